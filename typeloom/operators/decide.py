"""Whether a word was typed in the wrong keyboard layout: rule cascades over precomputed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.functions.layout import FREQUENT, convert, has_cyrillic, has_latin
from typeloom.functions.text import shape_reason
from typeloom.operators.lexicon import language_scores

#: Digits to which scores are rounded before they are compared with a threshold.
PLACES = 6


def looked_up(tokens: DataFrame, lex: DataFrame, model: DataFrame, exceptions: DataFrame | None = None, pad: str = "^^", smooth: float = 0.1) -> DataFrame:
    """One row per distinct ``token`` with what its two readings are: as typed, and by the same keys in the other layout.

    Adds ``converted, from_known, to_known, excepted, source_score, target_score``. Both readings of all
    tokens are looked up in the word list, among the ``exceptions(token)`` and in the trigram model at once. ``lex``
    holds words of each language's own letters.
    """
    t = tokens.select("token").where("token is not null").distinct()
    from_lang = F.when(has_latin(F.col("token")), "en").otherwise("ru")
    side = lambda name, lang, word: F.struct(F.lit(name).alias("side"), lang.alias("lang"), word.alias("word"))
    both = F.array(side("from", from_lang, F.lower("token")), side("to", F.when(from_lang == "en", "ru").otherwise("en"), F.lower(convert(F.col("token")))))
    each = t.select("token", F.inline(both))
    facts = language_scores(each.select("lang", "word"), model, pad, smooth, None).join(lex.select("lang", "word").distinct().withColumn("known", F.lit(True)), ["lang", "word"], "left")
    if exceptions is not None:
        facts = facts.join(exceptions.select(F.lower("token").alias("word")).distinct().withColumn("excepted", F.lit(True)), "word", "left")
    else:
        facts = facts.withColumn("excepted", F.lit(False))
    of = lambda name, c: F.max(F.when(F.col("side") == name, F.col(c)))
    known = lambda name: F.coalesce(of(name, "known"), F.lit(False))
    out = each.join(facts, ["lang", "word"], "left").groupBy("token").agg(
        known("from").alias("from_known"), known("to").alias("to_known"), F.coalesce(F.max("excepted"), F.lit(False)).alias("excepted"), of("from", "score").alias("source_score"), of("to", "score").alias("target_score")
    )
    return out.withColumn("converted", convert(F.col("token")))


def legacy_decisions(words: DataFrame, lex: DataFrame, model: DataFrame) -> DataFrame:
    """The rule cascade that needs word lists only: ``token, converted, should_convert, reason, margin``, and ``target_context`` if given.

    ``words`` has ``token`` and, optionally, ``target_context``, whether the words before it
    are in the script it would be converted to. Null tokens are left out. Look-ups are
    made once per distinct token.
    """
    names = [c for c in ("target_context",) if c in words.columns]
    w = words.where("token is not null").select("token", *names).join(looked_up(words, lex, model), "token")
    w = w.withColumn("margin", F.col("target_score") - F.col("source_score"))
    t, n, ctx = F.col("token"), F.length("token"), F.coalesce("target_context", F.lit(False)) if names else F.lit(False)
    letters = F.regexp_replace(t, r"[^\p{L}]", "")
    caps = ~letters.rlike(r"[^\p{Lu}]")
    dots = F.length(F.regexp_replace(t, "[^.]", ""))
    reason = (
        F.when((n < 1) | (n > 64), "length")
        .when(t.rlike(r"[\p{Nd}\s@/\\_\-:+=#]"), "structured-token")
        .when(has_latin(t) == has_cyrillic(t), "mixed-or-unsupported-script")
        .when(t.rlike(r"^.[^\p{Lu}]*\p{Lu}") & ~caps, "identifier")
        .when((n <= 4) & caps, "abbreviation")
        .when(~t.rlike(r"^[\p{L}`\[\];',.]*$"), "symbols")
        .when((dots > 1) | ((dots > 0) & ~t.rlike(r"^[^.]*\.$")), "domain-or-dot")
        .when(~F.col("converted").rlike(r"^[\p{L}']*$"), "unsupported-target")
        .when(F.col("from_known") & ~(ctx & (n <= 3) & F.col("to_known")), "known-original")
        .when(n == 1, F.when(ctx & F.col("to_known"), "context-single-letter").otherwise("length"))
        .when(ctx & (n <= 3) & F.col("to_known"), "context-short-word")
        .when((n <= 3) & F.col("from_known") & ~ctx, "ambiguous-short")
        .when(F.col("to_known"), F.when(F.col("margin") >= F.when(ctx, -1.0).otherwise(0.25), "known-target-and-language-margin").otherwise("ambiguous-score"))
        .when((n >= 4) & (F.col("source_score") <= -10.0) & (F.col("target_score") >= -9.1) & (F.col("margin") >= 2.6), "trigram-unknown-target")
        .otherwise("insufficient-language-evidence")
    )
    convert_reasons = ("context-single-letter", "context-short-word", "known-target-and-language-margin", "trigram-unknown-target")
    w = w.withColumn("reason", reason)
    return w.select("token", *names, "converted", F.col("reason").isin(*convert_reasons).alias("should_convert"), "reason", "margin")


#: Reasons of :func:`layout_reason` for which a token is converted.
CONVERTING = ("context-short-word", "trained-model")


def layout_reason(near: Column, threshold: float | None) -> Column:
    """The first rule of the current cascade that applies to a row of :func:`looked_up` with ``logit``.

    ``near`` tells whether one of the two words before is in the script the token would be
    converted to. Without a threshold no score is high enough.
    """
    t, n = F.col("token"), F.length("token")
    sure = F.lit(False) if threshold is None else F.coalesce(F.col("logit") > threshold, F.lit(False))
    frequent = F.lower(t).isin(*FREQUENT)
    shape = shape_reason(t)
    return (
        F.when(shape == "length", shape)
        .when(F.col("excepted"), "exception")
        .when(shape.isNotNull(), shape)
        .when((n <= 3) & near & F.col("to_known") & ~frequent, "context-short-word")
        .when(n == 1, "length")
        .when(frequent | F.col("from_known"), "known-original")
        .when(sure, "trained-model")
        .otherwise("model-below-threshold")
    )


def trigram_logits(found: DataFrame) -> DataFrame:
    """Adds ``logit`` to rows of :func:`looked_up`: how much likelier the converted reading is, by the mean log odds of its trigrams."""
    return found.withColumn("logit", F.round(F.col("target_score") - F.col("source_score"), PLACES))


def layout_decisions(words: DataFrame, lex: DataFrame, model: DataFrame, threshold: float | None, exceptions: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """The current cascade with context and a scoring model: ``token, near, converted, should_convert, reason, logit``.

    ``words`` has ``token`` and ``near``, whether one of the two words before is in the script the
    token would be converted to; null counts as no. The model is that of trigrams, or any whose ``scores(token, logit)``
    are given; a token is converted for a logit above ``threshold``. Tokens and conversions in
    ``exceptions(token)`` stay, whatever their case. Null tokens are left out.
    """
    found = looked_up(words, lex, model, exceptions)
    found = trigram_logits(found) if scores is None else found.join(scores.select("token", "logit"), "token", "left")
    w = words.where("token is not null").select("token", F.coalesce("near", F.lit(False)).alias("near")).join(found, "token")
    w = w.withColumn("reason", layout_reason(F.col("near"), threshold))
    return w.select("token", "near", "converted", F.col("reason").isin(*CONVERTING).alias("should_convert"), "reason", "logit")
