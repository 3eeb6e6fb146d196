"""Choices offered for a word, rivals among unlisted forms, corrections of real words, and the search for common misspellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from typeloom.functions.edits import PATTERNS, confusion, deletes, misspelling_pattern
from typeloom.functions.hashing import letter_mask
from typeloom.functions.layout import convert
from typeloom.operators import correct as C


def two_edit_fill(typed: DataFrame, lex: DataFrame, most: int = 2, shortest: int = 6, cap: int = 50_000) -> DataFrame:
    """``lang, typed, word, rank, place``: frequent words two edits away, for typed words without a single-edit candidate.

    Both sides are joined on deletion keys; letters that differ in more than four places
    of the letter mask are discarded before distances are computed.
    """
    near = C.candidates(typed, lex, shortest, cap, ("en", "ru"))
    lone = near.where("dist = 1").select("lang", "typed").distinct()
    two = near.where("dist = 2").join(lone, ["lang", "typed"], "left_anti").where(F.bit_count(letter_mask(F.col("typed")).bitwiseXOR(letter_mask(F.col("word")))) <= 4)
    w = Window.partitionBy("lang", "typed").orderBy("rank", "word")
    return two.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("lang", "typed", "word", "rank", "place")


def unlisted_rivals(typed: DataFrame, lex: DataFrame, known: DataFrame) -> DataFrame:
    """``lang, typed, rival_score``: the best score of a known form that the ranked list lacks, one edit away."""
    size = lex.groupBy("lang").agg((F.max("rank") + 1).alias("rank"))
    forms = known.join(lex.select("lang", "word"), ["lang", "word"], "left_anti").join(F.broadcast(size), "lang").select("lang", "word", "rank")
    return C.scored(C.candidates(typed, forms).where("dist = 1")).groupBy("lang", "typed").agg(F.max("score").alias("rival_score"))


def manual_options(typed: DataFrame, lex: DataFrame, policy: C.Policy = C.MANUAL) -> DataFrame:
    """``lang, typed, kind, options`` for each distinct typed word: what successive presses offer, in order, joined by ``|``.

    ``kind`` tells the case: the converted word is known; a spelling is certain; there
    are spellings; there is nothing but the conversion.
    """
    base = typed.where("typed is not null").select("lang", "typed").distinct().withColumn("converted", convert(F.col("typed")))
    other = lex.select(F.when(F.col("lang") == "ru", "en").otherwise("ru").alias("lang"), F.col("word").alias("converted"), F.lit(True).alias("layout_known"))
    rows = C.scored(C.candidates(base.select("lang", "typed"), lex))
    top = C.best(rows).select("lang", "typed", F.col("word").alias("fix"), "margin", F.col("rank").alias("fix_rank"))
    alts = C.alternatives(rows).select("lang", "typed", F.split("options", ",").alias("alts"))
    j = base.join(other, ["lang", "converted"], "left").join(top, ["lang", "typed"], "left").join(alts, ["lang", "typed"], "left")
    cap = F.when(F.col("lang") == "ru", policy.rank_cap_ru).otherwise(policy.rank_cap_en)
    sure = F.coalesce((F.col("margin") >= policy.margin) & (F.col("fix_rank") <= cap) & (F.length("typed") >= policy.shortest), F.lit(False))
    spell = F.array_remove(F.coalesce("alts", F.array().cast("array<string>")), F.col("converted"))
    layout = F.array("converted")
    kind = F.when(F.col("layout_known"), "layout-known").when(sure, "spelling-certain").when(F.size(spell) > 0, "spelling").otherwise("layout")
    options = (
        F.when(F.col("layout_known"), F.concat(layout, spell))
        .when(sure, F.concat(F.array("fix"), F.array_remove(spell, F.col("fix"))))
        .when(F.size(spell) > 0, F.concat(spell, layout))
        .otherwise(layout)
    )
    return j.select("lang", "typed", kind.alias("kind"), F.array_join(options, "|").alias("options"))


def pressed(options: DataFrame, presses: int) -> DataFrame:
    """Adds ``shown``: what stands there after so many presses; after the last option the typed word comes back."""
    each = F.split("options", r"\|")
    k = F.pmod(F.lit(presses), F.size(each) + 1)
    return options.withColumn("shown", F.when(k == 0, F.col("typed")).otherwise(F.get(each, (k - 1).cast("int"))))


def real_word_fixes(pairs: DataFrame, lex: DataFrame, kinds: int = 7, least: int = 3, margin: float = 1.0) -> DataFrame:
    """``lang, prev, word, fixed, kind, margin``: known words in a context in which a word one edit away is far more frequent.

    ``pairs(lang, prev, next, cnt)`` are the neighbours seen; an edit of no particular
    kind must be ten times as frequent as the word itself.
    """
    one = lex.select("lang", F.col("word").alias("a"), F.col("cnt").alias("a_cnt"), F.explode(deletes(F.col("word"), 1)).alias("k"))
    two = lex.select("lang", F.col("word").alias("b"), F.col("cnt").alias("b_cnt"), F.explode(deletes(F.col("word"), 1)).alias("k"))
    near = one.join(two, ["lang", "k"]).where("a <> b").select("lang", "a", "b", "a_cnt", "b_cnt").distinct().withColumn("kind", confusion(F.col("a"), F.col("b")))
    near = near.where((F.col("kind").bitwiseAND(F.lit(kinds)) != 0) & ((F.col("kind") != 4) | (F.col("b_cnt") >= 10 * F.col("a_cnt"))))
    seen = pairs.select("lang", "prev", F.col("next").alias("a"), F.col("cnt").alias("typed_cnt"))
    cand = pairs.select("lang", "prev", F.col("next").alias("b"), F.col("cnt").alias("cand_cnt"))
    j = seen.join(near, ["lang", "a"]).join(cand, ["lang", "prev", "b"]).where(F.col("cand_cnt") >= least)
    w = Window.partitionBy("lang", "prev", "a").orderBy(F.desc("cand_cnt"), "b")
    j = j.withColumns({"place": F.row_number().over(w), "second": F.coalesce(F.lead("cand_cnt").over(w), F.lit(0))}).where("place = 1")
    j = j.withColumn("margin", F.ln((F.col("cand_cnt") + 0.5) / (F.greatest("typed_cnt", "second") + 0.5))).where(F.col("margin") >= margin)
    return j.select("lang", "prev", F.col("a").alias("word"), F.col("b").alias("fixed"), "kind", "margin")


def mined_misspellings(lex: DataFrame, known: DataFrame, shortest: int = 5, cap: int = 50_000, times: int = 20, letter_cap: int = 20_000, least: int = 3, lang: str = "ru") -> DataFrame:
    """``lang, word, right, pattern``: unknown words one explained edit from a known word that is far more frequent; the best pattern, then rank, counts.

    Words seen less than ``least`` times have no rank: they are no corrections, and only
    they may be explained by a missing letter.
    """
    mine = lex.where(F.col("lang") == lang)
    odd = mine.where(F.col("len") >= shortest).join(known, ["lang", "word"], "left_anti").select("lang", F.col("word").alias("w"), F.when(F.col("cnt") >= least, F.col("rank")).alias("w_rank"))
    right = mine.where((F.col("rank") <= cap) & (F.col("cnt") >= least)).join(known, ["lang", "word"], "left_semi").select("lang", F.col("word").alias("r"), F.col("rank").alias("r_rank"))
    keys = lambda df, c: df.withColumn("k", F.explode(deletes(F.col(c), 1)))
    near = keys(odd, "w").join(keys(right, "r"), ["lang", "k"]).where((F.col("w") != F.col("r")) & (F.col("w_rank").isNull() | (F.col("w_rank") >= times * F.col("r_rank"))) & (F.levenshtein("w", "r") == 1))
    near = near.select("lang", "w", "w_rank", "r", "r_rank").distinct().withColumn("pattern", misspelling_pattern(F.col("w"), F.col("r")))
    near = near.where(F.col("pattern").isNotNull() & ((F.col("pattern") != "missing_letter") | ((F.col("r_rank") <= letter_cap) & F.col("w_rank").isNull())))
    order = F.array_position(F.array(*map(F.lit, PATTERNS)), F.col("pattern"))
    best = near.groupBy("lang", "w").agg(F.min(F.struct(order.alias("o"), "r_rank", "r", "pattern")).alias("x"))
    return best.select("lang", F.col("w").alias("word"), F.col("x.r").alias("right"), F.col("x.pattern").alias("pattern"))
