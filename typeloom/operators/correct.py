"""Spelling candidates as equi-joins on deletion keys, their scores and decisions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeloom.functions.edits import confusion, deletes, distance, edit_cost, is_transposition
from typeloom.functions.hashing import keep_probability
from typeloom.functions.text import context_normal, is_capitalized, plain, recapitalized
from typeloom.tables import written

#: The lead of a reviewed misspelling: above every threshold.
MISSPELLING_LEAD = 5.0


@dataclass(frozen=True)
class Policy:
    """Thresholds of a decision; variants are made with ``dataclasses.replace``."""

    margin: float = 2.2
    russian_margin: float = 4.0
    rank_cap_en: int = 12_000
    rank_cap_ru: int = 50_000
    shortest: int = 4
    shortest_ru: int = 5
    russian: bool = True
    #: Weight of how typical a candidate is after the word before, and the least it may be.
    context_weight: float = 0.5
    context_veto: float = float("-inf")
    #: Known words are replaced by confusions of these kinds that are so much likelier after the word before.
    kinds: int = 1
    real_word_margin: float = 3.0
    real_word_pairs: int = 20
    #: Whether capitals are judged only at the start of a sentence, and the lead they need.
    capitals_at_start: bool = True
    capital_margin: float = 4.0
    reason: str = "typo"


AUTO = Policy()
MANUAL = Policy(margin=2.5, russian_margin=2.5, rank_cap_ru=200_000, shortest_ru=4, context_weight=0.0, kinds=0, capitals_at_start=False, capital_margin=0.0, reason="typo-manual")


@dataclass(frozen=True)
class Evidence:
    """What spellings are judged by; tables of any size.

    ``ranked(lang, word, rank)`` are the words that corrections are taken from, with ``bonus``, what a word's letters
    add to its score, and ``shown``, how the word is spelled with all its letters, if it has such columns; ``known(lang, word)`` all words that are right. ``misspellings(word, spelled)``,
    ``seen(word)``, ``colloquial(word)`` hold Russian words; ``exceptions(token)`` any. ``pairs(prev, next, cnt)`` are neighbours in Russian
    texts and ``counts(word, cnt)`` how often words occur in ``total`` words; ``contexts(word, cnt)`` those among them that count as a word before.
    """

    ranked: DataFrame
    known: DataFrame
    misspellings: DataFrame | None = None
    seen: DataFrame | None = None
    colloquial: DataFrame | None = None
    exceptions: DataFrame | None = None
    pairs: DataFrame | None = None
    contexts: DataFrame | None = None
    counts: DataFrame | None = None
    total: int = 0


def _index_keys(deep_rank: int, deep: Column | None = None) -> Column:
    far = F.col("rank") <= deep_rank
    return F.when(far if deep is None else far & deep, deletes(F.col("word"), 2)).otherwise(deletes(F.col("word"), 1))


def delete_index(lex: DataFrame, deep_rank: int = 15_000) -> DataFrame:
    """``lang, del_key, word, rank``: two deletions for frequent words, one for the others."""
    return lex.select("lang", "word", "rank", F.explode(_index_keys(deep_rank)).alias("del_key"))


def _hashed(keys: Column, lang: Column) -> Column:
    """Keys of a language as numbers, which shuffle and sort faster; a collision costs one comparison more."""
    return F.explode(F.transform(keys, lambda k: F.xxhash64(lang, k)))


def candidates(typed: DataFrame, lex: DataFrame, deep_length: int = 8, deep_rank: int = 10_000, deep_langs: tuple[str, ...] = ("en",)) -> DataFrame:
    """``lang, typed, word, rank, dist`` and the columns that ``lex`` has beside: words at distance 1, or 2 for long typed and frequent words of ``deep_langs``.

    ``typed`` has distinct ``lang, typed``. Both sides are exploded into deletion keys and
    joined on them, so no pair without a common key is ever compared.
    """
    deep = F.col("lang").isin(*deep_langs)
    keys = F.when((F.length("typed") >= deep_length) & deep, deletes(F.col("typed"), 2)).otherwise(deletes(F.col("typed"), 1))
    beside = [c for c in lex.columns if c not in ("lang", "word", "rank", "key", "cnt", "len")]
    # words grow some fiftyfold into keys: spread them first, as partitions sized by the words' bytes would be too few
    n = int(typed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    typed, lex = typed.repartition(n, "typed"), lex.repartition(n, "word")
    q = typed.select("lang", "typed", _hashed(keys, F.col("lang")).alias("k"))
    index = lex.select(F.col("lang").alias("word_lang"), "word", "rank", *beside, _hashed(_index_keys(max(15_000, deep_rank), deep), F.col("lang")).alias("k"))
    near = (F.col("lang") == F.col("word_lang")) & (F.abs(F.length("typed") - F.length("word")) <= 2)
    # the same fiftyfold is missing from the planner's estimate: without the hint all keys are gathered on the driver and sent to every task
    pairs = q.join(index.hint("merge"), "k").where(near).select("lang", "typed", "word", "rank", *beside).distinct()
    # most pairs that share a key are further apart: these go before anything costs more
    pairs = pairs.withColumn("_far", F.levenshtein("typed", "word", 2)).where("_far >= 0")
    swapped = F.when(F.col("_far") == 2, is_transposition(F.col("typed"), F.col("word"))).otherwise(False)
    return pairs.withColumn("dist", F.when(swapped, 1).otherwise(F.col("_far")).cast("int")).drop("_far").where((F.col("dist") == 1) | ((F.col("dist") == 2) & deep & (F.length("typed") >= deep_length) & (F.col("rank") <= deep_rank)))


def one_edit_pairs(lex: DataFrame) -> DataFrame:
    """``lang, word, other``: all ordered pairs of a language's words at distance 1, whatever their letters and length.

    Words one edit apart share a key of at most one deletion; a key of n letters belongs to no
    more than n + 1 times the alphabet's words, so no group of the join grows with the data.
    """
    n = int(lex.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = lex.select("lang", "word").repartition(n, "word").select("lang", "word", _hashed(deletes(F.col("word")), F.col("lang")).alias("k"))
    others = keys.select(F.col("lang").alias("other_lang"), F.col("word").alias("other"), "k")
    near = (F.col("lang") == F.col("other_lang")) & (F.col("word") != F.col("other")) & (F.abs(F.length("word") - F.length("other")) <= 1)
    pairs = keys.join(others, "k").where(near).select("lang", "word", "other").distinct()
    return pairs.where(distance(F.col("word"), F.col("other")) == 1)


def scored(found: DataFrame) -> DataFrame:
    """Adds ``cost`` and ``score``: frequency against edit cost, and ``bonus`` where there is one; a second edit costs 3.2."""
    cost = F.when(F.col("dist") == 2, 3.2).otherwise(edit_cost(F.col("typed"), F.col("word"), F.col("lang") == "ru"))
    score = -F.ln(F.col("rank") + 15) - 1.5 * F.col("cost")
    return found.withColumn("cost", cost).withColumn("score", score + F.coalesce("bonus", F.lit(0.0)) if "bonus" in found.columns else score)


def letter_bonus(language: Column, logit: Column, threshold: float) -> Column:
    """What a word's letters add to its score: their mean log probability, and how surely the word is in no wrong layout."""
    return 0.65 * language + 0.3 * F.ln(F.greatest(F.lit(1e-6), keep_probability(logit, threshold)))


def best(rows: DataFrame, by: tuple[str, ...] = ("lang", "typed")) -> DataFrame:
    """The best candidate of each typed word with its lead over the second (4 for an only one)."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "rank", "word")
    first = rows.withColumns({"place": F.row_number().over(w), "second": F.lead("score").over(w)}).where("place = 1")
    return first.withColumn("margin", F.when(F.col("second").isNull(), 4.0).otherwise(F.col("score") - F.col("second"))).drop("place", "second")


def pair_facts(rows: DataFrame, e: Evidence, word: str = "word") -> DataFrame:
    """Adds ``pair_cnt``, how often ``word`` follows ``previous``, and ``lift``, by how much more than their frequencies suggest; 0 for an unknown word before."""
    if e.pairs is None:
        return rows.withColumns({"pair_cnt": F.lit(0), "lift": F.lit(0.0)})
    j = rows.join(e.contexts.select(F.col("word").alias("previous"), F.col("cnt").alias("_prev_cnt")), "previous", "left")
    j = j.join(e.pairs.select(F.col("prev").alias("previous"), F.col("next").alias(word), F.col("cnt").alias("_pair_cnt")), ["previous", word], "left")
    j = j.join(e.counts.select(F.col("word").alias(word), F.col("cnt").alias("_cnt")), word, "left")
    n = F.coalesce("_pair_cnt", F.lit(0))
    lift = F.when(F.col("_prev_cnt").isNull() | F.col("_cnt").isNull(), 0.0).otherwise(F.ln((n + 2.0) / (F.col("_prev_cnt") * F.col("_cnt") / e.total + 2.0)))
    return j.withColumns({"pair_cnt": F.when(F.col("_prev_cnt").isNull(), 0).otherwise(n), "lift": lift}).drop("_prev_cnt", "_pair_cnt", "_cnt")


def real_words(known: DataFrame, e: Evidence, policy: Policy) -> DataFrame:
    """``typed, previous, fixed, kind, fix_margin`` of known Russian ``typed`` after ``previous``: a confusion that is much likelier there.

    Confusions of endings are found by the ending, other kinds among all words one edit away.
    """
    t = known.where((F.length("typed") >= policy.shortest_ru) & F.col("previous").isNotNull()).select("typed", "previous").distinct()
    w = t.select("typed").distinct()
    ending = lambda a, b: F.when(F.col("typed").endswith(a), F.concat(F.substr("typed", F.lit(1), F.length("typed") - len(a)), F.lit(b)))
    if policy.kinds == 1:
        other = w.withColumn("word", F.coalesce(ending("ться", "тся"), ending("тся", "ться"))).where("word is not null").withColumn("kind", F.lit(1))
        other = other.join(e.ranked.where("lang = 'ru'").select("word", "rank"), "word")
    else:
        other = candidates(w.withColumn("lang", F.lit("ru")), e.ranked.where("lang = 'ru'").select("lang", "word", "rank"), deep_langs=()).withColumn("kind", confusion(F.col("typed"), F.col("word")))
    other = other.where((F.col("kind").bitwiseAND(F.lit(policy.kinds)) != 0) & (F.col("rank") <= policy.rank_cap_ru))
    if e.misspellings is not None:
        other = other.join(e.misspellings.select("word"), "word", "left_anti")
    counts = e.counts.select(F.col("word").alias("typed"), F.col("cnt").alias("_own"))
    other = other.join(counts, "typed", "left").join(e.counts.select("word", F.col("cnt").alias("_other")), "word", "left")
    other = other.where((F.col("kind") != 4) | (F.coalesce("_other", F.lit(0)) >= 10 * F.coalesce("_own", F.lit(0)))).select("typed", "word", "rank", "kind")
    j = pair_facts(t.join(other, "typed"), e).withColumnRenamed("pair_cnt", "there").drop("lift")
    j = pair_facts(j, e, "typed").drop("lift")
    by = Window.partitionBy("typed", "previous").orderBy(F.desc("there"), "rank", "word")
    j = j.withColumns({"place": F.row_number().over(by), "second": F.coalesce(F.lead("there").over(by), F.lit(0))}).where("place = 1")
    j = j.withColumn("fix_margin", F.ln((F.col("there") + 0.5) / (F.greatest("pair_cnt", "second") + 0.5)))
    return j.where((F.col("there") >= policy.real_word_pairs) & (F.col("fix_margin") >= policy.real_word_margin)).select("typed", "previous", F.col("word").alias("fixed"), "kind", "fix_margin")


def _lists(e: Evidence) -> DataFrame:
    """All lists as one table: what each word is known for."""
    ru = lambda df, *more: df.select(F.lit("ru").alias("lang"), plain(F.lower("word")).alias("typed"), *more)
    parts = [e.known.select("lang", plain(F.col("word")).alias("typed"), F.lit("known").alias("what"))]
    for name in ("seen", "colloquial"):
        if getattr(e, name) is not None:
            parts.append(ru(getattr(e, name), F.lit(name).alias("what")))
    if e.misspellings is not None:
        parts.append(ru(e.misspellings, F.concat(F.lit("="), F.col("spelled")).alias("what")))
    if e.exceptions is not None:
        parts.append(e.exceptions.select(F.explode(F.array(F.lit("ru"), F.lit("en"))).alias("lang"), plain(F.lower("token")).alias("typed"), F.lit("excepted").alias("what")))
    each = parts[0]
    for p in parts[1:]:
        each = each.unionByName(p)
    has = lambda what: F.max(F.col("what") == what).alias(what)
    return each.where("typed is not null").groupBy("lang", "typed").agg(has("known"), has("seen"), has("colloquial"), has("excepted"), F.max(F.when(F.col("what").startswith("="), F.substr("what", F.lit(2)))).alias("spelled"))


def decisions(words: DataFrame, e: Evidence, policy: Policy = AUTO) -> DataFrame:
    """``word, previous, at_start, corrected, reason, margin`` for each distinct ``word, previous, at_start``.

    ``previous`` is the word before (null for none), ``at_start`` whether the word begins a sentence. A Russian word with a
    capital is judged in small letters and gets its capital back: at the start of a
    sentence, or anywhere where the policy does not care. Lists and known words settle most words
    by one join; candidates are searched for once per distinct word, and only their scores after
    different words before differ. What is settled and the best candidates are written between, so that neither
    is computed again by what follows. The script of the words before adds the same to every candidate and
    is left out. Null words are left out.
    """
    w = words.where("word is not null").select("word", context_normal(F.col("previous")).alias("previous"), F.coalesce("at_start", F.lit(False)).alias("at_start")).distinct()
    capital = is_capitalized(F.col("word")) & (F.lit(not policy.capitals_at_start) | (F.col("at_start") & F.col("word").rlike("^[А-Яа-яЁё]+$")))
    typed = F.when(capital, F.concat(F.lower(F.substring("word", 1, 1)), F.substr("word", F.lit(2)))).otherwise(F.col("word"))
    w = w.withColumns({"capital": capital, "typed": plain(typed)})
    w = w.withColumn("lang", F.when(F.col("typed").rlike("^[а-я]+$"), "ru").when(F.col("typed").rlike("^[a-z]+$"), "en"))
    w = w.join(_lists(e), ["lang", "typed"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    ru = F.coalesce(F.col("lang") == "ru", F.lit(False))
    early = (
        F.when(~F.col("typed").rlike(r"^\p{L}{4,32}$"), "protected-shape")
        .when(F.col("typed").rlike(r"\p{Lu}"), "protected-case")
        .when(yes("excepted"), "exception")
        .when(F.col("lang").isNull(), "protected-script")
        .when(ru & F.lit(not policy.russian), "ru-typo-disabled")
        .when(ru & (F.length("typed") < policy.shortest_ru), "protected-shape")
        .when(F.col("spelled").isNotNull(), policy.reason + "-known-misspelling")
        .when(yes("known"), "known-original")
        .when(yes("seen"), "known-corpus")
        .when(yes("colloquial"), "colloquial")
    )
    w = written(w.withColumn("early", early), "settled")
    if policy.kinds and e.pairs is not None:
        w = w.join(real_words(w.where(ru & (F.col("early") == "known-original")), e, policy), ["typed", "previous"], "left")
    else:
        w = w.withColumns({"fixed": F.lit(None).cast("string"), "kind": F.lit(None).cast("int"), "fix_margin": F.lit(None).cast("double")})
    ranked = e.ranked if "shown" in e.ranked.columns else e.ranked.withColumn("shown", F.col("word"))
    open_ = w.where("early is null").select("lang", "typed", "previous").distinct()
    found = scored(candidates(open_.select("lang", "typed").distinct(), ranked))
    if e.misspellings is not None:
        found = found.join(e.misspellings.select(F.lit("ru").alias("lang"), "word").distinct(), ["lang", "word"], "left_anti")
    rows = open_.join(found.select("lang", "typed", "word", "shown", "rank", "score"), ["lang", "typed"])
    if e.pairs is not None and (policy.context_weight or policy.context_veto > float("-inf")):
        rows = pair_facts(rows, e).withColumn("lift", F.when(F.col("lang") == "ru", F.col("lift")).otherwise(0.0))
        rows = rows.withColumn("score", F.col("score") + policy.context_weight * F.col("lift"))
    else:
        rows = rows.withColumn("lift", F.lit(0.0))
    top = written(best(rows, ("lang", "typed", "previous")), "best")
    # words that are known but not ranked are scored as if they came right behind the ranked ones
    size = e.ranked.groupBy("lang").agg((F.max("rank") + 1).alias("rank"))
    forms = e.known.where("lang = 'ru'").select("lang", plain(F.col("word")).alias("word")).distinct().join(e.ranked.select("lang", "word"), ["lang", "word"], "left_anti")
    if e.misspellings is not None:
        forms = forms.join(e.misspellings.select("word"), "word", "left_anti")
    rivals = scored(candidates(top.where("lang = 'ru'").select("lang", "typed").distinct(), forms.join(F.broadcast(size), "lang").select("lang", "word", "rank"))).groupBy("lang", "typed").agg(F.max("score").alias("rival"))
    same = lambda *c: reduce(and_, (F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}")) for x in c))
    top = top.select("lang", "typed", "previous", F.col("shown").alias("found"), "rank", "score", "lift", F.col("margin").alias("lead")).join(rivals, ["lang", "typed"], "left")
    out = w.alias("a").join(top.alias("b"), same("lang", "typed", "previous"), "left").select("a.*", "b.found", "b.rank", "b.score", "b.lift", "b.lead", "b.rival")
    cap = F.when(ru, policy.rank_cap_ru).otherwise(policy.rank_cap_en)
    gap = F.col("score") - F.col("rival")
    lead = F.when(ru & F.col("rival").isNotNull(), F.least("lead", gap)).otherwise(F.col("lead"))
    kind = F.when(F.col("kind") == 1, "tsya").when(F.col("kind") == 2, "2pl").otherwise("edit")
    plain_reason = (
        F.when(F.col("fixed").isNotNull(), F.concat(F.lit(policy.reason + "-context-"), kind))
        .when(F.col("early").isNotNull(), F.col("early"))
        .when(F.col("found").isNull(), "no-candidate")
        .when((F.col("lead") < policy.margin) | (F.col("rank") > cap), "ambiguous-candidate")
        .when(ru & F.col("rival").isNotNull() & (gap < policy.margin), "ambiguous-form")
        .when(ru & (lead < policy.russian_margin), "ambiguous-candidate")
        .when(ru & (F.col("lift") < policy.context_veto), "context-mismatch")
        .otherwise(policy.reason)
    )
    out = out.withColumn("reason", plain_reason)
    right = F.when(F.col("fixed").isNotNull(), F.col("fixed")).when(F.col("reason") == policy.reason + "-known-misspelling", F.col("spelled")).when(F.col("reason") == policy.reason, F.col("found"))
    sure = F.when(F.col("fixed").isNotNull(), F.col("fix_margin")).when(F.col("reason") == policy.reason + "-known-misspelling", MISSPELLING_LEAD).when(F.col("reason") == policy.reason, lead)
    out = out.withColumns({"corrected": right, "margin": sure})
    weak = F.col("capital") & F.col("corrected").isNotNull() & (F.col("margin") < policy.capital_margin)
    return out.select(
        "word",
        "previous",
        "at_start",
        F.when(weak, None).when(F.col("capital"), recapitalized(F.col("corrected"))).otherwise(F.col("corrected")).alias("corrected"),
        F.when(weak, "ambiguous-capital").otherwise(F.col("reason")).alias("reason"),
        F.when(~weak, F.col("margin")).alias("margin"),
    )


def alternatives(rows: DataFrame, most: int = 2, lead: float = 6.0) -> DataFrame:
    """Up to ``most`` candidates within ``lead`` of the best, as a joined list in order."""
    w = Window.partitionBy("lang", "typed").orderBy(F.desc("score"), "rank", "word")
    near = rows.withColumns({"place": F.row_number().over(w), "top": F.max("score").over(Window.partitionBy("lang", "typed"))}).where((F.col("place") <= most) & (F.col("top") - F.col("score") <= lead))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"])
    return near.groupBy("lang", "typed").agg(F.array_join(listed, ",").alias("options"))
