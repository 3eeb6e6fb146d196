"""Tokens, ranked lexicons, form lists, trigram models and word pairs from a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeloom.functions.hashing import ngrams
from typeloom.functions.text import letter_runs, plain


def language(source: Column) -> Column:
    """Language of a corpus by the prefix of its name; null for others."""
    return F.when(source.startswith("rus_"), "ru").when(source.startswith("eng_"), "en")


def tokens(sentences: DataFrame) -> DataFrame:
    """``sent_id, lang, pos, word`` of ``sent_id, source, sentence``; null texts have no tokens."""
    return sentences.select("sent_id", language(F.col("source")).alias("lang"), F.posexplode(letter_runs(F.col("sentence"))).alias("pos", "word"))


def pure(lang: Column, word: Column) -> Column:
    """Whether a word consists of 2 to 32 letters of its language."""
    return ((lang == "en") & word.rlike("^[a-z]{2,32}$")) | ((lang == "ru") & word.rlike("^[а-яё]{2,32}$"))


def fanned(words: DataFrame) -> DataFrame:
    """Distinct words over all shuffle partitions before they are expanded into many parts each; partitions sized by the words' bytes would be too few."""
    return words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")


def with_rank(words: DataFrame, to: str = "rank", letters: int = 3) -> DataFrame:
    """Adds the place of each word of its language by (``cnt`` descending, ``word``), without sorting a language in one task.

    Words of equal count and beginning form small groups that are ranked by themselves;
    how many words come before a group follows from a table of the groups alone.
    """
    w = words.withColumn("_begin", F.substring("word", 1, letters))
    group = w.groupBy("lang", "cnt", "_begin").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("lang").orderBy(F.desc("cnt"), "_begin").rowsBetween(Window.unboundedPreceding, -1))
    group = group.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("lang", "cnt", "_begin").orderBy("word"))
    return w.withColumn("_within", within).join(group, ["lang", "cnt", "_begin"]).withColumn(to, (F.col("_before") + F.col("_within")).cast("int")).drop("_begin", "_within", "_before")


def ranked(tok: DataFrame, least: int = 1) -> DataFrame:
    """``lang, word, key, cnt, rank, len``: words by frequency, ties in the order of the alphabet.

    Counts are combined before the shuffle and spellings with ё and е merged under the
    more frequent one; only distinct words are ranked.
    """
    cnt = tok.where(pure(F.col("lang"), F.col("word"))).groupBy("lang", "word").agg(F.count("*").alias("cnt"))
    merged = (
        cnt.groupBy("lang", plain(F.col("word")).alias("key"))
        .agg(F.max(F.struct("cnt", "word")).alias("best"), F.sum("cnt").alias("total"))
        .select("lang", F.col("best.word").alias("word"), "key", F.col("total").alias("cnt"))
        .where(F.col("cnt") >= least)
    )
    return with_rank(merged).select("lang", "word", "key", "cnt", "rank", F.length("word").alias("len"))


def form_list(lex: DataFrame, known: DataFrame, least: int = 3, limit: int = 200_000) -> DataFrame:
    """Frequent known forms, at most ``limit`` a language, ranked anew (semi join, then rank)."""
    kept = lex.where(F.col("cnt") >= least).join(known, ["lang", "word"], "left_semi").select("lang", "word", "cnt")
    return with_rank(kept, "form_rank").where(F.col("form_rank") <= limit).select("lang", "word", "cnt", "form_rank")


def seen_forms(lex: DataFrame, known: DataFrame, least: int = 5, length: int = 5) -> DataFrame:
    """Frequent forms that are not known words: they are left alone (anti join)."""
    return lex.where((F.col("cnt") >= least) & (F.col("len") >= length)).join(known, ["lang", "word"], "left_anti").select("lang", "word", "cnt")


def trigram_model(lex: DataFrame, pad: str, weight: Column) -> DataFrame:
    """``lang, gram, weight``: weighted counts of the trigrams of ``pad + word + $``."""
    grams = fanned(lex).select("lang", weight.alias("w"), F.explode(ngrams(F.concat(F.lit(pad), F.col("word"), F.lit("$")), 3)).alias("gram"))
    return grams.groupBy("lang", "gram").agg(F.sum("w").alias("weight"))


def language_scores(words: DataFrame, model: DataFrame, pad: str, smooth: float, letters: Column | None) -> DataFrame:
    """``lang, word, score`` of each distinct ``lang, word``: the mean log probability of the word's trigrams.

    With ``letters`` (alphabet size per language) unseen trigrams share ``smooth`` times
    its cube, else ``smooth`` times the number of trigrams of the model. The model has trigrams of
    letters of one alphabet each, under 70,000 in all, and is sent to every task.
    """
    totals = model.groupBy("lang").agg(F.sum("weight").alias("total"), F.count("*").alias("kinds"))
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # words are spread by themselves before they grow into trigrams; what follows stays where it is
    each = words.select("lang", "word").repartition(n, "lang", "word").distinct().select("lang", "word", F.explode(ngrams(F.concat(F.lit(pad), F.col("word"), F.lit("$")), 3)).alias("gram"))
    kinds = F.col("kinds") if letters is None else letters * letters * letters
    p = F.ln((F.coalesce("weight", F.lit(0.0)) + smooth) / (F.col("total") + smooth * kinds))
    return each.join(F.broadcast(model), ["lang", "gram"], "left").join(F.broadcast(totals), "lang").groupBy("lang", "word").agg(F.avg(p).alias("score"))


def neighbours(texts: DataFrame) -> DataFrame:
    """``lang, prev, next, cnt`` of neighbouring words within a text of ``lang, ws``, taken from the array itself; counts combine before the shuffle."""
    n = F.size("ws")
    each = F.arrays_zip(F.slice("ws", 1, n - 1).alias("prev"), F.slice("ws", 2, n - 1).alias("next"))
    return texts.where(n > 1).select("lang", F.inline(each)).groupBy("lang", "prev", "next").agg(F.count("*").alias("cnt"))


def word_arrays(sentences: DataFrame) -> DataFrame:
    """``sent_id, lang, ws`` of ``sent_id, source, sentence``: the words of each text in order."""
    return sentences.select("sent_id", language(F.col("source")).alias("lang"), letter_runs(F.col("sentence")).alias("ws"))


def pair_counts(texts: DataFrame, lex: DataFrame, previous: int = 16_383, nexts: int = 200_000) -> DataFrame:
    """``lang, prev, next, cnt`` of neighbours within a text of ``lang, ws``, limited to frequent words."""
    prev = lex.where(F.col("rank") <= previous).select("lang", F.col("word").alias("prev"), F.col("cnt").alias("prev_cnt"))
    nxt = lex.where(F.col("rank") <= nexts).select("lang", F.col("word").alias("next"), F.col("cnt").alias("next_cnt"), F.col("rank").alias("next_rank"))
    return neighbours(texts).join(prev, ["lang", "prev"]).join(nxt, ["lang", "next"]).select("lang", "prev", "next", "cnt", "prev_cnt", "next_cnt", "next_rank")


def pair_lift(pairs: DataFrame, totals: DataFrame, alpha: float = 2.0) -> DataFrame:
    """Adds ``lift``: how much more often a pair occurs than its words' frequencies suggest."""
    joined = pairs.join(F.broadcast(totals), "lang")
    return joined.withColumn("lift", F.ln((F.col("cnt") + alpha) / (F.col("prev_cnt") * F.col("next_cnt") / F.col("total") + alpha)))
