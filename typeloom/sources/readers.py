"""Readers and writers of the text formats in which lists, pairs, reviews and reports come."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from typeloom.functions.layout import script
from typeloom.functions.text import plain, sentences, training_tokens


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines of whole text files; list files are small, corpora are read with ``spark.read.text`` or parquet."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    return whole.withColumn("line", F.btrim("line", F.lit(" \t﻿")))


def ranked_words(spark: SparkSession, path: str) -> DataFrame:
    """``word, key, rank``: letters only, 2 to 32 of them; the first of each ё/е form counts, ranks number the kept words."""
    w = _lines(spark, path).select("file", "at", F.lower("line").alias("word")).where(F.col("word").rlike(r"^\p{L}{2,32}$")).withColumn("key", plain(F.col("word")))
    first = w.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("file", "at"))).where("k = 1")
    return first.select("word", "key", F.row_number().over(Window.orderBy("file", "at")).alias("rank"))


def counted_words(spark: SparkSession, path: str, total: int = 1_000_000) -> DataFrame:
    """``word, frequency`` of lines ``word [count]``; without a count the frequency falls with the rank within its file; a word's last line counts."""
    w = _lines(spark, path).where("line <> ''").withColumn("parts", F.split("line", " +")).withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy("at")))
    count = F.get("parts", F.lit(1)).try_cast("bigint")
    w = w.select(F.lower(F.col("parts")[0]).alias("word"), F.greatest(F.lit(1), F.coalesce(count, F.greatest(F.lit(1), F.floor(F.lit(total) / F.col("rank"))))).alias("frequency"), "file", "at")
    return w.groupBy("word").agg(F.max_by("frequency", F.struct("file", "at")).alias("frequency"))


def word_set(spark: SparkSession, path: str) -> DataFrame:
    """Distinct words of a list with comments."""
    return _lines(spark, path).where("line <> '' and line not like '#%'").select(plain(F.lower("line")).alias("word")).distinct()


def word_pairs(spark: SparkSession, path: str, arrow: str = "→") -> DataFrame:
    """``word, spelled`` of lines ``wrong → right``; lines without two sides are left out, and a word's last line counts."""
    p = _lines(spark, path).where("line <> '' and line not like '#%'").select("file", "at", F.split("line", arrow, 2).alias("p")).where(F.size("p") == 2)
    p = p.select("file", "at", plain(F.lower(F.trim(F.col("p")[0]))).alias("word"), F.lower(F.trim(F.col("p")[1])).alias("spelled")).where("word <> '' and spelled <> ''")
    return p.groupBy("word").agg(F.max_by("spelled", F.struct("file", "at")).alias("spelled"))


def typos_in_context(spark: SparkSession, path: str) -> DataFrame:
    """``context, typed, intended`` of lines ``words typed → intended``; also with ``->`` or a tab."""
    p = _lines(spark, path).where("line <> '' and line not like '#%'").select(F.split("line", "→|->|\t", 2).alias("p")).where(F.size("p") == 2)
    ws = F.split(F.trim(F.col("p")[0]), r"\s+")
    return p.select(F.slice(ws, 1, F.size(ws) - 1).alias("context"), F.element_at(ws, -1).alias("typed"), F.trim(F.col("p")[1]).alias("intended"))


def sentences_after_tab(spark: SparkSession, path: str) -> DataFrame:
    """``source, sentence, lang`` of lines cut at the first tab; lines without one are left out."""
    p = spark.read.text(path).select(F.split("value", "\t", 2).alias("p")).where(F.size("p") == 2)
    return p.select(F.col("p")[0].alias("source"), F.col("p")[1].alias("sentence"), F.when(F.col("p")[0].startswith("rus_"), "ru").otherwise("en").alias("lang"))


def corpus_counts(spark: SparkSession, path: str) -> DataFrame:
    """``word, cnt`` of tab-separated lines whose last field is a number and whose second is the word, summed over files."""
    p = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") >= 3).select(F.col("p")[1].alias("word"), F.element_at("p", -1).try_cast("bigint").alias("n"))
    return p.where("n is not null").groupBy("word").agg(F.sum("n").alias("cnt"))


def treebank_texts(spark: SparkSession, path: str, genre: str = "social") -> DataFrame:
    """Texts of a treebank's comments that stand under a marker of the wanted genre: the last marker before a line counts."""
    lines = _lines(spark, path)
    mark = F.when(F.col("line").startswith("# genre ="), F.trim(F.substring_index("line", "=", -1)))
    w = Window.partitionBy("file").orderBy("at")
    return lines.withColumn("genre", F.last(mark, ignorenulls=True).over(w)).where(F.col("line").startswith("# text =") & (F.col("genre") == genre)).select(F.trim(F.expr("substring(line, 9)")).alias("sentence"))


def json_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``source, correction`` of JSON lines; byte order marks at the ends go, blank lines are left out."""
    p = spark.read.schema("source string, correction string").json(path).where("source is not null or correction is not null")
    return p.select(*[F.btrim(c, F.lit("﻿")).alias(c) for c in ("source", "correction")])


def reviews(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A review sheet: tab-separated, named columns, comments with ``#``, spreadsheet quoting."""
    r = spark.read.option("sep", "\t").option("comment", "#").option("header", True).option("quote", '"').option("escape", '"')
    return (r.schema(schema) if schema else r).csv(path)


def domain_texts(spark: SparkSession, path: str, keys: tuple[str, ...] = ("vo", "voiceover", "narration", "script", "text", "line", "spoken_text"), most: int = 8) -> DataFrame:
    """``file, at, sentence`` of text, Markdown and JSON files: the first ``most`` sentences of three words or more of each file with at least two.

    Of JSON the strings under ``keys`` are taken, at any depth; code blocks of Markdown, addresses and tags are
    left out. Files that are no JSON though named so hold no sentence.
    """

    def strings(value, key: str = ""):  # noqa: ANN001, ANN202
        todo = [(value, key)]
        while todo:  # without recursion: documents may be nested deeply
            v, k = todo.pop()
            if isinstance(v, dict):
                todo.extend((x, str(n)) for n, x in reversed(v.items()))
            elif isinstance(v, list):
                todo.extend((x, k) for x in reversed(v))
            elif isinstance(v, str) and k.lower() in keys:
                yield v

    def read(frames):  # noqa: ANN001, ANN202
        for f in frames:
            out = []
            for name, text in zip(f["file"], f["value"], strict=True):
                if name.endswith(".json"):
                    try:
                        text = "\n".join(strings(json.loads(text)))
                    except ValueError:
                        text = ""
                out.append((name, text))
            yield pd.DataFrame(out, columns=["file", "value"])

    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value").mapInPandas(read, "file string, value string")
    text = F.when(F.col("file").endswith(".md"), F.regexp_replace("value", r"(?s)```.*?```", " ")).otherwise(F.col("value"))
    text = F.regexp_replace(text, r"https?://\S+|www\.\S+|<[^>]*>", " ")
    own = F.filter(sentences(text), lambda s: F.size(F.filter(training_tokens(s), lambda w: (F.length(w) <= 35) & (script(w) != "other"))) >= 3)
    found = whole.select("file", own.alias("all")).where(F.size("all") >= 2)
    return found.select("file", F.posexplode(F.slice("all", 1, most)).alias("at", "sentence"))


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder of tab-separated files per split."""
    df.write.mode("overwrite").partitionBy(split).option("sep", "\t").option("quote", "").csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of a few rows as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_review(df: DataFrame, path: str, order: list[str]) -> None:
    """Numbered rows for reviewers, in order; the sheet is meant for people and small."""
    df.select(F.row_number().over(Window.orderBy(*order)).alias("id"), *df.columns).coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).option("escape", '"').csv(path)


def comparison(df: DataFrame, row: str, mode: str, value: str) -> DataFrame:
    """One row per ``row``, one column per ``mode``."""
    return df.groupBy(row).pivot(mode).agg(F.first(value))
