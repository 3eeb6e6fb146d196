"""Duplicates hidden by formatting differences (problem 4).

Records are brought to a canonical form (characters, case, white space, punctuation,
field order), hashed to 128 bits, and counted with map-side combining. A second,
independent 64-bit hash of the canonical form travels along as collision check and is
part of the group key, so that a collision of the first never merges records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.llm.words import word_text


def text_key(*cols: Column) -> Column:
    """Canonical form of a flat record; null if any column is null."""
    return F.concat(*[x for c in cols for x in (word_text(c), F.lit("\x01"))])


def json_key(payload: Column, needed: str) -> Column:
    """Canonical form of a JSON object: names in order, each with the words of its value.

    Null, text that is no object, and objects whose field ``needed`` is null have none.
    """
    fields = F.from_json(payload, "map<string,string>")
    entries = F.array_sort(F.map_keys(fields))
    key = F.array_join(F.transform(entries, lambda k: F.concat(k, F.lit("\x02"), F.coalesce(word_text(fields[k]), F.lit("\x03")))), "\x01")
    return F.when(~F.map_contains_key(fields, F.lit(needed)) | fields[needed].isNotNull(), key)


def hashed(df: DataFrame, id_col: str, key: Column, name: str) -> DataFrame:
    """``table_name, id, h, check``; records without a canonical form are left out."""
    return (
        df.select(F.col(id_col).alias("id"), key.alias("k"))
        .where(F.col("k").isNotNull() & F.col("id").isNotNull())
        .select(F.lit(name).alias("table_name"), "id", F.unhex(F.md5("k")).alias("h"), F.xxhash64("k").alias("check"))
    )


def groups(rows: DataFrame) -> DataFrame:
    """One row per distinct record: ``table_name, h, check, first_id, n_copies``; partial counts before the shuffle."""
    return rows.groupBy("table_name", "h", "check").agg(F.min("id").alias("first_id"), F.count("*").alias("n_copies"))


def collisions(rows: DataFrame) -> DataFrame:
    """128-bit hashes under which different canonical forms were found."""
    return groups(rows).groupBy("table_name", "h").agg(F.count("*").alias("n_forms")).where("n_forms > 1")


def members(rows: DataFrame) -> DataFrame:
    """``table_name, id_1, id_2``: each copy with the smallest id of its group.

    The join's other side has one row per group, so adaptive execution can split a group
    of any size over many tasks. A null record is no copy of anything; an empty table
    gives an empty result; an id that occurs again within its group counts as a copy but
    is not paired with itself.
    """
    many = groups(rows).where("n_copies > 1").select("table_name", "h", "check", F.col("first_id").alias("id_1"))
    return rows.join(many, ["table_name", "h", "check"]).where("id <> id_1").select("table_name", "id_1", F.col("id").alias("id_2"))
