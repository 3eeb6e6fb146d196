"""Queries of the training-data operators, each with its SQL where SQL can express it on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm import copies, cross_split, encodings, leaks, one_form, packing, terms, toxicity
from typeloom.tables import load, written

# --- 2: same or nearly the same records across splits


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split.overlapping(load(spark, sf_dir, "sentence_corpus")).select(*cross_split.ordered("id_train", "id_other"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source: how many records overlap with train, in how many pairs."""
    rows = load(spark, sf_dir, "sentence_corpus")
    per_row = cross_split.overlapping(rows).groupBy("id_other").agg(F.count("*").alias("pairs"))
    other = rows.where("split <> 'train'").select("sent_id", "split", "source")
    return (
        other.join(per_row, other.sent_id == per_row.id_other, "left")
        .groupBy("split", "source")
        .agg(F.count("*").alias("n_records"), F.count("pairs").alias("n_overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"))
    )


def p2_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split.overlap_fractions(load(spark, sf_dir, "sentence_corpus"))


def _sql_words(c: str) -> str:
    """The words of a text in DuckDB, separated by single spaces."""
    return rf"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}} \t\n]+', '', 'g'), '[ \t\n]+', ' ', 'g'), ' ')"


_P2 = rf"""
WITH w AS (
  SELECT sent_id, split = 'train' AS train, split, source, list_distinct(string_split({_sql_words("sentence")}, ' ')) AS ws
  FROM sentence_corpus WHERE sentence IS NOT NULL AND split IS NOT NULL AND {_sql_words("sentence")} <> ''
), e AS (SELECT sent_id, train, len(ws) AS n, unnest(ws) AS word FROM w
), p AS (
  SELECT a.sent_id AS id_train, b.sent_id AS id_other FROM (SELECT * FROM e WHERE train) a JOIN (SELECT * FROM e WHERE NOT train) b USING (word)
  GROUP BY a.sent_id, b.sent_id, a.n, b.n HAVING count(*) * 17 >= 7 * (a.n + b.n)
)
"""

# --- 4: duplicates hidden by formatting differences


def _p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = copies.hashed(load(spark, sf_dir, "sentence_corpus"), "sent_id", _sentence_key(), "sentence_corpus")
    b = copies.hashed(load(spark, sf_dir, "sentence_lines"), "line_id", copies.json_key(F.col("payload"), "sentence"), "sentence_lines")
    return a.unionByName(b)


def _sentence_key():  # noqa: ANN202
    """The source counts as written, the sentence by its words."""
    return F.concat(F.col("source"), F.lit("\x01"), copies.word_text(F.col("sentence")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # hashes are read twice, for the groups and for their members: they are written, so that texts are not
    return copies.members(written(_p4_rows(spark, sf_dir), "hashes"))


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record once, with its number of copies."""
    return copies.groups(_p4_rows(spark, sf_dir)).select("table_name", "first_id", "n_copies")


def p4_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.collisions(_p4_rows(spark, sf_dir)).groupBy("table_name").agg(F.count("*").alias("n_hashes"))


_P4 = rf"""
WITH k AS (
  SELECT 'sentence_corpus' AS table_name, sent_id AS id, source || chr(1) || {_sql_words("sentence")} AS k FROM sentence_corpus WHERE sentence IS NOT NULL AND source IS NOT NULL
  UNION ALL
  SELECT 'sentence_lines', line_id, array_to_string(list_transform(list_sort(json_keys(payload)),
    lambda f: f || chr(2) || coalesce({_sql_words("json_extract_string(payload, '$.\"' || f || '\"')")}, chr(3))), chr(1))
  FROM sentence_lines WHERE payload IS NOT NULL AND (NOT list_contains(json_keys(payload), 'sentence') OR json_extract_string(payload, '$.sentence') IS NOT NULL)
), g AS (SELECT table_name, k, min(id) AS first_id, count(*) AS n_copies FROM k GROUP BY ALL)
"""

# --- 5: frequency of every distinct term


def _p5_counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    rows = load(spark, sf_dir, "word_tokens")
    n = rows.select("record_id").distinct().count()
    return terms.term_counts(rows, F.lower(F.trim("word")), "record_id", "token_id"), n


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.marked(*_p5_counts(spark, sf_dir)).where("mark is not null").select(F.col("term").alias("word"), "mark")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.marked(*_p5_counts(spark, sf_dir)).select(F.col("term").alias("word"), "occurrences", "records", F.coalesce("mark", F.lit("useful")).alias("mark"))


_P5 = """
WITH t AS (SELECT token_id, min(lower(trim(word, ' '))) AS word, min(record_id) AS record_id FROM word_tokens WHERE token_id IS NOT NULL GROUP BY token_id),
c AS (SELECT word, count(*) AS occurrences, count(DISTINCT record_id) AS records FROM t WHERE word <> '' GROUP BY word),
m AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records * 20 > (SELECT count(DISTINCT record_id) FROM word_tokens) THEN 'common' END AS mark FROM c)
"""

# --- 3: visually identical text with different characters

_DISGUISED = (("dev_label_review", "context"), ("known_misspellings_review", "word"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (one_form.disguised(load(spark, sf_dir, t).select("review_id", c), c).select(F.lit(t).alias("table_name"), "review_id") for t, c in _DISGUISED)
    return a.unionByName(b)


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its one form."""
    a, b = (one_form.canonical(load(spark, sf_dir, t).select("review_id", F.col(c).alias("text")), "text").select(F.lit(t).alias("table_name"), "review_id", "canonical") for t, c in _DISGUISED)
    return a.unionByName(b)


def p3_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are equal in their one form though written in several ways."""
    a, b = (one_form.canonical(load(spark, sf_dir, t).select(F.col(c).alias("text")), "text").select(F.lit(t).alias("table_name"), "canonical", "text") for t, c in _DISGUISED)
    return a.unionByName(b).where("canonical is not null").groupBy("table_name", "canonical").agg(F.count("*").alias("n_rows"), F.countDistinct("text").alias("n_forms")).where("n_forms > 1")


# --- 6: garbled text from wrong character encoding


def _p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "sentence_corpus").select(F.lit("sentence_corpus").alias("table_name"), F.col("sent_id").alias("row_id"), F.col("sentence").alias("text"))
    b = load(spark, sf_dir, "correction_pairs").select(F.lit("correction_pairs").alias("table_name"), F.col("pair_id").alias("row_id"), F.col("source").alias("text"))
    return a.unionByName(b)


def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _p6_texts(spark, sf_dir)
    return encodings.garbled(texts, encodings.fitted(texts))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_restored(spark, sf_dir).select("table_name", "row_id")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_restored(spark, sf_dir).groupBy("table_name", F.coalesce("chain", F.lit("beyond restoring")).alias("chain")).agg(F.count("*").alias("n_rows"))


# --- 7: filling fixed-capacity containers


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.documents_packed(load(spark, sf_dir, "documents"), load(spark, sf_dir, "context_windows"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(p7_packed(spark, sf_dir))


# --- 8: evaluation texts leaking into training text


def _p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p8(spark, sf_dir).where("exact").select("doc_id", "item_id")


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a whole item, word for word or nearly."""
    return _p8(spark, sf_dir).where("similarity is not null").select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per test set: items, leaked items and documents they leaked into; pairs by a run of exact words, with the whole item, and with nearly the whole item."""
    items = load(spark, sf_dir, "eval_items").select("item_id", "set_name")
    return items.join(_p8(spark, sf_dir), "item_id", "left").groupBy("set_name").agg(
        F.countDistinct("item_id").alias("n_items"),
        F.countDistinct(F.when(F.col("doc_id").isNotNull(), F.col("item_id"))).alias("n_leaked"),
        F.countDistinct("doc_id").alias("n_documents"),
        F.count(F.when(F.col("exact"), 1)).alias("n_exact_pairs"),
        F.count(F.when(F.col("similarity") == 1, 1)).alias("n_whole_pairs"),
        F.count(F.when(F.col("similarity") < 1, 1)).alias("n_near_pairs"),
    )


_P8 = rf"""
WITH i AS (SELECT item_id, string_split({_sql_words("text")}, ' ') AS ws FROM eval_items WHERE text IS NOT NULL AND {_sql_words("text")} <> ''),
q AS (SELECT item_id, len(ws) AS n, unnest(list_transform(range(1, greatest(1, len(ws) - 11) + 1), lambda k: array_to_string(ws[k:k + 11], ' '))) AS g, least(12, len(ws)) AS m FROM i),
d AS (SELECT doc_id, string_split({_sql_words("text")}, ' ') AS ws FROM documents WHERE text IS NOT NULL AND {_sql_words("text")} <> ''),
l AS (SELECT DISTINCT m FROM q),
w AS (SELECT DISTINCT doc_id, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda k: array_to_string(ws[k:k + m - 1], ' '))) AS g FROM d, l WHERE len(ws) >= m)
SELECT DISTINCT doc_id, item_id FROM w JOIN q USING (m, g)
"""


# --- 9: abusive, hateful or sexual content


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(load(spark, sf_dir, "documents"), load(spark, sf_dir, "doc_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scores(spark, sf_dir).where("score >= 0.5").select("doc_id")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rates(p9_scores(spark, sf_dir))


QUERIES = {
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p2_overlap": p2_overlap,
    "p3_found": p3_found,
    "p3_canonical": p3_canonical,
    "p3_same": p3_same,
    "p4_found": p4_found,
    "p4_records": p4_records,
    "p4_collisions": p4_collisions,
    "p5_found": p5_found,
    "p5_counts": p5_counts,
    "p6_found": p6_found,
    "p6_restored": p6_restored,
    "p6_report": p6_report,
    "p7_packed": p7_packed,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_near": p8_near,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
    "p9_report": p9_report,
}
ORACLE = {
    "p2_found": _P2 + "SELECT least(id_train, id_other) AS sent_id_1, greatest(id_train, id_other) AS sent_id_2 FROM p",
    "p2_report": _P2
    + """, o AS (SELECT id_other, count(*) AS pairs FROM p GROUP BY ALL)
    SELECT split, source, count(*) AS n_records, count(pairs) AS n_overlapping, CAST(coalesce(sum(pairs), 0) AS BIGINT) AS n_pairs
    FROM (SELECT * FROM sentence_corpus WHERE split <> 'train') s LEFT JOIN o ON s.sent_id = o.id_other GROUP BY ALL""",
    "p4_found": _P4 + "SELECT table_name, first_id AS id_1, id AS id_2 FROM k JOIN g USING (table_name, k) WHERE n_copies > 1 AND id <> first_id",
    "p4_records": _P4 + "SELECT table_name, first_id, n_copies FROM g",
    "p4_collisions": _P4 + "SELECT table_name, count(*) AS n_hashes FROM (SELECT table_name, md5(k) AS h FROM g GROUP BY ALL HAVING count(*) > 1) GROUP BY table_name",
    "p5_found": _P5 + "SELECT word, mark FROM m WHERE mark IS NOT NULL",
    "p8_found": _P8,
    "p5_counts": _P5 + "SELECT word, occurrences, records, coalesce(mark, 'useful') AS mark FROM m",
}
