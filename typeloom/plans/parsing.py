"""Queries of problem 1: rows that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.sources.damaged_lines import loaded, rejected
from typeloom.tables import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(load(spark, sf_dir, "raw_words")).select("raw_id", "reason")


def p1_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(load(spark, sf_dir, "raw_words")).select(
        "raw_id", "layout", "number", "word", "count", "proposed", "pattern", "internet_rank", "corpus_rank_word", "corpus_rank_proposed", "verdict", "intended", "spelled"
    )


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(load(spark, sf_dir, "raw_words")).groupBy("file_name", "layout", "reason").agg(F.count("*").alias("n_lines"))


def p1_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per layout and column: lines whose value there is invalid; a line counts for each such column."""
    bad = rejected(load(spark, sf_dir, "raw_words")).select("layout", F.explode("bad_columns").alias("column"))
    return bad.groupBy("layout", "column").agg(F.count("*").alias("n_lines"))


def _f(sep: str) -> str:
    return f' *(?:"(?:[^"]|"")*" *|[^"{sep} ][^{sep}]*)?'


_T, _A = _f("\t").replace("\t", "\\t"), _f("→")
_NUM = r"(regexp_full_match({0}, '0*[1-9][0-9]{{0,9}}') AND TRY_CAST({0} AS BIGINT) <= 2147483647)"
_WORD = r"(regexp_full_match({0}, '\p{{L}}+(-\p{{L}}+)*') AND length({0}) BETWEEN 2 AND 32)"
_n = lambda i: _NUM.format(f"cols[{i}]")
_w = lambda i: _WORD.format(f"cols[{i}]")
_r = lambda i: f"(cols[{i}] = '' OR {_n(i)})"
_PARSED = rf"""
WITH t AS (
  SELECT *, regexp_replace(regexp_replace(raw_line, '^' || chr(65279) || '+', ''), '\r+$', '') AS line FROM raw_words
), a AS (
  SELECT *, CASE WHEN layout = 'pairs' THEN regexp_full_match(line, '{_A}(?:→{_A})*', 's') ELSE regexp_full_match(line, '{_T}(?:\t{_T})*', 's') END AS quoting_ok
  FROM t WHERE line IS NOT NULL AND NOT regexp_full_match(line, '\s*') AND NOT starts_with(line, '#')
), b AS (
  SELECT *, CASE WHEN quoting_ok THEN list_transform(
      CASE WHEN layout = 'pairs' THEN regexp_extract_all('→' || line, '→({_A})', 1) ELSE regexp_extract_all(chr(9) || line, '\t({_T})', 1) END,
      lambda x: CASE WHEN starts_with(trim(x, ' '), '"') THEN replace(substr(trim(x, ' '), 2, length(trim(x, ' ')) - 2), '""', '"') ELSE trim(x, ' ') END) END AS cols
  FROM a
), c AS (
  SELECT *, CASE
    WHEN NOT quoting_ok THEN 'quoting'
    WHEN len(cols) <> CASE layout WHEN 'words' THEN 3 WHEN 'review' THEN 9 ELSE 2 END THEN 'column_count'
    WHEN NOT CASE layout
      WHEN 'words' THEN {_n(1)} AND {_w(2)} AND {_n(3)}
      WHEN 'review' THEN {_n(1)} AND {_w(2)} AND {_w(3)} AND {_r(5)} AND {_r(6)} AND {_r(7)} AND cols[8] IN ('misspelling', 'misspelling-other', 'keep', '')
      ELSE {_w(1)} AND {_w(2)} END THEN 'invalid_value' END AS reason
  FROM b
)
"""

def _bad(name: str, rule: str) -> str:
    return f"CASE WHEN NOT coalesce({rule}, false) THEN '{name}' END"


_COLUMNS = f"""SELECT layout, "column", count(*) AS n_lines FROM (SELECT layout, unnest(CASE layout
  WHEN 'words' THEN [{_bad("number", _n(1))}, {_bad("word", _w(2))}, {_bad("count", _n(3))}]
  WHEN 'review' THEN [{_bad("number", _n(1))}, {_bad("word", _w(2))}, {_bad("proposed", _w(3))}, {_bad("internet_rank", _r(5))}, {_bad("corpus_rank_word", _r(6))}, {_bad("corpus_rank_proposed", _r(7))},
    {_bad("verdict", "cols[8] IN ('misspelling', 'misspelling-other', 'keep', '')")}]
  ELSE [{_bad("word", _w(1))}, {_bad("spelled", _w(2))}] END) AS "column" FROM c WHERE reason = 'invalid_value') WHERE "column" IS NOT NULL GROUP BY ALL"""

QUERIES = {"p1_found": p1_found, "p1_loaded": p1_loaded, "p1_report": p1_report, "p1_columns": p1_columns}
ORACLE = {
    "p1_found": _PARSED + "SELECT raw_id, reason FROM c WHERE reason IS NOT NULL",
    "p1_loaded": _PARSED
    + """SELECT raw_id, layout,
      CASE WHEN layout <> 'pairs' THEN TRY_CAST(cols[1] AS INT) END AS number,
      CASE WHEN layout = 'pairs' THEN cols[1] ELSE cols[2] END AS word,
      CASE WHEN layout = 'words' THEN TRY_CAST(cols[3] AS INT) END AS count,
      CASE WHEN layout = 'review' THEN cols[3] END AS proposed, CASE WHEN layout = 'review' THEN cols[4] END AS pattern,
      CASE WHEN layout = 'review' THEN TRY_CAST(cols[5] AS INT) END AS internet_rank,
      CASE WHEN layout = 'review' THEN TRY_CAST(cols[6] AS INT) END AS corpus_rank_word,
      CASE WHEN layout = 'review' THEN TRY_CAST(cols[7] AS INT) END AS corpus_rank_proposed,
      CASE WHEN layout = 'review' THEN cols[8] END AS verdict, CASE WHEN layout = 'review' THEN cols[9] END AS intended,
      CASE WHEN layout = 'pairs' THEN cols[2] END AS spelled
      FROM c WHERE reason IS NULL""",
    "p1_report": _PARSED + "SELECT file_name, layout, reason, count(*) AS n_lines FROM c WHERE reason IS NOT NULL GROUP BY ALL",
    "p1_columns": _PARSED + _COLUMNS,
}
