from typeloom.sources.damaged_lines import loaded, parsed, rejected

CASES = [
    ("words", "1\tслово\t5", None),
    ("words", "﻿1\tслово\t5\r", None),
    ("words", ' "1" \t"a""b"\t2', "invalid_value"),
    ("words", '1\t"ab', "quoting"),
    ("words", '1\t"ab"x\t2', "quoting"),
    ("words", '1\t"ab"" \t2', "quoting"),
    ("words", '1\t"a\tb"\t2', "invalid_value"),
    ("words", "1\tab", "column_count"),
    ("words", "1\tab\t2\t", "column_count"),
    ("words", "0\tab\t2", "invalid_value"),
    ("words", "2147483648\tab\t2", "invalid_value"),
    ("words", "99999999999999999999\tab\t2", "invalid_value"),
    ("words", "1\ta\t2", "invalid_value"),
    ("words", "1\tab--c\t2", "invalid_value"),
    ("words", "1\tкто-то\t2", None),
    ("words", '1\ta"b\t2', "invalid_value"),
    ("review", "1\tслво\tслово\tx\t\t3\t4\tkeep\t", None),
    ("review", "1\tслво\tслово\tx\t\t3\t4\tmaybe\t", "invalid_value"),
    ("review", "1\tслво\tслово\tx\t-\t3\t4\tkeep\t", "invalid_value"),
    ("pairs", "слво → слово", None),
    ("pairs", "слво слово", "column_count"),
    ("pairs", "→слово", "invalid_value"),
    ("other", "x", "layout"),
    (None, "x", "layout"),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, a, b, "own") for i, (a, b, _) in enumerate(CASES)], "raw_id long, layout string, raw_line string, errors string")
    got = {r.raw_id: (r.errors[0].reason if r.errors else None) for r in parsed(df).collect()}
    assert got == {i: e for i, (_, _, e) in enumerate(CASES)}


def test_every_invalid_column_has_an_error(spark):
    lines = ["0\tслово\t5", "0\ta\t-1", "1\tслово\t5", '"0', "1\t2"]
    df = spark.createDataFrame([(i, "words", x) for i, x in enumerate(lines)], "raw_id long, layout string, raw_line string")
    assert {r.raw_id: (r.reason, r.bad_columns) for r in rejected(df).collect()} == {0: ("invalid_value", ["number"]), 1: ("invalid_value", ["number", "word", "count"]), 3: ("quoting", []), 4: ("column_count", [])}


def test_a_line_is_cut_once(spark):
    df = spark.createDataFrame([(1, "words", "1\tab\t2")], "raw_id long, layout string, raw_line string")
    plan = rejected(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2  # one for each separator


def test_skipped_lines_and_empty_table(spark):
    df = spark.createDataFrame([(1, "words", None), (2, "words", "  \t "), (3, "words", "# 1\tab\t2"), (4, "words", "﻿#"), (5, "words", "")], "raw_id long, layout string, raw_line string")
    assert parsed(df).count() == 0
    assert rejected(df.limit(0)).count() == 0 and loaded(df.limit(0)).count() == 0


def test_loaded_values_and_long_lines(spark):
    rows = [(1, "words", '1\t"слово"\t5'), (2, "review", "3\tслво\tслово\tx\t\t3\t4\tkeep\tда"), (3, "pairs", "слво→слово"), (4, "words", '1\t"' + 'a""' * 50_000), (1, "words", "1\tab\t2")]
    got = loaded(spark.createDataFrame(rows, "raw_id long, layout string, raw_line string")).collect()
    by = [(r.raw_id, r.word, r["count"], r.corpus_rank_word, r.spelled, r.intended) for r in got]
    assert sorted(by, key=str) == sorted([(1, "слово", 5, None, None, None), (2, "слво", None, 3, None, "да"), (3, "слво", None, None, "слово", None), (1, "ab", 2, None, None, None)], key=str)
