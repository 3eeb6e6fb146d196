"""Loading separated text lines while setting apart the ones that cannot be read (problem 1).

Every column is loaded as nullable text, cast and constraint rules are evaluated as
built-in column expressions into an array of errors, one for each column that breaks
a rule, and rows are split by whether that array is empty. There is no Python code on
the data path and no shuffle. A line is cut by one pattern, once: its columns pass
through a generator of one row, which the optimizer does not fold into the rules that
read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separator and number of columns of each layout.
LAYOUTS = {"words": ("\t", 3), "review": ("\t", 9), "pairs": ("→", 2)}
WORD = r"^\p{L}+(?:-\p{L}+)*$"
DIGITS = r"^0*[1-9][0-9]{0,9}$"
VERDICTS = ("misspelling", "misspelling-other", "keep", "")
#: Names of the columns of each layout, in the order of the line.
COLUMNS = {
    "words": ("number", "word", "count"),
    "review": ("number", "word", "proposed", "pattern", "internet_rank", "corpus_rank_word", "corpus_rank_proposed", "verdict", "intended"),
    "pairs": ("word", "spelled"),
}


def _field(sep: str) -> str:
    """One column: quoted (quotes inside doubled) or plain, with spaces around it."""
    return rf' *(?:"(?:[^"]++|"")*+" *|[^"{sep} ][^{sep}]*+)?'


def _is_word(c: Column) -> Column:
    return c.rlike(WORD) & F.length(c).between(2, 32)


def _is_number(c: Column) -> Column:
    return c.rlike(DIGITS) & (c.try_cast("bigint") <= 2147483647)


def _unquoted(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.startswith('"'), F.replace(t.substr(F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"'))).otherwise(t)


def _rules(layout: str) -> list[tuple[str, Column]]:
    """The rule of each column that has one, in the order of the line."""
    rank = lambda c: (c == "") | _is_number(c)
    rules = {"number": _is_number, "count": _is_number, "word": _is_word, "proposed": _is_word, "spelled": _is_word, "internet_rank": rank, "corpus_rank_word": rank, "corpus_rank_proposed": rank, "verdict": lambda c: c.isin(*VERDICTS)}
    return [(name, rules[name](F.get("cols", F.lit(i)))) for i, name in enumerate(COLUMNS[layout]) if name in rules]


def _error(reason: str, column: str | None = None) -> Column:
    return F.struct(F.lit(reason).alias("reason"), F.lit(column).cast("string").alias("column"))


def parsed(df: DataFrame, line: str = "raw_line", layout: str = "layout") -> DataFrame:
    """Adds ``cols`` (array of nullable text) and ``errors`` (array of reason and column) to every line that counts.

    Errors of form have no column and come alone; each column with an invalid value has
    an error of its own, in the order of the line. Byte order marks before and carriage returns after a
    line are ignored. Null lines, lines of white space and lines beginning with ``#`` are
    left out: they hold no record. A line of a null or unknown layout has the error
    ``layout``. An empty table gives an empty result; other columns of ``df`` pass through
    unchanged, but for columns named ``cols`` and ``errors``, which are replaced.
    """
    text = F.rtrim(F.ltrim(F.col(line), F.lit("\ufeff")), F.lit("\r"))
    df = df.drop("cols", "errors").withColumn("_text", text).where(F.col("_text").isNotNull() & ~F.col("_text").startswith("#") & ~F.col("_text").rlike(r"(?U)^\s*$"))
    separator, pieces = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for sep in dict.fromkeys(sep for sep, _ in LAYOUTS.values()):
        here = F.col(layout).isin(*[name for name, (own, _) in LAYOUTS.items() if own == sep])
        separator = F.when(here, sep).otherwise(separator)
        pieces = F.when(here, F.regexp_extract_all(F.concat(F.lit(sep), F.col("_text")), F.lit(f"{sep}({_field(sep)})"), 1)).otherwise(pieces)
    # columns that leave nothing out between them are all of the line; else a quote is out of place
    whole = lambda x: F.aggregate(x, F.lit(0), lambda n, c: n + F.length(c) + 1) == F.length("_text") + 1
    once = F.transform(F.array(pieces), lambda x: F.struct(F.when(whole(x), F.transform(x, _unquoted)).alias("cols"), x.isNull().alias("_lost")))
    df = df.select("*", F.inline(once))
    errors = F.when(F.col("_lost"), F.array(_error("layout"))).when(F.col("cols").isNull(), F.array(_error("quoting")))
    for name, (_, n) in LAYOUTS.items():
        here = F.col(layout) == name
        bad = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), _error("invalid_value", c)) for c, ok in _rules(name)]))
        errors = errors.when(here & (F.size("cols") != n), F.array(_error("column_count"))).when(here, bad)
    return df.withColumn("errors", errors).drop("_text", "_lost")


def rejected(df: DataFrame, line: str = "raw_line", layout: str = "layout") -> DataFrame:
    """The lines that cannot be read, with ``reason``, the first error's, and ``bad_columns``, those with invalid values; duplicates of a line are each kept."""
    bad = parsed(df, line, layout).where(F.size("errors") > 0)
    return bad.withColumns({"reason": F.col("errors")[0]["reason"], "bad_columns": F.array_compact(F.col("errors.column"))}).drop("cols", "errors")


def loaded(df: DataFrame, line: str = "raw_line", layout: str = "layout") -> DataFrame:
    """The readable lines with typed columns; a column that a layout lacks, and an empty rank, is null."""
    ok = parsed(df, line, layout).where(F.size("errors") == 0)
    out = {}
    for name in dict.fromkeys(c for cs in COLUMNS.values() for c in cs):
        value = F.lit(None).cast("string")
        for lay, cs in COLUMNS.items():
            if name in cs:
                value = F.when(F.col(layout) == lay, F.col("cols")[cs.index(name)]).otherwise(value)
        out[name] = value.try_cast("int") if "rank" in name or name in ("number", "count") else value
    return ok.withColumns(out).drop("cols", "errors")
