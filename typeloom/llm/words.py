"""The words of a text, as all operators of this subpackage take them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower-cased text without anything but letters, digits, spaces, tabs and line feeds.
_NOT_WORD = r"[^\p{L}\p{N} \t\n]+"


def word_text(c: Column) -> Column:
    """The words of ``c``, separated by single spaces; empty for a text without words, null for null."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(c), _NOT_WORD, ""), r"[ \t\n]+", " "), F.lit(" "))


def words(c: Column) -> Column:
    """The words of ``c`` as an array; empty for a text without words, null for null."""
    t = word_text(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def word_hashes(c: Column) -> Column:
    """64-bit hashes of the words of ``c`` in their order, made with one pattern less than :func:`words`."""
    pieces = F.split(F.regexp_replace(F.lower(c), _NOT_WORD, ""), r"[ \t\n]+")
    return F.transform(F.array_remove(pieces, ""), lambda w: F.xxhash64(w))
