"""Keyboard layouts: conversion, scripts and key adjacency as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The same physical keys in both layouts, plain and shifted, and the rows of letter keys.
EN_KEYS = "`qwertyuiop[]asdfghjkl;'zxcvbnm,."
RU_KEYS = "ёйцукенгшщзхъфывапролджэячсмитьбю"
EN_SHIFTED = '~QWERTYUIOP{}ASDFGHJKL:"ZXCVBNM<>'
RU_SHIFTED = "ЁЙЦУКЕНГШЩЗХЪФЫВАПРОЛДЖЭЯЧСМИТЬБЮ"
EN_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
RU_ROWS = ("йцукенгшщзхъ", "фывапролджэ", "ячсмитьбю")
# Words never converted because they are so frequent, and endings of domain names.
FREQUENT = (
    "the and for you that this with from have your are was but not can our all one has will "
    "это что как для его она они при или есть так все уже где если нет нам вам"
).split()
DOMAIN_ENDINGS = ("com", "org", "net", "ru", "io", "wiki", "site", "co", "uk", "рф")

FROM = EN_KEYS + EN_SHIFTED + RU_KEYS + RU_SHIFTED
TO = RU_KEYS + RU_SHIFTED + EN_KEYS + EN_SHIFTED


def convert(c: Column) -> Column:
    """What the same keys type in the other layout; other characters stay. Applying it twice changes nothing."""
    return F.translate(c, FROM, TO)


def convert_letters(c: Column) -> Column:
    """Converts letters only and leaves punctuation as typed."""
    pairs = [(a, b) for a, b in zip(FROM, TO, strict=True) if a.isalpha()]
    return F.translate(c, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def has_latin(c: Column) -> Column:
    return c.rlike("[A-Za-z]")


def has_cyrillic(c: Column) -> Column:
    return c.rlike("[А-Яа-яЁё]")


def script(c: Column) -> Column:
    """``en`` or ``ru`` where letters of only that script occur, else ``other``; ``other`` for null."""
    return F.when(has_latin(c) & ~has_cyrillic(c), "en").when(has_cyrillic(c) & ~has_latin(c), "ru").otherwise("other")


def _neighbours(rows: tuple[str, ...]) -> list[str]:
    at = {k: (r, i) for r, row in enumerate(rows) for i, k in enumerate(row)}
    return sorted(a + b for a, (r, i) in at.items() for b, (s, j) in at.items() if a != b and abs(r - s) <= 1 and abs(i - j) <= 1)


#: Every two letters of adjacent keys, by script.
ADJACENT = {"en": _neighbours(EN_ROWS), "ru": _neighbours(RU_ROWS)}


def adjacent(a: Column, b: Column) -> Column:
    """Whether two letters lie on adjacent keys of one layout."""
    return F.concat(a, b).isin(ADJACENT["en"] + ADJACENT["ru"])
