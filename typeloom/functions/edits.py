"""Edit distances, edit costs and candidate keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from typeloom.functions.layout import EN_ROWS, RU_ROWS, adjacent

# Alphabets that candidates are made of.
EN_LETTERS = "abcdefghijklmnopqrstuvwxyz"
RU_LETTERS = "абвгдежзийклмнопрстуфхцчшщъыьэюя"


def first_mismatch(a: Column, b: Column) -> Column:
    """Place (from 1) of the first difference; one more than the shorter length if there is none before its end."""
    n = F.least(F.length(a), F.length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.get(F.filter(places, lambda i: a.substr(i, F.lit(1)) != b.substr(i, F.lit(1))), F.lit(0)), n + 1)


def _rest(c: Column, start: Column) -> Column:
    return c.substr(start, F.length(c))


def _with(value: Column, made) -> Column:  # noqa: ANN001
    """``made(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def is_transposition(a: Column, b: Column) -> Column:
    """Exactly two adjacent letters are swapped; false for equal words."""
    at = lambda i: (a.substr(i, F.lit(1)) == b.substr(i + 1, F.lit(1))) & (a.substr(i + 1, F.lit(1)) == b.substr(i, F.lit(1))) & (_rest(a, i + 2) == _rest(b, i + 2))
    # a swap is two replacements: most pairs are told without looking for the place
    return F.when((F.length(a) == F.length(b)) & (F.levenshtein(a, b, 2) == 2), _with(first_mismatch(a, b), at)).otherwise(F.when(a.isNotNull() & b.isNotNull(), False))


def _next_key(a: Column, b: Column, i: Column) -> Column:
    return (F.length(a) == F.length(b)) & (a != b) & (_rest(a, i + 1) == _rest(b, i + 1)) & adjacent(a.substr(i, F.lit(1)), b.substr(i, F.lit(1)))


def is_adjacent_substitution(a: Column, b: Column) -> Column:
    """One letter is replaced by that of an adjacent key."""
    return _with(first_mismatch(a, b), lambda i: _next_key(a, b, i))


def distance(a: Column, b: Column) -> Column:
    """1 for a transposition, else Levenshtein distance."""
    return F.when(is_transposition(a, b), 1).otherwise(F.levenshtein(a, b))


def edit_cost(typed: Column, candidate: Column, russian: Column) -> Column:
    def cost(i: Column) -> Column:
        initial = F.when(russian & (i == 1), 0.5).otherwise(0.0)
        longer = F.when(F.length(typed) > F.length(candidate), typed).otherwise(candidate)
        sign = longer.substr(i, F.lit(1)).isin("ь", "ъ")
        second = (F.length(candidate) > F.length(typed)) & (i > 1) & (candidate.substr(i - 1, F.lit(1)) == "ш") & _rest(candidate, i + 1).isin("", "ся")
        return (
            F.when((F.abs(F.length(typed) - F.length(candidate)) == 1) & russian & sign, F.when(second, 0.0).otherwise(0.3))
            .when(F.abs(F.length(typed) - F.length(candidate)) == 1, F.lit(0.75) + initial)
            .when(is_transposition(typed, candidate), F.lit(0.55) + initial)
            .when(_next_key(typed, candidate, i), F.lit(0.65) + initial)
            .otherwise(F.lit(1.0) + initial)
        )

    return _with(first_mismatch(typed, candidate), cost)


def confusion(typed: Column, intended: Column) -> Column:
    """0 no single edit, 1 -тся/-ться, 2 -ете/-ите, 4 another edit."""
    swap = lambda a, b, x, y: a.endswith(x) & b.endswith(y) & (a.substr(F.lit(1), F.length(a) - len(x)) == b.substr(F.lit(1), F.length(b) - len(y)))
    return (
        F.when((typed == intended) | (distance(typed, intended) != 1), 0)
        .when(swap(typed, intended, "тся", "ться") | swap(typed, intended, "ться", "тся"), 1)
        .when((F.length(typed) > 4) & (swap(typed, intended, "ете", "ите") | swap(typed, intended, "ите", "ете")), 2)
        .otherwise(4)
    )


# The patterns of misspellings in their order of priority, and what z for s may end.
PATTERNS = ("soft_hard_sign", "tsya", "double_letter", "z_s_prefix", "unstressed_vowel", "sh_shch", "missing_letter")
Z_PREFIXES = ("раз", "без", "из", "воз", "низ", "через")


def misspelling_pattern(word: Column, right: Column) -> Column:
    """The pattern by which ``word`` is a slip of ``right``, one edit apart; null where none explains it.

    A letter is replaced: signs for each other, з for с at the start or where it ends a
    prefix, unstressed vowels but for the last letter, hissing letters. A letter is missing
    or too many: a sign, one of a double letter, or any inside the word.
    """
    i = first_mismatch(word, right)
    tsya = lambda x, y: x.endswith("тся") & (y == F.concat(x.substr(F.lit(1), F.length(x) - 3), F.lit("ться")))
    replaced = (F.length(word) == F.length(right)) & (word != right) & (_rest(word, i + 1) == _rest(right, i + 1))
    a, b = word.substr(i, F.lit(1)), right.substr(i, F.lit(1))
    either = lambda x, y: ((a == x) & (b == y)) | ((a == y) & (b == x))
    longer = F.when(F.length(word) > F.length(right), word).otherwise(right)
    shorter = F.when(F.length(word) > F.length(right), right).otherwise(word)
    one_more = (F.length(longer) == F.length(shorter) + 1) & (_rest(longer, i + 1) == _rest(shorter, i))
    extra = longer.substr(i, F.lit(1))
    double = ((i > 1) & (extra == longer.substr(i - 1, F.lit(1)))) | ((i < F.length(longer)) & (extra == longer.substr(i + 1, F.lit(1))))
    return (
        F.when(tsya(word, right) | tsya(right, word), "tsya")
        .when(
            replaced,
            F.when(either("ь", "ъ"), "soft_hard_sign")
            .when((a == "з") & (b == "с") & ((i == 1) | word.substr(F.lit(1), i).isin(*Z_PREFIXES)), "z_s_prefix")
            .when((either("а", "о") | either("е", "и")) & (i < F.length(word)), "unstressed_vowel")
            .when(either("ш", "щ") | either("ч", "щ"), "sh_shch"),
        )
        .when(one_more, F.when(extra.isin("ь", "ъ"), "soft_hard_sign").when(double, "double_letter").when((i > 1) & (i < F.length(longer)), "missing_letter"))
    )


def deletes(word: Column, depth: int = 1) -> Column:
    """The word and all words with up to ``depth`` letters removed."""
    def once(w: Column) -> Column:
        return F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(w.substr(F.lit(1), i - 1), _rest(w, i + 1)))).otherwise(F.array().cast("array<string>"))

    out = F.array_distinct(F.concat(F.array(word), once(word)))
    return out if depth == 1 else F.array_distinct(F.concat(out, F.flatten(F.transform(out, once))))


def single_edits(word: Column, letters: str, swaps: bool = True) -> Column:
    """All words one deletion, swap, replacement or insertion away."""
    n = F.length(word)
    alphabet = F.split(F.lit(letters), "")
    alphabet = F.filter(alphabet, lambda x: x != "")
    head = lambda i: word.substr(F.lit(1), i - 1)
    at = lambda i: word.substr(i, F.lit(1))
    every = F.sequence(F.lit(1), n)
    parts = [
        F.transform(every, lambda i: F.concat(head(i), _rest(word, i + 1))),
        F.flatten(F.transform(every, lambda i: F.transform(alphabet, lambda x: F.concat(head(i), x, _rest(word, i + 1))))),
        F.flatten(F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.transform(alphabet, lambda x: F.concat(head(i), x, _rest(word, i))))),
    ]
    if swaps:
        parts.append(F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(head(i), at(i + 1), at(i), _rest(word, i + 2)))).otherwise(F.array().cast("array<string>")))
    return F.array_remove(F.array_distinct(F.concat(*parts)), word)


def _next_keys() -> dict[str, str]:
    out = {}
    for row in (*EN_ROWS, *RU_ROWS):
        for i, k in enumerate(row):
            out[k] = row[i + 1] if i + 1 < len(row) else row[i - 1]
    return out


NEXT_KEY = _next_keys()


def make_typo(word: Column, seed: Column) -> Column:
    """A reproducible slip: an inner letter deleted, swapped with the next, or replaced by the neighbouring key."""
    i = 2 + seed % F.greatest(F.length(word) - 2, F.lit(1))
    i = i.cast("int")
    a, b = word.substr(i, F.lit(1)), word.substr(i + 1, F.lit(1))
    head = word.substr(F.lit(1), i - 1)
    kind = seed % 3
    deleted = F.concat(head, _rest(word, i + 1))
    return (
        F.when((kind == 0) | ((kind == 1) & (a == b)), deleted)
        .when(kind == 1, F.concat(head, b, a, _rest(word, i + 2)))
        .otherwise(F.concat(head, F.translate(a, "".join(NEXT_KEY), "".join(NEXT_KEY.values())), _rest(word, i + 1)))
    )


def osa(a: str, b: str) -> int:
    """Optimal string alignment distance."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


@F.pandas_udf(IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def align(typed: list[str], fixed: list[str]) -> list[tuple[int, int | None]]:
    """For each typed word the place of its counterpart: equal words along a longest common subsequence, words of gaps of equal length one to one, else None."""
    n, m = len(typed), len(fixed)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if typed[i] == fixed[j] else max(best[i + 1][j], best[i][j + 1])
    anchors, i, j = [], 0, 0
    while i < n and j < m:
        if typed[i] == fixed[j]:
            anchors.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    out: list[tuple[int, int | None]] = []
    i = j = 0
    for x, y in [*anchors, (n, m)]:
        same = x - i == y - j
        out.extend((i + k, j + k if same else None) for k in range(x - i))
        if x < n:
            out.append((x, y))
        i, j = x + 1, y + 1
    return out


@F.pandas_udf(ArrayType(StructType([StructField("typed", StringType()), StructField("intended", StringType())])))
def aligned_words(typed: pd.Series, fixed: pd.Series) -> pd.Series:
    rows = []
    for a, b in zip(typed, fixed, strict=True):
        a, b = ([] if x is None else list(x) for x in (a, b))
        rows.append([{"typed": a[i], "intended": None if j is None else b[j]} for i, j in align(a, b)])
    return pd.Series(rows)
