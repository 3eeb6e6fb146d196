"""Tokenisers, normalisations and predicates on text as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from typeloom.functions.layout import DOMAIN_ENDINGS, convert, has_cyrillic, has_latin

# What counts as part of a typed token, and what is stripped from its ends.
TOKEN_PUNCTUATION = "`,.;'[]~{}:\"<>@/_-\\#?&=%+"
TOKEN_CLASS = r"\p{L}\p{Nd}`,.;'\[\]~{}:\"<>@/_\-\\#?&=%+"
LAYOUT_TAIL, LAYOUT_HEAD = ",.;:!?\"'»)]}", "\"'[{<"
TYPO_TAIL, TYPO_HEAD = ",.;:!?\"'»)]}>…", "\"'([{<«"
CONTEXT_TAIL = ",.;:!?"
QUOTES = "\"'«»„“()[]{}<>"


def letter_runs(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+)"), 1)


def boundary_tokens(c: Column) -> Column:
    """Tokens with the one separator after each; an empty token stands between two separators."""
    return F.regexp_extract_all(c, F.lit(rf"([{TOKEN_CLASS}]*[^{TOKEN_CLASS}]|[{TOKEN_CLASS}]+$)"), 1)


def white_space_tokens(c: Column) -> Column:
    return F.array_remove(F.split(F.trim(c), r"\s+"), "")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def training_tokens(c: Column) -> Column:
    """Letters of either script, joined by punctuation that may be letters of the other layout."""
    return F.regexp_extract_all(c, F.lit(r"([A-Za-zА-Яа-яЁё]+(?:[,.;'\[\]][A-Za-zА-Яа-яЁё]+)*)"), 1)


def guarded_words(c: Column) -> Column:
    """Words of 4 to 32 letters that touch no letter, apostrophe or ``@/._-``."""
    return F.regexp_extract_all(c, F.lit(r"(?<![\p{L}'’@/._\-])(\p{L}{4,32})(?![\p{L}'’@/._\-])"), 1)


def plain(c: Column) -> Column:
    return F.translate(c, "ё", "е")


def normal(c: Column) -> Column:
    return plain(F.lower(c))


def context_normal(c: Column) -> Column:
    return normal(F.btrim(F.trim(c), F.lit(QUOTES)))


def sentence_normal(c: Column) -> Column:
    """Lower case with white space collapsed: what sentences are hashed by."""
    return F.regexp_replace(F.btrim(F.lower(c), F.lit(" \t\n\r")), r"\s+", " ")


def is_capitalized(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}[^\p{Lu}]+$")


def recapitalized(fixed: Column) -> Column:
    return F.concat(F.upper(F.substring(fixed, 1, 1)), fixed.substr(F.lit(2), F.length(fixed)))


def without_tail(c: Column, chars: str = LAYOUT_TAIL) -> Column:
    return F.rtrim(c, F.lit(chars))


def without_head(c: Column, chars: str = LAYOUT_HEAD) -> Column:
    return F.ltrim(c, F.lit(chars))


def stripped_markup(c: Column) -> Column:
    """Code fences, addresses and tags become spaces, white space is collapsed."""
    t = F.regexp_replace(c, r"(?s)```.*?```", " ")
    t = F.regexp_replace(t, r"https?://\S+|www\.\S+|<[^>]*>", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def octets_within(c: Column, low: int = 1, high: int = 20_000) -> Column:
    return F.octet_length(c).between(low, high)


def last_dot_ending(c: Column) -> Column:
    return F.lower(F.substring_index(c, ".", -1))


def shape_reason(token: Column) -> Column:
    """The first rule on shape alone that keeps a token from conversion; null where none applies."""
    converted = convert(token)
    ending = last_dot_ending(token)
    letters = F.regexp_replace(token, r"[^\p{L}]", "")
    all_caps = ~letters.rlike(r"[^\p{Lu}]")
    return (
        F.when((F.length(token) < 1) | (F.length(token) > 64), "length")
        .when(token.rlike(r"[\p{Nd}\s@/\\_\-+=#]") | token.contains("://") | token.contains(".."), "structured-token")
        .when(token.rlike(r"^.+\.[^.]+$") & (ending.isin(*DOMAIN_ENDINGS) | convert(ending).isin(*DOMAIN_ENDINGS)), "domain-or-dot")
        .when(has_latin(token) == has_cyrillic(token), "mixed-or-unsupported-script")
        .when(has_latin(converted) == has_cyrillic(converted), "mixed-target")
        .when(token.rlike(r"^.[^\p{Lu}]*\p{Lu}") & ~all_caps, "identifier")
        .when(F.length(token).between(2, 4) & all_caps, "abbreviation")
        .when(~token.rlike(r"^[\p{L}`\[\];',.~{}:\"<>]*$"), "symbols")
        .when(F.length(F.regexp_replace(token, "[^.]", "")) > 1, "domain-or-dot")
    )


def kwic(text: Column, start: Column, length: Column, around: int = 120) -> Column:
    """The word at ``start`` (from 1) in brackets with up to ``around`` characters on either side, white space collapsed."""
    lo = F.greatest(F.lit(1), start - around)
    end = start + length
    hi = F.least(F.length(text) + 1, end + around)
    t = F.concat(
        F.when(lo > 1, "…").otherwise(""), text.substr(lo, start - lo), F.lit("[["), text.substr(start, length), F.lit("]]"), text.substr(end, hi - end), F.when(hi <= F.length(text), "…").otherwise("")
    )
    return F.regexp_replace(t, r"\s+", " ")
