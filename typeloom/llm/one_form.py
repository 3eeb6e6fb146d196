"""Visually identical text with different characters (problem 3).

A compiled transducer walks over grapheme clusters once. In each it takes the longest
sources of a precomputed mapping: joined and wide forms, base letters with separate
accents, spaces, invisible characters. Letters that only look like those of the rest of their run
of letters are entries of the same mapping, one for each script they can be read in: the
transducer keeps a run open, with the scripts seen in it, and writes it out in the script that fits all of it when it
ends. The mapping is built from the Unicode database when first used and
checked for conflicts: no source may have two results, no result may contain a source,
and look-alikes must lead back to each other.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Letters of one script and the letters of another that look like them.
LATIN_CYRILLIC = dict(zip("ABEKMHOPCTYXSIJaeopcyxsijgh", "АВЕКМНОРСТУХЅІЈаеорсухѕіјԍһ", strict=True))
LATIN_GREEK = dict(zip("ABEZHIKMNOPTYXvouapyi", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνουαργι", strict=True))
CYRILLIC_GREEK = dict(zip("АВЕКМНОРТХорапк", "ΑΒΕΚΜΗΟΡΤΧοραπκ", strict=True))
#: Characters that are ordinary though compatibility forms would rewrite them.
ORDINARY = "…№"
#: Characters without a width of their own beside the format characters of Unicode.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")


@cache
def script(ch: str) -> str:
    name = unicodedata.name(ch, "")
    return next((s for s in SCRIPTS if name.startswith(s)), "OTHER")


def _wide_or_joined(ch: str) -> bool:
    """Compatibility forms of ordinary letters, digits and punctuation; neither superscripts nor fractions nor signs."""
    tag = unicodedata.decomposition(ch).partition(" ")[0]
    if tag in ("<wide>", "<narrow>"):
        return True
    if tag == "<font>":
        return True
    return tag == "<compat>" and unicodedata.category(ch)[0] == "L" and unicodedata.normalize("NFKC", ch) != ch


@cache
def mapping() -> dict[str, str]:
    """Every source that is rewritten wherever it stands, with its ordinary form: single characters, and letters with separate accents."""
    out: dict[str, str] = {}

    def put(a: str, b: str) -> None:
        if out.setdefault(a, b) != b:
            raise ValueError(f"two results for {a!r}")

    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if ch in ORDINARY or kind in ("Cn", "Co", "Cs"):
            continue
        if kind == "Zs":
            put(ch, " ")
        elif kind == "Cf" and not 0x600 <= cp <= 0x8FF or ch in INVISIBLE or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
            put(ch, "")
        elif _wide_or_joined(ch):
            put(ch, unicodedata.normalize("NFKC", ch))
        elif unicodedata.decomposition(ch) and unicodedata.decomposition(ch)[0] != "<":
            apart, whole = unicodedata.normalize("NFD", ch), unicodedata.normalize("NFC", ch)
            put(*((apart, ch) if whole == ch else (ch, whole)))
    # what a source turns into is final
    for a, b in list(out.items()):
        out[a] = "".join(out.get(c, c) for c in b)
    longest = max(map(len, out))
    for a, b in out.items():
        if any(b[i : i + n] in out for i in range(len(b)) for n in range(1, longest + 1)):
            raise ValueError(f"{a!r} does not end in ordinary characters")
    return out


@cache
def look_alikes() -> dict[tuple[str, str], str]:
    """(letter, script wanted) -> the letter of that script that looks the same."""
    out: dict[tuple[str, str], str] = {}
    for one, two, table in (("LATIN", "CYRILLIC", LATIN_CYRILLIC), ("LATIN", "GREEK", LATIN_GREEK), ("CYRILLIC", "GREEK", CYRILLIC_GREEK)):
        for a, b in table.items():
            out.setdefault((a, two), b)
            out.setdefault((b, one), a)
    for (a, wanted), b in out.items():
        if script(b) != wanted or out.get((b, script(a))) is None or a in mapping() or b in mapping():
            raise ValueError(f"{a!r} and {b!r} are no look-alikes")
    return out


class Transducer:
    """The mapping as a trie of characters; what it makes of a cluster is remembered."""

    def __init__(self, table: dict[str, str]) -> None:
        self.start: dict = {}
        for source, result in table.items():
            node = self.start
            for ch in source:
                node = node.setdefault(ch, {})
            node[""] = result
        self.known: dict[str, tuple[str, bool, int]] = {}

    def cluster(self, text: str) -> tuple[str, bool, int]:
        """The form of one cluster, whether it is nothing but letters and marks, and its scripts as bits."""
        found = self.known.get(text)
        if found is None:
            source, out, at = unicodedata.normalize("NFD", text) if len(text) > 1 else text, "", 0
            while at < len(source):
                node, end, result = self.start, at + 1, source[at]
                for i in range(at, len(source)):
                    node = node.get(source[i])
                    if node is None:
                        break
                    if "" in node:
                        end, result = i + 1, node[""]
                out += result
                at = end
            if len(out) > 1:
                out = unicodedata.normalize("NFC", out)  # syllables that are made by rule
            letters = all(unicodedata.category(ch)[0] in "LM" for ch in out)
            found = out, letters, sum({1 << SCRIPTS.index(k) for k in map(script, out) if k in SCRIPTS})
            if len(self.known) > 1 << 16:
                self.known.clear()
            self.known[text] = found
        return found

    def __call__(self, text: str) -> str:
        out: list[str] = []
        run: list[str] = []
        seen = 0
        for c in _CLUSTERS.findall(text):
            form, letters, scripts = self.cluster(c)
            # a form of several kinds of characters goes on one by one
            for part, inside, kinds in ((form, letters, scripts),) if letters or len(form) == 1 else map(self.cluster, form):
                if inside:
                    run.append(part)
                    seen |= kinds
                    continue
                if run:
                    out.append(in_one_script("".join(run), seen))
                    run, seen = [], 0
                out.append(part)
        if run:
            out.append(in_one_script("".join(run), seen))
        done = "".join(out)
        # marks can come to stand behind a letter when what was between them is gone
        return done if unicodedata.is_normalized("NFC", done) else self(unicodedata.normalize("NFC", done))


_CLUSTERS = regex.compile(r"\X")
FLAG = "__typeloom_suspicious"


def in_one_script(run: str, scripts: int) -> str:
    """A run of letters with its look-alikes read in one script; ``scripts`` are the bits of those in it.

    That script is the one that all letters can take, then the one that fewest letters have
    to change for, then the one of letters without look-alikes. Where letters that
    cannot change leave a choice open, readings are repeated until they stay.
    """
    if not scripts & (scripts - 1):
        return run
    alike = look_alikes()
    seen: list[str] = []
    while run not in seen:
        seen.append(run)
        kinds = [script(ch) for ch in run]
        cost = {s: (sum(k not in (s, "OTHER") and (ch, s) not in alike for ch, k in zip(run, kinds, strict=True)), sum(k not in (s, "OTHER") for k in kinds)) for s in SCRIPTS if s in kinds}
        if len(cost) < 2:
            return run
        best = min(cost, key=lambda s: (*cost[s], s != "CYRILLIC"))
        run = "".join(alike.get((ch, best), ch) if k != best else ch for ch, k in zip(run, kinds, strict=True))
    return min(seen[seen.index(run) :])


@cache
def transducer() -> Transducer:
    return Transducer(mapping())


def one_form(text: str) -> str:
    """``text`` in its one consistent form; applying it again changes nothing."""
    return transducer()(text)


#: Text that the transducer leaves as it is can be told without it: ordinary characters only and no run of letters of two scripts.
_PLAIN = r"^[\x00-\x7fА-Яа-яЁё…№—–«»“”„’‘]*+$"
_MIXED = r"[A-Za-z][А-Яа-яЁё]|[А-Яа-яЁё][A-Za-z]"


def suspicious(c: Column) -> Column:
    return ~c.rlike(_PLAIN) | c.rlike(_MIXED)


def canonical(df: DataFrame, column: str, to: str = "canonical") -> DataFrame:
    """Adds ``to``, the one form of ``column``; rows of ordinary text never leave the JVM's columns but for the batch they travel in.

    Null stays null, empty stays empty, texts of any length are rewritten whole; a column
    named ``to`` is replaced, other columns pass through.
    """
    rest = df.drop(to)
    marked = rest.withColumn(FLAG, F.coalesce(suspicious(F.col(column)), F.lit(False)))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, flag = b.column(column).to_pylist(), b.column(FLAG).to_pylist()
            new = pa.array([one_form(t) if s else t for t, s in zip(text, flag, strict=True)], pa.string())
            keep = [n for n in b.schema.names if n != FLAG]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), new], names=[*keep, to])

    return marked.mapInArrow(rewrite, StructType([*rest.schema.fields, StructField(to, StringType())]))


def disguised(df: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` holds a character that passes for another; null and empty texts hold none."""
    return canonical(df.where(suspicious(F.col(column))), column, "__typeloom_one_form").where(F.col("__typeloom_one_form") != F.col(column)).drop("__typeloom_one_form")
