"""Garbled text from a wrong character encoding (problem 6).

Candidate decodings undo chains of wrong decodings on all or part of a text. Every
candidate is compressed with a zstandard dictionary per language; the chain whose
description (compressed text, oddities of case and script, chain itself) is shortest
wins, and a text for which that is no chain at all is left unchanged.

Damage that cannot be undone is found the same way: a chain that ends in sequences of
lost bytes, or replacement characters in the text itself, is described by the text
without them and a price for each loss. Where that is shortest the text is damaged, but
left as it is.

Letter pairs and words are counted over all ordinary texts, whatever their number and length.
A dictionary holds the words that save most bytes in all of them, as many as it has room for.
"""

from __future__ import annotations

import math
import pickle
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeloom.tables import written

# Fixed values: (encoding the text was decoded with, encoding it was written in).
SINGLE = ("cp1251", "cp1252", "latin-1", "cp1250", "mac_roman", "mac_cyrillic", "koi8-r", "cp866", "cp437", "iso8859-5")
CYRILLIC = ("cp1251", "koi8-r", "cp866", "mac_cyrillic", "iso8859-5")
LINKS = [(w, "utf-8") for w in SINGLE] + [(w, r) for r in CYRILLIC for w in SINGLE if w != r]
CHAINS = [(link,) for link in LINKS] + [(link, link) for link in LINKS[:8]] + [(("cp1251", "utf-8"), ("cp1252", "utf-8")), (("cp1252", "utf-8"), ("cp1251", "utf-8")), (("cp1252", "utf-8"), ("latin-1", "cp1251")), (("cp1251", "utf-8"), ("latin-1", "cp1251"))]
#: Chains that do not prove themselves: parts of a text are undone by them where letter pairs say so.
OPEN = [c for c in CHAINS if any(right != "utf-8" for _, right in c)]
#: Bytes that a chain costs, per link: a UTF-8 sequence proves itself, another single-byte reading always exists.
COST = {"utf-8": 2.5, "other": 5.0}
ODD_CASE, FOREIGN, ODD_LETTER = 8.0, 5.0, 2.0
#: Bytes for each place where bytes were lost, however many.
LOST = 1.0
#: So many tokens and their costs are remembered by a task.
_KEPT = 1 << 18
#: Characters after which a task passes its words on.
_PASSED_ON = 1 << 25
#: Bytes of a dictionary, and bytes that a match with a word of it costs.
DICTIONARY, MATCH = 48 * 1024, 3

_ORDINARY = r"^[\x09\x0a\x0d\x20-\x7eА-Яа-яЁё—–«»…№]*+$"
_CASE = r"[а-яё][А-ЯЁ]|[А-ЯЁ]{3}|(?<![А-ЯЁа-яёA-Za-z])[А-ЯЁ]{2}(?![А-ЯЁа-яёA-Za-z])"
_ODD_CASE = regex.compile(r"(?<=\p{Ll})\p{Lu}|(?<=\p{Lu}\p{Lu})\p{Ll}")
_GLUED = regex.compile(r"[‚„†‡‰‹‘’“•–—™›](?=[а-яё])")
_FOREIGN = regex.compile(r"[Ѐ-Џѐ-џ҂-ҏґҐ--[Ёё]]", regex.V1)
#: What restored text is made of.
_USUAL = regex.compile(r"[\x00-\x7f\xa0-\xffĀ-žА-Яа-яЁёЀ-џ‐-‧‰‹›€№™₽°′″−×√∞≈≠≤≥←→↑↓©®§¶•…\x80-\x9f─-▟Α-ωƒˆ˜]*")
_ODD_LETTER = regex.compile(r"[^\x00-\x7fА-Яа-яЁё—–«»…№“”’„‘°€£₽§©½é]")
_GONE = regex.compile("\ufffd+")
_SPLIT = regex.compile(r"([ \t\n\r]+)")
_PUNCTUATION = string.punctuation + "–—«»…№"


@cache
def _bytes_of(encoding: str) -> dict[int, int]:
    """Character to byte; bytes without a character stand for themselves, as lenient decoders have it."""
    out = {}
    for b in range(256):
        try:
            out[ord(bytes([b]).decode(encoding))] = b
        except UnicodeDecodeError:
            out.setdefault(b, b)
    return out


@cache
def _text_of(encoding: str) -> list[str]:
    back = {b: chr(c) for c, b in _bytes_of(encoding).items()}
    return [back[b] for b in range(256)]


@cache
def _sequence(encoding: str) -> regex.Pattern:
    """A UTF-8 lead byte and a following one, as ``encoding`` shows them."""
    t = _text_of(encoding)
    return regex.compile("[" + regex.escape("".join(t[0xC2:0xF5]), special_only=False) + "][" + regex.escape("".join(t[0x80:0xC0]), special_only=False) + "]")


@lru_cache(_KEPT)
def undo(text: str, chain: tuple[tuple[str, str], ...], lossy: bool = False) -> str | None:
    """``text`` before the wrong decodings of ``chain``; None where that is impossible, or if ``lossy`` with a replacement character for what is lost."""
    for wrong, right in chain:
        table = _bytes_of(wrong)
        if lossy:
            # a byte that no text begins with stands for characters that the wrong encoding lacks
            raw = bytes([table.get(ord(c), 0xFF) for c in text])
        else:
            try:
                raw = bytes([table[ord(c)] for c in text])
            except KeyError:
                return None
        if right == "utf-8":
            try:
                text = raw.decode("utf-8", "replace" if lossy else "strict")
            except UnicodeDecodeError:
                return None
        else:
            table = _text_of(right)
            text = "".join(table[b] for b in raw)
    return text


def pair_counts(text: str) -> Counter:
    """Pairs of neighbouring characters of a text in lower case, its ends counting as spaces."""
    t = f" {text.lower()} "
    return Counter(zip(t, t[1:]))


def word_counts(tokens: Counter) -> Counter:
    """Words without the punctuation around them, from counts of tokens in lower case."""
    words: Counter = Counter()
    for t, n in tokens.items():
        words[t.strip(_PUNCTUATION)] += n
    del words[""]
    return words


def most_saving(words: Counter) -> list[str]:
    """Words that a dictionary saves bytes with, those first that save most for the room they take (a word takes a space too)."""
    size = {w: len(w.encode()) + 1 for w in words}
    return sorted((w for w in words if MATCH < size[w] <= DICTIONARY), key=lambda w: (-words[w] * (size[w] - MATCH) / size[w], w))


def dictionary(words: Iterable[str]) -> bytes:
    """Those of ``words`` that begin within a dictionary's length and that there is room for, the first at the end, where references to it are shortest."""
    parts, begun, room = [], 0, DICTIONARY
    for w in words:
        part = f" {w}".encode()
        if begun >= DICTIONARY:
            break
        begun += len(part)
        if len(part) <= room:
            parts.append(part)
            room -= len(part)
    return b"".join(reversed(parts))


class Language:
    """Zstandard dictionaries and letter-pair costs per language, from ``words``, most saving first, and ``counts`` of letter pairs (those of all ``samples`` if none are given)."""

    def __init__(self, samples: dict[str, list[str]], counts: dict[str, Counter] | None = None, words: dict[str, list[str]] | None = None) -> None:
        words = words or {k: most_saving(word_counts(Counter(" ".join(v).lower().split()))) for k, v in samples.items()}
        self.dictionaries, self.pairs = {name: dictionary(w) for name, w in words.items() if w}, {}
        for name, two in (counts or {k: sum((pair_counts(t) for t in v), Counter()) for k, v in samples.items()}).items():
            one = Counter()
            for (a, _), n in two.items():
                one[a] += n
            v = len(one) + 50
            self.pairs[name] = ({k: math.log2((one[k[0]] + 0.1 * v) / (n + 0.1)) for k, n in two.items()}, {c: math.log2((n + 0.1 * v) / 0.1) for c, n in one.items()})
        self._ready, self._costs, self._gains = None, {}, {}

    def __getstate__(self) -> dict:
        return {"dictionaries": self.dictionaries, "pairs": self.pairs, "_ready": None, "_costs": {}, "_gains": {}}

    @staticmethod
    def oddities(text: str) -> float:
        """Bytes for letters of odd case (text with caps lock on is read with its case turned), symbols stuck to a word and odd letters."""
        case = len(_ODD_CASE.findall(text))
        if case:
            case = min(case, len(_ODD_CASE.findall(text.swapcase())))
        return ODD_CASE * (case + len(_GLUED.findall(text))) + FOREIGN * len(_FOREIGN.findall(text)) + ODD_LETTER * len(_ODD_LETTER.findall(text))

    def pair_cost(self, token: str) -> float:
        """Bits of a token by its letter pairs, with its oddities of case and script."""
        cost = self._costs.get(token)
        if cost is None:
            t = f" {token.lower()} "
            cost = min((sum(two.get(k) or one.get(k[0], 14.0) for k in zip(t, t[1:])) for two, one in self.pairs.values()), default=0.0)
            cost += 8 * (len(_ODD_CASE.findall(token)) + len(_GLUED.findall(token)) + len(_ODD_LETTER.findall(token)))
            if len(self._costs) >= _KEPT:
                self._costs.clear()
            self._costs[token] = cost
        return cost

    def gains(self, token: str) -> np.ndarray:
        """Bits by letter pairs that each of ``OPEN`` gains by undoing a token; much is lost where that is impossible."""
        gain = self._gains.get(token)
        if gain is None:
            cost = self.pair_cost(token)
            gain = np.array([-50.0 if u is None else 0.0 if u == token else cost - self.pair_cost(u) for u in (undo(token, c) for c in OPEN)])
            if len(self._gains) >= _KEPT // 4:
                self._gains.clear()
            self._gains[token] = gain
        return gain

    def size(self, text: str) -> float:
        """Bytes that describe ``text``."""
        if self._ready is None:
            self._ready = [
                zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
                for d in (zstandard.ZstdCompressionDict(r, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for r in self.dictionaries.values())
            ] or [zstandard.ZstdCompressor(level=6)]
        raw = text.lower().encode("utf-8", "surrogatepass")
        return min(len(c.compress(raw)) for c in self._ready) + self.oddities(text)


def _best_run(tokens: list[str], chain: tuple, own: list[int], gains: list[float]) -> str | None:
    """The text with the run of tokens undone that gains most by letter pairs; None where nothing gains.

    ``own`` holds the places of the tokens that are not plain ASCII, ``gains`` what undoing each gains.
    """
    best, lo, hi, here, start = 0.0, 0, 0, 0.0, 0
    for i, gain in zip(own, gains, strict=True):
        here += gain
        if here > best:
            best, lo, hi = here, start, i + 1
        if here <= 0:
            here, start = 0.0, i + 1
    return None if best <= 0 else "".join(t if t.isascii() else undo(t, chain) or t for t in tokens[lo:hi]).join(("".join(tokens[:lo]), "".join(tokens[hi:])))


def restore(text: str, model: Language) -> tuple[str, str | None, bool]:
    """``text`` as originally written, the chain that was undone, and whether the text is damaged.

    Where no chain describes it better without losing something it is the same text and None.
    """
    tokens = _SPLIT.split(text)
    own = [i for i, t in enumerate(tokens) if not t.isascii()]
    gains = np.array([model.gains(tokens[i]) for i in own]) if own else np.zeros((0, len(OPEN)))
    promising = dict(zip(OPEN, (gains > 0).any(axis=0).tolist(), strict=True))
    best, name, least = text, None, model.size(text)
    whole = with_loss = least
    if "\ufffd" in text:
        kept = text.replace("\ufffd", "")
        with_loss = model.size(kept) + LOST * len(_GONE.findall(text))
    for chain in CHAINS:
        proves = all(right == "utf-8" for _, right in chain)
        if chain[0][1] == "utf-8" and not _sequence(chain[0][0]).search(text):
            continue
        cost = sum(COST.get(right, COST["other"]) for _, right in chain)
        if proves:
            new = "".join([t if t.isascii() else undo(t, chain) or t for t in tokens])
        else:
            new = _best_run(tokens, chain, own, gains[:, OPEN.index(chain)].tolist()) if promising[chain] else None
        if new is not None and new != text and _USUAL.fullmatch(new):
            size = model.size(new) + cost
            if size < least:
                best, name, least = new, "+".join(f"{r} as {w}" for w, r in chain), size
        if proves and len(chain) == 1:
            found = [t if t.isascii() else undo(t, chain) or (undo(t, chain, True) if _sequence(chain[0][0]).search(t) else t) for t in tokens]
            gone = sum(t.count("\ufffd") for t in found)
            kept, places = _GONE.subn("", "".join(found))
            # what is lost must be part of something: as many letters as losses have to come out
            if gone and len(text) - len(kept) > 2 * gone:
                with_loss = min(with_loss, model.size(kept) + cost + LOST * places)
    return best, name, name is not None or with_loss < whole


def unusual(c: Column) -> Column:
    """Whether a text can be damaged at all: a character outside the ordinary ones, or capitals inside or all over a word."""
    return ~c.rlike(_ORDINARY) | c.rlike(_CASE)


def _ordinary(texts: DataFrame, column: str) -> DataFrame:
    """``t, lang`` of the ordinary texts of one script."""
    t = F.col(column)
    cyrillic, latin = t.rlike("[А-Яа-яЁё]"), t.rlike("[A-Za-z]")
    language = F.when(cyrillic & ~latin, "ru").when(latin & ~cyrillic, "en")
    return texts.where(t.rlike(_ORDINARY) & ~t.rlike(_CASE)).select(t.alias("t"), language.alias("lang")).where(F.col("lang").isNotNull())


_COUNTED = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])


def counted(plain: DataFrame) -> DataFrame:
    """``lang, a, b, n`` over all texts of ``t, lang``: how often the characters ``a, b`` are neighbours and, where ``b`` is null, how often the word ``a`` occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[str, Counter] = {}
        tokens: dict[str, Counter] = {}
        read = 0

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rows), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[i : i + (1 << 16)], strict=True), _COUNTED, strict=True)], schema=_COUNTED)

        def of_words() -> Iterator[pa.RecordBatch]:
            for lang, c in tokens.items():
                yield from out([(lang, w, None, n) for w, n in word_counts(c).items() if len(w) < DICTIONARY])
            tokens.clear()

        for b in batches:
            by: dict[str, list[str]] = {}
            for t, lang in zip(b.column("t").to_pylist(), b.column("lang").to_pylist(), strict=True):
                by.setdefault(lang, []).append(t.lower())
                read += len(t)
            for lang, ts in by.items():
                # texts are joined by two characters that no text holds, standing for the space at its end and before the next
                codes = np.frombuffer(("\ue000" + "\ue001\ue000".join(ts) + "\ue001").encode("utf-32-le"), np.uint32)
                letters, at = np.unique(codes, return_inverse=True)
                n = np.bincount(at[:-1] * len(letters) + at[1:], minlength=len(letters) ** 2).reshape(len(letters), -1)
                name = [{0xE000: " ", 0xE001: " "}.get(c, chr(c)) for c in letters.tolist()]
                mine = pairs.setdefault(lang, Counter())
                for i, j in zip(*np.nonzero(n), strict=True):
                    if letters[i] != 0xE001:
                        mine[name[i], name[j]] += int(n[i, j])
                tokens.setdefault(lang, Counter()).update(" ".join(ts).split())
            if read > _PASSED_ON or sum(map(len, tokens.values())) > _KEPT:
                yield from of_words()
                read = 0
        yield from of_words()
        yield from out([(lang, x, y, n) for lang, c in pairs.items() for (x, y), n in c.items()])

    return plain.select("t", "lang").mapInArrow(run, "lang string, a string, b string, n bigint").groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))


def fitted(texts: DataFrame, column: str = "text") -> Language:
    """Letter pairs and dictionaries of all ordinary texts.

    Counts are made once and written. Letter pairs are collected whole: ordinary texts have under two hundred
    different characters, so they are few whatever the data. Of the words, in the order of ``most_saving``,
    those are collected that begin within a dictionary's length.
    """
    counts = written(counted(_ordinary(texts, column)), "letters_words")
    pairs: dict[str, Counter] = {}
    for r in counts.where("b is not null").collect():
        pairs.setdefault(r["lang"], Counter())[r["a"], r["b"]] = r["n"]
    size = F.octet_length("a") + 1
    words = counts.where("b is null").withColumn("_size", size).where(F.col("_size").between(MATCH + 1, DICTIONARY))
    order = ((F.col("n") * (F.col("_size") - MATCH) / F.col("_size")).desc(), F.col("a"))
    first: dict[str, list[str]] = {}
    for lang in sorted(pairs):
        # a dictionary has room for no more words than this, as each takes more than MATCH bytes
        most = words.where(F.col("lang") == lang).orderBy(*order).limit(DICTIONARY // (MATCH + 1))
        before = F.sum("_size").over(Window.partitionBy("lang").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        most = most.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < DICTIONARY)
        first[lang] = [r["a"] for r in most.orderBy("_before").collect()]
    return Language({}, pairs, first)


_OUT = pa.schema([("table_name", pa.string()), ("row_id", pa.int64()), ("restored", pa.string()), ("chain", pa.string())])


def garbled(texts: DataFrame, model: Language) -> DataFrame:
    """``table_name, row_id, restored, chain`` of every damaged row of ``texts(table_name, row_id, text)``.

    ``restored`` is the text as originally written as far as it can be had, ``chain`` null
    where nothing could be undone. Null and empty texts are no cases; an id delivered
    twice comes out once; an empty table gives an empty result.
    """
    shared = texts.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for b in batches:
            rows = []
            for table, i, t in zip(*(b.column(k).to_pylist() for k in ("table_name", "row_id", "text")), strict=True):
                new, name, damaged = restore(t, own)
                if damaged:
                    rows.append((table, i, new, name))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

    picked = texts.where(F.col("text").isNotNull() & unusual(F.col("text"))).select("table_name", F.col("row_id").cast("bigint").alias("row_id"), "text")
    return picked.mapInArrow(run, "table_name string, row_id bigint, restored string, chain string").dropDuplicates(["table_name", "row_id"])
