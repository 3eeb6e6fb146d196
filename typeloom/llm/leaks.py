"""Evaluation texts leaking into training text (problem 8).

Two kinds of passages of the test items are searched for: every ``size`` words of an
item (or all of a shorter one), and every item as a whole, in windows of its own length.
Passages and windows get SimHash fingerprints of their word shingles. The fingerprints
of the passages are kept in one index per block of bits; fingerprints within the radius
of ``len(BLOCKS) * (NEAR + 1) - 1`` bits differ in at most ``NEAR`` bits of some block, and
all keys that near are probed, so none within the radius is missed. Candidates are
verified by the exact weighted (multiset) similarity of their shingles, and by words.

Most windows cannot be similar to any passage: a similarity of ``least`` needs
``2 least / (1 + least)`` of a window's shingles to be shingles of passages. Whole documents and
single windows with fewer are passed over before anything is fingerprinted. Where all
shingles are needed (up to twelve words at 0.8) fingerprints must be equal, and only
equal ones are looked up. At 0.8, one changed word inside an item loses five shingles, which needs 49
words or more to be near; a changed word at either end needs 13.

The items are a stated query set: they are read one after the other and searched for in
blocks of at most ``block`` passages (64 MB), so what the driver holds and sends to every
task is bounded however many items there are. Documents are read in place, without a
shuffle.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.words import word_hashes

SHINGLE = 5
#: Bits of the blocks of a 64-bit fingerprint, and bits in which keys of a block may differ.
BLOCKS = (16, 16, 16, 16)
NEAR = 3
RADIUS = len(BLOCKS) * (NEAR + 1) - 1
#: Size of the table that tells which shingles passages have, and shingles handled at a time.
_TABLE, _STEP = 1 << 24, 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(v: np.ndarray, k: int) -> np.ndarray:
    """Hashes of ``k`` consecutive word hashes, one per start."""
    n = len(v) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    u = v.view(np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = _mixed(out ^ u[j : j + n]) if j else _mixed(u[:n])
    return out


def needed(count: int, least: float) -> int:
    """How many of ``count`` shingles two windows must share for a similarity of ``least``."""
    return int(np.ceil(2 * least / (1 + least) * count - 1e-9))


def fingerprints(s: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """SimHashes of the windows of ``count`` shingles of ``s`` from each start on: one bit tells whether more of the shingles have it set than not."""
    out = np.empty(len(starts), np.uint64)
    step = max(1, _STEP // count)
    for at in range(0, len(starts), step):
        part = starts[at : at + step]
        if count <= _STEP:
            bits = np.unpackbits(s[part[:, None] + np.arange(count)].view(np.uint8).reshape(len(part), count, 8), axis=2)
            sums = bits.sum(axis=1, dtype=np.int32)
        else:
            sums = sum(np.unpackbits(s[part[0] + j : part[0] + min(count, j + _STEP)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) for j in range(0, count, _STEP))[None]
        out[at : at + step] = np.packbits(2 * sums > count, axis=1).view(np.uint64).ravel()
    return out


@cache
def _masks(bits: int, most: int) -> np.ndarray:
    """All numbers of ``bits`` bits with at most ``most`` of them set."""
    return np.array([sum(1 << b for b in c) for m in range(most + 1) for c in combinations(range(bits), m)], np.int64)


class Passages:
    """Passages of one length with their fingerprints, indexed by each block of bits."""

    def __init__(self, words: np.ndarray, items: np.ndarray, whole: np.ndarray, least: float) -> None:
        self.words, self.items, self.whole = words, items, whole
        n = words.shape[1]
        self.k = min(SHINGLE, n)
        self.count = n - self.k + 1
        self.need = needed(self.count, least)
        self.radius = 0 if self.need == self.count else RADIUS
        flat = np.concatenate([shingles(row, self.k) for row in words])
        self.shingles = np.unique(flat)
        self.prints = fingerprints(flat, np.arange(len(words)) * self.count, self.count)
        self.index = []
        shift = 0
        for bits in BLOCKS:
            key = self._key(self.prints, shift, bits)
            order = np.argsort(key, kind="stable")
            self.index.append((shift, bits, key[order], order))
            shift += bits

    @staticmethod
    def _key(prints: np.ndarray, shift: int, bits: int) -> np.ndarray:
        return ((prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)

    def near(self, prints: np.ndarray, radius: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All (window, passage) whose fingerprints differ in at most ``radius`` bits, each once."""
        radius = self.radius if radius is None else radius
        found = [np.zeros(0, np.int64)]
        for shift, bits, keys, order in self.index if radius else self.index[:1]:
            most = radius // len(BLOCKS)
            masks, own = _masks(bits, most), np.unique(keys)
            present = np.zeros(1 << bits, bool)
            present[own] = True
            few = len(own) < len(masks)  # then all keys there are, else all keys there could be
            step = max(1, _STEP // min(len(own), len(masks)))
            for at in range(0, len(prints), step):
                key = self._key(prints[at : at + step], shift, bits)[:, None] ^ (own if few else masks)
                w, j = np.nonzero(np.bitwise_count(key) <= most if few else present[key])
                key = own[j] if few else key[w, j]
                lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                n = hi - lo
                rep = np.repeat(w + at, n)
                p = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                close = np.bitwise_count(prints[rep] ^ self.prints[p]) <= radius
                found.append(rep[close] * len(self.prints) + p[close])
        both = np.unique(np.concatenate(found))
        return both // len(self.prints), both % len(self.prints)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted similarity of two windows: shared over all shingles, each as often as it occurs."""
    k = min(SHINGLE, len(a), len(b))
    x, y = Counter(shingles(a, k).tolist()), Counter(shingles(b, k).tolist())
    union = (x | y).total()
    return (x & y).total() / union if union else 0.0


def passages(items: Iterable[tuple[int, list[int]]], size: int, block: int, least: float) -> Iterator[dict[int, Passages]]:
    """The distinct passages of the items by length, at most ``block`` at a time."""
    rows: dict[int, dict[tuple[int, tuple[int, ...]], bool]] = {}
    held = 0

    def built() -> dict[int, Passages]:
        return {n: Passages(np.array([w for _, w in r], np.int64), np.array([i for i, _ in r], np.int64), np.array(list(r.values())), least) for n, r in rows.items()}

    for i, ws in items:
        n = min(size, len(ws))
        if not n:
            continue
        each = [(n, at, n == len(ws)) for at in range(len(ws) - n + 1)]
        if len(ws) > n:
            each.append((len(ws), 0, True))
        for m, at, whole in each:
            mine = rows.setdefault(m, {})
            key = (i, tuple(ws[at : at + m]))
            if key in mine:
                mine[key] |= whole
                continue
            mine[key] = whole
            held += 1
            if held == block:
                yield built()
                rows, held = {}, 0
    if held:
        yield built()


class Search:
    """Looks for the passages of a block in batches of documents."""

    def __init__(self, index: dict[int, Passages], least: float) -> None:
        self.least = least
        self.groups = []
        for k in sorted({p.k for p in index.values()}):
            mine = {n: p for n, p in index.items() if p.k == k}
            table = np.zeros(_TABLE, bool)
            for p in mine.values():
                table[p.shingles & np.uint64(_TABLE - 1)] = True
            self.groups.append((k, mine, table, min(p.need for p in mine.values())))

    def run(self, v: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Document rows, items, whether all words agree, and similarities of whole items (nan for other passages)."""
        for k, mine, table, fewest in self.groups:
            s = shingles(v, k)
            if not len(s):
                continue
            total = np.concatenate(([0], np.cumsum(table[s & np.uint64(_TABLE - 1)])))
            at = np.minimum(off, len(s))
            rows = np.flatnonzero(total[at[1:]] - total[at[:-1]] >= fewest)
            if not len(rows):
                continue
            # only the documents that have shingles enough
            n_words = (off[1:] - off[:-1])[rows]
            o = np.concatenate(([0], np.cumsum(n_words)))
            u = v[np.repeat(off[rows] - o[:-1], n_words) + np.arange(o[-1])]
            s = shingles(u, k)
            total = np.concatenate(([0], np.cumsum(table[s & np.uint64(_TABLE - 1)])))
            for n, p in mine.items():
                if len(u) < n:
                    continue
                start = np.flatnonzero(total[p.count :] - total[: len(total) - p.count] >= p.need)
                row = np.searchsorted(o[1:], start, "right")
                inside = start + n <= o[1:][row]
                start, row = start[inside], row[inside]
                if p.count == 1 and len(start):  # the same few words again and again
                    _, first = np.unique(np.stack((row.astype(np.uint64), s[start])), axis=1, return_index=True)
                    start, row = start[first], row[first]
                w, q = p.near(fingerprints(s, start, p.count))
                if not len(w):
                    continue
                start, row, whole = start[w], row[w], p.whole[q]
                same = np.empty(len(w), bool)
                step = max(1, _STEP // n)
                for j in range(0, len(w), step):
                    same[j : j + step] = (u[start[j : j + step, None] + np.arange(n)] == p.words[q[j : j + step]]).all(axis=1)
                sim = np.where(same & whole, 1.0, np.nan)
                for j in np.flatnonzero(whole & ~same).tolist():
                    x = similarity(u[start[j] : start[j] + n], p.words[q[j]])
                    sim[j] = x if x >= self.least else np.nan
                keep = same | ~np.isnan(sim)
                yield rows[row[keep]], p.items[q[keep]], same[keep], sim[keep]


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("exact", pa.bool_()), ("similarity", pa.float64())])
_SCHEMA = "doc_id bigint, item_id bigint, exact boolean, similarity double"


def leaked(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 12, least: float = 0.8, block: int = 400_000
) -> DataFrame:
    """``doc_id, item_id, exact, similarity``: every document and item of which a passage is found in it.

    ``exact`` tells that ``size`` consecutive words of the item, or all words of a shorter
    one, stand in the document. ``similarity`` is the best shingle similarity of the whole
    item and a window of its length, null where none reaches ``least``. Null or wordless
    texts hold and leak nothing; whole texts are searched; an item that occurs in several
    places of a document comes out once.
    """
    spark = docs.sparkSession
    read = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), word_hashes(F.col(item_text)).alias("ws"))
    hashed = docs.where(F.col(doc_text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), word_hashes(F.col(doc_text)).alias("ws"))
    out = None
    for index in passages(((r["i"], r["ws"]) for r in read.toLocalIterator()), size, block, least):
        shared = spark.sparkContext.broadcast(pickle.dumps(index))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            search = Search(pickle.loads(shared.value), least)
            for b in batches:
                ws = b.column("ws")
                off = ws.offsets.to_numpy().astype(np.int64)
                v = np.ascontiguousarray(ws.values.to_numpy()[off[0] : off[-1]])
                for row, item, exact, sim in search.run(v, off - off[0]):
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(item), pa.array(exact), pa.array(sim, from_pandas=True)], schema=_OUT)

        part = hashed.mapInArrow(run, _SCHEMA)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], _SCHEMA)
    return out.groupBy("doc_id", "item_id").agg(F.max("exact").alias("exact"), F.max("similarity").alias("similarity"))
