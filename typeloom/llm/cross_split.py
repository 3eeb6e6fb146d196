"""Same or nearly the same records across splits (problem 2).

A record is normalised to its distinct words, ordered from rare to frequent, and taken
apart into pieces that depend on nothing but their content; digests of the pieces are
joined across splits, and pairs that share one are verified exactly.

:func:`overlap_fractions` cuts content-defined chunks: after every rare word, and among
frequent ones where the rolling hash of the last two says so. Shared chunks lose pairs
at a similarity of 0.7, where a changed word breaks every chunk around it, and chunks
of a frequent word alone are shared by so many records that pairs grow as the square
of the data. :func:`overlapping` therefore joins pieces that can miss no pair:

* Two records with similarity ``t`` share all but ``n - ceil(t n)`` of the ``n`` words of
  either, so their first ``k`` shared words lie among the first ``n - ceil(t n) + k`` words of both.
* If the rarest word they share is in at most ``rare`` records, it is a piece by itself:
  such pieces join a record with a bounded number of others, however much data there is.
* If it is in more, but in at most ``often``, it is a piece together with the next shared word:
  every two words there are, the first of them no more frequent than that.
* If all they share is more frequent, three of them are a piece.
* Records of more than ``LONG`` words would have too many twos and threes; among them, single
  words are pieces of their own kind. Records of one or two words are one piece.

The word order comes from counts over all records in a table of ``2**bits`` hash
buckets, at most 2**22 numbers (16 MB) however much data there is, so it can be sent
to every task. A wrong order of two words of one bucket costs speed, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.llm.words import words
from typeloom.tables import written

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


#: So many word sets are remembered by a task to leave out copies before the shuffle.
_SEEN = 200_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    return x ^ (x >> np.uint64(29))


def word_sets(df: DataFrame, id_col: str, split_col: str, text_col: str) -> DataFrame:
    """``id, train, hs, set_h``: sorted distinct word hashes of each record and a digest of them.

    Records with a null id, split or text, and texts without words, are left out: they
    overlap with nothing.
    """
    w = words(F.col(text_col))
    return (
        df.where(F.col(text_col).isNotNull() & F.col(split_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), (F.col(split_col) == "train").alias("train"), F.array_sort(F.array_distinct(F.transform(w, lambda x: F.xxhash64(x)))).alias("hs"))
        .where(F.size("hs") > 0)
        .withColumn("set_h", F.xxhash64("hs"))
    )


def bucket_counts(sets: DataFrame, bits: int) -> np.ndarray:
    """In how many records a word of each hash bucket occurs; ``2**bits`` numbers, bits at most 22."""
    if bits > 22:
        raise ValueError("bits: at most 22")
    counted = sets.select(F.explode("hs").alias("h")).groupBy(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)).alias("b")).agg(F.count("*").alias("n")).toArrow()
    out = np.zeros(1 << bits, np.int32)
    out[counted.column("b").to_numpy()] = np.minimum(counted.column("n").to_numpy(), 2**31 - 1)
    return out


def cut(v: np.ndarray, offsets: np.ndarray, counts: np.ndarray, limit: int) -> tuple[np.ndarray, ...]:
    """Chunks of records given as concatenated word hashes ``v``: record, start position, length in words, digest and smallest count of each."""
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    u = v.view(np.uint64)
    c = counts[(u & np.uint64(len(counts) - 1)).astype(np.int64)]
    order = np.lexsort((v, c, row))
    u, c = u[order], c[order]
    pos = np.arange(len(u)) - np.repeat(offsets[:-1], n)
    rolled = _mixed(u)
    rolled[1:] ^= _mixed(u[:-1] * _M2)
    last = np.zeros(len(u), bool)
    last[offsets[1:][n > 0] - 1] = True
    ends = last | (c <= limit) | ((rolled & np.uint64(1)) == 0)
    starts = np.flatnonzero(np.concatenate(([True], ends[:-1]))) if len(u) else np.zeros(0, np.int64)
    if not len(starts):
        return row[:0], pos[:0], n[:0], v[:0], c[:0]
    length = np.diff(np.append(starts, len(u)))
    digest = _mixed(np.add.reduceat(_mixed(u), starts) ^ (length.astype(np.uint64) * _M2))
    return row[starts], pos[starts], length, digest.view(np.int64), np.minimum.reduceat(c, starts)


#: Distinct words from which on records are long.
LONG = 40


def pieces(v: np.ndarray, offsets: np.ndarray, counts: np.ndarray, rare: int, often: int, tenths: int) -> tuple[np.ndarray, np.ndarray]:
    """Record and digest of every piece of records given as concatenated distinct word hashes ``v``."""
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    u = v.view(np.uint64)
    c = counts[(u & np.uint64(len(counts) - 1)).astype(np.int64)]
    order = np.lexsort((v, c, row))
    u, c = _mixed(u[order]), c[order]
    pos = np.arange(len(u)) - np.repeat(offsets[:-1], n)
    spare = n - (tenths * n + 9) // 10
    first = pos <= spare[row]
    one = first & (c <= rare) & (c > 1)  # a word of one record only is shared with none
    rows, digests = [row[one]], [u[one]]
    long = first & (c > rare) & (n[row] > LONG * tenths // 10)
    rows.append(row[long])
    digests.append(_mixed(u[long] ^ _M1))
    tiny = np.flatnonzero((n > 0) & (n <= 2))
    if len(tiny):
        rows.append(tiny)
        digests.append(_mixed(np.add.reduceat(u, offsets[:-1][n > 0])[(n[n > 0] <= 2)] ^ _M2))

    def several(many: int, begin: np.ndarray, leading: np.ndarray, mark: np.uint64) -> None:
        """Every ``many`` words from ``begin`` on of those among which the first so many shared ones lie, led by one of the first ``leading``."""
        size = np.minimum(spare + many, n) - begin
        able = (n >= 3) & (n <= LONG) & (begin <= spare) & (size >= many) & (leading > 0)
        kind = size * (LONG + 1) + np.minimum(leading, size)
        for k in np.unique(kind[able]).tolist():
            r = np.flatnonzero(able & (kind == k))
            words = u[(offsets[r] + begin[r])[:, None] + np.arange(k // (LONG + 1))]
            picks = np.array([x for x in combinations(range(k // (LONG + 1)), many) if x[0] < k % (LONG + 1)]).T
            made = words[:, picks[0]]
            for p in picks[1:]:
                made = _mixed(made * _M2 ^ words[:, p])
            rows.append(np.repeat(r, picks.shape[1]))
            digests.append(_mixed(made ^ mark).ravel())

    at_most = lambda limit: np.bincount(row[c <= limit], minlength=len(n))
    few, some = at_most(rare), at_most(max(rare, often))
    several(2, few, some - few, np.uint64(2))
    several(3, some, n - some, np.uint64(3))
    return np.concatenate(rows), np.concatenate(digests).view(np.int64)


_KEYS = pa.schema([("digest", pa.int64()), ("set_h", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()), ("train", pa.bool_())])


def piece_keys(sets: DataFrame, counts: np.ndarray, rare: int, often: int, tenths: int) -> DataFrame:
    """The digests by which each distinct word set is joined, copies within a task mostly left out."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, bool]] = set()
        for b in batches:
            new = []
            for i, k in enumerate(zip(b.column("set_h").to_pylist(), b.column("train").to_pylist(), strict=True)):
                if k not in seen:
                    seen.add(k)
                    new.append(i)
            if not new:
                continue
            if len(seen) > _SEEN:  # this only spares work: a set that comes again later is made distinct after the join
                seen.clear()
            b = b.take(pa.array(new))
            hs = b.column("hs")
            off = hs.offsets.to_numpy().astype(np.int64)
            v = hs.values.to_numpy()[off[0] : off[-1]]
            off = off - off[0]
            sig = np.bitwise_or.reduceat(np.uint64(1) << (v.view(np.uint64) >> np.uint64(58)), off[:-1]).view(np.int64)
            row, digest = pieces(v, off, shared.value, rare, often, tenths)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(digest), b.column("set_h").take(take), pa.array(sig[row]), pa.array(np.diff(off)[row].astype(np.int32)), b.column("train").take(take)], schema=_KEYS)

    return sets.mapInArrow(keys, "digest long, set_h long, sig long, n int, train boolean")


def overlapping(
    df: DataFrame, id_col: str = "sent_id", split_col: str = "split", text_col: str = "sentence", tenths: int = 7, rare: int = 50, often: int | None = None, bits: int | None = None
) -> DataFrame:
    """``id_train, id_other, shared, n_train, n_other``: every pair of a train record and one of another split whose distinct words agree to ``tenths``/10.

    Null or wordless texts and null splits pair with nothing; an empty table gives an
    empty result; repeated rows give a pair each. Copies of one text are joined as one
    word set and expanded at the end, because the pairs of rows are the result. ``rare`` and ``often``
    (by default the square root of the number of records) tell which pieces there are, not which pairs.
    """
    sets = written(word_sets(df, id_col, split_col, text_col), "word-sets")
    total = sets.count()
    counts = bucket_counts(sets, bits or min(22, max(12, total.bit_length() - 3)))
    keys = piece_keys(sets.select("hs", "set_h", "train"), counts, rare, int(total**0.5) if often is None else often, tenths)
    a = keys.where("train").select("digest", F.col("set_h").alias("set_a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    b = keys.where("not train").select("digest", F.col("set_h").alias("set_b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
    # |A xor B| <= (1 - 2t/(1+t)) (|A|+|B|), and the signatures differ in no more bits than the sets in words
    near = (
        (F.bit_count(F.col("sig_a").bitwiseXOR(F.col("sig_b"))) * (10 + tenths) <= (10 - tenths) * (F.col("n_a") + F.col("n_b")))
        & (F.col("n_a") * 10 >= tenths * F.col("n_b"))
        & (F.col("n_b") * 10 >= tenths * F.col("n_a"))
    )
    pairs = a.join(b, "digest").where(near).select("set_a", "set_b").distinct()
    rows = lambda which, x: sets.where(which).select(F.col("set_h").alias(f"set_{x}"), F.col("id").alias(f"id_{x}"), F.col("hs").alias(f"hs_{x}"))
    out = pairs.join(rows("train", "a"), "set_a").join(rows("not train", "b"), "set_b")
    return (
        out.withColumn("shared", F.size(F.array_intersect("hs_a", "hs_b")))
        .withColumns({"n_train": F.size("hs_a"), "n_other": F.size("hs_b")})
        .where(F.col("shared") * (10 + tenths) >= tenths * (F.col("n_train") + F.col("n_other")))
        .select(F.col("id_a").alias("id_train"), F.col("id_b").alias("id_other"), "shared", "n_train", "n_other")
    )


def ordered(one: str, two: str) -> list[Column]:
    return [F.least(one, two).alias("sent_id_1"), F.greatest(one, two).alias("sent_id_2")]


_CHUNKS = pa.schema([("set_h", pa.int64()), ("train", pa.bool_()), ("digest", pa.int64()), ("length", pa.int32()), ("n", pa.int32())])


def overlap_fractions(df: DataFrame, id_col: str = "sent_id", split_col: str = "split", text_col: str = "sentence", frequent: float = 0.001, bits: int | None = None) -> DataFrame:
    """``id, n_words, shared_words, overlap``: for every record outside train, the share of its distinct words that lies in chunks also found in train.

    Left out are the same records as in :func:`overlapping`; a record that shares no
    chunk has overlap 0.
    """
    sets = written(word_sets(df, id_col, split_col, text_col), "word-sets")
    total = sets.count()
    counts = bucket_counts(sets, bits or min(22, max(12, total.bit_length() - 3)))
    shared, limit = sets.sparkSession.sparkContext.broadcast(counts), max(50, int(frequent * total))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs = b.column("hs")
            off = hs.offsets.to_numpy().astype(np.int64)
            v = hs.values.to_numpy()[off[0] : off[-1]]
            off = off - off[0]
            row, _, length, digest, least = cut(v, off, shared.value, limit)
            use = (least > 1) | ~b.column("train").to_numpy(zero_copy_only=False)[row]
            row = row[use]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b.column("set_h").take(take), b.column("train").take(take), pa.array(digest[use]), pa.array(length[use].astype(np.int32)), pa.array(np.diff(off)[row].astype(np.int32))], schema=_CHUNKS
            )

    keys = sets.select("set_h", "train", "hs").mapInArrow(chunks, "set_h long, train boolean, digest long, length int, n int")
    known = keys.where("train").select("digest").distinct().withColumn("known", F.lit(True))
    per_set = (
        keys.where("not train").select("set_h", "digest", "length", "n").distinct().join(known, "digest", "left").groupBy("set_h", "n").agg(F.sum(F.when(F.col("known"), F.col("length")).otherwise(0)).alias("shared_words"))
    )
    rows = sets.where("not train").select("id", "set_h")
    return rows.join(per_set, "set_h").select("id", F.col("n").alias("n_words"), "shared_words", (F.col("shared_words") / F.col("n")).alias("overlap"))
