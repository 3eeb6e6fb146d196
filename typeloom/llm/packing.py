"""Filling fixed-capacity containers with items (problem 7).

Sum-of-squares online packing: an item goes to the fill level at which the sum of
squares of the numbers of partially filled windows per level grows least. Levels are
tracked in an array; the window of a level that takes the item is the fullest with
room for it. Nothing is packed twice. As the items of a part are known to end, no new window is
opened once the open ones have room for all that is still to come (and one of them for the
item). Parts are cut by a hash of the item id, of at most about ``part_items`` items each
however many items there are, so that packing is spread over all tasks and the room lost at
the ends of parts stays a constant share, which shrinks with the size of a part.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.tables import written

#: Folder of public vocabulary files; a parameter of every function that reads them.
TOKENIZERS = os.environ.get("TYPELOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which this public vocabulary's tokenizer cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEVELS = 256
_NEVER = 1 << 60


def token_counts(docs: DataFrame, id_col: str, text_col: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id, tokens``: the length of every text in tokens; texts of any length are taken whole.

    A null text has no tokens; rows with a null id are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(os.path.join(folder, vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [0 if t is None else sum(len(enc.encode_ordinary(part)) for part in _parts(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64())], names=["id", "tokens"])

    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, tokens bigint")


def _parts(text: str, size: int = 1 << 16) -> Iterator[str]:
    """``text`` cut between a single line feed and a letter after it, where no token spans the cut; very long texts are thus tokenized in linear time."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while (cut := text.find("\n", cut) + 1) and cut < len(text) and not (text[cut].isalpha() and not text[cut - 2].isspace()):
            pass
        if not cut or cut >= len(text):
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def sum_of_squares(sizes: np.ndarray, capacity: int, levels: int = LEVELS) -> np.ndarray:
    """The window of each item, numbered from 0; sizes are from 1 to ``capacity``, in the order in which the items arrive.

    The level array holds the number of open windows per fill level (``levels`` of equal
    width, the last one ends at the capacity) and the largest fill among them.
    """
    width = max(1, -(-capacity // levels))
    top = (capacity - 1) // width
    count = np.zeros(top + 1, np.int64)
    fullest = np.full(top + 1, -1, np.int64)
    opened: list[list[tuple[int, int]]] = [[] for _ in range(top + 1)]  # (fill, window) in order, by level
    level = np.arange(top + 1)
    out, made = np.empty(len(sizes), np.int64), 0
    to_come, room = int(sizes.sum()), 0
    for i, s in enumerate(sizes.tolist()):
        ending = room >= to_come
        to_come -= s
        most = capacity - s
        n = min(most // width, top) + 1
        fill = fullest[:n].copy()
        if fill[-1] > most:
            at = bisect_right(opened[n - 1], (most, made)) - 1
            fill[-1] = opened[n - 1][at][0] if at >= 0 else -1
        after = fill + s
        to = np.minimum(after // width, top)
        # growth of the sum of squares when a window leaves its level for another, or is full and leaves for good
        grown = np.where(after == capacity, 0, 2 * count[to] + 1) - (2 * count[:n] - 1)
        grown[(to == level[:n]) & (after < capacity)] = 0
        grown[fill < 0] = _NEVER
        best = n - 1 - int(np.argmin(grown[::-1]))  # of equals the fullest
        new = 0 if s == capacity else 2 * int(count[s // width]) + 1
        if grown[best] < _NEVER and (ending or grown[best] <= new):
            at = bisect_right(opened[best], (int(fill[best]), made)) - 1
            f, window = opened[best].pop(at)
            count[best] -= 1
            fullest[best] = opened[best][-1][0] if opened[best] else -1
        else:
            f, window = 0, made
            made += 1
            room += capacity
        f += s
        room -= s
        out[i] = window
        if f < capacity:
            k = f // width
            insort(opened[k], (f, window))
            count[k] += 1
            fullest[k] = opened[k][-1][0]
    return out


_PACKED = "window_name string, capacity bigint, part bigint, window bigint, id bigint, piece int, first_token bigint, tokens bigint"


def packed(items: DataFrame, capacities: list[tuple[str, int]], part_items: int = 100_000) -> DataFrame:
    """Items ``(id, tokens)`` packed for each capacity: ``window_name, part, window, id, piece, first_token, tokens``.

    An item longer than the capacity is cut into full windows and a rest, numbered as
    pieces; no other item is cut. Items without tokens take no room and come out in no
    window. An id that occurs again is packed again. Null or not positive capacities are
    left out.
    """
    sized = items.where("tokens > 0")
    n = sized.count()
    parts = max(1, -(-n // part_items))

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        name, capacity, part = key[0], int(f["capacity"].iat[0]), int(key[1])
        f = f.sort_values(["h", "id"], kind="stable")
        ids, tokens = f["id"].to_numpy(), f["tokens"].to_numpy()
        full = tokens // capacity
        pieces = full + (tokens % capacity > 0)
        row = np.repeat(np.arange(len(ids)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(capacity, tokens[row] - piece * capacity)
        whole = size == capacity
        window = np.empty(len(row), np.int64)
        window[~whole] = sum_of_squares(size[~whole], capacity)
        base = int(window[~whole].max()) + 1 if (~whole).any() else 0
        window[whole] = base + np.arange(int(whole.sum()))
        return pd.DataFrame({"window_name": name, "capacity": capacity, "part": part, "window": window, "id": ids[row], "piece": piece.astype(np.int32), "first_token": piece * capacity, "tokens": size})

    kinds = F.array(*[F.struct(F.lit(a).cast("string").alias("window_name"), F.lit(b).cast("bigint").alias("capacity")) for a, b in capacities if b and b > 0]).cast("array<struct<window_name:string,capacity:bigint>>")
    each = sized.withColumn("h", F.xxhash64("id", F.lit(7))).withColumn("part", F.pmod("h", F.lit(parts))).withColumn("k", F.explode(kinds)).select("h", "id", "tokens", "part", "k.window_name", "k.capacity")
    return each.groupBy("window_name", "part").applyInPandas(run, _PACKED)


def report(rows: DataFrame) -> DataFrame:
    """Per capacity: windows, items, cut items, tokens and the share of room left unused."""
    per_window = rows.groupBy("window_name", "capacity", "part", "window").agg(F.sum("tokens").alias("fill"), F.count("*").alias("n"), F.sum(F.when(F.col("piece") > 0, 1).otherwise(0)).alias("more"))
    return per_window.groupBy("window_name", "capacity").agg(
        F.count("*").alias("n_windows"),
        F.sum("n").alias("n_pieces"),
        F.sum("more").alias("n_cuts"),
        F.sum("fill").alias("n_tokens"),
        (1 - F.sum("fill") / (F.count("*") * F.col("capacity"))).alias("unused"),
    )


def documents_packed(docs: DataFrame, windows: DataFrame, folder: str = TOKENIZERS, part_items: int = 100_000) -> DataFrame:
    """Every document packed for each row of ``windows(window_name, capacity_tokens)``, a table of a few rows."""
    kinds = [(r["window_name"], r["capacity_tokens"]) for r in windows.limit(1001).collect()]
    if len(kinds) > 1000:
        raise ValueError("at most 1,000 capacities")
    items = written(token_counts(docs, "doc_id", "text", folder), "token-counts")
    return packed(items, kinds, part_items).withColumnRenamed("id", "doc_id")
