"""Frequency of every distinct term and in how many records it occurs (problem 5).

Burst tries: every task counts its terms in a trie whose leaves are small tables that
burst into children, one per next character, when they hold more than ``BURST`` terms.
A task hands on its leaves, each a prefix with the counters of the terms below it. From
the sizes of all leaves follow adaptive routes: prefixes short where terms are few and
long where they are many, so that no route holds more than its share; a route that is
still too large at the depth of the tries is split by a hash of the terms. Matching
subtrees of all tasks meet on their route and are merged there, leaf by leaf, in a trie of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.tables import written

BURST = 512
DEPTH = 12
_LEAVES = "prefix string, terms array<string>, occurrences array<bigint>, records array<bigint>"


class BurstTrie:
    """Counts (occurrences, records) of terms; a leaf with more than ``burst`` terms becomes a node with one leaf per next character."""

    def __init__(self, burst: int = BURST, depth: int = DEPTH) -> None:
        self.burst, self.depth, self.size = burst, depth, 0
        self.root: dict = {"leaf": {}, "level": 0}

    def add(self, term: str, occurrences: int, records: int) -> None:
        node = self.root
        while "leaf" not in node:
            node = node["next"].setdefault(term[node["level"] : node["level"] + 1], {"leaf": {}, "level": node["level"] + 1})
        leaf = node["leaf"]
        old = leaf.get(term)
        if old is None:
            self.size += 1
            leaf[term] = [occurrences, records]
            if len(leaf) > self.burst and node["level"] < self.depth:
                self._burst(node)
        else:
            old[0] += occurrences
            old[1] += records

    def _burst(self, node: dict) -> None:
        k, kids = node["level"], {}
        for term, c in node.pop("leaf").items():
            kids.setdefault(term[k : k + 1], {"leaf": {}, "level": k + 1})["leaf"][term] = c
        node["next"] = kids
        for kid in kids.values():
            if len(kid["leaf"]) > self.burst and kid["level"] < self.depth and any(len(t) > kid["level"] for t in kid["leaf"]):
                self._burst(kid)

    def merge(self, prefix: str, leaf: dict[str, list[int]]) -> None:
        """Takes over a leaf of another trie: into a matching leaf as a whole, and term by term where this trie has burst further."""
        node = self.root
        while "leaf" not in node and node["level"] < len(prefix):
            node = node["next"].setdefault(prefix[node["level"]], {"leaf": {}, "level": node["level"] + 1})
        if "leaf" not in node:
            for term, c in leaf.items():
                self.add(term, *c)
            return
        mine = node["leaf"]
        before = len(mine)
        for term, c in leaf.items():
            old = mine.get(term)
            if old is None:
                mine[term] = list(c)
            else:
                old[0] += c[0]
                old[1] += c[1]
        self.size += len(mine) - before
        if len(mine) > self.burst and node["level"] < self.depth:
            self._burst(node)

    def leaves(self) -> Iterator[tuple[str, dict[str, list[int]]]]:
        todo = [("", self.root)]
        while todo:
            prefix, node = todo.pop()
            if "leaf" in node:
                if node["leaf"]:
                    yield prefix, node["leaf"]
            else:
                todo.extend((prefix + c, kid) for c, kid in node["next"].items())


def _frame(leaves: Iterator[tuple[str, dict[str, list[int]]]]) -> pd.DataFrame:
    return pd.DataFrame([(p, list(t), [c[0] for c in t.values()], [c[1] for c in t.values()]) for p, t in leaves], columns=["prefix", "terms", "occurrences", "records"])


def _tries(most: int):  # noqa: ANN202
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = BurstTrie()
        for f in frames:
            for term, n, r in zip(f["term"], f["n"], f["r"], strict=True):
                trie.add(term, n, r)
            if trie.size > most:
                yield _frame(trie.leaves())
                trie = BurstTrie()
        yield _frame(trie.leaves())

    return run


def routes(leaves: DataFrame, share: int | None, most: int) -> tuple[dict[str, int], int]:
    """Prefixes with more than a share of entries below them, and that share; routes end one character beyond these.

    By default four routes a partition share the entries, with at least ``BURST`` and at most ``most`` each. Prefixes
    are listed down to a 65,536th of all entries, so that each of the ``DEPTH`` levels has
    fewer than 65,536 of them: the result is bounded whatever the data.
    """
    sized = leaves.select("prefix", F.size("terms").alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    share = share or min(most, max(BURST, total // (4 * int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1))
    up = sized.select(F.explode(F.expr("transform(sequence(0, length(prefix)), k -> left(prefix, k))")).alias("p"), "n")
    wide = up.groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") > max(share, total // 65_536))
    return {r["p"]: r["n"] for r in wide.collect()}, share


def route(term: str, wide: dict[str, int], share: int, depth: int = DEPTH) -> str:
    """Where a term is merged: the shortest of its prefixes that is not wide, or a part of the deepest."""
    k = 0
    while term[:k] in wide and k < min(len(term), depth):
        k += 1
    n = wide.get(term[:k], 0) if k == depth else 0
    return f"{term[:k]}\x00{xxhash.xxh64(term.encode()).intdigest() % (n // share + 1)}" if n else term[:k]


def _routed(wide: dict[str, int], share: int):  # noqa: ANN202
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for prefix, terms, occ, rec in zip(f["prefix"], f["terms"], f["occurrences"], f["records"], strict=True):
                if not len(terms):
                    continue
                if prefix not in wide and (at := route(prefix, wide, share)) not in wide:
                    rows.append((at, prefix, list(terms), list(occ), list(rec)))  # the whole leaf takes one route
                    continue
                parts: dict[str, tuple[list, list, list]] = {}
                for t, o, r in zip(terms, occ, rec, strict=True):
                    p = parts.setdefault(route(t, wide, share), ([], [], []))
                    p[0].append(t)
                    p[1].append(o)
                    p[2].append(r)
                rows.extend((k, prefix, *p) for k, p in parts.items())
            yield pd.DataFrame(rows, columns=["route", "prefix", "terms", "occurrences", "records"])

    return run


def _merge(f: pd.DataFrame) -> pd.DataFrame:
    trie = BurstTrie()
    for prefix, terms, occ, rec in zip(f["prefix"], f["terms"], f["occurrences"], f["records"], strict=True):
        trie.merge(prefix, {t: [o, r] for t, o, r in zip(terms, occ, rec, strict=True)})
    terms, occ, rec = [], [], []
    for _, leaf in trie.leaves():
        terms.extend(leaf)
        occ.extend(c[0] for c in leaf.values())
        rec.extend(c[1] for c in leaf.values())
    return pd.DataFrame({"term": terms, "occurrences": occ, "records": rec})


def term_counts(df: DataFrame, term: Column, record: str, token: str | None = None, share: int | None = None, most: int = 400_000) -> DataFrame:
    """``term, occurrences, records`` of every distinct non-empty ``term``.

    ``token`` names the id under which a delivery may be repeated; each id counts once,
    rows without one are left out. Null and empty terms do not count; a null record
    counts as an occurrence but as no record. An empty table gives an empty result.
    """
    rows = df.select(term.alias("term"), F.col(record).alias("record"), *([F.col(token).alias("token")] if token else []))
    if token:
        rows = rows.where(F.col("token").isNotNull()).groupBy("token").agg(F.min(F.struct("term", "record")).alias("x")).select("x.term", "x.record")
    rows = rows.where(F.col("term").isNotNull() & (F.col("term") != ""))
    each = rows.groupBy("term", "record").agg(F.count("*").alias("n")).select("term", "n", F.col("record").isNotNull().cast("bigint").alias("r"))
    leaves = written(each.mapInPandas(_tries(most), _LEAVES), "term-leaves")
    routed = leaves.mapInPandas(_routed(*routes(leaves, share, most)), f"route string, {_LEAVES}")
    return routed.groupBy("route").applyInPandas(_merge, "term string, occurrences bigint, records bigint")


def marked(counts: DataFrame, n_records: int, rare_below: int = 3, common_part: int = 20) -> DataFrame:
    """Adds ``mark``: ``rare`` in fewer than ``rare_below`` records, ``common`` in more than one in ``common_part`` of all, else null."""
    return counts.withColumn("mark", F.when(F.col("records") < rare_below, "rare").when(F.col("records") * common_part > n_records, "common"))
