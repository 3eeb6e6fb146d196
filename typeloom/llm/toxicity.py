"""Abusive, hateful or sexual content (problem 9).

A classifier chain: linear models predict the kinds of content one after the other, and
each is given the log odds of those before it; the last one is the verdict. While
fitting, these come from models that have not seen the document (out of fold). Features
are hashed words and word pairs, once as written and once reduced to consonants, which
spelling tricks (repeated, swapped, masked or digit-for-letter characters) mostly leave
alone. Documents are scored by their worst passage.

Everything is learnt from the labels; there is no list of words. A label tells of a
document only, so examples are chosen in rounds: the passages of documents labelled
toxic that labels of *other* documents make suspicious, against all passages of
documents labelled clean. Passages without a word that leans to either side count for
the bias only. As labels do not tell kinds, the examples are split into ``KINDS`` groups
by the features they share (spherical k-means from the farthest examples); the kinds
therefore have numbers, in the order of their size.

Only a bounded sample of labelled documents (``fit_docs``) is used for fitting; it
holds the documents of the smallest id hashes whose reviewers agree, so it is the same
on every run. Every document is scored, whole, without a shuffle.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 20
KINDS = 4
#: Order of the chain; the last link is the verdict.
LINKS = (*(f"kind_{k + 1}" for k in range(KINDS)), "toxic")
#: Where the bias starts from: most passages are harmless.
PRIOR = -2.5
_VOWELS = "aeiouаеёиоуыэюя"
_REPEATED = r"([^ ])\1+"
#: Between single letters: f.u.c.k, у-б-о-г-и-й.
_SPACED = r"[.\-_*/ ](?=[\p{L}\p{N}](?![\p{L}\p{N}]))(?<=(?<![\p{L}\p{N}])[\p{L}\p{N}].)"
#: Stands for the end of a sentence among the words of a text.
STOP = "\ue000"


def skeleton(word: str) -> str:
    """A word with repeated letters once and without vowels."""
    return re.sub(_REPEATED, r"\1", word).translate(str.maketrans("", "", _VOWELS))


def _h(word: str) -> int:
    x = xxhash.xxh64(word.encode(), seed=42).intdigest()
    return x - (1 << 64) if x >> 63 else x


_STOP_HASH = _h(STOP)


def with_hashed_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``a``, hashes of the words of ``text``, sentence ends among them, and ``b``, those of their skeletons; both arrays are of one length."""
    t = F.regexp_replace(F.lower(text), _SPACED, "")
    t = F.regexp_replace(t, r"[.!?…:]+(?=\s|$)|[\n—]+", f" {STOP} ")
    t = F.btrim(F.regexp_replace(F.regexp_replace(t, rf"[^\p{{L}}{STOP} \t\n]+", ""), r"[ \t\n]+", " "), F.lit(" "))
    each = lambda c: F.transform(F.split(c, " "), lambda w: F.xxhash64(w))
    both = lambda t: F.struct(each(t).alias("a"), each(F.translate(F.regexp_replace(t, _REPEATED, "$1"), _VOWELS, "")).alias("b"))
    # through a generator of one row, so that the words are cut once for both
    return df.select("*", F.inline(F.transform(F.array(t), both)))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def features(words: np.ndarray, skeletons: np.ndarray) -> np.ndarray:
    """Four feature numbers for each position: word, skeleton, pair of words, pair of skeletons (with the word before)."""
    a, b = _mixed(words), _mixed(skeletons ^ np.int64(0x5BD1E995))
    out = np.empty((len(words), 4), np.int64)
    shift = np.uint64(64 - BITS)
    with np.errstate(over="ignore"):
        pa_, pb = a.copy(), b.copy()
        pa_[1:] = (a[1:] ^ (a[:-1] << np.uint64(1))) * np.uint64(0xC2B2AE3D27D4EB4F)
        pb[1:] = (b[1:] ^ (b[:-1] << np.uint64(1))) * np.uint64(0x165667B19E3779F9)
    for i, x in enumerate((a, b, pa_, pb)):
        out[:, i] = (x >> shift).view(np.int64)
    return out


def passages(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of the passage each position lies in: passages end with sentences and with documents."""
    starts = np.zeros(len(words), np.int64)
    starts[offsets[:-1][np.diff(offsets) > 0]] = 1
    starts |= words == _STOP_HASH
    return np.cumsum(starts) - 1


@dataclass
class Chain:
    """Weights per feature and link (each with the log odds of earlier links), and whether a feature counts at all."""

    weights: np.ndarray
    bias: np.ndarray
    links: np.ndarray
    used: np.ndarray

    def odds(self, seg: np.ndarray, feat: np.ndarray, n: int) -> np.ndarray:
        """Log odds of ``n`` passages and all links; ``seg`` and ``feat`` are parallel."""
        out = np.empty((n, len(LINKS)))
        w = self.weights[feat]
        for k in range(len(LINKS)):
            z = np.bincount(seg, w[:, k], minlength=n) + self.bias[k]
            for j in range(k):
                z += self.links[k, j] * np.tanh(out[:, j] / 4)
            out[:, k] = z
        return out


def _fit(seg: np.ndarray, feat: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int, empty: float, l2: float, steps: int = 150, memory: int = 8) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by limited-memory quasi-Newton steps; ``empty`` is the number of further negatives without any feature."""
    n, k = len(y), dense.shape[1]
    pull = np.concatenate((np.full(width + k, l2), [l2 * 0.1]))
    x = np.zeros(width + k + 1)
    x[-1] = PRIOR
    origin = x.copy()

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(seg, x[:width][feat], minlength=n) + dense @ x[width : width + k] + x[-1]
        e = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        off = x - origin
        value = float(np.sum(np.logaddexp(0, z) - y * z) + empty * np.logaddexp(0, x[-1]) + 0.5 * (pull * off * off).sum())
        return value, np.concatenate((np.bincount(feat, e[seg], minlength=width), dense.T @ e, [e.sum() + empty / (1 + np.exp(-x[-1]))])) + pull * off

    value, g = loss(x)
    kept: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, t, r in reversed(kept):
            a = r * (s @ q)
            alphas.append(a)
            q -= a * t
        q *= (kept[-1][0] @ kept[-1][1]) / (kept[-1][1] @ kept[-1][1]) if kept else 1 / max(1.0, np.abs(g).sum())
        for (s, t, r), a in zip(kept, reversed(alphas), strict=True):
            q += (a - r * (t @ q)) * s
        rate, slope = 1.0, -(g @ q)
        while True:
            new = x - rate * q
            v, h = loss(new)
            if v <= value + 1e-4 * rate * slope or rate < 1e-4:
                break
            rate /= 2
        s, t = new - x, h - g
        if s @ t > 1e-10:
            kept = [*kept[1 - memory :], (s, t, 1 / (s @ t))]
        done = value - v < 1e-6 * max(1.0, abs(v))
        x, value, g = new, v, h
        if done:
            break
    return x[:width], x[width : width + k], float(x[-1])


def _best(score: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a passage is the one of the highest score of its document; of equals the last."""
    out = np.zeros(len(score), bool)
    if len(score):
        order = np.lexsort((score, doc))
        out[order[np.flatnonzero(np.append(doc[order][1:] != doc[order][:-1], True))]] = True
    return out


def kinds(seg: np.ndarray, feat: np.ndarray, weight: np.ndarray, n: int, rows: np.ndarray, k: int = KINDS, steps: int = 12) -> np.ndarray:
    """The group, from 0, of each of the passages ``rows``, numbered by falling size: spherical k-means over weighted features, from the farthest passages."""
    number = np.full(n, -1)
    number[rows] = np.arange(len(rows))
    on = number[seg] >= 0
    r, f = number[seg[on]], feat[on]
    columns, f = np.unique(f, return_inverse=True)
    x = np.zeros((len(rows), len(columns)), np.float32)
    x[r, f] = np.maximum(weight[columns], 0)[f]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = [x[int(np.argmax((x > 0).sum(axis=1)))]]
    while len(centres) < min(k, len(rows)):
        # the passage least like all centres; those with a single feature would be centres of nothing
        near = np.max(x @ np.array(centres).T, axis=1) + ((x > 0).sum(axis=1) < 2)
        centres.append(x[int(np.argmin(near))])
    c = np.array(centres)
    group = np.zeros(len(rows), np.int64)
    for _ in range(steps):
        group = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (group == j).any():
                c[j] = x[group == j].sum(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    place = np.empty(len(c), np.int64)
    place[np.argsort(-np.bincount(group, minlength=len(c)), kind="stable")] = np.arange(len(c))
    return place[group]


def fitted(words: list[np.ndarray], skeletons: list[np.ndarray], labels: np.ndarray, folds: int = 3, rounds: int = 3, least_docs: int = 3, chance: float = 10.0, doubt: float = 1.5, suspicious: float = 0.5, plenty: float = 8.0, l2: float = 0.2) -> Chain:
    """The chain from labelled documents, given as arrays of word and skeleton hashes and 0/1 labels.

    A feature counts if it is in ``least_docs`` documents and leans to one side beyond
    ``chance`` (squared deviation from what is expected). A passage of a toxic document
    is an example if its evidence from other documents is ``suspicious`` and the most of
    its document, or ``plenty``; later rounds ask models of other documents instead, which also
    leave out clean documents whose label they contradict by ``doubt``. Without
    labels, or without any that repeat, nothing is toxic.
    """
    m = len(LINKS)
    n_words = np.array([len(w) for w in words], np.int64)
    off = np.concatenate(([0], np.cumsum(n_words)))
    if not off[-1]:
        return Chain(np.zeros((1 << BITS, m), np.float32), np.full(m, PRIOR), np.zeros((m, m)), np.zeros(1 << BITS, bool))
    v, s = np.concatenate(words), np.concatenate(skeletons)
    seg1, f = passages(v, off), features(v, s)
    doc1 = np.repeat(np.arange(len(labels)), n_words)
    once = np.unique(np.repeat(doc1, 4) * (1 << BITS) + f.ravel())
    in_doc, of = once >> BITS, once & ((1 << BITS) - 1)
    pos, all_ = np.bincount(of, labels[in_doc], minlength=1 << BITS), np.bincount(of, minlength=1 << BITS)
    base = (labels.sum() + 1) / (len(labels) + 2)
    lean = lambda p, a: np.log((np.maximum(p, 0) + 4 * base) / (np.maximum(a - p, 0) + 4 * (1 - base))) - np.log(base / (1 - base))
    used = (all_ >= least_docs) & ((pos - all_ * base) ** 2 / (np.maximum(all_, 1) * base * (1 - base)) >= chance)
    number = np.flatnonzero(used)
    width = len(number)
    back = np.full(1 << BITS, -1)
    back[number] = np.arange(width)
    keep = used[f.ravel()]
    # a feature counts once per passage
    pair = np.unique(np.repeat(seg1, 4)[keep] * max(1, width) + back[f.ravel()[keep]])
    seg, feat = pair // max(1, width), pair % max(1, width)
    n_seg = int(seg1[-1]) + 1
    doc = np.zeros(n_seg, np.int64)
    doc[seg1] = doc1
    live = np.unique(seg)
    empty = int((labels[doc] == 0).sum() - (labels[doc[live]] == 0).sum())
    renumber = np.full(n_seg, -1)
    renumber[live] = np.arange(len(live))
    seg, doc, n = renumber[seg], doc[live], len(live)
    known = labels[doc] == 1
    p, a = pos[number][feat], all_[number][feat]
    score = np.bincount(seg, np.clip(lean(p - known[seg], a - 1), -1, 3), minlength=n)
    fold = (np.random.default_rng(17).permutation(len(labels)) % folds)[doc]

    def fit(y: np.ndarray, rows: np.ndarray, dense: np.ndarray, share: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
        at = np.cumsum(rows) - 1
        inside = rows[seg]
        return _fit(at[seg[inside]], feat[inside], dense[rows], y[rows], width, empty * share, l2)

    def out_of_fold(y: np.ndarray, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        out = np.empty(n)
        for part in range(folds):
            w, d, b = fit(y, (fold != part) & rows, dense, 1 - 1 / folds)
            here = fold == part
            out[here] = (np.bincount(seg, w[feat], minlength=n) + dense @ d + b)[here]
        return out

    top = known & (_best(score, doc) & (score > suspicious) | (score >= plenty))
    doubted = np.zeros(n, bool)
    for _ in range(rounds - 1):
        fresh = out_of_fold(top.astype(float), (top | ~known) & ~doubted, np.zeros((n, 0)))
        doubted = ~known & (fresh > doubt)
        top = known & ((fresh > 0) | (_best(fresh, doc) & (score > suspicious) & (fresh > -doubt)))
    rows = (top | ~known) & ~doubted
    kind = np.full(n, -1)
    if top.any():
        kind[top] = kinds(seg, feat, lean(pos[number], all_[number]), n, np.flatnonzero(top))
    weights, bias, links, oof = np.zeros((width, m)), np.zeros(m), np.zeros((m, m)), np.zeros((n, m))
    for k in range(m):
        y = (kind == k if k < m - 1 else top).astype(float)
        dense = np.tanh(oof[:, :k] / 4)
        if k < m - 1:
            oof[:, k] = out_of_fold(y, rows, dense)
        weights[:, k], links[k, :k], bias[k] = fit(y, rows, dense)
    table = np.zeros((1 << BITS, m), np.float32)
    table[number] = weights
    return Chain(table, bias, links, used)


def scored_rows(chain: Chain, words: np.ndarray, skeletons: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probabilities of all links for every document: those of its worst passage."""
    n = len(offsets) - 1
    out = np.zeros((n, len(LINKS)))
    out[:] = 1 / (1 + np.exp(-chain.odds(np.zeros(0, np.int64), np.zeros(0, np.int64), 1)[0]))
    if not len(words):
        return out
    seg1, f = passages(words, offsets), features(words, skeletons)
    keep = np.flatnonzero(chain.used[f.ravel()])
    seg, feat = seg1[keep >> 2], f.ravel()[keep]
    pair = np.unique(seg << BITS | feat)
    seg, feat = pair >> BITS, pair & ((1 << BITS) - 1)
    live, seg = np.unique(seg, return_inverse=True)
    if not len(live):
        return out
    p = 1 / (1 + np.exp(-np.clip(chain.odds(seg, feat, len(live)), -30, 30)))
    doc_of = np.searchsorted(offsets[1:], np.searchsorted(seg1, live), "right")
    for k in range(len(LINKS)):
        np.maximum.at(out[:, k], doc_of, p[:, k])
    return out


def labelled(docs: DataFrame, labels: DataFrame, fit_docs: int, longest: int = 10_000) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """At most ``fit_docs`` documents whose labels agree; null labels do not count, texts of more than ``longest`` characters are not fitted on."""
    each = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi")).where("lo = hi")
    picked = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs).select("doc_id", F.col("lo").alias("y"))
    mine = docs.where(F.col("text").isNotNull() & (F.length("text") <= longest)).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = with_hashed_words(mine).select("doc_id", "y", "a", "b").toArrow().sort_by("doc_id")
    split = lambda c: [np.asarray(x.values) for x in rows.column(c)]
    return split("a"), split("b"), rows.column("y").to_numpy().astype(np.int64)


def scored(docs: DataFrame, labels: DataFrame, fit_docs: int = 12_000) -> DataFrame:
    """``doc_id, source, kind_1 .. kind_4, score`` of every document.

    ``score`` is the probability that a passage is toxic. A null or empty text scores as
    one without any known word. Without labels nothing is toxic; an empty table
    gives an empty result; a doc_id that occurs again is scored again.
    """
    chain = fitted(*labelled(docs, labels, fit_docs))
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(chain))
    schema = "doc_id bigint, source string, " + "".join(f"{k} double, " for k in LINKS[:-1]) + "score double"
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for r in batches:
            x, y = r.column("a"), r.column("b")
            off = x.offsets.to_numpy().astype(np.int64)
            yoff = y.offsets.to_numpy()
            v = np.ascontiguousarray(x.values.to_numpy()[off[0] : off[-1]])
            s = np.ascontiguousarray(y.values.to_numpy()[yoff[0] : yoff[-1]])
            p = scored_rows(own, v, s, off - off[0])
            yield pa.RecordBatch.from_arrays([r.column("doc_id"), r.column("source"), *(pa.array(p[:, k]) for k in range(len(LINKS)))], names=["doc_id", "source", *LINKS[:-1], "score"])

    each = with_hashed_words(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.coalesce("text", F.lit("")).alias("text")))
    return each.select("doc_id", "source", "a", "b").mapInArrow(run, schema)


def rates(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per source: documents, flagged ones, their rate and the mean score; a null source is a group of its own."""
    return scores.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(F.when(F.col("score") >= threshold, 1).otherwise(0)).alias("n_flagged"), F.avg(F.when(F.col("score") >= threshold, 1.0).otherwise(0.0)).alias("rate"), F.avg("score").alias("mean_score")
    )
