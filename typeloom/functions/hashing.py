"""Hashes, buckets, character n-grams and letter masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters of the FNV hashes.
FNV32_START, FNV32_PRIME = 2166136261, 16777619
FNV64_START, FNV64_PRIME = 14695981039346656037, 1099511628211
SECOND_START, SECOND_PRIME = 1099511628211, 14029467366897019727
PROBES = 7


def _bytes(c: Column) -> Column:
    """The UTF-8 bytes of a text as numbers."""
    h = F.hex(F.encode(c, "UTF-8"))
    return F.when(F.length(h) > 0, F.transform(F.sequence(F.lit(0), (F.length(h) / 2).cast("int") - 1), lambda i: F.conv(h.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def fnv16(c: Column) -> Column:
    """FNV-1a of 32 bits over UTF-8, cut to 16 bits."""
    step = lambda h, b: F.pmod(h.bitwiseXOR(b) * F.lit(FNV32_PRIME), F.lit(1 << 32))
    return F.aggregate(_bytes(c), F.lit(FNV32_START).cast("bigint"), step).bitwiseAND(F.lit(65535))


def _fnv64(raw: list[bytes], start: int, prime: int) -> np.ndarray:
    h = np.full(len(raw), start, np.uint64)
    length = np.array([len(r) for r in raw])
    width = int(length.max(initial=0))
    if width:
        table = np.zeros((len(raw), width), np.uint64)
        for i, r in enumerate(raw):
            table[i, : len(r)] = np.frombuffer(r, np.uint8)
        with np.errstate(over="ignore"):
            for j in range(width):
                on = length > j
                h[on] = (h[on] ^ table[on, j]) * np.uint64(prime)
    return h


def bloom_probes(bits: int):  # noqa: ANN201
    """Positions of a word's seven probes in a filter of ``bits`` (a power of two); wrap-around arithmetic has no built-in form."""

    @F.pandas_udf("array<bigint>")
    def probes(words: pd.Series) -> pd.Series:
        raw = [(w or "").encode() for w in words]
        a = _fnv64(raw, FNV64_START, FNV64_PRIME)
        b = _fnv64(raw, SECOND_START, SECOND_PRIME) | np.uint64(1)
        with np.errstate(over="ignore"):
            at = [((a + np.uint64(i) * b) & np.uint64(bits - 1)).astype(np.int64) for i in range(PROBES)]
        return pd.Series([None if w is None else x for w, x in zip(words, np.stack(at, axis=1).tolist(), strict=True)])

    return probes


def split_bucket(normal: Column) -> Column:
    """The first four bytes of SHA-256, little-endian, modulo 1000."""
    h = F.sha2(normal, 256)
    le = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in (3, 2, 1, 0)])
    return F.conv(le, 16, 10).cast("bigint") % 1000


def split_of(bucket: Column) -> Column:
    return F.when(bucket < 20, "train").when(bucket < 22, "calibration").when(bucket < 24, "dev").when(bucket < 26, "final").otherwise("unused")


def sampled_tenth(word: Column) -> Column:
    h = F.sha2(word, 256)
    return F.conv(F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)), 16, 10).cast("bigint") % 10 == 0


def ngrams(padded: Column, n: int) -> Column:
    return F.when(F.length(padded) >= n, F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: padded.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def feature_names(word: Column, prefix: str, most: int = 5) -> Column:
    """Character n-grams of 1 to ``most`` over ``^word$``, each with prefix and length."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))

    def named(n: int) -> Column:
        return F.transform(ngrams(padded, n), lambda g: F.concat(F.lit(f"{prefix}{n}:"), g))

    return F.flatten(F.array(*[named(n) for n in range(1, most + 1)]))


def letter_mask(word: Column) -> Column:
    """One bit per letter code modulo 64."""
    codes = F.transform(F.split(word, ""), lambda ch: F.ascii(ch))
    return F.aggregate(F.filter(codes, lambda x: x > 0), F.lit(0).cast("bigint"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(F.lit(63)).cast("int"))))


def quantised(count: Column) -> Column:
    return F.when(count <= 0, 0).otherwise(F.least(F.lit(255), 1 + F.bround(10 * F.log2(count)))).cast("int")


def dequantised(q: Column) -> Column:
    return F.when(q == 0, 0.0).otherwise(F.pow(F.lit(2.0), (q - 1) / 10.0))


def keep_probability(logit: Column, threshold: float) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), threshold - logit))))
