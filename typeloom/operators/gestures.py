"""Rates, gestures and learned exceptions over event logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def offered_load(events: DataFrame, key: str = "user_id", at: str = "ts", seconds: int = 60) -> DataFrame:
    """Adds ``n_before``: events of the same key in the ``seconds`` up to and including each event."""
    w = Window.partitionBy(key).orderBy(_micros(at)).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("n_before", F.count("*").over(w))


def double_taps(events: DataFrame, key: str = "user_id", at: str = "ts", kind: str = "event_type", id_col: str = "event_id", gap: float = 0.4) -> DataFrame:
    """Events that follow one of the same kind and key within ``gap`` seconds with none between."""
    w = Window.partitionBy(key).orderBy(at, id_col)
    e = events.withColumns({"_kind": F.lag(kind).over(w), "_at": F.lag(_micros(at)).over(w)})
    return e.where((F.col("_kind") == F.col(kind)) & (_micros(at) - F.col("_at") <= int(gap * 1e6))).drop("_kind", "_at")


class RateLimiter:
    """Accepts a call unless one came under ``apart`` seconds ago or the last minute is full by number or bytes; only accepted calls count."""

    def __init__(self, apart: float = 5.0, calls: int = 18, size: int = 70_000) -> None:
        self.apart, self.calls, self.size, self.kept = apart, calls, size, []

    def offer(self, at: float, size: int) -> bool:
        self.kept = [(t, n) for t, n in self.kept if at - t < 60]
        if self.kept and at - self.kept[-1][0] < self.apart or len(self.kept) >= self.calls or sum(n for _, n in self.kept) + size > self.size:
            return False
        self.kept.append((at, size))
        return True


def accepted(events: DataFrame, key: str = "user_id", at: str = "ts", id_col: str = "event_id", size: str = "size") -> DataFrame:
    """``id_col, accepted`` of every event in the order of time within its key; a null time is rejected."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        limiter = RateLimiter()
        f = f.sort_values(["t", id_col], kind="stable")
        ok = [bool(t == t and limiter.offer(t, int(n))) for t, n in zip(f["t"], f[size].fillna(0), strict=True)]
        return pd.DataFrame({id_col: f[id_col], "accepted": ok})

    e = events.select(key, id_col, (_micros(at) / 1e6).alias("t"), F.col(size).cast("bigint").alias(size))
    return e.groupBy(key).applyInPandas(run, f"{id_col} {dict(events.dtypes)[id_col]}, accepted boolean")


class TapDetector:
    """Two clean taps of a key, each held at most ``hold`` ms, released at most ``gap`` ms apart; anything between cancels."""

    def __init__(self, hold: int = 250, gap: int = 400) -> None:
        self.hold, self.gap, self.down, self.last = hold, gap, None, None

    def feed(self, key: str, down: bool, tick: int, modifier: bool = False, watched: str = "shift") -> bool:
        if key != watched or modifier:
            self.down = self.last = None
            return False
        if down:
            if self.down is not None:  # auto-repeat
                self.down, self.last = -1, None
            else:
                self.down = tick
            return False
        start, self.down = self.down, None
        if start is None or start < 0 or tick - start > self.hold:
            self.last = None
            return False
        if self.last is not None and tick - self.last <= self.gap:
            self.last = None
            return True
        self.last = tick
        return False


def taps(events: DataFrame, session: str = "session") -> DataFrame:
    """``session, tick`` of every double tap in ``session, tick, key, down, modifier``."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        d = TapDetector()
        f = f.sort_values("tick", kind="stable")
        on = [d.feed(k, bool(x), int(t), bool(m)) for k, x, t, m in zip(f["key"], f["down"], f["tick"], f["modifier"], strict=True)]
        return f.loc[on, [session, "tick"]]

    return events.groupBy(session).applyInPandas(run, f"{session} {dict(events.dtypes)[session]}, tick bigint")


def learned_exceptions(reverts: DataFrame, token: str, least: int = 2) -> DataFrame:
    """Tokens reverted at least ``least`` times, whatever their case."""
    return reverts.where(F.col(token).isNotNull()).groupBy(F.lower(token).alias("token")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def applied_edits(text: str | None, edits: list[tuple[int, int, str]] | None) -> str | None:
    """``text`` after edits (offset, length, replacement), last first; out of range, overlapping and second insertions at a place are skipped."""
    if text is None:
        return None
    limit, inserted = len(text), set()
    for offset, length, new in sorted(edits or [], key=lambda e: -e[0]):
        if offset < 0 or length < 0 or offset + length > len(text) or offset + length > limit or (length == 0 and offset in inserted):
            continue
        text = text[:offset] + new + text[offset + length :]
        limit = offset
        if length == 0:
            inserted.add(offset)
    return text


def edited(df: DataFrame, text: str, edits: str, to: str = "edited") -> DataFrame:
    """Adds ``to``: ``text`` with the array of (offset, length, replacement) structs applied, as a built-in fold."""
    c = F.array_sort(F.coalesce(F.filter(edits, lambda e: (e["offset"] >= 0) & (e["length"] >= 0) & (e["offset"] + e["length"] <= F.length(text))), F.array().cast(dict(df.dtypes)[edits])), lambda a, b: F.when(a["offset"] > b["offset"], -1).when(a["offset"] < b["offset"], 1).otherwise(0))
    start = F.struct(F.col(text).alias("text"), F.length(text).alias("limit"), F.lit(-1).alias("inserted"))

    def step(s, e):  # noqa: ANN001, ANN202
        ok = (e["offset"] + e["length"] <= s["limit"]) & ~((e["length"] == 0) & (e["offset"] == s["inserted"]))
        new = F.concat(s["text"].substr(F.lit(1), e["offset"]), e["replacement"], s["text"].substr(e["offset"] + e["length"] + 1, F.length(s["text"])))
        return F.struct(F.when(ok, new).otherwise(s["text"]).alias("text"), F.when(ok, e["offset"]).otherwise(s["limit"]).alias("limit"), F.when(ok & (e["length"] == 0), e["offset"]).otherwise(s["inserted"]).alias("inserted"))

    return df.withColumn(to, F.aggregate(c, start, step, lambda s: s["text"]))


#: What is read of a checker's answer.
ANSWER = "matches array<struct<offset:int,length:int,replacements:array<struct<value:string>>>>"


def with_suggestions(df: DataFrame, answer: str, to: str = "edits") -> DataFrame:
    """Adds ``to``: offset, length and first replacement of every match in a checker's JSON ``answer``; matches without one are left out, no JSON gives none."""
    found = F.from_json(answer, ANSWER)["matches"]
    each = F.transform(found, lambda m: F.struct(m["offset"].alias("offset"), m["length"].alias("length"), F.get(m["replacements"], F.lit(0))["value"].alias("replacement")))
    none = F.array().cast("array<struct<offset:int,length:int,replacement:string>>")
    return df.withColumn(to, F.coalesce(F.filter(each, lambda e: F.coalesce(e["replacement"], F.lit("")) != ""), none))


class WordBuffer:
    """The word being typed: a backspace shortens it, a command or a change of place forgets it, and an overlong or marked one is suppressed until the next word."""

    def __init__(self, longest: int = 80, marks: str = "/@#") -> None:
        self.longest, self.marks, self.text, self.valid = longest, marks, "", True

    def feed(self, kind: str, text: str = "") -> str | None:
        """``kind`` is ``text``, ``back``, ``end`` (a separator; gives the word or None where it is suppressed) or anything that forgets."""
        if kind == "text":
            self.text += text
            self.valid = self.valid and len(self.text) <= self.longest and self.text[:1] not in self.marks
        elif kind == "back":
            self.text = self.text[:-1]
        else:
            out = self.text if self.valid and self.text else None
            self.text, self.valid = "", True
            return out if kind == "end" else None
        return None


def current(results: DataFrame, state: DataFrame, key: str = "session", version: str = "revision") -> DataFrame:
    """The rows of ``results(key, version)`` made for the version that ``state(key, version)`` is at; stale ones, and those of unknown keys, are dropped."""
    latest = state.groupBy(key).agg(F.max(version).alias("_at"))
    return results.join(latest, key).where(F.col(version) == F.col("_at")).drop("_at")
