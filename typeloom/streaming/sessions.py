"""Typing sessions, gestures and rate limits as stateful streams, sharing their steps with the batch operators."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from typeloom.operators.boundary import RESULT, Walk
from typeloom.operators.gestures import RateLimiter


def replay_stream(tokens: DataFrame, judged: DataFrame, kind: str = "bigint", idle: str = "1 hour", at: str | None = None, groups: int = 0) -> DataFrame:
    """Results of a stream of ``session, seq, token, separator``; the session's walk is the state.

    ``judged`` is a table of verdicts (:func:`typeloom.operators.boundary.verdicts`) of any size, joined with the stream by
    token; a token it lacks stays as typed, with the reason ``not-judged``, and ends the context. With ``at``, an
    event-time column with a watermark, the state of a session ends when the watermark has
    passed its last token by ``idle``; without it, state is kept. With ``groups``, that many groups of sessions
    have a state each, with the walks of all their sessions: a call of Python costs milliseconds, more than most sessions.
    A group's state is written whole, so this is for few large batches; it goes with kept state only.
    """
    if groups and at:
        raise ValueError("sessions of a group cannot end one by one")
    seconds = pd.Timedelta(idle).total_seconds()
    names = ["session", "seq", "token", "separator", *[at] * bool(at)]
    each = tokens.select(*names).join(judged.select("token", "bits", "brief", "verdicts"), "token", "left")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        walk = Walk()
        if state.exists:
            last, brief = map(json.loads, state.get)
            walk = Walk(tuple(last), tuple(brief) if brief else None)
        rows, latest = [], 0
        f = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for seq, t, sep, bits, brief, verdicts in zip(f["seq"], f["token"], f["separator"], f["bits"], f["brief"], f["verdicts"], strict=True):
            found = (int(bits), bool(brief), verdicts) if isinstance(verdicts, str) else None
            rows.append((key[0], seq, *walk.step(t if isinstance(t, str) else "", sep if isinstance(sep, str) else " ", found)))
        if at:
            latest = int(f[at].max().timestamp() * 1000)
        state.update((json.dumps(walk.last), json.dumps(walk.brief, ensure_ascii=False)))
        if at:
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + int(seconds * 1000))
        yield pd.DataFrame(rows, columns=["session", "seq", "original", "replacement", "changed", "erased", "reason"])

    def run_group(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else []
        walks = {s: Walk(tuple(last), tuple(brief) if brief else None) for s, last, brief in kept}
        f, rows = pd.concat(list(frames)).sort_values("seq", kind="stable"), []
        for s, seq, t, sep, bits, brief, verdicts in zip(*(f[c].tolist() for c in ("session", "seq", "token", "separator", "bits", "brief", "verdicts")), strict=True):
            walk = walks.get(s) or walks.setdefault(s, Walk())
            found = (int(bits), bool(brief), verdicts) if isinstance(verdicts, str) else None
            rows.append((s, seq, *walk.step(t if isinstance(t, str) else "", sep if isinstance(sep, str) else " ", found)))
        state.update((json.dumps([(s, w.last, w.brief) for s, w in walks.items()], ensure_ascii=False),))
        yield pd.DataFrame(rows, columns=["session", "seq", "original", "replacement", "changed", "erased", "reason"])

    out = f"session {kind}, seq int, {RESULT}"
    if groups:  # sessions travel as text, so that null among them turns no number into a float
        each = each.withColumns({"session": F.col("session").cast("string"), "of": F.pmod(F.xxhash64("session"), F.lit(groups))})
        done = each.groupBy("of").applyInPandasWithState(run_group, f"session string, seq int, {RESULT}", "kept string", "append", GroupStateTimeout.NoTimeout)
        return done.withColumn("session", F.col("session").cast(kind))
    timeout = GroupStateTimeout.EventTimeTimeout if at else GroupStateTimeout.NoTimeout
    return each.groupBy("session").applyInPandasWithState(run, out, "last string, brief string", "append", timeout)


def rate_limited_stream(calls: DataFrame, kind: str = "bigint") -> DataFrame:
    """``user_id, event_id, accepted`` of a stream of ``user_id, event_id, ts, size``; accepted calls of the last minute are the state."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        limiter = RateLimiter()
        if state.exists:
            limiter.kept = [tuple(x) for x in json.loads(state.get[0])]
        rows = []
        for f in frames:
            f = f.sort_values(["ts", "event_id"], kind="stable")
            rows += [(key[0], e, limiter.offer(t.timestamp(), int(n))) for e, t, n in zip(f["event_id"], f["ts"], f["size"], strict=True)]
        state.update((json.dumps(limiter.kept),))
        yield pd.DataFrame(rows, columns=["user_id", "event_id", "accepted"])

    return calls.groupBy("user_id").applyInPandasWithState(run, f"user_id {kind}, event_id bigint, accepted boolean", "kept string", "append", GroupStateTimeout.NoTimeout)


def counted_stream(events: DataFrame, at: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per kind and time window; events later than the watermark are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
