"""Control events: leases, expiry, safety, frames, quotas, request lifecycles and rendezvous.

What a window function can say is one, and runs alike on a table or a micro-batch. What depends
on earlier decisions is a small step function per event, folded over each key's events in
(ts, event_id) order: ``fold_batch`` over a table, ``fold_stream`` over a stream with a
watermark, state kept per key and dropped when it has been idle for ``idle_seconds``. Results
don't depend on where micro-batches end.

Events are ts, event_id, key, actor, action and level; late events beyond the watermark are
dropped by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, event_id bigint, ts timestamp, actor string, action string, outcome string"
Step = Callable[[dict, Any], str]

# ---- stateless and window forms


def validate_commands(events: DataFrame) -> DataFrame:
    """Channel 1 to 512 and value 0 to 255; rejected rows carry a reason."""
    reason = F.when(F.col("channel").isNull() | ~F.col("channel").between(1, 512), "channel").when(F.col("value").isNull() | ~F.col("value").between(0, 255), "value")
    return events.withColumn("reason", reason)


def micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def _w(*keys: str) -> W:
    return W.partitionBy(*keys).orderBy("ts", "event_id")


def leases(events: DataFrame, timeout_s: int) -> DataFrame:
    """Each controller's gap-sessions: events with a ``lease_no`` from 1."""
    gap = micros("ts") - F.lag(micros("ts")).over(_w("controller")) > timeout_s * 1_000_000
    return events.withColumn("_new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("lease_no", F.sum("_new").over(_w("controller")).cast("int")).drop("_new")


def lease_expiry(events: DataFrame, timeout_s: int) -> DataFrame:
    """A row when a lease has been quiet for the timeout, with the universes to be zeroed."""
    s = leases(events, timeout_s).groupBy("controller", "lease_no").agg(F.max("ts").alias("last"), F.count_distinct("universe").alias("n_universes"))
    return s.select("controller", "lease_no", (F.col("last") + F.make_dt_interval(secs=F.lit(timeout_s))).alias("expires"), "n_universes")


def safety_gate(leased: DataFrame) -> DataFrame:
    """Risky commands pass only after an unlock in the same lease."""
    w = _w("controller", "lease_no").rowsBetween(W.unboundedPreceding, -1)
    unlocked = F.coalesce(F.max((F.col("action") == "unlock").cast("int")).over(w), F.lit(0)) == 1
    return leased.withColumn("allowed", ~F.col("risky") | unlocked)


def live_frames(leased: DataFrame) -> DataFrame:
    """Latest value of each (controller, lease, universe, channel) since the last blackout or end."""
    last_clear = F.max(F.when(F.col("action").isin("end", "blackout"), F.struct("ts", "event_id"))).over(W.partitionBy("controller", "lease_no"))
    s = leased.withColumn("_clear", last_clear).where("action = 'set' and (_clear is null or struct(ts, event_id) > _clear)")
    return s.groupBy("controller", "lease_no", "universe", "channel").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def idle_periods(events: DataFrame, timeout_s: int) -> DataFrame:
    """Spans longer than the timeout without any event of a key, from the end of one to the next."""
    n = events.withColumn("next_ts", F.lead("ts").over(_w("key")))
    return n.where(micros("next_ts") - micros("ts") > timeout_s * 1_000_000).select("key", F.col("ts").alias("idle_from"), F.col("next_ts").alias("idle_to"))


def session_expiry(uses: DataFrame, tokens: DataFrame, hours: int) -> DataFrame:
    """Uses of a token (key, origin, ts) are valid for so many hours from issue and one origin."""
    t = tokens.select("key", F.col("origin").alias("_o"), F.col("ts").alias("_issued"))
    j = uses.join(t, "key", "left")
    valid = (F.col("_o") == F.col("origin")) & (F.col("ts") >= F.col("_issued")) & (micros("ts") <= micros("_issued") + hours * 3_600_000_000)
    return j.select(*uses.columns, F.coalesce(valid, F.lit(False)).alias("valid"))


# ---- steps: each changes the state and names the outcome


def seconds(e: Any) -> float:
    return e.ts.timestamp() if hasattr(e.ts, "timestamp") else float(e.ts)


def lease_gate(timeout_s: float) -> Step:
    """One actor holds the key; its events refresh the lease and ``end`` gives it up."""

    def step(s: dict, e: Any) -> str:
        now = seconds(e)
        if s.get("holder") is None or now > s["until"]:
            if e.action == "end":
                s["holder"] = None
                return "no lease"
            s["holder"], s["until"] = e.actor, now + timeout_s
            return "granted"
        if s["holder"] != e.actor:
            return "conflict"
        s["until"] = now + timeout_s
        if e.action == "end":
            s["holder"] = None
            return "released"
        return "accepted"

    return step


def token_bucket(capacity: float, per_second: float) -> Step:
    """Smooth refill, one token a request."""

    def step(s: dict, e: Any) -> str:
        now = seconds(e)
        tokens = min(capacity, s.get("tokens", capacity) + (now - s.get("at", now)) * per_second)
        allowed = tokens >= 1
        s["tokens"], s["at"] = tokens - allowed, now
        return "allow" if allowed else "deny"

    return step


def fixed_window_quota(length_s: float, most: int) -> Step:
    """The window opens at a key's first write; after so many, the rest of it is denied."""

    def step(s: dict, e: Any) -> str:
        now = seconds(e)
        if "start" not in s or now >= s["start"] + length_s:
            s["start"], s["n"] = now, 0
        s["n"] += 1
        return "allow" if s["n"] <= most else "deny"

    return step


def request_lifecycle(ttl_s: float) -> Step:
    """request, approve, deny and fetch: a new request replaces a pending one, approval restarts
    the clock, a result is served once."""

    def step(s: dict, e: Any) -> str:
        now = seconds(e)
        if s.get("state") in ("pending", "approved") and now > s["since"] + ttl_s:
            s["state"] = "expired"
        state = s.get("state")
        if e.action == "request":
            s["state"], s["since"] = "pending", now
            return "replaced" if state == "pending" else "pending"
        if e.action in ("approve", "deny"):
            if state != "pending":
                return f"nothing pending ({state or 'none'})"
            s["state"], s["since"] = ("approved" if e.action == "approve" else "denied"), now
            return s["state"]
        if e.action == "fetch":
            if state in ("approved", "denied"):
                s["state"] = "served"
                return f"served {state}"
            return state or "none"
        return "ignored"

    return step


def rendezvous(ttl_s: float) -> Step:
    """An offer, then one answer within the time; a read of the answer ends the session."""

    def step(s: dict, e: Any) -> str:
        now = seconds(e)
        if s.get("state") and now > s["since"] + ttl_s:
            s.clear()
        state = s.get("state")
        if e.action == "offer":
            if state == "answered":
                return "already answered"
            s["state"], s["since"] = "offered", now
            return "offer replaced" if state else "offered"
        if e.action == "answer":
            if state != "offered":
                return "second answer" if state else "no offer"
            s["state"] = "answered"
            return "matched"
        if e.action == "read":
            if state != "answered":
                return "nothing to read"
            s.clear()
            return "read"
        return "ignored"

    return step


# ---- folding


def _folded(rows: pd.DataFrame, state: dict, step: Step) -> pd.DataFrame:
    rows = rows.sort_values(["ts", "event_id"], kind="stable")
    outcome = [step(state, e) for e in rows.itertuples(index=False)]
    return rows.assign(outcome=outcome)[["key", "event_id", "ts", "actor", "action", "outcome"]]


def fold_batch(events: DataFrame, step: Step) -> DataFrame:
    """Every event with its outcome. Keys are dealt out and put in order by Spark; a task runs through
    its events as a stream with one state at a time, so a key may have any number of them."""
    names = ["key", "event_id", "ts", "actor", "action"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, first = None, {}, True
        for rows in batches:
            outcome = []
            for e in rows.itertuples(index=False):
                now = None if pd.isna(e.key) else e.key
                if first or now != key:
                    key, state, first = now, {}, False
                outcome.append(step(state, e))
            yield rows.assign(outcome=outcome)

    return events.select(*names).repartition("key").sortWithinPartitions("key", "ts", "event_id").mapInPandas(run, OUT)


def fold_stream(events: DataFrame, step: Step, *, watermark: str, idle_seconds: int) -> DataFrame:
    """The same on a stream. Events of a micro-batch are put in order; across micro-batches they
    must come in order, as within the watermark only later ones are kept."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts))
        held = json.loads(state.get[0]) if state.exists else {}
        out = _folded(rows, held, step)
        state.update((json.dumps(held),))
        after = max(state.getCurrentWatermarkMs(), int(rows["ts"].max().timestamp() * 1000)) + idle_seconds * 1000
        state.setTimeoutTimestamp(after)
        yield out

    marked = events.select("key", "event_id", "ts", "actor", "action").withWatermark("ts", watermark)
    return marked.groupBy("key").applyInPandasWithState(run, OUT, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def matched_offers(offers: DataFrame, answers: DataFrame, ttl: str, watermark: str) -> DataFrame:
    """Stream-stream join of offers and answers of one key within the time."""
    o = offers.select("key", F.col("ts").alias("offered_at")).withWatermark("offered_at", watermark)
    a = answers.select(F.col("key").alias("_k"), F.col("ts").alias("answered_at")).withWatermark("answered_at", watermark)
    return o.join(a, F.expr(f"_k = key and answered_at >= offered_at and answered_at <= offered_at + interval {ttl}")).drop("_k")
