"""Queries over control events: batch forms with SQL, folded state, and both on streams that are stopped and restarted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmine.plans.case import ORACLES, QUERIES, Tables, case
from specmine.streaming import control, live

HOURS = 6
CMD = "commands as (select user_id as controller, event_id, ts, case event_type when 'click' then 'set' when 'view' then 'heartbeat' when 'signup' then 'request' when 'purchase' then 'unlock' else 'end' end as action, k as channel, level % 300 as value, k % 4 as universe, level % 7 = 0 as risky from log)"
LEASED = CMD + f", gaps as (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by controller order by ts, event_id) > {HOURS * 3600}000000 as g from commands), leased as (select * exclude (g), cast(sum(case when coalesce(g, true) then 1 else 0 end) over (partition by controller order by ts, event_id) as int) as lease_no from gaps)"


def commands(t: Tables) -> DataFrame:
    names = F.create_map(*map(F.lit, ["click", "set", "view", "heartbeat", "signup", "request", "purchase", "unlock", "error", "end"]))
    return t("log").select(F.col("user_id").alias("controller"), "event_id", "ts", names[F.col("event_type")].alias("action"), F.col("k").alias("channel"), (F.col("level") % 300).alias("value"), (F.col("k") % 4).alias("universe"), (F.col("level") % 7 == 0).alias("risky"))


def leased(t: Tables) -> DataFrame:
    return control.leases(commands(t), HOURS * 3600)


def keyed(t: Tables, key, names: dict[str, str]) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return t("log").select(key.cast("string").alias("key"), "event_id", "ts", F.col("user_id").cast("string").alias("actor"), m[F.col("event_type")].alias("action"))


case("t1_validate_commands", lambda t: control.validate_commands(commands(t).withColumn("channel", F.col("channel") * 6)).select("event_id", "reason"), "log", f"{CMD} select event_id, case when channel * 6 not between 1 and 512 then 'channel' when value not between 0 and 255 then 'value' end as reason from commands")
case("t3_leases", lambda t: leased(t).select("event_id", "lease_no"), "log", f"{LEASED} select event_id, lease_no from leased")
case("t3_lease_expiry", lambda t: control.lease_expiry(commands(t), HOURS * 3600), "log", f"{LEASED} select controller, lease_no, max(ts) + interval {HOURS} hour as expires, count(distinct universe) as n_universes from leased group by 1, 2")
case("t4_safety_gate", lambda t: control.safety_gate(leased(t)).select("event_id", "allowed"), "log", f"{LEASED} select event_id, not risky or coalesce(max(case when action = 'unlock' then 1 else 0 end) over (partition by controller, lease_no order by ts, event_id rows between unbounded preceding and 1 preceding), 0) = 1 as allowed from leased")
case("t5_live_frames", lambda t: control.live_frames(leased(t)), "log", f"""{LEASED}, c as (select controller, lease_no, max(struct_pack(a := ts, b := event_id)) as clear from leased where action in ('end', 'blackout') group by 1, 2)
    select controller, lease_no, universe, channel, arg_max(value, struct_pack(a := ts, b := event_id)) as value from leased left join c using (controller, lease_no) where action = 'set' and (clear is null or struct_pack(a := ts, b := event_id) > clear) group by 1, 2, 3, 4""")  # fmt: skip
case("t10_idle_periods", lambda t: control.idle_periods(commands(t).withColumnRenamed("controller", "key"), 24 * 3600), "log", f'{CMD} select key, ts as idle_from, n as idle_to from (select controller as "key", ts, lead(ts) over (partition by controller order by ts, event_id) as n from commands) where epoch_us(n) - epoch_us(ts) > 86400000000')


def sessions(t: Tables) -> tuple[DataFrame, DataFrame]:
    c = commands(t).withColumnRenamed("controller", "key").withColumn("origin", F.col("universe"))
    tokens = c.where("action = 'request'").groupBy("key").agg(F.min_by(F.struct("ts", "origin"), F.struct("ts", "event_id")).alias("s")).select("key", "s.ts", "s.origin")
    return c.select("key", "origin", "ts", "event_id"), tokens


case("t11_session_expiry", lambda t: control.session_expiry(*sessions(t), 48).select("event_id", "valid"), "log", f"""{CMD}, tok as (select controller, arg_min(ts, struct_pack(a := ts, b := event_id)) as t0, arg_min(universe, struct_pack(a := ts, b := event_id)) as o from commands where action = 'request' group by 1)
    select event_id, coalesce(o = universe and ts >= t0 and ts <= t0 + interval 48 hour, false) as valid from commands left join tok using (controller)""")  # fmt: skip


def folded(key: str, actions: dict[str, str], start: str, state: dict[str, str], outcome: str, before: str = "") -> str:
    """SQL of a fold: events of a key in order, each step's state from the one before.

    ``start`` are the state's first values, ``state`` its next ones and ``outcome`` the row's, over the
    old state and the event; ``before`` changes the old state ahead of both.
    """
    action = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in actions.items()) + " end"
    names, event = ", ".join(state), "n.key, n.event_id, n.ts, n.actor, n.action, n.u, n.i"
    old = before or ", ".join(f"s.{c}" for c in state)
    step = f"select {{0}}, {', '.join(f'{x} as {c}' for c, x in state.items())}, {outcome} as outcome from"
    return f"""recursive n as (select cast({key} as varchar) as key, event_id, ts, cast(user_id as varchar) as actor, {action} as action, epoch_us(ts) as u, row_number() over (partition by {key} order by ts, event_id) as i from log),
    f as ({step.format('key, event_id, ts, actor, action, u, i')} (select {event}, {old} from n, (select {start}) s where n.i = 1) x
      union all {step.format('key, event_id, ts, actor, action, u, i')} (select {event}, {old} from n join f s on n.key is not distinct from s.key and n.i = s.i + 1) x)
    select key, event_id, ts, actor, action, outcome from f"""


def us(seconds: int) -> str:
    return f"{seconds}000000"


T2 = {"click": "set", "view": "heartbeat", "signup": "set", "purchase": "set", "error": "end"}
case("t2_lease_gate", lambda t: control.fold_batch(keyed(t, F.col("k"), T2), control.lease_gate(HOURS * 3600)), "log", folded(
    "k", T2, "cast(null as varchar) as holder, cast(0 as bigint) as until",
    {"holder": "case when holder is null or u > until then case when action = 'end' then null else actor end when holder <> actor then holder when action = 'end' then null else holder end", "until": f"case when holder is null or u > until or holder = actor then u + {us(HOURS * 3600)} else until end"},
    "case when holder is null or u > until then case when action = 'end' then 'no lease' else 'granted' end when holder <> actor then 'conflict' when action = 'end' then 'released' else 'accepted' end",
))
T6 = dict.fromkeys(["click", "view", "signup", "purchase", "error"], "call")
case("t6_token_bucket", lambda t: control.fold_batch(keyed(t, F.col("user_id"), T6), control.token_bucket(2, 1 / 43200)), "log", folded(
    "user_id", T6, "cast(2 as double) as tokens, cast(null as bigint) as seen",
    {"tokens": "tokens - case when tokens >= 1 then 1 else 0 end", "seen": "u"}, "case when tokens >= 1 then 'allow' else 'deny' end",
    "least(cast(2 as double), s.tokens + coalesce(n.u - s.seen, 0) / 1000000.0 / 43200) as tokens, s.seen",
))
T8 = {"click": "fetch", "view": "approve", "signup": "request", "purchase": "fetch", "error": "deny"}
case("t8_request_lifecycle", lambda t: control.fold_batch(keyed(t, F.col("user_id"), T8), control.request_lifecycle(12 * 3600)), "log", folded(
    "user_id", T8, "cast(null as varchar) as state, cast(0 as bigint) as since",
    {"state": "case when action = 'request' then 'pending' when action in ('approve', 'deny') and state = 'pending' then case action when 'approve' then 'approved' else 'denied' end when action = 'fetch' and state in ('approved', 'denied') then 'served' else state end", "since": "case when action = 'request' or action in ('approve', 'deny') and state = 'pending' then u else since end"},
    "case when action = 'request' then case when state = 'pending' then 'replaced' else 'pending' end when action in ('approve', 'deny') then case when state = 'pending' then case action when 'approve' then 'approved' else 'denied' end else 'nothing pending (' || coalesce(state, 'none') || ')' end when action = 'fetch' then case when state in ('approved', 'denied') then 'served ' || state else coalesce(state, 'none') end else 'ignored' end",
    f"case when s.state in ('pending', 'approved') and n.u > s.since + {us(12 * 3600)} then 'expired' else s.state end as state, s.since",
))
T9 = {"click": "read", "view": "read", "signup": "offer", "purchase": "answer", "error": "offer"}
case("t9_rendezvous", lambda t: control.fold_batch(keyed(t, F.col("k"), T9), control.rendezvous(12 * 3600)), "log", folded(
    "k", T9, "cast(null as varchar) as state, cast(0 as bigint) as since",
    {"state": "case when action = 'offer' and state is distinct from 'answered' then 'offered' when action = 'answer' and state = 'offered' then 'answered' when action = 'read' and state = 'answered' then null else state end", "since": "case when action = 'offer' and state is distinct from 'answered' then u else since end"},
    "case action when 'offer' then case when state = 'answered' then 'already answered' when state is null then 'offered' else 'offer replaced' end when 'answer' then case when state = 'offered' then 'matched' when state is null then 'no offer' else 'second answer' end when 'read' then case when state = 'answered' then 'read' else 'nothing to read' end else 'ignored' end",
    f"case when s.state is not null and n.u > s.since + {us(12 * 3600)} then null else s.state end as state, s.since",
))
case("t7_fixed_window_quota", lambda t: control.fold_batch(keyed(t, F.col("user_id"), dict.fromkeys(["click", "view", "signup", "purchase", "error"], "write")), control.fixed_window_quota(48 * 3600, 3)), "log", """recursive n as (select user_id, event_id, ts, event_type, epoch_us(ts) as u, row_number() over (partition by user_id order by ts, event_id) as i from log),
    w as (select user_id, event_id, ts, i, u as start, 1 as c from n where i = 1 union all select n.user_id, n.event_id, n.ts, n.i, case when n.u >= w.start + 172800000000 then n.u else w.start end, case when n.u >= w.start + 172800000000 then 1 else w.c + 1 end from w join n on n.user_id = w.user_id and n.i = w.i + 1)
    select cast(user_id as varchar) as "key", event_id, ts, cast(user_id as varchar) as actor, 'write' as action, case when c <= 3 then 'allow' else 'deny' end as outcome from w""")  # fmt: skip

# ---- the same on streams: the log in two parts by time, the query stopped and restarted from its checkpoint between them


def streamed(t: Tables, events: DataFrame, build) -> DataFrame:
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    cut = events.agg(F.percentile_approx(F.unix_micros("ts"), 0.5)).first()[0] or 0
    early = F.unix_micros("ts") < cut
    return live.run_in_parts(t.spark, [events.where(early), events.where(~early)], build, t.folder("stream"))


def folding(step, idle_s: int):
    return lambda s: control.fold_stream(s, step, watermark="0 seconds", idle_seconds=idle_s)


def same_rows(name: str, batch: str, fn) -> None:
    """A streamed query whose rows are those of a batch one."""
    QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
    ORACLES[name] = ORACLES[batch]


DAY = 24 * 3600
same_rows("t1_stream_validate", "t1_validate_commands", lambda t: streamed(t, commands(t).withColumn("channel", F.col("channel") * 6), lambda s: control.validate_commands(s).select("event_id", "reason")))
same_rows("t2_stream_lease_gate", "t2_lease_gate", lambda t: streamed(t, keyed(t, F.col("k"), T2), folding(control.lease_gate(HOURS * 3600), 60 * DAY)))
# a bucket that has had the time to fill is forgotten: the same as a new one
same_rows("t6_stream_token_bucket", "t6_token_bucket", lambda t: streamed(t, keyed(t, F.col("user_id"), T6), folding(control.token_bucket(2, 1 / 43200), DAY)))
same_rows("t7_stream_quota", "t7_fixed_window_quota", lambda t: streamed(t, keyed(t, F.col("user_id"), dict.fromkeys(T6, "write")), folding(control.fixed_window_quota(48 * 3600, 3), 2 * DAY)))
same_rows("t8_stream_request_lifecycle", "t8_request_lifecycle", lambda t: streamed(t, keyed(t, F.col("user_id"), T8), folding(control.request_lifecycle(12 * 3600), 60 * DAY)))
same_rows("t9_stream_rendezvous", "t9_rendezvous", lambda t: streamed(t, keyed(t, F.col("k"), T9), folding(control.rendezvous(12 * 3600), DAY)))


def live_rows(t: Tables) -> DataFrame:
    return streamed(t, commands(t), lambda s: live.live_leases(s, HOURS * 3600))


same_rows("t4_stream_safety_gate", "t4_safety_gate", lambda t: live_rows(t).where("cause = 'event'").select("event_id", "allowed"))
VALID = f"{LEASED}, valid as (select * from leased where action = 'set' and channel between 1 and 512 and value between 0 and 255)"
case("t3_stream_zero_frames", lambda t: live_rows(t).where("cause = 'expired'").select("controller", "lease_no", F.col("ts").alias("expires"), "universe", "frame"), "log", f"""{VALID},
    over as (select controller, lease_no, max(ts) + interval {HOURS} hour as expires from leased group by 1, 2)
    select distinct controller, lease_no, expires, cast(universe as int) as universe, '' as frame from over join valid using (controller, lease_no) where epoch_ms(expires) < (select epoch_ms(max(ts)) from log)""")  # fmt: skip
case("t5_stream_frames", lambda t: live_rows(t).where("cause in ('set', 'end', 'blackout')").select("event_id", "lease_no", "cause", "universe", "frame"), "log", f"""{VALID},
    cleared as (select e.event_id, e.controller, e.lease_no, e.universe, e.ts, max(struct_pack(a := c.ts, b := c.event_id)) filter (where c.ts is not null) as clear from valid e left join leased c on c.controller = e.controller and c.lease_no = e.lease_no and c.action in ('end', 'blackout') and (c.ts, c.event_id) < (e.ts, e.event_id) group by all),
    cells as (select e.event_id, e.lease_no, e.universe, v.channel, arg_max(v.value, struct_pack(a := v.ts, b := v.event_id)) as value from cleared e join valid v on v.controller = e.controller and v.lease_no = e.lease_no and v.universe = e.universe
      and (v.ts, v.event_id) <= (e.ts, e.event_id) and (clear is null or struct_pack(a := v.ts, b := v.event_id) > clear) group by 1, 2, 3, 4)
    select event_id, lease_no, 'set' as cause, cast(universe as int) as universe, coalesce(string_agg(channel || ':' || value, ',' order by channel) filter (where value > 0), '') as frame from cells group by 1, 2, 4
    union all select distinct c.event_id, c.lease_no, c.action, cast(v.universe as int), '' from leased c join valid v on v.controller = c.controller and v.lease_no = c.lease_no and c.action in ('end', 'blackout') and (v.ts, v.event_id) < (c.ts, c.event_id)""")  # fmt: skip
SOURCES = {"click": "lease", "view": "lease", "signup": "request", "purchase": "request", "error": "socket"}
LIVES = {"lease": 2 * 3600, "request": 6 * 3600, "socket": 3600}


def sourced(t: Tables) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv])
    return t("log").select(F.col("user_id").alias("key"), names[F.col("event_type")].alias("source"), "ts")


case("t10_stream_idle_spans", lambda t: streamed(t, sourced(t), lambda s: live.idle_spans(s, LIVES, 12 * 3600)), "log", f"""e as (select user_id as "key", case event_type {' '.join(f"when '{k}' then '{v}'" for k, v in SOURCES.items())} end as source, epoch_us(ts) as u from log),
    s as (select key, source, u, case source {' '.join(f"when '{k}' then {v}000000" for k, v in LIVES.items())} end as life from e),
    g as (select *, case when u - lag(u) over (partition by key, source order by u) <= life then 0 else 1 end as new from s),
    busy as (select key, source, no, min(u) as a, max(u) + any_value(life) as b from (select *, sum(new) over (partition by key, source order by u) as no from g) group by 1, 2, 3),
    r as (select key, a, max(b) over (partition by key order by a, b rows between unbounded preceding and 1 preceding) as reach from busy)
    select key, make_timestamp(reach) as idle_from, make_timestamp(a) as idle_to from r where a - reach > 12 * 3600000000""")  # fmt: skip
same_rows("t11_stream_session_expiry", "t11_session_expiry", lambda t: streamed(t, sessions(t)[0], lambda s: control.session_expiry(s, sessions(t)[1], 48).select("event_id", "valid")))
