"""Queries of stateful streams, each against SQL on what the watermark closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelake.catalog import Tables, _events_dir, query
from cachelake.sources.storage import scratch_path
from cachelake.streaming import state as ss
from cachelake.streaming import streams as sm

SECOND = "interval '1 second'"


def _two(t: Tables, first: str, second: str) -> tuple[DataFrame, DataFrame]:
    """Two streams of the events, with a watermark each."""
    path = _events_dir(t)
    return tuple(sm.as_stream(t.spark, path, t.events.schema, "1 hour").where(rule) for rule in (first, second))


def _closed(t: Tables, got: DataFrame, slack: str, *rules: str) -> DataFrame:
    """Rows whose ``ts`` the slowest stream's watermark passed by ``slack``."""
    ends = [F.max(F.when(F.expr(r), F.col("ts"))) for r in rules]
    last = t.events.agg((F.least(*ends) if len(ends) > 1 else ends[0]).cast("timestamp").alias("_w"))
    return got.crossJoin(F.broadcast(last)).where(f"ts <= _w - interval 1 hour - {slack}").drop("_w")  # one row


def _w(*rules: str) -> str:
    ends = ", ".join(f"max(ts) filter (where {r})" for r in rules)
    return f"(select least({ends}) - interval '1 hour' from events)"


LOOKUPS, DEPARTURES = "event_id % 97 <> 0", "event_id % 97 = 0"
KIND = "case when event_id % 20 = 0 then 'rewrite' else 'lookup' end kind"
FOUND = "case event_id % 5 when 0 then 'MISS' when 1 then 'UNSERVABLE' when 2 then 'UNSERVABLE' else 'HIT' end verdict"
MEMO_SQL = f"""with recursive e as (select *, count(*) filter (where {DEPARTURES}) over (order by ts, event_id) epoch from events),
    o as (select user_id as action, ts, event_id seq, {KIND}, {FOUND}, epoch, row_number() over (partition by user_id order by ts, event_id) rn from e where {LOOKUPS}),
    walk as (select action, rn, ts, seq, kind, verdict, false reused, case when kind = 'lookup' and verdict = 'HIT' then epoch end s, case when kind = 'lookup' and verdict = 'UNSERVABLE' then ts + interval '7200 seconds' end u from o where rn = 1
      union all select o.action, o.rn, o.ts, o.seq, o.kind,
        case when o.kind = 'lookup' and coalesce(w.s = o.epoch, false) then 'HIT' when o.verdict = 'MISS' then 'MISS' when coalesce(o.ts < w.u, false) then 'UNSERVABLE' else o.verdict end,
        o.kind = 'lookup' and (coalesce(w.s = o.epoch, false) or o.verdict <> 'MISS' and coalesce(o.ts < w.u, false)),
        case when o.kind = 'rewrite' then null when coalesce(w.s = o.epoch, false) or o.verdict <> 'HIT' or coalesce(o.ts < w.u, false) then w.s else o.epoch end,
        case when o.kind = 'rewrite' then null when coalesce(w.s = o.epoch, false) or o.verdict <> 'UNSERVABLE' or coalesce(o.ts < w.u, false) then w.u else o.ts + interval '7200 seconds' end
      from walk w join o on o.action = w.action and o.rn = w.rn + 1)
    select action, ts, seq, verdict, reused from walk where kind = 'lookup' and ts <= {_w(LOOKUPS, DEPARTURES)} - {SECOND}"""


@query("verdict_memo", MEMO_SQL)
def _(t: Tables) -> DataFrame:
    asked, left = _two(t, LOOKUPS, DEPARTURES)
    got = ss.verdict_memo(asked.selectExpr("user_id action", "ts", "event_id seq", KIND, FOUND), left.selectExpr("ts", "event_id seq"), 7200, 8)
    out = sm.drain(got, t.spark, scratch_path(t.spark, "memo"))
    return _closed(t, out, "interval 1 second", LOOKUPS, DEPARTURES).select("action", F.col("ts").cast("timestamp_ntz").alias("ts"), "seq", "verdict", "reused")


STARTS = "event_type in ('click', 'view', 'signup')"
ENDS = "not event_type in ('click', 'view', 'signup')"


@query("straggler_stream", f"select distinct user_id job, ts from events s where {STARTS} and not exists (select 1 from events e where e.user_id = s.user_id and {ENDS.replace('event_type', 'e.event_type')} and e.ts > s.ts and e.ts <= s.ts + interval '7200 seconds') and ts <= {_w('true')} - interval '7201 seconds'")
def _(t: Tables) -> DataFrame:
    events = sm.as_stream(t.spark, _events_dir(t), t.events.schema, "1 hour").selectExpr("user_id job", "ts", f"{ENDS} ends")
    out = sm.drain(ss.straggler_stream(events, 7200), t.spark, scratch_path(t.spark, "stragglers"))
    return _closed(t, out, "interval 7201 seconds", "true").select("job", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("stragglers_within", f"select distinct user_id job, ts from events s where {STARTS} and not exists (select 1 from events e where e.user_id = s.user_id and {ENDS.replace('event_type', 'e.event_type')} and e.ts > s.ts and e.ts <= s.ts + interval '7200 seconds')")
def _(t: Tables) -> DataFrame:
    return ss.stragglers_within(t.events.selectExpr("user_id job", "ts", f"{ENDS} ends"), 7200)


SIGNALS, ACKS = "event_id % 10 = 3", "event_id % 10 <> 3"


# An event is acknowledged by the views of its user; a signal is a user's tenth event.
@query("ack_stream", f"select s.user_id as signal, s.ts, count(distinct a.event_id % 8) shards from (select distinct user_id, ts from events where {SIGNALS}) s left join events a on a.user_id = s.user_id and a.event_type = 'view' and a.{ACKS} and a.ts between s.ts and s.ts + interval '86400 seconds' where s.ts <= {_w(SIGNALS, ACKS)} - interval '86401 seconds' group by 1, 2")
def _(t: Tables) -> DataFrame:
    signals, acks = _two(t, SIGNALS, ACKS)
    got = ss.ack_stream(signals.selectExpr("user_id signal", "ts"), acks.where("event_type = 'view'").selectExpr("user_id signal", "ts", "event_id % 8 shard"), 86400)
    out = sm.drain(got, t.spark, scratch_path(t.spark, "acks"))
    return _closed(t, out, "interval 86401 seconds", SIGNALS, ACKS).select("signal", F.col("ts").cast("timestamp_ntz").alias("ts"), "shards")


@query("latch_stream", f"select event_id as event, sum(new) over (partition by event_type order by ts, event_id) >= 20 formed from (select *, case when row_number() over (partition by event_type, user_id order by ts, event_id) = 1 then 1 else 0 end new from events) qualify ts <= {_w('true')} - {SECOND}")
def _(t: Tables) -> DataFrame:
    joins = sm.as_stream(t.spark, _events_dir(t), t.events.schema, "1 hour").selectExpr("event_type fleet", "ts", "event_id event", "user_id worker")
    out = sm.drain(ss.latch_stream(joins, 20), t.spark, scratch_path(t.spark, "latch"))
    return _closed(t, out.join(t.events.selectExpr("event_id event", "cast(ts as timestamp) ts"), "event"), "interval 1 second", "true").select("event", "formed")
