"""Operators with state of their own, in event time.

Rows wait in state until the watermark has passed them and are then taken in
event-time order, whatever batches they came in; so results don't depend on how
a stream is cut, and equal the batch twins on all that the watermark has closed.
Rows later than the watermark are dropped by Spark.  Every stream that goes in
has a watermark on ``ts``; of several the slowest one counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _ms(ts: object) -> int:
    """The first whole millisecond at or after a time: timers have no finer."""
    return -(-pd.Timestamp(ts).value // 1_000_000)


def _all_ms(ts: pd.Series) -> np.ndarray:
    return -(-ts.astype("datetime64[us]").astype("int64").to_numpy() // 1000)


class InOrder(StatefulProcessor):
    """Keeps a key's rows until the watermark has passed them, and hands them
    over in the order of ``ts`` and ``order``.

    They wait packed, by slots of time, so what is in memory is a block of
    arriving rows or one slot's."""

    schema: str
    order: list[str]
    slot_ms = 6 * 3600 * 1000
    block_rows = 1 << 18

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.columns = [c.split()[0] for c in self.schema.split(", ")]
        self.waiting = handle.getMapState("waiting", "slot long, part long", "rows binary")

    def keep(self, frames: Iterator[pd.DataFrame]) -> None:
        block, n, least = [], 0, None
        part = began = 1 + max((p for _, p in self.waiting.keys()), default=-1)

        def write() -> None:
            nonlocal part, least
            rows = pd.concat(block)
            ms = _all_ms(rows["ts"])
            least = int(ms.min()) if least is None else min(least, int(ms.min()))
            for slot, some in rows.groupby(ms // self.slot_ms):
                self.waiting.updateValue((int(slot), part), (_packed(some),))
            part += 1

        for frame in frames:
            if len(frame):
                block.append(frame[self.columns])
                n += len(frame)
            if n >= self.block_rows:
                write()
                block, n = [], 0
        if n:
            write()
        if part != began:
            self.handle.registerTimer(least)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.keep(rows)
        return iter([])

    def slots(self) -> dict[int, list[int]]:
        found: dict[int, list[int]] = {}
        for slot, part in self.waiting.keys():
            found.setdefault(slot, []).append(part)
        return dict(sorted(found.items()))

    def take(self, slot: int, parts: list[int]) -> pd.DataFrame:
        rows = pd.concat([_unpacked(self.waiting.getValue((slot, p))[0]) for p in parts])
        for p in parts:
            self.waiting.removeKey((slot, p))
        return rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, last, rest = timerValues.getCurrentWatermarkInMs(), None, None
        slots = self.slots()
        for slot, parts in slots.items():
            if slot * self.slot_ms > now:
                break
            rows = self.take(slot, parts)
            passed = _all_ms(rows["ts"]) <= now
            rest = rows[~passed] if not passed.all() else rest
            if passed.any():
                some = rows[passed].sort_values(["ts", *self.order])
                last = some["ts"].iloc[-1]
                out = self.step(key, some)
                if out is not None and len(out):
                    yield out
        if rest is not None:
            self.keep([rest])
        else:
            later = [s for s in slots if s * self.slot_ms > now]
            if later:  # no sooner than the slot begins
                self.handle.registerTimer(later[0] * self.slot_ms)
        if last is not None:
            self.after(last)

    def step(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame | None:
        raise NotImplementedError

    def after(self, last: pd.Timestamp) -> None:
        """All rows up to ``last`` were taken."""

    def close(self) -> None:
        pass


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(rows).read_pandas()


# ------------------------------------------------------------ verdict memos


class _VerdictMemo(InOrder):
    """Both memos of a bucket's actions, and the number of departures so far."""

    schema = "ts timestamp, seq long, action long, kind string, verdict string"
    order = ["seq"]

    def __init__(self, ttl_s: int):
        self.ttl = pd.Timedelta(seconds=ttl_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.epoch = handle.getValueState("epoch", "n long")
        self.left = False
        self.held: dict[int, tuple | None] = {}
        self.changed: set[int] = set()
        self.memos = handle.getMapState("memos", "action long", "servable long, until timestamp")

    def step(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame | None:
        epoch = began = self.epoch.get()[0] if self.epoch.exists() else 0
        held, out = self.held, []
        for ts, seq, action, kind, verdict in rows.itertuples(index=False, name=None):
            if kind == "departure":
                epoch += 1
                continue
            action = int(action)
            if action not in held:
                held[action] = tuple(self.memos.getValue((action,))) if self.memos.containsKey((action,)) else None
            servable, until = held[action] or (None, None)
            if kind == "rewrite":
                new, reused = None, False
            elif servable is not None and int(servable) == epoch:
                verdict, new, reused = "HIT", held[action], True
            elif verdict == "MISS":
                new, reused = held[action], False
            elif until is not None and ts < pd.Timestamp(until):
                verdict, new, reused = "UNSERVABLE", held[action], True
            else:
                new = (epoch, until) if verdict == "HIT" else (servable, (ts + self.ttl).to_pydatetime())
                reused = False
            if kind == "lookup":
                out.append((action, ts, int(seq), verdict, reused))
            if new != held[action]:
                held[action] = new
                self.changed.add(action)
        if epoch != began:
            self.epoch.update((epoch,))
            self.left = True
        return pd.DataFrame(out, columns=["action", "ts", "seq", "verdict", "reused"]) if out else None

    def after(self, last: pd.Timestamp) -> None:
        """Memos are read and written once for all slots; what no departure
        left valid goes."""
        for action in self.changed:
            if self.held[action] is None:
                self.memos.removeKey((action,))
            else:
                self.memos.updateValue((action,), self.held[action])
        self.held, self.changed = {}, set()
        if not self.left:
            return
        self.left, (epoch,) = False, self.epoch.get()
        for (action,), (servable, until) in list(self.memos.iterator()):
            if (servable is None or servable != epoch) and (until is None or pd.Timestamp(until) <= last):
                self.memos.removeKey((action,))


def verdict_memo(lookups: DataFrame, departures: DataFrame, ttl_s: int = 120, buckets: int = 256) -> DataFrame:
    """``lookups[action, ts, seq, kind, verdict]`` with the verdicts that both
    memos give: ``action, ts, seq, verdict, reused``.

    A ``HIT`` is reused until any peer departs (``departures[ts, seq]``: it may
    have been the only holder), an ``UNSERVABLE`` for ``ttl_s`` from when it was
    found; a row of kind ``rewrite`` makes both of its action's memos obsolete.
    A ``MISS`` is never kept, and neither is hidden by a kept ``UNSERVABLE``.
    At one time ``seq`` decides; it is unique over both streams.

    State is per key and a departure concerns all of them, so actions are dealt
    to ``buckets`` and each bucket gets a copy of every departure, which are few.
    It counts them as epochs: a memo of an earlier one isn't valid any more.
    ``buckets`` bounds how many tasks can share the work and can't be changed
    for a running stream.
    """
    bucket = F.pmod(F.xxhash64("action"), F.lit(buckets)).cast("int")
    asked = lookups.select(bucket.alias("bucket"), "ts", "seq", "action", "kind", "verdict")
    left = departures.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "ts", "seq", F.lit(None).cast("long").alias("action"), F.lit("departure").alias("kind"), F.lit(None).cast("string").alias("verdict"))
    return asked.unionByName(left).groupBy("bucket").transformWithStateInPandas(_VerdictMemo(ttl_s), "action long, ts timestamp, seq long, verdict string, reused boolean", "Append", "EventTime")


# ------------------------------------------------------------ stragglers


class _Stragglers(StatefulProcessor):
    """The open starts of a bucket's jobs and the ends that may yet count, as
    columns; one timer, for the earliest deadline."""

    def __init__(self, least_s: int):
        self.least = pd.Timedelta(seconds=least_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "named binary, job binary, ts binary, ends binary")

    def load(self) -> list[pd.DataFrame]:
        held = self.known.get()
        if held is None:
            return []
        kinds = (bool, np.int64, np.int64, bool)
        named, job, ts, ends = (np.frombuffer(v, k) for v, k in zip(held, kinds, strict=True))
        return [pd.DataFrame({"named": named, "job": job, "ts": ts.view("datetime64[us]"), "ends": ends})]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [pd.DataFrame({"named": r["job"].notna(), "job": r["job"].fillna(0).astype("int64"), "ts": r["ts"].astype("datetime64[us]"), "ends": r["ends"].astype(bool)}) for r in rows]
        known = pd.concat([*self.load(), *new]).drop_duplicates().sort_values("ts")
        starts, ends = known[~known["ends"]], known[known["ends"]]
        after = pd.merge_asof(starts, ends.assign(end=ends["ts"]).drop(columns="ends"), on="ts", by=["named", "job"], direction="forward", allow_exact_matches=False)
        cut = (after["end"] <= after["ts"] + self.least).to_numpy()
        self.hold(starts[~cut], ends, timerValues)
        return iter([])

    def hold(self, starts: pd.DataFrame, ends: pd.DataFrame, timerValues) -> None:
        """An end counts for starts before it: once the watermark has passed
        it, all of these are known."""
        ends = ends[_all_ms(ends["ts"]) > timerValues.getCurrentWatermarkInMs()]
        both = pd.concat([starts, ends])
        if len(both):
            self.known.update(tuple(both[c].to_numpy().astype(k).tobytes() for c, k in (("named", bool), ("job", np.int64), ("ts", "datetime64[us]"), ("ends", bool))))
            self.handle.registerTimer(int(min([*_all_ms(starts["ts"] + self.least), *_all_ms(ends["ts"])])))  # an end's is to forget it
        else:
            self.known.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for known in self.load():
            starts = known[~known["ends"]]
            late = _all_ms(starts["ts"] + self.least) <= timerValues.getCurrentWatermarkInMs()
            self.hold(starts[~late], known[known["ends"]], timerValues)
            if late.any():
                some = starts[late]
                yield pd.DataFrame({"job": some["job"].astype("Int64").where(some["named"]), "ts": some["ts"]})

    def close(self) -> None:
        pass


def straggler_stream(events: DataFrame, least_s: int = 10, buckets: int = 256) -> DataFrame:
    """``job, ts`` of starts that nothing ended within ``least_s``.

    ``events[job, ts, ends]`` has the starts of jobs that aren't bound to a
    worker and, with ``ends``, what ends a wait: a finish, a race or a start
    anew.  A start that an end in time cuts is forgotten at once; others come
    out once the watermark has passed ``least_s`` after them.  Jobs are dealt
    to ``buckets``, which can't be changed for a running stream."""
    bucket = F.pmod(F.xxhash64("job"), F.lit(buckets)).cast("int").alias("bucket")
    return events.select(bucket, "job", "ts", "ends").groupBy("bucket").transformWithStateInPandas(_Stragglers(least_s), "job long, ts timestamp", "Append", "EventTime")


def stragglers_within(events: DataFrame, least_s: int = 10) -> DataFrame:
    """The batch twin of ``straggler_stream``."""
    ends = events.where("ends").select(F.col("job").alias("_job"), F.col("ts").alias("_ts"))
    met = F.expr(f"job = _job and _ts > ts and _ts <= ts + interval {least_s} seconds")
    return events.where("not ends").select("job", "ts").distinct().join(ends, met, "left_anti")


# ------------------------------------------------------------ acknowledgements


def ack_stream(signals: DataFrame, acks: DataFrame, limit_s: int = 180) -> DataFrame:
    """``signal, ts, shards``: how many shards acknowledged each signal in
    time; none is a result too.

    A time-bounded outer join and, on its output, an aggregate in event time:
    a signal comes out once, when the watermark has passed its deadline.
    ``signals[signal, ts]``, ``acks[signal, ts, shard]``; a shard's repeated
    acks count once."""
    a = acks.select(F.col("signal").alias("_signal"), F.col("ts").alias("_ts"), "shard")
    met = signals.select("signal", "ts").join(a, F.expr(f"signal = _signal and _ts >= ts and _ts <= ts + interval {limit_s} seconds"), "left_outer")
    return met.groupBy("signal", "ts").agg(F.size(F.collect_set("shard")).cast("long").alias("shards"))


# ------------------------------------------------------------ the latch


class _Latch(InOrder):
    """The workers of a fleet that hasn't formed; one value once it has."""

    schema = "ts timestamp, event long, worker long"
    order = ["event"]

    def __init__(self, min_workers: int):
        self.min_workers = max(min_workers, 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.formed = handle.getValueState("formed", "formed boolean")
        self.workers = handle.getMapState("workers", "worker long", "joined boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.formed.exists():
            self.keep(rows)
        else:  # the watermark has passed what formed it, so all that comes is later
            for new in rows:
                yield self.said(key, new["event"], True)

    def said(self, key: tuple, events: pd.Series, formed: object) -> pd.DataFrame:
        return pd.DataFrame({"fleet": [key[0]] * len(events), "event": events.astype("int64").values, "formed": formed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        if self.formed.exists():
            for slot, parts in self.slots().items():
                rest = self.take(slot, parts)
                yield self.said(key, rest["event"], True)

    def step(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame | None:
        if self.formed.exists():
            return self.said(key, rows["event"], True)
        known = {w for (w,) in self.workers.keys()}
        first = rows["worker"].drop_duplicates()
        new = first[~first.isin(known)].iloc[: self.min_workers - len(known)]
        for worker in new.tolist():
            self.workers.updateValue((int(worker),), (True,))
        if len(known) + len(new) < self.min_workers:
            return self.said(key, rows["event"], False)
        self.formed.update((True,))
        self.workers.clear()
        at = int(np.flatnonzero((rows["worker"] == new.iloc[-1]).to_numpy())[0])
        return self.said(key, rows["event"], np.arange(len(rows)) >= at)


def latch_stream(joins: DataFrame, min_workers: int) -> DataFrame:
    """``fleet, event, formed``: ``quorum_latch`` of a stream of ``joins[fleet,
    ts, event, worker]``.  At most ``min_workers`` workers and what the
    watermark hasn't passed are kept of a fleet; once it has formed, one flag,
    and its rows pass through."""
    return joins.select("fleet", "ts", "event", "worker").groupBy("fleet").transformWithStateInPandas(_Latch(min_workers), "fleet string, event long, formed boolean", "Append", "EventTime")
