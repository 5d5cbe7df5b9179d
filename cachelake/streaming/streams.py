"""Timed behaviour on event-time streams, with batch twins.

Streams take a watermark ``delay``: rows later than that are dropped, and in
append mode windows still open at the end aren't emitted.  ``ts`` has to be a
TIMESTAMP (``as_stream`` casts).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def as_stream(spark: SparkSession, path: str, schema: object, delay: str, ts: str = "ts") -> DataFrame:
    """A parquet folder or file as a stream with a watermark on ``ts``."""
    raw = spark.readStream.schema(schema).parquet(path)
    return raw.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


# ------------------------------------------------------------ built-in windows


def minute_stats(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Counters per window and kind; the same for a batch and a stream."""
    got = events.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("us").alias("us"))
    return got.select(F.col("w.start").alias("minute"), "kind", "n", "us")


def liveness(events: DataFrame, timeout: str = "90 seconds") -> DataFrame:
    """``peer, joined, gone, beats``: stretches of traffic that a silence of
    ``timeout`` ends."""
    got = events.groupBy(F.session_window("ts", timeout).alias("w"), "peer").agg(F.count("*").alias("beats"))
    return got.select("peer", F.col("w.start").alias("joined"), F.col("w.end").alias("gone"), "beats")


def liveness_batch(events: DataFrame, timeout_s: int = 90) -> DataFrame:
    """The batch twin: a gap of ``timeout_s`` or more starts a new stretch."""
    order = Window.partitionBy("peer").orderBy("ts")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp"))
    new = F.coalesce(gap >= F.lit(timeout_s * 1_000_000), F.lit(True)).cast("int")
    part = events.withColumn("_new", new).withColumn("_s", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    got = part.groupBy("peer", "_s").agg(F.min("ts").alias("joined"), F.max("ts").alias("last"), F.count("*").alias("beats"))
    return got.select("peer", "joined", (F.col("last") + F.expr(f"interval {timeout_s} seconds")).alias("gone"), "beats")


def first_result_stream(completions: DataFrame) -> DataFrame:
    """The first completion of each job within the watermark."""
    return completions.dropDuplicatesWithinWatermark(["job"])


# ------------------------------------------------------------ joins in time


def starvation_alerts(submitted: DataFrame, dispatched: DataFrame, now: object, limit_s: int = 120) -> DataFrame:
    """Jobs submitted over ``limit_s`` before ``now`` and never dispatched."""
    waiting = submitted.join(dispatched.select("job").distinct(), "job", "left_anti")
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return waiting.withColumn("age_s", age).where(F.col("age_s") > limit_s)


def starvation_stream(submitted: DataFrame, dispatched: DataFrame, limit_s: int = 120) -> DataFrame:
    """The stream: submissions without a dispatch within ``limit_s``, emitted
    when the watermark has passed."""
    d = dispatched.select(F.col("job").alias("_job"), F.col("ts").alias("_ts"))
    met = submitted.join(d, F.expr(f"job = _job and _ts >= ts and _ts <= ts + interval {limit_s} seconds"), "left_outer")
    return met.where("_job is null").drop("_job", "_ts")


def stragglers(started: DataFrame, finished: DataFrame, raced: DataFrame, now: object, least_s: int = 10) -> DataFrame:
    """Jobs running for ``least_s`` or more that aren't finished, raced yet or
    bound to a worker."""
    open_ = started.where("affinity is null").join(finished.select("job").distinct(), "job", "left_anti").join(raced.select("job").distinct(), "job", "left_anti")
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return open_.withColumn("age_s", age).where(F.col("age_s") >= least_s)


def acks_by_deadline(signals: DataFrame, acks: DataFrame, limit_s: int = 180) -> DataFrame:
    """``signal, shards``: shards that acknowledged in time; few is a result."""
    a = acks.select("signal", F.col("ts").alias("_ts"), "shard")
    met = signals.join(a, "signal", "left").withColumn("_in", F.expr(f"_ts between ts and ts + interval {limit_s} seconds"))
    return met.groupBy("signal").agg(F.count_distinct(F.when(F.col("_in"), F.col("shard"))).alias("shards"))


def quorum_latch(joins: DataFrame, min_workers: int) -> DataFrame:
    """``joins[fleet, ts, event, worker]`` with ``formed``: once enough distinct
    workers have joined a fleet, it stays formed.

    That is from the first join of the ``min_workers``-th worker on, so only
    that many rows of a fleet have to be ordered."""
    at = F.struct("ts", "event")
    first = joins.groupBy(F.col("fleet").alias("_fleet"), "worker").agg(F.min(at).alias("_at"))
    n = F.row_number().over(Window.partitionBy("_fleet").orderBy("_at"))
    formed = first.withColumn("_n", n).where(F.col("_n") <= max(min_workers, 1)).where(F.col("_n") == max(min_workers, 1)).select("_fleet", "_at")
    met = joins.join(formed, F.col("fleet").eqNullSafe(F.col("_fleet")), "left")
    return met.select(*joins.columns, F.coalesce(at >= F.col("_at"), F.lit(False)).alias("formed"))


# ------------------------------------------------------------ keyed state


class _LatestHoldings(StatefulProcessor):
    """The newest summary of a peer, until it has left for good."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "ts timestamp, seq long, holdings string, leaves boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        new = new.assign(holdings=new["holdings"].fillna("")).sort_values(["ts", "seq", "holdings"]).iloc[-1]
        stamp, leaves = (pd.Timestamp(new["ts"]).to_pydatetime(), int(new["seq"])), bool(new["leaves"])
        held = self.latest.get() if self.latest.exists() else None
        if held is not None and (*stamp, new["holdings"]) <= (held[0], held[1], held[2] or ""):
            return
        self.latest.update((*stamp, new["holdings"], leaves))
        if leaves:
            self.handle.registerTimer(int(pd.Timestamp(stamp[0]).timestamp() * 1000) + 1)
        yield pd.DataFrame({"peer": [key[0]], "ts": [stamp[0]], "seq": [stamp[1]], "holdings": [None if leaves else new["holdings"]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed a leave: what is older can't come any more,
        so nothing has to be remembered unless the peer is back."""
        if self.latest.exists():
            ts, _, _, leaves = self.latest.get()
            if leaves and pd.Timestamp(ts).timestamp() * 1000 < expiredTimerInfo.getExpiryTimeInMs():
                self.latest.clear()
        return iter([])

    def close(self) -> None:
        pass


def latest_holdings(summaries: DataFrame) -> DataFrame:
    """``summaries[peer, ts, seq, holdings, leaves]`` as a stream of updates:
    each peer's newest holdings, null once it has left.

    ``summaries`` has a watermark on ``ts``; a peer that left is forgotten once
    that has passed.  At one time and ``seq`` the larger holdings count."""
    return summaries.groupBy("peer").transformWithStateInPandas(_LatestHoldings(), "peer long, ts timestamp, seq long, holdings string", "Update", "EventTime")


def latest_holdings_batch(summaries: DataFrame) -> DataFrame:
    order = Window.partitionBy("peer").orderBy(F.desc("ts"), F.desc("seq"))
    got = summaries.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return got.select("peer", "ts", "seq", F.when(~F.col("leaves"), F.col("holdings")).alias("holdings"))


class _NegativeTtl(StatefulProcessor):
    """Reuses the unservable verdicts of a bucket's keys for a while; they are
    kept as columns, with one timer for the earliest end."""

    kinds = {"named": "bool", "action": "int64", "until": "int64", "epoch": "int64"}

    def __init__(self, ttl_s: int):
        self.ttl = ttl_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.refused = handle.getValueState("refused", ", ".join(f"{c} binary" for c in self.kinds))

    def load(self) -> dict[tuple[bool, int], tuple[int, int]]:
        held = self.refused.get()
        if held is None:
            return {}
        named, action, until, epoch = (np.frombuffer(v, k).tolist() for v, k in zip(held, self.kinds.values(), strict=True))
        return dict(zip(zip(named, action, strict=True), zip(until, epoch, strict=True), strict=True))

    def hold(self, held: dict[tuple[bool, int], tuple[int, int]]) -> None:
        if not held:
            self.refused.clear()
            return
        rows = [(*key, *value) for key, value in held.items()]
        self.refused.update(tuple(np.array(c, k).tobytes() for c, k in zip(zip(*rows, strict=True), self.kinds.values(), strict=True)))
        self.handle.registerTimer(min(until for until, _ in held.values()) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # A key's rows may come in several frames, in any order.
        rows = pd.concat(rows).sort_values(["named", "action", "ts", "seq"])
        held, last, reused = self.load(), None, []
        columns = (
            zip(rows["named"].tolist(), rows["action"].tolist(), strict=True),
            rows["ts"].astype("datetime64[us]").astype("int64").tolist(),
            rows["epoch"].astype("int64").tolist(),
            *(c.tolist() for c in (rows["kind"] == "lookup", rows["kind"] == "rewrite", rows["verdict"] == "UNSERVABLE")),
        )
        for own, ts, epoch, lookup, rewrite, refused in zip(*columns, strict=True):
            if own != last:
                last, now = own, held.get(own)
            again = lookup and now is not None and ts < now[0] and epoch == now[1]
            reused.append(again)
            if rewrite:
                now = None
                held.pop(own, None)
            elif refused and not again:
                now = held[own] = (ts + self.ttl, epoch)
        self.hold(held)
        out = rows[["named", "action", "ts", "verdict"]].assign(reused=reused)
        out["verdict"] = out["verdict"].mask(out["reused"], "UNSERVABLE")
        out = out[(rows["kind"] == "lookup").to_numpy()]
        if len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Forget the verdicts that the watermark has passed."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self.hold({key: value for key, value in self.load().items() if value[0] > now})
        return iter([])

    def close(self) -> None:
        pass


def negative_ttl(lookups: DataFrame, ttl_s: int = 120, buckets: int = 256) -> DataFrame:
    """``lookups[action, ts, seq, kind, verdict, epoch]``: an unservable
    verdict is reused for ``ttl_s``, cleared early by a rewrite of its key or
    a new ``epoch`` (which a leaving peer starts).

    ``lookups`` has a watermark on ``ts``; once that passes a verdict's end,
    its state goes.  Actions are dealt to ``buckets``, which can't be changed for
    a running stream.  A bucket's rows of one micro-batch are put in order
    together, so bound micro-batches at the source."""
    bucket = F.pmod(F.xxhash64("action"), F.lit(buckets)).cast("int").alias("bucket")
    rows = lookups.select(bucket, F.col("action").isNotNull().alias("named"), F.coalesce("action", F.lit(0)).cast("long").alias("action"), "ts", "seq", "kind", "verdict", "epoch")
    got = rows.groupBy("bucket").transformWithStateInPandas(_NegativeTtl(ttl_s), "named boolean, action long, ts timestamp, verdict string, reused boolean", "Update", "EventTime")
    return got.select(F.when(F.col("named"), F.col("action")).alias("action"), "ts", "verdict", "reused")


# ------------------------------------------------------------ running


def drain(stream: DataFrame, spark: SparkSession, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return what it wrote."""
    state = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        if state is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", state)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/out")


def incremental_publish(blobs: DataFrame, publish, path: str) -> None:
    """Publish each arriving batch as a delta generation.

    The batch number should name the generation: a batch that is repeated after
    a crash then finds its own, or only drafts of it
    (``sources.tables.write_generation``)."""
    query = blobs.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(lambda batch, number: publish(batch, number)).start()
    query.awaitTermination()
