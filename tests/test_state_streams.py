"""Stateful streams: the same rows however a stream is cut, bounded state."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cachelake.streaming import state as ss
from cachelake.streaming import streams as sm

START = datetime(2026, 1, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def at(s):
    return START + timedelta(seconds=s)


def run(spark, build, inputs, tmp_path, name):
    """Write each stream's batches as files that are read one at a time, in
    turn, and return all rows and the state's rows at the end."""
    frames = []
    for k, (schema, batches) in enumerate(inputs):
        path = f"{tmp_path}/{name}-{k}"
        for n, batch in enumerate(batches):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{path}/{n:03d}")
        read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
        frames.append(read.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "60 seconds"))
    rows = []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        query = build(*frames).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}-c").trigger(availableNow=True).foreachBatch(lambda df, n: rows.extend(tuple(r) for r in df.collect())).start()
        query.awaitTermination()
        state = sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"])
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return rows, state


def cuts(rng, rows, n, late=30):
    """Rows by arrival: up to ``late`` seconds out of order, in ``n`` batches."""
    arrived = sorted(rows, key=lambda r: (r[1] - START).total_seconds() + rng.random() * late)
    step = -(-len(arrived) // n)
    return [arrived[i : i + step] for i in range(0, len(arrived), step)]


def memo_by_hand(rows, ttl):
    """Lookups, rewrites and departures ``(action, ts, seq, kind, verdict)``."""
    servable, refused, out = set(), {}, []
    for action, ts, seq, kind, verdict in sorted(rows, key=lambda r: (r[1], r[2])):
        if kind == "departure":
            servable.clear()
        elif kind == "rewrite":
            servable.discard(action)
            refused.pop(action, None)
        elif action in servable:
            out.append((action, ts, seq, "HIT", True))
        elif verdict == "MISS":
            out.append((action, ts, seq, "MISS", False))
        elif action in refused and ts < refused[action]:
            out.append((action, ts, seq, "UNSERVABLE", True))
        else:
            if verdict == "HIT":
                servable.add(action)
            else:
                refused[action] = ts + timedelta(seconds=ttl)
            out.append((action, ts, seq, verdict, False))
    return out


LOOKUPS, DEPARTURES = "action long, ts timestamp_ntz, seq long, kind string, verdict string", "ts timestamp_ntz, seq long"
END = [(None, at(10_000), -1)]


def memo(spark, tmp_path, rows, name, n, rng, ttl=120):
    asked = [r for r in rows if r[3] != "departure"]
    left = [(r[0], r[1], r[2]) for r in rows if r[3] == "departure"]
    last = [(0, at(10_000), -1, "lookup", "MISS")]
    inputs = [(LOOKUPS, [*cuts(rng, asked, n), last]), (DEPARTURES, [[r[1:] for r in b] for b in [*cuts(rng, left, n), END]])]
    got, state = run(spark, lambda a, b: ss.verdict_memo(a, b, ttl, 4), inputs, tmp_path, name)
    return sorted(r for r in got if r[2] >= 0), state


def test_memoized_verdicts(spark, tmp_path):
    """A servable verdict outlives its blob until a departure; an unservable
    one outlives the blob's return until a rewrite or its time."""
    a = 7
    rows = [
        (a, at(0), 1, "lookup", "HIT"), (a, at(1), 2, "lookup", "UNSERVABLE"), (None, at(2), 3, "departure", None), (a, at(3), 4, "lookup", "UNSERVABLE"), (a, at(4), 5, "lookup", "HIT"),
        (a, at(5), 6, "rewrite", None), (a, at(6), 7, "lookup", "HIT"), (8, at(3), 8, "lookup", "UNSERVABLE"), (8, at(122), 9, "lookup", "HIT"), (8, at(123), 10, "lookup", "HIT"), (8, at(300), 11, "lookup", "UNSERVABLE"), (9, at(1), 12, "lookup", "MISS"),
    ]
    got, _ = memo(spark, tmp_path, rows, "memo", 1, random.Random(1))
    assert [r[3:] for r in got if r[0] == a] == [("HIT", False), ("HIT", True), ("UNSERVABLE", False), ("UNSERVABLE", True), ("HIT", False)]
    assert [r[3:] for r in got if r[0] == 8] == [("UNSERVABLE", False), ("UNSERVABLE", True), ("HIT", False), ("HIT", True)]
    assert [r[3:] for r in got if r[0] == 9] == [("MISS", False)]


@pytest.mark.parametrize("n", [1, 4])
def test_memos_however_the_streams_are_cut(spark, tmp_path, n):
    rng = random.Random(n)
    kinds = ["lookup"] * 16 + ["rewrite", "departure"]
    rows = [(rng.randrange(6), at(rng.randrange(900)), i, rng.choice(kinds), rng.choice(["HIT", "UNSERVABLE", "MISS"])) for i in range(200)]
    got, _ = memo(spark, tmp_path, rows, f"cut{n}", n, rng, ttl=60)
    want = sorted(memo_by_hand(rows, 60))
    assert got == want and {r[3] for r in want if r[4]} == {"HIT", "UNSERVABLE"}


EVENTS = "job long, ts timestamp_ntz, ends boolean"


@pytest.mark.parametrize("n", [1, 5])
def test_stragglers_however_the_stream_is_cut(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(rng.randrange(12), at(rng.randrange(600)), rng.random() < 0.6) for _ in range(150)] + [(50, at(5), False), (50, at(15), True), (51, at(5), False), (51, at(16), True), (52, at(5), False), (52, at(5), True)]
    last = [(99, at(5000), True)]
    got, state = run(spark, lambda e: ss.straggler_stream(e, 10), [(EVENTS, [*cuts(rng, rows, n), last])], tmp_path, f"late{n}")
    want = {tuple(r) for r in ss.stragglers_within(spark.createDataFrame(rows, EVENTS), 10).collect()}
    assert len(got) == len(set(got)) and set(got) == want
    assert {j for j, _ in got if j >= 50} == {51, 52}
    assert state <= 3  # the last row, and its timer


def test_acknowledgements_come_out_once_with_none_as_a_result(spark, tmp_path):
    signals = [(1, at(0)), (2, at(10)), (3, at(20))]
    acks = [(1, at(5), 0), (1, at(6), 1), (1, at(7), 1), (1, at(180), 2), (1, at(181), 3), (2, at(9), 4), (3, at(25), 7)]
    s, a = "signal long, ts timestamp_ntz", "signal long, ts timestamp_ntz, shard int"
    inputs = [(s, [signals[:2], signals[2:], [(9, at(9000))]]), (a, [acks[:3], acks[3:], [(9, at(9000), 1)]])]
    got, _ = run(spark, lambda x, y: ss.ack_stream(x, y, 180), inputs, tmp_path, "acks")
    batch = sm.acks_by_deadline(spark.createDataFrame(signals, s), spark.createDataFrame(acks, a), 180)
    assert sorted((r[0], r[2]) for r in got) == sorted(tuple(r) for r in batch.collect()) == [(1, 3), (2, 0), (3, 1)]


JOINS = "fleet string, ts timestamp_ntz, event long, worker long"


@pytest.mark.parametrize("n", [1, 4])
def test_latch_and_what_it_keeps(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(rng.choice("ab"), at(rng.randrange(900)), i, rng.randrange(30)) for i in range(300)] + [("few", at(i), 1000 + i, i % 2) for i in range(20)]
    last = [("end", at(9000), -1, 0)]
    got, state = run(spark, lambda j: ss.latch_stream(j, 12), [(JOINS, [*cuts(rng, rows, n), last])], tmp_path, f"latch{n}")
    want = {(r.event, r.formed) for r in sm.quorum_latch(spark.createDataFrame(rows, JOINS), 12).collect()}
    assert len(got) == len(rows) and {(e, f) for _, e, f in got} == want and {f for _, f in want} == {True, False}
    assert state <= 2 + 2 + 2 + 2  # a flag each of two fleets, two workers of the third, what waits of the last


SUMMARIES = "peer long, ts timestamp_ntz, seq long, holdings string, leaves boolean"


@pytest.mark.parametrize("n", [1, 3])
def test_holdings_of_peers_that_left_are_forgotten(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(rng.randrange(8), at(rng.randrange(300)), i, f"h{i}", False) for i in range(60)]
    rows += [(p, at(400), 100 + p, None, True) for p in range(5)] + [(2, at(500), 200, "back", False), (7, at(100), 1, "a", False), (7, at(100), 1, "b", False)]
    last = [(99, at(9000), -1, "end", False)]
    frames = [*cuts(rng, rows, n), last]
    path = f"{tmp_path}/in"
    for k, batch in enumerate(frames):
        spark.createDataFrame(batch, SUMMARIES).coalesce(1).write.parquet(f"{path}/{k:03d}")
    read = spark.readStream.schema(SUMMARIES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    got, last_batch = {}, []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = sm.latest_holdings(read.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "60 seconds"))
        query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(lambda df, k: got.update({r.peer: r.holdings for r in df.collect()})).start()
        query.awaitTermination()
        last_batch = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = {r.peer: r.holdings for r in sm.latest_holdings_batch(spark.createDataFrame(rows, SUMMARIES).where("not (peer = 7 and holdings = 'a')")).collect()}
    assert {p: h for p, h in got.items() if p != 99} == want and want[0] is None and want[2] == "back"
    assert last_batch <= 1 + sum(h is not None for h in want.values())


def test_stragglers_wait_with_one_timer(spark, tmp_path):
    rows = [(1, at(i), False) for i in range(300)]
    got, state = run(spark, lambda e: ss.straggler_stream(e, 10_000), [(EVENTS, [rows])], tmp_path, "timers")
    assert got == [] and state <= 2


class Handle:
    """State of one key in dictionaries."""

    def __init__(self):
        self.written = 0

    def getMapState(self, name, *_):
        handle, held = self, {}

        class State:
            def updateValue(self, key, value):
                handle.written += 1
                held[key] = value

            def keys(self):
                return iter(list(held))

        return State()

    def getValueState(self, *_):
        return type("State", (), {"get": lambda s: None, "exists": lambda s: False})()

    def registerTimer(self, ms):
        pass


@pytest.mark.parametrize("make", [lambda: ss._Latch(2), lambda: ss._VerdictMemo(60)])
def test_arriving_rows_are_kept_block_by_block(make):
    import pandas as pd

    processor, handle = make(), Handle()
    processor.block_rows = 10
    processor.init(handle)

    def frames():
        for i in range(10):
            assert handle.written >= i  # all rows before are in state, none is held
            yield pd.DataFrame({"ts": [at(i)] * 10, "event": range(10), "worker": range(10), "seq": range(10), "action": range(10), "kind": "lookup", "verdict": "HIT"})

    list(processor.handleInputRows(("k",), frames(), None))
    assert handle.written == 10


def test_refused_verdicts_of_many_keys_over_batches(spark, tmp_path):
    """In two batches; the watermark after the first has passed some verdicts' ends."""
    rng, ttl = random.Random(5), 120
    rows = [(rng.choice([None, 0, 2**60 + 1, *range(40)]), at(rng.randrange(3000)), n, rng.choice(["lookup"] * 7 + ["rewrite"]), rng.choice(["HIT", "MISS", "UNSERVABLE"]), 0) for n in range(900)]
    rows = [(a, t, n, k, v, int(t > at(1500))) for a, t, n, k, v, _ in sorted(rows, key=lambda r: (r[1], r[2]))]
    want, held = [], {}
    for action, ts, _, kind, verdict, epoch in rows:
        until, of = held.get(action, (START, None))
        reused = kind == "lookup" and ts < until and epoch == of
        if kind == "rewrite":
            held.pop(action, None)
        elif verdict == "UNSERVABLE" and not reused:
            held[action] = ts + timedelta(seconds=ttl), epoch
        if kind == "lookup":
            want.append((str(action), ts, "UNSERVABLE" if reused else verdict, reused))
    schema = "action long, ts timestamp, seq long, kind string, verdict string, epoch long"
    for n in range(2):
        some = [rng.sample(part, len(part)) for part in (rows[:500], rows[500:])][n]
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n:03d}")
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in").withWatermark("ts", "60 seconds")
    got = sm.drain(sm.negative_ttl(read, ttl, 2), spark, f"{tmp_path}/out", "update")
    assert sorted((str(r.action), r.ts, r.verdict, r.reused) for r in got.collect()) == sorted(want)
    assert any(w[3] for w in want)
    left = spark.read.format("statestore").option("stateVarName", "refused").load(f"{tmp_path}/out/checkpoint").count()
    assert left <= 2  # a row for each bucket
