"""Generations that survive crashes and repetitions."""

import pytest
from pyspark.sql import functions as F

from cachelake.sources import storage, tables
from cachelake.sources.tables import clean_generation, committed_payload, read_generation, read_manifests, write_generation
from cachelake.streaming.streams import incremental_publish

ROWS = "id string, bytes long"


def parts(spark, ids):
    rows = spark.createDataFrame([(i, len(i), i[:1], f"s{i[:1]}") for i in ids], f"{ROWS}, prefix string, segment string")
    segments = rows.groupBy(F.col("segment").alias("name")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("blobs"))
    return segments, rows, spark.range(1).selectExpr("1 version", "'main' lineage", "7L generation")


def read(spark, path):
    return sorted(r.id for r in read_generation(spark, path, ROWS).collect())


def write(spark, path, ids):
    segments, rows, head = parts(spark, ids)
    return write_generation(segments, rows, path, head)


class Crash(Exception):
    pass


@pytest.mark.parametrize("at", ["payload", "draft", "after"])
def test_a_crash_and_a_rerun_end_in_one_generation(spark, tmp_path, monkeypatch, at):
    path = f"file://{tmp_path}/gen-1"

    def crash(*a):
        raise Crash

    with monkeypatch.context() as m:
        if at == "payload":
            m.setattr(tables, "rename", crash)
            m.setattr(tables, "MANIFEST_SEGMENTS", 0)  # fails before the draft
        elif at == "draft":
            m.setattr(tables, "rename", crash)
        else:
            m.setattr(tables, "rename", lambda *a: storage.rename(*a) and crash())
        with pytest.raises((Crash, ZeroDivisionError)):
            write(spark, path, ["a1", "b2"])
    assert read(spark, path) == (["a1", "b2"] if at == "after" else [])
    first = write(spark, path, ["a1", "b2"])
    assert read(spark, path) == ["a1", "b2"] and write(spark, path, ["a1", "b2"]) == first == committed_payload(spark, path)
    assert len(clean_generation(spark, path)) == {"payload": 1, "draft": 2, "after": 0}[at] and read(spark, path) == ["a1", "b2"]
    assert sorted(storage.children(spark, path)) == ["manifest", first.rpartition("/")[2]]


def test_an_attempt_that_comes_too_late_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/gen-2"
    real = storage.rename

    def other_first(*a):
        with monkeypatch.context() as m:
            m.setattr(tables, "rename", real)
            write(spark, path, ["a1"])
        return real(*a)

    with monkeypatch.context() as m:
        m.setattr(tables, "rename", other_first)
        assert write(spark, path, ["zz"]) == committed_payload(spark, path)
    assert read(spark, path) == ["a1"] and len(clean_generation(spark, path)) == 2


def test_manifests_of_many_and_of_no_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "MANIFEST_SEGMENTS", 3)
    ids = [f"{d}{i}" for d in "0123456789" for i in range(2)]
    write(spark, f"file://{tmp_path}/many", ids)
    listed = read_manifests(spark, f"file://{tmp_path}/many/manifest")
    assert listed.count() == 10 and {tuple(r) for r in listed.select("lineage", "generation", "blobs").collect()} == {("main", 7, 2)}
    write(spark, f"file://{tmp_path}/none", [])
    assert read(spark, f"file://{tmp_path}/none") == [] and read_manifests(spark, f"file://{tmp_path}/none/manifest").count() == 1
    assert read(spark, f"file://{tmp_path}/nothing") == [] and clean_generation(spark, f"file://{tmp_path}/nothing") == []


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_repeated_batch_ends_in_one_generation(spark, tmp_path, when):
    """A batch that dies before or after its commit is repeated by the next run."""
    base = f"file://{tmp_path}"
    spark.createDataFrame([("a1",), ("b2",)], "id string").write.parquet(f"{base}/in")
    tries = []

    def publish(batch, number):
        tries.append(number)
        ids = [r.id for r in batch.collect()]
        if len(tries) == 1 and when == "before":
            segments, rows, _ = parts(batch.sparkSession, ids)
            rows.write.partitionBy("prefix", "segment").parquet(f"{base}/gen-{number}/payload-died")
            raise Crash
        write(batch.sparkSession, f"{base}/gen-{number}", ids)
        if len(tries) == 1:
            raise Crash

    stream = lambda: spark.readStream.schema("id string").parquet(f"{base}/in")
    with pytest.raises(Exception, match="Crash"):
        incremental_publish(stream(), publish, base)
    incremental_publish(stream(), publish, base)
    assert tries == [0, 0] and read(spark, f"{base}/gen-0") == ["a1", "b2"]
    assert [n for n in storage.children(spark, base) if n.startswith("gen-")] == ["gen-0"]
