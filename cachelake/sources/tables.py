"""Scans, readers and sinks of the cache's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelake.sources.storage import children, path_exists, remove, rename

MANIFEST_SEGMENTS = 10_000

SEGMENT = "struct<name:string,bytes:bigint,blobs:bigint,prefixes:string,artifact:string,run:bigint,role:string,`full`:boolean>"
MANIFEST = f"version int, lineage string, generation bigint, parent_lineage string, parent_generation bigint, created_by_run bigint, segments array<{SEGMENT}>"
ARTIFACT = "id bigint, name string, expired boolean, created_at string, workflow_run struct<head_branch:string,head_repository_id:bigint,repository_id:bigint>"


def content_index(blobs: DataFrame) -> DataFrame:
    """One row per distinct content of ``blobs[path, content]``: ``hash, path,
    bytes``, in hash order.  Content is hashed where it is read; only digests
    are shuffled."""
    seen = blobs.select(F.sha2("content", 256).alias("hash"), "path", F.octet_length("content").cast("long").alias("bytes"))
    return seen.groupBy("hash").agg(F.min("path").alias("path"), F.min("bytes").alias("bytes")).orderBy("hash")


def row_index(flat: DataFrame, canonical: DataFrame) -> DataFrame:
    """``path, content_hash, bytes`` over both layouts, in path order.  Names
    are stable and contents change, so the content's hash is the version."""
    both = flat.select("path", "content").unionByName(canonical.select("path", "content"))
    return both.select("path", F.sha2("content", 256).alias("content_hash"), F.octet_length("content").cast("long").alias("bytes")).orderBy("path", "content_hash")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per segment of each JSON manifest; missing scalars get their
    defaults, a manifest without segments keeps one row."""
    raw = spark.read.schema(MANIFEST).option("encoding", "UTF-8").json(path)
    return flatten_manifests(raw)


def flatten_manifests(raw: DataFrame) -> DataFrame:
    kept = raw.select(
        F.coalesce("version", F.lit(1)).alias("version"), F.coalesce("lineage", F.lit("")).alias("lineage"), F.coalesce("generation", F.lit(0)).cast("long").alias("generation"),
        F.coalesce("parent_lineage", F.lit("")).alias("parent_lineage"), F.coalesce("parent_generation", F.lit(0)).cast("long").alias("parent_generation"),
        F.coalesce("created_by_run", F.lit(0)).cast("long").alias("created_by_run"), F.explode_outer("segments").alias("s"),
    )
    return kept.select(
        "version", "lineage", "generation", "parent_lineage", "parent_generation", "created_by_run",
        F.col("s.name").alias("segment"), F.col("s.bytes").alias("bytes"), F.col("s.blobs").alias("blobs"), F.col("s.prefixes").alias("prefixes"),
        F.col("s.artifact").alias("artifact"), F.col("s.run").alias("run"), F.col("s.role").alias("role"), F.coalesce(F.col("s.full"), F.lit(False)).alias("full"),
    )


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id per line; a list that isn't there is a cold bank, not an error."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "id string")
    return spark.read.text(path).where("value <> ''").select(F.col("value").alias("id"))


def _kv_fields(lines: DataFrame) -> DataFrame:
    part = F.split("value", " ", 4)
    value = F.get(part, 3)
    fields = lines.select(
        "value", F.get(part, 0).try_cast("smallint").alias("shard"), F.get(part, 1).try_cast("bigint").alias("key_hi"), F.get(part, 2).try_cast("bigint").alias("key_lo"), value.alias("hex"),
        *[F.get(part, i).rlike("^[+-]?[0-9]+$").alias(f"int{i}") for i in range(3)],
    )
    good = F.col("int0") & F.col("int1") & F.col("int2") & F.col("shard").between(0, 255) & F.col("key_hi").isNotNull() & F.col("key_lo").isNotNull() & F.col("hex").rlike("^([0-9A-Fa-f]{2})*$")
    return fields.withColumn("good", F.coalesce(good, F.lit(False)))


def read_kv_export(lines: DataFrame) -> DataFrame:
    """Well-formed ``shard hi lo hex`` lines as typed rows.  An empty value is
    legal; keys stay 64-bit integers."""
    return _kv_fields(lines).where("good").select("shard", "key_hi", "key_lo", F.unhex("hex").alias("value"))


def rejected_kv_lines(lines: DataFrame) -> DataFrame:
    """The lines that ``read_kv_export`` leaves out."""
    return _kv_fields(lines).where("not good").select("value")


def read_artifact_listing(spark: SparkSession, path: str) -> DataFrame:
    return flatten_artifacts(spark.read.schema(ARTIFACT).json(path))


def flatten_artifacts(raw: DataFrame) -> DataFrame:
    """Nested artifact rows as flat ones; ``same_repo`` needs both ids."""
    run = F.col("workflow_run")
    same = F.coalesce(run["head_repository_id"] == run["repository_id"], F.lit(False))
    return raw.select("id", "name", F.coalesce("expired", F.lit(False)).alias("expired"), "created_at", run["head_branch"].alias("head_branch"), same.alias("same_repo"))


def parse_build_log(lines: DataFrame) -> DataFrame:
    """Typed events of log lines, of a batch or a stream; other lines go."""
    v = F.col("value")
    job = r"\[driver\] job (\d+) (speculated )?-> worker (\S+) \(([^)]*)\)"
    done = r"\[action\] (ok|FAIL)\s+(.*?)(?: exit=(?:Some\()?(-?\d+|None)\)?)? \(([0-9.]+)s\)$"
    start = r"\[action\] start (.*) \(staged in ([0-9.]+)s\)$"
    stats = r"\[stats\] (.*)$"
    pick = lambda rule, i: F.nullif(F.regexp_extract(v, rule, i), F.lit(""))
    kind = (
        F.when(v.rlike(job), F.when(F.regexp_extract(v, job, 2) == "", "dispatch").otherwise("speculate"))
        .when(v.rlike(start), "start")
        .when(v.rlike(done), F.when(F.regexp_extract(v, done, 1) == "ok", "ok").otherwise("fail"))
        .when(v.rlike(stats), "stats")
    )
    action = F.when(v.rlike(job), pick(job, 4)).when(v.rlike(start), pick(start, 1)).when(v.rlike(done), pick(done, 2))
    secs = F.when(v.rlike(start), pick(start, 2)).when(v.rlike(done), pick(done, 4)).try_cast("double")
    counters = F.when(v.rlike(stats), F.array_join(F.regexp_extract_all(F.regexp_extract(v, stats, 1), F.lit(r"(\w+=[0-9.]+)"), 1), " "))
    rows = lines.select(
        kind.alias("kind"), pick(job, 1).try_cast("bigint").alias("job"), pick(job, 3).alias("worker"), action.alias("action"), secs.alias("secs"),
        F.when(v.rlike(done), pick(done, 3)).try_cast("int").alias("exit_code"), counters.alias("counters"),
    )
    return rows.where("kind is not null")


def write_generation(segments: DataFrame, rows: DataFrame, path: str, manifest: DataFrame) -> str:
    """Write a generation, payload first and manifest last; the payload's path.

    ``rows`` carry ``segment`` and ``prefix``.  Each attempt writes a payload
    and a draft of the manifest that names it, both under names of its own; the
    generation is there once a draft has been renamed to ``manifest``.  A crash
    before that leaves drafts that nobody reads, and a repetition (a retried
    batch) writes new ones.  A generation that is there stays as it is: a
    repetition returns its payload and writes nothing.

    The manifest has a line for each ``MANIFEST_SEGMENTS`` segments, with the
    same head.
    """
    spark, attempt = rows.sparkSession, uuid.uuid4().hex
    if (payload := committed_payload(spark, path)) is not None:
        return payload
    rows.write.partitionBy("prefix", "segment").parquet(f"{path}/payload-{attempt}")
    lines = max(1, -(-segments.count() // MANIFEST_SEGMENTS))
    listed = segments.groupBy(F.pmod(F.xxhash64("name"), F.lit(lines)).alias("_line")).agg(F.array_sort(F.collect_list(F.struct(*segments.columns))).alias("segments"))
    head = manifest.withColumn("payload", F.lit(f"payload-{attempt}"))
    if segments.isEmpty():
        listed = head.select(F.array().cast(listed.schema["segments"].dataType).alias("segments"))
    head.crossJoin(listed.select("segments")).write.json(f"{path}/draft-{attempt}")  # the head is one row
    if not rename(spark, f"{path}/draft-{attempt}", f"{path}/manifest") and committed_payload(spark, path) is None:
        raise OSError(f"{path}: the manifest can't be put in place")
    return committed_payload(spark, path)


def committed_payload(spark: SparkSession, path: str) -> str | None:
    """The payload that a generation's manifest names; None without one."""
    if not path_exists(spark, f"{path}/manifest/_SUCCESS"):
        return None
    named = spark.read.schema("payload string").json(f"{path}/manifest").first()
    return f"{path}/{(named and named.payload) or 'payload'}"


def read_generation(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A generation's rows; none if it isn't (or isn't yet) there."""
    payload, none = committed_payload(spark, path), spark.createDataFrame([], schema)
    if payload is None or not any(n.startswith("prefix=") for n in children(spark, payload)):
        return none
    return spark.read.schema(none.schema).parquet(payload).select(none.columns)


def clean_generation(spark: SparkSession, path: str) -> list[str]:
    """Remove the drafts that failed attempts at a generation left, once it is
    there; their names."""
    payload = committed_payload(spark, path)
    left = [] if payload is None else [n for n in children(spark, path) if n.startswith(("payload-", "draft-")) and f"{path}/{n}" != payload]
    for name in left:
        remove(spark, f"{path}/{name}")
    return left


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Add rows whose key isn't there yet; an existing key wins.  Rows are
    content-addressed, so which of an incoming key's repeats stays is moot:
    the smallest does."""
    rest = [c for c in incoming.columns if c not in keys]
    once = incoming.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]) if rest else incoming.distinct()
    new = once.join(existing.select(*keys).distinct(), keys, "left_anti")
    return existing.unionByName(new)


def upsert_last(base: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in a total order over base and updates."""
    both = base.unionByName(updates)
    rest = [c for c in both.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
