"""Composite jobs: restore and publish of the three banks, and the report.

Each is a composition of the operators; only one-row decisions are read by the
driver.  ``lookup_state`` is ``found``, ``absent`` or ``unknown``: an unknown
own head must never lead to a manifest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelake.functions.expressions import generation_gate, owned_digits
from cachelake.operators import aggregates as agg
from cachelake.operators.filters import provenance_filter, purge_failures, verify_digests
from cachelake.operators.joins import delta_by_id, delta_by_key, delta_by_version, fetch_plan, segments_to_fetch
from cachelake.operators.sets import recent_spills, split_range
from cachelake.operators.windows import apply_order, collapse_versions, newest_per_name, pack_greedy, pack_until_full, prefix_length_of
from cachelake.sources.storage import scratch_path
from cachelake.sources.tables import insert_or_ignore, write_generation


def heads_of(artifacts: DataFrame, lineage: str, parent: str | None, prefix: str | None = None) -> DataFrame:
    """The newest trusted artifacts of a lineage (rank 1) and its parent (0)."""
    own = newest_per_name(provenance_filter(artifacts, lineage), prefix).withColumn("rank", F.lit(1))
    if parent is None:
        return own
    return own.unionByName(newest_per_name(provenance_filter(artifacts, parent), prefix).withColumn("rank", F.lit(0)))


def restore_blobs(segments: DataFrame, payload: DataFrame, artifacts: DataFrame, lineage: str, parent: str, shard: int, spills: DataFrame, spill_rows: DataFrame, cutoff: object = None) -> dict[str, DataFrame]:
    """``blobs``, ``ids``, ``plan``, ``missing`` and a one-row ``status``.

    ``segments[lineage, segment, prefixes, bytes, container]`` are those that
    the heads of the lineage and its parent list.
    """
    listed = segments.where(F.col("lineage").isin(lineage, parent))
    ids = agg.union_ids(payload.join(listed.select("segment").distinct(), "segment", "left_semi").select(F.col("hash").alias("id")))
    wanted = segments_to_fetch(listed, "".join(owned_digits(shard)))
    plan, missing = fetch_plan(wanted, artifacts)
    live = wanted.join(missing.select("segment").distinct(), "segment", "left_anti")
    got = payload.join(live.select("segment").distinct(), "segment", "left_semi").groupBy("hash").agg(F.min("bytes").alias("bytes"))
    absorbed = recent_spills(spills, spill_rows, cutoff, shard).select("hash", "bytes")
    blobs = insert_or_ignore(got, absorbed, ["hash"])
    status = blobs.agg(F.when(F.count("*") > 0, "warm").otherwise("cold").alias("status"), F.count("*").alias("blobs"))
    return {"blobs": blobs, "ids": ids, "plan": plan, "missing": missing, "status": status}


def _packs_fully(heads: DataFrame, evidence: DataFrame, lineage: str, now: int, cfg: agg.CompactCfg, held: DataFrame, own: DataFrame, distinct: bool = True) -> bool:
    """Whether the policy asks for a full pack of the ids ``own`` and that
    wouldn't shed any of those ``held``."""
    verdict = agg.compaction_policy(heads, evidence, now, cfg).where(F.col("lineage") == lineage).first()  # one row
    if verdict is None or verdict["reason"] == "none":
        return False
    name = F.lit(lineage).alias("lineage")
    shed = agg.shed_guard(held.select(name, "id"), own.select(name, "id"), distinct).first()  # one row
    return not (shed and shed["would_shed"])


def publish_blobs(index: DataFrame, heads: DataFrame, banked: DataFrame, evidence: DataFrame, lineage: str, shard: int, cap: int, now: int, lookup_state: str = "found", cfg: agg.CompactCfg = agg.CompactCfg()) -> dict[str, DataFrame]:
    """``packed`` rows with their segment, ``segments``, and ``spill``.

    A full pack replaces the own range if the policy asks for it and it
    wouldn't shed ids; else only the delta is packed.  The complement spills,
    and all does while the own state is unknown.
    """
    known = lookup_state != "unknown"
    own_ids = split_range(index, shard).where("dest = 'bank'").select(F.col("hash").alias("id"))
    full = lookup_state == "found" and _packs_fully(heads, evidence, lineage, now, cfg, banked, own_ids)
    new = split_range(index if full else delta_by_id(index, banked), shard, known)
    bank = new.where("dest = 'bank'").select(F.col("hash").alias("id"), F.col("bytes").alias("size"))
    packed = pack_greedy(bank, cap, prefix_length_of(bank)).withColumnRenamed("size", "bytes")
    segments = agg.segment_meta(packed, ["prefix", "segment_no"]).withColumn("full", F.lit(full))
    spill = delta_by_id(index, banked).join(bank.select(F.col("id").alias("hash")), "hash", "left_anti")
    return {"packed": packed, "segments": segments, "spill": spill}


def restore_rows(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of all heads in total order, without failures.  ``rows`` may carry
    ``exit_code``, which a content decides and so its winning row tells."""
    final = apply_order(rows.select("path", "content_hash", "segment", "exit_code"), plan, ("exit_code",))
    return purge_failures(final).select("path", "content_hash", "source", "exit_code")


def publish_rows(
    rows: DataFrame, banked: DataFrame, run: int, role: str, cap: int, lookup_state: str = "found", heads: DataFrame | None = None, evidence: DataFrame | None = None, lineage: str = "", now: int = 0, cfg: agg.CompactCfg = agg.ROW_BANK
) -> dict[str, DataFrame]:
    """New row versions packed and stamped, and the collapsed id list.

    With the bank's ``heads`` and their ``evidence``, a full pack of all rows
    replaces it if the policy asks for that and it wouldn't shed lines.
    Nothing is staged while the own state is unknown.  A content hash has no
    space, so distinct pairs have distinct lines.
    """
    ok = purge_failures(rows)
    line = F.concat("path", F.lit(" "), "content_hash").alias("id")
    full = heads is not None and evidence is not None and lookup_state == "found" and _packs_fully(heads, evidence, lineage, now, cfg, banked.select(line), ok.select(line), distinct=False)
    new = ok if full else delta_by_version(ok, banked)
    if lookup_state == "unknown":
        new = new.where(F.lit(False))
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "new-rows")
    new = new.select("path", "content_hash", "bytes").distinct()
    new.write.parquet(path)  # read for its number, to pack it and for the id list
    new = spark.read.schema(new.schema).parquet(path)
    items = new.select(line, F.col("bytes").alias("size"))
    packed = pack_greedy(items.withColumn("id", F.concat(F.substring(F.md5("id"), 1, 4), F.lit("|"), "id")), cap, prefix_length_of(items, longest=4)).withColumnRenamed("size", "bytes")
    stamped = agg.segment_meta(packed, ["prefix", "segment_no"]).withColumns({"run": F.lit(run), "role": F.lit(role), "full": F.lit(full)})
    listed = new.select("path", F.col("content_hash").alias("hash"), F.lit(1).alias("seq"))
    if not full:
        listed = listed.unionByName(banked.select("path", F.col("content_hash").alias("hash"), F.lit(0).alias("seq")))
    return {"packed": packed, "segments": stamped, "ids": collapse_versions(listed, ["seq", "hash"])}


def restore_kv(existing: DataFrame, segments: DataFrame, payload: DataFrame, artifacts: DataFrame, seed: str) -> DataFrame:
    """Merge a seed's key/value rows, all or nothing.

    ``segments[lineage_rank, gate, segment, container, bytes]``: the own bank
    (rank 1) is taken, the parent's (0) only where there is no own one.
    """
    gated = segments.where(F.col("gate") == generation_gate(F.lit(seed)))
    top = gated.agg(F.max("lineage_rank").alias("_top"))  # one row
    chosen = gated.join(F.broadcast(top), F.col("lineage_rank") == F.col("_top")).drop("_top")
    plan, _ = fetch_plan(chosen.select("segment", "container", "bytes"), artifacts, strict=True)
    ready = chosen.join(plan.select("container").distinct(), "container", "left_semi").select("segment").distinct()
    return insert_or_ignore(existing, payload.join(ready, "segment", "left_semi").select(*existing.columns), ["key_hi", "key_lo"])


def publish_kv(kv: DataFrame, banked: DataFrame, cap: int) -> DataFrame:
    """New key/value rows with their segment, packed per shard."""
    new = delta_by_key(kv, banked).withColumn("id", F.concat_ws(" ", "key_hi", "key_lo"))
    line = F.concat_ws(" ", "shard", "key_hi", "key_lo", F.hex("value"))
    return pack_until_full(new.withColumn("size", (F.length(line) + 1).cast("long")), cap, "shard")


def kv_bank(packed: DataFrame) -> dict[str, DataFrame]:
    """What ``publish_kv`` packed, with its segments, as ``publish_generation``
    writes it."""
    rows = packed.withColumnRenamed("size", "bytes")
    return {"packed": rows, "segments": agg.segment_meta(rows, ["prefix", "segment_no"]).withColumn("full", F.lit(False))}


def restore_all(blobs: dict[str, DataFrame], rows: DataFrame, contents: DataFrame) -> DataFrame:
    """One row: blobs and rows restored, how many contents verify, and whether
    either bank is warm."""
    checked = verify_digests(contents).agg(F.count_if("ok").alias("verified"), F.count_if(~F.col("ok")).alias("rejected"))
    counts = blobs["status"].select(F.col("blobs").alias("blobs")).crossJoin(rows.agg(F.count("*").alias("rows"))).crossJoin(checked)  # one-row tables
    return counts.withColumn("warm", (F.col("blobs") > 0) | (F.col("rows") > 0))


def publish_all(blobs: dict[str, DataFrame], rows: dict[str, DataFrame]) -> DataFrame:
    """All new segments of both banks, with their bank."""
    columns = ["bank", "name", "blobs", "bytes", "prefixes", "full"]
    a = blobs["segments"].withColumn("bank", F.lit("cas")).select(*columns)
    return a.unionByName(rows["segments"].withColumn("bank", F.lit("ac")).select(*columns))


def publish_generation(published: dict[str, DataFrame], path: str, lineage: str, generation: int) -> str:
    """Write a published bank: payload, then manifest."""
    named = published["packed"].join(published["segments"].select("prefix", "segment_no", F.col("name").alias("segment")), ["prefix", "segment_no"])
    rows = named.select("id", "bytes", "prefix", "segment")
    segments = published["segments"].select("name", "bytes", "blobs", "prefixes", "full")
    manifest = segments.sparkSession.range(1).select(F.lit(1).alias("version"), F.lit(lineage).alias("lineage"), F.lit(generation).alias("generation"))
    return write_generation(segments, rows, path, manifest)


def _metrics(df: DataFrame, names: list[str], suffix: list[str]) -> DataFrame:
    """``metric, value`` of number columns, a metric being ``name:suffix…``."""
    parts = [F.struct(F.concat_ws(":", F.lit(n), *[F.col(s).cast("string") for s in suffix]).alias("metric"), F.col(n).cast("long").alias("value")) for n in names]
    return df.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def lap_report(lookups: DataFrame, seeded: int, events: DataFrame, jobs: DataFrame | None = None, fetches: DataFrame | None = None, moved: DataFrame | None = None) -> DataFrame:
    """``metric, value``: hit counts, the tripwire, dispatches, latency; with
    ``jobs`` the queue by platform, with ``fetches`` their sources by worker,
    with ``moved`` (of ``off_node_bytes``) what locality saved."""
    report = agg.cache_report(lookups, seeded)
    names = ["hits", "misses", "unservable", "bytes", "hit_ok", "hit_failed"]
    stack = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("long").alias("value")) for n in names], F.struct(F.lit("tripwire").alias("metric"), F.col("tripwire").cast("long").alias("value")))
    one = report.select(F.explode(stack).alias("x")).select("x.*")
    parts = [
        _metrics(agg.dispatch_counts(events), ["jobs"], ["worker"]),
        _metrics(agg.latency_summary(lookups.select("verdict", "us")), ["n", "p50", "p90", "p99", "max"], ["verdict"]),
    ]
    if jobs is not None:
        parts.append(_metrics(agg.queue_summary(jobs), ["queued", "oldest_s", "starved"], ["os", "arch"]))
    if fetches is not None:
        parts.append(_metrics(agg.fetch_sources(fetches).withColumnRenamed("n", "fetches"), ["fetches"], ["worker", "source"]))
    if moved is not None:
        parts.append(_metrics(moved, ["moved", "total", "baseline", "regressed"], []))
    return reduce(DataFrame.unionByName, parts, one)
