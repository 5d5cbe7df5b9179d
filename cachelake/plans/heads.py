"""Restores from an artifact listing: heads, the generations behind them, and
what their manifests name.

A bank's manifest is an artifact ``cas-manifest-<lineage>-<part>``: a part is a
range of blobs (``r0`` to ``r7``), a role's rows (``ac-<role>``) or a seed's
key/values (``kv-<gate>``).  A listing is ``id, name, expired, created_at,
head_branch, same_repo``; a table of manifests has ``artifact_id`` and the
fields of ``sources.tables.MANIFEST``, a row each.  An artifact is trusted for
the lineage that is its head branch, of the same repository; a container that a
trusted manifest names only has to be live.

Generations repeat what they inherit, so manifests of many generations list the
same segments.  Instead of ``segments`` they may have ``listing``, a key into a
table ``listings`` with a row for each segment (``listing`` and the fields of
one); only the chain's manifests meet it, so nothing grows with manifests times
segments.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cachelake.functions.expressions import owned_digits, role_of
from cachelake.operators.aggregates import union_ids
from cachelake.operators.filters import provenance_filter
from cachelake.operators.joins import fetch_plan, segments_to_fetch
from cachelake.operators.sets import recent_spills
from cachelake.plans.jobs import restore_kv, restore_rows
from cachelake.sources.storage import scratch_path
from cachelake.sources.tables import insert_or_ignore

PREFIX = "cas-manifest-"
NODE = ["start", "part", "lineage", "generation"]
NEWEST = "struct(created_at, -id)"


def trusted_manifests(artifacts: DataFrame) -> DataFrame:
    """``part, lineage, id, created_at`` of live artifacts of the repository's
    own whose name says their branch."""
    head = F.concat(F.lit(PREFIX), "head_branch", F.lit("-"))
    live = ~F.coalesce("expired", F.lit(False)) & F.coalesce("same_repo", F.lit(False)) & F.col("name").startswith(head)
    return artifacts.where(live).select(F.expr("substring(name, length(head_branch) + 15)").alias("part"), F.col("head_branch").alias("lineage"), "id", "created_at")


def newest_manifests(trusted: DataFrame, manifests: DataFrame, lineages: list[str]) -> DataFrame:
    """The newest artifact of each part of the lineages, if it has a manifest:
    an older one is never taken in its stead."""
    newest = trusted.where(F.col("lineage").isin(lineages)).groupBy("part", "lineage").agg(F.max_by(F.struct("id", "created_at"), F.expr(NEWEST)).alias("a"))
    return newest.select("part", "lineage", F.col("a.id").alias("artifact_id"), F.col("a.created_at").alias("created_at")).join(_pointers(manifests), "artifact_id")


def _pointers(manifests: DataFrame) -> DataFrame:
    return manifests.select("artifact_id", F.coalesce("generation", F.lit(0)).cast("long").alias("generation"), F.nullif("parent_lineage", F.lit("")).alias("parent_lineage"), F.coalesce("parent_generation", F.lit(0)).cast("long").alias("parent_generation"))


def manifest_chain(artifacts: DataFrame, manifests: DataFrame, lineage: str, parent: str | None = None, parts: Column | None = None, follow: bool = True) -> tuple[DataFrame, DataFrame]:
    """``chain`` and ``ends`` of all parts, or of those that ``parts`` allows.

    From the newest manifest of the lineage, and of ``parent`` if that is
    another, each generation's pointer leads to the same part's newest trusted
    manifest of ``parent_lineage`` and ``parent_generation``.  ``chain[part,
    lineage, generation, artifact_id, created_at, hop]`` has each manifest that
    is reached once, with its least distance (the parent's head is one hop
    away).  ``ends[start, part, lineage, generation, parent_lineage,
    parent_generation, reason]`` says for each walk where it ended: at a
    ``root``, because the next one is ``gone``, or at a ``cycle``.

    A round is a join of a frontier of at most one row for each part and walk
    with the generations' pointers, without their segments; there are as many
    rounds as the longest walk has hops, each a written table.
    """
    spark, path = artifacts.sparkSession, scratch_path(artifacts.sparkSession, "chain")
    trusted = trusted_manifests(artifacts)
    trusted = trusted if parts is None else trusted.where(parts)
    listed = trusted.join(_pointers(manifests).withColumnRenamed("artifact_id", "id"), "id")
    newest = listed.groupBy("part", "lineage", "generation").agg(F.max_by(F.struct("id", "created_at", "parent_lineage", "parent_generation"), F.expr(NEWEST)).alias("a"))
    newest.select("part", "lineage", "generation", F.col("a.id").alias("artifact_id"), "a.created_at", "a.parent_lineage", "a.parent_generation").write.parquet(f"{path}/generations")
    generations = spark.read.parquet(f"{path}/generations")

    lineages = [lineage] if parent is None or parent == lineage else [lineage, parent]
    own = F.col("lineage") == lineage
    begin = newest_manifests(trusted, manifests, lineages).withColumns({"start": F.when(own, "own").otherwise("parent"), "hop": F.when(own, 0).otherwise(1)})
    nothing = {c: F.lit(None).cast(kind) for c, kind in (("from_lineage", "string"), ("from_generation", "long"), ("reason", "string"))}
    columns = [*NODE, "artifact_id", "created_at", "hop", "parent_lineage", "parent_generation", *nothing]
    begin.withColumns(nothing).select(columns).write.parquet(f"{path}/walk/round=0")
    schema, rounds = spark.read.parquet(f"{path}/walk/round=0").schema, 0
    walked = lambda p: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(p)
    while follow:
        level = walked(f"{path}/walk/round={rounds}").where("reason is null")
        if level.isEmpty():
            break
        seen = walked(f"{path}/walk").where("reason is null").select(*NODE, F.lit(True).alias("seen"))
        pointed = level.select(
            "start", "part", F.col("lineage").alias("from_lineage"), F.col("generation").alias("from_generation"), (F.col("hop") + 1).alias("hop"),
            F.col("parent_lineage").alias("lineage"), F.when(F.col("parent_lineage").isNotNull(), F.col("parent_generation")).alias("generation"),
        )
        met = pointed.join(generations, ["part", "lineage", "generation"], "left").join(seen, NODE, "left")
        reason = F.when(F.col("lineage").isNull(), "root").when(F.col("artifact_id").isNull(), "gone").when(F.col("seen"), "cycle")
        rounds += 1
        met.withColumn("reason", reason).select(columns).write.parquet(f"{path}/walk/round={rounds}")
    whole = walked(f"{path}/walk")
    chain = whole.where("reason is null").groupBy("part", "lineage", "generation", "artifact_id", "created_at").agg(F.min("hop").alias("hop"))
    ends = whole.where("reason is not null").select("start", "part", F.col("from_lineage").alias("lineage"), F.col("from_generation").alias("generation"), F.col("lineage").alias("parent_lineage"), F.col("generation").alias("parent_generation"), "reason")
    return chain, ends


def listed_segments(chain: DataFrame, manifests: DataFrame, listings: DataFrame | None = None) -> DataFrame:
    """The segments that the chain's manifests list: ``part, hop, segment,
    container`` and the rest of a segment's fields.  A generation repeats what
    it inherits, so a segment may be listed by several."""
    reached = chain.select("artifact_id", "part", "hop")
    if listings is None:
        met = manifests.select("artifact_id", "segments").join(reached, "artifact_id")
        s = met.select("part", "hop", F.explode("segments").alias("s"))
    else:
        met = manifests.select("artifact_id", "listing").join(reached, "artifact_id")
        fields = [c for c in listings.columns if c != "listing"]
        s = met.join(listings, "listing").select("part", "hop", F.struct(*fields).alias("s"))
    return s.select("part", "hop", F.col("s.name").alias("segment"), F.col("s.artifact").alias("container"), "s.bytes", "s.blobs", "s.prefixes", "s.run", "s.role", F.coalesce("s.full", F.lit(False)).alias("full"))


def _once(segments: DataFrame, *more: str) -> DataFrame:
    """Each segment as its nearest manifest lists it."""
    rest = ["bytes", "prefixes", *more]
    got = segments.groupBy("segment", "container").agg(F.min_by(F.struct("hop", *rest), "hop").alias("s"))
    return got.select("segment", "container", "s.hop", *[f"s.{c}" for c in rest])


def restore_blob_bank(
    artifacts: DataFrame, manifests: DataFrame, id_lists: DataFrame, payload: DataFrame, lineage: str, parent: str | None = None, shard: int | None = None, spill_rows: DataFrame | None = None, own_known: bool = True, listings: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Blobs of an own range, and what is known of all ranges, from a listing.

    ``id_lists[artifact_id, id]`` are the lists beside the manifests,
    ``payload[segment, hash, bytes]`` what containers hold and
    ``spill_rows[spill, hash, bytes]`` spills by artifact id; spills count if
    they are trusted and newer than the own head.  ``ids`` joins the lists of
    all ranges and generations; segments come from the own range only, and the
    nearest generation's word on a segment counts.  A container that is gone
    costs its segments (``missing``), never the restore.  A shard of None has
    no range and restores ids only.

    ``own_known`` is False if the listing of the own head failed: that isn't
    an absent head, and a publish has to know (``own_state``).
    """
    chain, ends = manifest_chain(artifacts, manifests, lineage, parent, F.col("part").rlike("^r[0-7]$"))
    ids = union_ids(id_lists.join(chain.select("artifact_id"), "artifact_id", "left_semi").select("id"))
    part = f"r{shard}"
    own = chain.where((F.col("part") == part) & (F.col("lineage") == lineage) & (F.col("hop") == 0))
    if not own_known:
        chain = chain.join(own.select("artifact_id"), "artifact_id", "left_anti")
    listed = _once(listed_segments(chain.where(F.col("part") == part), manifests, listings), "full")
    wanted = segments_to_fetch(listed, "".join(owned_digits(shard)) if shard is not None else "").where("container is not null")
    live = provenance_filter(artifacts, "-")
    plan, missing = fetch_plan(wanted, live)
    fetched = wanted.join(missing.select("segment").distinct(), "segment", "left_anti")
    blobs = payload.join(fetched.select("segment").distinct(), "segment", "left_semi").groupBy("hash").agg(F.min("bytes").alias("bytes"))
    head = own.select("created_at").first()  # one row: a part has one newest artifact
    if spill_rows is not None and shard is not None:
        name = F.col("name").startswith(f"cas-spill-{lineage}-")
        spills = provenance_filter(artifacts, lineage).where(name).select(F.col("id").alias("spill"), "created_at")
        blobs = insert_or_ignore(blobs, recent_spills(spills, spill_rows, head and head["created_at"], shard).select("hash", "bytes"), ["hash"])
    found = chain.agg(
        F.count("*").alias("manifests"), F.count_if(F.col("lineage") != lineage).alias("inherited"), F.when(F.count("*") > 0, "warm").otherwise("cold").alias("status"),
        F.lit("unknown" if not own_known else "found" if head else "absent").alias("own_state"),
    )
    oldest = live.join(plan.select(F.col("artifact_id").alias("id")), "id", "left_semi").agg(F.min("created_at").alias("oldest_container"))
    return {"heads": chain, "ends": ends, "ids": ids, "plan": plan, "missing": missing, "blobs": blobs, "status": found.crossJoin(oldest)}  # one-row tables


def apply_plan(segments: DataFrame, role: Column) -> DataFrame:
    """``segment, rank, run, role, container``: nearer generations later, each
    segment with the run and role that packed it, else its manifest's."""
    role = F.coalesce("role", role)
    best = segments.groupBy("segment", "container").agg(F.max(F.struct((-F.col("hop")).alias("rank"), F.coalesce("run", F.lit(0)).alias("run"), role.alias("role"))).alias("s"))
    return best.select("segment", "s.rank", "s.run", "s.role", "container")


def restore_row_bank(artifacts: DataFrame, manifests: DataFrame, id_lists: DataFrame, payload: DataFrame, lineage: str, parent: str | None = None, role: str | None = None, listings: DataFrame | None = None) -> dict[str, DataFrame]:
    """Rows of all roles, or of one role's own history, from a listing.

    ``payload[segment, path, content_hash, exit_code]``.  A generation's rows
    are applied after those of the ones behind it, a lineage's own last; within
    one by run, and the driver's last.  With ``role`` no parent is read.  Rows
    of a container that is gone are derived anew.
    """
    chain, ends = manifest_chain(artifacts, manifests, lineage, parent if role is None else None, F.col("part").startswith("ac-") if role is None else F.col("part") == f"ac-{role}")
    banked = union_ids(id_lists.join(chain.select("artifact_id"), "artifact_id", "left_semi").select("id"))
    planned = apply_plan(listed_segments(chain, manifests, listings).where("container is not null"), role_of(F.concat(F.lit("-"), "part")))
    containers = provenance_filter(artifacts, "-").select(F.col("name").alias("container")).distinct()
    plan, missing = planned.join(containers, "container", "left_semi"), planned.join(containers, "container", "left_anti")
    return {"heads": chain, "ends": ends, "ids": banked, "plan": plan, "missing": missing, "rows": restore_rows(payload, plan.drop("container"))}


def restore_kv_bank(existing: DataFrame, artifacts: DataFrame, manifests: DataFrame, payload: DataFrame, lineage: str, seed: str, parent: str | None = None, listings: DataFrame | None = None) -> DataFrame:
    """A seed's key/values from a listing, all or nothing.

    Only heads count: the own one, or where there is none the parent's, which
    the seed in its name makes as valid.  One container that is gone leaves
    ``existing`` as it is.
    """
    gate = hashlib.sha256(seed.encode()).hexdigest()[:8]
    chain, _ = manifest_chain(artifacts, manifests, lineage, parent, F.col("part") == f"kv-{gate}", follow=False)
    segments = _once(listed_segments(chain, manifests, listings)).select((1 - F.col("hop")).alias("lineage_rank"), F.lit(gate).alias("gate"), "segment", F.coalesce("container", F.lit("")).alias("container"), "bytes")
    path = scratch_path(artifacts.sparkSession, "kv-segments")
    segments.write.parquet(path)  # read four times
    return restore_kv(existing, artifacts.sparkSession.read.schema(segments.schema).parquet(path), payload, provenance_filter(artifacts, "-"), seed)
