"""Presence, verdicts, routing and canonical matches as joins.

``held`` tables are made distinct before they meet anything.  Which side is
broadcast is left to the optimizer, which knows the sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cachelake.functions.expressions import EMPTY_HASH, bloom_positions, normalize_token
from cachelake.operators.filters import in_range


def find_missing(requested: DataFrame, held: DataFrame) -> DataFrame:
    """Requested digests that aren't held, by hash and size; repeats stay.
    The empty digest is always held."""
    asked = requested.where(~((F.col("hash").cast("string") == EMPTY_HASH) & (F.col("size") == 0)))
    return asked.join(held.select("hash", "size").distinct(), ["hash", "size"], "left_anti")


def presence_vector(batch: DataFrame, held: DataFrame) -> DataFrame:
    """``id, have``: for each request batch, which of its digests are held, in
    request order."""
    known = held.select("hash", "size").distinct().withColumn("have", F.lit(True))
    empty = (F.col("hash").cast("string") == EMPTY_HASH) & (F.col("size") == 0)
    got = batch.join(known, ["hash", "size"], "left").withColumn("have", F.coalesce("have", empty, F.lit(False)))
    listed = got.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "have"))).alias("v"))
    return listed.select("id", F.transform("v", lambda x: x["have"]).alias("have"))


def delta_by_id(index: DataFrame, banked: DataFrame, shard: int | None = None, of: int = 8) -> DataFrame:
    """Blobs that the banked id list lacks, of one shard's range or of all."""
    own = index if shard is None else in_range(index, shard, of)
    return own.join(banked.select(F.col("id").alias("hash")).distinct(), "hash", "left_anti")


def delta_by_version(rows: DataFrame, banked: DataFrame) -> DataFrame:
    """Rows whose (path, content hash) pair is new: a known name with new
    content is banked again."""
    return rows.join(banked.select("path", "content_hash").distinct(), ["path", "content_hash"], "left_anti")


def delta_by_key(kv: DataFrame, banked: DataFrame) -> DataFrame:
    return kv.join(banked.select("key_hi", "key_lo").distinct(), ["key_hi", "key_lo"], "left_anti")


def result_refs(results: DataFrame) -> DataFrame:
    """``action, kind, hash, size`` of each digest that a result promises:
    files, trees and the two output streams; empty ones are left out."""
    one = lambda c, k: F.transform(F.coalesce(c, F.array().cast("array<struct<hash:string,size:bigint>>")), lambda d: F.struct(F.lit(k).alias("kind"), d["hash"].alias("hash"), d["size"].alias("size")))
    both = F.concat(one(F.col("files"), "file"), one(F.col("trees"), "tree"), one(F.array_compact(F.array("stdout", "stderr")), "stream"))
    return results.select("action", F.explode(both).alias("d")).select("action", "d.*").where("size > 0")


def expand_trees(refs: DataFrame, trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Refs with the files and child directories of their trees, and the
    actions whose tree is missing or can't be read.

    ``trees[tree, root, children]``; a directory is (digest, files).
    """
    asked = refs.where("kind = 'tree'").join(trees.withColumn("_there", F.lit(True)), F.col("hash") == F.col("tree"), "left")
    ok = F.coalesce("_there", F.lit(False)) & F.col("root").isNotNull()
    failed = asked.where(~ok).select("action").distinct()
    walk = asked.where(ok).select("action", "children", F.concat(F.array("root"), F.coalesce("children", F.array().cast(trees.schema["children"].dataType))).alias("dirs"))
    files = walk.select("action", F.explode("dirs").alias("d")).select("action", F.explode("d.files").alias("f")).select("action", F.lit("file").alias("kind"), "f.hash", "f.size")
    below = walk.select("action", F.explode("children").alias("d")).select("action", F.lit("dir").alias("kind"), F.col("d.digest.hash").alias("hash"), F.col("d.digest.size").alias("size"))
    return refs.unionByName(files).unionByName(below).where("size > 0"), failed


def validated_lookup(requests: DataFrame, results: DataFrame, refs: DataFrame, held: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """``key, verdict, n_refs, n_missing`` per request: MISS (no readable
    row), UNSERVABLE (a reference is absent) or HIT (all there, or none asked).

    Relational division in one plan: references of requested keys meet the
    distinct held digests, and counts per key decide.
    """
    keys = [c for c in ("hash", "size") if c in held.columns and c in refs.columns]
    have = held.select(*keys).distinct().withColumn("_have", F.lit(1))
    counted = refs.join(have, keys, "left").groupBy("action").agg(F.count("*").alias("n_refs"), (F.count("*") - F.count("_have")).alias("n_missing"))
    if failed is not None:
        extra = failed.select("action").distinct().select("action", F.lit(0).cast("long").alias("n_refs"), F.lit(1).cast("long").alias("n_missing"))
        counted = counted.unionByName(extra).groupBy("action").agg(F.sum("n_refs").alias("n_refs"), F.sum("n_missing").alias("n_missing"))
    rows = results.select("action", F.coalesce("decodable", F.lit(True)).alias("_row")) if "decodable" in results.columns else results.select("action").distinct().withColumn("_row", F.lit(True))
    asked = requests.select("key").join(rows, F.col("key") == rows["action"], "left").drop("action")
    got = asked.join(counted, F.col("key") == counted["action"], "left").drop("action")
    row, n, lacking = F.coalesce("_row", F.lit(False)), F.coalesce("n_refs", F.lit(0)), F.coalesce("n_missing", F.lit(0))
    verdict = F.when(~row, "MISS").when(lacking > 0, "UNSERVABLE").otherwise("HIT")
    return got.select("key", verdict.alias("verdict"), F.when(row, n).otherwise(0).cast("long").alias("n_refs"), F.when(row, lacking).otherwise(0).cast("long").alias("n_missing"))


def scrub(rows: DataFrame, verdicts: DataFrame, proven: DataFrame) -> DataFrame:
    """Rows without those that were found unservable and aren't proven."""
    dead = verdicts.where("verdict = 'UNSERVABLE'").select(F.col("key").alias("action")).join(proven.select("action").distinct(), "action", "left_anti")
    return rows.join(dead.distinct(), "action", "left_anti")


def scrub_counts(rows: DataFrame, verdicts: DataFrame, proven: DataFrame) -> DataFrame:
    checked = rows.join(proven.select("action").distinct(), "action", "left_anti")
    dead = verdicts.where("verdict = 'UNSERVABLE'").select(F.col("key").alias("action")).distinct().withColumn("_dead", F.lit(1))
    return checked.join(dead, "action", "left").agg(F.count("*").alias("scanned"), F.count("_dead").alias("deleted"))


def heavy_keys(rows: DataFrame, key: str, share: float = 0.001) -> DataFrame:
    """``key`` of those that hold at least ``share`` of the rows with one: at
    most ``1 / share``, found by a sketch of a bounded number of counters.

    The sketch's counts are never too small, so none of these is missed."""
    track = int(4 / share)
    found = rows.where(F.col(key).isNotNull()).agg(F.count("*").alias("_rows"), F.expr(f"approx_top_k(`{key}`, {int(1 / share)}, {track})").alias("_top"))
    each = found.select("_rows", F.explode("_top").alias("_t"))
    return each.where(F.col("_t.count") >= F.col("_rows") * share).select(F.col("_t.item").alias(key))


def join_salted(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame, spread: list[str], salts: int = 32) -> DataFrame:
    """The inner join on ``key``, where pairs of ``heavy`` keys (a bounded
    table) are spread over ``salts`` tasks each.

    Rows of the right side with a heavy key are dealt by their ``spread``
    columns, and the left side's get a copy for each salt; other keys are
    joined as they are.  No pair is lost or made twice."""
    marked = F.broadcast(heavy.select(key).distinct().withColumn("_heavy", F.lit(True)))  # at most 1 / share rows
    deal = F.when(F.col("_heavy"), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(0).cast("int")
    copies = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    a = left.join(marked, key, "left").withColumn("_salt", F.explode(copies)).drop("_heavy")
    b = right.join(marked, key, "left").withColumn("_salt", deal).drop("_heavy")
    return a.join(b, [key, "_salt"]).drop("_salt")


HOLDERS = 256


def locality_pref(inputs: DataFrame, holdings: DataFrame, k: int = 8) -> DataFrame:
    """``root, peer, score``: who holds most bytes of a root's ``k`` heaviest
    files.  Ties go to the smallest peer; roots that nobody holds are absent.

    A file's holders travel to its roots as lists of about ``HOLDERS`` peers and
    are told apart there, so what is shuffled is a list, not a row, for each
    file of a root.  A file that most peers hold and most roots need makes many
    lists for each of these; such files' are spread over tasks."""
    heavy = Window.partitionBy("root").orderBy(F.desc("size"), "hash")
    top = inputs.withColumn("_n", F.row_number().over(heavy)).where((F.col("_n") <= k) & (F.col("size") > 0)).drop("_n")
    held = holdings.select("peer", "hash").distinct()
    lists = F.pmod(F.xxhash64("peer"), F.ceil(F.col("_holders") / HOLDERS))
    counted = held.groupBy("hash").agg(F.count("*").alias("_holders")).where(F.col("_holders") > HOLDERS)
    many = held.join(counted, "hash").groupBy("hash", lists.alias("_list")).agg(F.collect_list("peer").alias("_peers"))
    few = held.join(counted, "hash", "left_anti").groupBy("hash").agg(F.collect_list("peer").alias("_peers")).select("hash", F.lit(0).cast("long").alias("_list"), "_peers")
    listed = few.unionByName(many)
    met = join_salted(top, listed, "hash", heavy_keys(held, "hash"), ["_list"]).select("root", "size", "_peers")
    tasks = 4 * int(inputs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # sized by pairs, which are more than the lists' bytes say
    each = met.repartition(tasks, "root").select("root", "size", F.explode("_peers").alias("peer"))
    scored = each.groupBy("root", "peer").agg(F.sum("size").alias("score"))
    best = scored.groupBy("root").agg(F.max_by(F.struct("peer", "score"), F.struct("score", -F.col("peer"))).alias("b"))
    return best.select("root", "b.peer", "b.score")


def wildcard_match(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Each fact's most specific rule for (os, arch), '' being a wildcard.

    Four equi-joins, not one nested loop: exact, os, arch, neither.
    """
    own = [c for c in rules.columns if c not in ("os", "arch")]
    parts = []
    for rank, (os, arch) in enumerate(((True, True), (True, False), (False, True), (False, False))):
        some = rules.where((F.col("os") != "" if os else F.col("os") == "") & (F.col("arch") != "" if arch else F.col("arch") == ""))
        some = some.withColumnsRenamed({"os": "_os", "arch": "_arch"})
        fits = facts.withColumn("_want_os", F.col("os") if os else F.lit("")).withColumn("_want_arch", F.col("arch") if arch else F.lit(""))
        got = fits.join(some, (F.col("_want_os") == F.col("_os")) & (F.col("_want_arch") == F.col("_arch")))
        parts.append(got.select(*facts.columns, F.struct(F.lit(rank).alias("rank"), *own).alias("_rule")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = every.groupBy(*facts.columns).agg(F.min("_rule").alias("_rule"))
    return best.select(*facts.columns, F.col("_rule.rank").alias("specificity"), *[F.col(f"_rule.{c}").alias(c) for c in own])


def bloom_build(hashes: DataFrame, nbits: int) -> DataFrame:
    """The set bits of a summary, as rows: ``[owner,] bit``."""
    owner = [c for c in hashes.columns if c == "owner"]
    return hashes.select(*owner, F.explode(bloom_positions("hash", nbits)).alias("bit")).distinct()


def bloom_probe(probe: DataFrame, bits: DataFrame, nbits: int) -> DataFrame:
    """``probe`` with ``maybe``; false only for hashes that aren't there."""
    asked = probe.select("hash").distinct().select("hash", F.explode(F.array_distinct(bloom_positions("hash", nbits))).alias("bit"))
    lacking = asked.join(bits.select("bit").distinct(), "bit", "left_anti").select("hash").distinct().withColumn("_no", F.lit(True))
    return probe.join(lacking, "hash", "left").withColumn("maybe", F.col("_no").isNull()).drop("_no")


def bloom_slices(blooms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries turned round: ``owners[owner, word, at]`` numbers the owners,
    and ``slices[bit, word, owners]`` has for each bit which of 64 owners a
    word set it, as the bits of one number."""
    numbered = blooms.select("owner").distinct().withColumn("_n", F.row_number().over(Window.orderBy("owner")) - 1)  # a fleet's peers
    owners = numbered.select("owner", F.floor(F.col("_n") / 64).cast("int").alias("word"), (F.col("_n") % 64).alias("at"))
    slices = blooms.join(owners, "owner").groupBy("bit", "word").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("owners"))
    return owners, slices


def claims(hashes: DataFrame, blooms: DataFrame, nbits: int) -> DataFrame:
    """``hash, peer`` for each peer whose summary may have the hash.

    Each of a hash's bits meets one number for 64 peers, and those that all of
    its bits have in common are its claimants; peers are only told apart where
    they claim a hash."""
    owners, slices = bloom_slices(blooms)
    asked = hashes.select("hash").distinct().withColumn("_bits", F.array_distinct(bloom_positions("hash", nbits)))
    met = asked.select("hash", F.size("_bits").alias("_n"), F.explode("_bits").alias("bit")).join(slices, "bit")
    common = met.groupBy("hash", "_n", "word").agg(F.count("*").alias("_got"), F.bit_and("owners").alias("_all")).where("_got = _n and _all <> 0")
    each = common.select("hash", "word", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.bit_get("_all", i) == 1)).alias("at"))
    return each.join(owners, ["word", "at"]).select("hash", F.col("owner").alias("peer"))


def confirm_candidates(requests: DataFrame, blooms: DataFrame, holdings: DataFrame, nbits: int) -> DataFrame:
    """``hash, peer, confirmed``: bloom claims, then the exact check."""
    exact = holdings.select("hash", "peer").distinct().withColumn("confirmed", F.lit(True))
    return claims(requests, blooms, nbits).join(exact, ["hash", "peer"], "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))


def confirm_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("peer").agg(F.count("*").alias("claimed"), F.count_if("confirmed").alias("confirmed"), F.count_if(~F.col("confirmed")).alias("refuted"))


def route(digests: DataFrame, providers: DataFrame, claims: DataFrame, owners: DataFrame, exact: DataFrame) -> DataFrame:
    """``hash, peer, round, have``: whom each digest is asked of.

    Round 1 asks the provider index, else the smallest claimant, else the
    range's owner.  What is denied is asked of the range's owner in round 2,
    unless that was asked already.  ``providers[hash, peer]``,
    ``claims[hash, peer]``, ``owners[range, peer]``, ``exact[hash, peer]``;
    digests carry ``range``.
    """
    known = providers.groupBy("hash").agg(F.min("peer").alias("_p"))
    maybe = claims.groupBy("hash").agg(F.min("peer").alias("_c"))
    owner = owners.groupBy("range").agg(F.min("peer").alias("_o"))
    asked = digests.select("hash", "range").distinct().join(known, "hash", "left").join(maybe, "hash", "left").join(owner, "range", "left")
    asked = asked.withColumn("peer", F.coalesce("_p", "_c", "_o"))
    has = exact.select("hash", "peer").distinct().withColumn("have", F.lit(True))
    first = asked.join(has, ["hash", "peer"], "left").withColumn("have", F.coalesce("have", F.lit(False)))
    again = first.where("not have and _o is not null and not (_o <=> peer)").select("hash", F.col("_o").alias("peer")).join(has, ["hash", "peer"], "left")
    one = first.where("peer is not null").select("hash", "peer", F.lit(1).alias("round"), "have")
    return one.unionByName(again.select("hash", "peer", F.lit(2).alias("round"), F.coalesce("have", F.lit(False)).alias("have")))


def pick_holder(claims: DataFrame, self_peer: object = None) -> DataFrame:
    """``hash, peer``: fetches spread over the claimants by the hash's first
    four digits.  A hash has at most as many claimants as there are peers."""
    others = claims if self_peer is None else claims.where(F.col("peer") != F.lit(self_peer))
    listed = others.groupBy("hash").agg(F.array_sort(F.collect_set("peer")).alias("_peers"))
    at = F.conv(F.substring("hash", 1, 4), 16, 10).cast("long") % F.size("_peers")
    return listed.select("hash", F.element_at("_peers", (at + 1).cast("int")).alias("peer"))


def fetch_plan(segments: DataFrame, artifacts: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """What to fetch, by container, and the segments to derive anew.

    The newest live artifact of a container's name is taken.  ``strict``: one
    missing container empties the plan.
    """
    newest = artifacts.groupBy("name").agg(F.max_by(F.struct("id", "created_at"), F.struct("created_at", -F.col("id"))).alias("a"))
    live = newest.select(F.col("name").alias("container"), F.col("a.id").alias("artifact_id"))
    met = segments.join(live, "container", "left")
    missing = met.where("artifact_id is null").select(*segments.columns)
    plan = met.where("artifact_id is not null").groupBy("container", "artifact_id").agg(F.count("*").alias("segments"), F.sum("bytes").alias("bytes"))
    if strict:
        gaps = missing.agg(F.count("*").alias("_gaps"))  # one row
        plan = plan.crossJoin(F.broadcast(gaps)).where("_gaps = 0").drop("_gaps")
    return plan, missing


def segments_to_fetch(segments: DataFrame, owned: str) -> DataFrame:
    """Segments whose prefix bitmap has an owned digit; owned ``*`` takes all.
    ``*`` on the segment's side matches no digit."""
    if owned == "*":
        return segments
    return segments.where(F.arrays_overlap(F.split("prefixes", ""), F.array(*[F.lit(d) for d in owned])))


def canonical_twins(requests: DataFrame, canonical: DataFrame, refs: DataFrame, held: DataFrame) -> DataFrame:
    """``request, key, hit``: requests whose canonical key has a stored result
    with all its own digests present.  Trees aren't opened here."""
    have = held.select("hash").distinct().withColumn("_have", F.lit(1))
    lacking = refs.join(have, "hash", "left").where("_have is null").select("key").distinct().withColumn("_lacks", F.lit(True))
    stored = canonical.select("key").distinct().join(lacking, "key", "left").select("key", F.col("_lacks").isNull().alias("_ok"))
    return requests.join(stored, "key", "left").select("request", "key", F.coalesce("_ok", F.lit(False)).alias("hit"))


def rewrite_paths(results: DataFrame, declared: DataFrame) -> DataFrame:
    """A stored result's normalised ``path`` as the requester's declared one
    (the last of ``pos`` for its normal form); others stay."""
    last = declared.select("request", "pos", "declared", normalize_token("declared").alias("path")).groupBy("request", "path").agg(F.max_by("declared", "pos").alias("declared"))
    return results.join(last, ["request", "path"], "left").select("request", F.coalesce("declared", "path").alias("path"))


