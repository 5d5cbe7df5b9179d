"""Every operator as a query over the given tables, with its DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelake.functions import expressions as ex
from cachelake.operators import aggregates as agg
from cachelake.operators import filters as fl
from cachelake.operators import joins as jn
from cachelake.operators import sets as st
from cachelake.operators import windows as wn
from cachelake.plans import jobs as jb
from cachelake.sources import tables as tb
from cachelake.sources.storage import children, scratch_path
from cachelake.streaming import streams as sm

GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The given tables and the views of them that queries share."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """A statement that names given tables plainly."""
        used = {n: getattr(self, n) for n in GIVEN if re.search(rf"\b(from|join) {n}\b", text)}
        return self.spark.sql(re.sub(rf"\b(from|join) ({'|'.join(GIVEN)})\b", r"\1 {\2}", text), **used)

    @property
    def blobs(self) -> DataFrame:
        return self.documents.selectExpr("concat(source,'/',doc_id) path", "sha2(text,256) hash", "cast(octet_length(text) as bigint) bytes", "lang", "source", "doc_id")

    @property
    def distinct_blobs(self) -> DataFrame:
        return self.blobs.groupBy("hash").agg(F.min("bytes").alias("bytes"))

    @property
    def refs(self) -> DataFrame:
        return self.lineitem.selectExpr("l_orderkey action", "l_partkey hash").distinct()

    @property
    def held(self) -> DataFrame:
        return self.part.where("p_size <= 45").selectExpr("p_partkey hash", "p_size bytes")

    @property
    def holdings(self) -> DataFrame:
        return self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_suppkey peer", "l_partkey hash", "p_size bytes").distinct()

    @property
    def versions(self) -> DataFrame:
        return self.lineitem.selectExpr(
            "concat(l_orderkey,'/',l_linenumber) path", "concat(l_partkey,'|',l_suppkey,'|',cast(l_quantity as int)) content",
            "sha2(concat(l_partkey,'|',l_suppkey,'|',cast(l_quantity as int)),256) content_hash", "l_shipdate", "l_partkey", "l_suppkey", "cast(l_quantity as int) qty", "l_returnflag", "l_orderkey",
        )

    @property
    def artifacts(self) -> DataFrame:
        return self.orders.selectExpr("o_orderkey id", "concat('cas-manifest-',o_orderstatus,'-r',o_custkey % 8) name", "o_orderpriority = '5-LOW' expired", "o_orderdate created_at", "o_orderstatus head_branch", "o_orderkey % 7 <> 0 same_repo")

    @property
    def log(self) -> DataFrame:
        return self.events.selectExpr("event_id job", "user_id worker", "event_type kind", "ts", "cast(round(value*1000) as bigint) us", "event_id")

    @property
    def tokens(self) -> DataFrame:
        return self.documents.selectExpr("doc_id action", "concat(lang,'/__d',doc_id % 50,'__/',substr(sha2(text,256),1,16),'/lib',doc_id % 50,'-',substr(sha2(text,256),17,8),'.rlib') token", "lang")

    @property
    def kv_lines(self) -> DataFrame:
        return self.events.selectExpr("case when event_id % 97 = 0 then concat('bad ',event_id) else concat(event_id % 16,' ',user_id - 75,' ',event_id,' ',hex(event_type)) end value")

    @property
    def verdicts(self) -> DataFrame:
        return jn.validated_lookup(self.orders.selectExpr("o_orderkey key"), self.lineitem.selectExpr("l_orderkey action"), self.refs, self.held.select("hash"))

    @property
    def segments(self) -> DataFrame:
        """Blobs as segments of lineages: one per source and language."""
        return self.blobs.groupBy(F.col("lang").alias("lineage"), F.col("source").alias("segment")).agg(
            F.sum("bytes").cast("long").alias("bytes"), F.count("*").alias("blobs"), F.array_join(F.array_sort(F.collect_set(F.substring("hash", 1, 1))), "").alias("prefixes"), (F.substring("source", -1, 1) == "0").alias("full"),
        )


VIEWS = {
    "v_blobs": "select concat(source,'/',doc_id) path, sha256(text) hash, octet_length(encode(text)) bytes, lang, source, doc_id, text from documents",
    "v_index": "select hash, min(bytes) bytes from v_blobs group by hash",
    "v_refs": "select distinct l_orderkey as action, l_partkey hash from lineitem",
    "v_held": "select p_partkey hash, p_size bytes from part where p_size <= 45",
    "v_holdings": "select distinct l_suppkey peer, l_partkey hash, p_size bytes from lineitem join part on l_partkey = p_partkey",
    "v_versions": "select concat(l_orderkey,'/',l_linenumber) path, concat(l_partkey,'|',l_suppkey,'|',cast(l_quantity as int)) content, sha256(concat(l_partkey,'|',l_suppkey,'|',cast(l_quantity as int))) content_hash, l_shipdate, l_partkey, l_suppkey, cast(l_quantity as int) qty, l_returnflag, l_orderkey from lineitem",
    "v_artifacts": "select o_orderkey id, concat('cas-manifest-',o_orderstatus,'-r',o_custkey % 8) as name, o_orderpriority = '5-LOW' expired, o_orderdate created_at, o_orderstatus head_branch, o_orderkey % 7 <> 0 same_repo from orders",
    "v_events": "select event_id job, user_id worker, event_type kind, ts, cast(round(value*1000) as bigint) us, event_id from events",
    "v_tokens": "select doc_id as action, concat(lang,'/__d',doc_id % 50,'__/',substr(sha256(text),1,16),'/lib',doc_id % 50,'-',substr(sha256(text),17,8),'.rlib') token, lang from documents",
    "v_kv_lines": "select case when event_id % 97 = 0 then concat('bad ',event_id) else concat(event_id % 16,' ',user_id - 75,' ',event_id,' ',hex(event_type)) end as value from events",
    "v_verdicts": "select o_orderkey as key, case when r.a is null then 'MISS' when m.n > 0 then 'UNSERVABLE' else 'HIT' end verdict, coalesce(m.refs,0) n_refs, coalesce(m.n,0) n_missing from orders left join (select distinct l_orderkey a from lineitem) r on r.a = o_orderkey left join (select f.action, count(*) refs, count(*) - count(h.hash) n from v_refs f left join v_held h using (hash) group by 1) m on m.action = o_orderkey",
    "v_segments": "select lang lineage, source segment, cast(sum(bytes) as bigint) bytes, count(*) blobs, list_aggregate(list_sort(list_distinct(list(substr(hash,1,1)))),'string_agg','') prefixes, source like '%0' as \"full\" from v_blobs group by 1, 2",
}
NEEDS = {"v_index": ["v_blobs"], "v_verdicts": ["v_refs", "v_held"], "v_segments": ["v_blobs"]}
BLOB_IDS = "select hash as id, bytes as size from v_index"
NOW = "2024-02-01 00:00:00"


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query; ``sql`` may use the views by name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            used = [v for v in VIEWS if v in sql]
            used = list(dict.fromkeys(x for v in used for x in [*NEEDS.get(v, []), v]))
            used.sort(key=lambda v: (v in NEEDS, list(VIEWS).index(v)))
            head = ", ".join(f"{v} as ({VIEWS[v]})" for v in used)
            body = sql.strip()
            if body.lower().startswith("with recursive "):
                SQL[name] = f"with recursive {head + ', ' if head else ''}{body[15:]}"
            elif body.lower().startswith("with "):
                SQL[name] = f"with {head + ', ' if head else ''}{body[5:]}"
            else:
                SQL[name] = f"with {head} {body}" if head else body
        return f

    return add


# ------------------------------------------------------------------ 2A sources


@query("content_index", "select hash, min(path) path, min(bytes) bytes from v_blobs group by hash")
def _(t: Tables) -> DataFrame:
    return tb.content_index(t.documents.selectExpr("concat(source,'/',doc_id) path", "text content"))


@query("row_index", "select concat(case when l_returnflag = 'N' then 'ac/' else 'acn/' end, path) path, content_hash, octet_length(encode(content)) bytes from v_versions")
def _(t: Tables) -> DataFrame:
    v = t.versions
    return tb.row_index(v.where("l_returnflag = 'N'").selectExpr("concat('ac/',path) path", "content"), v.where("l_returnflag <> 'N'").selectExpr("concat('acn/',path) path", "content"))


def _manifests(t: Tables) -> DataFrame:
    s = F.struct(F.col("segment").alias("name"), "bytes", "blobs", "prefixes", F.lit(None).cast("string").alias("artifact"), F.lit(None).cast("bigint").alias("run"), F.lit(None).cast("string").alias("role"), "full")
    return t.segments.groupBy("lineage").agg(F.count("*").alias("generation"), F.collect_list(s).alias("segments"))


MANIFEST_SQL = "select 1 as version, lineage, count(*) over (partition by lineage) generation, '' parent_lineage, 0::bigint parent_generation, 0::bigint created_by_run, segment, bytes, blobs, prefixes, null::varchar artifact, null::bigint run, null::varchar as role, \"full\" from v_segments"


@query("read_manifests", MANIFEST_SQL)
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "manifests")
    _manifests(t).write.json(path)
    return tb.read_manifests(t.spark, path)


@query("read_id_list", "select distinct hash as id from v_blobs")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "ids")
    t.blobs.select("hash").distinct().write.text(path)
    return tb.read_id_list(t.spark, path).unionByName(tb.read_id_list(t.spark, f"{path}-cold"))


KV_SQL = "select cast(split_part(value,' ',1) as smallint) shard, cast(split_part(value,' ',2) as bigint) key_hi, cast(split_part(value,' ',3) as bigint) key_lo, split_part(value,' ',4) as value from v_kv_lines where value not like 'bad%'"


@query("read_kv_export", KV_SQL)
def _(t: Tables) -> DataFrame:
    return tb.read_kv_export(t.kv_lines).withColumn("value", F.hex("value"))


@query("rejected_kv_lines", "select value from v_kv_lines where value like 'bad%'")
def _(t: Tables) -> DataFrame:
    return tb.rejected_kv_lines(t.kv_lines)


@query("read_artifact_listing", "select id, name, expired, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') created_at, head_branch, same_repo from v_artifacts")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "artifacts")
    run = F.struct("head_branch", F.col("id").alias("head_repository_id"), F.when(F.col("same_repo"), F.col("id")).otherwise(-1 - F.col("id")).alias("repository_id"))
    t.artifacts.select("id", "name", "expired", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), run.alias("workflow_run")).write.json(path)
    return tb.read_artifact_listing(t.spark, path)


LOG_LINE = """case event_id % 6 when 0 then concat('[driver] job ',event_id,' -> worker ',user_id,' (',event_type,')') when 1 then concat('[driver] job ',event_id,' speculated -> worker ',user_id,' (',event_type,')')
 when 2 then concat('[action] start ',event_type,' (staged in ',event_id % 10,'.5s)') when 3 then concat('[action] ok    ',event_type,' (',event_id % 10,'.2s)')
 when 4 then concat('[action] FAIL  ',event_type,' exit=Some(',event_id % 4,') (',event_id % 10,'.7s)') else 'noise' end"""


@query(
    "parse_build_log",
    """select ['dispatch','speculate','start','ok','fail'][event_id % 6 + 1] kind, case when event_id % 6 < 2 then event_id end job, case when event_id % 6 < 2 then cast(user_id as varchar) end worker, event_type as action,
    case event_id % 6 when 2 then event_id % 10 + 0.5::double when 3 then event_id % 10 + 0.2::double when 4 then event_id % 10 + 0.7::double end secs,
    case when event_id % 6 = 4 then cast(event_id % 4 as integer) end exit_code, null::varchar counters from events where event_id % 6 < 5""",
)
def _(t: Tables) -> DataFrame:
    return tb.parse_build_log(t.events.select(F.expr(LOG_LINE).alias("value")))


@query("write_generation", "select hash as id, bytes, substr(hash,1,1) prefix from v_index")
def _(t: Tables) -> DataFrame:
    rows = t.distinct_blobs.select(F.col("hash").alias("id"), "bytes", F.substring("hash", 1, 1).alias("prefix"), F.concat(F.lit("s"), F.substring("hash", 1, 1)).alias("segment"))
    segments = rows.groupBy(F.col("segment").alias("name")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("blobs"))
    path = scratch_path(t.spark, "generation")
    payload = tb.write_generation(segments, rows, path, t.spark.range(1).selectExpr("1 version", "'main' lineage", "1 generation"))
    sealed = tb.read_manifests(t.spark, f"{path}/manifest").select("segment")
    back = t.spark.read.schema("id string, bytes bigint, prefix string, segment string").parquet(payload)
    return back.join(sealed, "segment", "left_semi").select("id", "bytes", "prefix")


@query("insert_or_ignore", "select p_partkey hash, case when p_partkey % 2 = 0 then 'old' else 'new' end origin, p_size bytes from part where p_partkey % 2 = 0 or p_partkey % 3 = 0")
def _(t: Tables) -> DataFrame:
    p = t.part
    old = p.where("p_partkey % 2 = 0").selectExpr("p_partkey hash", "'old' origin", "p_size bytes")
    return tb.insert_or_ignore(old, p.where("p_partkey % 3 = 0").selectExpr("p_partkey hash", "'new' origin", "p_size bytes"), ["hash"])


@query("upsert_last", "select path, content_hash, l_shipdate, l_partkey, l_suppkey, qty from v_versions qualify row_number() over (partition by path order by l_shipdate desc, l_partkey desc, l_suppkey desc, qty desc, content_hash desc) = 1")
def _(t: Tables) -> DataFrame:
    v = t.versions.select("path", "content_hash", "l_shipdate", "l_partkey", "l_suppkey", "qty")
    return tb.upsert_last(v.where("l_partkey % 2 = 0"), v.where("l_partkey % 2 <> 0"), ["path"], ["l_shipdate", "l_partkey", "l_suppkey", "qty", "content_hash"])


# ------------------------------------------------------------------ 2B filters

PLANTED = "case when doc_id % 10 = 3 then {sha}(concat(text,'x'){n}) else {sha}(text{n}) end"


@query("verify_digests", f"select {PLANTED.format(sha='sha256', n='')} as name, doc_id % 10 <> 3 ok from documents")
def _(t: Tables) -> DataFrame:
    return fl.verify_digests(t.documents.selectExpr(f"{PLANTED.format(sha='sha2', n=',256')} name", "text content"))


@query("verify_counts", "select count_if(doc_id % 10 <> 3)::bigint verified, count_if(doc_id % 10 = 3)::bigint rejected from documents")
def _(t: Tables) -> DataFrame:
    return fl.verify_counts(t.documents.selectExpr(f"{PLANTED.format(sha='sha2', n=',256')} name", "text content"))


@query("check_expected", "select doc_id, sha256(text) exp_hash, octet_length(encode(text)) + case when doc_id % 7 = 0 then 1 else 0 end exp_size, doc_id % 7 <> 0 accepted from documents")
def _(t: Tables) -> DataFrame:
    return fl.check_expected(t.documents.selectExpr("doc_id", "sha2(text,256) exp_hash", "cast(octet_length(text) as bigint) + case when doc_id % 7 = 0 then 1 else 0 end exp_size", "text content"))


CODES = "case when event_id % 11 = 0 then null else event_id % 3 end"


@query("purge_failures", f"select event_id, cast({CODES} as bigint) exit_code from events where {CODES} is null or {CODES} = 0")
def _(t: Tables) -> DataFrame:
    return fl.purge_failures(t.events.selectExpr("event_id", f"{CODES} exit_code"))


@query("purge_counts", f"select count(*) scanned, count_if({CODES} <> 0)::bigint purged from events")
def _(t: Tables) -> DataFrame:
    return fl.purge_counts(t.events.selectExpr(f"{CODES} exit_code"))


@query("cacheable_only", "select o_orderkey as action, cast(o_orderkey % 3 as bigint) exit_code, o_orderkey % 3 = 0 persisted from orders where o_orderpriority <> '1-URGENT' and o_orderkey % 3 >= 0")
def _(t: Tables) -> DataFrame:
    return fl.cacheable_only(t.orders.selectExpr("o_orderkey action", "o_orderkey % 3 exit_code", "o_orderpriority = '1-URGENT' do_not_cache"), True).drop("do_not_cache")


@query("provenance_filter", "select id, name, created_at from v_artifacts where not expired and head_branch = 'F' and same_repo")
def _(t: Tables) -> DataFrame:
    return fl.provenance_filter(t.artifacts, "F").select("id", "name", "created_at")


@query("in_range", "select path, hash, bytes from v_blobs where substr(hash,1,1) in ('6','7')")
def _(t: Tables) -> DataFrame:
    return fl.in_range(t.blobs, 3).select("path", "hash", "bytes")


@query("hot_set", "select path, hash, bytes from v_blobs where bytes > 0 and bytes <= 4096 and hash not in (select hash from v_blobs where lang = 'en')")
def _(t: Tables) -> DataFrame:
    b = t.blobs
    return fl.hot_set(b, b.where("lang = 'en'"), 4096).select("path", "hash", "bytes")


# ------------------------------------------------------------------ 2C joins


@query("find_missing", "select l_partkey hash, cast(l_linenumber as int) as size from lineitem where not exists (select 1 from part where p_size <= 45 and p_partkey = l_partkey and p_size % 7 + 1 = l_linenumber)")
def _(t: Tables) -> DataFrame:
    return jn.find_missing(t.lineitem.selectExpr("l_partkey hash", "l_linenumber size"), t.held.selectExpr("hash", "bytes % 7 + 1 size")).select("hash", "size")


PRESENCE = "select l_orderkey id, l_linenumber * 100000000::bigint + l_partkey * 100 + l_suppkey % 100 pos, l_partkey hash, 1 as size from lineitem"


@query("presence_vector", f"select id, array_to_string(list(case when h.hash is null then 'n' else 'y' end order by pos, h.hash is not null), '') have from ({PRESENCE}) b left join v_held h using (hash) group by id")
def _(t: Tables) -> DataFrame:
    batch = t.lineitem.selectExpr("l_orderkey id", "l_linenumber * 100000000L + l_partkey * 100 + l_suppkey % 100 pos", "l_partkey hash", "1 size")
    got = jn.presence_vector(batch, t.held.selectExpr("hash", "1 size"))
    return got.select("id", F.array_join(F.transform("have", lambda x: F.when(x, "y").otherwise("n")), "").alias("have"))


@query("delta_by_id", "select hash, bytes from v_index where hash not in (select hash from v_blobs where lang = 'de') and substr(hash,1,1) in ('2','3')")
def _(t: Tables) -> DataFrame:
    return jn.delta_by_id(t.distinct_blobs, t.blobs.where("lang = 'de'").selectExpr("hash id"), 1)


BANKED = "l_orderkey % 3 = 0"


@query("delta_by_version", f"select path, content_hash from v_versions where (path, content_hash) not in (select path, content_hash from v_versions where {BANKED})")
def _(t: Tables) -> DataFrame:
    v = t.versions.select("path", "content_hash", "l_orderkey")
    return jn.delta_by_version(v, v.where(BANKED)).select("path", "content_hash")


@query("delta_by_key", f"select shard, key_hi, key_lo from ({KV_SQL}) where key_lo % 4 <> 0")
def _(t: Tables) -> DataFrame:
    kv = tb.read_kv_export(t.kv_lines)
    return jn.delta_by_key(kv, kv.where("key_lo % 4 = 0")).select("shard", "key_hi", "key_lo")


def _results(t: Tables) -> DataFrame:
    d = lambda h, s: F.struct(F.expr(h).cast("string").alias("hash"), F.expr(s).cast("bigint").alias("size"))
    return t.orders.select(F.col("o_orderkey").alias("action"), F.array(d("concat('f',o_custkey)", "o_orderkey % 5")).alias("files"), F.array(d("concat('t',o_orderkey)", "1")).alias("trees"), d("concat('o',o_custkey % 10)", "o_orderkey % 2").alias("stdout"), F.when(F.expr("o_orderkey % 3 = 0"), d("'e'", "1")).alias("stderr"))


REFS_SQL = "select o_orderkey as action, 'file' kind, concat('f',o_custkey) hash, cast(o_orderkey % 5 as bigint) as size from orders where o_orderkey % 5 > 0 union all select o_orderkey, 'tree', concat('t',o_orderkey), 1 from orders union all select o_orderkey, 'stream', concat('o',o_custkey % 10), 1 from orders where o_orderkey % 2 > 0 union all select o_orderkey, 'stream', 'e', 1 from orders where o_orderkey % 3 = 0"


@query("result_refs", REFS_SQL)
def _(t: Tables) -> DataFrame:
    return jn.result_refs(_results(t))


def _trees(t: Tables) -> DataFrame:
    f = F.struct(F.concat(F.lit("p"), "l_partkey").alias("hash"), F.col("l_linenumber").cast("bigint").alias("size"))
    per = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(f).alias("files"))
    own = F.struct(F.concat(F.lit("d"), "l_orderkey").alias("hash"), F.lit(1).cast("bigint").alias("size"))
    none = F.array().cast("array<struct<hash:string,size:bigint>>")
    return per.select(F.concat(F.lit("t"), "l_orderkey").alias("tree"), F.struct(own.alias("digest"), none.alias("files")).alias("root"), F.array(F.struct(own.alias("digest"), F.col("files"))).alias("children"))


@query("expand_trees", f"with r as ({REFS_SQL}) select * from r union all select l_orderkey, 'file', concat('p',l_partkey), cast(l_linenumber as bigint) from lineitem union all select distinct l_orderkey, 'dir', concat('d',l_orderkey), 1::bigint from lineitem")
def _(t: Tables) -> DataFrame:
    return jn.expand_trees(jn.result_refs(_results(t)), _trees(t))[0]


@query("failed_trees", "select o_orderkey as action from orders where o_orderkey not in (select l_orderkey from lineitem)")
def _(t: Tables) -> DataFrame:
    return jn.expand_trees(jn.result_refs(_results(t)), _trees(t))[1]


@query("validated_lookup", "select * from v_verdicts")
def _(t: Tables) -> DataFrame:
    return t.verdicts


@query("scrub", "select distinct l_orderkey as action from lineitem where l_orderkey % 5 = 0 or l_orderkey not in (select key from v_verdicts where verdict = 'UNSERVABLE')")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.selectExpr("l_orderkey action").distinct()
    return jn.scrub(rows, t.verdicts, rows.where("action % 5 = 0"))


@query("scrub_counts", "select count(*) scanned, count_if(verdict = 'UNSERVABLE')::bigint deleted from v_verdicts where verdict <> 'MISS' and key % 5 <> 0")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.selectExpr("l_orderkey action").distinct()
    return jn.scrub_counts(rows, t.verdicts, rows.where("action % 5 = 0"))


@query(
    "locality_pref",
    """with top as (select *, row_number() over (partition by l_orderkey order by p_size desc, l_partkey) n from (select distinct l_orderkey, l_partkey, p_size from lineitem join part on l_partkey = p_partkey)),
    s as (select l_orderkey root, peer, cast(sum(p_size) as bigint) score from top join v_holdings on hash = l_partkey where n <= 8 group by 1, 2)
    select root, peer, score from s where score > 0 qualify row_number() over (partition by root order by score desc, peer) = 1""",
)
def _(t: Tables) -> DataFrame:
    inputs = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_orderkey root", "l_partkey hash", "p_size size").distinct()
    return jn.locality_pref(inputs, t.holdings)


RULES = "select case when p_partkey % 3 = 0 then '' else p_brand end os, case when p_partkey % 2 = 0 then '' else p_type end arch, min(p_partkey) rule from part where p_partkey % 5 = 0 group by 1, 2"


@query(
    "wildcard_match",
    f"""with rules as ({RULES}), m as (select p_partkey, p_brand, p_type, rule, (case when r.os = '' then 2 else 0 end) + (case when r.arch = '' then 1 else 0 end) specificity from part join rules r on (r.os = '' or r.os = p_brand) and (r.arch = '' or r.arch = p_type))
    select p_partkey, p_brand as os, p_type as arch, specificity, rule from m qualify row_number() over (partition by p_partkey order by specificity, rule) = 1""",
)
def _(t: Tables) -> DataFrame:
    rules = t.part.where("p_partkey % 5 = 0").selectExpr("case when p_partkey % 3 = 0 then '' else p_brand end os", "case when p_partkey % 2 = 0 then '' else p_type end arch", "p_partkey").groupBy("os", "arch").agg(F.min("p_partkey").alias("rule"))
    return jn.wildcard_match(t.part.selectExpr("p_partkey", "p_brand os", "p_type arch"), rules)


BLOOM_BITS = 16384
POS_SQL = " union all ".join(f"select {{c}}, cast(('0x' || substr(hash,{8 * i + 1},8)) as bigint) & {BLOOM_BITS - 1} as bit from {{s}}" for i in range(4))


@query("bloom_build", "select distinct bit from (" + POS_SQL.format(c="hash", s="(select hash from v_blobs where lang = 'en')") + ")")
def _(t: Tables) -> DataFrame:
    return jn.bloom_build(t.blobs.where("lang = 'en'").select("hash"), BLOOM_BITS)


@query(
    "bloom_probe",
    "with bits as (select distinct bit from (" + POS_SQL.format(c="hash", s="(select hash from v_blobs where lang = 'en')") + ")), p as (" + POS_SQL.format(c="hash", s="v_index") + "), no as (select distinct hash from p where bit not in (select bit from bits)) select path, hash, hash not in (select hash from no) maybe from v_blobs where lang <> 'en'",
)
def _(t: Tables) -> DataFrame:
    b = t.blobs
    return jn.bloom_probe(b.where("lang <> 'en'").select("path", "hash"), jn.bloom_build(b.where("lang = 'en'").select("hash"), BLOOM_BITS), BLOOM_BITS)


CLAIM_SQL = "bits as (select distinct lang as peer, bit from (" + POS_SQL.format(c="lang", s="v_blobs") + ")), p as (select distinct hash, bit from (" + POS_SQL.format(c="hash", s="v_index") + ")), claims as (select hash, peer from p join bits using (bit) group by hash, peer having count(*) = (select count(*) from p p2 where p2.hash = p.hash))"


@query("confirm_candidates", "with " + CLAIM_SQL + " select c.hash, c.peer, exists (select 1 from v_blobs b where b.hash = c.hash and b.lang = c.peer) confirmed from claims c")
def _(t: Tables) -> DataFrame:
    return _confirm(t)


def _confirm(t: Tables) -> DataFrame:
    b = t.blobs
    blooms = jn.bloom_build(b.selectExpr("lang owner", "hash"), BLOOM_BITS)
    return jn.confirm_candidates(b.select("hash"), blooms, b.selectExpr("hash", "lang peer"), BLOOM_BITS)


@query("confirm_counts", "with " + CLAIM_SQL + ", x as (select c.peer, exists (select 1 from v_blobs b where b.hash = c.hash and b.lang = c.peer) ok from claims c) select peer, count(*) claimed, count_if(ok)::bigint confirmed, count_if(not ok)::bigint refuted from x group by peer")
def _(t: Tables) -> DataFrame:
    return jn.confirm_counts(_confirm(t))


@query(
    "route",
    """with dg as (select p_partkey hash, p_partkey % 8 as rng from part), kn as (select hash, min(peer) + (hash % 2) peer from v_holdings where hash % 4 = 0 group by hash), cl as (select hash, min(peer) peer from v_holdings where hash % 4 = 1 group by hash),
    a as (select d.hash, coalesce(kn.peer, cl.peer, d.rng + 1) peer, d.rng + 1 owner from dg d left join kn using (hash) left join cl using (hash)),
    f as (select a.*, exists (select 1 from v_holdings h where h.hash = a.hash and h.peer = a.peer) have from a)
    select hash, peer, 1 as round, have from f union all select hash, owner, 2, exists (select 1 from v_holdings h where h.hash = f.hash and h.peer = f.owner) from f where not have and owner <> peer""",
)
def _(t: Tables) -> DataFrame:
    h = t.holdings
    digests = t.part.selectExpr("p_partkey hash", "p_partkey % 8 range")
    owners = t.part.selectExpr("p_partkey % 8 range").distinct().selectExpr("range", "range + 1 peer")
    known = h.where("hash % 4 = 0").groupBy("hash").agg(F.min("peer").alias("peer")).selectExpr("hash", "peer + hash % 2 peer")
    return jn.route(digests, known, h.where("hash % 4 = 1"), owners, h)


@query("pick_holder", "with h as (select distinct sha256(cast(hash as varchar)) hash, peer from v_holdings), l as (select hash, list(peer order by peer) p from h group by hash) select hash, p[cast(('0x' || substr(hash,1,4)) as bigint) % len(p) + 1] peer from l")
def _(t: Tables) -> DataFrame:
    return jn.pick_holder(t.holdings.select(F.sha2(F.col("hash").cast("string"), 256).alias("hash"), "peer"))


PLAN_SEG = "select concat('s',o_orderkey) segment, concat('cas-manifest-',o_orderstatus,'-r',o_custkey % 11) container, cast(o_custkey as bigint) bytes from orders"


@query("fetch_plan", f"with a as (select name, id from v_artifacts where not expired qualify row_number() over (partition by name order by created_at desc, id) = 1) select container, a.id artifact_id, count(*) segments, cast(sum(bytes) as bigint) bytes from ({PLAN_SEG}) s join a on a.name = s.container group by 1, 2")
def _(t: Tables) -> DataFrame:
    return jn.fetch_plan(_plan_segments(t), t.artifacts.where("not expired"))[0]


def _plan_segments(t: Tables) -> DataFrame:
    return t.orders.selectExpr("concat('s',o_orderkey) segment", "concat('cas-manifest-',o_orderstatus,'-r',o_custkey % 11) container", "cast(o_custkey as bigint) bytes")


@query("fetch_missing", f"select * from ({PLAN_SEG}) where container not in (select name from v_artifacts where not expired)")
def _(t: Tables) -> DataFrame:
    return jn.fetch_plan(_plan_segments(t), t.artifacts.where("not expired"))[1]


@query("fetch_plan_strict", f"with a as (select name, id from v_artifacts where not expired qualify row_number() over (partition by name order by created_at desc, id) = 1), s as ({PLAN_SEG}) select container, a.id artifact_id, count(*) segments, cast(sum(bytes) as bigint) bytes from s join a on a.name = s.container where not exists (select 1 from s where container not in (select name from a)) group by 1, 2")
def _(t: Tables) -> DataFrame:
    return jn.fetch_plan(_plan_segments(t), t.artifacts.where("not expired"), strict=True)[0]


@query("segments_to_fetch", "select lineage, segment, prefixes from v_segments where prefixes like '%0%' or prefixes like '%1%'")
def _(t: Tables) -> DataFrame:
    return jn.segments_to_fetch(t.segments, "01").select("lineage", "segment", "prefixes")


NORM_SQL = r"regexp_replace(case when regexp_matches(token, '{p}') then concat('__norm__/', regexp_extract(token, '{p}', 1), case when regexp_extract(token, '{p}', 2) <> '' then concat('/', regexp_extract(token, '{p}', 2)) else '' end) else token end, '-[0-9a-f]{{8}}\.', '-00000000.', 'g')".format(p=ex.PATH_RULE)


@query("canonical_twins", f"with k as (select action, {NORM_SQL} as key, lang from v_tokens), c as (select distinct key from k where lang = 'en'), lack as (select distinct key from k where lang = 'en' and action % 9 = 0) select k.action as request, k.key, c.key is not null and k.key not in (select key from lack) hit from k left join c using (key)")
def _(t: Tables) -> DataFrame:
    k = t.tokens.select("action", ex.normalize_token("token").alias("key"), "lang")
    stored = k.where("lang = 'en'").selectExpr("key", "action hash")
    return jn.canonical_twins(k.selectExpr("action request", "key"), stored, stored, stored.where("hash % 9 <> 0"))


@query("rewrite_paths", f"select action as request, token as path from v_tokens where action % 2 = 0 union all select action, {NORM_SQL} from v_tokens where action % 2 <> 0")
def _(t: Tables) -> DataFrame:
    results = t.tokens.select(F.col("action").alias("request"), ex.normalize_token("token").alias("path"))
    return jn.rewrite_paths(results, t.tokens.where("action % 2 = 0").selectExpr("action request", "1 pos", "token declared"))


# ------------------------------------------------------------------ 2D aggregates


@query("union_ids", "select distinct hash as id from v_blobs where lang in ('en','de','fr')")
def _(t: Tables) -> DataFrame:
    b = t.blobs
    return agg.union_ids(*[b.where(F.col("lang") == x).selectExpr("hash id") for x in ("en", "de", "fr")])


@query("union_counts", "select count(distinct hash) filter (where lang = 'en') own, count(distinct hash) filter (where lang <> 'en') inherited, count(distinct hash) ids from v_blobs")
def _(t: Tables) -> DataFrame:
    b = t.blobs
    return agg.union_counts(b.where("lang = 'en'").selectExpr("hash id"), b.where("lang <> 'en'").selectExpr("hash id"))


@query("segment_meta", "select source, count(*) blobs, cast(sum(bytes) as bigint) bytes, string_agg(distinct substr(hash,1,1), '' order by substr(hash,1,1)) prefixes, concat('seg-', substr(sha256(string_agg(concat(hash, chr(10)), '' order by hash)),1,16)) as name from v_blobs group by source")
def _(t: Tables) -> DataFrame:
    return agg.segment_meta(t.blobs.selectExpr("source", "hash id", "bytes"), ["source"])


FP_SQL = "with p as (select {g} as g, substr(md5({p}),1,2) bin, sha256(string_agg(concat({p},chr(0),{h},chr(0)),'' order by {p},{h})) fp from {s} group by 1, 2) select g as \"group\", sha256(string_agg(concat(bin,':',fp),'' order by bin)) fp from p group by g"


@query("content_fingerprint", FP_SQL.format(g="source", p="path", h="hash", s="(select * from v_blobs where doc_id % 13 <> 0)"))
def _(t: Tables) -> DataFrame:
    b = t.blobs
    return agg.content_fingerprint(b.selectExpr("source group", "path", "hash"), b.where("doc_id % 13 = 0").select("path"))


@query("table_unchanged", "select count(*) > 0 unchanged from documents")
def _(t: Tables) -> DataFrame:
    index = t.blobs.selectExpr("path id")
    recorded = agg.content_fingerprint(index.selectExpr("'all' group", "id path", "'' hash").distinct()).select("fp")
    return agg.table_unchanged(index, recorded)


CFG = agg.CompactCfg(min_bytes=20_000, max_segments=18)
SUMS_SQL = "select lineage, cast(sum(case when \"full\" then bytes else 0 end) as bigint) f, cast(sum(case when \"full\" then 0 else bytes end) as bigint) d, count_if(not \"full\") n from v_segments group by lineage"
REASON_SQL = "case when n > 18 then 'segments' when d < 20000 then null when f = 0 then 'cold-bank' when d > (f * 25) // 100 then 'delta' end"


@query("needs_compaction", f"select lineage, {REASON_SQL} is not null compact, {REASON_SQL} reason from ({SUMS_SQL})")
def _(t: Tables) -> DataFrame:
    return agg.needs_compaction(t.segments, CFG)


POLICY_NOW = 1_720_000_000
EVIDENCE_SQL = "select o_orderpriority lineage, cast(min(o_custkey) as bigint) delta_restore_secs, case when o_orderpriority = '2-HIGH' then 'soon' else '2024-01-01T00:00:00Z' end oldest from orders group by 1"


@query("compaction_policy", f"with h as (select o_orderpriority lineage, cast(o_custkey as bigint) bytes, false as \"full\" from orders), e as ({EVIDENCE_SQL}) select lineage, case when delta_restore_secs > 1 then 'restore' when oldest like '2024%' then 'rewarm' else 'none' end reason from (select distinct lineage from h) join e using (lineage)")
def _(t: Tables) -> DataFrame:
    heads = t.orders.selectExpr("o_orderpriority lineage", "cast(o_custkey as bigint) bytes", "false full")
    evidence = t.orders.groupBy(F.col("o_orderpriority").alias("lineage")).agg(F.min("o_custkey").cast("long").alias("delta_restore_secs")).withColumn("oldest", F.expr("case when lineage = '2-HIGH' then 'soon' else '2024-01-01T00:00:00Z' end"))
    return agg.compaction_policy(heads, evidence, POLICY_NOW, agg.CompactCfg(min_bytes=1 << 60, max_segments=1 << 60), budget=1)


@query("restore_evidence", "with s as (select l_orderkey container, bool_and(l_returnflag = 'N') all_full from lineitem group by 1) select cast(sum(case when not all_full then o_custkey % 60 end) as bigint) delta_restore_secs, min(o_orderdate) oldest from orders join s on container = o_orderkey")
def _(t: Tables) -> DataFrame:
    return agg.restore_evidence(t.orders.selectExpr("o_orderkey container", "o_custkey % 60 secs", "o_orderdate created_at"), t.lineitem.selectExpr("l_orderkey container", "l_returnflag = 'N' full"))


@query("shed_guard", "select lang lineage, count(distinct hash) filter (where doc_id % 5 <> 0 or lang = 'en') < count(distinct hash) would_shed from v_blobs group by lang")
def _(t: Tables) -> DataFrame:
    b = t.blobs.selectExpr("lang lineage", "hash id", "doc_id")
    return agg.shed_guard(b, b.where("doc_id % 5 <> 0 or lineage = 'en'"))


LATENCY_SQL = "select kind verdict, count(*) n, " + ", ".join(f"(list(us order by us))[cast(round((count(*) - 1) * {p}) as bigint) + 1] \"{n}\"" for n, p in (("p50", "0.5::double"), ("p90", "0.9::double"), ("p99", "0.99::double"), ("max", "0.99999::double"))) + " from v_events group by kind"


@query("latency_summary", LATENCY_SQL)
def _(t: Tables) -> DataFrame:
    return agg.latency_summary(t.log.selectExpr("kind verdict", "us"))


AGE = "cast(epoch(timestamp '2024-02-01 00:00:00') - floor(epoch(ts)) as bigint)"


@query("queue_summary", f"select kind os, '*' arch, count(*) queued, max({AGE}) oldest_s, max({AGE}) > 120 starved, min(job) filter (where a = m) job from (select *, {AGE} a, max({AGE}) over (partition by kind) m from v_events) group by kind")
def _(t: Tables) -> DataFrame:
    age = (F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("age_s")
    return agg.queue_summary(t.log.select(F.col("kind").alias("os"), F.lit("").alias("arch"), "job", age))


@query("dispatch_counts", "select cast(worker as varchar) worker, count(*) jobs from v_events where kind = 'click' group by 1 union all select '*', count(*) from v_events where kind = 'click'")
def _(t: Tables) -> DataFrame:
    return agg.dispatch_counts(t.log.where("kind = 'click'"))


@query("cache_report", "select count_if(verdict = 'HIT')::bigint hits, count_if(verdict = 'MISS')::bigint misses, count_if(verdict = 'UNSERVABLE')::bigint unservable, cast(sum(case when verdict = 'HIT' then n_refs end) as bigint) bytes, count_if(verdict = 'HIT' and key % 2 = 0)::bigint hit_ok, count_if(verdict = 'HIT' and key % 2 <> 0)::bigint hit_failed, count_if(verdict = 'HIT') = 0 and count_if(verdict = 'MISS') > 0 tripwire from v_verdicts")
def _(t: Tables) -> DataFrame:
    return agg.cache_report(t.verdicts.selectExpr("verdict", "n_refs bytes", "key % 2 exit_code"), 1)


SOURCE = "case when event_id % 3 = 0 then 'local' when event_id % 3 = 1 then 'peer' else 'driver' end"


@query("fetch_sources", f"select w.worker, s.source, count(e.worker) n from (select distinct worker from v_events) w cross join (select unnest(['local','peer','driver']) source) s left join (select worker, {SOURCE} source from v_events) e on e.worker = w.worker and e.source = s.source group by 1, 2")
def _(t: Tables) -> DataFrame:
    return agg.fetch_sources(t.log.selectExpr("worker", f"{SOURCE} source"))


@query("off_node_bytes", "with i as (select l_orderkey as action, l_partkey hash, p_size as size, l_orderkey % 100 + 1 peer from lineitem join part on l_partkey = p_partkey), m as (select coalesce(sum(size) filter (where not exists (select 1 from v_holdings h where h.peer = i.peer and h.hash = i.hash)),0) moved, sum(size) total from i) select cast(moved as bigint) moved, cast(total as bigint) total, cast(floor(total * 99 / 100.0) as bigint) baseline, moved * 2 > total * 99 / 100.0 regressed from m")
def _(t: Tables) -> DataFrame:
    inputs = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_orderkey action", "l_partkey hash", "p_size size")
    placed = t.orders.selectExpr("o_orderkey action", "o_orderkey % 100 + 1 peer")
    return agg.off_node_bytes(placed, inputs, t.holdings, 100)


@query("quorum", "select count(distinct worker) workers, count(distinct event_id % 8) shards, count(distinct worker) >= 10 and count(distinct event_id % 8) >= 8 formed from v_events")
def _(t: Tables) -> DataFrame:
    return agg.quorum(t.log.selectExpr("worker", "event_id % 8 shard"), 10, 8)


# ------------------------------------------------------------------ 2E windows


@query("newest_per_name", "select id, name, created_at from v_artifacts where not expired qualify row_number() over (partition by name order by created_at desc, id) = 1")
def _(t: Tables) -> DataFrame:
    return wn.newest_per_name(fl.provenance_filter(t.artifacts, "-"), "cas-manifest-").select("id", "name", "created_at")


@query("collapse_versions", "select path, content_hash hash from v_versions qualify row_number() over (partition by path order by l_shipdate desc, l_partkey desc, l_suppkey desc, qty desc) = 1")
def _(t: Tables) -> DataFrame:
    return wn.collapse_versions(t.versions.withColumnRenamed("content_hash", "hash"), ["l_shipdate", "l_partkey", "l_suppkey", "qty"])


PLAN_SQL = "select cast(s_suppkey as varchar) segment, cast(s_suppkey % 2 as int) as rank, s_nationkey run, case when s_suppkey % 5 = 0 then 'driver' else 'Linux-w1' end as role from supplier"
ORDER_SQL = f"select path, content_hash, cast(l_suppkey as varchar) source from v_versions join ({PLAN_SQL}) p on p.segment = cast(l_suppkey as varchar) qualify row_number() over (partition by path order by p.rank desc, run desc, case when p.role = 'driver' then 'zzzz-driver' else p.role end desc, p.segment desc, content_hash desc) = 1"


def _apply_plan(t: Tables) -> DataFrame:
    return t.supplier.selectExpr("cast(s_suppkey as string) segment", "cast(s_suppkey % 2 as int) rank", "s_nationkey run", "case when s_suppkey % 5 = 0 then 'driver' else 'Linux-w1' end role")


@query("apply_order", ORDER_SQL)
def _(t: Tables) -> DataFrame:
    return wn.apply_order(t.versions.selectExpr("path", "content_hash", "cast(l_suppkey as string) segment"), _apply_plan(t))


def pack_sql(items: str, group: str, opens: str) -> str:
    """Packing as a recursive walk along each group's items."""
    return f"""with recursive items as ({items}), o as (select *, {group} as prefix, row_number() over (partition by {group} order by id) rn from items),
    walk as (select prefix, rn, id, size, size::bigint as acc, 0 as segment_no from o where rn = 1
      union all select o.prefix, o.rn, o.id, o.size, case when {opens} then o.size else w.acc + o.size end, w.segment_no + case when {opens} then 1 else 0 end from walk w join o on o.prefix = w.prefix and o.rn = w.rn + 1)
    select id, size, prefix, segment_no from walk"""


@query("pack_greedy", pack_sql(BLOB_IDS, "substr(id,1,1)", "w.acc + o.size > 20000"))
def _(t: Tables) -> DataFrame:
    return wn.pack_greedy(t.distinct_blobs.selectExpr("hash id", "bytes size"), 20_000).select("id", "size", "prefix", "segment_no")


KV_ITEMS = f"select concat(key_hi,' ',key_lo) id, length(concat(shard,' ',key_hi,' ',key_lo,' ',value)) + 1 as size, cast(shard as varchar) shard from ({KV_SQL})"


@query("pack_until_full", pack_sql(KV_ITEMS, "shard", "w.acc >= 4096"))
def _(t: Tables) -> DataFrame:
    kv = tb.read_kv_export(t.kv_lines)
    line = F.concat_ws(" ", "shard", "key_hi", "key_lo", F.hex("value"))
    items = kv.select(F.concat_ws(" ", "key_hi", "key_lo").alias("id"), (F.length(line) + 1).cast("long").alias("size"), "shard")
    return wn.pack_until_full(items, 4096, "shard").select("id", "size", "prefix", "segment_no")


@query("chunk", "select peer, hash, cast(floor((row_number() over (partition by peer order by hash) - 1) / 512) as int) chunk_no from v_holdings")
def _(t: Tables) -> DataFrame:
    return wn.chunk(t.holdings.select("peer", "hash"), 512, ["peer"], ["hash"])


@query("counter_rate", "select worker, event_id, us - coalesce(lag(us) over (partition by worker order by ts, event_id), 0) rate from v_events")
def _(t: Tables) -> DataFrame:
    return wn.counter_rate(t.log, "worker", ("ts", "event_id"), "us").select("worker", "event_id", "rate")


@query("attempts", "select job % 4000 job, event_id, cast(row_number() over (partition by job % 4000 order by ts, event_id) as int) attempt, row_number() over (partition by job % 4000 order by ts, event_id) >= 3 gave_up from v_events")
def _(t: Tables) -> DataFrame:
    return wn.attempts(t.log.selectExpr("job % 4000 job", "event_id", "ts"), order=("ts", "event_id")).select("job", "event_id", "attempt", "gave_up")


FIRST_SQL = "select job % 4000 job, event_id id, ts from v_events qualify row_number() over (partition by job % 4000 order by ts, event_id) = 1"


@query("first_result_wins", FIRST_SQL)
def _(t: Tables) -> DataFrame:
    return wn.first_result_wins(t.log.selectExpr("job % 4000 job", "event_id id", "ts"))


# ------------------------------------------------------------------ 2F, 2G


@query("recent_spills", "with s as (select o_orderkey spill from orders where o_orderdate > timestamp '1995-01-01' order by o_orderdate desc, o_orderkey limit 40), r as (select l_orderkey spill, sha256(cast(l_partkey as varchar)) hash from lineitem) select spill, hash from r where spill in (select spill from s) and substr(hash,1,1) in ('0','1')")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("spill"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("hash"))
    return st.recent_spills(t.orders.selectExpr("o_orderkey spill", "o_orderdate created_at"), rows, datetime(1995, 1, 1), 0)


@query("sample_unservable", "select key, (select min(f.hash) from v_refs f where f.action = key and f.hash not in (select hash from v_held)) first_missing from v_verdicts where verdict = 'UNSERVABLE' order by key limit 20")
def _(t: Tables) -> DataFrame:
    missing = t.refs.join(t.held.select("hash"), "hash", "left_anti")
    return st.sample_unservable(t.verdicts, missing)


@query("fleet_union", "select hash, min(bytes) as size from v_blobs where substr(hash,1,1) in ('4','5') group by hash")
def _(t: Tables) -> DataFrame:
    return st.fleet_union(t.blobs.selectExpr("lang peer", "hash", "bytes size"), 2)


@query("sync_gap", "select hash, min(bytes) as size from v_blobs where substr(hash,1,1) in ('4','5') and hash not in (select hash from v_blobs where lang = 'es') group by hash")
def _(t: Tables) -> DataFrame:
    b = t.blobs.selectExpr("lang peer", "hash", "bytes size")
    return st.sync_gap(st.fleet_union(b, 2), b.where("peer = 'es'"))


@query("split_range", "select hash, bytes, case when substr(hash,1,1) in ('0','1') then 'bank' else 'spill' end dest from v_index")
def _(t: Tables) -> DataFrame:
    return st.split_range(t.distinct_blobs, 0)


@query("same_ids", "select hash as id, 'before' side from v_index where hash in (select hash from v_blobs where doc_id % 17 = 0)")
def _(t: Tables) -> DataFrame:
    ids = t.distinct_blobs.selectExpr("hash id")
    return st.same_ids(ids, ids.join(t.blobs.where("doc_id % 17 = 0").selectExpr("hash id").distinct(), "id", "left_anti"))


# ------------------------------------------------------------------ 2H expressions


@query("normalize_tokens", f"with n as (select action, lang, {NORM_SQL} norm from v_tokens) select lang, action, norm, sha256(concat(norm, chr(0))) as key from n")
def _(t: Tables) -> DataFrame:
    n = ex.normalize_token("token")
    return t.tokens.select("lang", "action", n.alias("norm"), F.sha2(F.concat(n, F.lit("\0")), 256).alias("key"))


@query("strip_result", f"select action, {NORM_SQL} as path, 'unknown' worker from v_tokens")
def _(t: Tables) -> DataFrame:
    outs = t.tokens.select("action", F.array("token").alias("paths"), F.lit(None).cast("struct<worker:string>").alias("metadata"))
    return outs.select("action", F.element_at(ex.strip_result(F.col("paths")), 1).alias("path"), ex.served_metadata(F.col("metadata"))["worker"].alias("worker"))


@query("normalize_commands", f"select action, sha256(concat('-Copt-level=3', chr(0), {NORM_SQL}, chr(0), '-Cmetadata=__CKEY__', chr(0), lang, chr(0))) as key from v_tokens")
def _(t: Tables) -> DataFrame:
    tokens = F.array(F.lit("-Copt-level=3"), "token", F.concat(F.lit("-Cmetadata="), F.col("action").cast("string")), "lang")
    return t.tokens.select("action", ex.command_key(tokens).alias("key"))


@query("group_key", "select action, case when action % 4 = 0 then concat('root', action) else regexp_extract(token, '^(.*?__/)', 1) end as gk from v_tokens")
def _(t: Tables) -> DataFrame:
    first = F.when(F.expr("action % 4 <> 0"), F.col("token"))
    return t.tokens.select("action", ex.group_key(first, F.concat(F.lit("root"), "action")).alias("gk"))


@query("role_of", "select s_suppkey, case when s_suppkey % 3 = 0 then null when s_suppkey % 5 = 0 then 'driver' else concat('Linux-w', s_suppkey % 4) end as role, case when s_suppkey % 3 = 0 then null when s_suppkey % 5 = 0 then 'zzzz-driver' else concat('Linux-w', s_suppkey % 4) end role_order from supplier")
def _(t: Tables) -> DataFrame:
    name = F.expr("case when s_suppkey % 3 = 0 then 'cas-main' when s_suppkey % 5 = 0 then 'bank-ac-x-ac-driver' else concat('bank-ac-Linux-w', s_suppkey % 4) end")
    return t.supplier.select("s_suppkey", ex.role_of(name).alias("role"), ex.role_order(ex.role_of(name)).alias("role_order"))


@query("digest_validity", "select doc_id, doc_id % 4 <> 1 valid, case when doc_id % 4 <> 1 then case when doc_id % 4 = 2 then upper(hash) else hash end end hash, case when doc_id % 4 <> 1 then bytes end as size from v_blobs")
def _(t: Tables) -> DataFrame:
    h = F.expr("case when doc_id % 4 = 1 then substr(hash,2) when doc_id % 4 = 2 then upper(hash) else hash end")
    name = F.concat(F.lit("main/blobs/"), h, F.lit("/"), F.col("bytes").cast("string"))
    return t.blobs.select("doc_id", ex.is_digest(h).alias("valid"), ex.parse_resource(name)["hash"].alias("hash"), ex.parse_resource(name)["size"].alias("size"))


@query("epoch_seconds", "select o_orderkey, case when o_orderkey % 5 = 0 then null else cast(epoch(o_orderdate) as bigint) end secs from orders")
def _(t: Tables) -> DataFrame:
    stamp = F.expr("case when o_orderkey % 5 = 0 then date_format(o_orderdate, 'yyyy-MM-dd') else date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") end")
    return t.orders.select("o_orderkey", ex.epoch_seconds(stamp).alias("secs"))


@query("generation_gate", "select c_custkey, substr(sha256(c_name),1,8) gate from customer")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", ex.generation_gate(F.col("c_name")).alias("gate"))


# ------------------------------------------------------------------ 2I streams and their twins


def _stream(t: Tables, delay: str = "1 hour") -> DataFrame:
    raw = sm.as_stream(t.spark, _events_dir(t), t.events.schema, delay)
    return raw.selectExpr("event_id job", "user_id worker", "event_type kind", "ts", "cast(round(value*1000) as bigint) us", "event_id")


def _events_dir(t: Tables) -> str:
    """The events as files of a folder, which a stream reads."""
    path = scratch_path(t.spark, "events")
    t.events.write.parquet(path)
    return path


MINUTES = "select time_bucket(interval '60 seconds', ts) as minute, kind, count(*) n, cast(sum(us) as bigint) us from v_events group by 1, 2"


@query("minute_stats", MINUTES)
def _(t: Tables) -> DataFrame:
    return sm.minute_stats(t.log).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("minute_stats_stream", f"with m as (select max(ts) - interval '1 hour' w from events) select b.* from ({MINUTES}) b, m where minute + interval '60 seconds' <= w")
def _(t: Tables) -> DataFrame:
    got = sm.drain(sm.minute_stats(_stream(t)), t.spark, scratch_path(t.spark, "minutes"))
    last = t.events.select((F.max("ts").cast("timestamp") - F.expr("interval 1 hour")).alias("w"))
    closed = got.crossJoin(F.broadcast(last)).where("minute + interval 60 seconds <= w")  # one row
    return closed.select(F.col("minute").cast("timestamp_ntz").alias("minute"), "kind", "n", "us")


LIVE = "select peer, min(ts) joined, max(ts) + interval '5400 seconds' gone, count(*) beats from (select *, sum(new) over (partition by peer order by ts, event_id) s from (select user_id peer, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '5400 seconds' then 0 else 1 end new from events)) group by peer, s"


@query("liveness", LIVE)
def _(t: Tables) -> DataFrame:
    return sm.liveness_batch(t.events.selectExpr("user_id peer", "ts"), 5400)


@query("liveness_stream", f"with m as (select max(ts) - interval '1 hour' w from events) select b.* from ({LIVE}) b, m where gone <= w")
def _(t: Tables) -> DataFrame:
    got = sm.drain(sm.liveness(_stream(t).withColumnRenamed("worker", "peer"), "5400 seconds"), t.spark, scratch_path(t.spark, "live"))
    last = t.events.select((F.max("ts").cast("timestamp") - F.expr("interval 1 hour")).alias("w"))
    closed = got.crossJoin(F.broadcast(last)).where("gone <= w")  # one row
    return closed.select("peer", F.col("joined").cast("timestamp_ntz").alias("joined"), F.col("gone").cast("timestamp_ntz").alias("gone"), "beats")


@query("first_result_stream", "select distinct job % 4000 job from v_events")
def _(t: Tables) -> DataFrame:
    stream = _stream(t, "60 days").withColumn("job", F.expr("job % 4000"))
    return sm.drain(sm.first_result_stream(stream), t.spark, scratch_path(t.spark, "first")).select("job")


def _summaries(log: DataFrame) -> DataFrame:
    return log.selectExpr("worker peer", "cast(ts as timestamp) ts", "event_id seq", "concat(kind,':',us) holdings", "event_id % 50 = 0 leaves")


@query("latest_holdings", "select worker peer, event_id seq, case when event_id % 50 <> 0 then concat(kind,':',us) end holdings from v_events qualify row_number() over (partition by worker order by ts desc, event_id desc) = 1")
def _(t: Tables) -> DataFrame:
    return sm.latest_holdings_batch(_summaries(t.log)).select("peer", "seq", "holdings")


@query("latest_holdings_stream", "select worker peer, event_id seq, case when event_id % 50 <> 0 then concat(kind,':',us) end holdings from v_events qualify row_number() over (partition by worker order by ts desc, event_id desc) = 1")
def _(t: Tables) -> DataFrame:
    got = sm.drain(sm.latest_holdings(_summaries(_stream(t))), t.spark, scratch_path(t.spark, "latest"), "update")
    return sm.latest_holdings_batch(got.withColumn("leaves", F.lit(False))).select("peer", "seq", "holdings")


TTL_SQL = """with recursive o as (select worker as action, ts, event_id % 20 = 0 rewrite, case when event_id % 2 = 0 then 'UNSERVABLE' else 'HIT' end verdict, row_number() over (partition by worker order by ts, event_id) rn from v_events),
    walk as (select action, rn, ts, rewrite, verdict, false reused, case when not rewrite and verdict = 'UNSERVABLE' then ts + interval '7200 seconds' end ends from o where rn = 1
      union all select o.action, o.rn, o.ts, o.rewrite, o.verdict, not o.rewrite and coalesce(o.ts < w.ends, false),
        case when o.rewrite then null when coalesce(o.ts < w.ends, false) then w.ends when o.verdict = 'UNSERVABLE' then o.ts + interval '7200 seconds' else w.ends end from walk w join o on o.action = w.action and o.rn = w.rn + 1)
    select action, ts, case when reused then 'UNSERVABLE' else verdict end verdict, reused from walk where not rewrite"""


@query("negative_ttl", TTL_SQL)
def _(t: Tables) -> DataFrame:
    rows = _stream(t).selectExpr("worker action", "ts", "event_id seq", "case when event_id % 20 = 0 then 'rewrite' else 'lookup' end kind", "case when event_id % 2 = 0 then 'UNSERVABLE' else 'HIT' end verdict", "0L epoch")
    got = sm.drain(sm.negative_ttl(rows, 7200), t.spark, scratch_path(t.spark, "ttl"), "update")
    return got.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("starvation_alerts", f"select job, {AGE} age_s from v_events where kind = 'click' and job % 3 <> 0 and {AGE} > 120")
def _(t: Tables) -> DataFrame:
    log = t.log
    return sm.starvation_alerts(log.where("kind = 'click'").select("job", "ts"), log.where("job % 3 = 0").select("job"), NOW).select("job", "age_s")


def _starved_sql(kind: str) -> str:
    return f"select s.job from v_events s where s.kind = 'click' and not exists (select 1 from v_events d where d.kind = '{kind}' and d.job = s.job + 1 and d.ts >= s.ts and d.ts <= s.ts + interval '120 seconds') and s.ts < (select min(m) from (select max(ts) m from events where event_type in ('click','view') group by event_type)) - interval '2 hours'"


@query("starvation_stream", _starved_sql("view"))
def _(t: Tables) -> DataFrame:
    path, schema = _events_dir(t), t.events.schema
    s = sm.as_stream(t.spark, path, schema, "1 hour").where("event_type = 'click'").selectExpr("event_id job", "ts")
    d = sm.as_stream(t.spark, path, schema, "1 hour").where("event_type = 'view'").selectExpr("event_id - 1 job", "ts")
    got = sm.drain(sm.starvation_stream(s, d), t.spark, scratch_path(t.spark, "starved"))
    ends = t.events.where("event_type in ('click','view')").groupBy("event_type").agg(F.max("ts").cast("timestamp").alias("m"))
    last = ends.select((F.min("m") - F.expr("interval 2 hours")).alias("w"))
    return got.crossJoin(F.broadcast(last)).where("ts < w").select("job")  # one row


@query("stragglers", f"select job, {AGE} age_s from v_events where kind = 'click' and job % 3 <> 0 and job % 5 <> 0 and job % 7 <> 0 and {AGE} >= 10")
def _(t: Tables) -> DataFrame:
    log = t.log
    started = log.where("kind = 'click'").selectExpr("job", "ts", "case when job % 7 = 0 then 1 end affinity")
    return sm.stragglers(started, log.where("job % 3 = 0").select("job"), log.where("job % 5 = 0").select("job"), NOW).select("job", "age_s")


@query("acks_by_deadline", "with s as (select user_id as signal, min(ts) ts from events group by 1) select s.signal, count(distinct a.event_id % 8) shards from s left join events a on a.user_id = s.signal and a.ts between s.ts and s.ts + interval '86400 seconds' group by 1")
def _(t: Tables) -> DataFrame:
    e = t.events
    return sm.acks_by_deadline(e.groupBy(F.col("user_id").alias("signal")).agg(F.min("ts").alias("ts")), e.selectExpr("user_id signal", "ts", "event_id % 8 shard"), 86400)


@query("quorum_latch", "select event_id as event, sum(new) over (partition by kind order by ts, event_id) >= 20 formed from (select *, case when row_number() over (partition by kind, worker order by ts, event_id) = 1 then 1 else 0 end new from v_events)")
def _(t: Tables) -> DataFrame:
    return sm.quorum_latch(t.log.selectExpr("kind fleet", "ts", "event_id event", "worker"), 20).select("event", "formed")


@query("incremental_publish", "select hash as id, bytes from v_index where substr(hash,1,1) in ('0','1')")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "publish")
    t.distinct_blobs.write.parquet(f"{path}/in")

    def publish(batch: DataFrame, number: int) -> None:
        empty = batch.sparkSession.createDataFrame([], "id string")
        head = batch.sparkSession.createDataFrame([], "lineage string, bytes bigint, `full` boolean")
        out = jb.publish_blobs(batch, head, empty, head.selectExpr("lineage", "bytes delta_restore_secs", "lineage oldest"), "main", 0, 50_000, POLICY_NOW, "absent")
        jb.publish_generation(out, f"{path}/gen-{number}", "main", number)

    sm.incremental_publish(t.spark.readStream.schema("hash string, bytes bigint").parquet(f"{path}/in"), publish, path)
    written = [tb.read_generation(t.spark, f"{path}/{n}", "id string, bytes bigint") for n in children(t.spark, path) if n.startswith("gen-")]
    return reduce(DataFrame.unionByName, written)


# ------------------------------------------------------------------ 2K jobs


def _bank(t: Tables) -> dict[str, DataFrame]:
    """A blob bank from documents: lineage = language, segment = source."""
    payload = t.blobs.select(F.concat("lang", F.lit(":"), "source").alias("segment"), "hash", "bytes")
    segments = t.segments.withColumn("segment", F.concat("lineage", F.lit(":"), "segment")).withColumn("container", F.concat(F.lit("cas-manifest-F-r"), F.length("segment") % 9))
    spills = t.blobs.groupBy(F.col("source").alias("spill")).agg(F.max("doc_id").alias("created_at"))
    rows = t.blobs.where("lang = 'fr'").selectExpr("source spill", "hash", "bytes")
    return {"payload": payload, "segments": segments, "artifacts": fl.provenance_filter(t.artifacts, "F"), "spills": spills, "spill_rows": rows}


def _restored(t: Tables) -> dict[str, DataFrame]:
    b = _bank(t)
    return jb.restore_blobs(b["segments"], b["payload"], b["artifacts"], "en", "de", 0, b["spills"], b["spill_rows"])


RESTORED_SQL = """names as (select distinct name from v_artifacts where not expired and head_branch = 'F' and same_repo),
    live as (select lineage, segment from v_segments where lineage in ('en','de') and (prefixes like '%0%' or prefixes like '%1%') and concat('cas-manifest-F-r', length(concat(lineage,':',segment)) % 9) in (select name from names)),
    spills as (select source from v_blobs group by source order by max(doc_id) desc, source limit 40),
    got as (select hash, min(bytes) bytes from v_blobs b where exists (select 1 from live l where l.lineage = b.lang and l.segment = b.source) group by hash),
    blobs as (select * from got union all select hash, min(bytes) from v_blobs where lang = 'fr' and source in (select source from spills) and substr(hash,1,1) in ('0','1') and hash not in (select hash from got) group by hash)"""


@query("restore_blobs", f"with {RESTORED_SQL} select * from blobs")
def _(t: Tables) -> DataFrame:
    return _restored(t)["blobs"]


def _published(t: Tables) -> dict[str, DataFrame]:
    banked = t.blobs.where("doc_id % 3 = 0").selectExpr("hash id").distinct()
    heads = t.segments.where("lineage = 'en'")
    evidence = heads.groupBy("lineage").agg(F.lit(1).alias("delta_restore_secs"), F.lit(None).cast("string").alias("oldest"))
    return jb.publish_blobs(t.distinct_blobs, heads, banked, evidence, "en", 0, 20_000, POLICY_NOW)


PUBLISH_ITEMS = "select hash as id, bytes as size from v_index where substr(hash,1,1) in ('0','1') and hash not in (select hash from v_blobs where doc_id % 3 = 0)"
META_SQL = "select prefix, segment_no, count(*) blobs, cast(sum(size) as bigint) bytes, prefix as prefixes, concat('seg-', substr(sha256(string_agg(concat(id, chr(10)), '' order by id)),1,16)) as name, false as \"full\" from packed group by 1, 2"


def _walk(items: str, meta: str, cap: int = 20_000) -> str:
    packed = pack_sql(items, "substr(id,1,1)", f"w.acc + o.size > {cap}")
    at = packed.rindex("select id, size, prefix")
    return f"{packed[:at].rstrip()}, packed as ({packed[at:]}) {meta}"


@query("publish_blobs", _walk(PUBLISH_ITEMS, META_SQL))
def _(t: Tables) -> DataFrame:
    return _published(t)["segments"]


def _row_restore(t: Tables) -> DataFrame:
    rows = t.versions.selectExpr("path", "content_hash", "cast(l_suppkey as string) segment", "qty % 3 exit_code")
    return jb.restore_rows(rows, _apply_plan(t))


@query("restore_rows", f"select path, content_hash, source, code as exit_code from ({ORDER_SQL}) join (select content_hash, max(qty % 3) code from v_versions group by 1) using (content_hash) where code = 0")
def _(t: Tables) -> DataFrame:
    return _row_restore(t)


def _row_publish(t: Tables) -> dict[str, DataFrame]:
    rows = t.versions.selectExpr("path", "content_hash", "cast(length(content) as bigint) bytes", "case when qty % 5 = 0 then 1 else 0 end exit_code", "l_orderkey")
    return jb.publish_rows(rows, rows.where("l_orderkey % 2 = 0"), 7, "driver", 100_000)


@query("publish_rows", "with o as (select path, content_hash, 0 as seq from v_versions where l_orderkey % 2 = 0 union all select path, content_hash, 1 from v_versions where qty % 5 <> 0 and (path, content_hash) not in (select path, content_hash from v_versions where l_orderkey % 2 = 0)) select path, content_hash hash from o qualify row_number() over (partition by path order by seq desc, content_hash desc) = 1")
def _(t: Tables) -> DataFrame:
    return _row_publish(t)["ids"]


@query("restore_kv", f"with kv as ({KV_SQL}) select key_hi, key_lo from kv where key_lo % 2 = 0 or shard < 8")
def _(t: Tables) -> DataFrame:
    kv = tb.read_kv_export(t.kv_lines)
    segments = kv.groupBy("shard").agg(F.count("*").alias("bytes")).selectExpr("case when shard < 8 then 1 else 0 end lineage_rank", "substr(sha2('seed',256),1,8) gate", "concat('k',shard) segment", "concat('cas-manifest-F-r',shard % 8) container", "bytes")
    payload = kv.select(F.concat(F.lit("k"), "shard").alias("segment"), "key_hi", "key_lo")
    return jb.restore_kv(kv.where("key_lo % 2 = 0").select("key_hi", "key_lo"), segments, payload, t.artifacts.where("not expired"), "seed")


@query("publish_kv", pack_sql(f"select * from ({KV_ITEMS}) where cast(split_part(id,' ',2) as bigint) % 4 <> 0", "shard", "w.acc >= 4096"))
def _(t: Tables) -> DataFrame:
    kv = tb.read_kv_export(t.kv_lines)
    return jb.publish_kv(kv, kv.where("key_lo % 4 = 0"), 4096).select("id", "size", "prefix", "segment_no")


@query("restore_all", f"with {RESTORED_SQL}, rows_ as (select * from ({ORDER_SQL}) join (select content_hash, max(qty % 3) code from v_versions group by 1) using (content_hash) where code = 0) select (select count(*) from blobs) blobs, (select count(*) from rows_) as rows, (select count(*) from documents) verified, 0::bigint rejected, (select count(*) from blobs) > 0 or (select count(*) from rows_) > 0 warm")
def _(t: Tables) -> DataFrame:
    return jb.restore_all(_restored(t), _row_restore(t), t.documents.selectExpr("sha2(text,256) name", "text content"))


ROW_ITEMS = "select distinct concat(substr(md5(concat(path,' ',content_hash)),1,4),'|',path,' ',content_hash) as id, length(content) as size, 'ac' bank from v_versions where qty % 5 <> 0 and (path, content_hash) not in (select path, content_hash from v_versions where l_orderkey % 2 = 0)"
def _all_sql(most: int = 1 << 20) -> str:
    """Segments of both banks; a bank with more than ``most`` items under a digit takes longer prefixes."""
    length = lambda longest: "1" + "".join(f" + (count(*) over () > {most * 16**i})::int" for i in range(longest - 1) if most * 16**i < 1 << 62)
    banks = f"select id, size, 'cas' bank, {length(16)} len from ({PUBLISH_ITEMS}) union all select id, size, bank, {length(4)} from ({ROW_ITEMS})"
    packed = pack_sql(banks, "bank || substr(id,1,len)", "w.acc + o.size > case when w.prefix like 'cas%' then 20000 else 100000 end")
    return f"{packed[: packed.rindex('select id, size, prefix')].rstrip()}, packed as (select id, size, prefix, segment_no from walk) {ALL_META}"


ALL_META = "select case when prefix like 'cas%' then 'cas' else 'ac' end bank, concat('seg-', substr(sha256(string_agg(concat(id, chr(10)), '' order by id)),1,16)) as name, count(*) blobs, cast(sum(size) as bigint) bytes, case when prefix like 'cas%' then substr(prefix,4,1) else '*' end prefixes, false as \"full\" from packed group by prefix, segment_no"


@query("publish_all", _all_sql())
def _(t: Tables) -> DataFrame:
    return jb.publish_all(_published(t), _row_publish(t))


def _unpivot(names: list[str], suffix: str, table: str) -> str:
    return " union all ".join(f"select concat('{n}', {suffix}) metric, cast({n} as bigint) as value from {table}" for n in names)


LAP_SQL = f"""with l as (select verdict, n_refs, key, key % 1000 us from v_verdicts),
    c as (select count_if(verdict = 'HIT') hits, count_if(verdict = 'MISS') misses, count_if(verdict = 'UNSERVABLE') unservable, coalesce(sum(case when verdict = 'HIT' then n_refs end),0) bytes, count_if(verdict = 'HIT' and key % 2 = 0) hit_ok, count_if(verdict = 'HIT' and key % 2 <> 0) hit_failed, count_if(verdict = 'HIT') = 0 and count_if(verdict = 'MISS') > 0 tripwire from l),
    d as (select cast(worker as varchar) worker, count(*) jobs from v_events where job % 6 = 0 group by 1 union all select '*', count(*) from v_events where job % 6 = 0),
    p as ({LATENCY_SQL.replace("select kind verdict", "select verdict").replace("from v_events group by kind", "from l group by verdict")}),
    q as (select kind os, count(*) queued, max({AGE}) oldest_s, max({AGE}) > 120 starved from v_events group by kind),
    s as (select worker, {SOURCE} source, count(*) fetches from v_events group by 1, 2),
    w as (select w.worker, x.source, coalesce(s.fetches,0) fetches from (select distinct worker from v_events) w cross join (select unnest(['local','peer','driver']) source) x left join s on s.worker = w.worker and s.source = x.source),
    i as (select l_partkey hash, p_size as size, l_orderkey % 100 + 1 peer from lineitem join part on l_partkey = p_partkey),
    m as (select coalesce(sum(size) filter (where not exists (select 1 from v_holdings h where h.peer = i.peer and h.hash = i.hash)),0) moved, sum(size) total from i),
    o as (select moved, total, floor(total * 99 / 100.0) baseline, moved * 2 > total * 99 / 100.0 regressed from m)
    {_unpivot(["hits", "misses", "unservable", "bytes", "hit_ok", "hit_failed", "tripwire"], "''", "c")} union all {_unpivot(["jobs"], "':', worker", "d")} union all {_unpivot(["n", "p50", "p90", "p99", "max"], "':', verdict", "p")}
    union all {_unpivot(["queued", "oldest_s", "starved"], "':', os, ':*'", "q")} union all {_unpivot(["fetches"], "':', worker, ':', source", "w")} union all {_unpivot(["moved", "total", "baseline", "regressed"], "''", "o")}"""


@query("lap_report", LAP_SQL)
def _(t: Tables) -> DataFrame:
    lookups = t.verdicts.selectExpr("verdict", "n_refs bytes", "key % 2 exit_code", "key % 1000 us")
    dispatched = tb.parse_build_log(t.events.select(F.expr(LOG_LINE).alias("value"))).where("kind = 'dispatch'")
    age = (F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("age_s")
    jobs = t.log.select(F.col("kind").alias("os"), F.lit("").alias("arch"), "job", age)
    inputs = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_orderkey action", "l_partkey hash", "p_size size")
    moved = agg.off_node_bytes(t.orders.selectExpr("o_orderkey action", "o_orderkey % 100 + 1 peer"), inputs, t.holdings, 100)
    return jb.lap_report(lookups, 1, dispatched, jobs, t.log.selectExpr("worker", f"{SOURCE} source"), moved)


@query("verdict_counts", "select verdict, count(*) n from v_verdicts group by verdict")
def _(t: Tables) -> DataFrame:
    return t.verdicts.groupBy("verdict").agg(F.count("*").alias("n"))


# The rest of the queries registers itself with those above.
from cachelake import catalog_banks, catalog_streams  # noqa: E402, F401
