"""Exact top-k search: a KD-tree per shard, walked best-first.

A top tree, fitted to a bounded sample, deals vectors to shards of near ones.
Each query is first searched in its own shard; then only in those whose tight
box may hold a score as high as the k-th that it has by then.  That is decided
before anything is sent, from a table with a bounded number of boxes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cachelake.llm.common import chunks_of_rows, shuffle_partitions, stage

LEAF = 512
BLOCK = 512
#: The top tree: sampled rows, most shards with boxes of their own.
SAMPLE_ROWS, MOST_BOXES = 1 << 15, 1 << 12
LOW = -(2**63)


class KDTree:
    """Median splits along the widest dimension, with tight boxes.  ``points``
    are kept in the order of the leaves; ``order`` tells where they came from."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, int, int]] = []  # start, end, left child, right child
        self.splits: list[tuple[int, float]] = []  # axis, first value on the right
        low, high = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            me = len(self.nodes)
            own = points[self.order[lo:hi]]
            low.append(own.min(0))
            high.append(own.max(0))
            self.nodes.append((lo, hi, -1, -1))
            self.splits.append((0, 0.0))
            if parent >= 0:
                s, e, a, b = self.nodes[parent]
                self.nodes[parent] = (s, e, me, b) if side == 0 else (s, e, a, me)
            width = high[-1] - low[-1]
            if hi - lo > leaf and width.max() > 0:
                axis = int(np.argmax(width))
                mid = (hi - lo) // 2
                part = np.argpartition(own[:, axis], mid)
                self.order[lo:hi] = self.order[lo:hi][part]
                self.splits[me] = axis, float(own[part[mid], axis])
                todo += [(lo + mid, hi, me, 1), (lo, lo + mid, me, 0)]
        self.low, self.high = np.array(low), np.array(high)
        self.points = points[self.order]

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf on whose side of all splits each point lies, numbered in order."""
        out = np.zeros(len(points), np.int32)
        todo, n = [(0, np.arange(len(points)))], 0
        while todo:
            node, who = todo.pop()
            _, _, left, right = self.nodes[node]
            if left < 0:
                out[who] = n
                n += 1
                continue
            axis, value = self.splits[node]
            upper = points[who, axis] >= value
            todo += [(right, who[upper]), (left, who[~upper])]
        return out

    def leaf_bounds(self, queries: np.ndarray, least: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Leaves, and the largest inner product that each query may have in
        each of them: LOW where a box on the way there rules it out."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        leaves, bounds = [], []
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, who = todo.pop()
            most = up[who] @ self.high[node] + down[who] @ self.low[node]
            able = most >= least[who]
            if not able.any():
                continue
            _, _, left, right = self.nodes[node]
            if left < 0:
                row = np.full(len(queries), LOW, most.dtype)
                row[who[able]] = most[able]
                leaves.append(node)
                bounds.append(row)
            else:
                todo += [(right, who[able]), (left, who[able])]
        return leaves, np.array(bounds).T if bounds else np.zeros((len(queries), 0), queries.dtype)


def search(tree: KDTree, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query as query numbers, scores and ids, in order;
    ``least`` is the score that a candidate has to reach.

    ``ids`` and ``rows`` are those of ``tree.points``; a query's own row isn't
    its candidate.  Each query opens its next-best leaf, against the k-th score
    that it has found so far, until no leaf left can reach that.
    """
    everyone = np.arange(len(queries))
    asker, score, place = np.zeros(0, np.int64), np.zeros(0, queries.dtype), np.zeros(0, np.int64)
    least = least.astype(queries.dtype)
    leaves, bounds = tree.leaf_bounds(queries, least)
    turn = np.argsort(-bounds, axis=1, kind="stable")
    for step in range(len(leaves)):
        at = turn[:, step]
        bound = bounds[everyone, at]
        active = np.flatnonzero((bound >= least) & (bound > LOW))
        if not len(active):
            break
        active = active[np.argsort(at[active], kind="stable")]
        found = [(asker, score, place)]
        for who in np.split(active, np.flatnonzero(np.diff(at[active])) + 1):
            lo, hi, _, _ = tree.nodes[leaves[at[who[0]]]]
            product = queries[who] @ tree.points[lo:hi].T
            floor = least[who]
            if hi - lo > k + 1:  # its own row may be among the k + 1 best
                new = np.flatnonzero(floor == least.dtype.type(LOW))
                if len(new):
                    floor[new] = np.partition(product[new], -(k + 1), axis=1)[:, -(k + 1)]
            q, c = np.nonzero(product >= floor[:, None])
            found.append((who[q], product[q, c], lo + c))
        asker, score, place = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = rows[place] != own[asker]
        asker, score, place = asker[keep], score[keep], place[keep]
        order = np.lexsort((place, ids[place], -score, asker))
        asker, score, place = asker[order], score[order], place[order]
        first = np.searchsorted(asker, everyone)
        keep = np.arange(len(asker)) - first[asker] < k
        asker, score, place = asker[keep], score[keep], place[keep]
        n = np.bincount(asker, minlength=len(queries))
        last = np.cumsum(n) - 1
        full = n == k
        least[full] = np.maximum(least[full], score[last[full]])
    return asker, score, ids[place]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def _padded(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of ``dim`` doubles; shorter ones end in zeros."""
    n = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(n), dim))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = np.asarray(column.flatten())
    return out


def _number(most: float) -> type:
    """The fastest type in which all sums up to ``most`` are exact."""
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def top_k(vectors: DataFrame, is_query: str, k: int = 20, scale: int = 64, shard_rows: int = 1 << 17, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query``
    holds, the ``k`` other vectors with the largest inner product.

    Components count as floor(scale * x), so scores are exact; they have to
    fit 64 bits.  Ties go to the smaller id.  A query's candidates are all rows
    but its own; of repeated rows each is a query and a candidate.  Vectors
    that are null or have null or non-finite components take no part; vectors
    of different lengths aren't compared; null ids take no part; other columns
    are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    x = F.col(vector)
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))) & F.col(vec_id).isNotNull()
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    base = vectors.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"), F.coalesce(F.expr(is_query), F.lit(False)).alias("asks"))
    # Rows are numbered once, in a table that is written.
    base = stage(base.withColumn("row", F.monotonically_increasing_id()), "vectors")
    count, dim = base.agg(F.count("*"), F.max(F.size("v"))).first()
    shards = min(max(shuffle_partitions(spark), -(-count // shard_rows)), MOST_BOXES)
    # A bounded sample fits the splits only; all rows are dealt by them.
    sample = base.orderBy(F.xxhash64("row")).limit(SAMPLE_ROWS).select("v").toArrow()["v"].combine_chunks()
    top = KDTree(_padded(sample, dim or 0), max(1, -(-len(sample) // shards))) if count and dim else None
    top_tree = spark.sparkContext.broadcast(top)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks_of_rows(batches):
            shard = top_tree.value.leaf_of(_padded(batch.column(1), dim)) if top_tree.value else np.zeros(batch.num_rows, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], names=["vec_id", "v", "asks", "row", "shard"])

    dealt = base.mapInArrow(deal, "vec_id long, v array<long>, asks boolean, row long, shard int")
    # Splits can't part equal vectors: shards of too many rows are cut by row.
    per = dealt.groupBy("shard").agg(F.count("*").alias("n"))
    sizes = {r.shard: max(1, -(-r.n // (2 * max(1, -(-count // shards))))) for r in per.collect()}  # at most MOST_BOXES
    starts = dict(zip(sizes, np.cumsum([0, *sizes.values()]).tolist(), strict=False))
    shards = max(1, sum(sizes.values()))
    parts = spark.createDataFrame([(s, starts[s], sizes[s]) for s in sizes], "shard int, start int, parts int")
    dealt = dealt.join(F.broadcast(parts), "shard").withColumn("shard", (F.col("start") + F.pmod(F.xxhash64("row"), "parts")).cast("int")).drop("start", "parts")
    dealt = stage(dealt.select("vec_id", "v", "asks", "row", "shard"), "dealt-vectors")
    least = F.lit(LOW + 1).cast("long")
    candidates = dealt.select("shard", F.lit(0).alias("kind"), "row", "vec_id", "v", least.alias("least"))
    asked = dealt.where("asks").select("shard", "row", "vec_id", "v")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, trees = None, [], {}
        for batch in batches:
            at = np.asarray(batch.column(0))
            kind = np.asarray(batch.column(1))
            dims = np.diff(np.asarray(batch.column(4).offsets))
            mark = np.stack([at, kind, dims])
            cut = np.flatnonzero((np.diff(mark, axis=1) != 0).any(0)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(at)], strict=True):
                if hi == lo:
                    continue
                part, width = batch.slice(lo, hi - lo), int(dims[lo])
                if at[lo] != shard:
                    shard, held, trees = at[lo], [], {}
                vec, row, ids = _matrix(part.column(4), width), np.asarray(part.column(2)), np.asarray(part.column(3))
                if kind[lo] == 0:
                    held.append((width, ids, row, vec))
                    continue
                if not trees:
                    for d in {h[0] for h in held}:
                        trees[d] = [np.concatenate([h[j] for h in held if h[0] == d]) for j in (1, 2, 3)] + [None]
                    held = []
                if width not in trees:
                    continue
                most = float(np.abs(trees[width][2]).max(initial=0)) * float(np.abs(vec).max(initial=0)) * max(width, 1)
                tree = trees[width][3]
                if tree is None or tree.points.dtype != _number(most):
                    tree = KDTree(trees[width][2].astype(_number(most)))
                    trees[width][3] = tree
                    own_ids, own_rows = trees[width][0][tree.order], trees[width][1][tree.order]
                for b in range(0, len(vec), BLOCK):
                    some = slice(b, b + BLOCK)
                    asker, score, found = search(tree, own_ids, own_rows, vec[some].astype(tree.points.dtype), row[some], np.asarray(part.column(5))[some], k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row[some][asker]), pa.array(ids[some][asker]), pa.array(found), pa.array(score.astype(np.int64))], names=["row", "query_id", "vec_id", "score"]
                    )

    def searched(queries: DataFrame) -> DataFrame:
        both = candidates.unionByName(queries.select("shard", F.lit(1).alias("kind"), "row", "vec_id", "v", "least"))
        # Candidates of a shard come before its queries, which then stream by.
        order = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", F.size("v"))
        return order.mapInArrow(run, "row long, query_id long, vec_id long, score long")

    first = stage(searched(asked.withColumn("least", least)), "top-own-shard")
    every = first
    if shards > 1:
        kth = first.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        boxes = spark.sparkContext.broadcast(_boxes(dealt, shards, dim))

        def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high = boxes.value
            for batch in chunks_of_rows(batches):
                vec, home, need = _padded(batch.column(2), dim), np.asarray(batch.column(3)), np.asarray(batch.column(4)).astype(float)
                bound = np.maximum(vec, 0) @ high.T + np.minimum(vec, 0) @ low.T
                # Sums beyond 2^53 aren't exact here.
                able = bound + 1e-9 * np.abs(bound) >= need[:, None]
                able[np.arange(len(home)), home] = False
                q, s = np.nonzero(able)
                some = batch.take(pa.array(q))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), some.column(4), pa.array(s.astype(np.int32))], names=["row", "vec_id", "v", "least", "shard"])

        known = asked.join(kth, "row", "left").select("row", "vec_id", "v", "shard", F.coalesce("kth", least).alias("least"))
        every = first.unionByName(searched(known.mapInArrow(spread, "row long, vec_id long, v array<long>, least long, shard int")))
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _boxes(dealt: DataFrame, shards: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Tight boxes of all shards (at most MOST_BOXES); an empty shard's box
    holds nothing."""

    def box(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            vec, shard = _padded(batch.column(1), dim), np.asarray(batch.column(0))
            for s in np.unique(shard):
                own = vec[shard == s]
                low, high = found.get(s, (own[0], own[0]))
                found[s] = [np.minimum(low, own.min(0)), np.maximum(high, own.max(0))]
        if found:
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), *(pa.array([b[j] for b in found.values()], kind) for j in (0, 1))], names=["shard", "low", "high"])

    ddl = "shard int, low array<double>, high array<double>"
    table = dealt.select("shard", "v").mapInArrow(box, ddl).repartition("shard").mapInArrow(_joined_boxes, ddl).toArrow()
    low, high = np.full((shards, dim), np.inf), np.full((shards, dim), -np.inf)
    for s, a, b in zip(*(table[c].to_pylist() for c in ("shard", "low", "high")), strict=True):
        low[s], high[s] = a, b
    # No query reaches an empty box.
    empty = np.isinf(low).any(1)
    low[empty], high[empty] = 1e300, -1e300
    return low, high


def _joined_boxes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list[list[float]]] = {}
    for batch in batches:
        for s, low, high in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
            a, b = found.get(s, (low, high))
            found[s] = [np.minimum(a, low), np.maximum(b, high)]
    if found:
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), *(pa.array([b[j] for b in found.values()], kind) for j in (0, 1))], names=["shard", "low", "high"])


TOP_K_SQL = """
WITH r AS (SELECT row_number() OVER () AS id, vec_id, embedding FROM embeddings), v AS (
  SELECT id, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM r
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.id, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.id <> q.id
)
SELECT query_id, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
