"""Ranked lexical search by bit-sliced Bloom signatures.

Documents of similar size are rows of a block; each has a Bloom filter of its
terms, and of each term at the powers of two that its count exceeds.  A block is
kept by slices: bit b of all its documents side by side.  A query's term is the
conjunction of a few slices, a bitmap that overestimates which documents have
it, and as often as that; the weighted sum of these bitmaps bounds every
document's score from above.  Documents whose bound reaches the k-th score of
some that were scored are scored exactly from their texts; all others are
proved to be outside.

Signatures don't depend on queries; they are built in one pass over the texts
and are a fraction of their size.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cachelake.llm.common import chunks, hash_spans, may_be_among, mix, stage, text_buffer, word_spans

BITS, HASHES = 16, 4  # a term taken for present by mistake: 0.24 %
BLOCK_DOCS, BLOCK_CELLS, SPREAD = 2048, 8 << 20, 1.5
CHUNK = 4 << 20
ITEM_BYTES = 1 << 20
SEEDS = 16
CELLS = 4 << 20
BLOCKS = (
    "docs long, terms long, ids array<bigint>, lengths array<bigint>, first_keys array<bigint>, second_keys array<bigint>, width int, slices binary"
)
_LEVEL, _OTHER = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_LOW = np.uint64(0xFFFFFFFF)

#: Bytes that separate terms: all of ASCII but digits and letters.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[:128] = [not chr(b).isalnum() for b in range(128)]


# ---------------------------------------------------------------- terms


def count_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each text: their hashes and counts, each text's first
    of them (one entry more than texts), and each text's number of terms."""
    data, offsets = text_buffer(texts)
    starts, ends, rows = word_spans(data, offsets, SEPARATORS)
    hashes = hash_spans(data, starts, ends)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[rows[:-1][rows[:-1] < len(hashes)]] = True
    at = np.flatnonzero(new)
    return hashes[at], np.diff(np.append(at, len(hashes))), np.searchsorted(at, rows), np.diff(rows)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """How many levels a count reaches: level 0, and level j if over 2^(j-1)."""
    return 1 + np.frexp(counts - 1.0)[1]


def places(hashes: np.ndarray, levels: np.ndarray | int, width: int) -> Iterator[np.ndarray]:
    """The slices of terms at their levels."""
    x = mix(hashes + (np.atleast_1d(levels).astype(np.uint64) + np.uint64(1)) * _LEVEL)
    a, b = x >> np.uint64(32), (x & _LOW) | np.uint64(1)
    for i in range(HASHES):
        yield ((((a + np.uint64(i) * b) & _LOW) * np.uint64(width)) >> np.uint64(32)).astype(np.int64)


def gains(lengths: np.ndarray, m: np.ndarray, level: int) -> np.ndarray:
    """A term's largest share of its weight at a level."""
    tf = np.minimum(1 << level, lengths)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def length_norm(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 75 + (75 n N) div L, without leaving 64 bits."""
    x = 75 * lengths.astype(np.int64)
    if n_docs and int(x.max(initial=0)) > (1 << 62) // n_docs:
        return 25 + np.array([int(v) * n_docs // n_terms for v in x], np.int64)
    return 25 + x * n_docs // n_terms


# ---------------------------------------------------------------- signatures


def signature_blocks(docs: DataFrame) -> DataFrame:
    """Signatures of ``doc_id, text``: a row for each block.

    ``docs`` and ``terms`` count what is in it; ``ids``, ``lengths`` (in terms)
    and two keys of the terms and their counts are in the order of its bitmaps'
    bits.  Documents without terms are in none.  Blocks are cut within a chunk
    of texts by size, so that the widest filter is at most half as wide again
    as the narrowest one needs; a chunk is all that a task holds.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch in chunks(batches, "text", CHUNK):
            hashes, counts, first, lengths = count_terms(batch.column(1))
            if not len(hashes):
                continue
            levels = levels_of(counts)
            filled = np.flatnonzero(lengths)
            begin = first[:-1][filled]
            sizes = np.add.reduceat(levels, begin)
            keys = [np.add.reduceat(mix(hashes * _OTHER + counts.astype(np.uint64) * k), begin).view(np.int64) for k in (_LEVEL, _OTHER)]
            by = np.argsort(sizes, kind="stable")
            lo = 0
            while lo < len(by):
                hi = min(int(np.searchsorted(sizes[by], SPREAD * sizes[by[lo]] + 8, "right")), lo + BLOCK_DOCS)
                while hi > lo + 8 and BITS * int(sizes[by[hi - 1]]) * (hi - lo) > BLOCK_CELLS:
                    hi = lo + max(8, (hi - lo) // 2)
                rows, lo = by[lo:hi], hi
                width = BITS * int(sizes[rows[-1]])
                cells = np.zeros((width, -(-len(rows) // 8) * 8), bool)
                spans = np.diff(first)[filled][rows]
                at = np.repeat(begin[rows] - np.append(0, np.cumsum(spans)[:-1]), spans) + np.arange(spans.sum())
                reach = levels[at]
                level = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
                column = np.repeat(np.repeat(np.arange(len(rows)), spans), reach)
                for place in places(np.repeat(hashes[at], reach), level, width):
                    cells[place, column] = True
                own = pa.array(filled[rows])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([len(rows)]), pa.array([int(lengths[filled[rows]].sum())]), _one(batch.column(0).take(own)), _one(pa.array(lengths[filled[rows]])),
                        _one(pa.array(keys[0][rows])), _one(pa.array(keys[1][rows])), pa.array([width], pa.int32()), pa.array([np.packbits(cells, axis=1).tobytes()], pa.binary()),
                    ],
                    names=["docs", "terms", "ids", "lengths", "first_keys", "second_keys", "width", "slices"],
                )

    return _plain(docs).mapInArrow(work, BLOCKS)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _one(values: pa.Array) -> pa.Array:
    """A list array with ``values`` as its only row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


# ---------------------------------------------------------------- queries


@dataclass
class Queries:
    """A bounded block of items: distinct terms, and each item's terms."""

    ids: list  # item ids, in the order of the items' numbers
    terms: np.ndarray  # sorted hashes
    starts: np.ndarray  # each item's first entry, one more than items
    entries: np.ndarray  # terms' indices
    times: np.ndarray  # and how often the item has them
    weights: np.ndarray | None = None
    n_docs: int = 0
    n_terms: int = 0

    def slabs(self, docs: int) -> Iterator[tuple[int, int]]:
        """Spans of items whose entries fill no more than CELLS for ``docs``."""
        lo, n = 0, len(self.starts) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.starts, self.starts[lo] + CELLS // docs, "right")) - 1)
            yield lo, hi
            lo = hi


def read_items(items: pa.Table) -> Queries:
    hashes, counts, first, _ = count_terms(items["text"].combine_chunks())
    terms, entries = np.unique(hashes, return_inverse=True)
    return Queries(items["item_id"].to_pylist(), terms, first, entries.astype(np.int64), counts)


def weigh(queries: Queries, frequencies: dict[int, int], n_docs: int, n_terms: int) -> Queries:
    """Terms with their weights; those that no document has, or that weigh
    nothing, go."""
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequencies[i] + 1))) if i in frequencies else 0 for i in range(len(queries.terms))], np.int64)
    kept = weight > 0
    number = np.cumsum(kept) - 1
    stays = kept[queries.entries]
    starts = np.append(0, np.cumsum(stays))[queries.starts]
    return Queries(queries.ids, queries.terms[kept], starts, number[queries.entries[stays]], queries.times[stays], weight[kept], n_docs, n_terms)


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """``term, n``: how many documents have each of the sorted ``terms``, by
    index.  Each task adds up its own before anything is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for _, batch in chunks(batches, "text", CHUNK):
            hashes, *_ = count_terms(batch.column(1))
            at = np.minimum(np.searchsorted(shared.value, hashes), len(total) - 1)
            total += np.bincount(at[shared.value[at] == hashes], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    return _plain(docs).mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Block:
    """One row of ``signature_blocks`` against weighed queries."""

    def __init__(self, batch: pa.RecordBatch, row: int, queries: Queries):
        field = {name: batch.column(i)[row] for i, name in enumerate(batch.schema.names)}
        self.ids, self.keys = field["ids"].values, (field["first_keys"].values, field["second_keys"].values)
        lengths = np.asarray(field["lengths"].values)
        self.docs, self.queries = len(lengths), queries
        width = field["width"].as_py()
        slices = np.frombuffer(field["slices"].as_buffer(), np.uint8).reshape(width, -1)
        m = length_norm(lengths, queries.n_docs, queries.n_terms)
        #: For each level: which terms any document may have at it, their bitmaps, and what each document gains.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        terms, before, gained = np.arange(len(queries.terms)), None, np.zeros(self.docs, np.int64)
        while len(terms) and 1 << len(self.levels) < 2 * lengths.max() + 1:  # a count is a length at most
            bits = before
            for place in places(queries.terms[terms], len(self.levels), width):
                bits = slices[place] if bits is None else bits & slices[place]
            some = bits.any(1)
            terms, before = terms[some], bits[some]
            now = gains(lengths, m, len(self.levels))
            if len(terms):
                self.levels.append((terms, np.unpackbits(before, axis=1, count=self.docs), now - gained))
            gained = now

    def bounds(self) -> Iterator[tuple[int, np.ndarray]]:
        """Upper bounds of all documents' scores, for one span of items after
        another: the first item's number, and items by documents."""
        q = self.queries
        for lo, hi in q.slabs(self.docs):
            total = np.zeros((hi - lo, self.docs), np.int64)
            a, b = q.starts[lo], q.starts[hi]
            owner = np.repeat(np.arange(hi - lo), np.diff(q.starts[lo : hi + 1]))
            worth = (q.weights[q.entries[a:b]] * q.times[a:b]).astype(np.int64)
            for terms, bits, gain in self.levels:
                at = np.minimum(np.searchsorted(terms, q.entries[a:b]), len(terms) - 1)
                here = np.flatnonzero(terms[at] == q.entries[a:b])
                if len(here):
                    first = np.flatnonzero(np.append(True, owner[here][1:] != owner[here][:-1]))
                    total[owner[here][first]] += np.add.reduceat(worth[here, None] * bits[at[here]], first, axis=0) * gain
            yield lo, total


def best_bounds(blocks: DataFrame, queries: Queries, seeds: int) -> DataFrame:
    """``item, doc_id, bound``: each task's ``seeds`` largest bounds for each
    item (by its number)."""
    shared = blocks.sparkSession.sparkContext.broadcast(queries)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, n = shared.value, len(shared.value.ids)
        best, ids, known = np.zeros((n, seeds), np.int64), np.zeros((n, seeds), np.int64), np.zeros((n, seeds), bool)
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row, q)
                own, has = np.asarray(block.ids.fill_null(0)), np.asarray(block.ids.is_valid())
                for lo, bounds in block.bounds():
                    items = lo + np.flatnonzero(bounds.max(1) > best[lo : lo + len(bounds)].min(1))
                    if not len(items):
                        continue
                    both = np.concatenate([best[items], bounds[items - lo]], axis=1)
                    top = np.argpartition(-both, seeds - 1, axis=1)[:, :seeds]
                    wide = (len(items), block.docs)
                    best[items] = np.take_along_axis(both, top, 1)
                    ids[items] = np.take_along_axis(np.concatenate([ids[items], np.broadcast_to(own, wide)], axis=1), top, 1)
                    known[items] = np.take_along_axis(np.concatenate([known[items], np.broadcast_to(has, wide)], axis=1), top, 1)
        item, at = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids[item, at], mask=~known[item, at]), pa.array(best[item, at])], names=["item", "doc_id", "bound"])

    return blocks.mapInArrow(work, "item long, doc_id long, bound long")


def not_excluded(blocks: DataFrame, queries: Queries, least: np.ndarray) -> DataFrame:
    """``item, doc_id, first_key, second_key`` of all documents whose bound is
    at least the item's ``least`` score, and above 0."""
    shared = blocks.sparkSession.sparkContext.broadcast((queries, np.maximum(least, 1)))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, score = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row, q)
                for lo, bounds in block.bounds():
                    item, doc = np.nonzero(bounds >= score[lo : lo + len(bounds), None])
                    if len(item):
                        doc = pa.array(doc)
                        yield pa.RecordBatch.from_arrays([pa.array(item + lo), block.ids.take(doc), block.keys[0].take(doc), block.keys[1].take(doc)], names=["item", "doc_id", "first_key", "second_key"])

    return blocks.mapInArrow(work, "item long, doc_id long, first_key long, second_key long")


def exact_scores(docs: DataFrame, pairs: DataFrame, queries: Queries) -> DataFrame:
    """``item, doc_id, score``: all documents with the id of a pair, scored by
    their whole texts for that pair's item.

    A bitmap of the ids rules out other documents where they are, so that only
    texts that are scored are shuffled, and few besides.
    """
    wanted = stage(pairs.groupBy("doc_id").agg(F.collect_set("item").alias("items")).withColumn("id_key", F.xxhash64("doc_id")), "search-wanted")
    texts = may_be_among(_plain(docs).withColumn("id_key", F.xxhash64("doc_id")), wanted, "id_key").alias("d")
    found = texts.join(wanted.alias("w"), F.expr("d.id_key = w.id_key and d.doc_id <=> w.doc_id")).select("d.doc_id", "d.text", "w.items")
    shared = docs.sparkSession.sparkContext.broadcast(queries)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for _, batch in chunks(batches, "text", CHUNK):
            hashes, counts, first, lengths = count_terms(batch.column(1))
            m = length_norm(lengths, q.n_docs, q.n_terms)
            at = np.minimum(np.searchsorted(q.terms, hashes), len(q.terms) - 1)
            known = q.terms[at] == hashes
            out: list[tuple[int, int, int]] = []
            tf = np.zeros(len(q.terms), np.int64)
            for row, items in enumerate(batch.column(2).to_pylist()):
                own = slice(first[row], first[row + 1])
                there = at[own][known[own]]
                tf[there] = counts[own][known[own]]
                share = np.zeros(len(q.terms), np.int64)
                share[there] = q.weights[there] * (1_000_000_000 * tf[there] // (1000 * tf[there] + 8 * m[row]))
                for item in items:
                    span = slice(q.starts[item], q.starts[item + 1])
                    out.append((item, row, int((share[q.entries[span]] * q.times[span]).sum())))
            if out:
                item, row, score = (np.array(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(item), batch.column(0).take(pa.array(row)), pa.array(score)], names=["item", "doc_id", "score"])

    return found.mapInArrow(work, "item long, doc_id long, score long")


def first_of(df: DataFrame, k: int, keys: list[str], *order: F.Column) -> DataFrame:
    """The first ``k`` rows of each key, with their ``rank``; tasks drop what
    can't be among them before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, blocks: DataFrame | None = None) -> DataFrame:
    """The ``k`` best-scoring documents of each item: ``item_id, rank, doc_id,
    score``.

    Items go in blocks of about 1 MB of text, each against all documents;
    ``blocks`` may have the ``signature_blocks`` of the same documents.  Texts
    are taken whole, null as empty; a text without terms is never found and an
    item without terms finds nothing, as does an empty table.  Equal scores go
    by document id, null last; rows that repeat an id are documents of their
    own, and so are items; other columns are ignored.  Terms are told apart by
    64-bit hashes.

    Of documents with the same terms and counts, which have equal scores, only
    the ``k`` smallest ids go on from the bounds: a third of all rows may be
    copies of one text.
    """
    spark = docs.sparkSession
    blocks = stage(signature_blocks(docs), "search-signatures") if blocks is None else blocks
    n_docs, n_terms = blocks.agg(F.sum("docs"), F.sum("terms")).first()
    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // ITEM_BYTES)
    found = []
    for part in range(parts if n_docs else 0):
        queries = read_items(named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).toArrow())
        if not len(queries.terms):
            continue
        counts = {r.term: r.n for r in document_frequencies(docs, queries.terms).toLocalIterator()}  # one number a term of the items
        queries = weigh(queries, counts, n_docs, n_terms)
        if not len(queries.terms):
            continue
        seeds = first_of(best_bounds(blocks, queries, max(k, SEEDS)), max(k, SEEDS), ["item"], F.desc("bound"), F.asc_nulls_last("doc_id"))
        least = np.zeros(len(queries.ids), np.int64)
        for r in first_of(exact_scores(docs, seeds, queries), k, ["item"], F.desc("score")).where(F.col("rank") == k).toLocalIterator():
            least[r.item] = r.score
        open_pairs = first_of(not_excluded(blocks, queries, least), k, ["item", "first_key", "second_key"], F.asc_nulls_last("doc_id"))
        ranked = first_of(exact_scores(docs, open_pairs, queries).where("score > 0"), k, ["item"], F.desc("score"), F.asc_nulls_last("doc_id"))
        ids = spark.createDataFrame(pa.table({"item": pa.array(range(len(queries.ids)), pa.int64()), "item_id": pa.array(queries.ids, pa.int64())}))
        found.append(stage(ranked.join(ids, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "search-found"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


_TERMS = r"unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t"
SEARCH_SQL = f"""
with tf as (select doc_id, t, count(*) tf from (select doc_id, {_TERMS} from documents) group by all),
dl as (select doc_id, cast(sum(tf) as bigint) n from tf group by 1),
s as (select count(*) nd, cast(sum(n) as bigint) nt from dl),
q as (select item_id, t, count(*) times from (select item_id, {_TERMS} from benchmark) group by all),
w as (select t, cast(floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1))) as bigint) w from tf, s where t in (select t from q) group by t),
sc as (select item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt)))) as bigint) score
  from q join w using (t) join tf using (t) join dl using (doc_id), s group by 1, 2)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) rank, doc_id, score from sc where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10
"""
