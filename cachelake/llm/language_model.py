"""LM scoring: a smoothed bigram model in Elias-Fano tries, one per shard.

The model is spread over shards by the hash of the context word, as the
vocabulary is by that of the word, so no task or driver holds it whole.
Occurrences travel to the shards in packed, compressed columns; each shard
builds its trie from the training occurrences, maps its levels from a file,
scores all occurrences that came and sends sums per document back.

Witten-Bell weights: with c(h) tokens and t(h) types after context h,

    P(w | h) = c(h, w) / (c(h) + t(h)) + l(h) P(w)

    where c(h, w) is 0 for an unseen pair and

    l(h) = t(h) / (c(h) + t(h)), 1 for an unseen context
    P(w) = (c(w) + 1) / (N + V + 1)

A word's shard sends the word's count to the shards of the contexts that it
follows, so all seen pairs get both terms.  Both kinds of probabilities are
quantised to 8 bits.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelake.llm.common import chunks, hash_words, mix, shard_of, shuffle_partitions, stage

START = np.uint64(0x51ED270B7F3F2E1D)
END = np.uint64(0xA1B2C3D4E5F60719)
CODES = 256
RELATIVE_BITS = 40
GROUP = 256
#: Pairs that are searched at once.
SEARCHED = 1 << 14
#: A level is read in order where it has at most so many values for each that is looked up.
DENSE = 64
RELATIVE = np.uint64((1 << RELATIVE_BITS) - 1)


# ---------------------------------------------------------------- packing


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob.  Bytes of equal weight lie together."""
    head = np.array([len(arrays), *[x for a in arrays for x in (len(a), a.dtype.itemsize, "uif".index(a.dtype.kind))]], np.int64)
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"" for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 3 * count, 8).reshape(count, 3)
    at, out = 8 + 24 * count, []
    for n, size, kind in head.tolist():
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"{'uif'[kind]}{size}").ravel())
        at += n * size
    return out


def low_bytes(x: np.ndarray, size: int) -> np.ndarray:
    """The lowest bytes of 64-bit words, plane by plane."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :size].T).ravel()


def from_low_bytes(planes: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(planes) // size, 8), np.uint8)
    out[:, :size] = planes.reshape(size, -1).T
    return out.view(np.uint64).ravel()


def small(x: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds the values."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


# ---------------------------------------------------------------- the trie


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary with a
    rank directory.  Its parts are views of one buffer, which may be a mapped
    file."""

    @staticmethod
    def build(values: np.ndarray, universe: int) -> bytes:
        n = len(values)
        width = max(0, min(56, (max(universe, 1) // max(n, 1)).bit_length() - 1))
        low = values & np.uint64((1 << width) - 1)
        bits = np.zeros(n * width + 64, np.uint8)
        for b in range(width):
            bits[b : b + n * width : width][:n] = (low >> np.uint64(b)).astype(np.uint8) & 1
        high = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        top = int(high[-1]) + 1 if n else 0
        unary = np.zeros(-(-(top + 1) // 512) * 512, np.uint8)
        unary[high] = 1
        ranks = np.concatenate([[0], np.cumsum(unary.reshape(-1, 512).sum(1, dtype=np.int64))])
        parts = [np.packbits(bits, bitorder="little"), np.packbits(unary, bitorder="little"), ranks.view(np.uint8)]
        return np.array([n, width, *map(len, parts)], np.int64).tobytes() + b"".join(p.tobytes() for p in parts)

    def __init__(self, buffer: memoryview):
        self.n, self.width, low, unary, ranks = np.frombuffer(buffer, np.int64, 5).tolist()
        self.low = np.frombuffer(buffer, np.uint8, low, 40)
        self.unary = np.frombuffer(buffer, np.uint8, unary, 40 + low)
        self.ranks = np.frombuffer(buffer, np.uint8, ranks, 40 + low + unary).copy().view(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at positions ``i``."""
        i = i.astype(np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        first, last = int(i.min()), int(i.max()) + 1
        if last - first <= DENSE * len(i):
            return self.stretch(first, last)[i - first]
        block = np.searchsorted(self.ranks, i, "right") - 1
        rest = i - self.ranks[block]
        # The word of the block in which the bit is, then the byte, then the bit.
        bytes_ = self.unary.reshape(-1, 64)[block]
        ones = np.cumsum(np.bitwise_count(bytes_), 1, dtype=np.int16)
        byte = (ones <= rest[:, None]).sum(1)
        before = np.where(byte > 0, np.take_along_axis(ones, np.maximum(byte - 1, 0)[:, None], 1)[:, 0], 0)
        kth = rest - before
        lanes = np.cumsum(np.unpackbits(np.take_along_axis(bytes_, byte[:, None], 1), axis=1, bitorder="little"), 1)
        bit = (lanes <= kth[:, None]).sum(1)
        return self._with_low((block * 512 + byte * 8 + bit - i).astype(np.uint64), i)

    def stretch(self, first: int, last: int) -> np.ndarray:
        """The values at positions [first, last), read in order."""
        if first >= last:
            return np.zeros(0, np.uint64)
        block, end = np.searchsorted(self.ranks, [first, last - 1], "right").tolist()
        ones = np.flatnonzero(np.unpackbits(self.unary[(block - 1) * 64 : end * 64], bitorder="little"))
        skip = first - int(self.ranks[block - 1])
        i = np.arange(first, last)
        return self._with_low(((block - 1) * 512 + ones[skip : skip + last - first] - i).astype(np.uint64), i)

    def _with_low(self, high: np.ndarray, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return high
        at = i * self.width
        word = np.zeros(len(i), np.uint64)
        for b in range(8):
            word |= self.low[(at >> 3) + b].astype(np.uint64) << np.uint64(8 * b)
        return (high << np.uint64(self.width)) | ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1))

    def successor(self, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first positions in [lo, hi) whose value isn't smaller; else hi.

        Of values that lie close together, the stretch that they are in is read
        once; others are searched one by one."""
        lo, hi = lo.astype(np.int64), hi.astype(np.int64)
        if not len(values):
            return lo
        ends = self._halve(np.array([values.min(), values.max()]), np.full(2, lo.min()), np.full(2, hi.max()))
        first, last = ends.tolist()
        if last - first <= DENSE * len(values):
            return np.clip(first + np.searchsorted(self.stretch(first, last), values), lo, hi)
        return self._halve(values, lo, hi)

    def _halve(self, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.get(mid) < values[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes and their values: means of equally wide bins, so that none
    is further off than a bin is wide."""
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(CODES)
    edges = np.linspace(x.min(), x.max(), CODES + 1)[1:-1]
    code = np.searchsorted(edges, x, "left")
    count = np.bincount(code, minlength=CODES)
    return code.astype(np.uint8), np.bincount(code, x, CODES) / np.maximum(count, 1)


class Trie:
    """A shard's contexts and, in ranges given by monotone pointers, their
    successors.  A successor is kept relative to its context: its 40-bit code
    behind the context's number, which makes the whole level monotone."""

    def __init__(self, contexts: np.ndarray, counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], shares: np.ndarray):
        at, successor, count = pairs
        types = np.bincount(at, minlength=len(contexts))
        whole = (counts + types).astype(float)
        back = types / np.maximum(whole, 1)
        p = count / whole[at] + back[at] * shares
        self.p_code, self.p_value = quantise(np.log10(np.minimum(p, 1.0)))
        self.b_code, self.b_value = quantise(np.log10(back))
        levels = [
            EliasFano.build(contexts, 1 << 64),
            EliasFano.build(np.concatenate([[0], np.cumsum(types)]).astype(np.uint64), len(at) + 1),
            EliasFano.build((at.astype(np.uint64) << np.uint64(RELATIVE_BITS)) + successor, max(1, len(contexts)) << RELATIVE_BITS),
            self.p_code.tobytes(), self.b_code.tobytes(),
        ]
        # The file has no name any more once it is mapped, so nothing stays behind.
        with tempfile.TemporaryFile() as file:
            starts = []
            for level in levels:
                starts.append(file.tell())
                file.write(level + b"\0" * (-len(level) % 64 + 64))
            file.flush()
            view = memoryview(mmap.mmap(file.fileno(), os.fstat(file.fileno()).st_size, access=mmap.ACCESS_READ))
        self.contexts, self.pointers, self.successors = (EliasFano(view[s:]) for s in starts[:3])
        self.p = np.frombuffer(view, np.uint8, len(at), starts[3])
        self.b = np.frombuffer(view, np.uint8, len(contexts), starts[4])

    def score(self, context: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P of each pair, or of its context's back-off if unseen, and
        whether it was seen."""
        out, seen = np.zeros(len(context)), np.zeros(len(context), bool)
        own, of = np.unique(context, return_inverse=True)
        n = self.contexts.n
        at = self.contexts.successor(own, np.zeros(len(own), int), np.full(len(own), n))
        there = np.zeros(len(own), bool)
        inside = at < n
        there[inside] = self.contexts.get(at[inside]) == own[inside]
        at = np.where(there, at, 0)
        known = np.flatnonzero(there[of])
        if not len(known):
            return out, seen
        h = at[of[known]]
        lo, hi = self.pointers.get(h).astype(np.int64), self.pointers.get(h + 1).astype(np.int64)
        wanted = (h.astype(np.uint64) << np.uint64(RELATIVE_BITS)) + successor[known]
        found = self.successors.successor(wanted, lo, hi)
        hit = found < hi
        hit[hit] = self.successors.get(found[hit]) == wanted[hit]
        out[known] = np.where(hit, self.p_value[self.p[np.where(hit, found, 0)]], self.b_value[self.b[h]])
        seen[known] = hit
        return out, seen


def search_once(trie: Trie, context: np.ndarray, successor: np.ndarray, order: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``trie.score`` of all occurrences of the distinct pairs, of which each
    is searched once; ``order`` has the places of the first pair's
    ``times[0]`` occurrences, then the next one's."""
    parts = [trie.score(context[lo : lo + SEARCHED], successor[lo : lo + SEARCHED]) for lo in range(0, len(context), SEARCHED)]
    out = np.zeros(len(order)), np.zeros(len(order), bool)
    for each, found in zip(out, zip(*parts, strict=True), strict=False):
        each[order] = np.repeat(np.concatenate(found), times)
    return out


# ---------------------------------------------------------------- the jobs


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each document with its end, their contexts, and their rows."""
    words, rows = hash_words(batch.column(batch.schema.get_field_index("text")))
    n = np.diff(rows)
    token = np.insert(words, rows[1:], END)
    first = rows[:-1] + np.arange(len(n))
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[first] = START
    return token, context, np.repeat(np.arange(len(n)), n + 1)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys (first the most significant), run starts and lengths."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    start = np.flatnonzero(new)
    return order, start, np.diff(np.append(start, len(order)))


_ROWS = "part int, kind int, chunk long, blob binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "kind", "chunk", "blob"])


def _sums(parts: DataFrame, values: list[str]) -> DataFrame:
    """Packed sums of a chunk's documents to one row per document.

    ``parts[chunk, blob]``: a blob has document numbers and their values; the
    chunk's own blob (kind 0) also names the documents.
    """
    ddl = "rk long, doc_id long, train boolean, n_tokens long, " + ", ".join(f"{v} double" for v in values)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, meta, sums = None, None, None

        def out() -> pa.RecordBatch:
            rk, doc_id, valid, train, n = meta
            columns = [pa.array(rk), pa.array(doc_id, mask=valid == 0), pa.array(train.astype(bool)), pa.array(n.astype(np.int64)), *[pa.array(s[: len(rk)]) for s in sums]]
            return pa.RecordBatch.from_arrays(columns, names=["rk", "doc_id", "train", "n_tokens", *values])

        for batch in batches:
            for chunk, group, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (chunk, group) != last:
                    if meta is not None:
                        yield out()
                    last, meta, sums = (chunk, group), None, [np.zeros(GROUP) for _ in values]
                arrays = unpack(blob)
                if kind == 0:
                    meta = arrays
                else:
                    for s, v in zip(sums, arrays[1:], strict=True):
                        s += np.bincount(arrays[0], v.astype(float), GROUP)
        if meta is not None:
            yield out()

    return parts.select("chunk", "part", "kind", "blob").repartition("chunk", "part").sortWithinPartitions("chunk", "part").mapInArrow(add, ddl)


def _back(chunk: int, doc: np.ndarray, values: list[np.ndarray], kind: int = 1) -> list[tuple]:
    """Rows of sums for ``_sums``, split by groups of documents."""
    cut = np.searchsorted(doc, np.arange(0, int(doc[-1]) + 2 * GROUP, GROUP)) if len(doc) else np.zeros(1, int)
    return [(g, kind, chunk, pack(small(doc[a:b] - g * GROUP), *[v[a:b] for v in values])) for g, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]


def _per_doc(doc: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    own, at = np.unique(doc, return_inverse=True)
    return own, [np.bincount(at, v, len(own)) for v in values]


def score_documents(docs: DataFrame, held: str = "crc32(cast(doc_id as string)) % 7 = 2") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score`` of every row; the model learns from rows outside ``held``.

    Null and empty texts have one token, their end.  A null id isn't held out.
    Fully repeated rows are learned from as often as they occur and score
    alike.  Very long texts count whole.  Other columns are ignored; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    shards = shuffle_partitions(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = source.withColumn("rk", F.xxhash64("doc_id", "text")).withColumn("train", ~F.coalesce(F.expr(held), F.lit(False)))

    # Unigrams: every (word, document) goes to the word's shard once.
    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, batch in chunks(batches, "text", 4 << 20):
            token, context, doc = _sequences(batch)
            train = np.asarray(batch.column(3)).astype(bool)
            n = np.bincount(doc, minlength=batch.num_rows)
            ids = batch.column(0)
            out = []
            for g, lo in enumerate(range(0, batch.num_rows, GROUP)):
                some = slice(lo, lo + GROUP)
                valid = np.asarray(ids.is_valid())[some].astype(np.uint8)
                out.append((g, 0, chunk, pack(np.asarray(batch.column(2))[some], np.asarray(ids.fill_null(0))[some], valid, train[some].astype(np.uint8), small(n[some]))))
            yield _rows([(chunk % shards, 0, chunk, pack(np.array([g]), np.frombuffer(b, np.uint8))) for g, _, _, b in out])
            order, start, count = _runs(token, doc)
            w, d = token[order][start], doc[order][start]
            cut = np.searchsorted(shard_of(w, shards), np.arange(shards + 1))
            # Of each word of the chunk, by its number, the context shards that will ask for its count.
            number = np.concatenate([[0], np.cumsum(w[1:] != w[:-1])]) if len(w) else np.zeros(0, np.int64)
            of = np.empty(len(token), np.int64)
            of[order] = np.repeat(number, np.diff(np.append(start, len(order))))
            use = np.flatnonzero(train[doc])
            asks = np.unique(of[use] * shards + shard_of(mix(context[use]), shards).astype(np.int64))
            rows = []
            for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if b > a:
                    new = np.flatnonzero(np.concatenate([[True], w[a + 1 : b] != w[a : b - 1]]))
                    lo, hi = np.searchsorted(asks, [number[a] * shards, (number[b - 1] + 1) * shards])
                    many = np.bincount(asks[lo:hi] // shards - number[a], minlength=len(new))
                    rows.append((s, 1, chunk, pack(w[a:b][new], small(np.diff(np.append(new, b - a))), small(d[a:b]), small(count[a:b]), train[d[a:b]].astype(np.uint8), small(many), small(asks[lo:hi] % shards))))
            yield _rows(rows)

    def unigrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, shard = [], 0
        for batch in batches:
            for part, kind, chunk, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if kind == 0:
                    (g,), raw = unpack(blob)
                    yield _rows([(int(g), 0, chunk, raw.tobytes())])
                else:
                    shard = part
                    blobs.append((chunk, blob))
        if not blobs:
            return
        names, totals, asks = [], [], []
        for _, blob in blobs:
            w, per, _, count, train, many, by = unpack(blob)
            asks.append((np.repeat(w, many), by))
            n = np.add.reduceat(count.astype(np.int64) * train, np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.int64))
            names.append(w[n > 0])
            totals.append(n[n > 0])
        name, at = np.unique(np.concatenate(names), return_inverse=True)
        total = np.bincount(at, np.concatenate(totals), len(name)).astype(np.int64) if len(name) else np.zeros(0, np.int64)
        del names, totals, at
        yield _rows([(shard, 2, int(total.sum()), pack(name, small(total))), (shard, 3, len(name), b"")])
        word, by = (np.concatenate(x) for x in zip(*asks, strict=True))
        wanted = np.unique(by.astype(np.int64) * len(name) + np.searchsorted(name, word))
        del asks, word, by
        if len(wanted):
            cut = np.searchsorted(wanted, np.arange(shards + 1) * len(name))
            for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if b > a:
                    at = wanted[a:b] - s * len(name)
                    yield _rows([(s, 5, 0, pack(name[at], small(total[at])))])
        for chunk, blob in blobs:
            w, per, doc, count = unpack(blob)[:4]
            c = _look(name, total, w)
            each = np.repeat(c, per)
            own, (base, known) = _per_doc(doc, np.log10(each + 1.0) * count, count * (each > 0))
            yield _rows(_back(chunk, own, [base, small(known.astype(np.int64))]))

    counted = stage(source.mapInArrow(words, _ROWS).repartitionById(shards, F.col("part")).mapInArrow(unigrams, _ROWS), "lm-unigrams")
    n_train, n_words = (int(x or 0) for x in counted.agg(F.sum(F.when(F.col("kind") == 2, F.col("chunk"))), F.sum(F.when(F.col("kind") == 3, F.col("chunk")))).first())
    norm = float(np.log10(n_train + n_words + 1))

    # Bigrams: every (context, word, document) goes to the context's shard once.
    def bigrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, batch in chunks(batches, "text", 4 << 20):
            token, context, doc = _sequences(batch)
            train = np.asarray(batch.column(3)).astype(bool)
            yield _rows([(chunk % shards, 0, chunk, pack(np.array([g]), np.frombuffer(pack(np.asarray(batch.column(2))[lo : lo + GROUP], np.asarray(batch.column(0).fill_null(0))[lo : lo + GROUP], np.asarray(batch.column(0).is_valid())[lo : lo + GROUP].astype(np.uint8), train[lo : lo + GROUP].astype(np.uint8), np.zeros(len(train[lo : lo + GROUP]), np.uint8)), np.uint8))) for g, lo in enumerate(range(0, batch.num_rows, GROUP))])
            hashed = mix(context)
            for kind in (1, 2):  # training documents, then held-out ones
                use = np.flatnonzero(train[doc] == (kind == 1))
                if not len(use):
                    continue
                order, start, count = _runs(hashed[use], token[use] & RELATIVE if kind == 1 else token[use], doc[use])
                at = use[order[start]]
                h, w, d = hashed[at], token[at], doc[at]
                cut = np.searchsorted(shard_of(h, shards), np.arange(shards + 1))
                rows = []
                for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    if b > a:
                        new = np.flatnonzero(np.concatenate([[True], h[a + 1 : b] != h[a : b - 1]]))
                        code = low_bytes(w[a:b], RELATIVE_BITS // 8) if kind == 1 else w[a:b]
                        rows.append((s, kind, chunk, pack(h[a:b][new], small(np.diff(np.append(new, b - a))), code, small(d[a:b]), small(count[a:b]))))
                yield _rows(rows)

    def scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, asked, counts = [], [], []
        for batch in batches:
            for kind, chunk, blob in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if kind == 0:
                    (g,), raw = unpack(blob)
                    yield _rows([(int(g), 0, chunk, raw.tobytes())])
                elif kind == 5:
                    counts.append(unpack(blob))
                else:
                    (learned if kind == 1 else asked).append((chunk, blob))
        h_all, w_all, n_all = [], [], []
        for _, blob in learned:
            h, per, code, _, count = unpack(blob)
            h_all.append(np.repeat(h, per))
            w_all.append(from_low_bytes(code, RELATIVE_BITS // 8))
            n_all.append(count.astype(np.uint32))
        if learned:
            h, w, n = (np.concatenate(x) for x in (h_all, w_all, n_all))
        else:
            h, w, n = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        del h_all, w_all, n_all
        order, start, times = _runs(h, w)
        count = np.add.reduceat(n[order].astype(np.int64), start) if len(order) else np.zeros(0, np.int64)
        contexts, at = np.unique(h[order][start], return_inverse=True)
        successor = w[order][start]
        del h, w, n
        shares = np.zeros(len(at))
        if len(at):
            # Words whose codes are equal are one word here.
            codes, of = np.unique(np.concatenate([x[0] for x in counts]) & RELATIVE, return_inverse=True)
            shares = (np.bincount(of, np.concatenate([x[1] for x in counts]) + 1.0) / (n_train + n_words + 1))[np.searchsorted(codes, successor)]
        trie = Trie(contexts, np.bincount(at, count, len(contexts)), (at, successor, count), shares)
        value, _ = search_once(trie, contexts[at], successor, order, times)
        del contexts, successor, at, shares, counts, order, times
        sums: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        lo = 0
        for chunk, blob in learned:
            _, _, _, doc, count = unpack(blob)
            own, (total,) = _per_doc(doc, value[lo : lo + len(doc)] * count)
            lo += len(doc)
            sums.setdefault(chunk, []).append((own, total))
        rest: list[tuple[np.ndarray, ...]] = []
        h_all, w_all = [], []
        for _, blob in asked:
            h, per, w, _, _ = unpack(blob)
            h_all.append(np.repeat(h, per))
            w_all.append(w & RELATIVE)
        if asked:
            h, w = np.concatenate(h_all), np.concatenate(w_all)
            del h_all, w_all
            order, start, times = _runs(h, w)
            of = order[start]
            values, all_seen = search_once(trie, h[of], w[of], order, times)
            del h, w, order, start, times, of
        lo = 0
        for chunk, blob in asked:
            _, _, w, doc, count = unpack(blob)
            value, seen = values[lo : lo + len(doc)], all_seen[lo : lo + len(doc)]
            lo += len(doc)
            own, (total,) = _per_doc(doc, value * count)
            sums.setdefault(chunk, []).append((own, total))
            order, start, _ = _runs(w[~seen], doc[~seen])
            if len(order):
                at = order[start]
                rest.append((w[~seen][at], np.full(len(at), chunk), doc[~seen][at].astype(np.int64), np.add.reduceat(count[~seen][order].astype(np.int64), start)))
        for chunk, parts in sums.items():
            own, (total,) = _per_doc(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]))
            yield _rows(_back(chunk, own, [total.astype(np.float32)]))
        if rest:
            # One row for each shard that is asked, whatever the number of chunks.
            u, chunk, doc, times = (np.concatenate(x) for x in zip(*rest, strict=True))
            order = np.argsort(u)
            u, chunk, doc, times = u[order], chunk[order], doc[order], times[order]
            cut = np.searchsorted(shard_of(u, shards), np.arange(shards + 1))
            yield _rows([(s, 4, 0, pack(u[a:b], chunk[a:b], small(doc[a:b]), small(times[a:b]))) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a])

    sent = source.mapInArrow(bigrams, _ROWS).unionByName(counted.where("kind = 5"))
    scored = stage(sent.repartitionById(shards, F.col("part")).mapInArrow(scores, _ROWS), "lm-bigrams")

    # What was unseen after its context gets its word's own probability.
    def back_off(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, total, asked = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        for batch in batches:
            for kind, blob in zip(*(batch.column(i).to_pylist() for i in (1, 3)), strict=True):
                if kind == 2:
                    name, total = unpack(blob)
                else:
                    asked.append(blob)
        if not asked:
            return
        u, chunks_, doc, times = (np.concatenate(x) for x in zip(*(unpack(blob) for blob in asked), strict=True))
        value = (np.log10(_look(name, total, u) + 1.0) - norm) * times
        order, start, _ = _runs(chunks_, doc)
        sums, at = np.add.reduceat(value[order], start), order[start]
        of = chunks_[at]
        cut = np.flatnonzero(np.diff(of, prepend=of[0] - 1))
        for a, b in zip(cut, np.append(cut[1:], len(at)), strict=True):
            yield _rows(_back(int(of[a]), doc[at[a:b]].astype(np.int64), [sums[a:b].astype(np.float32)]))

    asks = scored.where("kind = 4").unionByName(counted.where("kind = 2"))
    unseen = asks.repartitionById(shards, F.col("part")).mapInArrow(back_off, _ROWS)
    base = _sums(counted.where("kind < 2"), ["base", "known"])
    full = _sums(scored.where("kind < 2").unionByName(unseen), ["score"])
    both = base.select("rk", "doc_id", "train", "n_tokens", "base", "known", F.lit(1).alias("m"), F.lit(0.0).alias("score")).unionByName(
        full.select("rk", "doc_id", "train", F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("base"), F.lit(0.0).alias("known"), F.lit(0).alias("m"), "score")
    )
    # Fully repeated rows meet here: sums are shared out among them again.
    each = both.groupBy("rk", "doc_id", "train").agg(F.sum("m").alias("m"), *[F.sum(c).alias(c) for c in ("n_tokens", "base", "known", "score")])
    n = (F.col("n_tokens") / F.col("m")).cast("long")
    rows = each.select("doc_id", (~F.col("train")).alias("held_out"), n.alias("n_tokens"), F.round(F.col("known") / F.col("m")).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") / F.col("m") - n * F.lit(norm)).alias("base_score"), (F.col("score") / F.col("m")).alias("score"), F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("_"))
    return rows.drop("_")


def _look(name: np.ndarray, total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Counts of words; 0 for those that aren't there."""
    if not len(name):
        return np.zeros(len(words), np.int64)
    at = np.minimum(np.searchsorted(name, words), len(name) - 1)
    return np.where(name[at] == words, total[at].astype(np.int64), 0)
