"""Links between similar token sets, at scale and without losing any.

1. The texts are read once to describe their sets and to count, in a sketch
   sized from the texts' bytes, how often each token (or band key) occurs.
2. Each set gets keys such that two sets that are alike share one: its rarest
   tokens for exact joins, MinHash bands for recall-tuned ones.  Keys travel to
   shards as packed words; those that the sketch counts often travel as rows,
   which Spark aggregates before and after the shuffle, so that no task holds
   a hot key.  Of each key, the least set is the pivot of all others.
3. Most sets share a key by chance only.  A set's signature, which has about as
   many bits as the set has tokens, bounds from below by how many tokens two
   sets differ; groups are cut where that rules all links out.
4. Only sets that may still be linked are fetched, each once.  A pivot's
   group is joined as a whole; a large one is cut into parts that all hold the
   pivot.  What isn't joined with its group's main component by then goes to
   the group's other parts in a second pass.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelake.llm.common import bitmap, chunks, connected_components, grouped_arrow, in_bitmap, may_be_among, mix, release, shard_of, shuffle_partitions, stage
from cachelake.llm.signature_tree import Forest, linked_pairs, overlap

GROUP_PART = 512
LINK_PART = 512
#: Groups of up to so many sets are cut by their signatures.
SIGNED_GROUP = 8192
LEAST_SIGN, MOST_SIGN = 64, 1 << 14
BLOCK_SIGN = 256
SHARD_KEYS = 1 << 21
LEAST_BITS, MOST_BITS, SKETCH_PARTS = 16, 23, 64
#: Bits of a packed key that number its set; no chunk has more.
REF = np.uint64(22)
#: Counts are kept as 16 times their binary logarithm.
HOT = 16 * 12


@dataclass
class Units:
    """The sets of one chunk: ``tokens`` is flat, sorted and without repeats
    within each of the ``offsets``' ranges; ``columns`` describe the sets.
    ``ordered`` are the sets' tokens as they came, with offsets, if wanted."""

    tokens: np.ndarray
    offsets: np.ndarray
    columns: dict[str, pa.Array]
    ordered: tuple[np.ndarray, np.ndarray] | None = None


def distinct_sets(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each range's sorted distinct values, and their offsets."""
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(o[new], minlength=len(n)))])


def fingerprints(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128-bit fingerprints of sets, as pairs of 64-bit words."""
    n = np.diff(offsets)
    out = np.zeros((len(n), 2), np.uint64)
    full = n > 0
    if full.any():
        at = offsets[:-1][full]
        for k, seed in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            out[full, k] = mix(np.add.reduceat(mix(tokens ^ np.uint64(seed)), at) + n[full].astype(np.uint64))
    return out


# ---------------------------------------------------------------- signatures


def signatures(tokens: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """For each set a bitmap of which of its slots an odd number of tokens
    falls into.  It has as many bits as the set has tokens, rounded up to a
    power of 2; halves of a longer one XORed are the shorter one.  Two sets
    differ by at least as many tokens as bits."""
    n = np.diff(offsets)
    bits = np.left_shift(1, np.ceil(np.log2(np.clip(n, LEAST_SIGN, MOST_SIGN))).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(bits)])
    slot = np.repeat(at[:-1], n) + (tokens & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    flat = np.packbits((np.bincount(slot, minlength=at[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [flat[a // 8 : b // 8] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _equal_signatures(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Such bitmaps of ``BLOCK_SIGN`` bits for all sets, a row of words each."""
    slot = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) * BLOCK_SIGN + (tokens & np.uint64(BLOCK_SIGN - 1)).astype(np.int64)
    odd = (np.bincount(slot, minlength=(len(offsets) - 1) * BLOCK_SIGN) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64).reshape(-1, BLOCK_SIGN // 64)


def able_classes(sizes: list[int], signs: list[bytes], num: int, den: int) -> np.ndarray:
    """Classes of sets, as the position of one of each, that no two sets with
    Jaccard similarity of ``num / den`` or more are in different ones of."""
    order = np.argsort(sizes, kind="stable")
    n = np.asarray(sizes, np.int64)[order]
    hi = np.searchsorted(n, n * den // num, "right")
    label = np.arange(len(n))
    levels: dict[int, tuple[int, np.ndarray]] = {}
    for i in range(len(n)):
        if hi[i] <= i + 1:
            continue
        size = len(signs[order[i]])
        if size not in levels:  # of this and all larger sets
            levels[size] = i, np.array([_folded(signs[k], size) for k in order[i:]])
        first, maps = levels[size]
        differ = np.bitwise_count(maps[i + 1 - first : hi[i] - first] ^ maps[i - first]).sum(1, dtype=np.int64)
        able = label[i + 1 : hi[i]][differ * (num + den) <= (n[i] + n[i + 1 : hi[i]]) * (den - num)]
        for other in np.unique(able[able != label[i]]).tolist():
            label[label == other] = label[i]
    out = np.empty(len(n), np.int64)
    out[order] = order[label]
    return out


def _folded(sign: bytes, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(np.frombuffer(sign, np.uint64).reshape(-1, size // 8), 0)


# ---------------------------------------------------------------- keys


@dataclass
class PrefixKeys:
    """A set's n - ceil(n num / den) + 1 first tokens in an order that all sets
    share.  Sets with Jaccard similarity of ``num / den`` or more have one of
    them in common.  Tokens that the sketch counts least come first, so a set
    with enough tokens of its own meets nobody; any order is exact."""

    num: int
    den: int

    def counted(self, tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return tokens

    def number(self, sets: int, tokens: int) -> int:
        return sets + tokens * (self.den - self.num) // self.den

    def __call__(self, tokens: np.ndarray, offsets: np.ndarray, often: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, the positions of their sets, and the keys' counts."""
        n = np.diff(offsets)
        owner = np.repeat(np.arange(len(n)), n)
        count = often(tokens)
        order = np.lexsort((tokens, count, owner))
        first = np.arange(len(tokens)) - np.repeat(offsets[:-1], n) < np.repeat(n - -(-n * self.num // self.den) + 1, n)
        at = order[first]
        return tokens[at], owner[at], count[at]

    def join(self, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, forest: Forest) -> list[tuple[int, int]]:
        return linked_pairs(sets, left, right, self.num, self.den, forest)


@dataclass
class BandKeys:
    """MinHash band keys: sets with similarity s share one of ``bands`` keys
    of ``rows`` hashes with probability 1 - (1 - s^rows)^bands.  Only sets
    that share a band are compared."""

    bands: int
    rows: int
    num: int
    den: int

    def counted(self, tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.table(tokens, offsets).ravel()

    def number(self, sets: int, tokens: int) -> int:
        return sets * self.bands

    def table(self, tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """``bands`` keys of each set; none may be empty."""
        if len(offsets) < 2:
            return np.zeros((self.bands, 0), np.uint64)
        keys = []
        for band, factors in enumerate(_band_factors(self.bands, self.rows)):
            key = np.full(len(offsets) - 1, band, np.uint64)
            for a, b in factors:
                x = tokens * a + b
                key = mix(key * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(x ^ (x >> np.uint64(29)), offsets[:-1]))
            keys.append(key)
        return np.array(keys)

    def __call__(self, tokens: np.ndarray, offsets: np.ndarray, often: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = self.table(tokens, offsets).ravel()
        return keys, np.tile(np.arange(len(offsets) - 1), self.bands), often(keys)

    def join(self, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, forest: Forest) -> list[tuple[int, int]]:
        size = np.array([len(s) for s in sets])
        if right is None and len(sets) == 2:  # a pivot and the only set that collided with it
            linked = overlap(*sets) * (self.num + self.den) >= self.num * size.sum()
            return [(0, 1)] if linked and forest.union(0, 1) else []
        flat, offsets = np.concatenate(sets), np.concatenate([[0], np.cumsum(size)])
        bands, signs = self.table(flat, offsets), _equal_signatures(flat, offsets)
        to = left if right is None else right
        found = []
        for i in left.tolist():
            near = to[(bands[:, [i]] == bands[:, to]).any(0)]
            # Only sets whose signatures don't rule a link out are compared.
            differ = np.bitwise_count(signs[near] ^ signs[i]).sum(1, dtype=np.int64)
            near = near[differ * (self.num + self.den) <= (size[i] + size[near]) * (self.den - self.num)]
            near = near[np.minimum(size[i], size[near]) * self.den >= self.num * np.maximum(size[i], size[near])]
            for j in near.tolist():
                if forest.find(i) != forest.find(j) and overlap(sets[i], sets[j]) * (self.num + self.den) >= self.num * (size[i] + size[j]):
                    forest.union(i, j)
                    found.append((i, j))
        return found


@functools.cache
def _band_factors(bands: int, rows: int) -> list[list[tuple[np.uint64, np.uint64]]]:
    rng = np.random.Generator(np.random.PCG64(104729))
    return [[tuple(np.uint64(int(x) | 1) for x in rng.integers(1, 1 << 63, 2)) for _ in range(rows)] for _ in range(bands)]


# ---------------------------------------------------------------- the join


def find_links(docs: DataFrame, text: str, read: Callable[[pa.RecordBatch], Units], columns: str, keys: PrefixKeys | BandKeys) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All units with their fingerprints, the components of their links, and the
    sets that were compared.

    ``read`` makes a chunk's sets; ``columns`` is the DDL of its columns.  The
    first result has those and ``n``, ``fp``; the second ``fp``, ``component``
    for the fingerprints that are linked with another (equal sets are one); the
    third ``fp``, ``tokens``, ``ordered``.
    """
    spark = docs.sparkSession
    names = [c.strip().split()[0] for c in columns.split(",")]
    volume = int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    bits = min(max(volume.bit_length() - 2, LEAST_BITS), MOST_BITS)
    described = f"{columns}, n long, fp binary, head long, sign binary, part int, counts binary"

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for _, batch in chunks(batches, text):
            units = read(batch)
            fps = fingerprints(units.tokens, units.offsets)
            yield _rows(described, len(fps), **units.columns, n=pa.array(np.diff(units.offsets)), fp=_binary(fps), head=pa.array(fps[:, 0].view(np.int64)), sign=pa.array(signatures(units.tokens, units.offsets), pa.binary()))
            tokens, offsets, _ = _once(units, fps)
            np.add.at(total, (keys.counted(tokens, offsets) >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        if total.any():
            parts = np.minimum(total, 65535).astype(np.uint16).reshape(SKETCH_PARTS, -1)
            yield _rows(described, SKETCH_PARTS, part=pa.array(np.arange(SKETCH_PARTS, dtype=np.int32)), counts=pa.array([zlib.compress(x.tobytes(), 1) for x in parts], pa.binary()))

    seen = stage(docs.mapInArrow(describe, described), "similar-units")
    units = seen.where("fp is not null").select(*names, "n", "fp")
    sketch = spark.sparkContext.broadcast(_sketch(seen.where("part is not null").select("part", "counts"), bits))
    sets, tokens = units.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(shuffle_partitions(spark), -(-keys.number(sets, tokens) // SHARD_KEYS))
    steps = size_steps(keys.num, keys.den)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for chunk, batch in chunks(batches, text):
            units = read(batch)
            fps = fingerprints(units.tokens, units.offsets)
            tokens, offsets, took = _once(units, fps)
            if not len(took):
                continue
            k, own, count = keys(tokens, offsets, lambda x: counts[(x >> np.uint64(64 - bits)).astype(np.int64)])
            hot = count >= HOT
            size = np.diff(offsets).astype(np.uint64)
            if hot.any():
                own_hot = np.tile(own[hot], 2)
                by_size = sized_keys(np.tile(mix(k[hot]), 2), size[own_hot], steps)
                yield _rows(_KEYS, len(by_size), shard=pa.array(np.full(len(by_size), chunk % shards, np.int32)), hot=pa.array(by_size.view(np.int64)), head=pa.array(fps[took[own_hot], 0].view(np.int64)))
            k, own = mix(k[~hot]), own[~hot]
            order = np.argsort(k)
            k, own = k[order], own[order]
            cut = np.searchsorted(shard_of(k, shards), np.arange(shards + 1))
            some = np.flatnonzero(np.diff(cut))
            blobs = []
            for a, b in zip(cut[some], cut[some + 1], strict=True):
                # Heads and sizes of the shard's sets, then keys with the number of their set.
                refs, at = np.unique(own[a:b], return_inverse=True)
                blobs.append(np.concatenate([[np.uint64(len(refs))], fps[took[refs], 0], size[refs], ((k[a:b] >> REF) << REF) | at.astype(np.uint64)]).tobytes())
            yield _rows(_KEYS, len(some), shard=pa.array(some.astype(np.int32)), packed=pa.array(blobs, pa.binary()))

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head, size = [], [], []
        for batch in batches:
            hot = batch.filter(batch.column(2).is_valid())
            if hot.num_rows:
                yield _rows(_MET, hot.num_rows, hot=hot.column(2), head=hot.column(3))
            for blob in batch.column(1).drop_null():
                x = np.frombuffer(blob.as_buffer(), np.uint64)
                n = int(x[0])
                of = (x[2 * n + 1 :] & ((np.uint64(1) << REF) - np.uint64(1))).astype(np.int64)
                key.append(x[2 * n + 1 :] >> REF)
                head.append(x[1 : n + 1][of])
                size.append(x[n + 1 : 2 * n + 1][of])
        if not key:
            return
        keys_, heads, sizes = (np.concatenate(x) for x in (key, head, size))
        del key, head, size
        # Most keys have one owner only.
        order = np.argsort(keys_, kind="stable")
        k = keys_[order]
        same = np.zeros(len(k) + 1, bool)
        same[1:-1] = k[1:] == k[:-1]
        order = order[same[1:] | same[:-1]]
        if not len(order):
            return
        own = np.tile(order, 2)
        pair = star_pairs(sized_keys(np.tile(mix(keys_[order]), 2), sizes[own], steps), heads[own])
        for lo in range(0, len(pair), 1 << 16):
            part = np.ascontiguousarray(pair[lo : lo + (1 << 16)].T).view(np.int64)
            yield _rows(_MET, part.shape[1], head=pa.array(part[0]), pivot=pa.array(part[1]))
        del keys_, heads, sizes, k, order, own, same, pair
        release()

    met = stage(docs.mapInArrow(deal, _KEYS).repartitionById(shards, F.col("shard")).mapInArrow(meet, _MET), "similar-keys")
    sketch.destroy()
    hot = met.where("hot is not null").select("hot", "head").distinct()
    pivots = hot.groupBy("hot").agg(F.min("head").alias("pivot"))
    hot_pairs = hot.join(pivots, "hot").where("head <> pivot").select("head", "pivot")
    pairs = stage(met.where("pivot is not null").select("head", "pivot").unionByName(hot_pairs).distinct(), "similar-pairs")
    pairs = stage(_able_pairs(pairs, seen.where("n > 0").select("head", "fp", "n", "sign"), keys), "similar-able")
    wanted, slots = bitmap(pairs.select("head").unionByName(pairs.select(F.col("pivot").alias("head"))).distinct(), "head")

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, batch in chunks(batches, text):
            units = read(batch)
            fps = fingerprints(units.tokens, units.offsets)
            asked = (np.diff(units.offsets) > 0) & in_bitmap(wanted.value, slots, fps[:, 0])
            at = np.intersect1d(_firsts(fps), np.flatnonzero(asked))
            for lo in range(0, len(at), 256):
                own = at[lo : lo + 256]
                blobs = {
                    name: pa.array([flat[bounds[i] : bounds[i + 1]].tobytes() for i in own], pa.binary())
                    for name, (flat, bounds) in {"tokens": (units.tokens, units.offsets), "ordered": units.ordered or (None, None)}.items()
                    if flat is not None
                }
                yield _rows(_SETS, len(own), fp=_binary(fps[own]), head=pa.array(fps[own, 0].view(np.int64)), member=pa.array((chunk << 24) + own), **blobs)

    first = [F.first(c).alias(c) for c in ("head", "tokens", "ordered")]
    sets = stage(docs.mapInArrow(fetch, _SETS).groupBy("fp").agg(F.min("member").alias("member"), *first), "similar-sets")
    wanted.destroy()
    found = connected_components(_group_edges(sets, pairs, keys), "similar-links")
    return units, sets.select("fp", F.col("member").alias("node")).join(found, "node").select("fp", "component"), sets.select("fp", "tokens", "ordered")


_KEYS = "shard int, packed binary, hot long, head long"
_SETS = "fp binary, head long, member long, tokens binary, ordered binary"
_MET = "hot long, head long, pivot long"


def _once(units: Units, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal sets in a chunk one, without empty ones: tokens, offsets and
    the sets' positions."""
    n = np.diff(units.offsets)
    once = np.zeros(len(n), bool)
    once[_firsts(fps)] = True
    once &= n > 0
    return units.tokens[np.repeat(once, n)], np.concatenate([[0], np.cumsum(n[once])]), np.flatnonzero(once)


def _firsts(fps: np.ndarray) -> np.ndarray:
    """Where each fingerprint comes first."""
    order = np.lexsort((fps[:, 1], fps[:, 0]))  # stable
    new = np.ones(len(order), bool)
    new[1:] = (fps[order[1:]] != fps[order[:-1]]).any(1)
    return order[new]


def _sketch(parts: DataFrame, bits: int) -> np.ndarray:
    """The tasks' counters added up, as 16 times their binary logarithms."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = np.frombuffer(zlib.decompress(counts.as_buffer()), np.uint16)
                sums[k] = sums[k] + one if k in sums else one.astype(np.uint32)
        if sums:
            logs = [np.minimum(16 * np.log2(1.0 + x), 255).astype(np.uint8).tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(logs, pa.binary())], names=["part", "counts"])

    out = np.zeros((SKETCH_PARTS, (1 << bits) // SKETCH_PARTS), np.uint8)
    table = parts.repartition("part").mapInArrow(add, "part int, counts binary").toArrow()  # 2^MOST_BITS bytes at most
    for k, counts in zip(table["part"].to_pylist(), table["counts"].to_pylist(), strict=True):
        out[k] = np.frombuffer(counts, np.uint8)
    return out.ravel()


def size_steps(num: int, den: int) -> np.ndarray:
    """Least sizes of classes such that linked sets are in the same or in
    neighbouring ones."""
    steps = [1]
    while steps[-1] < 1 << 40:
        steps.append(max(steps[-1] + 1, -(-steps[-1] * den // num)))
    return np.array(steps, np.uint64)


def sized_keys(twice: np.ndarray, sizes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Keys, given twice in a row, joined with their sets' size class and with
    the next one: linked sets still share one, very unlike sizes don't."""
    level = np.searchsorted(steps, sizes, "right").astype(np.uint64)
    level[len(level) // 2 :] += np.uint64(1)
    return mix(twice + level * np.uint64(0x9FB21C651E98DF25))


def star_pairs(keys: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Distinct pairs of each key's owners with the least of them."""
    order = np.argsort(keys, kind="stable")
    k, own = keys[order], owners[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    pivot = np.repeat(np.minimum.reduceat(own, start), np.diff(np.append(start, len(k))))
    return np.unique(np.stack([own, pivot], 1)[own != pivot], axis=0)


def _able_pairs(pairs: DataFrame, signed: DataFrame, keys: PrefixKeys | BandKeys) -> DataFrame:
    """``pairs`` (``head, pivot``) of groups in which links aren't ruled out by
    the signatures in ``signed`` (``head, fp, n, sign``).  Very large groups
    stay as they are."""
    size = pairs.groupBy("pivot").agg(F.count("*").alias("size"))
    dealt = pairs.join(size, "pivot")
    few = dealt.where(F.col("size") < SIGNED_GROUP).select("head", "pivot")
    members = few.unionByName(few.select(F.col("pivot").alias("head"), "pivot").distinct())
    known = may_be_among(signed, members.select("head").distinct(), "head").groupBy("fp").agg(*[F.first(c).alias(c) for c in ("head", "n", "sign")])

    def cut(rows: dict) -> pa.RecordBatch | None:
        heads = np.array(rows["head"])
        label = able_classes(rows["n"], rows["sign"], keys.num, keys.den)
        _, own = np.unique(label, return_inverse=True)
        least = np.full(len(heads), np.iinfo(np.int64).max)
        np.minimum.at(least, own, heads)
        at = np.flatnonzero(heads != least[own])
        return pa.RecordBatch.from_arrays([pa.array(heads[at]), pa.array(least[own][at])], names=["head", "pivot"])

    able = grouped_arrow(members.join(known.drop("fp"), "head").select("pivot", "head", "n", "sign"), ["pivot"], cut, "head long, pivot long")
    return able.unionByName(dealt.where(F.col("size") >= SIGNED_GROUP).select("head", "pivot")).distinct()


def _group_edges(sets: DataFrame, pairs: DataFrame, keys: PrefixKeys | BandKeys) -> DataFrame:
    """Links ``(src, dst)`` between members that span the components of all
    links between sets that share a pivot."""
    size = pairs.groupBy("pivot").agg(F.ceil((F.count("*") + 1) / GROUP_PART).cast("int").alias("parts"))
    dealt = pairs.join(size, "pivot").withColumn("part", F.pmod(F.xxhash64("head"), "parts").cast("int"))
    # The pivot is in all parts of its group, and so joins these parts' components.
    every = size.select("pivot", F.col("pivot").alias("head"), "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    groups = dealt.select("pivot", "head", "parts", "part").unionByName(every)

    def within(rows: dict) -> pa.RecordBatch | None:
        if len(rows["member"]) < 2:
            return None
        tokens = [np.frombuffer(x, np.uint64) for x in rows["tokens"]]
        return _pairs(rows["member"], keys.join(tokens, np.arange(len(tokens)), None, Forest(len(tokens))))

    full = groups.join(sets.select("head", "member", "tokens"), "head")
    first = stage(grouped_arrow(full.select("pivot", "part", "member", "tokens"), ["pivot", "part"], within, "src long, dst long"), "similar-within")
    split = groups.where("parts > 1")
    if not split.take(1):
        return first
    # What isn't in its group's largest component yet goes to all other parts.
    joined = connected_components(first, "similar-parts").withColumnRenamed("node", "member")
    own = split.join(sets.select("head", "member"), "head").join(joined, "member", "left").withColumn("component", F.coalesce("component", "member"))
    counts = own.groupBy("pivot", "component").agg(F.count("*").alias("c"))
    main = counts.groupBy("pivot").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("components"))
    own = stage(own.join(main.where("components > 1"), "pivot").select("pivot", "parts", "part", "member", "component", "main"), "similar-split")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rest = own.where("component <> main").select("pivot", F.col("part").alias("home"), other.alias("part"), "member", "component", F.lit(True).alias("moves"))
    both = rest.where("home <> part").drop("home").unionByName(own.select("pivot", "part", "member", "component", F.lit(False).alias("moves")))

    def across(rows: dict) -> pa.RecordBatch | None:
        moves = np.array(rows["moves"])
        if not moves.any() or moves.all():
            return None
        tokens = [np.frombuffer(x, np.uint64) for x in rows["tokens"]]
        forest, seen = Forest(len(tokens)), {}
        for i, c in enumerate(rows["component"]):
            forest.union(i, seen.setdefault(c, i))
        return _pairs(rows["member"], keys.join(tokens, np.flatnonzero(moves), np.flatnonzero(~moves), forest))

    second = grouped_arrow(both.join(sets.select("member", "tokens"), "member"), ["pivot", "part"], across, "src long, dst long")
    # The parts' components stand for their links.
    joined = joined.select(F.col("member").alias("src"), F.col("component").alias("dst")).where("src <> dst")
    return joined.unionByName(stage(second, "similar-across"))


def link_counts(sets: DataFrame, found: DataFrame, copies: DataFrame, num: int, den: int) -> DataFrame:
    """``fp, links``: with how many documents each set of ``found`` (``fp,
    component``) is linked, those with an equal set aside; ``copies`` (``fp,
    copies``) has the documents of each set.

    All links are within components, so each one's sets are compared with each
    other, in blocks: of a large component, every two parts meet in a task that
    holds these two.  That work is a component's square, as its links are; what
    comes out is a number for each set and block.
    """
    size = found.groupBy("component").agg(F.ceil(F.count("*") / LINK_PART).cast("int").alias("parts"))
    dealt = found.join(size, "component").join(copies, "fp").withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    met = dealt.select("component", "fp", "copies", "part", other).select("component", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "fp", "copies", "part")
    full = met.join(sets.select("fp", "tokens"), "fp").select("component", "low", "high", "part", "fp", "copies", "tokens")

    def count(rows: dict) -> pa.RecordBatch | None:
        tokens = [np.frombuffer(x, np.uint64) for x in rows["tokens"]]
        part, weight = np.array(rows["part"]), np.array(rows["copies"], np.int64)
        n = np.array([len(x) for x in tokens])
        common = overlaps(tokens)
        linked = common * (num + den) >= num * (n[:, None] + n)
        np.fill_diagonal(linked, False)
        if rows["low"][0] != rows["high"][0]:  # each part by itself is another block
            linked &= part[:, None] != part
        return pa.RecordBatch.from_arrays([pa.array(rows["fp"], pa.binary()), pa.array(linked @ weight)], names=["fp", "links"])

    return grouped_arrow(full, ["component", "low", "high"], count, "fp binary, links long").groupBy("fp").agg(F.sum("links").alias("links"))


def overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many tokens every two sets have in common, by products of bounded
    slices of their incidence matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[token] > 1  # others are in no overlap
    number = np.cumsum(times > 1) - 1
    token, owner = number[token[shared]], owner[shared]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(token, [lo, lo + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], token[a:b] - lo] = 1
        out += np.rint(part @ part.T).astype(np.int64)
    return out


def _pairs(members: list[int], pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([members[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], names=["src", "dst"])


def _binary(fps: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(fps), [None, pa.py_buffer(np.ascontiguousarray(fps).tobytes())]).cast(pa.binary())


def _rows(ddl: str, count: int, /, **given: pa.Array) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [c.split() for c in ddl.split(",")]
    arrays = [given[n].cast(kinds[k]) if n in given else pa.nulls(count, kinds[k]) for n, k in fields]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])
