"""Helpers shared by the training-data operators: staging and text hashing.

Words everywhere in this subpackage are runs of bytes outside ``\\x20`` and
``\\x09-\\x0D``, compared after lower-casing ASCII A-Z.  They are hashed to 64
bits with numpy over a whole Arrow buffer at once, so no Python code runs per
word.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelake.sources.storage import remove

CHUNK_BYTES = 2 << 20
CHUNK_ROWS = 1 << 14
HASH_WINDOW = 1 << 20
LEAST_BITMAP, MOST_BITMAP, PART_BITMAP = 20, 28, 24
#: Whether Spark removes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths that were staged on the way to a table of ``stage_last``.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


# ---------------------------------------------------------------- staging


def shared_dir(spark: SparkSession) -> str:
    """The scratch folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it.  Only a local session may go without;
    it gets a temporary folder, since there the driver is the only machine.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends
    there and survives lost executors.  The write's shuffle files go with it;
    else they stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    own = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if own is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, own)
    if (passing := _PASSING.get()) is not None:
        passing.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_last(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stage what ``make`` returns; what was staged on the way to it goes."""
    passing: list[str] = []
    mark = _PASSING.set(passing)
    try:
        made = make()
    finally:
        _PASSING.reset(mark)
    last = stage(made, name)
    for path in passing:
        remove(spark, path)
    return last


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Have Arrow batches of at most ``rows`` rows in this session, unless it
    has set a number of its own: batches of long texts are held several times,
    in an executor's JVM and in its workers, and buffers once grown stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- hashing

_RNG = np.random.Generator(np.random.PCG64(7919))
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, HASH_WINDOW + 1)
        for k, base in enumerate((_BASE, _INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array (null: empty) and its row offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first
    word (one entry more than rows)."""
    inside = ~separators[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a row's start separates words
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, in windows of bounded memory."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + HASH_WINDOW, "right")))
        at = int(starts[lo])
        part = data[at : int(ends[hi - 1])]
        power, inverse = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * power[: len(part)], out=sums[1:])
        s, e = starts[lo:hi] - at, ends[lo:hi] - at
        out[lo:hi] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def hash_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, and for each row the index of its first."""
    data, offsets = text_buffer(texts)
    starts, ends, rows = word_spans(data, offsets)
    return hash_spans(data, starts, ends), rows


def word_hash(word: str) -> int:
    return int(hash_words(pa.array([word]))[0][0])


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles, in order, with their rows' offsets.

    A row with fewer words than ``k`` has its whole sequence as one shingle; a
    row without words has none.
    """
    counts = np.diff(rows)
    full = np.maximum(counts - k + 1, 0)
    short = (counts > 0) & (counts < k)
    n = np.where(short, 1, full)
    offsets = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(offsets[-1], np.uint64)
    if len(words) >= k and full.any():
        total = len(words) - k + 1
        rolled = np.zeros(total, np.uint64)
        for j in range(k):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + words[j : j + total]
        at = np.repeat(rows[:-1][full > 0] - offsets[:-1][full > 0], full[full > 0])
        where = np.repeat(full > 0, n)
        out[where] = mix(rolled[np.flatnonzero(where) + at])
    for r in np.flatnonzero(short):
        h = np.uint64(0)
        for w in words[rows[r] : rows[r + 1]]:
            h = np.uint64((int(h) * 0xD6E8FEB86659FD93 + int(w)) & 0xFFFFFFFFFFFFFFFF)
        out[offsets[r]] = mix(np.array([int(h) ^ (int(counts[r]) << 56)], np.uint64))[0]
    return out, offsets


#: What an operator's tasks leave in a worker for the next one, by name.
KEPT: dict[str, object] = {}


def keep(name: str, make: Callable[[], object]) -> object:
    """What ``name`` stands for in this worker, which holds one such thing."""
    if name not in KEPT:
        KEPT.clear()
        release()
        KEPT[name] = make()
    return KEPT[name]


def chunks(batches: Iterable[pa.RecordBatch], text: str, size: int = CHUNK_BYTES, keeps: str = "") -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches cut to a bounded number of bytes and rows, each with an id that
    no other task or chunk of the same job has.  Whatever other operators have
    left in this worker (but ``keeps``) goes."""
    if KEPT.keys() - {keeps}:
        KEPT.clear()
        release()
    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 16
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
            hi = min(max(hi, lo + 1), lo + CHUNK_ROWS, batch.num_rows)
            yield base + n, batch.slice(lo, hi - lo)
            n += 1
            lo = hi
    release()


def chunks_of_rows(batches: Iterable[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Batches cut to a bounded number of rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def release() -> None:
    """Give freed memory back: workers stay between tasks, and share an
    executor's memory with the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: equal ranges of the key space."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def grouped_arrow(df: DataFrame, keys: list[str], work: Callable[[dict], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Call ``work`` on each group's columns (name -> Python list).

    Groups have to be of bounded size; they come sorted, so a task holds one
    at a time, and thousands of small groups cost little each.
    """
    names = df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, {n: [] for n in names}
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_pylist() for i in range(len(names))]
            marks = list(zip(*(columns[names.index(k)] for k in keys), strict=True))
            cuts = [i for i in range(len(marks)) if marks[i] != (marks[i - 1] if i else last)]
            lo = 0
            for hi in [*cuts, len(marks)]:
                for n, c in zip(names, columns, strict=True):
                    rows[n] += c[lo:hi]
                if hi < len(marks) and rows[names[0]]:
                    if (out := work(rows)) is not None and out.num_rows:
                        yield out
                    rows = {n: [] for n in names}
                lo = hi
            last = marks[-1]
        if rows[names[0]] and (out := work(rows)) is not None and out.num_rows:
            yield out
        rows.clear()
        release()

    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).mapInArrow(run, schema)


def key_mask(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A bitmap of the top bits of the keys, and how many bits those are: about
    a sixteenth of it is set, until it is as large as it may get.  Tasks make
    it, as ``part, words``: rows of 2^``PART_BITMAP`` bits at most; parts
    without keys have none."""
    bits = min(max((16 * df.count()).bit_length(), LEAST_BITMAP), MOST_BITMAP)
    wide = min(bits, PART_BITMAP)

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[int, np.ndarray] = {}
        for batch in batches:
            part, slot = (np.asarray(batch.column(k)) for k in (0, 1))
            for p in np.unique(part).tolist():
                own = slot[part == p]
                np.bitwise_or.at(masks.setdefault(p, np.zeros(1 << (wide - 6), np.int64)), own >> 6, np.left_shift(1, own & 63))
        for p, mask in masks.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.ListArray.from_arrays(np.array([0, len(mask)], np.int32), mask)], names=["part", "words"])
        masks.clear()
        release()

    slot = F.shiftrightunsigned(key, 64 - bits)
    dealt = df.select(F.shiftright(slot, wide).cast("int").alias("part"), slot.bitwiseAND(F.lit((1 << wide) - 1)).alias("slot"))
    return dealt.repartition("part").mapInArrow(fill, "part int, words array<bigint>"), bits


def bitmap(df: DataFrame, key: str) -> tuple:
    """A broadcast ``key_mask`` by part, for tasks in Python."""
    parts, bits = key_mask(df, key)
    masks = {}
    for batch in parts.toArrow().to_batches():
        masks |= {p: words.values.to_numpy().view(np.uint64) for p, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)}
    return df.sparkSession.sparkContext.broadcast(masks), bits


def in_bitmap(masks: dict[int, np.ndarray], bits: int, keys: np.ndarray) -> np.ndarray:
    slot = keys >> np.uint64(64 - bits)
    found = np.zeros(len(keys), bool)
    for p, mask in masks.items():
        wide = np.uint64((64 * len(mask)).bit_length() - 1)
        at = np.flatnonzero(slot >> wide == np.uint64(p))
        own = slot[at] & ((np.uint64(1) << wide) - np.uint64(1))
        found[at] = (mask[own >> np.uint64(6)] >> (own & np.uint64(63))) & np.uint64(1)
    return found


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes to differ
    from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _bitmap_parts(df: DataFrame, few: DataFrame, key: str) -> tuple[DataFrame, F.Column]:
    """A bitmap of ``few``'s keys, and the condition by which a row of ``df``
    meets the part that says it may have one of them."""
    mask, bits = key_mask(few, key)
    part, words = unused(df, "part", "words")
    wide = min(bits, PART_BITMAP)
    slot = F.shiftrightunsigned(key, 64 - bits)
    word = F.element_at(words, F.shiftright(slot.bitwiseAND(F.lit((1 << wide) - 1)), 6).cast("int") + 1)
    bit = F.call_function("shiftrightunsigned", word, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
    # A few rows, whose size is bounded by MOST_BITMAP.
    return F.broadcast(mask.toDF(part, words)), (F.shiftright(slot, wide).cast("int") == F.col(part)) & (bit == 1)


def may_be_among(df: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """``df`` without the rows that a bitmap of the staged ``few``'s keys rules
    out; nothing is shuffled."""
    parts, may = _bitmap_parts(df, few, key)
    return df.join(parts, may, "left_semi")


def join_few(df: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """``df`` left joined with the staged ``few`` on ``key``, a hash; rows that
    a bitmap of its keys rules out stay where they are, without a shuffle."""
    away, near = few_and_others(df, few, key)
    return away.union(near)


def few_and_others(df: DataFrame, few: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The two parts of ``join_few``: rows that stay where they are, and those
    that are looked up."""
    parts, may = _bitmap_parts(df, few, key)
    other = few.drop(key).schema
    away = df.join(parts, may, "left_anti").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in other])
    return away, df.join(parts, may, "left_semi").join(few, key, "left").select(*[F.col(f"`{c}`") for c in df.columns], *other.names)


# ---------------------------------------------------------------- graphs


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(src long, dst long)`` links to ``(node, component)``: the smallest
    node that each node reaches.

    Alternating large-star and small-star rounds over staged tables.  Minima
    are pre-aggregated and joined back, so a node with very many neighbours
    isn't gathered anywhere; skewed join partitions can be split.
    """
    now = stage(
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct(),
        name,
    )
    # One table is written per round; edges become few within two or three.
    digest = [F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))]
    before = now.agg(*digest).first()
    while before[0]:
        # Large star: larger neighbours of a node go to its smallest neighbour (or itself).
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        least = down.groupBy("src").agg(F.min("dst").alias("m"))
        moved = down.join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        now = stage(moved.unionByName(least.select("src", F.col("m").alias("dst"))).distinct(), name)
        after = now.agg(*digest).first()
        if after == before:
            break
        before = after
    nodes = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return nodes.unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
