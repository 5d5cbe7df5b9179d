"""Best-fit packing: token sequences filled by fitted length patterns.

The plan needs only the histogram of lengths, which has as many entries as a
sequence has tokens, however many documents there are.  Patterns of a few
lengths are enumerated on a coarse grid and their repeat counts fitted to the
histogram by non-negative least squares; rounded patterns are laid out with
real lengths, the last of each chosen to fit best; residual documents go into
the smallest gap that holds them.  Documents then find their places by their
rank among those of their length.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cachelake.llm.common import chunks, keep, release, shuffle_partitions, stage, text_buffer

GRID = 64
MOST_PARTS = 5


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- the plan


def patterns(units: int = GRID, parts: int = MOST_PARTS) -> np.ndarray:
    """All ways to fill ``units`` exactly with up to ``parts`` lengths, as
    counts of each length (a row each)."""
    found: list[list[int]] = []

    def extend(sofar: list[int], left: int, least: int) -> None:
        if not left:
            found.append(sofar)
            return
        if len(sofar) == parts:
            return
        for x in range(least, left + 1):
            if x == left or left - x >= x:
                extend([*sofar, x], left - x, x)

    extend([], units, 1)
    out = np.zeros((len(found), units), np.float32)
    for i, p in enumerate(found):
        np.add.at(out[i], np.array(p) - 1, 1)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares by the active-set method of Lawson and
    Hanson: argmin |a x - b|, x >= 0."""
    gram, rhs = a.T @ a if a.shape[1] <= 64 else None, a.T @ b
    x, active = np.zeros(a.shape[1]), []
    tolerance = 1e-9 * max(1.0, float(np.abs(rhs).max(initial=0)))
    for _ in range(rounds):
        gradient = rhs - a.T @ (a @ x) if gram is None else rhs - gram @ x
        gradient[active] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= tolerance:
            break
        active.append(best)
        while active:
            fit = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (fit > 0).all():
                x[:] = 0
                x[active] = fit
                break
            old = x[active]
            low = fit <= 0
            step = float(np.min(old[low] / np.maximum(old[low] - fit[low], 1e-300)))
            moved = old + step * (fit - old)
            x[:] = 0
            x[active] = moved
            active = [k for k, v in zip(active, moved, strict=True) if v > 1e-12]
    return x


def plan(histogram: np.ndarray, most: int) -> list[tuple[int, list[int], int]]:
    """Groups of sequences ``(repeats, lengths, gap)`` that hold exactly the
    documents of ``histogram`` (``histogram[n]``: how many of n tokens).

    Its size is bounded by the number of patterns and of lengths, since each
    step uses up a pattern, a length or a gap.
    """
    left = np.array(histogram, dtype=np.int64)
    groups: list[tuple[int, list[int], int]] = []
    if left[most]:
        groups.append((int(left[most]), [most], 0))
        left[most] = 0
    unit = most / GRID
    grid = np.minimum(np.ceil(np.arange(most + 1) / unit).astype(int), GRID)
    coarse = np.bincount(grid, left, GRID + 1)[1:]
    forms = patterns()
    # Residuals of long lengths waste more, so they weigh more.
    weight = np.sqrt(np.arange(1, GRID + 1))
    repeats = np.floor(nnls((forms * weight).T.astype(float), coarse * weight) + 0.5).astype(np.int64)

    def longest(top: int) -> int:
        at = np.flatnonzero(left[1 : top + 1])
        return int(at[-1]) + 1 if len(at) else 0

    for k in np.argsort(-repeats, kind="stable"):
        todo = int(repeats[k])
        cells = [c + 1 for c in reversed(range(GRID)) for _ in range(int(forms[k][c]))]
        while todo > 0:
            used: dict[int, int] = {}
            lengths: list[int] = []
            room = most
            for n, cell in enumerate(cells):
                last = n == len(cells) - 1
                top = room if last else min(room, int(cell * unit))
                low = 0 if last else int((cell - 1) * unit)
                while top > low and left[top] <= used.get(top, 0):
                    top -= 1
                if top <= low:
                    lengths = []
                    break
                lengths.append(top)
                used[top] = used.get(top, 0) + 1
                room -= top
            if not lengths or room > unit:
                break
            times = min(todo, min(int(left[n]) // c for n, c in used.items()))
            for n, c in used.items():
                left[n] -= times * c
            groups.append((times, lengths, room))
            todo -= times
    # Residuals, longest first, each into the smallest gap that holds it.
    gaps: dict[int, list[tuple[int, list[int]]]] = {}
    done: list[tuple[int, list[int], int]] = []
    for times, lengths, room in groups:
        gaps.setdefault(room, []).append((times, lengths)) if room else done.append((times, lengths, 0))
    open_ = np.zeros(most + 1, bool)
    open_[list(gaps)] = True
    while size := longest(most):
        at = np.flatnonzero(open_[size:])
        if len(at):
            room = int(at[0]) + size
            times, lengths = gaps[room].pop()
            if not gaps[room]:
                open_[room] = False
        else:
            room, times, lengths = most, int(left[size]) // max(1, most // size) or 1, []
        each = min(room // size, max(1, int(left[size]) // times))
        fill = min(times, int(left[size]) // each)
        left[size] -= fill * each
        if times > fill and lengths:
            gaps.setdefault(room, []).append((times - fill, lengths))
            open_[room] = True
        rest = room - each * size
        if rest:
            gaps.setdefault(rest, []).append((fill, lengths + [size] * each))
            open_[rest] = True
        else:
            done.append((fill, lengths + [size] * each, 0))
    return done + [(times, lengths, room) for room, each in gaps.items() for times, lengths in each]


def places(groups: list[tuple[int, list[int], int]], most: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: ranks at which runs of places begin, the runs' first
    sequence ids and their offsets."""
    runs: dict[int, tuple[list[int], list[int], list[int]]] = {}
    taken = np.zeros(most + 1, np.int64)
    sequence = 0
    for times, lengths, _ in groups:
        offset = 0
        for n in lengths:
            start, first, at = runs.setdefault(n, ([], [], []))
            start.append(int(taken[n]))
            first.append(sequence)
            at.append(offset)
            taken[n] += times
            offset += n
        sequence += times
    return {n: tuple(np.array(x, np.int64) for x in r) for n, r in runs.items()}


# ---------------------------------------------------------------- documents


class WordIds(dict):
    """Token ids of white-space-separated words, as little-endian bytes.

    The vocabulary's rules never join tokens across white space, nor letters
    or digits with the punctuation behind them, so words and such endings can
    be looked up one by one.  A worker keeps what it has learned from task to
    task; the memory is bounded: it is emptied when full.
    """

    TOGETHER = 4096

    def __init__(self, path: str, most: int = 900_000):
        from tokenizers import Tokenizer

        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + 2 * len(new) > self.most:
            self.clear()
            new = list(words)
        parts: dict[bytes, tuple[bytes, bytes]] = {}
        for w in new:
            stem = w.rstrip(b".,;:!?")
            if w.isascii():
                stem = stem.lower()
            if not stem or len(stem) == len(w) and stem == w:
                continue
            if not (stem[-1:].isalnum() or stem[-1] >= 128 and stem.decode("utf-8", "replace")[-1].isalnum()):
                continue
            parts[w] = stem, w[len(stem) :]
        self._encode({x for w in new for x in parts.get(w, (w,)) if x and x not in self})
        for w, (stem, tail) in parts.items():
            self[w] = self[stem] + (self[tail] if tail else b"")

    def _encode(self, words: set[bytes]) -> None:
        rest = list(words)
        for lo in range(0, len(rest), self.TOGETHER):
            # One text of many words; tokens find their words by where they begin.
            some = rest[lo : lo + self.TOGETHER]
            texts = [w.decode("utf-8", "replace") for w in some]
            found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            begin = np.fromiter((o[0] for o in found.offsets), np.int64, len(ids))
            ends = np.cumsum([len(t) + 1 for t in texts])
            cut = np.searchsorted(begin, np.concatenate([[0], ends]))
            for w, a, b in zip(some, cut[:-1], cut[1:], strict=True):
                self[w] = ids[a:b].tobytes()


def token_pieces(docs: DataFrame, most: int, vocabulary: str, end_id: int, kept_words: int, remember: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = keep(vocabulary, lambda: WordIds(vocabulary, kept_words))
        end = np.array([end_id], "<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for _, batch in chunks(batches, "text", 4 << 20 if remember else 2 << 20, vocabulary):
            data, offsets = text_buffer(batch.column(1))
            raw = data.tobytes()
            out: list[list[int | None]] = [[] for _ in names]
            split = [raw[a:b].split() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            words.learn(set().union(*split))
            for doc_id, tokens in zip(batch.column(0).to_pylist(), split, strict=True):
                ids = b"".join(map(words.__getitem__, tokens)) + end
                for piece, lo in enumerate(range(0, len(ids), 4 * most)):
                    part = ids[lo : lo + 4 * most]
                    for column, value in zip(out, (doc_id, piece, lo // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=names)
        if not remember:
            words.clear()
            release()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, most: int = 4096, vocabulary: str | None = None, end_id: int = 1, kept_words: int = 900_000, remember: bool = True) -> DataFrame:
    """Pack all documents into few sequences of at most ``most`` tokens.

    Returns per piece ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``.  Only documents longer than ``most`` tokens are cut.  Null and
    empty texts are the end token alone; repeated rows and null ids are packed
    like others; other columns are ignored; an empty table gives no rows.  ``kept_words`` bounds the words whose
    ids a worker remembers (about 250 bytes each), and without ``remember`` it
    forgets them after each task: both trade time for memory only.
    """
    spark = docs.sparkSession
    pieces = stage(token_pieces(docs, most, vocabulary or default_vocabulary(), end_id, kept_words, remember), "pack-pieces")
    # A frequent length is ranked in parts, whose first ranks come from their counts.
    parts = shuffle_partitions(spark)
    salted = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = salted.groupBy("length", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("_first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    lengths = pieces.groupBy("length").agg(F.count("*").alias("n")).toArrow()  # at most `most` rows
    histogram = np.zeros(most + 1, np.int64)
    histogram[np.asarray(lengths["length"])] = np.asarray(lengths["n"])
    runs = spark.sparkContext.broadcast(places(plan(histogram, most), most))  # bounded by patterns and lengths, see plan()

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cut = np.flatnonzero(np.diff(length[order], prepend=-1))
            for at in np.split(order, cut[1:]) if len(order) else []:
                start, first, where = runs.value[int(length[at[0]])]
                run = np.searchsorted(start, rank[at], "right") - 1
                sequence[at] = first[run] + rank[at] - start[run]
                offset[at] = where[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    order = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_n", F.row_number().over(order) - 1).join(firsts.select("length", "_part", "_first"), ["length", "_part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_n") + F.col("_first")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
