"""Periodic runs in texts: stretches of words that repeat at a fixed distance.

The suffixes of a text's words are sorted by prefix doubling; the bottom-up
traversal of their LCP-interval tree merges the children's positions, and pairs
of positions from different children that have different left words are exactly
the maximal pairs (i, j, l): the l words at i and at j are equal, and neither
side can be extended.  A pair whose distance q = j - i is at most l / 2 is a run
of period q from i to j + l as it stands, since its words are equal q apart and
maximality on both sides is the run's; nothing has to be extended.

Only such near pairs are looked at.  Occurrences of one string at most half its
length apart follow each other at its smallest period, so a run with smallest
period q appears as two *neighbours* of an interval's positions in text order;
positions further along the same chain only give multiples of q.  The left words
of such a chain are of two classes, the first's and all others'.  So an
interval keeps its positions in text order with their left-word classes, the
smaller child is merged into the larger, and each position meets its two
neighbours: O(n log n) steps without pairs that are dropped afterwards.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cachelake.llm.common import chunks, mix, text_buffer, unused

LEAST_WORDS, LEAST_PERIODS = 24, 3
WORDS = r"[^\x20\x09-\x0D]+"
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


# ---------------------------------------------------------------- suffixes


def repeated_grams(words: np.ndarray, k: int) -> np.ndarray:
    """Which positions begin ``k`` words that also begin elsewhere, by hash: no
    such position is left out."""
    if len(words) < k + 1:
        return np.zeros(len(words), bool)
    total = len(words) - k + 1
    mixed, rolled = mix(words.astype(np.uint64)), np.zeros(total, np.uint64)
    for j in range(k):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + mixed[j : j + total]
    found = np.sort(rolled)
    twice = np.unique(found[1:][found[1:] == found[:-1]])
    out = np.zeros(len(words), bool)
    if len(twice):
        out[:total] = twice[np.minimum(np.searchsorted(twice, rolled), len(twice) - 1)] == rolled
    return out


def suffix_order(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in the order of their suffixes, the common prefix of each with
    the one before where that is ``least`` words or more (else 0), and for each
    position a number that those with the same first words share.

    Prefix doubling that only goes on with suffixes not yet told apart.  The
    ranks of all lengths are kept, four bytes a word each; by them the length at
    which two neighbours part is found going down again.
    """
    n = len(words)
    _, rank, count = np.unique(words, return_inverse=True, return_counts=True)
    rank = np.append((np.cumsum(count) - count)[rank], -1).astype(np.int64)  # a group's first place
    group = rank[:-1].copy()
    levels, parted, k = [rank.astype(np.int32)], [], 1
    size = np.bincount(rank[:-1], minlength=n)
    active = np.flatnonzero(size[rank[:-1]] > 1)
    while len(active):
        after = active + k
        second = np.where(after < n, rank[np.minimum(after, n)], -1)
        order = np.lexsort((second, rank[active]))
        active, second = active[order], second[order]
        old = rank[active]
        new_group = np.append(True, old[1:] != old[:-1])
        new_run = new_group.copy()
        new_run[1:] |= second[1:] != second[:-1]
        at = np.arange(len(active))
        run = np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
        place = old + run - np.flatnonzero(new_group)[np.cumsum(new_group) - 1]
        if 2 * k > least:
            cut = at[new_run & ~new_group]
            parted.append((place[cut], active[cut - 1], active[cut], np.full(len(cut), k)))
        rank[active] = place
        length = np.diff(np.append(np.flatnonzero(new_run), len(active)))[np.cumsum(new_run) - 1]
        active, k = active[length > 1], 2 * k
        levels.append(rank.astype(np.int32))
        if k <= least:
            group = rank[:-1].copy()
    order, common = np.empty(n, np.int64), np.zeros(n + 1, np.int64)
    order[rank[:-1]] = np.arange(n)
    if parted:
        place, left, right, known = (np.concatenate(x) for x in zip(*parted, strict=True))
        length = known.copy()
        for j in range(len(levels) - 1, -1, -1):
            a, b = np.minimum(left + length, n), np.minimum(right + length, n)
            length += ((1 << j) < known) * (levels[j][a] == levels[j][b]) << j
        common[place] = np.where(length >= least, length, 0)
    return order, common, group


# ---------------------------------------------------------------- the tree


def maximal_pairs(order: list[int], common: list[int], before: np.ndarray) -> list[tuple[int, int, int]]:
    """``i, j, l`` with i < j <= i + l / 2 of the LCP-interval tree over
    ``order``, bottom-up; ``before`` has each position's left word."""
    pairs: list[tuple[int, int, int]] = []

    def merge(a: list[int], b: list[int], length: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        reach = length // 2
        for x in b:
            at = bisect_left(a, x)
            if at and x - a[at - 1] <= reach and before[x] != before[a[at - 1]]:
                pairs.append((a[at - 1], x, length))
            if at < len(a) and a[at] - x <= reach and before[x] != before[a[at]]:
                pairs.append((x, a[at], length))
        if 8 * len(b) < len(a):
            for x in b:
                insort(a, x)
        else:
            a += b
            a.sort()
        return a

    lengths: list[int] = []  # of the open intervals, ascending
    held: list[list[int]] = []  # their positions so far
    child: list[int] = []
    for x, length in zip(order, common, strict=True):
        while lengths and lengths[-1] > length:
            child = merge(held.pop(), child, lengths.pop())
        if not length:
            child = [x]
            continue
        if lengths and lengths[-1] == length:
            held[-1] = merge(held[-1], child, length)
        else:
            lengths.append(length)
            held.append(child)
        child = [x]
    while lengths:
        child = merge(held.pop(), child, lengths.pop())
    return pairs


def runs_of(words: np.ndarray, rows: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """``start, length, period`` of each row's runs, by start and period.

    ``words`` are numbers that no two rows share, ``rows`` the index of each
    row's first.  A run of L words and period q is a pair with L - q words in
    common, so that these are at least ``2 / 3 * least_words``; texts that don't repeat so many
    words aren't sorted.
    """
    if least_periods < 3:
        raise ValueError("a maximal pair is a run from three periods on")
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(rows) - 1)]
    least = max(1, -(-least_words * (least_periods - 1) // least_periods))
    repeated = np.append(0, np.cumsum(repeated_grams(words, least)))
    some = np.flatnonzero(repeated[rows[1:]] > repeated[rows[:-1]])
    if not len(some):
        return out
    sizes = np.diff(rows)[some]
    starts = np.append(0, np.cumsum(sizes))
    shift = np.repeat(rows[:-1][some] - starts[:-1], sizes)
    words = words[np.arange(starts[-1]) + shift]
    order, common, group = suffix_order(words, least)
    before = np.append(-1, words[:-1])
    before[starts[:-1]] = -1
    # A pair's distance is at least that to the nearest place with the same first words.
    most = np.empty(len(words), np.int64)
    most[order] = np.maximum(common[:-1], common[1:])
    near = np.full(len(words), len(words) + 1)
    by = np.lexsort((np.arange(len(words)), group))
    gap = np.where(group[by][1:] == group[by][:-1], np.diff(by), len(words) + 1)
    near[by[1:]] = gap
    near[by[:-1]] = np.minimum(near[by[:-1]], gap)
    kept = np.flatnonzero((most >= 2 * near)[order])
    if not len(kept):
        return out
    # The common prefix with the kept position before is the least of those between.
    between = np.minimum.reduceat(common, np.append(0, kept + 1))[:-1]
    between[0] = 0
    least_period: dict[tuple[int, int], int] = {}
    for i, j, length in maximal_pairs(order[kept].tolist(), between.tolist(), before):
        period, whole = j - i, j - i + length
        if whole >= max(least_words, least_periods * period):
            least_period[i, whole] = min(period, least_period.get((i, whole), period))
    places = sorted((i, period, whole) for (i, whole), period in least_period.items())
    of = np.searchsorted(starts, [i for i, _, _ in places], "right") - 1
    for row, (i, period, whole) in zip(of.tolist(), places, strict=True):
        out[some[row]].append((i - int(starts[row]), whole, period))
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay if of each run the first period does."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


# ---------------------------------------------------------------- the operator


def periodic_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """``docs`` with each text's ``n_words``, its ``runs`` (an array of start,
    length and period, by start and period, words counted from 0) and its
    ``collapsed`` text: words that a run has after its first period are dropped,
    the others joined by one space.

    Words are runs of bytes outside ``\\x20`` and ``\\x09-\\x0D`` and are
    compared as they are.  Null and empty texts have no words, no runs and an
    empty collapsed text; repeated rows have equal results; texts are taken
    whole, in memory that grows with the longest; all columns stay, and a new
    one whose name is taken gets underscores in front; an empty table stays
    empty.  Each row is worked on where it is: nothing is shuffled.
    """
    n_words, runs, collapsed = unused(docs, "n_words", runs, collapsed)
    (own,) = unused(docs, "_text")
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch in chunks(batches, own):
            data, offsets = text_buffer(batch.column(batch.num_columns - 1))
            texts, numbers, rows, base = [], [], [0], 0
            for i in range(batch.num_rows):
                words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                known = {w: j for j, w in enumerate(dict.fromkeys(words), base)}
                texts.append(words)
                numbers.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                rows.append(rows[-1] + len(words))
                base += len(known)
            found = runs_of(np.concatenate(numbers), np.array(rows), least_words, least_periods)
            for i, own_runs in enumerate(found):
                if own_runs:
                    stays = kept_words(len(texts[i]), own_runs).tolist()
                    texts[i] = [w for w, s in zip(texts[i], stays, strict=True) if s]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.diff(rows)), pa.array([[{"start": s, "length": n, "period": q} for s, n, q in x] for x in found], run_type), pa.array([b" ".join(w) for w in texts], pa.binary()).cast(pa.string())],
                names=[*batch.schema.names[:-1], n_words, runs, collapsed],
            )

    held = docs.withColumn(own, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    new = T.StructType().add(n_words, "long").add(runs, RUNS).add(collapsed, "string")
    return held.mapInArrow(work, T.StructType([*docs.schema.fields, *new.fields]))


def repeat_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the periodic tails that the query plants: a tenth
    of the documents, by their ids' CRC-32, goes on with the words from a on at
    period p.  A null id plants nothing."""
    words, h = F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), F.crc32(F.col("doc_id").cast("string"))
    planted = docs.select("doc_id", "text", h.alias("h"), F.expr("cast(null as array<string>)").alias("w"))
    planted = planted.withColumn("w", F.when(F.col("h") % 10 == 0, words))
    g = "(h div 10)"
    planted = planted.withColumn("a", F.expr(f"case when size(w) > 0 then cast({g} % size(w) as int) end"))
    planted = planted.withColumn("p", F.expr(f"cast(1 + (size(w) - a) div (3 + {g} % 8) as int)"))
    tail = "transform(sequence(0, size(w) - a - 1), i -> element_at(w, cast(a + i % p + 1 as int)))"
    return planted.select("doc_id", F.expr(f"case when a is null then text else concat_ws(' ', concat(slice(w, 1, a), {tail})) end").alias("text"))


def periodic_documents(docs: DataFrame) -> DataFrame:
    """The query: runs of all documents after ``repeat_tails``, as digests."""
    found = periodic_runs(repeat_tails(docs))
    longer = "l.length * r.period > r.length * l.period"
    shorter = "l.length * r.period < r.length * l.period"
    first = f"array_sort(runs, (l, r) -> case when {longer} then -1 when {shorter} then 1 when l.start <> r.start then cast(sign(l.start - r.start) as int) else cast(sign(l.period - r.period) as int) end)"
    best = found.withColumn("best", F.expr(f"case when size(runs) > 0 then {first}[0] end"))
    lines = "concat_ws('', transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\\n')))"
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.expr(lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
