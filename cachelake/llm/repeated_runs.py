"""Runs of words that repeat exactly, wherever they begin and end.

1. Every window of ``min_words`` words has an anchor: the least hash of the
   half-length shingles in it.  It depends on the window's words only, so equal
   windows have equal anchors, of which there are few (winnowing).
2. Windows whose anchor was chosen twice send their own hash.  The text in
   which a hash is first keeps it; later ones lose all words of such windows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelake.llm.common import bitmap, chunks, hash_words, in_bitmap, mix, release, shard_of, shuffle_partitions, stage, word_spans

SPANS = "array<struct<word:bigint,words:bigint,kept_doc_id:bigint>>"


def _windows(batch: pa.RecordBatch, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of ``m`` words of what ``gone`` leaves of a chunk's texts:
    their rows, first words (within what is left), anchors and hashes."""
    words, rows = hash_words(batch.column(batch.schema.get_field_index("text")))
    gone = batch.column(batch.schema.get_field_index("gone"))
    if gone.null_count < len(gone):
        left = np.ones(len(words), bool)
        for r in np.flatnonzero(np.asarray(gone.is_valid())):
            for span in gone[int(r)].as_py():
                left[rows[r] + span["word"] : rows[r] + span["word"] + span["words"]] = False
        words, rows = words[left], np.concatenate([[0], np.cumsum(left)])[rows]
    n = len(words) - m + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    k = (m + 1) // 2
    rolled = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + words[j : j + len(rolled)]
    rolled = mix(rolled)
    span, least = 1, rolled
    while span * 2 <= m - k + 1:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    # Least hashes are small numbers; shards and bitmaps go by the top bits.
    least = mix(np.minimum(least[:n], least[m - k + 1 - span :][:n]))
    hashes = mix(rolled[:n] * np.uint64(0x9FB21C651E98DF25) + mix(rolled[m - k :]))
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    whole = row[:n] == row[m - 1 :]
    at = np.flatnonzero(whole)
    return row[at], at - rows[row[at]], least[at], hashes[at]


def repeated_runs(docs: DataFrame, m: int) -> DataFrame:
    """``rk, passages`` of the texts that repeat ``m`` words or more of another.

    ``docs`` has ``rk, doc_id, text`` and ``gone``, passages that have gone
    already; words are counted without them.  Places are ordered by (doc_id, rk, word), null ids
    first; rows of one ``rk`` are alike.  What a
    text repeats of itself stays.  ``passages`` are the words that go.
    """
    spark = docs.sparkSession
    shards = shuffle_partitions(spark)

    def anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch in chunks(batches, "text"):
            row, word, anchor, _ = _windows(batch, m)
            if not len(row):
                continue
            new = np.ones(len(row), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (word[1:] != word[:-1] + 1)
            at = np.flatnonzero(new)
            # One place is the anchor of no more windows than there are shingles in one.
            times = 1 + (np.diff(np.append(at, len(row))) > m // 2 + 1)
            keys, back = np.unique(anchor[at], return_inverse=True)
            times = np.minimum(np.bincount(back, times), 2).astype(np.int64)
            cut = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array([np.repeat(keys[cut[i] : cut[i + 1]], times[cut[i] : cut[i + 1]]).tobytes() for i in some], pa.binary())], names=["key_shard", "keys"]
            )

    def repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [np.frombuffer(x.as_buffer(), np.uint64) for batch in batches for x in batch.column(1)]
        if not keys:
            return
        k = np.sort(np.concatenate(keys))
        found = np.unique(k[1:][k[1:] == k[:-1]]).view(np.int64)
        for lo in range(0, len(found), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(found[lo : lo + (1 << 16)])], names=["anchor"])
        del keys, k, found
        release()

    wanted = stage(docs.mapInArrow(anchors, "key_shard int, keys binary").repartitionById(shards, F.col("key_shard")).mapInArrow(repeated, "anchor long"), "run-anchors")
    shared, bits = bitmap(wanted, "anchor")

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch in chunks(batches, "text"):
            row, word, anchor, hashes = _windows(batch, m)
            hit = in_bitmap(shared.value, bits, anchor)
            if not hit.any():
                continue
            row, word, hashes = row[hit], word[hit], hashes[hit]
            shard = shard_of(hashes, shards)
            order = np.argsort(shard, kind="stable")  # rows and words stay in order
            row, word, hashes = row[order], word[order], hashes[order]
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            rk, ids = (batch.column(batch.schema.get_field_index(c)) for c in ("rk", "doc_id"))
            valid = np.asarray(ids.is_valid())
            rk, ids = np.asarray(rk), np.asarray(ids.fill_null(0))
            some, blobs = np.flatnonzero(np.diff(cut)), []
            for i in some:
                r, n = np.unique(row[cut[i] : cut[i + 1]], return_counts=True)
                heads = np.stack([valid[r].astype(np.int64), ids[r], rk[r], n])
                blobs.append([x.tobytes() for x in (heads, word[cut[i] : cut[i + 1]].astype(np.uint32), hashes[cut[i] : cut[i + 1]])])
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array([b[j] for b in blobs], pa.binary()) for j in range(3))], names=["key_shard", "heads", "words", "hashes"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, words, hashes = [], [], []
        for batch in batches:
            heads += [np.frombuffer(x.as_buffer(), np.int64).reshape(4, -1) for x in batch.column(1)]
            words += [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(2)]
            hashes += [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(3)]
        if not heads:
            return
        head, word, h = np.concatenate(heads, 1), np.concatenate(words), np.concatenate(hashes)
        del heads, words, hashes
        order = np.lexsort((head[2], head[1], head[0]))
        ordered = head[:3, order]
        new = np.concatenate([[True], (ordered[:, 1:] != ordered[:, :-1]).any(0)])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        place = ordered[:, new]
        # A place is one number: its text's rank and its word.
        at = (np.repeat(rank, head[3]) << 32) | word.astype(np.int64)
        order = np.lexsort((at, h))
        h, at = h[order], at[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        first = np.repeat(at[start], np.diff(np.append(start, len(h))))
        again = at >> 32 != first >> 32
        pair, word = np.stack([at[again] >> 32, first[again] >> 32]), at[again] & 0xFFFFFFFF
        if not len(word):
            return
        order = np.lexsort((word, pair[1], pair[0]))
        pair, word = pair[:, order], word[order]
        new = np.concatenate([[True], (pair[:, 1:] != pair[:, :-1]).any(0)])
        cut = np.append(np.flatnonzero(new), len(word))
        for lo in range(0, len(cut) - 1, 1 << 12):
            part = cut[lo : lo + (1 << 12) + 1]
            own, kept = pair[:, part[:-1]]
            blobs = [np.unique(word[a:b]).astype(np.uint32).tobytes() for a, b in zip(part[:-1], part[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(place[2, own]), pa.array(place[1, kept], mask=place[0, kept] == 0), pa.array(blobs, pa.binary())], names=["rk", "kept_doc_id", "words"]
            )
        del h, at, first, again, pair, word, order
        release()

    def spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for parts in batch.column(1).to_pylist():
                word = [np.frombuffer(p["words"], np.uint32).astype(np.int64) for p in parts]
                kept = np.repeat(np.arange(len(parts)), [len(w) for w in word])
                word = np.concatenate(word)
                order = np.argsort(word, kind="stable")
                word, kept = word[order], kept[order]
                # Windows that overlap are one run.
                cut = np.flatnonzero(np.concatenate([[True], np.diff(word) > m]))
                last = np.append(cut[1:], len(word)) - 1
                found.append([{"word": int(word[a]), "words": int(word[b] + m - word[a]), "kept_doc_id": parts[kept[a]]["kept_doc_id"]} for a, b in zip(cut, last, strict=True)])
            kind = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("kept_doc_id", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["rk", "passages"])

    met = docs.mapInArrow(places, "key_shard int, heads binary, words binary, hashes binary").repartitionById(shards, F.col("key_shard"))
    met = met.mapInArrow(meet, "rk long, kept_doc_id long, words binary").groupBy("rk").agg(F.collect_list(F.struct("kept_doc_id", "words")).alias("parts"))
    found = stage(met.mapInArrow(spans, f"rk long, passages {SPANS}"), "run-spans")
    shared.destroy()
    return found


def cut_runs(text: pa.Array, near: pa.Array, exact: pa.Array) -> pa.Array:
    """Texts without their passages, and all passages in words of the texts as
    they came.  ``exact`` counts words without ``near``.  A passage takes the
    space in front of it along, or, at the start of a line, the one behind it."""
    texts, spans = [], []
    for value, first, then in zip(text.to_pylist(), near.to_pylist(), exact.to_pylist(), strict=True):
        first, then = first or [], then or []
        if value is None or not first and not then:
            texts.append(value)
            spans.append([])
            continue
        data = np.frombuffer(value.encode(), np.uint8)
        starts, ends, _ = word_spans(data, np.array([0, len(data)]))
        gone = np.zeros(len(starts) + 1, bool)
        for run in first:
            gone[run["word"] : run["word"] + run["words"]] = True
        left = np.flatnonzero(~gone[:-1])
        for run in then:
            own = left[run["word"] : run["word"] + run["words"]]
            gone[own] = True
            # A passage around one that has gone is told as its parts.
            for part in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                first = [*first, {"word": int(part[0]), "words": len(part), "kept_doc_id": run["kept_doc_id"]}]
        edge = np.flatnonzero(np.diff(gone, prepend=False))
        keep = np.ones(len(data), bool)
        for a, b in edge.reshape(-1, 2).tolist():
            fresh = a == 0 or b < len(starts) and 10 in data[ends[a - 1] : starts[a]]
            lo, hi = (starts[a] if fresh else ends[a - 1]), (starts[b] if fresh and b < len(starts) else ends[b - 1])
            keep[lo : len(data) if a == 0 and b == len(starts) else hi] = False
        texts.append(data[keep].tobytes().decode())
        spans.append(sorted(first, key=lambda run: run["word"]))
    kind = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("kept_doc_id", pa.int64())]))
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(spans, kind)], names=["text", "passages"])
