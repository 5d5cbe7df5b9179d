"""Substring dedup: passages that repeat across documents leave all but one."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelake.llm.common import few_and_others, hash_words, join_few, mix, shingle_hashes, stage, stage_last, unused
from cachelake.llm.repeated_runs import SPANS, cut_runs, repeated_runs
from cachelake.llm.similarity import BandKeys, Units, distinct_sets, find_links

#: A paragraph's least length, but at both ends of a text.
REACH = 32


def paragraph_starts(words: np.ndarray, rows: np.ndarray, reach: int = REACH) -> np.ndarray:
    """First words of all paragraphs: of each text, and wherever the hash of
    two words is the least of those up to ``reach`` words before and after.

    The cuts depend on the words around them only, not on line ends or on what
    a text begins with: equal passages are cut alike.
    """
    n = np.diff(rows)
    row = np.repeat(np.arange(len(n)), n)
    top = np.iinfo(np.uint64).max
    # Texts are kept apart by as many largest values as a window has.
    at = np.arange(len(words)) + reach * (row + 1)
    spread = np.full(len(words) + reach * (len(n) + 1), top)
    pair = words.copy()
    pair[1:] = words[1:] * np.uint64(0xD6E8FEB86659FD93) + words[:-1]
    spread[at] = mix(pair)
    least, width = spread, 1
    while width * 2 <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: len(spread) - reach + 1], least[reach - width :])
    own = spread[at]
    cut = (own < least[at - reach]) & (own <= least[np.minimum(at + 1, len(least) - 1)])
    cut[rows[:-1][n > 0]] = True
    return np.flatnonzero(cut)


def read_paragraphs(shingle: int, batch: pa.RecordBatch) -> Units:
    """The shingle sets of all paragraphs of a chunk, whatever their length."""
    words, rows = hash_words(batch.column(batch.schema.get_field_index("text")))
    starts = paragraph_starts(words, rows)
    bounds = np.append(starts, len(words))
    ordered = shingle_hashes(words, bounds, shingle)
    tokens, offsets = distinct_sets(*ordered)
    row = np.searchsorted(rows, starts, "right") - 1
    of = {c: batch.column(batch.schema.get_field_index(c)).take(pa.array(row)) for c in ("doc_id", "rk")}
    return Units(tokens, offsets, {**of, "word": pa.array(starts - rows[row]), "words": pa.array(np.diff(bounds)), "total": pa.array(np.diff(rows)[row])}, ordered)


def substring_dedup(docs: DataFrame, min_words: int = 50, shingle: int = 5, num: int = 4, den: int = 5, bands: int = 9, rows: int = 3, passages: str = "passages") -> DataFrame:
    """Remove passages of at least ``min_words`` words that repeat, nearly or
    exactly, and repeated texts of any length.

    Paragraphs are cut where the words say so (``paragraph_starts``), so they
    don't hang on lines.  They collide by MinHash banding (9 bands of 3: a
    recall of 0.998 at the threshold), colliding ones are verified by exact
    Jaccard similarity of their ``shingle``-word shingles (>= ``num / den``),
    and of each component the first occurrence stays, by (doc_id, row hash,
    position).  The others go, from the first to the last shingle that they
    share with it.  Such parts with at most two shingles' words between them
    are one passage; it goes if it has ``min_words`` words or is a whole text.  Of what is left, any
    ``min_words`` words that occur in an earlier text, in the same order, go
    from the later one, wherever they begin and end.  What a text repeats of
    itself alone stays.

    Returns ``docs`` with ``text`` rewritten and ``passages``, an array of
    (word, words, kept_doc_id) that counts the words of the text as it came.
    In front of it all columns are as they came, but for ``n_chars`` if it is
    there.  Null texts stay null, empty ones empty; repeated rows are one
    occurrence and are rewritten alike; null ids sort first; texts that repeat
    nothing are returned unchanged; an empty table stays empty.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("rk"))
    spark = docs.sparkSession
    gone = stage_last(spark, lambda: near_passages(source, min_words, shingle, BandKeys(bands, rows, num, den)), "near-passages")
    at, near, exact, cut = unused(docs, "at", "near", "exact", "cut")

    def edits() -> DataFrame:
        # Texts are read twice; those that were moved to their passages are kept.
        away, moved = few_and_others(source, gone.withColumnRenamed("passages", "gone"), "rk")
        runs = repeated_runs(away.union(stage(moved, "near-texts")), min_words)
        return gone.select(F.col("rk").alias(at), F.col("passages").alias(near)).join(runs.select(F.col("rk").alias(at), F.col("passages").alias(exact)), at, "full")

    kept = join_few(docs.withColumn(at, key), stage_last(spark, edits, "repeated-edits"), at)
    has = F.coalesce(near, exact).isNotNull()
    # Only texts with passages go to Python.
    rewrite = F.arrow_udf(cut_runs, f"text string, passages {SPANS}")
    kept = kept.withColumn(cut, rewrite(F.when(has, F.col("text").cast("string")), F.col(near), F.col(exact)))
    out = {c: F.col(f"`{c}`") for c in docs.columns if c.lower() != passages.lower()}
    text = F.when(has, F.col(f"{cut}.text")).otherwise(F.col("text").cast("string"))
    out["text"] = text.alias("text")
    if "n_chars" in out:
        out["n_chars"] = F.when(has, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return kept.select(*out.values(), F.when(has, F.col(f"{cut}.passages")).otherwise(F.array().cast(SPANS)).alias(passages))


def near_passages(source: DataFrame, min_words: int, shingle: int, keys: BandKeys) -> DataFrame:
    """``rk, passages`` of the texts with paragraphs that are like earlier ones."""
    columns = "doc_id long, rk long, word long, words long, total long"
    units, found, sets = find_links(source, "text", lambda batch: read_paragraphs(shingle, batch), columns, keys)
    place = F.struct("doc_id", "rk", "word")
    same = units.groupBy("fp").agg(F.min(place).alias("own"), F.max(place).alias("last"))
    named = same.join(found, "fp", "left").where("component is not null or own <> last")
    reach = named.where("component is not null").groupBy("component").agg(F.min(F.struct("own", "fp")).alias("kept"))
    clusters = stage(named.join(reach, "component", "left").select("fp", "own", F.coalesce("kept.own", "own").alias("kept"), F.coalesce("kept.fp", "fp").alias("kept_fp")), "near-clusters")
    # The first of equal paragraphs loses what it shares with the kept one, from end to end; the others go whole.
    unlike = clusters.where("fp <> kept_fp").select("fp", "kept_fp").join(sets.select("fp", "ordered"), "fp").join(sets.select(F.col("fp").alias("kept_fp"), "tokens"), "kept_fp")

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ordered, tokens in zip(batch.column(1), batch.column(2), strict=True):
                x = np.frombuffer(ordered.as_buffer(), np.uint64)
                at = np.flatnonzero(np.isin(x, np.frombuffer(tokens.as_buffer(), np.uint64)))
                out.append((int(at[0]), int(at[-1]) + shingle) if len(at) else (0, len(x) + shingle))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], pa.int64()) for k in (0, 1))], names=["fp", "lo", "hi"])

    shared = unlike.select("fp", "ordered", "tokens").mapInArrow(ends, "fp binary, lo long, hi long")
    known = clusters.join(shared, "fp", "left").select(F.xxhash64("fp").alias("head"), F.struct("fp", "own", "kept", "lo", "hi").alias("of"))
    later = join_few(units.withColumn("head", F.xxhash64("fp")), stage(known, "near-known"), "head")
    later = later.where((F.col("of.fp") == F.col("fp")) & (F.col("rk") != F.col("of.kept.rk")))
    whole = ~place.eqNullSafe(F.col("of.own")) | F.col("of.lo").isNull()
    lo = F.when(whole, F.lit(0)).otherwise(F.col("of.lo"))
    hi = F.when(whole, F.col("words")).otherwise(F.least("words", "of.hi"))
    part = F.struct((F.col("word") + lo).alias("word"), (hi - lo).alias("words"), F.col("of.kept.doc_id").alias("kept_doc_id"))
    # A text's own paragraphs, told apart by their first word, are no more than it has.
    parts = later.groupBy("rk", "total").agg(F.collect_set(part).alias("parts"))

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("kept_doc_id", pa.int64())]))
        for batch in batches:
            ids, out = [], []
            for rk, total, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                merged: list[dict] = []
                for part in sorted(own, key=lambda p: p["word"]):
                    if merged and part["word"] <= merged[-1]["word"] + merged[-1]["words"] + 2 * shingle:
                        merged[-1]["words"] = max(merged[-1]["words"], part["word"] + part["words"] - merged[-1]["word"])
                    else:
                        merged.append(part)
                merged = [m for m in merged if m["words"] >= min_words or m["words"] == total]
                if merged:
                    ids.append(rk)
                    out.append(merged)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, kind)], names=["rk", "passages"])

    return parts.mapInArrow(merge, f"rk long, passages {SPANS}")
