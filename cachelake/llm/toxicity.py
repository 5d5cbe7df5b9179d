"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelake.llm.common import chunks, hash_words, mix, unused

BITS = 20


def features(words: np.ndarray, rows: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all words, word pairs and pairs with one word between, and
    their rows.  Slot 0 is the bias and never hashed to."""
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    slots, owners = [mix(words ^ np.uint64(0x452821E638D01377))], [owner]
    for gap, seed in ((1, 0xBE5466CF34E90C6C), (2, 0xC0AC29B7C97C50DD)):
        same = owner[gap:] == owner[:-gap]
        slots.append(mix(words[:-gap] * np.uint64(seed | 1) + words[gap:])[same])
        owners.append(owner[gap:][same])
    return np.maximum(np.concatenate(slots) >> np.uint64(64 - bits), np.uint64(1)).astype(np.int64), np.concatenate(owners)


class FtrlProximal:
    """Per-coordinate FTRL-proximal with L1 and L2 terms (McMahan et al.)."""

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic calibration of margins (a column each): intercept and slopes, by
    Newton steps with a small ridge."""
    a = np.column_stack([np.ones(len(x)), np.clip(x, -30, 30)])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hessian, a.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, held: str) -> DataFrame:
    """A bounded sample ``text, label``: the labelled rows outside ``held``
    with the ``most`` smallest id hashes.  Of several labels the largest counts."""
    own, order = unused(docs, "own", "order")
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~F.expr(held)).groupBy(F.col("doc_id").cast("long").alias(own)).agg(F.max(F.col(label).cast("int")).alias("label"))
    some = known.orderBy(F.xxhash64(own), own).limit(most)
    # At most `most` rows of two numbers, so the broadcast is bounded.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col(own))
    rows = rows.select("text", "label", F.xxhash64(own, "text").alias(order))
    return rows.orderBy(order, "label").limit(most).select("text", "label")


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 16_384, epochs: int = 4, bits: int = BITS, held: str = "crc32(cast(doc_id as string)) % 5 = 0") -> tuple[np.ndarray, np.ndarray]:
    """Nonzero slots and weights, learned in one task from a bounded sample.

    At most ``most`` labelled rows are used, a fifth of them for calibration.  The weights are at most 2^bits
    numbers; L1 leaves a small part of them.  Without labelled rows there are
    none.
    """

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, docs, bias = FtrlProximal(bits), [], np.zeros(1, np.int32)
        for _, batch in chunks(batches, "text"):
            words, rows = hash_words(batch.column(0))
            slots, owners = features(words, rows, bits)
            pair = np.unique(owners * (1 << bits) + slots)
            cut = np.searchsorted(pair, np.arange(len(rows)) * (1 << bits))
            slot = (pair & ((1 << bits) - 1)).astype(np.int32)
            docs += [(np.concatenate([bias, slot[a:b]]), y) for a, b, y in zip(cut[:-1], cut[1:], batch.column(1).to_pylist(), strict=True)]
        for epoch in range(epochs):
            for i in np.random.default_rng(epoch).permutation(len(docs)):
                if i % 5:
                    model.learn(*docs[i])
        w = model.weights(np.arange(1 << bits))
        # The rest calibrates the margin; the weights take in slope and intercept.
        y = np.array([label for _, label in docs[::5]], float)
        if 0 < y.sum() < len(y):
            a, b = calibrate(np.array([[w[at].sum()] for at, _ in docs[::5]]), y)
            if b > 0:
                w = w * b
                w[0] += a
        at = np.flatnonzero(w)
        if docs and not len(at):
            at = np.array([0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], names=["slot", "weight"])

    got = training_rows(docs, labels, label, most, held).repartition(1).mapInArrow(fit, "slot int, weight double").toArrow()
    return np.asarray(got["slot"]), np.asarray(got["weight"])


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS, name: str = "score") -> DataFrame:
    """``docs`` with ``name`` (0 to 1; higher: likelier toxic) in place of a
    column that has that name.

    Only ``text`` is looked at.  Null and empty texts get the bias's score;
    with no model every score is 0.  Each feature counts once in a text.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by 2^bits slots
    kept = [f"`{c}`" for c in docs.columns if c.lower() != name.lower()]
    (text,) = unused(docs, "words")

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, weights = shared.value
        table = np.zeros(1 << bits)
        table[slots] = weights
        for _, batch in chunks(batches, text):
            words, rows = hash_words(batch.column(len(kept)))
            slot, owner = features(words, rows, bits)
            hit = table[slot] != 0
            pair = np.unique(owner[hit] * (1 << bits) + slot[hit])
            total = np.bincount(pair >> bits, table[pair & ((1 << bits) - 1)], len(rows) - 1) + table[0]
            out = 1 / (1 + np.exp(-np.clip(total, -35, 35))) if len(slots) else np.zeros(len(rows) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out)], names=[*batch.schema.names[: len(kept)], name])

    source = docs.select(*kept, F.col("text").cast("string").alias(text))
    schema = docs.select(*kept).schema.add(name, "double")
    return source.mapInArrow(score, schema)


def toxicity(docs: DataFrame, labels: DataFrame, held: str = "crc32(cast(doc_id as string)) % 5 = 0") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Rows with ``held`` true are never learned from; a null id counts as not
    held out (and has no label).  Null and empty texts get the bias's score,
    very long ones are scored whole; repeated rows are scored alike; other
    columns are ignored; without labels every score is 0, and an empty table
    gives no rows.
    """
    model = train_toxicity(docs, labels, held=held)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score_toxicity(ids, model)
    return scored.select("doc_id", F.coalesce(F.expr(held), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns as they came,
    whatever their names.  Null and empty texts have no words and stay, as do
    null ids; repeated rows go or stay together; without labels all stay; an
    empty table stays empty."""
    model = train_toxicity(docs, labels)
    (score,) = unused(docs, "score")
    text = F.col("text").cast("string")
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return score_toxicity(docs, model, name=score).where((F.col(score) < 0.5) | ~worded).drop(score)
