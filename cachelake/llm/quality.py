"""Quality classifier by co-training: a text view and a page-metadata view.

Each view's classifier first learns from a bounded sample of labelled rows.  In
each round both score every row of the corpus that has no label; the rows that
one is surest of, by cuts from a histogram of all margins, teach the other.  So
many learners as it takes for each to see about ``LEARNER_ROWS`` of these rows
start from the labelled state, and what they add to it is averaged by the rows
that they have seen.  Calibrated on labelled rows that no view has learned
from, the views are combined to score all documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelake.llm.common import _SPACE, chunks, hash_words, join_few, mix, release, stage, text_buffer
from cachelake.llm.toxicity import FtrlProximal, calibrate

BITS = 18
META = ["lang", "source", "n_chars"]
L1 = (8.0, 1.0)
LEARNER_ROWS = 8192
BINS, SPAN = 4096, 32.0
SCALE = 1 << 20

Slots = tuple[np.ndarray, np.ndarray]  # all rows' slots, ascending in a row, and the rows' offsets


def _distinct(owner: np.ndarray, slot: np.ndarray, n: int, bits: int) -> Slots:
    """Each row's slots once, and the bias, slot 0."""
    pair = np.unique(np.concatenate([np.arange(n) << bits, (owner << bits) + slot]))
    return (pair & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(pair, np.arange(n + 1) << bits)


def content_slots(texts: pa.Array, bits: int = BITS) -> Slots:
    """Slots of each text's words and of its binned shares of byte kinds."""
    words, rows = hash_words(texts)
    data, offsets = text_buffer(texts)
    kinds = np.zeros(256, np.int64)  # 0: letters and other scripts
    kinds[48:58] = 1
    kinds[_SPACE] = 2
    kinds[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
    n = np.maximum(np.diff(offsets), 1)
    of = np.repeat(np.arange(len(n)), np.diff(offsets))
    shares = [np.bincount(of, kinds[data] == k, len(n)) / n for k in range(4)]
    shares.append(np.bincount(of, np.isin(data, np.frombuffer(b".,;:!?'\"-()", np.uint8)), len(n)) / n)
    shares.append(np.minimum(np.diff(rows) / n, 1.0))
    bins = np.stack([np.minimum((s * 32).astype(np.uint64), np.uint64(31)) + np.uint64(64 * k) for k, s in enumerate(shares)], 1)
    shape = (mix(bins + np.uint64(0x3C6EF372FE94F82B)) >> np.uint64(64 - bits)).astype(np.int64)
    slot = (mix(words ^ np.uint64(0xA54FF53A5F1D36F1)) >> np.uint64(64 - bits)).astype(np.int64)
    owner = np.concatenate([np.repeat(np.arange(len(n)), np.diff(rows)), np.repeat(np.arange(len(n)), shape.shape[1])])
    return _distinct(owner, np.concatenate([slot, shape.ravel()]), len(n), bits)


def meta_slots(batch: pa.RecordBatch, texts: pa.Array, bits: int = BITS) -> Slots:
    """Slots of a page's metadata: language, source, length and layout, alone
    and by language."""
    data, offsets = text_buffer(texts)
    lines = np.diff(np.concatenate([[0], np.cumsum(data == 10)])[offsets]) + 1
    length = np.diff(offsets)
    bins = [np.log2(length + 1).astype(int), np.log2(lines).astype(int), np.log2(length / lines + 1).astype(int)]
    column = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in META}
    keys: list[str] = []
    for i in range(len(length)):
        lang = str(column["lang"][i])
        size = column["n_chars"][i]
        layout = [f"b{k}:{x[i]}" for k, x in enumerate(bins)] + [f"c:{'-' if size is None else int(np.log2(max(size, 0) + 1))}"]
        keys += [f"lang:{lang}".replace(" ", "_"), f"source:{column['source'][i]}".replace(" ", "_"), *layout, *[f"{lang}|{x}".replace(" ", "_") for x in layout]]
    hashes = hash_words(pa.array([" ".join(keys)]))[0] if keys else np.zeros(0, np.uint64)
    slot = (mix(hashes ^ np.uint64(0x510E527FADE682D1)) >> np.uint64(64 - bits)).astype(np.int64)
    return _distinct(np.repeat(np.arange(len(length)), len(slot) // max(len(length), 1)), slot, len(length), bits)


def margins(weights: np.ndarray, slots: Slots) -> np.ndarray:
    """Each row's sum of weights."""
    values, offsets = slots
    return np.add.reduceat(weights[values], offsets[:-1]) if len(values) else np.zeros(len(offsets) - 1)  # no row is without slots


def _lists(slots: Slots) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(slots[1], pa.int32()), pa.array(slots[0], pa.int32()))


def _slots(lists: pa.Array) -> Slots:
    offsets = np.asarray(lists.offsets).astype(np.int64)
    return np.asarray(lists.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


# ---------------------------------------------------------------- the parts of a round


def feature_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, held: str, bits: int) -> DataFrame:
    """``doc_id, held_out, told, label, content, meta``: slots of all rows.
    ``label`` is null where there is none or the row is held out; ``told`` are
    the ``most`` labelled rows, by smallest id hash, that may be learned from."""
    kinds = {"lang": "string", "source": "string", "n_chars": "long"}
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *((F.col(c) if c in docs.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in META)]
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~F.expr(held)).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(most).select("_id", F.lit(True).alias("told"))
    known = stage(known.join(some, "_id", "left").select(F.xxhash64("_id").alias("_key"), "label", F.coalesce("told", F.lit(False)).alias("told")), "quality-labels")
    source = join_few(docs.select(*columns).withColumn("_key", F.xxhash64("doc_id")), known, "_key")  # texts without a label stay where they are
    source = source.select("doc_id", "text", *META, F.coalesce(F.expr(held), F.lit(False)).alias("held_out"), F.coalesce("told", F.lit(False)).alias("told"), "label")

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch in chunks(batches, "text"):
            texts = batch.column(1)
            kept = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "held_out", "told", "label")]
            yield pa.RecordBatch.from_arrays([*kept, _lists(content_slots(texts, bits)), _lists(meta_slots(batch, texts, bits))], names=["doc_id", "held_out", "told", "label", "content", "meta"])

    return source.mapInArrow(extract, "doc_id long, held_out boolean, told boolean, label int, content array<int>, meta array<int>")


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """The labelled rows, at most ``most`` (ids may repeat), in one task."""
    told = rows.where("told").select("label", "content", "meta", F.xxhash64("doc_id", "content").alias("_order"))
    return told.orderBy("_order", "label").limit(most).select("label", "content", "meta").repartition(1).sortWithinPartitions(F.xxhash64("content", "meta"), "label")


def _fit_labelled(sample: DataFrame, bits: int, epochs: int = 4) -> np.ndarray | None:
    """Both views' z and n after four fifths of the labelled sample; a row
    more tells the share of good rows.  None without labels."""

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = ([], []), []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            for v in range(2):
                values, offsets = _slots(batch.column(1 + v))
                rows[v].extend(values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))
        for v in range(2) if labels else ():
            model = FtrlProximal(bits, alpha=0.5, l1=L1[v], l2=0.5)
            for epoch in range(epochs):
                for i in np.random.default_rng(epoch).permutation(len(labels)):
                    if i % 5 or len(labels) < 5:
                        model.learn(rows[v][i], labels[i])
            at = np.flatnonzero(model.n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v, np.int32)), pa.array(at), pa.array(model.z[at]), pa.array(model.n[at])], names=["view", "slot", "z", "n"])
        if labels:
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0]), pa.array([float(np.mean(labels))]), pa.array([0.0])], names=["view", "slot", "z", "n"])

    return _state(sample.mapInArrow(fit, "view int, slot long, z double, n double"), bits)


def _state(table: DataFrame, bits: int) -> np.ndarray | None:
    """``view, slot, z, n`` as an array: at most 2^(bits + 1) pairs of numbers."""
    got = table.toArrow()
    if not got.num_rows:
        return None
    state = np.zeros((3, 2, 1 << bits))
    view, slot = np.asarray(got["view"]), np.asarray(got["slot"])
    state[view, 0, slot], state[view, 1, slot] = np.asarray(got["z"]), np.asarray(got["n"])
    return state


def _model(state: np.ndarray, view: int, bits: int) -> FtrlProximal:
    model = FtrlProximal(bits, alpha=0.5, l1=L1[view], l2=0.5)
    model.z, model.n = state[view, 0].copy(), state[view, 1].copy()
    return model


def _weights(state: np.ndarray, bits: int) -> list[np.ndarray]:
    return [_model(state, v, bits).weights(np.arange(1 << bits)) for v in range(2)]


def margin_counts(rows: DataFrame, weights: list[np.ndarray]) -> np.ndarray:
    """How many rows of ``content, meta`` have each binned margin, by view."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)  # 2^(bits + 1) numbers

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS), np.int64)
        for batch in batches:
            for v in range(2):
                total[v] += np.bincount(bin_of(margins(shared.value[v], _slots(batch.column(v)))), minlength=BINS)
        view, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(view.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[view, at])], names=["view", "bin", "n"])

    out = np.zeros((2, BINS), np.int64)
    for r in rows.select("content", "meta").mapInArrow(count, "view int, bin int, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).collect():  # at most 2 * BINS rows
        out[r["view"], r["bin"]] = r["n"]
    return out


def bin_of(margin: np.ndarray) -> np.ndarray:
    return np.clip(((margin + SPAN) * (BINS / (2 * SPAN))).astype(np.int64), 0, BINS - 1)


def sure_from(margin: np.ndarray, labels: np.ndarray, precision: float) -> tuple[int, int]:
    """The last bin up to which labelled rows are bad, and the first from which
    they are good, with at least ``precision`` (one more right and one wrong
    added); (-1, BINS) where there is none."""
    order = np.argsort(margin, kind="stable")
    at, bad = bin_of(margin[order]), labels[order] == 0
    n = np.arange(1, len(at) + 1)
    low = np.flatnonzero((np.cumsum(bad) + 1) / (n + 2) >= precision)
    high = np.flatnonzero((np.cumsum(~bad[::-1]) + 1) / (n + 2) >= precision)
    return (int(at[low[-1]]) if len(low) else -1), (int(at[::-1][high[-1]]) if len(high) else BINS)


def cuts_of(counts: np.ndarray, sure: list[tuple[int, int]], share: float, good: float) -> list[tuple[int, int]]:
    """Of each view the last bin of its surest bad rows and the first of its
    surest good ones: ``share`` of all rows, in the classes' proportion, but
    none of the other sign and none that labelled rows show it to be unsure of."""
    out = []
    for each, (bad, fine) in zip(counts, sure, strict=True):
        below, above = np.cumsum(each), np.cumsum(each[::-1])
        n, half = int(each.sum()), BINS // 2
        low = int(np.searchsorted(below, max(1, share * n * (1 - good))))
        high = BINS - 1 - int(np.searchsorted(above, max(1, share * n * good)))
        out.append((min(low, half - 1, bad), max(high, half, fine)))
    return out


def teach(rows: DataFrame, state: np.ndarray, weights: list[np.ndarray], cuts: list[tuple[int, int]], many: int, bits: int) -> np.ndarray:
    """What the surest rows of each view add to the other's state, over the
    labelled one, ``state``: the mean of all learners', by their rows."""
    context = rows.sparkSession.sparkContext
    shared, start = context.broadcast((weights, cuts)), context.broadcast(state)

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cut = shared.value
        for batch in batches:
            for v in range(2):
                at = bin_of(margins(w[v], _slots(batch.column(v))))
                sure = np.flatnonzero((at <= cut[v][0]) | (at >= cut[v][1]))
                if len(sure):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sure), 1 - v, np.int32)), pa.array((at[sure] >= cut[v][1]).astype(np.int32)), batch.column(1 - v).take(pa.array(sure))], names=["view", "label", "slots"])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, seen = [None, None], [0, 0]
        for batch in batches:
            view, label = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            values, offsets = _slots(batch.column(2))
            for i, v in enumerate(view.tolist()):
                models[v] = models[v] or _model(start.value, v, bits)
                models[v].learn(values[offsets[i] : offsets[i + 1]], label[i])
                seen[v] += 1
        for v in range(2):
            if seen[v]:
                z, n = models[v].z - start.value[v, 0], models[v].n - start.value[v, 1]
                at = np.flatnonzero(n)
                times = seen[v] * SCALE  # whole numbers, whose sums don't depend on their order
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at) + 1, v, np.int32)), pa.array(np.append(at, -1)), pa.array(np.append(np.rint(z[at] * times).astype(np.int64), seen[v])), pa.array(np.append(np.rint(n[at] * times).astype(np.int64), 0))],
                    names=["view", "slot", "z", "n"],
                )
        models.clear()
        release()

    chosen = rows.select("content", "meta").mapInArrow(choose, "view int, label int, slots array<int>")
    dealt = chosen.repartition(max(1, -(-many // LEARNER_ROWS)), F.xxhash64("view", "label", "slots")).sortWithinPartitions(F.xxhash64("slots"), "view", "label")
    added = dealt.mapInArrow(learn, "view int, slot long, z long, n long").groupBy("view", "slot").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toArrow()
    new = state.copy()
    view, slot, z, n = (np.asarray(added[c]) for c in ("view", "slot", "z", "n"))
    for v in range(2):
        own = (view == v) & (slot >= 0)
        if own.any():
            seen = float(z[(view == v) & (slot < 0)][0]) * SCALE
            new[v, 0, slot[own]] += z[own] / seen
            new[v, 1, slot[own]] += n[own] / seen
    return new


def _check(sample: DataFrame, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Both margins and the labels of the fifth of the labelled sample that no
    view has learned from: a bounded number of rows."""
    shared = sample.sparkSession.sparkContext.broadcast(weights)

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [pa.array(margins(shared.value[v], _slots(batch.column(1 + v)))) for v in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *x], names=["label", "a", "b"])

    got = sample.mapInArrow(look, "label int, a double, b double").toArrow()
    some = slice(None, None, 5) if got.num_rows >= 5 else slice(None)
    return np.column_stack([np.asarray(got["a"]), np.asarray(got["b"])])[some], np.asarray(got["label"])[some]


def _squash(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -35, 35)))


def _combined(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _squash(c[0] + np.clip(x, -30, 30) @ c[1:])


def _loss(c: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(_combined(c, x), 1e-6, 1 - 1e-6)
    return float(-np.mean(np.where(y == 1, np.log(p), np.log(1 - p))))


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 8192, rounds: int = 3, share: float = 0.1, precision: float = 0.95, bits: int = BITS, held: str = "crc32(cast(doc_id as string)) % 5 = 0") -> DataFrame:
    """``doc_id, held_out, content_score, meta_score, score, predicted``.

    Labels are taken from at most ``most`` rows outside ``held`` (by smallest id
    hash), a fifth of them for calibration only.  All rows that have no label
    and aren't held out take part in every round; the k-th uses at most k times
    ``share`` of them, those of which a view is sure with ``precision`` on that
    fifth.  The round with the least loss on it counts, so rounds that don't
    help do no harm.  Scores lie between 0 and 1.  Null texts count as empty
    and long ones whole, null metadata is a value of its own; repeated rows are
    scored alike, also under a null id; other columns are ignored; without
    labels every score is 0.5, and an empty table gives no rows.
    """
    rows = stage(feature_rows(docs, labels, label, most, held, bits), "quality-features")
    sample = _sample(rows, most)
    state = _fit_labelled(sample, bits)
    tables = [np.zeros(1 << bits), np.zeros(1 << bits), np.zeros(3)]
    if state is not None:
        good, seed = float(state[2, 0, 0]), state[:2]
        rest, weights, best = rows.where("label is null and not held_out"), _weights(seed, bits), np.inf
        for turn in range(rounds + 1):
            x, y = _check(sample, weights)
            combine = calibrate(x, y.astype(float))
            if (loss := _loss(combine, x, y)) < best:
                best, tables = loss, [*weights, combine]
            if turn == rounds or not 0 < good < 1:
                break
            counts = margin_counts(rest, weights)
            cuts = cuts_of(counts, [sure_from(x[:, v], y, precision) for v in range(2)], (turn + 1) * share, good)
            many = sum(int(c[: low + 1].sum() + c[high:].sum()) for c, (low, high) in zip(counts, cuts, strict=True))
            if not many:
                break
            weights = _weights(teach(rest, seed, weights, cuts, many, bits), bits)
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, c = shared.value
        for batch in batches:
            x = np.column_stack([margins(a, _slots(batch.column(2))), margins(b, _slots(batch.column(3)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_squash(x[:, 0])), pa.array(_squash(x[:, 1])), pa.array(_combined(c, x))], names=["doc_id", "held_out", "content_score", "meta_score", "score"])

    scored = rows.select("doc_id", "held_out", "content", "meta").mapInArrow(score, "doc_id long, held_out boolean, content_score double, meta_score double, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
