"""Folds over ordered items that many tasks share.

A segment's end depends on where it began, so packing looks like one walk along
a whole group.  Here a group is cut into pieces of consecutive items.  What a
piece makes of the bytes that an open segment brings into it is a step function
of these bytes: walks from nearby starts soon meet, so it has few steps.  Each
piece finds its own; a walk over all pieces' steps tells each what comes in;
then each numbers its items.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cachelake.sources.storage import scratch_path

PIECE_ROWS = 1 << 18
#: More than any segment holds: what comes in where a group begins, since its first item opens a segment.
BEGIN = 1 << 62
STEPS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("least", "starts", "carry")]))
STEPS_ARROW = pa.list_(pa.struct([(n, pa.int64()) for n in ("least", "starts", "carry")]))


class Piece:
    """Consecutive items' sizes under a cap.

    ``before`` closes a segment before the item that would exceed the cap, else
    one closes once it has reached it.
    """

    def __init__(self, sizes: np.ndarray, cap: int, before: bool):
        ends = np.cumsum(sizes.astype(np.int64))
        self.total, self.n, self.begins = int(ends[-1]), len(sizes), ends - sizes
        self.marks, self.limit = (ends, cap + 1) if before else (self.begins, cap)

    def first(self, carry: int) -> int:
        """The first item that opens a segment if ``carry`` bytes come in."""
        return int(np.searchsorted(self.marks, self.limit - carry))

    def after(self, start: int) -> int:
        """The item that opens the segment after the one from ``start``."""
        return max(int(np.searchsorted(self.marks, self.begins[start] + self.limit)), start + 1)

    def steps(self) -> list[tuple[int, int, int]]:
        """``least, starts, carry``, ascending: from ``least`` bytes on, how many
        segments begin here and how many bytes the last one takes along.  The
        first step is that none does; its ``carry`` comes on top."""
        known: dict[int, tuple[int, int]] = {}
        found: list[tuple[int, int, int]] = []
        for entry in range(min(self.first(0) + 1, self.n)):
            if entry and self.marks[entry] == self.marks[entry - 1]:  # the one before opens it
                continue
            walk, at = [], entry
            while at < self.n and at not in known:
                walk.append(at)
                at = self.after(at)
            starts, last = known[at] if at < self.n else (0, walk[-1])
            for at in reversed(walk):
                starts += 1
                known[at] = (starts, last)
            starts, last = known[entry]
            step = (self.limit - int(self.marks[entry]), starts, self.total - int(self.begins[last]))
            if found and found[-1][1:] == step[1:]:
                found.pop()
            found.append(step)
        return [(-BEGIN, 0, self.total), *reversed(found)]

    def numbers(self, carry: int, before: int) -> np.ndarray:
        """Each item's segment, if ``before`` segments began before this piece."""
        starts, at = [], self.first(carry)
        while at < self.n:
            starts.append(at)
            at = self.after(at)
        return before - 1 + np.searchsorted(np.array(starts, np.int64), np.arange(self.n), "right")


def _runs(groups: pa.ChunkedArray) -> Iterator[tuple[int, int]]:
    """Spans of equal values."""
    codes = groups.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    cuts = np.flatnonzero(np.diff(codes)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(codes)], strict=True)


def _carried(rows: pd.DataFrame) -> pd.DataFrame:
    """What comes into each piece of a group."""
    carry, before, out = BEGIN, 0, []
    for piece, steps in sorted(zip(rows["_piece"], rows["_steps"], strict=True), key=lambda x: x[0]):
        out.append((rows["_g"].iloc[0], piece, carry, before))
        step = max((s for s in steps if s["least"] <= carry), key=lambda s: s["least"])
        carry = step["carry"] if step["starts"] else carry + step["carry"]
        before += step["starts"]
    return pd.DataFrame(out, columns=["_g", "_piece", "_carry", "_before"])


def segment_numbers(items: DataFrame, group: Column, cap: int, before: bool, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``items[id, size]`` with ``prefix``, its group, and ``segment_no``: each
    group's items in the order of their distinct ids, cut under ``cap``.

    Groups may have any size.  A task holds a piece of about ``piece_rows``
    items; a group's pieces' steps, a few numbers each, are walked together.
    Where no group has more items than that, each is a piece by itself.
    """
    spark, columns = items.sparkSession, items.columns
    keyed = items.withColumn("_g", group)
    numbered = T.StructType([*items.schema.fields, T.StructField("prefix", keyed.schema["_g"].dataType), T.StructField("segment_no", T.IntegerType())])

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        numbers = Piece(table["size"].to_numpy(), cap, before).numbers(BEGIN, 0).astype(np.int32)
        return pa.table([*(table[c] for c in columns), table["_g"], pa.array(numbers)], names=[*columns, "prefix", "segment_no"])

    largest = keyed.groupBy("_g").count().agg(F.max("count")).first()[0] or 0  # one number
    if largest <= piece_rows:  # every group is one piece
        return keyed.groupBy("_g").applyInArrow(whole, numbered)
    path = scratch_path(spark, "fold")
    keyed.write.parquet(f"{path}/items")
    keyed = spark.read.schema(keyed.schema).parquet(f"{path}/items")
    pieces = max(1, -(-keyed.count() // piece_rows))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table, number = pa.Table.from_batches(held), TaskContext.get().partitionId()
        sizes, places, steps = table["size"].to_numpy(), np.empty(table.num_rows, np.int64), [None] * table.num_rows
        for lo, hi in _runs(table["_g"]):
            places[lo:hi] = np.arange(hi - lo)
            steps[hi - 1] = [dict(zip(("least", "starts", "carry"), s, strict=True)) for s in Piece(sizes[lo:hi], cap, before).steps()]
        table = table.append_column("_piece", pa.array(np.full(table.num_rows, number))).append_column("_n", pa.array(places)).append_column("_steps", pa.array(steps, STEPS_ARROW))
        yield from table.to_batches()

    schema = T.StructType([*keyed.schema.fields, *T.StructType().add("_piece", "long").add("_n", "long").add("_steps", STEPS).fields])
    keyed.repartitionByRange(pieces, "_g", "id").sortWithinPartitions("_g", "id").mapInArrow(cut, schema).write.parquet(f"{path}/pieces")
    cuts = spark.read.schema(schema).parquet(f"{path}/pieces")
    carried = cuts.where("_steps is not null").select("_g", "_piece", "_steps").groupBy("_g").applyInPandas(_carried, T.StructType([keyed.schema["_g"], *T.StructType().add("_piece", "long").add("_carry", "long").add("_before", "long").fields]))

    def number(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_g", "ascending"), ("_n", "ascending")])
        sizes, out = table["size"].to_numpy(), np.empty(table.num_rows, np.int32)
        carry, starts = table["_carry"].to_numpy(), table["_before"].to_numpy()
        for lo, hi in _runs(table["_g"]):
            out[lo:hi] = Piece(sizes[lo:hi], cap, before).numbers(int(carry[lo]), int(starts[lo]))
        return pa.table([*(table[c] for c in columns), table["_g"], pa.array(out)], names=[*columns, "prefix", "segment_no"])

    met = cuts.drop("_steps").join(carried.withColumnRenamed("_g", "_group"), F.col("_g").eqNullSafe(F.col("_group")) & (cuts["_piece"] == carried["_piece"])).drop(carried["_piece"]).drop("_group")
    return met.groupBy("_piece").applyInArrow(number, numbered)
