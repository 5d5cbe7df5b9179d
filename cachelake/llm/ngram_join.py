"""N-gram Jaccard join: documents whose word shingles are nearly the same."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelake.llm.common import hash_words, join_few, shingle_hashes, stage, stage_last, unused
from cachelake.llm.similarity import PrefixKeys, Units, distinct_sets, find_links, link_counts


def ngram_join(docs: DataFrame, shingle: int = 5, num: int = 4, den: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Classes of documents linked by Jaccard similarity >= ``num / den``.

    Returns, per row, ``doc_id``, ``n_shingles`` (the size of its set of
    ``shingle``-word shingles; a shorter text is one shingle),
    ``component_id``, the smallest ``doc_id`` that links reach, and ``n_links``,
    the number of other rows that it is linked with.

    Null and empty texts have no shingles and no links; their component is
    their own id.  Repeated rows are alike and keep one row each.  A null
    ``doc_id`` takes part; a class has a null component only if all its ids are
    null.  Very long texts count whole.  Other columns are ignored; an empty
    table gives an empty result.
    """
    found = class_rows(docs, shingle, num, den, text, doc_id, links=True)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def class_rows(docs: DataFrame, shingle: int, num: int, den: int, text: str, doc_id: str, links: bool = False) -> DataFrame:
    """``doc_id, rk, n, component_id, class`` and, if asked for, ``n_links``
    per row; ``rk`` hashes id and text, ``class`` is the class itself: its
    links' component, or its only set."""

    def read(batch: pa.RecordBatch) -> Units:
        words, rows = hash_words(batch.column(batch.schema.get_field_index("text")))
        tokens, offsets = distinct_sets(*shingle_hashes(words, rows, shingle))
        return Units(tokens, offsets, {c: batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "rk")})

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("rk", F.xxhash64("doc_id", "text"))
    units, found, sets = find_links(source, "text", read, "doc_id long, rk long", PrefixKeys(num, den))
    # Equal sets are one class from the start; classes then go by components.
    same = units.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    named = same.join(found, "fp", "left")
    reach = named.where("component is not null").groupBy("component").agg(F.min("least").alias("reached"))
    own = F.struct("component", F.when(F.col("component").isNull(), F.col("fp")).alias("fp"))
    classes = named.join(reach, "component", "left").select("fp", F.coalesce("reached", "least").alias("reached"), own.alias("class"), (F.col("copies") - 1).alias("n_links"))
    if links:
        found = stage(found, "linked-sets")
        others = stage(link_counts(sets, found, same.select("fp", "copies"), num, den), "links")
        classes = classes.join(others, "fp", "left").withColumn("n_links", F.col("n_links") + F.coalesce("links", F.lit(0)))
    full = units.where("n > 0").join(classes, "fp", "left").select("doc_id", "rk", "n", F.col("reached").alias("component_id"), "class", "n_links")
    return full.unionByName(units.where("n = 0").select("doc_id", "rk", "n", F.col("doc_id").alias("component_id")), allowMissingColumns=True)


def keep_one(docs: DataFrame, shingle: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id.

    Of a class, the row with the smallest ``doc_id`` and row hash stays, once;
    null ids come last.  Unlinked texts are classes of their own, also if they
    have the same id or none.  Documents without words (null, empty or blank
    texts) all stay.  Of rows that repeat an id and its text, one stays, as its
    other columns are.  Columns of any names are kept as they are; an empty
    table stays empty.
    """
    key, first, many = unused(docs, "key", "first", "copies")

    def few() -> DataFrame:
        rows = class_rows(docs, shingle, num, den, "text", "doc_id").where("n > 0")
        place = F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "rk")
        firsts = rows.groupBy("class").agg(F.min(place).alias("first")).select(F.col("first.rk").alias("rk"), F.lit(True).alias("first"))
        copies = rows.groupBy("rk").agg(F.count("*").alias("copies")).join(firsts, "rk", "left")
        # Only rows that go, or of which there are several, are looked up.
        return copies.where("first is null or copies > 1").select(F.col("rk").alias(key), F.coalesce("first", F.lit(False)).alias(first), F.col("copies").alias(many))

    text = F.col("text").cast("string")
    wordless = ~F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = docs.where(~wordless).withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), text))
    looked = join_few(own, stage_last(docs.sparkSession, few, "near-copies"), key).where(F.coalesce(first, F.lit(True)))
    again = F.coalesce(many, F.lit(1)) > 1
    kept = looked.where(~again).union(looked.where(again).dropDuplicates([key]))
    return kept.drop(key, first, many).union(docs.where(wordless))
