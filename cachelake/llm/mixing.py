"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from cachelake.llm.common import stage, unused

MOST_BROADCAST = 100_000
MOST_RATE = 500.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, joined by ``|``."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """``source, rate``: how often a document of each source is to appear.

    Target shares are ``weights`` (``source, weight``; sources without one get
    none) or, by default, proportional to n^alpha.  The whole is ``epochs``
    times the input: rate = share * epochs * N / n.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        named = weights.select(F.col("source").alias("_s"), F.greatest(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
        counts = counts.join(named, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["weight"])
    whole = counts.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))
    row = whole.first()  # two numbers
    total, mass = float(row[0] or 0), float(row[1] or 0)
    share = F.col("weight") / F.lit(mass) if mass > 0 else F.lit(0.0)
    return counts.select("source", (share * F.lit(epochs * total) / F.col("n")).alias("rate"))


def poisson_quantile(u: Column, rate: Column, reach: float = 12.0) -> Column:
    """The least k with CDF(k) > u, for rates up to MOST_RATE."""
    top = F.ceil(rate + F.lit(reach) * F.sqrt(rate) + F.lit(reach)).cast("int")
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("c"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i.cast("double")
        more = F.struct((s["k"] + 1).alias("k"), p.alias("p"), (s["c"] + p).alias("c"))
        return F.when(s["c"] > u, s).otherwise(more)

    k = F.aggregate(F.sequence(F.lit(1), top), start, step, lambda s: s["k"])
    return F.when(rate <= 0, F.lit(0)).otherwise(k)


def poisson_count(seed: str, name: Column, rate: Column) -> Column:
    """A Poisson count of mean ``rate``, drawn by inverting the distribution at
    a hash of seed and name.  Larger rates than MOST_RATE would underflow; they
    are the sum of several equal draws with seeds of their own, which is
    Poisson of the whole rate exactly."""
    draws = F.greatest(F.ceil(rate / F.lit(MOST_RATE)).cast("int"), F.lit(1))

    def draw(j: Column) -> Column:
        own = F.concat(F.lit(seed), F.when(j > 1, F.concat(F.lit("-"), j.cast("string"))).otherwise(F.lit("")))
        return poisson_quantile(uniform(own, name), rate / draws)

    return F.aggregate(F.sequence(F.lit(1), draws), F.lit(0), lambda total, j: total + draw(j))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: str = "mix", copy: str = "copy", shuffle_key: str = "shuffle_key") -> DataFrame:
    """Replicate each document by a Poisson count whose mean is its source's
    rate, and shuffle all copies globally.

    Adds ``copy`` (from 1) and ``shuffle_key``, by which the result's
    partitions are dealt and sorted, in place of columns with these names; all
    others are as they came, whatever their names.  Counts come from an MD5 of
    seed and id alone, so repeated rows and equal ids are drawn alike, on any
    cluster.  A null source is a source of its own; null ids are drawn as one
    id, and shuffled by their rows' hashes; texts may be null, empty or long.
    An empty table stays empty.
    """
    origin, rate, times, nth = unused(docs, "origin", "rate", "times", "nth")
    rates = stage(source_rates(docs, weights, alpha, epochs), "source-rates").select(F.col("source").alias(origin), F.col("rate").alias(rate))
    small = rates.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (copy.lower(), shuffle_key.lower())]
    joined = docs.join(F.broadcast(rates) if small else rates, F.col("source").eqNullSafe(F.col(origin)))
    drawn = joined.withColumn(times, poisson_count(seed, F.col("doc_id"), F.col(rate))).where(F.col(times) > 0)
    copies = drawn.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(times))))
    row = F.concat(F.lit("#"), F.xxhash64(*[f"`{f.name}`" for f in docs.schema if isinstance(f.dataType, AtomicType)]).cast("string"))
    key = uniform(F.lit(f"{seed}-order"), F.coalesce(F.col("doc_id").cast("string"), row), F.col(nth))
    out = copies.select(*kept, F.col(nth).alias(copy), key.alias(shuffle_key))
    return out.repartition(shuffle_key).sortWithinPartitions(shuffle_key)


MIX_SQL = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
whole AS (SELECT sum(n) AS all_n, sum(pow(n, 0.5)) AS all_w FROM counts),
rates AS (SELECT source, pow(n, 0.5) / all_w * (1.0 * all_n) / n AS rate FROM counts, whole),
parts AS (SELECT source, greatest(ceil(rate / 500.0), 1)::INTEGER AS draws, rate / greatest(ceil(rate / 500.0), 1) AS part FROM rates),
cdf AS (
  SELECT source, part, 0 AS k, exp(-part) AS p, exp(-part) AS c FROM parts
  UNION ALL
  SELECT source, part, k + 1, p * part / (k + 1), c + p * part / (k + 1) FROM cdf
  WHERE k + 1 <= ceil(part + 12 * sqrt(part) + 12)
),
named AS (SELECT d.*, row_number() OVER () AS rid FROM documents d),
draws AS (
  SELECT rid, d.source, ('0x' || substr(md5('mix' || CASE WHEN j > 1 THEN '-' || j ELSE '' END || '|' || coalesce(cast(d.doc_id AS varchar), '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM named d JOIN (SELECT source AS s, unnest(generate_series(1, draws)) AS j FROM parts) x ON d.source IS NOT DISTINCT FROM x.s
),
counted AS (
  SELECT rid, count(*) AS n FROM draws d JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u GROUP BY rid
),
copies AS (SELECT named.*, unnest(generate_series(1, n)) AS copy FROM named JOIN counted USING (rid))
SELECT doc_id, text, lang, source, n_chars, cast(copy AS integer) AS copy FROM copies
"""
