"""Mixing sources to target weights by Poisson replication.

A source's mean target repetition rate is its target share of the mix over its
share of the corpus.  Each document gets a uniform number from a hash of (seed,
doc_id), inverts the Poisson distribution of its source's rate with it, and is
exploded into that many copies.  A hash of (seed, doc_id, copy) orders all
copies globally.  No document is looked at with any other, so a hot source
stays spread over all partitions.

Defined results: a null source is a source of its own; without weights every
source has the same share; a source missing from given weights has rate 0;
rows that repeat a doc_id are replicated alike; a null doc_id hashes as empty;
null text is kept; other columns are carried along, and own columns win over
columns of the same name; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: The rates go to every task only up to this many sources; beyond it they are joined by shuffle.
MOST_BROADCAST = 100_000
MOST_RATE = 500.0


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5 digest."""
    key = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def poisson_inverse(u: Column, rate: Column, most: int) -> Column:
    """The number of k in 0..most-1 whose Poisson distribution function is at most u."""
    term, total, n = F.exp(-rate), F.exp(-rate), F.lit(0)
    start = F.struct(term.alias("p"), total.alias("c"), n.cast("int").alias("n"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k.cast("double")
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), (a["n"] + (a["c"] <= u).cast("int")).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda a: a["n"])


def copies(seed: int, doc_id: Column, rate: Column, most: Column) -> Column:
    """A Poisson number of the rate; a high one is a sum of several of at most MOST_RATE, whose exp(-rate) is above 0."""
    parts = F.ceil(rate / MOST_RATE).cast("int")
    each = F.transform(F.sequence(F.lit(1), parts), lambda j: poisson_inverse(uniform(seed, doc_id, j), rate / parts, F.lit(int(MOST_RATE + 10 * MOST_RATE**0.5) + 20)))
    return F.when(rate <= MOST_RATE, poisson_inverse(uniform(seed, doc_id), rate, most)).otherwise(F.aggregate(each, F.lit(0), lambda a, n: a + n))


def rates(docs: DataFrame, weights: dict[str | None, float] | None, size: float) -> DataFrame:
    """source, rate, most: counts per source are the only thing that is gathered."""
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("w", F.lit(1.0))
    else:
        w = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        n = n.join(w.withColumnRenamed("source", "given"), F.col("source").eqNullSafe(F.col("given")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    total = n.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    rate = F.col("w") / F.lit(total["w"] or None).cast("double") * F.lit(float(total["n"] or 0)) * F.lit(float(size)) / F.col("n")
    r = n.select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))
    # beyond this many copies a 48-bit uniform number cannot reach
    return r.withColumn("most", (F.ceil(F.col("rate") + 10 * F.sqrt("rate")) + 20).cast("int"))


def mix(spark: SparkSession, docs: DataFrame, *, weights: dict[str | None, float] | None = None, size: float = 1.0, seed: int = 17, shuffle: bool = True) -> DataFrame:
    """All columns of docs, and copy (from 0), n_copies, mix_rate, mix_key; ``size`` is the mix's size over the corpus'."""
    r = rates(docs, weights, size)
    own = {"copy", "n_copies", "mix_rate", "mix_key"}
    docs = docs.select(*(c for c in docs.columns if c.lower() not in own))
    of, most = fresh("mix_source", docs.columns), fresh("mix_most", docs.columns)
    r = r.select(F.col("source").alias(of), F.col("rate").alias("mix_rate"), F.col("most").alias(most))
    n_sources = docs.select("source").distinct().count()
    joined = docs.join(F.broadcast(r) if n_sources <= MOST_BROADCAST else r, F.col("source").eqNullSafe(F.col(of)))
    counted = joined.withColumn("n_copies", copies(seed, F.col("doc_id"), F.col("mix_rate"), F.col(most)))
    kept = counted.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")).cast("binary"))
    out = kept.withColumn("mix_key", key).drop(of, most)
    return out.orderBy("mix_key") if shuffle else out
