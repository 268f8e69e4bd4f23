"""Runs of equal neighbours: gaps and islands over an ordered partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, by: list[str], order: str, key: Column, least: int, carry: dict[str, Column]) -> DataFrame:
    """by, key, n, first (order value), and aggregates of ``carry`` for each run of at least ``least`` rows."""
    w = Window.partitionBy(*by).orderBy(order)
    df = df.withColumn("_key", key).withColumn("_n", F.row_number().over(w))
    new = F.coalesce(F.lag("_key").over(w) != F.col("_key"), F.lit(True))
    df = df.withColumn("_new", new).withColumn("_run", F.sum(F.col("_new").cast("int")).over(w))
    got = df.where(F.col("_key").isNotNull()).groupBy(*by, "_run").agg(F.first("_key").alias("key"), F.count("*").alias("n"), F.min(order).alias("first"), *(c.alias(k) for k, c in carry.items()))
    return got.where(F.col("n") >= least).drop("_run")


def following(df: DataFrame, by: str, order: str, value: str, *, ranges: int = 64) -> DataFrame:
    """df with ``next``: the value of the row that follows within ``by`` in ``order``, a number without repeats.

    The order is cut into ranges, and each range gets the first row of the next
    one from a table of first rows, so no task holds all rows of a group.
    """
    shares = [k / ranges for k in range(1, ranges)]
    cuts = sorted(set(df.where(F.col(order).isNotNull()).approxQuantile(order, shares, 0.1 / ranges))) if shares else []
    df = df.withColumn("_range", _cuts_below(F.col(order), cuts))
    firsts = df.groupBy(by, "_range").agg(F.min_by(F.struct(F.col(value).alias("v")), order).alias("_first"))
    ahead = firsts.withColumn("_ahead", F.lead("_first").over(Window.partitionBy(by).orderBy("_range"))).select(F.col(by).alias("_by"), F.col("_range").alias("_of"), "_ahead")
    own = df.withColumn("_next", F.lead(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(by, "_range").orderBy(order)))
    out = own.join(ahead, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_of")), "left")
    return out.withColumn("next", F.coalesce("_next", "_ahead")["v"]).drop("_range", "_next", "_by", "_of", "_ahead")


def _cuts_below(x: Column, cuts: list[float], least: int = 0) -> Column:
    """The number of sorted cuts that x reaches, by halving; 0 for null.

    No lambda: Spark's canonical lambda variables have the ids of a session's
    first columns, and a filter inferred for a join can then name a column that
    its side does not have.
    """
    if not cuts:
        return F.lit(least)
    half = len(cuts) // 2
    return F.when(x >= cuts[half], _cuts_below(x, cuts[half + 1 :], least + half + 1)).otherwise(_cuts_below(x, cuts[:half], least))
