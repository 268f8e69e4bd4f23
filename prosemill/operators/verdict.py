"""Statuses of metric values against limits, and verdicts of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_WARN = 3
#: The limits table goes to every task; it has a few rows a metric, and must not have more than this.
MOST_LIMITS = 10_000
RANK = {"PASS": 0, "INFO": 0, "CHECK": 0, "OVER": 1, "WARN": 1, "FAIL": 2, "GATE": 3}


def poisson_quantile(q: Column, mean: Column) -> Column:
    """The smallest k whose Poisson distribution function reaches q."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))

    def step(a, i):
        p = a["p"] * mean / i
        return F.when(a["c"] < q, F.struct(p.alias("p"), (a["c"] + p).alias("c"), (a["k"] + 1).alias("k"))).otherwise(a)

    most = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    return F.when(mean > 0, F.aggregate(F.sequence(F.lit(1), most), start, step, lambda a: a["k"])).otherwise(0)


def status(value: Column, chars: Column, floor: int = 0) -> Column:
    """The status of a value joined with its limits."""
    c = F.col
    mean = c("rate_per_1k") * chars / 1000
    low, high = (F.greatest(F.lit(floor), poisson_quantile(F.coalesce(c(k), F.lit(q)), mean)) for k, q in (("pass_q", 0.9), ("warn_q", 0.975)))

    def three(passes: Column, warns: Column) -> Column:
        return F.when(passes, "PASS").when(warns.isNull(), "OVER").when(warns, "WARN").otherwise("FAIL")

    found = (
        F.when(c("kind") == "check", F.when(value > 0, "CHECK").otherwise("PASS"))
        .when(c("kind") == "gate", F.when(value > 0, "GATE").otherwise("PASS"))
        .when(c("kind") == "poisson", three(value <= low, value <= high))
        .when(c("kind") == "upper", three(value <= c("pass_max"), value <= c("warn_max")))
        .when(c("kind") == "lower", three(value >= c("pass_min"), value >= c("warn_min")))
        .when(c("kind") == "range", three(value.between(c("pass_lo"), c("pass_hi")), value.between(c("warn_lo"), c("warn_hi"))))
        .otherwise("INFO")
    )
    return F.when(c("min_chars").isNotNull() & (chars < c("min_chars")) & (found != "GATE"), "INFO").otherwise(found)


def judge(metrics: DataFrame, limits: DataFrame, *, floor: int = 0, skip_policy: bool = False) -> DataFrame:
    """doc_id, metric_id, value, status: only metrics that have limits for the document's tone."""
    limits = limits.where("not policy") if skip_policy else limits
    limits = limits.withColumnRenamed("tone", "_tone")
    few = limits.limit(MOST_LIMITS + 1).count() <= MOST_LIMITS
    joined = metrics.join(F.broadcast(limits) if few else limits, "metric_id").where("_tone is null or _tone = tone")
    return joined.select("doc_id", "metric_id", "value", status(F.col("value"), F.col("chars"), floor).alias("status"), F.col("grp").alias("group"))


def verdicts(results: DataFrame, *, max_warn: int = MAX_WARN) -> DataFrame:
    """doc_id, gate, fail, warn, over, verdict."""
    n = {k.lower(): F.count_if(F.col("status") == k).alias(k.lower()) for k in ("GATE", "FAIL", "WARN", "OVER")}
    out = results.groupBy("doc_id").agg(*n.values())
    return out.withColumn("verdict", F.when((F.col("gate") == 0) & (F.col("fail") == 0) & (F.col("warn") <= max_warn), "PASS").otherwise("FAIL"))


def short_profile(limits: DataFrame, *, drop: list[str] = (), counts: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Limits for short texts: ids (or prefixes that end in a dot) left out, and rates judged as numbers of hits.

    ``counts`` gives a metric's new PASS and WARN limits; its values are to be
    numbers of hits.
    """
    c = F.col
    for d in drop:
        limits = limits.where(~c("metric_id").startswith(d) if d.endswith(".") else c("metric_id") != d)
    for metric, (passes, warns) in (counts or {}).items():
        own = c("metric_id") == metric
        new = {"kind": F.lit("upper"), "pass_max": F.lit(float(passes)), "warn_max": F.lit(float(warns)), "min_chars": F.lit(None).cast("long")}
        limits = limits.withColumns({k: F.when(own, v).otherwise(c(k)) for k, v in new.items()})
    return limits


def as_counts(metrics: DataFrame, hits: DataFrame, ids: list[str]) -> DataFrame:
    """metrics with the number of hits(doc_id, metric_id) in place of the rates of ``ids``."""
    base = F.regexp_replace("metric_id", "_per_1k$", "")
    n = hits.groupBy("doc_id", F.col("metric_id").alias("_base")).agg(F.count("*").cast("double").alias("_n"))
    j = metrics.withColumn("_base", F.when(F.col("metric_id").isin(*ids), base)).join(n, ["doc_id", "_base"], "left")
    return j.withColumn("value", F.when(F.col("_base").isNotNull(), F.coalesce("_n", F.lit(0.0))).otherwise(F.col("value"))).drop("_base", "_n")
