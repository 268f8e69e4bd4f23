"""Corpora: selection, cohorts, holdout, calibration of limits, and reports of rates and quantiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions.hangul import holdout

from .verdict import judge, verdicts

# Periods, least sizes, words of articles that don't count.
CUTOFF, CASUAL_END, DRIFT_START = "2022-12-01", "2024-07-01", "2025-01-01"
TONE_SHARE, PER_AUTHOR = 0.9, 2
RATIO_SUFFIXES = ("_ratio", "_per_1k", "_cv", "_mean")


def tone_group(classes: Column) -> Column:
    """struct(tone, share) from a map of ending classes to counts: default or casual at a share of 0.9, else mixed or unknown."""
    n = lambda k: F.coalesce(classes[k], F.lit(0))
    formal, polite = n("HAPNIDA"), n("HAEYO")
    all_ = formal + polite + n("HAERA")
    tone = F.when(all_ == 0, "unknown").when(formal / all_ >= TONE_SHARE, "default").when(polite / all_ >= TONE_SHARE, "casual").otherwise("mixed")
    return F.struct(tone.alias("tone"), F.when(all_ == 0, 0.0).otherwise(F.greatest(formal, polite) / all_).alias("share"))


def period(date: Column) -> Column:
    """ISO dates compare as text."""
    return F.when(date < CUTOFF, "pre2023").when(date < CASUAL_END, "2023-2024H1").when(date >= DRIFT_START, "drift").otherwise("gap")


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that holds; null if none does."""
    return reduce(lambda c, r: c.when(r[1], r[0]), reasons[1:], F.when(reasons[0][1], reasons[0][0]))


def select(articles: DataFrame, reasons: list[tuple[str, Column]], *, author: str = "author", by: list[str] = (), order: list[str] = ("date", "id"), most: int = PER_AUTHOR) -> DataFrame:
    """articles with reason and included: the first reason that holds, then at most ``most`` of a named author in order.

    ``by`` and ``order`` together name an article.
    """
    a = articles.withColumn("reason", first_reason(reasons) if reasons else F.lit(None).cast("string"))
    named = F.coalesce(F.trim(F.split(author, ",")[0]), F.lit(""))
    counts = F.col("reason").isNull() & (named != "")
    # the rank is a limit of each group, which Spark applies before it deals rows: no task gets all rows of an author
    w = Window.partitionBy(*by, "_author").orderBy(*order)
    first = a.where(counts).select(*by, *order, named.alias("_author")).withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= most)
    first = first.select(*(F.col(c).alias(f"_{c}") for c in (*by, *order)), F.lit(True).alias("_first"))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, *order)))
    a = a.join(first, same & counts, "left")
    over = counts & F.col("_first").isNull()
    a = a.withColumn("reason", F.when(over, f"more than {most} of an author").otherwise(F.col("reason")))
    return a.drop("_first", *(f"_{c}" for c in (*by, *order))).withColumn("included", F.col("reason").isNull())


# Reasons to leave an article out, in the order in which they are asked.
NO_TEXT, NOT_TECHNICAL, NO_KOREAN, LITTLE_KOREAN, SHORT, MIXED, GAP, LATE = (
    "no text", "not technical", "no Korean text", "little Korean text", "below 1,500 characters or 30 sentences", "mixed tone", "outside the periods", "formal but late",
)


def measure(meta: DataFrame, stats: DataFrame, classes: DataFrame) -> DataFrame:
    """Articles (id, site, date, title, author, error, technical, hangul) joined with their measures, with reason, group and holdout.

    stats(doc_id, chars, sentences, ...); classes(doc_id, classes): a map of
    ending classes; hangul: the number of Korean letters.
    """
    a = meta.join(stats.withColumnRenamed("doc_id", "id").drop("tone", "title"), "id", "left").join(classes.withColumnRenamed("doc_id", "id"), "id", "left")
    a = a.withColumn("t", tone_group(F.coalesce("classes", F.create_map().cast("map<string,bigint>")))).withColumn("period", period(F.coalesce("date", F.lit(""))))
    a = a.withColumns({"tone": F.col("t.tone"), "tone_share": F.col("t.share")}).drop("t", "classes")
    c = F.col
    reasons = [
        (NO_TEXT, c("error").isNotNull() | c("chars").isNull()),
        (NOT_TECHNICAL, ~c("technical")),
        (NO_KOREAN, c("hangul") < 300),
        (LITTLE_KOREAN, c("hangul") < 1000),
        (SHORT, (c("chars") < 1500) | (c("sentences") < 30)),
        (MIXED, c("tone").isin("mixed", "unknown")),
        (GAP, c("period") == "gap"),
        (LATE, (c("tone") == "default") & (c("period") == "2023-2024H1")),
    ]
    got = select(a, reasons, by=["tone", "period"])
    group = F.when(F.col("period") == "drift", F.concat(F.lit("drift-"), F.col("tone"))).otherwise(F.col("tone"))
    return got.withColumn("group", F.when(F.col("included"), group)).withColumn("holdout", F.col("included") & holdout(F.col("id")))


def is_count(metric: Column, whole: Column) -> Column:
    return whole & ~reduce(lambda a, b: a | b, (metric.endswith(s) for s in RATIO_SUFFIXES))


#: Cuts of a group's value range from an approximate sketch: a task sorts one such range of one group.
RANGES = 200


def quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float], **more: Column) -> DataFrame:
    """by, a column for each of qs, n: exact quantiles by linear interpolation at (n - 1) q, and aggregates of ``more``.

    A bounded sketch cuts each group's values into ranges; counts of ranges tell
    which of them hold the wanted ranks, and only those are ranked exactly.  No
    task holds a group, and equal values are counted before they are ranked.
    """
    at = [k / RANGES for k in range(1, RANGES)]
    df = df.where(F.col(value).isNotNull())
    keys = {k: F.col(k) for k in by}
    whole = df.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx(value, at, 20 * RANGES).alias("_cuts"), *(c.alias(k) for k, c in more.items()))
    same = lambda a, b: reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))
    counts = df.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    place = F.size(F.filter("g._cuts", lambda c: c < F.col("v._v")))
    counts = counts.alias("v").join(whole.select(*by, "_cuts").alias("g"), same("v", "g")).select("v.*", place.alias("_range"))
    sums = counts.groupBy(*by, "_range").agg(F.sum("_c").alias("_in"))
    w = Window.partitionBy(*by).orderBy("_range")
    sums = sums.withColumn("_before", F.sum("_in").over(w) - F.col("_in"))
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor((F.col("n") - 1) * q), F.ceil((F.col("n") - 1) * q)) for q in qs.values()))))
    wanted = whole.select(*by, ranks.alias("_ranks"))
    held = F.filter("w._ranks", lambda r: (r >= F.col("s._before")) & (r < F.col("s._before") + F.col("s._in")))
    few = sums.alias("s").join(wanted.alias("w"), same("s", "w")).select("s.*", held.alias("_held")).where(F.size("_held") > 0)
    inner = counts.alias("c").join(few.alias("f"), same("c", "f") & (F.col("c._range") == F.col("f._range"))).select("c.*", "f._before", "f._held")
    w = Window.partitionBy(*by, "_range").orderBy("_v")
    inner = inner.withColumn("_at", F.col("_before") + F.sum("_c").over(w) - F.col("_c"))
    hit = F.filter("_held", lambda r: (r >= F.col("_at")) & (r < F.col("_at") + F.col("_c")))
    found = inner.withColumn("_hit", hit).where(F.size("_hit") > 0).select(*by, F.explode("_hit").alias("_r"), "_v")
    found = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_m"))

    def between(q: float) -> Column:
        pos = (F.col("g.n") - 1) * q
        low, high = F.col("m._m")[F.floor(pos)], F.col("m._m")[F.ceil(pos)]
        return low + (high - low) * (pos - F.floor(pos))

    out = whole.alias("g").join(found.alias("m"), same("g", "m"))
    return out.select(*(f"g.{k}" for k in by), *(between(q).alias(k) for k, q in qs.items()), "g.n", *(f"g.{k}" for k in more))


def calibrate(values: DataFrame, limits: DataFrame, *, groups: tuple[str, ...] = ("default", "casual")) -> DataFrame:
    """New limits from values(metric_id, value, chars, grp, site, holdout) of the calibration groups.

    upper: 95th percentile, and beyond the largest by 1 (counts) or a fifth;
    lower: 5th percentile, and the smallest less a fifth; range: both;
    poisson: pooled rate, a ratio of sums; gates and fixed limits stay.
    """
    pool = values.where(F.col("grp").isin(*groups) & ~F.col("holdout")).withColumnRenamed("grp", "_group")
    pool = pool.join(limits.select("metric_id", "tone", "kind", "fixed", "exclude_site"), "metric_id")
    pool = pool.where("(tone is null or tone = _group) and (exclude_site is null or exclude_site <> site)")
    key = ["metric_id", "tone"]
    pool = pool.withColumn("tone", F.coalesce("tone", F.lit("")))
    qs = {"p01": 0.01, "p05": 0.05, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    whole = F.bool_and(F.col("value") == F.floor("value"))
    q = quantiles(pool, key, "value", qs, low=F.min("value"), high=F.max("value"), whole=whole, total=F.sum("value"), chars=F.sum("chars"))
    c = F.col
    counts = is_count(c("metric_id"), c("whole"))
    up = lambda x: F.when(counts, F.ceil(x).cast("double")).otherwise(F.round(x, 3))
    down = lambda x: F.when(counts, F.floor(x).cast("double")).otherwise(F.round(x, 3))
    top, bottom = F.greatest("p99", "high"), F.least("p01", "low") * 0.8
    top = F.when(counts, top + 1).otherwise(top * 1.2)
    q = q.select(
        *key, "n", "p10", "p50", "p90",
        up(c("p95")).alias("new_pass_max"), F.greatest(up(c("p95")), up(top)).alias("new_warn_max"),
        down(c("p05")).alias("new_pass_min"), F.least(down(c("p05")), down(bottom)).alias("new_warn_min"),
        F.round(F.when(c("chars") > 0, c("total") / c("chars") * 1000), 3).alias("new_rate"),
        F.round("p05", 3).alias("new_pass_lo"), F.round("p95", 3).alias("new_pass_hi"), F.round(bottom, 3).alias("new_warn_lo"), F.round(F.greatest("p99", "high") * 1.2, 3).alias("new_warn_hi"),
    )
    old = limits.withColumn("tone", F.coalesce("tone", F.lit(""))).join(q, key, "left")
    free = (c("kind") != "gate") & ~F.coalesce("fixed", F.lit(False)) & c("n").isNotNull()

    def moved(kind: str, new: str, was: str):
        return F.when(free & (c("kind") == kind), c(new)).otherwise(c(was)).alias(was)

    ranges = ("pass_lo", "pass_hi", "warn_lo", "warn_hi")
    kept = [x for x in limits.columns if x not in ("pass_max", "warn_max", "pass_min", "warn_min", "rate_per_1k", "tone", *ranges)]
    return old.select(
        *kept, F.when(c("tone") != "", c("tone")).alias("tone"), moved("upper", "new_pass_max", "pass_max"), moved("upper", "new_warn_max", "warn_max"),
        moved("lower", "new_pass_min", "pass_min"), moved("lower", "new_warn_min", "warn_min"), moved("poisson", "new_rate", "rate_per_1k"), *(moved("range", f"new_{k}", k) for k in ranges), "n", "p10", "p50", "p90",
    )


def pass_rate(values: DataFrame, limits: DataFrame, *, max_warn: int = 3) -> DataFrame:
    """held, passed, rate of held-out articles(doc_id, metric_id, value, chars, tone), policy limits left out."""
    v = verdicts(judge(values, limits, skip_policy=True), max_warn=max_warn)
    return v.agg(F.count("*").alias("held"), F.count_if(F.col("verdict") == "PASS").alias("passed")).withColumn("rate", F.col("passed") / F.col("held"))


def pooled_rates(values: DataFrame, by: list[str]) -> DataFrame:
    """Hits per 1,000 characters over all articles of a group: a ratio of sums."""
    got = values.groupBy(*by).agg(F.sum("value").alias("hits"), F.sum("chars").alias("chars"), F.count_if(F.col("value") > 0).alias("articles_with"), F.count("*").alias("articles"), F.max("value").alias("most"))
    return got.withColumn("per_1k", F.when(F.col("chars") > 0, F.col("hits") * 1000 / F.col("chars")).otherwise(0.0))


def status_histogram(results: DataFrame) -> DataFrame:
    """Metrics by how badly they fail: 3 for FAIL and GATE, 1 for WARN."""
    got = results.groupBy("metric_id").pivot("status", ["PASS", "INFO", "CHECK", "OVER", "WARN", "FAIL", "GATE"]).count().na.fill(0)
    return got.withColumn("weight", 3 * (F.col("FAIL") + F.col("GATE")) + F.col("WARN")).orderBy(F.desc("weight"), "metric_id")


def by_group(values: DataFrame, groups: list[str], value: Column, *, rows: str = "metric_id", column: str = "grp") -> DataFrame:
    return values.groupBy(rows).pivot(column, groups).agg(value)


def control_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in an order that a hash of (seed, key) gives."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key))).limit(n)
