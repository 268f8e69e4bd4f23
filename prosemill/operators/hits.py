"""Where rules and detectors hit: one row a hit, the first few of each metric, and the rest by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions import hangul as H
from prosemill.plans.rules import RULES, by_id

from .metrics import HIT_CHARS, any_of, first_match, rule_hit, unicode_rx
from .units import labelled, units

SHOWN = 5
REPORT = ("A14.report_write", "A14.report_write_check")


def rule_hits(docs: DataFrame, rules=RULES, **params) -> DataFrame:
    """doc_id, metric_id, ord, line, text, match: sentences in order, then headings, then table rows."""
    u = labelled(units(docs, **params)).where("kind in ('sentence', 'heading', 'row')").withColumn("_ko", F.col("text").rlike("[가-힣]"))
    found = []
    for r in rules:
        target = F.col("text") if r.raw else F.col("masked")
        hit = rule_hit(r)
        if r.id in REPORT and (quoted := by_id(rules).get("A14.quoted_english_token")):
            hit = hit & ~rule_hit(quoted)
        if r.id == "G8.beyond_simple":
            hit = hit | ((F.col("kind") == "heading") & any_of(F.col("masked"), r.patterns))
        found.append(F.when(hit, F.struct(F.lit(r.id).alias("metric_id"), first_match(target, r.patterns).alias("match"))))
    hits = F.filter(F.array(*found), lambda x: x.isNotNull())
    rows = u.select("doc_id", "pos", "kind", "line", F.substring("text", 1, HIT_CHARS).alias("text"), F.inline(hits))
    place = F.array_position(F.array(F.lit("sentence"), F.lit("heading"), F.lit("row")), F.col("kind"))
    w = Window.partitionBy("doc_id", "metric_id").orderBy(place, "pos")
    return rows.select("doc_id", "metric_id", F.row_number().over(w).alias("ord"), "line", "text", "match")


def shown(hits: DataFrame, *, most: int = SHOWN) -> DataFrame:
    """doc_id, metric_id, hits, more: the first ``most`` hits whole, of the others line and match."""
    lists = lambda c, *cols: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("ord", *cols)))), lambda x: F.struct(*(x[k].alias(k) for k in cols)))
    return hits.groupBy("doc_id", "metric_id").agg(lists(F.col("ord") <= most, "line", "text", "match").alias("hits"), lists(F.col("ord") > most, "line", "match").alias("more"))


def endings(docs: DataFrame, **params) -> DataFrame:
    """doc_id, cls, bucket, n: how body sentences end."""
    s = labelled(units(docs, **params)).where("body")
    return s.groupBy("doc_id", "cls", "bucket").agg(F.count("*").alias("n"))


def ending_maps(docs: DataFrame, **params) -> DataFrame:
    """doc_id, classes, buckets: maps to counts."""
    e = endings(docs, **params)
    of = lambda k: e.groupBy("doc_id", k).agg(F.sum("n").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(k, "n"))).alias({"cls": "classes", "bucket": "buckets"}[k]))
    return of("cls").join(of("bucket"), "doc_id")


def sentence_counts(docs: DataFrame, patterns: dict[str, str], **params) -> DataFrame:
    """doc_id and, for each named pattern, how many body sentences it occurs in: to try rules out."""
    s = labelled(units(docs, **params)).where("body")
    return s.groupBy("doc_id").agg(*(F.count_if(F.col("masked").rlike(unicode_rx(p))).alias(k) for k, p in patterns.items()))


# Last syllables that a bare noun doesn't have.
NOT_NOUN_END = "은는이가을를의에와과도만로서고며면다요지게한할된될던인히니까야여나든엔랑께럼터"


def noun_stacks(docs: DataFrame, *, least: int = 4, **params) -> DataFrame:
    """doc_id, line, text, longest: sentences with ``least`` or more bare nouns in a row."""
    s = labelled(units(docs, **params)).where("body")
    words = H.words(F.translate(F.regexp_replace("masked", H.PLACEHOLDER, " "), ",", " "))
    bare = lambda w: w.rlike("^[가-힣]{2,}$") & ~w.rlike(f"[{NOT_NOUN_END}]$")
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a, w):
        run = F.when(bare(w), a["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(a["best"], run).alias("best"))

    longest = F.aggregate(words, start, step, lambda a: a["best"])
    return s.select("doc_id", "line", "text", longest.alias("longest")).where(F.col("longest") >= least)


def changed_hits(pairs: DataFrame, rules=RULES) -> DataFrame:
    """metric_id, changed, kept, after: hits in sentences that a revision changed, kept, and hits after it.

    pairs(pair_id, before, after).  A hit belongs to a changed sentence if one
    holds the other's first 50 characters.
    """
    from .pairs import _alignment, _sided

    docs = _sided(pairs)
    hits = rule_hits(docs, rules, keep=())
    side = F.split("doc_id", "\t")
    hits = hits.select(side[0].alias("pair"), side[1].alias("side"), "metric_id", "text")
    s = labelled(units(docs)).where("body").select(side[0].alias("pair"), side[1].alias("side"), "pos", "text")
    seqs = s.groupBy("pair", "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("s"))
    b, a = (seqs.where(F.col("side") == k).select("pair", F.col("s").alias(k)) for k in ("b", "a"))
    both = b.join(a, "pair", "left").withColumn("same", _alignment("a", "b")["places"])
    changed = both.select("pair", F.transform("same", lambda i: F.get("b", i)).alias("changed"))
    first = lambda x: F.substring(x, 1, 50)
    inside = F.exists(F.coalesce("changed", F.array().cast("array<string>")), lambda c: c.contains(first(F.col("text"))) | F.col("text").contains(first(c)))
    old = hits.where("side = 'b'").join(changed, "pair", "left").groupBy("metric_id").agg(F.count_if(inside).alias("changed"), F.count_if(~inside).alias("kept"))
    new = hits.where("side = 'a'").groupBy("metric_id").agg(F.count("*").alias("after"))
    return old.join(new, "metric_id", "full").na.fill(0)
