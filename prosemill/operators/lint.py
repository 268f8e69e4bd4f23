"""Texts to verdicts in one call: metrics, statuses against limits, and a code for each text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.plans.rules import RULES

from .hits import rule_hits
from .pairs import fidelity
from .terms import all_metrics
from .verdict import as_counts, judge, short_profile, verdicts

#: Codes of a run: nothing to mend, something to mend.
PASSED, FAILED = 0, 1


@dataclass(frozen=True)
class Lint:
    results: DataFrame  # doc_id, metric_id, value, status
    verdicts: DataFrame  # doc_id, gate, fail, warn, over, verdict, code


def lint(docs: DataFrame, limits: DataFrame, *, rules=RULES, tone: str | None = None, facts: str | None = None, short: dict | None = None, source: str | None = None, terms: DataFrame | None = None) -> Lint:
    """docs(doc_id, text, ...) judged against limits.

    ``facts`` and ``source`` name columns: a fact sheet, and the text that a
    short one translates.  ``short`` is the profile of short texts (the
    arguments of ``verdict.short_profile``); only with it a source and terms
    are looked at.
    """
    if short is None and (source or terms is not None):
        raise ValueError("a source and terms are for short texts")
    values = all_metrics(docs, rules, facts=facts, given_tone=tone, short=short is not None)
    if short is not None:
        limits = short_profile(limits, **short)
        if counts := list(short.get("counts") or {}):
            values = as_counts(values, rule_hits(docs, rules), counts)
    results = judge(values, limits)
    if source:
        both = docs.where(F.col(source).isNotNull()).select(F.col("doc_id").alias("pair_id"), F.col(source).alias("source"), F.col("text").alias("target"))
        kept = fidelity(both, terms).select(F.col("pair_id").alias("doc_id"), "metric_id", F.col("value").cast("double").alias("value"))
        results = results.select("doc_id", "metric_id", "value", "status").unionByName(kept.withColumn("status", F.when(F.col("value") > 0, "GATE").otherwise("PASS")))
    found = verdicts(results)
    return Lint(results, found.withColumn("code", F.when(F.col("verdict") == "PASS", PASSED).otherwise(FAILED)))
