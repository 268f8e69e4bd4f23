"""A training-data pipeline over ``documents``: five stages, each written and read again by the next.

Every stage takes and, but for the last, returns all columns of its input,
whatever their names (columns beside those of ``documents`` bear other names
inside a stage), and works on empty tables.  Null and empty texts have no
letter and go in the first stage; a null language or source is a value like any
other, but isn't trained on; a null doc_id is no copy of anything and stays.
Rows that repeat a doc_id are one document until mixing, whose copies repeat
doc_ids on purpose; packing places each row.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm import language_id as lid
from prosemill.llm.common import Scratch, fresh, remove, table, tables_made
from prosemill.llm.line_dedup import dedup_lines
from prosemill.llm.mixing import mix
from prosemill.llm.near_dedup import near_duplicates
from prosemill.llm.packing import pack

OWN = ("doc_id", "text", "lang", "source", "n_chars")


def sheltered(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, with the columns beside OWN named so that no operator's names meet them, and all named back."""

    @functools.wraps(stage)
    def inside(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        safe: list[str] = []
        for k, c in enumerate(names):
            safe.append(c.lower() if c.lower() in OWN else fresh(f"column_{k}", [*names, *safe]))
        out = stage(spark, docs.toDF(*safe), sf_dir)
        return out.select(*(F.col(a).alias(b) for a, b in zip(safe, names, strict=True)))

    return inside


@sheltered
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those too unlike all training texts to be of a learned language, go."""
    model = lid.fit(spark, docs)
    scored = lid.predict(spark, docs, model)
    return scored.where((F.col("lang_pred") != "und") & (F.col("likeness") >= model.least))


@sheltered
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; a document without any character left goes too."""
    kept = dedup_lines(spark, docs)
    kept = kept.where((F.col("n_dropped") == 0) | (F.trim("text") != ""))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))


@sheltered
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates stays; rows of one doc_id stay or go together."""
    gone = near_duplicates(spark, docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


@sheltered
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same share of a mix as large as its input."""
    return mix(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of at most 1,024 tokens, with its place."""
    return pack(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Language ID, near-duplicate groups and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for name, stage in STAGES[:-1]:
        before = set(tables_made())
        given, docs = docs, scratch.write(stage(spark, docs, sf_dir), name)
        # what the stage read and what its operator left are done with
        for path in tables_made():
            if path not in before and path != docs.scratch_path:
                remove(spark, path)
        if hasattr(given, "scratch_path"):
            scratch.drop(given)
    return STAGES[-1][1](spark, docs, sf_dir)
