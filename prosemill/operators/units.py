"""Units of documents: one Arrow kernel, then Column expressions.

The kernel's array is exploded where the document lies: nothing is dealt.  What
is summed by document is first cut down to flags and numbers, so the exchange
that windows and aggregates share moves no texts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosemill.functions import hangul as H
from prosemill.functions import markdown
from prosemill.functions.plan import settled

_TEXT, _INT, _BOOL = (T.StringType(), pa.string()), (T.IntegerType(), pa.int32()), (T.BooleanType(), pa.bool_())
UNIT = {
    "pos": _INT, "kind": _TEXT, "block": _INT, "type": _TEXT, "line": _INT, "level": _INT, "list_id": _INT, "depth": _INT, "section": _INT, "in_refs": _BOOL,
    "para": _INT, "nth": _INT, "last": _BOOL, "question": _BOOL, "after": _TEXT, "bold": _INT, "text": _TEXT, "masked": _TEXT, "raw": _TEXT,
}
UNITS = T.ArrayType(T.StructType([T.StructField(n, t[0]) for n, t in UNIT.items()]))
ARROW_UNITS = pa.list_(pa.struct([(n, t[1]) for n, t in UNIT.items()]))


def rows_of(found: list[dict]) -> list[dict]:
    return [{n: u[n] for n in UNIT} for u in found]


@F.arrow_udf(UNITS)
def _units(text: pa.Array) -> pa.Array:
    return pa.array([rows_of(markdown.units(t)) for t in text.to_pylist()], ARROW_UNITS)


def exploded(parsed: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns to keep, and a row for each unit of _u; one row of nulls for a document without any."""
    return parsed.select("doc_id", *keep, F.explode_outer("_u").alias("_u")).select("doc_id", *keep, "_u.*")


def units(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, and a row for each heading, block, table row and sentence."""
    parsed = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("_text")).select("doc_id", *keep, _units("_text").alias("_u"))
    return exploded(parsed, *keep)


def labelled(units: DataFrame) -> DataFrame:
    """Units with, for sentences, last word, ending class and bucket, and whether they count as body text."""
    s = F.col("kind") == "sentence"
    out = units.withColumn("word", F.when(s, H.last_word(F.col("text"))))
    out = out.withColumn("cls", F.when(s, H.ending_class(F.col("word"), F.col("question"))))
    out = out.withColumn("bucket", F.when(s, H.ending_bucket(F.col("text"), F.col("word"), F.col("cls"))))
    body = s & ((F.col("type") == "paragraph") | ~F.col("cls").isin("NOUN", "OTHER"))
    return settled(out.withColumn("body", body))


def sentences(docs: DataFrame, **params) -> DataFrame:
    return labelled(units(docs, **params)).where("kind = 'sentence'")
