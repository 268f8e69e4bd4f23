"""Readers and writers: texts, JSON tables, logs, feeds, and tables that are replaced by key."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.StringType())
def _nfc(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


def normal(text: Column) -> Column:
    """NFC, line feeds only, no byte order mark."""
    return _nfc(F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n"))


def read_text(spark: SparkSession, path: str, *, glob: str | None = None) -> DataFrame:
    """doc_id (the file's path) and text of whole files, below folders too."""
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), normal(F.col("value")).alias("text"))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON document or list as rows."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no and json of the lines of log files, each file's lines in order."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "json"))
    return rows.where(F.trim("json") != "")


def cases(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """case: the folders below path that hold every required file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -2).alias("case"), F.element_at(parts, -1).alias("file")).where(F.col("file").isin(*required))
    return named.groupBy("case").agg(F.count_distinct("file").alias("n")).where(F.col("n") == len(set(required))).select("case")


def paired(files: DataFrame, before: str, after: str) -> DataFrame:
    """stem, before, after: texts whose doc_ids differ in their suffix only."""
    def side(suffix: str, name: str) -> DataFrame:
        return files.where(F.col("doc_id").endswith(suffix)).select(F.expr(f"substring(doc_id, 1, length(doc_id) - {len(suffix)})").alias("stem"), F.col("text").alias(name))

    return side(before, "before").join(side(after, "after"), "stem")


def missing(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Rows still to be fetched."""
    return wanted.join(there.select(key), key, "left_anti")


def strip_note(text: Column) -> Column:
    """A note's body: without front matter, imports, component lines, footnotes and its references."""
    steps = ((r"(?s)\A---\n.*?\n---\n", ""), (r"(?mU)^\s*(?:import|export)\s.*$", ""), (r"(?mU)^\s*<[A-Za-z][^>]*/?>\s*$", ""), (r"(?m)^\[\^[^\]]+\]:.*$", ""))
    for form, to in steps:
        text = F.regexp_replace(text, form, to)
    return F.split(text, r"(?mU)^#{1,3}\s*참고\s*자료\s*$", 2)[0]


def feed_items(feeds: DataFrame, column: str = "xml") -> DataFrame:
    """feed columns but the XML, and link, guid, title, published, author, tags, content of each item."""
    item = F.col("_item")
    one = lambda tag, data=False: F.regexp_extract(item, rf"(?s)<{tag}[^>]*>" + (r"<!\[CDATA\[(.*?)\]\]>" if data else "(.*?)") + f"</{tag}>", 1)
    rest = [c for c in feeds.columns if c != column]
    items = feeds.select(*rest, F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))).alias("_item"))
    link = F.split(one("link"), r"\?")[0]
    named = F.when(one("guid") != "", one("guid")).otherwise(one("link"))
    short = F.regexp_replace(F.element_at(F.split(F.rtrim(named, F.lit("/")), "/"), -1), "[^0-9a-zA-Z]", "")
    return items.select(
        *rest,
        F.when(F.length(short) > 12, F.substring(short, -12, 12)).otherwise(short).alias("id"),
        link.alias("url"),
        one("title", True).alias("title"),
        one("pubDate").alias("published"),
        one("dc:creator", True).alias("author"),
        F.regexp_extract_all(item, F.lit(r"<category><!\[CDATA\[(.*?)\]\]></category>"), F.lit(1)).alias("tags"),
        one("content:encoded", True).alias("content"),
    ).dropDuplicates([*rest, "id"])


def replaced(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of old whose key is not in new, and new."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def write(df: DataFrame, path: str, *, form: str = "parquet", by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").format(form)
    (writer.partitionBy(*by) if by else writer).save(path)
