"""Token counts through a digest cache.

The content of each document, after the tokenizer's own normaliser, is named
by its SHA-256 digest.  Stored counts are joined by (content digest, tokenizer
version); only distinct content that is not stored is encoded, once, and its
counts are appended to the cache.

Which digests miss is found on digests alone.  If they are few beside the rest,
and MOST_BROADCAST at most, they are sent to the texts, so only missing texts
are shuffled, and none if nothing misses; else every distinct text is shuffled
once for each task that reads it, copies having been put together before.  Counts return to documents
by digest; the few digests of very many documents are broadcast, so their
documents stay where they are.

Defined results: null text counts as empty (0 bytes, 0 tokens); rows that
repeat a doc_id each get their own count; a null doc_id stays null; other
columns are ignored, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_hot, map_arrow, new_path, pieces
from .tokens import Source, public_path

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
#: Missing digests (32 bytes each) are broadcast up to this many.
MOST_BROADCAST = 100_000


def _digests(batches, source):
    enc = source.encoder()
    for b in batches:
        for i, j in pieces(b, "text"):
            texts = [enc.normal(t or "") for t in b.column("text")[i:j].to_pylist()]
            raw = b.column("text")[i:j]
            yield {
                "doc_id": b.column("doc_id")[i:j],
                "n_bytes": pc.fill_null(pc.binary_length(raw), 0).cast(pa.int64()),
                "digest": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts],
                "text": texts,
            }


def _encode(batches, source):
    enc = source.encoder()
    for b in batches:
        for i, j in pieces(b, "text"):
            yield {"digest": b.column("digest")[i:j], "version": [enc.version] * (j - i), "n_tokens": [len(x) for x in enc.ids(b.column("text")[i:j].to_pylist())]}


def _digested(docs: DataFrame, source: Source) -> DataFrame:
    enc = source.encoder()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if enc.quick:  # no normaliser: the digest is taken in the JVM
        text = F.coalesce("text", F.lit(""))
        return own.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    return map_arrow(own, "doc_id long, n_bytes long, digest binary, text string", _digests, source)


def count_tokens(spark: SparkSession, docs: DataFrame, *, tokenizer: str | None = None, cache: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``cache`` is the folder of the cache table; a new, empty one if None.
    """
    source = Source(spark, tokenizer or public_path("byte_bpe_50k.json"))
    version = source.encoder().version
    cache = cache or new_path(spark, "token_cache")
    scratch = Scratch(spark)
    full = _digested(docs, source)
    rows = scratch.write(full.drop("text"), "digests")
    digests = scratch.write(rows.groupBy("digest").agg(F.count("*").alias("many")), "digests")
    try:
        spark.read.schema(CACHE_SCHEMA).parquet(cache).limit(1).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)

    def stored() -> DataFrame:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    misses = scratch.write(digests.join(stored(), "digest", "left_anti").select("digest"), "misses")
    if n := misses.count():
        texts = full.select("digest", "text")
        if few := n <= min(MOST_BROADCAST, digests.count() // 2):
            texts = texts.join(F.broadcast(misses), "digest", "left_semi")
        # equal digests have equal texts, which are put together where they are read, before they are shuffled
        texts = texts.groupBy("digest").agg(F.first("text").alias("text"))
        if not few:
            texts = texts.join(misses, "digest", "left_semi")
        before = spark.conf.get(Scratch.CLEAN, "false")
        spark.conf.set(Scratch.CLEAN, "true")
        try:
            map_arrow(texts, CACHE_SCHEMA, _encode, source).write.mode("append").option("compression", "zstd").parquet(cache)
        finally:
            spark.conf.set(Scratch.CLEAN, before)
    counted = scratch.write(digests.join(stored(), "digest"), "counted")
    scratch.drop(digests, misses)  # the result reads rows and counted
    out = join_hot(rows, counted, "digest", rows.count())
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
