"""Line dedup over sharded cuckoo filters that exact reference-count tables back.

A line's key is the line without white space at its ends, A-Z lower-cased;
keys of at least ``min_chars`` code points take part.  The index has three
tables in the shared folder:

* ``postings``: key digest, doc_id, once for each document that holds the key;
* ``counts``: shard, key, number of holders, first holder: the exact reference
  counts, made from the postings;
* ``filters``: one cuckoo filter for each shard, which holds a key's
  fingerprint once if one document has it and twice if several have.

Two copies in a key's buckets mean "maybe repeated"; fewer mean "surely not".
Lines are dealt to the shard of their key and probed there, by tasks that hold
that shard's filter and the exact counts of its repeated keys and nothing
else; a shard's lines are cut into salted parts of PART_ROWS, so a line of
very many documents is probed by many tasks.  The filter lets through the few
lines that are looked up exactly.  Nothing is broadcast, and a task's tables
are bounded by KEYS_PER_SHARD: an index that grows beyond twice that gets more
shards.

Cuckoo filters delete as well as insert, and postings know every holder, so
taking a document out restores the state without it (``LineIndex.delete``).

Defined results: null or empty text is one empty line; rows that repeat a
doc_id are one holder; rows with a null doc_id hold no lines and lose none;
extra columns are ignored by the index and kept by ``dedup_lines``, whose own
columns win over columns of the same name; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh, map_arrow, mix64, pieces

KEYS_PER_SHARD = 1 << 16
#: Lines of a shard that one task probes.
PART_ROWS = 1 << 16
#: Numbers of parts are broadcast up to so many shards.
MOST_BROADCAST = 100_000
SLOTS = 4


class CuckooFilter:
    """16-bit fingerprints, four slots a bucket; built, probed and changed by whole arrays of 64-bit hashes."""

    def __init__(self, n_keys: int = 0, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(4, int(np.ceil(np.log2(max(1, n_keys) / (SLOTS * 0.8)))))
            table = np.zeros((buckets, SLOTS), dtype=np.uint16)
        self.table = table

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp = (h >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        a = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return fp, a, self._other(a, fp)

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return bucket ^ (mix64(fp.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def count(self, h: np.ndarray) -> np.ndarray:
        """How often each fingerprint stands in its two buckets."""
        fp, a, b = self._places(h)
        n = (self.table[a] == fp[:, None]).sum(1)
        return n + np.where(a != b, (self.table[b] == fp[:, None]).sum(1), 0)

    def insert(self, h: np.ndarray, rng: np.random.Generator | None = None, rounds: int = 500) -> bool:
        """False if some found no place: then build a larger filter from the exact table."""
        rng = rng or np.random.default_rng(1)
        fp, a, b = self._places(h)
        at = a
        second = b
        for turn in range(rounds):
            if not len(fp):
                return True
            order = np.argsort(at, kind="stable")
            fp, at, second = fp[order], at[order], second[order]
            first = np.r_[True, at[1:] != at[:-1]]
            start = np.flatnonzero(first)
            rank = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
            free = self.table[at] == 0
            fits = rank < free.sum(1)
            slot = np.argmax(free.cumsum(1) == (rank + 1)[:, None], axis=1)
            self.table[at[fits], slot[fits]] = fp[fits]
            fp, at, second = fp[~fits], at[~fits], second[~fits]
            if turn % 2 == 0:  # try the other bucket first
                at, second = second, at
                continue
            # one of each crowded bucket throws a dweller out and takes its slot
            lead = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
            k = np.flatnonzero(lead)
            victim = rng.integers(0, SLOTS, len(k))
            out = self.table[at[k], victim]
            self.table[at[k], victim] = fp[k]
            old = at[k]
            fp[k] = out
            at, second = second, at
            live = out != 0
            at[k] = self._other(old, out)
            second[k] = old
            gone = np.zeros(len(fp), bool)
            gone[k[~live]] = True
            fp, at, second = fp[~gone], at[~gone], second[~gone]
        return not len(fp)

    def delete(self, h: np.ndarray) -> None:
        """Takes one copy of each out; all must have been inserted."""
        fp, a, b = self._places(h)
        left = ~self._cleared(fp, a)
        self._cleared(fp[left], b[left])

    def _cleared(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Takes a copy of each fingerprint out of its bucket: which of them had one."""
        order = np.lexsort((fp, at))
        p, q = fp[order], at[order]
        # the n-th of equal fingerprints in a bucket takes the bucket's n-th copy
        first = np.append(True, (q[1:] != q[:-1]) | (p[1:] != p[:-1]))[: len(q)]
        start = np.flatnonzero(first)
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        copies = self.table[q] == p[:, None]
        has = rank < copies.sum(1)
        slot = np.argmax(copies.cumsum(1) == (rank + 1)[:, None], axis=1)
        self.table[q[has], slot[has]] = 0
        out = np.empty(len(fp), bool)
        out[order] = has
        return out

    @classmethod
    def build(cls, h: np.ndarray) -> CuckooFilter:
        n = len(h)
        while not (f := cls(n)).insert(h):
            n = max(2 * n, 16)
        return f

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(raw, dtype=np.uint16).reshape(-1, SLOTS).copy())


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The key of each line; None where the line doesn't take part."""
    keys = [x.strip() for x in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]
    return [k if len(k) >= min_chars and (k.isascii() or len(k.decode("utf-8", "surrogatepass")) >= min_chars) else None for k in keys]


def _hash(digest: bytes) -> int:
    return int.from_bytes(digest[8:], "little")


def _postings(batches, min_chars):
    for b in batches:
        for i, j in pieces(b, "text"):
            doc_out, key_out = [], []
            for doc, text in zip(b.column("doc_id")[i:j].to_pylist(), b.column("text")[i:j].to_pylist(), strict=True):
                if doc is None:
                    continue
                keys = {xxhash.xxh3_128_digest(k) for k in line_keys(text, min_chars) if k is not None}
                doc_out += [doc] * len(keys)
                key_out += keys
            yield {"key": key_out, "doc_id": doc_out}


FILTER, COUNTS, LINES = 0, 1, 2


def _probe(batches):
    """Rows sorted by shard and salt: the filter, the exact counts of repeated keys, then the lines to be probed."""
    own, table, exact, first = None, None, [], []
    keys = firsts = None
    for b in batches:
        out: dict[str, list] = {"key": [], "doc_id": []}
        kinds = np.asarray(b.column("kind"))
        parts = np.asarray(b.column("shard")), np.asarray(b.column("salt"))
        edge = np.flatnonzero(np.append(True, (kinds[1:] != kinds[:-1]) | (parts[0][1:] != parts[0][:-1]) | (parts[1][1:] != parts[1][:-1]))) if len(kinds) else []
        for a, z in zip(edge, [*edge[1:], len(kinds)], strict=True):
            if own != (part := (parts[0][a], parts[1][a])):
                own, table, exact, first, keys = part, None, [], [], None
            if kinds[a] == FILTER:
                table = CuckooFilter.load(b.column("filter")[a].as_py())
                continue
            key, doc = b.column("key")[a:z].to_pylist(), np.asarray(b.column("doc_id")[a:z])
            if kinds[a] == COUNTS:
                exact += key
                first.append(doc)
                continue
            if table is None or not exact:
                continue
            maybe = np.flatnonzero(table.count(np.array([_hash(k) for k in key], dtype=np.uint64)) >= 2)
            if not len(maybe):
                continue
            if keys is None:
                raw = np.array(exact, dtype="S16")
                order = np.argsort(raw)
                keys, firsts = raw[order], np.concatenate(first)[order]
            asked = np.array([key[k] for k in maybe], dtype="S16")
            spot = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            gone = maybe[(keys[spot] == asked) & (doc[maybe] > firsts[spot])]
            out["key"] += [key[k] for k in gone]
            out["doc_id"] += doc[gone].tolist()
        yield out


def _dropped(batches, min_chars, text, drop, sha, n_lines, n_dropped):
    """The columns text, n_lines, n_dropped and, unless it is None, sha, with the keys in ``drop`` taken out."""
    for b in batches:
        for i, j in pieces(b, text):
            out: dict[str, list] = {text: [], n_lines: [], n_dropped: [], sha: []}
            for t, gone in zip(b.column(text)[i:j].to_pylist(), b.column(drop)[i:j].to_pylist(), strict=True):
                lines = (t or "").split("\n")
                n, kept = len(lines), t
                if gone:
                    gone = set(gone)
                    lines = [x for x, k in zip(lines, line_keys(t, min_chars), strict=True) if k is None or xxhash.xxh3_128_digest(k) not in gone]
                    kept = "\n".join(lines)
                out[text].append(kept if sha is None else None)
                out[n_lines].append(n)
                out[n_dropped].append(n - len(lines))
                out[sha].append(sha and hashlib.sha256((kept or "").encode("utf-8", "surrogatepass")).hexdigest())
            yield out | {c: b.column(c)[i:j] for c in b.schema.names if c not in (text, drop)}


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    h = np.array([_hash(k) for k in rows["key"]], dtype=np.uint64)
    f = CuckooFilter.build(np.concatenate([h, h[rows["n_docs"].to_numpy() > 1]]))
    return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "filter": [f.dump()]})


def _change(key, old: pd.DataFrame, delta: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after keys went from ``was`` to ``now`` holders."""
    f = CuckooFilter.load(old["filter"].iloc[0]) if len(old) else None
    if len(delta):
        h = np.array([_hash(k) for k in delta["key"]], dtype=np.uint64)
        step = np.minimum(delta["now"].to_numpy(), 2) - np.minimum(delta["was"].to_numpy(), 2)
        if f is None:
            f = CuckooFilter(2 * len(h))
        for k in (1, 2):
            f.delete(h[step <= -k])
        more = np.concatenate([h[step >= k] for k in (1, 2)])
        if not f.insert(more):
            return pd.DataFrame({"shard": [key[0]], "filter": [None]})  # to be built anew from the exact table
    return pd.DataFrame({"shard": [key[0]], "filter": [f.dump()]})


class LineIndex:
    """Postings, counts and filters of a set of documents; ``insert`` and ``delete`` return new indexes."""

    def __init__(self, spark: SparkSession, postings: DataFrame, counts: DataFrame, filters: DataFrame, shards: int, min_chars: int):
        self.spark, self.postings, self.counts, self.filters, self.shards, self.min_chars = spark, postings, counts, filters, shards, min_chars

    @classmethod
    def of(cls, spark: SparkSession, docs: DataFrame, *, min_chars: int = 10, shards: int | None = None) -> LineIndex:
        return cls._made(spark, cls._lines(spark, docs, min_chars), shards, min_chars)

    @staticmethod
    def _lines(spark: SparkSession, docs: DataFrame, min_chars: int) -> DataFrame:
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        return Scratch(spark).write(map_arrow(own, "key binary, doc_id long", _postings, min_chars), "postings")

    @classmethod
    def _made(cls, spark: SparkSession, postings: DataFrame, shards: int | None, min_chars: int) -> LineIndex:
        scratch = Scratch(spark)
        if shards is None:
            shards = cls._wanted(postings.count())
        counts = scratch.write(cls._counts(postings, shards), "counts")
        filters = scratch.write(counts.groupBy("shard").applyInPandas(_build, "shard long, filter binary"), "filters")
        return cls(spark, postings, counts, filters, shards, min_chars)

    @staticmethod
    def _wanted(n: int) -> int:
        return 1 << max(0, int(np.ceil(np.log2(max(1, n) / KEYS_PER_SHARD))))

    @staticmethod
    def _counts(postings: DataFrame, shards: int) -> DataFrame:
        """shard, key, n_docs, first_doc: a hot key's holders are counted in parts, by doc_id, and then summed."""
        own = postings.distinct().groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
        return own.select(_shard(shards).alias("shard"), "key", "n_docs", "first_doc")

    def _changed(self, postings: DataFrame) -> LineIndex:
        scratch = Scratch(self.spark)
        postings = scratch.write(postings, "postings")
        if self._wanted(postings.count()) > 2 * self.shards:
            return self._made(self.spark, postings, None, self.min_chars)
        counts = scratch.write(self._counts(postings, self.shards), "counts")
        was, now = (c.select("shard", "key", F.col("n_docs").alias(name)) for c, name in ((self.counts, "was"), (counts, "now")))
        delta = was.join(now, ["shard", "key"], "full").na.fill(0).where("was <> now and least(was, 2) <> least(now, 2)")
        filters = scratch.write(self.filters.groupBy("shard").cogroup(delta.groupBy("shard")).applyInPandas(_change, "shard long, filter binary"), "filters")
        broken = filters.where("filter is null").select("shard")
        if not broken.isEmpty():
            anew = counts.join(broken, "shard", "left_semi").groupBy("shard").applyInPandas(_build, "shard long, filter binary")
            filters = scratch.write(filters.where("filter is not null").unionByName(anew), "filters")
        return LineIndex(self.spark, postings, counts, filters, self.shards, self.min_chars)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(self.postings.unionByName(self._lines(self.spark, docs, self.min_chars)).distinct())

    def delete(self, ids: DataFrame) -> LineIndex:
        return self._changed(self.postings.join(ids.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_anti").select("key", "doc_id"))

    def to_drop(self, docs: DataFrame) -> DataFrame:
        """doc_id, drop: digests of the keys that the document loses."""
        return self._to_drop(self._lines(self.spark, docs, self.min_chars))

    def own_to_drop(self) -> DataFrame:
        """``to_drop`` of the documents that the index was made of."""
        return self._to_drop(self.postings)

    def _to_drop(self, lines: DataFrame) -> DataFrame:
        lines = lines.select(_shard(self.shards).alias("shard"), "key", "doc_id")
        salts = lines.groupBy("shard").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("salts"))
        small = self.shards <= MOST_BROADCAST
        salts = F.broadcast(salts) if small else salts
        none, no_doc = F.lit(None).cast("binary"), F.lit(None).cast("long")

        def dealt(rows: DataFrame) -> DataFrame:
            return rows.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

        filters = dealt(self.filters).select("shard", "salt", F.lit(FILTER).alias("kind"), none.alias("key"), no_doc.alias("doc_id"), "filter")
        exact = dealt(self.counts.where("n_docs > 1")).select("shard", "salt", F.lit(COUNTS).alias("kind"), "key", F.col("first_doc").alias("doc_id"), none.alias("filter"))
        asked = lines.join(salts, "shard").select("shard", F.pmod(F.xxhash64("doc_id"), "salts").cast("int").alias("salt"), F.lit(LINES).alias("kind"), "key", "doc_id", none.alias("filter"))
        rows = filters.unionByName(exact).unionByName(asked).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
        gone = map_arrow(rows, "key binary, doc_id long", _probe)
        return gone.groupBy("doc_id").agg(F.collect_set("key").alias("drop"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("long")


def dedup_lines(spark: SparkSession, docs: DataFrame, *, min_chars: int = 10, digests: bool = False) -> DataFrame:
    """docs with repeated lines taken out of text, and n_lines, n_dropped; with ``digests`` kept_sha256 in place of text.

    A key that at least two documents hold loses all its lines but those in
    the smallest doc_id that holds it.
    """
    index = LineIndex.of(spark, docs, min_chars=min_chars)
    scratch = Scratch(spark)
    drop = scratch.write(index.own_to_drop(), "drops")
    scratch.drop(index.postings, index.counts, index.filters)  # the result reads the drops alone
    given = docs.columns
    doc, gone, sha, n_lines, n_dropped = (fresh(c, given) for c in ("doc", "drop", "sha", "n_lines", "n_dropped"))
    rest = ["doc_id"] if digests else [c for c in given if c.lower() not in ("text", "n_lines", "n_dropped", "kept_sha256")]
    drop = drop.select(F.col("doc_id").alias(doc), F.col("drop").alias(gone))
    joined = docs.select(*rest, "text").join(drop, F.col("doc_id").cast("long") == F.col(doc), "left").drop(doc)
    kinds = {f.name: f for f in docs.schema}
    own = [T.StructField("text", T.StringType()), T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())]
    schema = T.StructType([*(kinds[c] for c in rest), *own, *([T.StructField(sha, T.StringType())] if digests else [])])
    out = map_arrow(joined, schema, _dropped, min_chars, "text", gone, sha if digests else None, n_lines, n_dropped)
    last = F.col(sha).alias("kept_sha256") if digests else F.col("text")
    return out.select(*rest, F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"), last)
