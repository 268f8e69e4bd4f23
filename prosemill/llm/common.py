"""What the operators share: tables in the shared folder, Arrow kernels, components of a link graph."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_own: dict[str, str] = {}
#: Paths of tables that are still there, by the order in which they were made.
_made: list[str] = []
#: Rows of an Arrow batch at most: beside a full JVM heap a worker holds one batch on its way in and one on its way out.
BATCH_ROWS = 2_000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir; where that is unset in local mode, a new folder."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="prosemill-"))


def own_dir(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{shared_dir(spark).rstrip('/')}/prosemill/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def tables_made() -> list[str]:
    """Paths of the tables that operators have made and not removed."""
    return list(_made)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column is called so."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor costs the running step only.

    The shuffle files of a step are removed when its table is written, and
    ``drop`` removes tables that no later step reads, so disk use stays near
    that of the largest step.
    """

    CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        before = self.spark.conf.get(self.CLEAN, "false")
        self.spark.conf.set(self.CLEAN, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(self.CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, t.scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _made[:] = [x for x in _made if x != path]


def sweep(spark: SparkSession) -> None:
    """Removes all tables that this application's operators have left; results that read them end with it."""
    remove(spark, own_dir(spark))
    _made.clear()


#: Keys with more than one of so many parts of all rows are hot: there are at most so many of them.
HOT_PARTS, HOT_ROWS = 100_000, 1_000


def join_hot(rows: DataFrame, lookup: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with lookup(key, many, ...), one row a key, where ``many`` is the number of rows that have the key.

    Hot keys, HOT_PARTS of them at most, are broadcast, so their rows stay where
    they are; the others are dealt by key.  ``rows`` is read twice.
    """
    least = max(HOT_ROWS, total // HOT_PARTS)
    hot, cold = lookup.where(F.col("many") > least).drop("many"), lookup.where(F.col("many") <= least).drop("many")
    here = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return here.unionByName(rest)


def map_arrow(df: DataFrame, schema: str | T.StructType, kernel: Callable[..., Iterator[dict]], *args) -> DataFrame:
    """``kernel(batches, *args)`` gets an iterator of record batches and yields dicts of columns."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_CONF)) <= BATCH_ROWS:
        conf.set(BATCH_CONF, str(BATCH_ROWS))
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    fields = to_arrow_schema(out)

    def run(batches):
        try:
            for columns in kernel(batches, *args):
                arrays = [c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, f.type) for f in fields]
                yield pa.RecordBatch.from_arrays(arrays, schema=fields)
        finally:
            give_back()

    return df.mapInArrow(run, out)


def give_back() -> None:
    """Returns freed memory to the system: workers are kept between stages, beside a JVM that needs it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch, each of about ``most`` bytes of ``column`` or one row."""
    col = batch.column(column)
    if len(col) == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0))
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(col):
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield at, to
        at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest node that it reaches over the given edges."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _forest_kernel(batches):
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    for b in batches:
        u, v = forest(np.concatenate([u, b.column("u").to_numpy(zero_copy_only=False)]), np.concatenate([v, b.column("v").to_numpy(zero_copy_only=False)]))
        if len(u) > 2_000_000:
            yield {"u": u, "v": v}
            u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(u):
        yield {"u": u, "v": v}


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; component is the smallest node it reaches.

    Alternating large-star and small-star steps over distinct edges, each an
    aggregate and a join by node; each round is written to the shared folder.
    Partitions first replace their edges by a spanning forest.
    """
    scratch = Scratch(spark)
    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    e = scratch.write(map_arrow(e, "u long, v long", _forest_kernel).distinct(), "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every edge now goes from the larger to the smaller node
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = scratch.write(small, "edges")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        scratch.drop(e)
        e = new
        if state == seen or state[0] == state[2] and not _chained(e):
            break
        seen = state
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _chained(e: DataFrame) -> bool:
    """Whether a node is both an end and a start of edges."""
    return not e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
