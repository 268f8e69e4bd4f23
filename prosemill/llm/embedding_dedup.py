"""Embedding near-dedup through a pivot-permutation index.

A bounded sample of vectors, spread apart, serves as reference points (pivots).
Each vector is described by its ``prefix`` nearest pivots in order of nearness,
and listed under each of them (and its label): the inverted pivot lists.  Two
vectors of a list are candidates if their descriptions share at least
``shared`` pivots; a pair counts in the list of the first pivot that it shares,
so once.  Candidates are verified by cosine in double precision.

Lists are compared in blocks, so no task holds a whole list, and tasks return
link counts and a spanning forest in place of the pairs.  No list is cut short:
a list of all rows is compared whole, block by block.

Pivots nearer to each other than PIVOT_COSINE are not taken: in a dense group
of near copies a sample has many of its points, and the order of these would
part the group's members by chance.  So such a group has one pivot, which all
its members share, and their other pivots lie far off, where the members'
small distances hardly change the order.

The number of pivots follows the square root of the number of vectors, so lists
grow as slowly, up to PIVOT_BYTES of them; beyond that (about 4e9 vectors of 64
components) lists grow with the table.  Every vector is indexed; the sample
only names pivots.

Equal vectors of a label are one class, whose members link with each other
without being paired.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and vectors with a null label, link with nothing; vectors of
different lengths link with nothing; rows that repeat a vec_id each get a row,
with the number of other vec_ids that any of its vectors links with, and the
vec_id's vectors are in one component; a null vec_id links with nothing; extra
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, components, forest, map_arrow

PREFIX, SHARED = 8, 2
#: Vectors of a list that one task compares with each other at a time, and rows of a block compared at once.
BLOCK, STRIP = 1024, 256
#: All pivots together take at most so many bytes (each executor gets them).
PIVOT_BYTES, LEAST_PIVOTS = 32 << 20, 64
#: Pivots of a larger cosine would part a dense group by chance.
PIVOT_COSINE = 0.7
#: Block counts of long lists are broadcast up to so many lists.
MOST_BROADCAST = 200_000


def _vectors(batches):
    """Rows of usable vectors, scaled to length 1, with a 128-bit digest of the direction."""
    for b in batches:
        out: dict[str, list] = {"vec_id": [], "label": [], "digest": [], "unit": []}
        for vec_id, label, x in zip(b.column("vec_id").to_pylist(), b.column("label").to_pylist(), b.column("embedding").to_pylist(), strict=True):
            unit = digest = None
            if vec_id is not None and label is not None and x and None not in x:
                v = np.asarray(x, dtype=np.float64)
                if np.isfinite(v).all() and np.any(v):
                    v = v / np.abs(v).max() + 0.0
                    unit, digest = (v / np.sqrt(v @ v)).tobytes(), xxhash.xxh3_128_digest(v.tobytes())
            out["vec_id"].append(vec_id)
            out["label"].append(label)
            out["digest"].append(digest)
            out["unit"].append(unit)
        yield out


def apart(sample: list[bytes]) -> dict[int, np.ndarray]:
    """By length, the vectors of the sample that aren't near an earlier one."""
    found: dict[int, np.ndarray] = {}
    for size in {len(x) for x in sample}:
        own = np.array([np.frombuffer(x) for x in sample if len(x) == size])
        free = np.ones(len(own), bool)
        for k in range(len(own)):
            if free[k]:
                free[k + 1 :] &= own[k + 1 :] @ own[k] < PIVOT_COSINE
        found[size // 8] = own[free]
    return found


def _describe(batches, pivots, prefix):
    """The nearest pivots of the vector's own length, nearest first; -1 alone where there is none."""
    pivots = pivots.value
    for b in batches:
        units = b.column("unit").to_pylist()
        near: list = [[-1]] * len(units)
        for n in {len(u) // 8 for u in units} & set(pivots):
            rows = [k for k, u in enumerate(units) if len(u) == 8 * n]
            far = -(np.frombuffer(b"".join(units[k] for k in rows)).reshape(-1, n) @ pivots[n].T)
            most = min(prefix, far.shape[1])
            some = np.argpartition(far, most - 1, axis=1)[:, :most]
            order = np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable")
            for k, t in zip(rows, np.take_along_axis(some, order, 1).tolist(), strict=True):
                near[k] = t
        yield {"node": b.column("node"), "label": b.column("label"), "weight": b.column("weight"), "several": b.column("several"), "dim": [len(u) // 8 for u in units], "near": near, "unit": b.column("unit")}


def _runs(batches, names, key):
    """Lists of rows of equal key columns, which come first in ``names``."""
    held: list = []
    last = None
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in names), strict=True):
            if row[:key] != last:
                if held:
                    yield last, held
                held, last = [], row[:key]
            held.append(row[key:])
    if held:
        yield last, held


def _spanned(u: np.ndarray, v: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of the edges, and each number's root in it."""
    root = np.arange(size)
    u, v = forest(u, v)
    root[u] = v
    return u, v, root


PAIR = ("label", "dim", "pivot", "i", "j")
FOREST, DEGREE, LINK = 0, 1, 2


def _verify(batches, least, shared):
    """Rows sorted by list and block pair: a forest of the links, linked weights, and links that touch a class of a repeated vec_id."""
    for (_, dim, pivot, i, j), rows in _runs(batches, (*PAIR, "block", "node", "weight", "several", "near", "unit"), len(PAIR)):
        block, nodes, weight = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(3))
        several = np.array([r[3] for r in rows], dtype=bool)
        a = np.flatnonzero(block == i)
        c = a if i == j else np.flatnonzero(block == j)
        if not len(a) or not len(c):
            continue
        x = np.frombuffer(b"".join(r[5] for r in rows)).reshape(len(rows), dim)
        many = np.array([len(r[4]) for r in rows])
        ids, flat = np.unique(np.concatenate([r[4] for r in rows]), return_inverse=True)
        listed = np.zeros((len(rows), len(ids)), dtype=np.float32)
        listed[np.repeat(np.arange(len(rows)), many), flat] = 1
        before = listed[:, ids < pivot]
        y, late, wide = x[c], before[c].T, listed[c].T
        few = np.minimum(many, shared)
        deg = np.zeros(len(rows), dtype=np.int64)
        u, v = np.empty(0, np.int64), np.empty(0, np.int64)
        pu, pv = [], []
        for k in range(0, len(a), STRIP):
            own = a[k : k + STRIP]
            ok = (listed[own] @ wide >= few[own][:, None]) & (before[own] @ late == 0)
            if i == j:
                ok &= c[None, :] > own[:, None]
            if 8 * np.count_nonzero(ok) > ok.size:
                ok &= x[own] @ y.T >= least
            else:
                p, q = np.nonzero(ok)
                ok[p, q] = np.einsum("nd,nd->n", x[own[p]], y[q]) >= least
            if not ok.any():
                continue
            deg[own] += ok @ weight[c]
            deg[c] += weight[own] @ ok
            row, col = ok.any(1), ok.any(0)
            # one link of each member first; of the others only those between parts that these leave
            u, v, root = _spanned(np.r_[u, own[row], own[ok.argmax(0)[col]]], np.r_[v, c[ok.argmax(1)[row]], c[col]], len(rows))
            p, q = np.nonzero(ok & (root[own][:, None] != root[c][None, :]))
            if len(p):
                u, v, _ = _spanned(np.r_[u, own[p]], np.r_[v, c[q]], len(rows))
            if several.any():
                p, q = np.nonzero(ok & (several[own][:, None] | several[c][None, :]))
                pu.append(own[p])
                pv.append(c[q])
        hit = np.flatnonzero(deg)
        if len(u):
            pu, pv = (np.concatenate([np.empty(0, np.int64), *z]) for z in (pu, pv))
            yield {
                "kind": np.repeat([FOREST, DEGREE, LINK], [len(u), len(hit), len(pu)]),
                "u": nodes[np.r_[u, hit, pu]],
                "v": nodes[np.r_[v, hit, pv]],
                "links": np.r_[np.zeros(len(u), np.int64), deg[hit], np.zeros(len(pu), np.int64)],
            }


def described(spark: SparkSession, units: DataFrame, pivots: int | None, prefix: int) -> DataFrame:
    """units(node, label, weight, several, unit) with dim and near, the nearest pivots in order."""
    size = units.agg(F.count("*").alias("n"), F.max(F.octet_length("unit")).alias("bytes")).first()
    most = max(LEAST_PIVOTS, PIVOT_BYTES // (size["bytes"] or 8))
    want = pivots or int(min(most, max(LEAST_PIVOTS, size["n"] ** 0.5)))
    sample = [bytes(r["unit"]) for r in units.orderBy(F.xxhash64("node", F.lit(7)), "node").select("unit").limit(want).collect()]
    chosen = spark.sparkContext.broadcast(apart(sample))
    return map_arrow(units, "node long, label long, weight long, several boolean, dim int, near array<int>, unit binary", _describe, chosen, prefix)


def _placed(vectors: DataFrame) -> DataFrame:
    """Each vector once for each list and each pair of blocks that it is in."""
    lists = vectors.select("label", "dim", F.explode("near").alias("pivot")).groupBy("label", "dim", "pivot").agg(F.count("*").alias("size"))
    long = lists.where(F.col("size") > BLOCK).select("label", "dim", "pivot", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    posted = vectors.withColumn("pivot", F.explode("near"))
    posted = posted.join(F.broadcast(long) if long.count() <= MOST_BROADCAST else long, ["label", "dim", "pivot"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    posted = posted.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    out = posted.select("label", "dim", "pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "weight", "several", "near", "unit")
    return out.repartition(*PAIR).sortWithinPartitions(*PAIR, "node")


def near_vectors(spark: SparkSession, table: DataFrame, *, least: float = 0.98, pivots: int | None = None, prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id, kept: vectors of one label linked where their cosine is at least ``least``."""
    scratch = Scratch(spark)
    own = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = scratch.write(map_arrow(own, "vec_id long, label long, digest binary, unit binary", _vectors), "vectors")
    able = rows.where("unit is not null")
    # numbers are made once, by the written table
    classes = able.groupBy("label", "digest").agg(F.first("unit").alias("unit")).select(F.monotonically_increasing_id().alias("node"), "label", "digest", "unit")
    classes = scratch.write(classes, "classes")
    members = able.select("vec_id", "label", "digest").distinct().join(classes.select("label", "digest", "node"), ["label", "digest"]).select("vec_id", "node")
    members = scratch.write(members.withColumn("several", F.count("*").over(Window.partitionBy("vec_id")) > 1), "members")
    weights = members.groupBy("node").agg(F.count_if(~F.col("several")).alias("weight"), F.max("several").alias("several"), F.min("vec_id").alias("rep"))
    units = scratch.write(classes.select("node", "label", "unit").join(weights, "node"), "units")
    vectors = scratch.write(described(spark, units.drop("rep"), pivots, prefix), "described")
    found = scratch.write(map_arrow(_placed(vectors), "kind int, u long, v long, links long", _verify, least, shared), "links")

    repeated = members.where("several")
    edges = found.where(F.col("kind") == FOREST).select("u", "v")
    again = not repeated.isEmpty()
    if again:
        first = repeated.groupBy("vec_id").agg(F.min("node").alias("v"))
        edges = edges.unionByName(repeated.join(first, "vec_id").where("node <> v").select(F.col("node").alias("u"), "v"))
    linked = found.where(F.col("kind") == DEGREE).groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    comp = components(spark, edges)
    named = units.select("node", "rep", "weight").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "component").join(linked, "node", "left").select("node", "component_id", (F.col("weight") + F.coalesce("links", F.lit(0))).alias("near"))
    near = members.join(named, "node").select("vec_id", "several", "node", "component_id", "near")
    if again:
        near = _with_repeated(found, units, repeated, near)
    ids = near.groupBy("vec_id").agg(F.min("component_id").alias("component_id"), F.max(F.col("near") - 1).alias("n_links"))
    out = rows.select("vec_id").join(ids, "vec_id", "left")
    of = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), of.alias("component_id"), F.coalesce(of == F.col("vec_id"), F.lit(True)).alias("kept"))


def _with_repeated(found: DataFrame, units: DataFrame, repeated: DataFrame, near: DataFrame) -> DataFrame:
    """near, with vec_ids of several vectors counted once each, and their own count over all their vectors."""
    pairs = found.where(F.col("kind") == LINK).select("u", "v")
    at = repeated.select("vec_id", "node")
    around = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).unionByName(at.select(F.col("node").alias("u"), F.col("node").alias("v"))).distinct()
    # classes of one vector: the repeated vec_ids in reach, each once
    seen = around.join(at.select(F.col("node").alias("v"), F.col("vec_id").alias("other")), "v").select("u", "other").distinct()
    more = seen.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("more"))
    single = near.where("not several").join(more, "node", "left").withColumn("near", F.col("near") + F.coalesce("more", F.lit(0))).select("vec_id", "component_id", "near")
    # repeated vec_ids: the classes in reach of any of its vectors, and the repeated vec_ids there, each once
    reach = at.select("vec_id", F.col("node").alias("u")).join(around, "u").select("vec_id", "v").distinct()
    plain = reach.join(units.select(F.col("node").alias("v"), "weight"), "v").groupBy("vec_id").agg(F.sum("weight").alias("near"))
    others = reach.join(at.select(F.col("node").alias("v"), F.col("vec_id").alias("other")), "v").select("vec_id", "other").distinct().groupBy("vec_id").agg(F.count("*").alias("more"))
    own = near.where("several").select("vec_id", "component_id").distinct()
    return single.unionByName(own.join(plain, "vec_id").join(others, "vec_id").select("vec_id", "component_id", (F.col("near") + F.col("more")).alias("near")))
