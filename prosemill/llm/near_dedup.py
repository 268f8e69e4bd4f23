"""Near-duplicate documents by min-max hashing of five-word shingles.

Each permutation of the shingle hashes gives two signature values, its minimum
and its maximum, so 64 permutations make 128 values; both match between two
documents with a probability equal to their similarity.  32 bands of four
values from four different permutations find candidates: a pair of similarity
0.75 misses all of them with probability (1 - 0.75^4)^32, about 5e-6.

Every link that counts is confirmed on the full sets:

1. Documents of equal sets are one class, which bears a number of its own and
   is compared by one of its texts.
2. Within a bucket (equal band), each member is confirmed against the bucket's
   smallest member: as many pairs as members, not their square.  Confirmed
   links give components.
3. A link that step 2 didn't try lies inside a bucket.  Where all members of a
   bucket are in one component it changes nothing.  In the other buckets the
   members outside the largest component are compared with all members of
   other components, in blocks: by size, by the signatures' estimate (at 0.55 a
   pair of 0.75 is five standard deviations away), and then on the full sets,
   by matrix products.  Pairs stay inside the task; links leave it as a forest.

Defined results: null or wordless text has an empty set and links with
nothing; with fewer words than a shingle the whole sequence is the one
shingle; rows that repeat a doc_id each get a row with the size of its own set,
and the doc_id's links are those of any of them, so its texts are in one
component; a null doc_id links with nothing; extra columns are ignored; an
empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, forest, join_hot, map_arrow, mix64, pieces

PERMUTATIONS, BANDS, ROWS = 64, 32, 4
#: Members of a bucket that one task compares with each other at a time.
BLOCK = 256
#: Members that one task confirms against a group's first member.
CHUNK = 256


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, k: int, words: dict[bytes, int]) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes; 0x20 and 0x09 to 0x0D part words, A-Z are lower-cased."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    n = min(k, len(h))
    total = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(total)


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def band_columns() -> np.ndarray:
    """The four signature columns of each band, of four different permutations: two minima and two maxima."""
    p = np.arange(BANDS)
    lo, hi = [p, p + BANDS], [(p + BANDS // 2) % PERMUTATIONS, (p + BANDS // 2 + BANDS) % PERMUTATIONS]
    return np.stack([*lo, *(PERMUTATIONS + x for x in hi)], axis=1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima and maxima under every permutation, a row for each set (none may be empty)."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), 2 * PERMUTATIONS), dtype=np.uint32)
    for p, (a, b) in enumerate(zip(*_factors(), strict=True)):
        v = ((flat * a + b) >> np.uint64(32)).astype(np.uint32)
        out[:, p] = np.minimum.reduceat(v, starts)
        out[:, p + PERMUTATIONS] = np.maximum.reduceat(v, starts)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    cols = band_columns()
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, cols[:, r]].astype(np.uint64))
    return keys.view(np.int64)


def _sketch(batches, k):
    words = _Words()
    for b in batches:
        for i, j in pieces(b, "text", 1 << 19):
            if len(words) > 500_000:
                words.clear()
            sets = [shingle_set(t, k, words) for t in b.column("text")[i:j].to_pylist()]
            full = [s for s in sets if len(s)]
            keys, small = [None] * len(sets), [None] * len(sets)
            if full:
                sig = signatures(full)
                at = [n for n, s in enumerate(sets) if len(s)]
                for n, row, band in zip(at, (sig & 0xFF).astype(np.uint8), band_keys(sig), strict=True):
                    keys[n], small[n] = band, row.tobytes()
            yield {
                "doc_id": b.column("doc_id")[i:j],
                "mark": b.column("mark")[i:j],
                "n_shingles": [len(s) for s in sets],
                "digest": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "sig": small,
                "bands": keys,
            }


def _confirm(batches, k, least, of):
    """Rows of a group in order, its first member first: yields the members whose sets reach the similarity."""
    words, group, first, first_id = _Words(), None, None, None
    for b in batches:
        for i, j in pieces(b, "text", 1 << 20):
            if len(words) > 500_000:
                words.clear()
            us, vs = [], []
            cols = (b.column(c)[i:j].to_pylist() for c in ("g", "salt", "role", "id", "text"))
            for g, salt, role, doc, text in zip(*cols, strict=True):
                if role == 0:
                    if group != (g, salt):
                        group, first, first_id = (g, salt), shingle_set(text, k, words), doc
                    continue
                if group != (g, salt):
                    continue
                s = shingle_set(text, k, words)
                lo, hi = sorted((len(s), len(first)))
                if lo * of < least * hi:
                    continue
                spot = np.minimum(np.searchsorted(first, s), len(first) - 1)
                both = int((first[spot] == s).sum())
                if of * both >= least * (len(s) + len(first) - both):
                    us.append(doc)
                    vs.append(first_id)
            yield {"u": us, "v": vs}


def confirm(texts: DataFrame, pairs: DataFrame, k: int, least: int, of: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach least/of; each v's set is made once for every CHUNK of its partners."""
    salts = pairs.groupBy("v").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("salts"))
    member = pairs.join(salts, "v").select(F.col("v").alias("g"), F.pmod(F.xxhash64("u"), "salts").cast("int").alias("salt"), F.lit(1).alias("role"), F.col("u").alias("id"))
    head = salts.select(F.col("v").alias("g"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("v").alias("id"))
    rows = member.unionByName(head).join(texts.select(F.col("node").alias("id"), "text"), "id")
    dealt = rows.repartition("g", "salt").sortWithinPartitions("g", "salt", "role", "id")
    return map_arrow(dealt.select("g", "salt", "role", "id", "text"), "u long, v long", _confirm, k, least, of)


def _candidates(rows: list[dict], least: int, of: int) -> tuple[list[dict], list[dict], np.ndarray, np.ndarray]:
    """The two sides of a block pair, and the pairs across components that may reach the similarity.

    A pair counts in the first bucket that both share, so it is confirmed once.
    """
    head = rows[0]
    a = [r for r in rows if r["side"] == 0]
    c = a if head["t"] == 1 and head["r"] == head["j"] else [r for r in rows if r["side"] == 1]
    none = np.empty(0, np.int64)
    if not a or not c:
        return a, c, none, none
    x, y = ({k: np.array([r[k] for r in side], dtype=np.int64) for k in ("doc", "comp", "n")} for side in (a, c))
    sx, sy = (np.frombuffer(b"".join(r["sig"] for r in side), np.uint8).reshape(len(side), -1) for side in (a, c))
    ok = x["comp"][:, None] != y["comp"][None, :]
    ok &= np.minimum(x["n"][:, None], y["n"][None, :]) * of >= least * np.maximum(x["n"][:, None], y["n"][None, :])
    centre = head["centre"]
    ok &= (x["doc"] != centre)[:, None] & (y["doc"] != centre)[None, :]
    if a is c:
        ok = np.triu(ok, 1)
    u, v = np.nonzero(ok)
    parts = [none], [none]
    for i in range(0, len(u), 1 << 14):
        p, q = u[i : i + (1 << 14)], v[i : i + (1 << 14)]
        near = (sx[p] == sy[q]).mean(1) >= least / of - 0.2
        parts[0].append(p[near])
        parts[1].append(q[near])
    u, v = np.concatenate(parts[0]), np.concatenate(parts[1])
    if len(u):
        bx, by = (np.array([r["bands"] for r in side], dtype=np.int64) for side in (a, c))
        this = int(np.flatnonzero(bx[0] == head["key"])[0])
        first = np.concatenate([np.argmax(bx[u[i : i + 4096]] == by[v[i : i + 4096]], axis=1) for i in range(0, len(u), 4096)])
        u, v = u[first == this], v[first == this]
    return a, c, u, v


def _block_pairs(batches):
    """Sorted rows of each (bucket, block pair)."""
    held: list[dict] = []
    last = None
    for b in batches:
        for i, j in pieces(b, "sig" if "text" not in b.schema.names else "text", 1 << 20):
            for row in b.slice(i, j - i).to_pylist():
                key = (row["key"], row["t"], row["r"], row["j"])
                if key != last:
                    if held:
                        yield held
                    held, last = [], key
                held.append(row)
    if held:
        yield held


def _in_question(batches, least, of):
    """The rows of each block pair that a candidate pair needs."""
    for rows in _block_pairs(batches):
        a, c, u, v = _candidates(rows, least, of)
        if len(u):
            need = [a[k] for k in np.unique(u)] + [c[k] for k in np.unique(v)]
            need = list({(r["doc"], r["side"]): r for r in need}.values())
            yield {k: [r[k] for r in need] for k in rows[0]}


def _common_sizes(x: list[np.ndarray], y: list[np.ndarray], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of x[u] and y[v]."""
    if len(u) < 16 * (len(x) + len(y)):
        return np.array([len(np.intersect1d(x[p], y[q], assume_unique=True)) for p, q in zip(u, v, strict=True)], dtype=np.int64)
    flat = np.concatenate([*x, *y])
    shingle, spot, many = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    keep = many[spot] > 1
    number = np.cumsum(many > 1) - 1
    row, col = row[keep], number[spot[keep]]
    total = np.zeros((len(x), len(y)), dtype=np.float64)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for c in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        own = slice(np.searchsorted(col, c), np.searchsorted(col, c + 4096))
        m = np.zeros((len(x) + len(y), 4096), dtype=np.float32)
        m[row[own], col[own] - c] = 1
        total += m[: len(x)] @ m[len(x) :].T
    return total[u, v].astype(np.int64)


def _confirm_blocks(batches, k, least, of):
    """The links of each block pair, as a spanning forest: pairs stay inside the task."""
    words = _Words()
    for rows in _block_pairs(batches):
        if len(words) > 500_000:
            words.clear()
        a, c, u, v = _candidates(rows, least, of)
        if not len(u):
            continue
        x = [shingle_set(r["text"], k, words) for r in a]
        y = x if a is c else [shingle_set(r["text"], k, words) for r in c]
        both = _common_sizes(x, y, u, v)
        sizes = np.array([len(s) for s in x])[u] + np.array([len(s) for s in y])[v]
        hit = of * both >= least * (sizes - both)
        if hit.any():
            fu, fv = forest(np.array([r["doc"] for r in a])[u[hit]], np.array([r["doc"] for r in c])[v[hit]])
            yield {"u": fu, "v": fv}


def _spread(members: DataFrame) -> DataFrame:
    """Each member of a bucket of several components, once for each pair of blocks that it is in.

    Members of the bucket's largest component (t = 0, side 1) meet only members
    of the others; those meet each other as well (t = 1).
    """
    main = F.col("comp") == F.col("main")
    block = F.pmod(F.xxhash64("doc"), F.when(main, F.col("mains")).otherwise(F.col("rests"))).cast("int")
    members = members.withColumn("block", block)

    def place(r, t, j, side):
        return F.struct(r.cast("int").alias("r"), F.lit(t).alias("t"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    own = F.col("block")
    rests, mains = F.sequence(F.lit(0), F.col("rests") - 1), F.sequence(F.lit(0), F.col("mains") - 1)
    of_main = F.transform(rests, lambda r: place(r, 0, own, F.lit(1)))
    of_rest = F.concat(
        F.transform(mains, lambda j: place(own, 0, j, F.lit(0))),
        F.transform(rests, lambda o: place(F.least(own, o), 1, F.greatest(own, o), (own > o))),
    )
    places = members.withColumn("p", F.explode(F.when(main, of_main).otherwise(of_rest)))
    return places.select("key", "p.t", "p.r", "p.j", "p.side", "doc", "comp", "centre")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "t", "r", "j").sortWithinPartitions("key", "t", "r", "j", "side", "doc")


def near_duplicates(spark: SparkSession, docs: DataFrame, *, k: int = 5, least: int = 75, of: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked where of * intersection >= least * union."""
    scratch = Scratch(spark)
    # the mark tells the texts of a repeated doc_id apart
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    sketch = scratch.write(map_arrow(docs, "doc_id long, mark long, n_shingles long, digest binary, sig binary, bands array<long>", _sketch, k), "sketches")
    able = sketch.where("digest is not null and doc_id is not null")
    one = F.min(F.struct("doc_id", "mark")).alias("one")
    classes = able.groupBy("digest").agg(one, F.count("*").alias("many"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    # numbers are made once, by the written table
    classes = scratch.write(classes.select(F.monotonically_increasing_id().alias("node"), "digest", "many", F.col("one.doc_id").alias("rep"), F.col("one.mark").alias("mark"), "n", "sig", "bands"), "classes")
    bands = classes.select(F.col("node").alias("doc"), F.explode("bands").alias("key"))
    centres = bands.groupBy("key").agg(F.min("doc").alias("centre"), F.max("doc").alias("last")).where("centre < last")
    member = scratch.write(bands.join(centres, "key").select("key", "doc", "centre"), "buckets")
    asked_for = classes.join(member.select(F.col("doc").alias("node")).distinct(), "node", "left_semi").select("node", F.col("rep").alias("doc_id"), "mark")
    texts = scratch.write(docs.join(asked_for, ["doc_id", "mark"]).select("node", "text"), "texts")
    star = member.where("doc <> centre").select(F.col("doc").alias("u"), F.col("centre").alias("v")).distinct()
    links = scratch.write(confirm(texts, star, k, least, of), "links")
    comps = scratch.write(components(spark, links), "components")

    inner = member.join(comps.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", "centre", F.coalesce("component", "doc").alias("comp"))
    sizes = inner.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("members"), F.count("*").alias("comps")).where("comps > 1 and members > 2")
    mixed = mixed.select("key", F.col("top.comp").alias("main"), F.ceil(F.col("top.c") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("members") - F.col("top.c")) / BLOCK).cast("int").alias("rests"))
    info = classes.select(F.col("node").alias("doc"), "n", "sig", "bands")
    rows = _spread(inner.join(mixed, "key")).join(info, "doc")
    asked = map_arrow(_dealt(rows), rows.schema, _in_question, least, of)
    asked = scratch.write(asked, "asked")
    edges = [scratch.write(_same_document(able, classes), "repeats")]
    if not asked.isEmpty():
        # rows that repeat both doc_id and text bring a text twice
        full = asked.join(texts.dropDuplicates(["node"]).withColumnRenamed("node", "doc"), "doc")
        edges.append(scratch.write(map_arrow(_dealt(full), "u long, v long", _confirm_blocks, k, least, of), "links"))
    if not all(e.isEmpty() for e in edges):
        comps = scratch.write(components(spark, reduce(DataFrame.unionByName, edges, links)), "components")

    named = classes.select("node", "digest", "rep", "many").join(comps, "node")
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = scratch.write(named.join(smallest, "component").select("digest", "many", "component_id"), "linked")
    single = classes.where("many > 1").join(linked, "digest", "left_anti").select("digest", "many", F.col("rep").alias("component_id"))
    ids = able.select("doc_id", "digest")
    far = join_hot(ids, linked.unionByName(single), "digest", sketch.count()).where("doc_id <> component_id").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    far = scratch.write(far, "components")
    scratch.drop(member, texts, links, asked, classes, linked, *edges)  # the result reads none of them

    out = sketch.select("doc_id", "n_shingles").join(far, "doc_id", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def _same_document(able: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the classes of a doc_id whose rows have several texts."""
    rows = able.select("doc_id", "digest")
    ids = rows.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    nodes = rows.join(ids, "doc_id", "left_semi").distinct().join(classes.select("digest", "node"), "digest").select("doc_id", "node")
    first = nodes.groupBy("doc_id").agg(F.min("node").alias("v"))
    return nodes.join(first, "doc_id").where("node <> v").select(F.col("node").alias("u"), "v").distinct()
