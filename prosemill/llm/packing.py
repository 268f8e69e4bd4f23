"""Best-fit packing of token pieces, improved by swaps between underfull bins.

A document's ids are its tokens and one end id.  A document longer than the
capacity is cut into pieces of the capacity, the remainder first.  How full a
bin gets depends on piece lengths alone, so the plan is made from the number
of pieces of each length: ``capacity`` numbers, whatever the corpus holds.
Bins of the same make-up are one *pattern* with a multiplicity.

1. Best-fit decreasing over lengths gives the first patterns.
2. Local search: moves, one-for-one and two-for-one exchanges between two
   underfull patterns, applied to as many of their bins as both have, each
   raising the sum of squared fills, until bins run empty or no pair of
   patterns has an exchange that helps.
3. Pieces get their rank among those of equal length (counts of each written
   chunk, summed in order) and with it a sequence and an offset.

Defined results: null text is empty text (one piece, the end id alone); rows
that repeat a doc_id are packed one by one; null doc_ids stay null; extra
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, pieces
from .tokens import Source, public_path

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, nth long"


def _cut(batches, source, end_id, capacity, ids_kept):
    from pyspark import TaskContext

    enc = source.encoder()
    chunk = TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, dtype=np.int64)
    for b in batches:
        for i, j in pieces(b, "text"):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "nth", "ids")}
            texts = [t or "" for t in b.column("text")[i:j].to_pylist()]
            for doc, ids in zip(b.column("doc_id")[i:j].to_pylist(), enc.ids(texts), strict=True):
                raw = np.append(ids, np.uint32(end_id)).astype("<u4")
                at, k = 0, 0
                while at < len(raw):
                    to = min(len(raw), at + ((len(raw) - at) % capacity or capacity))
                    part = raw[at:to]
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(at)
                    out["length"].append(to - at)
                    out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    out["nth"].append(int(seen[to - at]))
                    out["ids"].append(part.tolist() if ids_kept else None)
                    seen[to - at] += 1
                    at, k = to, k + 1
            yield out | {"chunk": [chunk] * len(out["nth"])}


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Patterns (lengths, longest first) and how many bins have each, by best-fit decreasing."""
    done: Counter = Counter()
    room: dict[int, dict[tuple, int]] = {}
    rooms: list[int] = []

    def put(pattern: tuple, n: int) -> None:
        left = capacity - sum(pattern)
        if left == 0:
            done[pattern] += n
            return
        if left not in room:
            room[left] = {}
            bisect.insort(rooms, left)
        room[left][pattern] = room[left].get(pattern, 0) + n

    for length in sorted((x for x in counts if counts[x] > 0), reverse=True):
        left = counts[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    put((length,) * each, full)
                if rest:
                    put((length,) * rest, 1)
                break
            at = rooms[k]
            pattern, n = next(iter(room[at].items()))
            each = min(at // length, left)
            take = min(n, left // each)
            put_back = n - take
            del room[at][pattern]
            if put_back:
                room[at][pattern] = put_back
            if not room[at]:
                del room[at]
                rooms.pop(k)
            put(tuple(sorted(pattern + (length,) * each, reverse=True)), take)
            left -= take * each
    for by in room.values():
        done.update(by)
    return done


def _better(a: tuple, b: tuple, capacity: int) -> tuple[tuple, tuple] | None:
    """The exchange from the emptier bin a into the fuller bin b that raises squared fill most."""
    fa, fb = sum(a), sum(b)
    slack = capacity - fb
    best, found = 0, None
    sa, sb = sorted(set(a)), sorted(set(b))
    two = sorted({x + y: (x, y) for k, x in enumerate(a) for y in a[k + 1 :]}.items())
    sums = [s for s, _ in two]

    def tried(give: tuple, take: tuple) -> None:
        nonlocal best, found
        d = sum(give) - sum(take)
        if 0 < d <= slack and (fb + d) ** 2 + (fa - d) ** 2 - fb**2 - fa**2 > best:
            best, found = (fb + d) ** 2 + (fa - d) ** 2 - fb**2 - fa**2, (give, take)

    k = bisect.bisect_right(sa, slack) - 1
    if k >= 0:
        tried((sa[k],), ())  # move
    for y in sb:
        k = bisect.bisect_right(sa, y + slack) - 1
        if k >= 0:
            tried((sa[k],), (y,))  # one for one
        k = bisect.bisect_right(sums, y + slack) - 1
        if k >= 0:
            tried(two[k][1], (y,))  # two for one
    return found


def _changed(p: tuple, out: tuple, new: tuple) -> tuple:
    left = list(p)
    for x in out:
        left.remove(x)
    return tuple(sorted([*left, *new], reverse=True))


def swap_search(bins: Counter, capacity: int) -> Counter:
    """Local search over patterns until no pair of underfull ones has an exchange that helps.

    Patterns wait in a queue, the emptiest first.  The one in turn is paired
    with every underfull pattern; a pattern that an exchange makes, or of which
    a second bin comes up, joins the queue, so every pair of the patterns that
    are left has been tried.  It ends because squared fill rises with each exchange.
    """
    bins = Counter({p: n for p, n in bins.items() if p and n})
    queue = [(sum(p), p) for p in bins if sum(p) < capacity]
    heapq.heapify(queue)
    under = sorted(queue)

    def exchange(a: tuple, b: tuple, found: tuple[tuple, tuple]) -> None:
        give, take = found
        n = bins[a] // 2 if a == b else min(bins[a], bins[b])
        new = _changed(a, give, take), _changed(b, take, give)
        for p in (a, b):
            bins[p] -= n
        for p in {a, b}:
            if not bins[p]:
                del bins[p]
                under.pop(bisect.bisect_left(under, (sum(p), p)))
        for p in filter(None, new):
            had = bins[p]
            bins[p] = had + n
            if sum(p) < capacity and had < 2:
                if not had:
                    bisect.insort(under, (sum(p), p))
                heapq.heappush(queue, (sum(p), p))

    while queue:
        fill, a = heapq.heappop(queue)
        found = True
        while found and bins.get(a):
            found = None
            for other, b in reversed(under):
                if a == b and bins[a] < 2:
                    continue
                low, high = (a, b) if (fill, a) <= (other, b) else (b, a)
                if found := _better(low, high, capacity):
                    exchange(low, high, found)
                    break
    return bins


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, first sequence, pieces a bin, first offset) that place every rank."""
    bins = swap_search(best_fit(counts, capacity), capacity)
    rows, used, sequence = [], Counter(), 0
    for pattern, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length, each in sorted(Counter(pattern).items(), reverse=True):
            rows.append((length, used[length], n * each, sequence, each, offset))
            used[length] += n * each
            offset += length * each
        sequence += n
    assert used == Counter({k: v for k, v in counts.items() if v}), "a piece has no place"
    return rows


def pack(spark: SparkSession, docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 2, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if kept) for every piece."""
    source = Source(spark, tokenizer or public_path("byte_bpe_50k.json"))
    scratch = Scratch(spark)
    schema = PIECE_SCHEMA + (", ids array<long>" if keep_ids else "")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    cut = scratch.write(map_arrow(own, schema, _cut, source, end_id, capacity, keep_ids), "pieces")
    by_chunk = cut.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    before = by_chunk.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("chunk", "length", F.coalesce("before", F.lit(0)).alias("before"))
    # at most `capacity` rows reach the driver
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan(counts, capacity)
    places = spark.createDataFrame(rows, "length long, rank0 long, ranks long, seq0 long, each long, offset0 long")
    ranked = cut.join(before, ["chunk", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    placed = ranked.join(F.broadcast(places) if len(rows) <= 200_000 else places, "length").where("rank >= rank0 and rank < rank0 + ranks")
    nth = F.col("rank") - F.col("rank0")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("seq0") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("offset0") + F.pmod(nth, F.col("each")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if keep_ids else []),
    )
