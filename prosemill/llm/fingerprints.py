"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, the phrases' names into phrases again,
three times.  On each level runs of an equal symbol become one symbol; then
deterministic coin tossing labels every symbol by the lowest bit in which it
differs from its left neighbour (the bit's place and value), and the labels
likewise, until six labels are left.  Local maxima of the labels start phrases,
so where a phrase starts depends on a few neighbours alone, and equal
substrings get equal phrases but near their ends, whatever their offset.  A
phrase's name is a hash of its symbols.

The fingerprint keeps, for each of 64 equal parts of the names' range, the
smallest name of levels two and three in it: two fingerprints' share of equal
parts among those that either has estimates the share of common phrases.

``fingerprint_pairs`` also holds each document against its successor in
descending order of doc_id.  Documents are dealt by ranges of doc_id, and each
range is sent the first document of the next one as well; so one shuffle of the
texts does, and no order over all rows is made.

Defined results: null text is empty; empty texts have a fingerprint of their
own and are alike to each other (1) and to nothing else (0); rows that repeat a
doc_id follow each other in order of their texts; null doc_ids come last; a
single document is its own successor; extra columns are ignored; an empty
table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, mix64, pieces

LEVELS, PARTS = 3, 64
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACES = mix64(np.arange(1000, 1256, dtype=np.uint64)) | np.uint64(1)
_LOWEST = np.array([0] + [(x & -x).bit_length() - 1 for x in range(1, 256)], dtype=np.uint8)


def _tossed(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One coin toss on uint8 symbols: 2 * place + bit of the lowest bit that differs from the left."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[starts] = ~x[starts]
    place = _LOWEST[x ^ left]
    return (place << np.uint8(1)) | ((x >> place) & np.uint8(1))


def _tossed64(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[starts] = ~x[starts]
    d = x ^ left
    place = np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
    return ((place << np.uint64(1)) | ((x >> place) & np.uint64(1))).astype(np.uint8)


def parse(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of the given texts, laid end to end, and where each text starts among them.

    symbols: uint8 or uint64; starts: index of each text's first symbol; no text is empty.
    """
    new = np.empty(len(symbols), dtype=bool)
    new[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new[starts] = True
    at = np.flatnonzero(new)
    own = symbols[at]
    starts = np.searchsorted(at, starts)
    names = _BYTES[own] if own.dtype == np.uint8 else own
    if len(at) < len(symbols):
        run = np.diff(np.append(at, len(symbols)))
        long = np.flatnonzero(run > 1)
        names = names.copy()
        names[long] = mix64(names[long] + run[long].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    labels = _tossed(own, starts) if own.dtype == np.uint8 else _tossed64(own, starts)
    for _ in range(2 if own.dtype == np.uint8 else 3):
        labels = _tossed(labels, starts)
    top = np.zeros(len(labels), dtype=bool)
    if len(labels) > 2:
        top[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    top[starts] = True
    ends = starts[1:] - 1  # a text's last symbol has no right neighbour
    top[ends[ends > starts[:-1]]] = False
    first = np.flatnonzero(top)
    length = np.diff(np.append(first, len(labels)))
    place = np.arange(len(labels)) - np.repeat(first, length)
    sums = np.add.reduceat(names * _PLACES[place & 255], first)
    return mix64(sums + length.astype(np.uint64)), np.searchsorted(first, starts)


def fingerprints(texts: list[bytes]) -> list[str]:
    out = [""] * len(texts)
    full = [k for k, t in enumerate(texts) if t]
    if full:
        symbols = np.frombuffer(b"".join(texts[k] for k in full), dtype=np.uint8)
        starts = np.cumsum([0] + [len(texts[k]) for k in full[:-1]])
        low = np.full(len(full) * PARTS, np.uint64(2**64 - 1), dtype=np.uint64)
        for level in range(1, LEVELS + 1):
            symbols, starts = parse(symbols, starts)
            if level > 1:
                text = np.repeat(np.arange(len(full)), np.diff(np.append(starts, len(symbols))))
                names = mix64(symbols + np.uint64(level))
                np.minimum.at(low, text * PARTS + (names >> np.uint64(58)).astype(np.int64), names << np.uint64(6))
        short = (mix64(low) % np.uint64(0xFFFF)).astype(">u2")
        short[low == np.uint64(2**64 - 1)] = 0xFFFF
        raw = short.reshape(len(full), PARTS)
        for k, row in zip(full, raw, strict=True):
            out[k] = row.tobytes().hex()
    return out


def likeness(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(s), dtype=">u2") for s in (a, b))
    have = (x != 0xFFFF) | (y != 0xFFFF)
    return float(((x == y) & have).sum() / have.sum())


def edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _pairs(batches):
    """Rows of a range in order, the guest from the next range last: each with its successor."""
    first = last = None  # (range, role, doc_id, text, fingerprint)

    def rows(pairs):
        changed = [edited(a[3], b[3]).encode("utf-8", "surrogatepass") for a, b in pairs]
        prints = fingerprints(changed)
        return {
            "doc_id": [a[2] for a, _ in pairs],
            "n_chars": [len(a[3]) for a, _ in pairs],
            "edited_sha256": [hashlib.sha256(x).hexdigest() for x in changed],
            "fingerprint": [a[4] for a, _ in pairs],
            "edited_fingerprint": prints,
            "near_edited": [likeness(a[4], p) for (a, _), p in zip(pairs, prints, strict=True)],
            "near_next": [likeness(a[4], b[4]) for a, b in pairs],
        }

    for b in batches:
        for i, j in pieces(b, "text", 1 << 20):
            texts = [t or "" for t in b.column("text")[i:j].to_pylist()]
            own = fingerprints([t.encode("utf-8", "surrogatepass") for t in texts])
            pairs = []
            for row in zip(*(b.column(c)[i:j].to_pylist() for c in ("part", "guest", "doc_id")), texts, own, strict=True):
                if first is None or row[0] != first[0]:
                    if last is not None and not last[1]:
                        pairs.append((last, first))  # the only range: its last row is followed by its first
                    first = last = row
                    continue
                if last[1]:
                    continue  # further guests of the same doc_id
                pairs.append((last, row))
                last = row
            yield rows(pairs)
    if last is not None and not last[1]:
        yield rows([(last, first)])


def fingerprint_pairs(spark: SparkSession, docs: DataFrame, *, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = docs.select("doc_id")
    ranges = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    share = [k / ranges for k in range(1, ranges)]
    bounds = sorted({int(x) for x in ids.where("doc_id is not null").approxQuantile("doc_id", share, 0.1 / ranges)}, reverse=True) if share else []
    part = _range_of(F.col("doc_id"), bounds)
    tops = {r["part"]: r["top"] for r in ids.groupBy(part.alias("part")).agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    # the first document of each range is a guest in the range before it
    guests = [(tops[b], a) for a, b in zip(order, order[1:] + order[:1], strict=True) if a != b and tops[b] is not None]
    host = spark.createDataFrame(guests, "_top long, _host int")
    seats = F.array(F.struct(part.alias("part"), F.lit(False).alias("guest")))
    more = F.when(F.col("_host").isNotNull(), F.array(F.struct(F.col("_host").alias("part"), F.lit(True).alias("guest")))).otherwise(F.array().cast("array<struct<part:int,guest:boolean>>"))
    seated = docs.join(F.broadcast(host), F.col("doc_id") == F.col("_top"), "left").select("doc_id", "text", F.explode(F.concat(seats, more)).alias("s")).select("s.part", "s.guest", "doc_id", "text")
    # range numbers are partition numbers: hashes of so few would meet in some partitions and leave others empty
    dealt = seated.repartitionById(max(1, max(order, default=0) + 1), "part").sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), "text")
    return map_arrow(dealt, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", _pairs)


def _range_of(x, bounds: list[int]):
    """The number of bounds above x, found among every s-th bound first and then among s: null comes last."""
    if not bounds:
        return F.lit(0)
    s = int(np.ceil(np.sqrt(len(bounds))))
    above = lambda arr: F.size(F.filter(arr, lambda b: b > x))
    coarse = F.array(*(F.lit(b) for b in bounds[s - 1 :: s]))
    fine = F.slice(F.array(*(F.lit(b) for b in bounds)), above(coarse) * s + 1, F.lit(s))
    return F.when(x.isNull(), F.lit(len(bounds))).otherwise(above(coarse) * s + above(fine)).cast("int")
