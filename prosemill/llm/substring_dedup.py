"""Exact substring dedup by bucket-pointer refinement of suffixes.

Each byte covered by a string of ``length`` bytes (a *window*) that also starts
in a document of smaller doc_id is removed.  What is needed for that is the
smallest doc_id of every class of equal windows.

The work is cut so that equal windows meet in one task, and few bytes move:

* Documents are packed into chunks of CHUNK_BYTES, which are written once and
  name themselves in all later exchanges.
* A window's *anchor* is its q-gram of smallest hash, the leftmost of equals:
  equal windows have equal anchors.  Consecutive windows of one anchor make a
  *fragment*, of some 65 bytes.
* Round 1: each chunk sends its distinct anchor hashes to shards by hash; a
  shard answers which of them other chunks have too, and which are hot.
* Round 2: each chunk sends its distinct fragments of anchors that at least two
  documents have, with their smallest doc_id.  A hot anchor's windows travel
  one by one under hashes of their own, so that no shard gathers all contexts
  of a common passage.  A shard takes equal fragments together, and sorts the
  suffixes of the others by bucket-pointer refinement: first buckets by their
  first 8 bytes, then each bucket with several members is refined by the bucket
  numbers of the positions 8, 16 and at last length - 32 further on, each
  round reusing the numbers that the round before has made.  The answer is one
  bit for each window of each fragment: whether a smaller document has it than
  any of this chunk's documents with the fragment.
* The chunks turn the answers into spans.

A chunk sends an anchor or fragment once, whatever the number of its documents
that hold it, so copies shrink before they are shuffled; fragments that it
takes together by name are compared byte by byte.  Anchors are the smallest of
many hashes, so they are hashed again before they are dealt to shards, which
makes shards alike in size.

Shards are numbered in ranges of hashes.  Up to FAN of them, a chunk sends each
its own message.  More shards make FAN buckets of them.  In round 1 a chunk
sends a message to each bucket; the messages of a bucket from PACK chunks or
fewer are put together and dealt to the bucket's shards.  In round 2, whose
messages are the bulk, a task puts those of SEND_PACK of its chunks or fewer
together before it sends them, so they move once.  The answers return by bucket.
So a chunk costs a bounded number of messages, and their number grows in
proportion to the chunks (up to FAN x SEND_PACK shards, some 13 GB of compressed
chunks; then with the ratio of shards to that).

Where most fragments have copies elsewhere, round 2 sends some 4 times the
input.  So it is asked in TURNS, each for a range of shards: the shuffles of one
go before the next begins.

Defined results: null text is empty; texts shorter than a window stay whole;
rows that repeat a doc_id don't remove each other's bytes, and each gets a row;
rows with a null doc_id neither lose bytes nor make others lose them; extra
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import hashlib
from itertools import groupby
from operator import itemgetter

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, mix64, pieces

GRAM = 16
CHUNK_BYTES = 5 << 20
SHARD_BYTES = 6 << 20
#: Bytes of fragments whose suffixes are sorted together.
SORT_BYTES = 1 << 20
#: Windows that are looked at together.
BLOCK = 1 << 18
#: Occurrences from which an anchor is hot.
HOT = 2_000
#: Messages that a chunk sends at most, and chunks whose messages to a bucket are put together at most.
FAN, PACK = 256, 4096
#: Chunks whose fragments a task holds at most to send them together, and turns of round 2.
SEND_PACK, TURNS = 16, 2
_LETTERS = mix64(np.arange(5000, 5256, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_POSITION = np.uint64((1 << 24) - 1)
_AGAIN = np.uint64(0x632BE59BD9B4E019)

CHUNKS = "chunk long, ids binary, sizes binary, data binary"
PARTS = "shard int, chunk long, data binary"


def _pack_chunks(batches, most):
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    ids, texts, held = [], [], 0

    def row():
        sizes = np.array([len(t) for t in texts], dtype="<i8")
        data = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        return {"chunk": [(part << 32) + seq], "ids": [np.array(ids, dtype="<i8").tobytes()], "sizes": [sizes.tobytes()], "data": [data]}

    for b in batches:
        for i, j in pieces(b, "text"):
            for doc, text in zip(b.column("doc_id")[i:j].to_pylist(), b.column("text")[i:j].to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if texts and held + len(raw) > most:
                    yield row()
                    seq, ids, texts, held = seq + 1, [], [], 0
                ids.append(doc)
                texts.append(raw)
                held += len(raw)
    if texts:
        yield row()


class Chunk:
    """A chunk's documents, and the fragments of their windows."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes, length: int):
        self.ids, self.sizes = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i8")
        self.text = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, int(self.sizes.sum()))), np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.length = length

    def fragments(self, whole: bool) -> dict[str, np.ndarray]:
        """anchor, start (first window), n (windows), doc (row in the chunk), and with ``whole`` name, a hash of the fragment."""
        out: dict[str, list] = {k: [] for k in ("anchor", "start", "n", "doc", "name")}
        last = max(0, len(self.text) - self.length + 1)
        self.windows = np.empty(last if whole else 0, dtype=np.uint64)
        for a in range(0, last, BLOCK):
            n = min(BLOCK, last - a)
            self._block(a, n, whole, out)
        kinds = {"anchor": np.uint64, "name": np.uint64}
        return {k: np.concatenate(v) if v else np.empty(0, kinds.get(k, np.int64)) for k, v in out.items()}

    def _block(self, a: int, n: int, whole: bool, out: dict[str, list]) -> None:
        h, size = _LETTERS[self.text[a : a + n + self.length - 1]], 1
        while size < GRAM:
            h = _joined(h, h, size, size)
            size *= 2
        grams = mix64(h)
        spots = len(grams)
        low = (grams & ~_POSITION) | np.arange(spots, dtype=np.uint64)
        span, want = 1, self.length - GRAM + 1
        while 2 * span <= want:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < want:
            low = np.minimum(low[:n], low[want - span : want - span + n])
        at = (low[:n] & _POSITION).astype(np.int64)
        doc = np.searchsorted(self.ends, np.arange(a, a + n), side="right")
        inside = np.arange(a, a + n) + self.length <= self.ends[doc]
        new = np.empty(n, dtype=bool)
        new[0] = True
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new & inside)
        if not len(first):
            return
        # a run ends where the next one starts or where windows stop fitting their document
        edge = np.flatnonzero(np.append(new | ~inside, True))
        stop = edge[np.searchsorted(edge, first, side="right")]
        out["anchor"].append(mix64(grams[at[first]] ^ _AGAIN))
        out["start"].append(first + a)
        out["n"].append(stop - first)
        out["doc"].append(doc[first])
        if whole:
            full = self._windows(a, n)
            self.windows[a : a + n] = full
            out["name"].append(mix64(full[first] * np.uint64(3) + mix64(full[stop - 1]) + (stop - first).astype(np.uint64)))

    def _windows(self, a: int, n: int) -> np.ndarray:
        """Hashes of the n windows from a on."""
        h, size, res, done = _LETTERS[self.text[a : a + n + self.length - 1]], 1, None, 0
        bits = self.length
        while bits:
            if bits & 1:
                res, done = (h, size) if res is None else (_joined(res, h, done, size), done + size)
            bits >>= 1
            if bits:
                h, size = _joined(h, h, size, size), 2 * size
        return mix64(res[:n])


def _joined(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> np.ndarray:
    """Hashes of nx + ny bytes from those of nx bytes and of the ny bytes that follow."""
    n = min(len(x), len(y) - nx)
    return x[:n] * np.uint64(pow(_BASE, ny, 1 << 64)) + y[nx : nx + n]


def _shards(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _touched(shard: np.ndarray) -> list[tuple[int, slice]]:
    """The shards that stand in a sorted array, each with its place."""
    ids, first = np.unique(shard, return_index=True)
    return [(int(s), slice(int(a), int(z))) for s, a, z in zip(ids, first, np.append(first, len(shard))[1:], strict=True)]


def _zipped(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unzipped(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompressobj().decompress(raw)


# Messages: how many entries of which chunks, and then the entries.  Answers: how many
# bits for which chunks, and then the bits, in planes.


def _headed(chunks: list[int], counts: list[int]) -> list[np.ndarray]:
    return [np.array([len(chunks)], "<u4"), np.array(chunks, "<i8"), np.array(counts, "<u4")]


def _opened(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks, counts and the rest of a message."""
    raw = np.frombuffer(_unzipped(data), np.uint8)
    m = int(raw[:4].view("<u4")[0])
    return raw[4 : 4 + 8 * m].view("<i8"), raw[4 + 8 * m : 4 + 12 * m].view("<u4").astype(np.int64), raw[4 + 12 * m :]


def _planes(rest: np.ndarray, total: int, planes: int) -> list[np.ndarray]:
    size = (total + 7) // 8
    return [np.unpackbits(rest[k * size : (k + 1) * size], count=total) for k in range(planes)]


def _groups(batches, *key):
    """Rows of sorted batches by group: (key values, list of rows)."""
    held, last = [], None
    for b in batches:
        for row in b.to_pylist():
            own = tuple(row[k] for k in key)
            if held and own != last:
                yield last, held
                held = []
            last = own
            held.append(row)
    if held:
        yield last, held


def _split(batches, planes):
    """Answers of a bucket's shards to a pack, in order of shards, as answers to its chunks."""
    for (bucket, _), rows in _groups(batches, "bucket", "chunk"):
        parts: dict[int, list] = {}
        for row in rows:
            chunks, counts, rest = _opened(row["data"])
            bits = _planes(rest, int(counts.sum()), planes)
            ends = np.cumsum(counts)
            for c, a, z in zip(chunks.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                parts.setdefault(c, []).append([p[a:z] for p in bits])
        data = []
        for c, own in parts.items():
            whole = [np.concatenate([x[k] for x in own]) for k in range(planes)]
            data.append(_zipped(*_headed([c], [len(whole[0])]), *map(np.packbits, whole)))
        yield {"shard": [bucket] * len(parts), "chunk": list(parts), "data": data}


# round 1


def _anchors(batches, length, shards, inner, width):
    """The distinct anchors of each chunk, ``width`` bytes of each, and how often it has them (up to 255)."""
    for b in batches:
        for ids, sizes, data, chunk in zip(*(b.column(c).to_pylist() for c in ("ids", "sizes", "data", "chunk")), strict=True):
            anchor, many = np.unique(Chunk(ids, sizes, data, length).fragments(False)["anchor"], return_counts=True)
            raw = anchor.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
            out: dict[str, list] = {"shard": [], "chunk": [], "data": []}
            for s, own in _touched(_shards(anchor, shards) // inner):
                out["shard"].append(s)
                out["chunk"].append(chunk)
                out["data"].append(_zipped(*_headed([chunk], [own.stop - own.start]), raw[own].T, np.minimum(many[own], 255).astype(np.uint8)))
            yield out


def _anchor_entries(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks, counts, keys and occurrences of a message of round 1."""
    chunks, counts, rest = _opened(data)
    n = int(counts.sum())
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = rest[: n * width].reshape(width, n).T
    return chunks, counts, wide.reshape(-1).view("<u8"), rest[n * width :]


def _dealt_anchors(batches, shards):
    """A bucket's messages from the chunks of a pack, whole keys, dealt to the bucket's shards."""
    for (_, pack), rows in _groups(batches, "shard", "pack"):
        parts: dict[int, list] = {}
        for row in rows:
            chunks, _, key, many = _anchor_entries(row["data"], 8)
            for s, own in _touched(_shards(key, shards)):
                parts.setdefault(s, []).append((int(chunks[0]), key[own], many[own]))
        data = [_zipped(*_headed([c for c, *_ in own], [len(k) for _, k, _ in own]), np.concatenate([k for _, k, _ in own]).view(np.uint8).reshape(-1, 8).T, *(m for *_, m in own)) for own in parts.values()]
        yield {"shard": list(parts), "chunk": [pack] * len(parts), "data": data}


def _common(batches, width, most):
    """Per chunk and anchor 2 bits: other chunks have it; it is hot."""
    for (shard,), rows in _groups(batches, "shard"):
        got = [_anchor_entries(row["data"], width) for row in rows]
        key, flat = np.unique(np.concatenate([k for *_, k, _ in got]), return_inverse=True)
        shared = np.bincount(flat, minlength=len(key))[flat] > 1
        hot = np.bincount(flat, weights=np.concatenate([m for *_, m in got]), minlength=len(key))[flat] >= most
        cuts = np.cumsum([0, *(len(k) for *_, k, _ in got)])
        yield {
            "shard": [shard] * len(rows),
            "chunk": [r["chunk"] for r in rows],
            "data": [_zipped(*_headed(chunks, counts), np.packbits(shared[a:z]), np.packbits(hot[a:z])) for (chunks, counts, *_), a, z in zip(got, cuts, cuts[1:], strict=False)],
        }


# round 2


def _with_answers(batches):
    """(chunk row, {shard: answer of round 1}, {shard: answer of round 2}) of each chunk."""
    for _, rows in _groups(batches, "chunk"):
        own = next((r for r in rows if r["kind"] == 0), None)
        yield own, {r["shard"]: r["data"] for r in rows if r["kind"] == 1}, {r["shard"]: r["data"] for r in rows if r["kind"] == 2}


def _entries(chunk: Chunk, answers: dict[int, bytes], shards: int, inner: int, least: int = 0, end: int | None = None) -> dict[str, np.ndarray]:
    """What the chunk sends in round 2 to shards from ``least`` to before ``end``, by shard and key, and the occurrences that stand behind it.

    Of the sent: key, shard, n (windows), doc (smallest id), start (of one occurrence).
    Of the occurrences: of (row of the sent), o_start, o_doc (id).
    """
    f = chunk.fragments(True)
    anchor, flat = np.unique(f["anchor"], return_inverse=True)
    shared, hot = np.zeros(len(anchor), bool), np.zeros(len(anchor), bool)
    for s, own in _touched(_shards(anchor, shards) // inner):
        shared[own], hot[own] = _planes(_opened(answers[s])[2], own.stop - own.start, 2)
    ids = chunk.ids[f["doc"]]
    low, high = np.full(len(anchor), np.iinfo(np.int64).max), np.full(len(anchor), np.iinfo(np.int64).min)
    np.minimum.at(low, flat, ids)
    np.maximum.at(high, flat, ids)
    take = (shared | (low < high))[flat]
    single = take & hot[flat]
    take &= ~single
    starts, counts = f["start"][single], f["n"][single]
    each = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    names = chunk.windows[each]
    key = np.concatenate([f["anchor"][take], names])
    name = np.concatenate([f["name"][take], names])
    n = np.concatenate([f["n"][take], np.ones(len(each), np.int64)])
    start = np.concatenate([f["start"][take], each])
    doc = np.concatenate([ids[take], np.repeat(ids[single], counts)])
    shard = _shards(key, shards).astype(np.uint32)
    if end is not None:
        own = np.flatnonzero((shard >= least) & (shard < end))
        shard, key, name, n, start, doc = shard[own], key[own], name[own], n[own], start[own], doc[own]
    # equal fragments side by side, shards in order: one sort of 64-bit names, one of small numbers
    whole = mix64(key + mix64(name) + n.astype(np.uint64))
    order = np.argsort(whole)
    order = order[np.argsort(shard[order], kind="stable")]
    new = np.ones(len(key), bool)
    new[1:] = whole[order[1:]] != whole[order[:-1]]
    if (alone := _unlike(chunk, new, start[order], n[order])).any():
        # those of one name that stand alone have to come in one order, whichever shards are asked for
        order = np.lexsort((start, whole, shard))
        new |= alone
    key, n, start, doc = key[order], n[order], start[order], doc[order]
    head = np.flatnonzero(new)
    low = np.minimum.reduceat(doc, head) if len(head) else doc
    return {"key": key[head], "shard": _shards(key[head], shards), "n": n[head], "doc": low, "start": start[head], "of": np.cumsum(new) - 1, "o_start": start, "o_doc": doc}


def _bytes_of(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return text[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _unlike(chunk: Chunk, new: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Members of the groups that begin where ``new`` is set whose bytes aren't all the same: each is to stand alone."""
    out = np.zeros(len(new), bool)
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    rest = np.flatnonzero(~new)
    for a in range(0, len(rest), 1 << 15):
        own = rest[a : a + (1 << 15)]
        first = head[group[own]]
        same = n[own] == n[first]
        size = np.where(same, n[own], 1) + chunk.length - 1
        differ = _bytes_of(chunk.text, start[own], size) != _bytes_of(chunk.text, start[first], size)
        if differ.any() or not same.all():
            same &= ~np.logical_or.reduceat(differ, np.cumsum(size) - size)
            out |= np.isin(group, group[own[~same]])
    return out


def _send(batches, length, shards, inner, most, least, end):
    """Messages with the fragments for the given shards: each chunk's, or those of ``most`` chunks together under the name of the first."""
    held: list[dict] = []
    first, count = None, 0
    for own, answers, _ in _with_answers(batches):
        if own is None:
            continue
        chunk = Chunk(own["ids"], own["sizes"], own["data"], length)
        e = _entries(chunk, answers, shards, inner, least, end)
        out: dict[str, list] = {"shard": [], "chunk": [], "data": []}
        for s, k in _touched(e["shard"] // inner):
            size = e["n"][k] + length - 1
            out["shard"].append(s)
            out["chunk"].append(own["chunk"])
            out["data"].append(_zipped(*_headed([own["chunk"]], [len(size)]), e["key"][k], e["doc"][k], e["n"][k].astype(np.uint8), _bytes_of(chunk.text, e["start"][k], size)))
        if inner == 1:
            yield out
            continue
        first, count = own["chunk"] if first is None else first, count + 1
        held += [{"shard": s, "data": d} for s, d in zip(out["shard"], out["data"], strict=True)]
        if count == most:
            yield from _dealt_fragments(held, first, length, shards)
            held, first, count = [], None, 0
    if held:
        yield from _dealt_fragments(held, first, length, shards)


def _fragment_entries(data: bytes) -> tuple[np.ndarray, ...]:
    """Chunks, counts, keys, documents, windows and bytes of a message of round 2."""
    chunks, counts, rest = _opened(data)
    n = int(counts.sum())
    return chunks, counts, rest[: 8 * n].view("<u8"), rest[8 * n : 16 * n].view("<i8"), rest[16 * n : 17 * n], rest[17 * n :]


def _dealt_fragments(held, pack, length, shards):
    """Messages of a pack's chunks to buckets, put together and dealt to the buckets' shards."""
    for _, rows in groupby(sorted(held, key=itemgetter("shard")), itemgetter("shard")):
        parts: dict[int, list] = {}
        for row in rows:
            chunks, _, key, doc, n, text = _fragment_entries(row["data"])
            row["data"] = None
            ends = np.append(0, np.cumsum(n.astype(np.int64) + length - 1))
            for s, own in _touched(_shards(key, shards)):
                parts.setdefault(s, []).append((int(chunks[0]), key[own], doc[own], n[own], text[ends[own.start] : ends[own.stop]]))
        data = [_zipped(*_headed([x[0] for x in own], [len(x[1]) for x in own]), *(x[k] for k in range(1, 5) for x in own)) for own in parts.values()]
        yield {"shard": list(parts), "chunk": [pack] * len(parts), "data": data}


def refine(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A number for each of the suffixes at ``starts``, equal where their first ``length`` bytes are.

    Bucket-pointer refinement: positions are put into buckets by 8 bytes; a
    bucket with several members is refined by sorting on the bucket numbers
    that its members' later positions have from the round before.
    """
    size = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    gram = np.zeros(size, np.uint64)
    for k in range(8):
        gram = (gram << np.uint64(8)) | padded[k : k + size]
    bucket = np.unique(gram, return_inverse=True)[1]
    depth = min(8, length)
    top = size
    while depth < length:
        step = min(depth, length - depth)
        last = depth + step == length  # from here on only the asked suffixes count
        open_ = np.bincount(bucket)[bucket] > 1
        at = starts[open_[starts]] if last else np.flatnonzero(open_)
        later = np.where(at + step < size, bucket[np.minimum(at + step, size - 1)] + 1, 0)
        number = np.unique(bucket[at].astype(np.uint64) * np.uint64(top + 2) + later.astype(np.uint64), return_inverse=True)[1]
        bucket = bucket + size  # buckets of one member keep numbers of their own, above the refined ones
        bucket[at] = number
        top += size
        depth += step
    return bucket[starts]


def _sort_shards(batches, length):
    """One bit for each window that a chunk has sent: a smaller document has it than the chunk said."""
    for (shard,), rows in _groups(batches, "shard"):
        got = []
        for row in rows:
            got.append(_fragment_entries(row["data"]))
            row["data"] = None
        heads = [x[:2] for x in got]
        key, doc, n, text = (np.concatenate([x[k] for x in got]) for k in range(2, 6))
        n = n.astype(np.int64)
        sizes = [int(counts.sum()) for _, counts in heads]
        del got
        size = n + length - 1
        begin = np.cumsum(size) - size
        # equal fragments are taken together, by their exact bytes
        raw = text.tobytes()
        known: dict[bytes, int] = {}
        same = np.fromiter((known.setdefault(raw[a : a + s], len(known)) for a, s in zip(begin.tolist(), size.tolist(), strict=True)), np.int64, len(size))
        first = np.full(len(known), -1, np.int64)
        first[same[::-1]] = np.arange(len(same))[::-1]
        least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(least, same, doc)
        # only fragments that share their key with others have windows to be sorted
        _, group = np.unique(key[first], return_inverse=True)
        mixed = np.flatnonzero(np.bincount(group)[group] > 1)
        fn = n[first]
        offset = np.cumsum(fn) - fn
        lowest = np.repeat(least, fn)
        # fragments of a key stay together; some SORT_BYTES of them are sorted at a time
        mixed = mixed[np.argsort(group[mixed], kind="stable")]
        key_ends = np.flatnonzero(np.append(np.diff(group[mixed]) != 0, True)) + 1 if len(mixed) else np.empty(0, np.int64)
        part_of = np.cumsum(size[first[mixed]])[key_ends - 1] // SORT_BYTES if len(mixed) else key_ends
        ends_of_parts = key_ends[np.append(np.diff(part_of) != 0, True)] if len(mixed) else key_ends
        for a, z in zip(np.append(0, ends_of_parts)[: len(ends_of_parts)], ends_of_parts, strict=True):
            some = mixed[a:z]
            k = first[some]
            part = _bytes_of(text, begin[k], size[k])
            local = np.cumsum(size[k]) - size[k]
            nth = np.arange(fn[some].sum()) - np.repeat(np.cumsum(fn[some]) - fn[some], fn[some])
            names = refine(part, np.repeat(local, fn[some]) + nth, length)
            _, names = np.unique(names, return_inverse=True)
            best = np.full(names.max() + 1, np.iinfo(np.int64).max)
            where = np.repeat(offset[some], fn[some]) + nth
            np.minimum.at(best, names, lowest[where])
            lowest[where] = best[names]
        cuts = np.cumsum([0, *sizes])
        answers = []
        for (chunks, counts), a, z in zip(heads, cuts, cuts[1:], strict=False):
            own = n[a:z]
            spot = np.repeat(offset[same[a:z]] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            bits = np.add.reduceat(own, np.cumsum(counts) - counts)
            answers.append(_zipped(*_headed(chunks, bits), np.packbits(lowest[spot] < np.repeat(doc[a:z], own))))
        yield {"shard": [shard] * len(rows), "chunk": [r["chunk"] for r in rows], "data": answers}


def _spans(batches, length, shards, inner, keep):
    for own, answers, gone in _with_answers(batches):
        if own is None:
            continue
        chunk = Chunk(own["ids"], own["sizes"], own["data"], length)
        e = _entries(chunk, answers, shards, inner)
        offset = np.cumsum(e["n"]) - e["n"]
        bit = np.zeros(int(e["n"].sum()), bool)
        for s, k in _touched(e["shard"] // inner):
            total = int(e["n"][k].sum())
            bit[offset[k.start] : offset[k.start] + total] = _planes(_opened(gone[s])[2], total, 1)[0]
        n = e["n"][e["of"]]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        lose = bit[np.repeat(offset[e["of"]], n) + nth] | np.repeat(e["o_doc"] > e["doc"][e["of"]], n)
        start = (np.repeat(e["o_start"], n) + nth)[lose]
        cover = np.zeros(len(chunk.text) + 1, np.int32)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + length, -1)
        covered = np.cumsum(cover[:-1]) > 0
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256")}
        for doc, end, size in zip(chunk.ids.tolist(), chunk.ends.tolist(), chunk.sizes.tolist(), strict=True):
            hit = covered[end - size : end]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            kept = chunk.text[end - size : end][~hit].tobytes()
            out["doc_id"].append(doc)
            out["n_bytes"].append(size)
            out["n_removed"].append(int(hit.sum()))
            out["n_spans"].append(len(edge) // 2)
            out["spans"].append(edge.astype(np.int64))
            out["kept"].append(kept if keep else None)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        yield out


def dedup_substrings(spark: SparkSession, docs: DataFrame, *, length: int = 50, keep: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (starts and ends, in turn), kept (bytes, with ``keep``), kept_sha256."""
    if not GRAM <= length <= 255 - GRAM:
        raise ValueError(f"length is to be from {GRAM} to {255 - GRAM}")
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = scratch.write(map_arrow(docs.where("doc_id is not null"), CHUNKS, _pack_chunks, CHUNK_BYTES), "chunks")
    found = chunks.agg(F.sum(F.octet_length("data")).alias("bytes"), F.count("*").alias("n")).first()
    total = int(found["bytes"] or 0)
    shards = max(8, -(-3 * total // SHARD_BYTES))
    inner = -(-shards // FAN)  # shards of a bucket
    shards = -(-shards // inner) * inner
    packs = -(-max(1, found["n"]) // min(inner, PACK))
    # tasks grow with the input, so that none reads more than a few chunks or shards
    usual = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    tasks, chunk_tasks = min(shards, max(usual, -(-shards // 4))), max(usual, -(-found["n"] // 2))
    # a part of the key tells anchors of a shard apart but for a few; whole keys can be dealt further
    width = 8 if inner > 1 else min(8, max(5, -(-(total.bit_length() + 6) // 8)))

    def asked(messages: DataFrame, answer, answer_args: tuple, planes: int) -> DataFrame:
        """The shards' answers to messages(shard, chunk, data): one to each message, or by bucket."""
        # shards are numbers in a row: each task gets as many as the next
        rows = messages.repartitionById(tasks, F.pmod("shard", F.lit(tasks))).sortWithinPartitions("shard", "chunk")
        answers = map_arrow(rows, PARTS, answer, *answer_args)
        if inner > 1:
            rows = answers.withColumn("bucket", F.floor(F.col("shard") / inner).cast("int"))
            rows = rows.repartition(chunk_tasks, "bucket", "chunk").sortWithinPartitions("bucket", "chunk", "shard")
            answers = map_arrow(rows, PARTS, _split, planes)
        return answers

    def by_chunk(count: int, *answers: DataFrame) -> DataFrame:
        rows = chunks.select("chunk", F.lit(0).alias("kind"), F.lit(-1).alias("shard"), "ids", "sizes", "data")
        for kind, a in enumerate(answers, 1):
            none = F.lit(None).cast("binary")
            rows = rows.unionByName(a.select("chunk", F.lit(kind).alias("kind"), "shard", none.alias("ids"), none.alias("sizes"), "data"))
        return rows.repartition(count, "chunk").sortWithinPartitions("chunk", "kind", "shard")

    sent = map_arrow(chunks, PARTS, _anchors, length, shards, inner, width)
    if inner > 1:
        sent = sent.withColumn("pack", F.pmod(F.xxhash64("chunk"), F.lit(packs)))
        sent = sent.repartition(chunk_tasks, "shard", "pack").sortWithinPartitions("shard", "pack", "chunk")
        sent = map_arrow(sent, PARTS, _dealt_anchors, shards)
    one = scratch.write(asked(sent, _common, (width, HOT), 2), "common")
    # fragments are the bulk of what moves: each turn asks some buckets, and its shuffles go when its answers are written
    most = min(inner, SEND_PACK)
    pack_tasks = chunk_tasks if inner == 1 else -(-max(1, found["n"]) // most)
    edges = [inner * (shards // inner * k // TURNS) for k in range(TURNS + 1)]
    gone = []
    for least, end in zip(edges, edges[1:], strict=False):
        sent = map_arrow(by_chunk(pack_tasks, one), PARTS, _send, length, shards, inner, most, least, end)
        gone.append(scratch.write(asked(sent, _sort_shards, (length,), 1), "gone"))
    two = functools.reduce(DataFrame.unionByName, gone)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary, kept_sha256 string"
    out = map_arrow(by_chunk(chunk_tasks, one, two), schema, _spans, length, shards, inner, keep)
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rest = docs.where("doc_id is null").select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.array().cast("array<long>").alias("spans"), (raw if keep else F.lit(None).cast("binary")).alias("kept"), F.sha2(raw, 256).alias("kept_sha256"))
    return out.unionByName(rest)
