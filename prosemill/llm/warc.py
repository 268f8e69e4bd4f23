"""WARC archives: written with segments and chunked transfer framing, read back by reassembly.

Writing.  The payload of each page goes into an HTTP response with chunked
transfer coding.  A response block longer than ``segment`` bytes is split: the
response record is segment 1, continuation records carry the rest, the origin's
record id, their number, and on the last one the total length.  Of equal
payloads of at least ``least`` bytes the smallest id is a response, the others
are revisits with headers only.  Archives are gzip files of plain WARC
records, written by Spark's text writer (a record's last byte is its line
feed), so any file system that Spark knows will do.  The records are put
together to lines of LINE_BYTES or one page, and a file takes FILE_LINES of
them, so an archive's size is bounded.

Reading.  Archive files are parsed record by record; whole records go straight
on.  Segments are shuffled by origin id, ordered by number within each origin,
checked for gaps and against the total length, joined, and the chunk framing is
decoded.  Only segments move; a record's group is one HTTP message.  A revisit's
payload is that of the response it names, so its length and digest are held
against that response's.

Defined results: null text is an empty payload; rows that repeat an id each get
a record, the first of equal ones being the response (ties by nothing else
matter: their payloads are equal); a row with a null id is written without a
page id header and comes back with a null id; extra columns are ignored; an
empty table gives an empty one; a damaged message (missing segment, wrong
length, broken chunk, no response) comes back with ``damage`` set and a null
payload.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_hot, map_arrow, new_path, pieces

SEGMENT, CHUNK_BYTES = 16 << 10, 4 << 10
LINE_BYTES, FILE_LINES = 1 << 20, 32
#: Digests of repeated payloads (some 100 bytes each) are broadcast up to this many.
MOST_BROADCAST = 200_000
NS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "2024-01-01T00:00:00Z"

RECORDS = "origin string, number int, total long, type string, page_id long, refers_to long, digest string, block binary"
MESSAGES = "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, damage string"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[at : at + size])
        at += size + 2


def _urn(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(NS, '|'.join(map(str, parts)))}>"


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, row: str, segment: int) -> bytes:
    """All records of one page."""
    own = [("WARC-Date", DATE)] + ([("WARC-Target-URI", "".join(url.split()))] if url and url.split() else []) + ([("X-Page-Id", str(page_id))] if page_id is not None else [])
    origin = _urn("page", page_id, row)
    payload_digest = ("WARC-Payload-Digest", f"sha256:{digest}")
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        head = [("WARC-Type", "revisit"), ("WARC-Record-ID", origin), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", str(refers_to)), ("Content-Type", "application/http; msgtype=response"), payload_digest]
        return record(head + own, block)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    head = [("WARC-Type", "response"), ("WARC-Record-ID", origin), ("Content-Type", "application/http; msgtype=response"), payload_digest]
    if len(block) <= segment:
        return record(head + own, block)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [record([*head, ("WARC-Segment-Number", "1"), *own], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", _urn(origin, k)), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", str(k))]
        if k == len(parts):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record(more + own[:1], part))
    return b"".join(out)


def _write(batches, segment):
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    held: list[bytes] = []
    size = 0
    for b in batches:
        for i, j in pieces(b, "html"):
            cols = [b.column(c)[i:j].to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")]
            out = []
            for page_id, url, html, digest, refers in zip(*cols, strict=True):
                raw = page_records(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers, f"{part}-{n}", segment)
                n += 1
                if held and size + len(raw) > LINE_BYTES:
                    out.append(b"".join(held)[:-1])  # the writer adds the last line feed
                    held, size = [], 0
                held.append(raw)
                size += len(raw)
            if out:
                yield {"value": out}
    if held:
        yield {"value": [b"".join(held)[:-1]]}


def parse(raw: bytes):
    """(headers by lower-case name, block) of each record of an archive's bytes, gzip or plain; one record is held at a time."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw))) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {line[:40]!r}")
        headers = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        size = int(headers["content-length"])
        block = f.read(size)
        if len(block) < size:
            raise ValueError("the archive ends within a record")
        yield headers, block


def _number(x: str | None) -> int | None:
    return int(x) if x is not None else None


def _records(batches):
    for b in batches:
        for raw in b.column("content").to_pylist():
            out: dict[str, list] = {k: [] for k in ("origin", "number", "total", "type", "page_id", "refers_to", "digest", "block")}
            held = 0
            for h, block in parse(raw):
                if h.get("warc-type") not in ("response", "revisit", "continuation"):
                    continue
                out["origin"].append(h.get("warc-segment-origin-id") or h["warc-record-id"])
                out["number"].append(_number(h.get("warc-segment-number")))
                out["total"].append(_number(h.get("warc-segment-total-length")))
                out["type"].append(h["warc-type"])
                out["page_id"].append(_number(h.get("x-page-id")))
                out["refers_to"].append(_number(h.get("x-refers-to-page-id")))
                out["digest"].append((h.get("warc-payload-digest") or "").removeprefix("sha256:") or None)
                out["block"].append(block)
                held += len(block)
                if held > 8 << 20:
                    yield out
                    out, held = {k: [] for k in out}, 0
            yield out


def decode(kind: str, page_id, refers_to, digest, block: bytes | None, damage: str | None, keep: bool) -> dict:
    row = {"page_id": page_id, "record_type": kind, "refers_to": refers_to, "damage": damage, "payload": None, "payload_bytes": None, "payload_digest": None}
    if damage:
        return row
    head, _, body = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if kind == "revisit":
        return row | {"payload_bytes": int(http.get(b"content-length", 0)), "payload_digest": digest}
    try:
        payload = unchunked(body) if http.get(b"transfer-encoding", b"").lower() == b"chunked" else body
    except ValueError:
        return row | {"damage": "broken chunk"}
    found = hashlib.sha256(payload).hexdigest()
    if digest and digest != found:
        return row | {"damage": "digest differs"}
    return row | {"payload": payload if keep else None, "payload_bytes": len(payload), "payload_digest": found}


def _columns(rows: list[dict]) -> dict[str, list]:
    return {k: [r[k] for r in rows] for k in ("page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "damage")}


def _whole(batches, keep):
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("type", "page_id", "refers_to", "digest", "block")]
        yield _columns([decode(*row, None, keep) for row in zip(*cols, strict=True)])


def _joined(batches, keep):
    """Rows sorted by (origin, number): one message for each origin."""
    held: list = []

    def message():
        first = held[0]
        total = held[-1][2]
        damage = None
        if [r[1] for r in held] != list(range(1, len(held) + 1)) or total is None:
            damage = "missing segment"
        elif sum(len(r[7]) for r in held) != total:
            damage = "wrong length"
        return decode(first[3], first[4], first[5], first[6], None if damage else b"".join(r[7] for r in held), damage, keep)

    for b in batches:
        rows = []
        cols = [b.column(c).to_pylist() for c in ("origin", "number", "total", "type", "page_id", "refers_to", "digest", "block")]
        for row in zip(*cols, strict=True):
            if held and row[0] != held[0][0]:
                rows.append(message())
                held = []
            held.append(row)
        yield _columns(rows)
    if held:
        yield _columns([message()])


def write_archives(spark: SparkSession, pages: DataFrame, path: str, *, least: int = 100, segment: int = SEGMENT) -> None:
    """pages(page_id, url, html) as gzip WARC archives below ``path``."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n"))
    first = pages.where((F.col("n") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("many")).where("many > 1")
    first = Scratch(spark).write(first, "repeated")
    if first.count() <= MOST_BROADCAST:
        rows = pages.join(F.broadcast(first.drop("many")), "digest", "left")
    else:
        rows = join_hot(pages, first, "digest", pages.count(), "left")
    refers = F.when((F.col("n") >= least) & (F.col("page_id") > F.col("first")), F.col("first")).alias("refers_to")
    rows = rows.select("page_id", "url", "html", "digest", refers)
    out = map_arrow(rows, "value binary", _write, segment)
    out.select(F.col("value").cast("string").alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", FILE_LINES).text(path)


def read_archives(spark: SparkSession, path: str, *, keep_payload: bool = True) -> DataFrame:
    """One row for each response or revisit: page_id, payload, payload_bytes, payload_digest, record_type, refers_to, damage."""
    files = spark.read.format("binaryFile").load(path).select("content")
    records = map_arrow(files, RECORDS, _records)
    whole = map_arrow(records.where("number is null"), MESSAGES, _whole, keep_payload)
    parts = records.where("number is not null").repartition("origin").sortWithinPartitions("origin", "number")
    messages = whole.unionByName(map_arrow(parts, MESSAGES, _joined, keep_payload))
    if not keep_payload:
        messages = Scratch(spark).write(messages, "messages")
    return _held_against_responses(messages)


def _held_against_responses(messages: DataFrame) -> DataFrame:
    """messages, with damage where a revisit's response is missing or another; each distinct claim is looked up once."""
    claim = ["refers_to", "payload_bytes", "payload_digest"]
    revisits = messages.where("record_type = 'revisit' and damage is null")
    there = messages.where("record_type = 'response' and damage is null").select(F.col("page_id").alias("refers_to"), *claim[1:])
    wrong = revisits.select(*claim).distinct().join(there, claim, "left_anti").select(*(F.col(c).alias(f"_{c}") for c in claim), F.lit("no response").alias("_wrong"))
    same = F.lit(True)
    for c in claim:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = messages.join(wrong, same & (F.col("record_type") == "revisit"), "left")
    return out.select(*(F.coalesce("damage", "_wrong").alias(c) if c == "damage" else c for c in messages.columns))


def round_trip(spark: SparkSession, pages: DataFrame, *, path: str | None = None, keep_payload: bool = False) -> DataFrame:
    path = path or new_path(spark, "archives")
    write_archives(spark, pages, path)
    return read_archives(spark, path, keep_payload=keep_payload)
