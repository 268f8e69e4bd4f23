"""Vectors, web archives, the link graph and the pipeline."""

import hashlib
import random

import numpy as np
import pytest


def test_components_of_chains_and_stars(spark):
    from prosemill.llm.common import components

    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(1, 200)] + [(1_000, k) for k in range(1_001, 1_100)] + [(7_000, 7_001), (7_001, 7_000), (7_002, 7_002)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark, spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()}
    assert got == {k: 1 for k in range(1, 201)} | {k: 1_000 for k in range(1_000, 1_100)} | {7_000: 7_000, 7_001: 7_000}
    assert components(spark, spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_vectors(spark, monkeypatch):
    from prosemill.llm import embedding_dedup as ed

    monkeypatch.setattr(ed, "BLOCK", 16)
    rng = np.random.default_rng(0)
    rows = []
    for k in range(40):
        centre = rng.normal(size=24)
        for _ in range(rng.integers(1, 12)):
            rows.append((centre + rng.normal(size=24) * rng.choice([0, 0.05, 0.12])).tolist())
    rows = [(k * 2, v, int(k % 3)) for k, v in enumerate(rows)]
    rows += [(10_001, [0.0] * 24, 1), (10_003, None, 1), (10_005, [None] + [1.0] * 23, 1), (10_007, [float("nan")] + [1.0] * 23, 1), (10_009, rows[0][1], None), (10_011, [1.0, 2.0], 1), (10_013, [2.0, 4.0], 1), (10_015, [], 1), (None, rows[0][1], 0), (10_017, rows[0][1], 0), (10_019, [3 * x for x in rows[0][1]], 0)]
    t = spark.createDataFrame([(*r, "x", True) for r in rows], "vec_id long, embedding array<double>, label int, n_links string, kept boolean").repartition(3)
    able = [(i, np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: [] for i, *_ in rows if i is not None}
    for a, x, la in able:
        for b, y, lb in able:
            if a != b and la == lb and len(x) == len(y) and x @ y >= 0.98:
                links[a].append(b)

    def component(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return min(seen)

    got = ed.near_vectors(spark, t).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id, r.kept) == (len(links[r.vec_id]), component(r.vec_id), component(r.vec_id) == r.vec_id)
    assert sum(map(len, links.values())) > 100
    assert ed.near_vectors(spark, t.where("false")).count() == 0


@pytest.mark.parametrize(("size", "pivots"), [(600, 128), (1_500, 256)])
def test_near_vectors_of_a_dense_group(spark, size, pivots):
    from prosemill.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(size)
    centre = rng.normal(size=64)
    centre /= np.linalg.norm(centre)
    x = rng.normal(size=(size, 64))
    x[: size // 3] = centre + 0.1 / 8 * x[: size // 3]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(1) - 1
    got = near_vectors(spark, spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(3), pivots=pivots).collect()
    assert want.sum() > (size // 3) ** 2 * 0.9
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(want.tolist()))
    assert sum(r.kept for r in got) == size - size // 3 + 1


def test_near_vectors_of_repeated_ids(spark):
    from prosemill.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(11)
    a, b, c = rng.normal(size=(3, 16))
    rows = [(7, a), (7, b), (9, b), (3, a), (5, a), (5, a), (20, c), (21, c + 0.01), (21, a + 0.01), (22, 2 * c)]
    rows += [(30 + k % 25, (a, b, c)[k % 3] + rng.normal(size=16) * 0.05 * (k % 4)) for k in range(60)]
    units = [x / np.linalg.norm(x) for _, x in rows]
    links = {d: set() for d, _ in rows}
    for (d, _), x in zip(rows, units):
        for (e, _), y in zip(rows, units):
            if d != e and x @ y >= 0.98:
                links[d].add(e)
    low = {d: d for d in links}
    for _ in links:
        low = {d: min([low[d], *(low[e] for e in links[d])]) for d in links}
    table = spark.createDataFrame([(d, x.tolist(), 1) for d, x in rows], "vec_id long, embedding array<double>, label int").repartition(3)
    got = near_vectors(spark, table).collect()
    assert sorted(map(tuple, got)) == sorted((d, len(links[d]), low[d], low[d] == d) for d, _ in rows)


def test_recall_of_the_pivot_index(spark):
    """Pairs just above the threshold, in a table with many more pivots than a vector names."""
    from prosemill.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(12)
    x = rng.normal(size=(4_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    angle = np.arccos(rng.uniform(0.9801, 0.985, (len(x), 1)))
    both = np.concatenate([x, np.cos(angle) * x + np.sin(angle) * y])
    table = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(both)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r.component_id for r in near_vectors(spark, table, pivots=1_000).collect()}
    assert sum(got[k + 4_000] == k for k in range(4_000)) >= 0.99 * 4_000


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abc <>\r\n\0é한") for _ in range(90_000))
    texts = [None, "", "short", "short", "y" * 99, "y" * 99, "z" * 100, "z" * 100, "z" * 100, long, long, "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9, "0\r\n\r\n" * 40, long[::-1]]
    rows = [(100 - k, None if k % 3 == 0 else f"http://a b/\r\n{k}", t, "d", "r") for k, t in enumerate(texts)]
    rows += [(None, "u", "z" * 100, "d", "r"), (50, "u", "w" * 200, "d", "r"), (50, "u", "w" * 200, "d", "r")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, digest string, record_type string").repartition(3)


def test_warc_round_trip(spark, pages):
    from prosemill.llm.warc import round_trip

    rows, df = pages
    want = []
    for page, _, html, *_ in rows:
        raw = (html or "").encode()
        same = [p for p, _, h, *_ in rows if p is not None and (h or "").encode() == raw]
        ref = min(same) if page is not None and len(raw) >= 100 and min(same) < page else None
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "response" if ref is None else "revisit", ref, None, None if ref is not None else raw))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.damage, None if r.payload is None else bytes(r.payload)) for r in round_trip(spark, df, keep_payload=True).collect()]
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r[:3])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert round_trip(spark, df.where("false")).count() == 0


def test_revisits_need_their_response(spark, tmp_path):
    from prosemill.llm import warc

    digest = hashlib.sha256(b"p" * 200).hexdigest()
    there = warc.page_records(1, None, b"p" * 200, digest, None, "a", 4_096)
    (tmp_path / "a.warc").write_bytes(there + b"".join(warc.page_records(k, None, p, hashlib.sha256(p).hexdigest(), of, "a", 4_096) for k, p, of in ((2, b"p" * 200, 1), (3, b"q" * 200, 1), (4, b"p" * 200, 9))))
    for keep in (True, False):
        got = {r.page_id: r.damage for r in warc.read_archives(spark, str(tmp_path), keep_payload=keep).collect()}
        assert got == {1: None, 2: None, 3: "no response", 4: "no response"}


def test_archives_are_cut_by_size(spark, tmp_path, monkeypatch):
    from prosemill.llm import common, warc

    monkeypatch.setattr(warc, "FILE_LINES", 1)
    monkeypatch.setattr(warc, "MOST_BROADCAST", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rng = random.Random(2)
    page = "".join(rng.choices("abcdefgh", k=400_000))
    df = spark.createDataFrame([(k, None, page[: -(k % 3) - 1]) for k in range(12)] + [(40 + k, None, page) for k in range(9)] + [(60, None, None)], "page_id long, url string, html string").repartition(1)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(spark, df, path=str(tmp_path / "w")).collect()}
    want = {k: ("response", None, 399_999 - k) if k < 3 else ("revisit", k % 3, 399_999 - k % 3) for k in range(12)}
    assert got == want | {40 + k: ("revisit", 40, 400_000) if k else ("response", None, 400_000) for k in range(9)} | {60: ("response", None, 0)}
    assert len(list((tmp_path / "w").glob("part-*"))) > 1


def test_warc_damage(spark, tmp_path):
    from prosemill.llm import warc

    payload = bytes(range(256)) * 300
    digest = hashlib.sha256(payload).hexdigest()
    whole = warc.page_records(1, None, payload, digest, None, "r", 4_096)
    records = list(warc.parse(whole))
    assert len(records) > 10 and b"".join(b for _, b in records).endswith(b"0\r\n\r\n")

    def archive(name, kept):
        (tmp_path / name).write_bytes(b"".join(warc.record([(k, v) for k, v in h.items() if k != "content-length"], b) for h, b in kept))

    archive("a.warc", records[::-1])  # any order
    archive("b.warc", [({**h, "warc-segment-origin-id": "<b>"} if "warc-segment-origin-id" in h else {**h, "warc-record-id": "<b>"}, b) for k, (h, b) in enumerate(records) if k != 3])
    archive("c.warc", [({**h, "warc-segment-origin-id": "<c>"} if "warc-segment-origin-id" in h else {**h, "warc-record-id": "<c>"}, b[:-1] if k == 3 else b) for k, (h, b) in enumerate(records)])
    got = sorted((r.damage or "", r.payload is not None and bytes(r.payload) == payload) for r in warc.read_archives(spark, str(tmp_path)).collect())
    assert got == [("", True), ("missing segment", False), ("wrong length", False)]


def test_chunked_framing():
    from prosemill.llm.warc import chunked, unchunked

    for n in (0, 1, 4_095, 4_096, 4_097, 20_000):
        assert unchunked(chunked(b"\r\n0" * n)) == b"\r\n0" * n
    with pytest.raises(ValueError):
        unchunked(b"5\r\nab\r\n0\r\n\r\n")


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(9_000_001, None, None, None, None), (9_000_002, "", "en", "src0", 0), (9_000_003, "??? !!!", "en", None, 7), (None, "no id but letters enough to be kept here", "en", "src1", 40)], docs.schema)
    given = docs.unionByName(extra)
    step, counts = given, []
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, step, "unused")
        assert k == len(p.STAGES) - 1 or out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        step = spark.read.parquet(path)
        counts.append(step.count())
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    after = spark.read.parquet(str(tmp_path / "language_id"))
    assert after.count() == docs.count() + 1 - docs.where("not text rlike '[a-zA-Z]'").count()
    near = spark.read.parquet(str(tmp_path / "near_dedup"))
    assert near.where("doc_id is not null").count() == near.select("doc_id").where("doc_id is not null").distinct().count() <= counts[1]
    assert all(counts)
    none = docs.where("false")
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, none, "unused").count() == 0


def test_texts_of_no_learned_language_go(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    foreign = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
        "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待",
        "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα",
        "Все люди",
        " ".join("".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=2 + k % 8)) for k in range(60)),
    ]
    clean = ["the thing is", "Die Zeit und der", "que la ción", "All human beings are born free and equal in dignity and rights."]
    planted = spark.createDataFrame([(9_000_000 + k, t, None, "src0", len(t)) for k, t in enumerate(foreign + clean)], docs.schema)
    kept = {r.doc_id for r in p.language_id(spark, docs.unionByName(planted), "unused").select("doc_id").collect()}
    assert {k for k in kept if k >= 9_000_000} == {9_000_000 + len(foreign) + k for k in range(len(clean))}
    assert {r.doc_id for r in docs.where("text rlike '[a-zA-Z]'").select("doc_id").collect()} <= kept


def test_stage_keeps_columns_of_clashing_names(spark):
    import corpus_pipeline as p

    names = "score lang_pred likeness kept n_lines n_dropped kept_sha256 copy n_copies mix_rate mix_key _doc _mix_source column_5 Component_ID n_shingles mark drop".split()
    schema = "doc_id long, text string, " + ", ".join(f"{c} int" for c in names) + ", lang string, source string, n_chars long"
    texts = ["some words of text here\nand a line", "other words altogether\nand a line"]
    docs = spark.createDataFrame([(k, t, *(10 * c + k for c in range(len(names))), "en", "s", 30) for k, t in enumerate(texts)], schema)
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, "unused")
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(tuple(r)[2:-3] == tuple(10 * c + r.doc_id for c in range(len(names))) for r in rows)


def test_pipeline_against_brute_force(spark):
    """The whole run on a small table, each stage's decisions made anew row by row."""
    import math
    import zlib

    import corpus_pipeline as p
    from prosemill.llm import language_id as li
    from prosemill.llm.tokens import public_path
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text", "source").collect())
    model = li.fit(spark, docs)
    step = [r for r in rows if r[1] and any(map(str.isalpha, r[1])) and model.judge([r[1]])[2][0] >= model.least]

    def key(line):
        k = line.strip(" \t\v\f\r").translate({c: c + 32 for c in range(65, 91)})
        return k if len(k) >= 10 else None

    holders = {}
    for d, t, _ in step:
        for x in t.split("\n"):
            holders.setdefault(key(x), set()).add(d)
    lines = []
    for d, t, s in step:
        kept = "\n".join(x for x in t.split("\n") if key(x) is None or d == min(holders[key(x)]))
        if kept == t or kept.strip(" "):
            lines.append((d, kept, s))

    sets = {}
    for d, t, _ in lines:
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    near = [r for r in lines if find(r[0]) == r[0]]

    n = {}
    for _, _, s in near:
        n[s] = n.get(s, 0) + 1
    tok = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    want = []
    for d, t, s in near:
        rate = len(near) / len(n) / n[s]
        u = int(hashlib.md5(f"17|{d}".encode()).hexdigest()[:12], 16) / 2**48
        k, q = 0, math.exp(-rate)
        c = q
        while c <= u:
            k += 1
            q *= rate / k
            c += q
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1_024 or 1_024, len(ids), 1_024), len(ids)]
        want += k * [(d, j, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())) for j, (a, z) in enumerate(zip(cuts, cuts[1:]))]
    got = p.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert len(rows) >= len(step) > len(near) > 0
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 1_024
    assert len(bins) <= sum(r.length for r in got) / 1_024 * 1.05 + 2
