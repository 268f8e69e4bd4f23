"""The operators on documents against brute force, on rows with nulls, repeats, ties and long texts."""

import hashlib
import random
import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_lines long, component_id string, lang_pred string, copy int, chunk string, shard string"
WORDS = [w + x for w in ("ka", "lo", "mi", "tu", "re", "zo") for x in ("n", "st", "ria", "l", "ve", "po", "x")]


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = words(rng, 120)
    texts = [None, "", " \t\n", "a", "?!", "One two", "one TWO", "short line\nshort line\n", "x" * 30_000, words(rng, 9_000), base, base, base.upper(), "Zeile\r\nmit Ümläuten und ß ☃ 한글\n" * 4]
    texts += [edited(rng, base, rng.choice((0.01, 0.02, 0.04, 0.06))) for _ in range(60)]
    texts += [words(rng, 40) + "\nA passage that many documents share, longer than fifty bytes in all.\n" + words(rng, 30) for _ in range(12)]
    texts += [words(rng, rng.randint(1, 200)) + "<|endoftext|>" * (k % 5 == 0) for k in range(20)]
    out = [(k * 3, t, rng.choice(["aa", "bb", None]), rng.choice(["s0", "s0", "s1", None]), len(t or "")) for k, t in enumerate(texts)]
    out += [(30, base, "aa", "s0", 5), (30, base, "aa", "s0", 5), (None, base, "aa", None, None), (None, None, None, None, None)]
    rng.shuffle(out)
    return [(*r, True, 1, "c", "p", 7, "q", "z") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates(spark, rows, docs, empty, monkeypatch):
    from prosemill.llm import near_dedup as nd

    monkeypatch.setattr(nd, "BLOCK", 7)

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {}
    for doc, text, *_ in rows:
        if doc is not None:
            sets.setdefault(doc, shingles(text))
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = nd.near_duplicates(spark, docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert len({find(d) for d in ids}) < len(ids) - 20  # some link, not all
    assert nd.near_duplicates(spark, empty).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    from prosemill.llm.near_dedup import near_duplicates

    rng = random.Random(8)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (9, b), (9, b), (9, None), (12, c), (13, c), (7, c)]
    # many rows over few ids, near copies among them
    for k in range(200):
        rows.append((100 + k % 60, edited(rng, (a, b, c, words(rng, 40))[k % 4], rng.choice((0, 0.01, 0.03)))))
    sets = [({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set()) for _, t in rows]
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (d, _) in enumerate(rows):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                x, y = sorted((find(d), find(rows[j][0])))
                root[y] = x
    got = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = sorted((d, len(s), find(d), find(d) == d) for (d, _), s in zip(rows, sets))
    assert sorted(map(tuple, got)) == want
    small = near_duplicates(spark, spark.createDataFrame(rows[:4], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in small} == {(3, 3), (5, 3), (9, 3)}


def test_bands_come_from_different_permutations():
    from prosemill.llm import near_dedup as nd

    cols = nd.band_columns()
    assert sorted(cols.ravel()) == list(range(2 * nd.PERMUTATIONS))
    assert all(len(set(row % nd.PERMUTATIONS)) == nd.ROWS for row in cols)


def test_line_dedup(spark, rows, docs, empty):
    from prosemill.llm.line_dedup import dedup_lines, line_keys

    first, holders = {}, {}
    for doc, text, *_ in rows:
        for k in line_keys(text, 10):
            if k is not None and doc is not None:
                holders.setdefault(k, set()).add(doc)
    first = {k: min(v) for k, v in holders.items() if len(v) > 1}
    want = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        keep = [x for x, k in zip(lines, line_keys(text, 10)) if doc is None or k not in first or first[k] == doc]
        want.append((doc, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r)
    got = [tuple(r) for r in dedup_lines(spark, docs, digests=True).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
    assert sorted(got, key=key_of) == sorted(want, key=key_of)
    assert key and sum(w[2] for w in want) > 10
    assert dedup_lines(spark, empty).count() == 0
    whole = dedup_lines(spark, docs)
    assert set(docs.columns) <= set(whole.columns)


def key_of(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def test_line_index_is_reversible(spark, rows, monkeypatch):
    from prosemill.llm import line_dedup as ld

    own = [(d, t) for d, t, *_ in rows if d is not None]
    a, b = (spark.createDataFrame([r for r in own if r[0] % 2 == k], "doc_id long, text string") for k in (0, 1))
    start = ld.LineIndex.of(spark, a, shards=2)
    both = start.insert(b)
    want = ld.LineIndex.of(spark, a.unionByName(b), shards=2)
    rowset = lambda i: sorted((r.shard, bytes(r.key), r.n_docs, r.first_doc) for r in i.counts.collect())
    assert rowset(both) == rowset(want)
    back = both.delete(b.select("doc_id"))
    assert rowset(back) == rowset(start)
    dropped = lambda i: {r.doc_id: {bytes(k) for k in r["drop"]} for r in i.own_to_drop().collect()}
    assert dropped(both) == dropped(want) != dropped(back) == dropped(start)
    # a filter knows every live key, and every repeated one twice
    tables = {r["shard"]: ld.CuckooFilter.load(bytes(r["filter"])) for r in both.filters.collect()}
    for shard, key, n, _ in rowset(both):
        import numpy as np

        assert tables[shard].count(np.array([ld._hash(key)], dtype=np.uint64))[0] >= min(n, 2)


def test_line_index_grows(spark, monkeypatch):
    """Many shards, parts of few rows, and inserts that need more shards."""
    from prosemill.llm import line_dedup as ld

    monkeypatch.setattr(ld, "KEYS_PER_SHARD", 16)
    monkeypatch.setattr(ld, "PART_ROWS", 8)
    rng = random.Random(6)
    lines = [words(rng, 4) for _ in range(150)]
    own = [(k, "\n".join([*rng.sample(lines, 5), "a line of every document"])) for k in range(90)]
    a, b = (spark.createDataFrame(own[k::2], "doc_id long, text string") for k in (0, 1))
    index = ld.LineIndex.of(spark, a, shards=1)
    assert index.shards == 1
    index = index.insert(b)
    assert index.shards > 8 and index.filters.count() > 8
    first = {}
    for d, t in own:
        for x in t.split("\n"):
            first.setdefault(x.encode().lower(), d)
    want = {}
    for d, t in own:
        gone = {ld.xxhash.xxh3_128_digest(x.encode().lower()) for x in t.split("\n") if len(x) >= 10 and first[x.encode().lower()] < d}
        if gone:
            want[d] = gone
    got = {r.doc_id: {bytes(k) for k in r["drop"]} for r in index.own_to_drop().collect()}
    assert got == want
    strange = spark.createDataFrame([(500, "a line of every document\nnew line never seen before"), (-1, "a line of every document")], "doc_id long, text string")
    assert [(r.doc_id, len(r["drop"])) for r in index.to_drop(strange).collect()] == [(500, 1)]


def test_cuckoo_filter_inserts_counts_and_deletes():
    import numpy as np
    from prosemill.llm.line_dedup import CuckooFilter

    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    f = CuckooFilter.build(np.concatenate([h, h[:5_000]]))
    n = f.count(h)
    assert (n[:5_000] >= 2).all() and (n >= 1).all()
    strange = f.count(rng.integers(0, 2**63, 20_000, dtype=np.uint64))
    assert (strange >= 1).mean() < 0.01
    f.delete(h[:5_000])
    f.delete(h)
    assert not f.table.any()


def test_language_id(spark, rows, docs, empty):
    from prosemill.llm.language_id import identify

    got = identify(spark, docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for doc, text, *_ in rows:
        r = by[doc][0]
        assert r.held_out == (zlib.crc32(str("" if doc is None else doc).encode()) % 5 == 0)
        if doc is not None and not any(map(str.isalpha, text or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        assert 0 <= r.score <= 1
    assert identify(spark, empty).count() == 0
    nothing = docs.withColumn("lang", docs.lang.substr(9, 1)).where("false").unionByName(docs.selectExpr("* except(lang)", "cast(null as string) as lang").select(docs.columns))
    assert {r.lang_pred for r in identify(spark, nothing).collect()} == {"und"}


def test_kernel_scores_against_sets():
    """Kernel, landmarks and class values from Python sets and a dense solve."""
    import numpy as np
    from prosemill.llm import language_id as li

    rng = random.Random(9)
    sample = [("".join(rng.choices(s, k=40)), name) for _ in range(12) for name, s in (("a", "abcde fgh"), ("b", "abc xyz uvw"), ("c", "mnopq abc"))]

    def grams(t):
        return set(li.gram_ids(t).tolist())

    # blended spectrum: the numbers of all n-grams of one to four letters, and of nothing else
    t = sample[0][0]
    assert len(li.gram_ids(t)) == sum(len(t) - n + 1 for n in range(1, 5))
    assert grams(t) == set().union(*(li.gram_ids(t[k : k + n])[-1:].tolist() for n in range(1, 5) for k in range(len(t) - n + 1)))

    def kernel(a, b):
        return len(a & b) / (len(a) * len(b)) ** 0.5

    sets = [grams(t) for t, _ in sample]
    model = li.train([np.array(sorted(s)) for s in sets], [c for _, c in sample], landmarks=5)
    marks = [s for c in "abc" for s in [s for s, (_, d) in zip(sets, sample) if d == c][:5]]
    low = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(low)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.array([[kernel(s, m) for m in marks] for s in sets]) @ root
    phi = np.c_[phi, np.ones(len(phi))]
    target = np.array([[1.0 if d == c else -1.0 for c in "abc"] for _, d in sample])
    solved = np.linalg.solve(phi.T @ phi + li.RIDGE * len(phi) * np.diag([1.0] * (phi.shape[1] - 1) + [1e-6]), phi.T @ target)
    fresh = ["".join(rng.choices(s, k=30)) for s in ("abcde fgh", "abc xyz uvw", "mnopq abc")]
    want = np.c_[np.array([[kernel(grams(t), m) for m in marks] for t in fresh]) @ root, np.ones(3)] @ solved
    assert np.allclose(model.values(fresh), want, atol=1e-3)
    names, scores = model.predict(fresh)
    assert names == ["abc"[k] for k in want.argmax(1)] and np.allclose(scores, np.clip((want.max(1) + 1) / 2, 0, 1), atol=1e-3)


def test_language_id_accuracy(spark):
    from prosemill.llm.language_id import identify

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(spark, d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").selectExpr("avg(cast(lang = lang_pred as int)) a", "count(*) n").first()
    assert got.n > 100 and got.a > 0.97


def test_mixing(spark, rows, docs, empty):
    import math

    from prosemill.llm.mixing import mix

    n = {}
    for r in rows:
        n[r[3]] = n.get(r[3], 0) + 1
    want = {}
    for r in rows:
        rate = len(rows) / len(n) / n[r[3]]
        u = int(hashlib.md5(f"17|{'' if r[0] is None else r[0]}".encode()).hexdigest()[:12], 16) / 2**48
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        want[(r[0], r[1], r[3])] = want.get((r[0], r[1], r[3]), 0) + k
    got = {}
    out = mix(spark, docs).collect()
    for r in out:
        got[(r.doc_id, r.text, r.source)] = got.get((r.doc_id, r.text, r.source), 0) + 1
    assert got == {k: v for k, v in want.items() if v}
    keys = [r.mix_key for r in out]
    assert keys == sorted(keys)
    none = mix(spark, docs, weights={"s1": 1.0, None: 0.0})
    assert {r.source for r in none.select("source").distinct().collect()} <= {"s1"}
    assert mix(spark, empty).count() == 0
    assert mix(spark, docs, weights={"s0": 0.0}).count() == 0


def test_own_names_of_the_operators_may_be_taken(spark):
    from prosemill.llm.line_dedup import dedup_lines
    from prosemill.llm.mixing import mix

    names = ["_doc", "_text", "_drop", "_n_lines", "_n_dropped", "_sha", "doc", "drop", "sha", "DROP_", "_mix_source", "_mix_most", "mix_source", "mix_most", "given", "n", "w", "rate", "most"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in names)
    docs = spark.createDataFrame([(k, "a line that all of them hold\nand one", "s", *range(len(names))) for k in range(3)], schema)
    lines, mixed = dedup_lines(spark, docs), mix(spark, docs, size=4.0)
    assert sorted((r.doc_id, r.n_dropped, r.text) for r in lines.collect()) == [(0, 0, "a line that all of them hold\nand one"), (1, 1, "and one"), (2, 1, "and one")]
    for out in (lines, mixed, dedup_lines(spark, docs, digests=True).join(docs, "doc_id")):
        rows = out.select(*names).collect()
        assert rows and all(tuple(r) == tuple(range(len(names))) for r in rows)


def test_mixing_at_high_rates(spark):
    from prosemill.llm.mixing import mix

    docs = spark.createDataFrame([(k, "t", "rare" if k < 5 else "most") for k in range(4_000)], "doc_id long, text string, source string")
    got = {r["source"]: r["count"] for r in mix(spark, docs, weights={"rare": 0.95, "most": 0.05}).groupBy("source").count().collect()}
    assert abs(got["rare"] - 3_800) < 5 * 3_800**0.5 and abs(got["most"] - 200) < 5 * 200**0.5


def test_fingerprints(spark, rows, docs, empty):
    from prosemill.llm.fingerprints import edited as edit
    from prosemill.llm.fingerprints import fingerprint_pairs, fingerprints, likeness

    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    texts = [r[1] or "" for r in order]
    prints = [fingerprints([t.encode()])[0] for t in texts]
    want = []
    for k, (r, t) in enumerate(zip(order, texts)):
        j = (k + 1) % len(order)
        e = edit(t, texts[j]).encode()
        f = fingerprints([e])[0]
        want.append((r[0], len(t), hashlib.sha256(e).hexdigest(), prints[k], f, likeness(prints[k], f), likeness(prints[k], prints[j])))
    for ranges in (1, 5):
        got = [tuple(r) for r in fingerprint_pairs(spark, docs, ranges=ranges).collect()]
        assert sorted(got, key=key_of) == sorted(want, key=key_of)
    assert fingerprint_pairs(spark, empty).count() == 0


def test_parse_against_its_definition():
    """Runs, coin tossing on lists of bits, and local maxima, symbol by symbol, without arrays of the operator's."""
    import numpy as np
    from prosemill.llm import fingerprints as fp

    def toss(labels, width):
        out = []
        for k, x in enumerate(labels):
            left = labels[k - 1] if k else x ^ (2**width - 1)
            at = next(b for b in range(width) if (x >> b) & 1 != (left >> b) & 1)
            out.append(2 * at + ((x >> at) & 1))
        return out

    def mixed(x):
        x &= 2**64 - 1
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 % 2**64
        x ^= x >> 27
        x = x * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    def level(symbols, byte):
        runs = []
        for x in symbols:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        labels, width = [x for x, _ in runs], 8 if byte else 64
        for _ in range(3 if byte else 4):
            labels = toss(labels, width)
            width = 8
        assert max(labels) < 6 or len(labels) == 1 or not byte
        starts = [k for k in range(len(labels)) if k == 0 or 0 < k < len(labels) - 1 and labels[k - 1] < labels[k] > labels[k + 1]]
        names = []
        for a, z in zip(starts, [*starts[1:], len(labels)]):
            total = z - a
            for k in range(a, z):
                x, n = runs[k]
                name = mixed((x + 1) * 0x9E3779B97F4A7C15) if byte else x
                if n > 1:
                    name = mixed(name + n * 0xD6E8FEB86659FD93)
                total += name * (mixed(1000 + (k - a) % 256) | 1)
            names.append(mixed(total))
        return names

    rng = random.Random(4)
    texts = [words(rng, n).encode() for n in (1, 3, 60, 300)] + [b"a", b"ab", b"aaaa", b"aabbaabb" * 9, bytes(range(256)), "한글 ☃ ß".encode() * 5]
    symbols, starts = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts[:-1]])
    slow = [list(t) for t in texts]
    for k in range(fp.LEVELS):
        symbols, starts = fp.parse(symbols, starts)
        slow = [level(s, k == 0) for s in slow]
        assert [p.tolist() for p in np.split(symbols, starts[1:])] == slow


def test_fingerprint_is_local():
    from prosemill.llm.fingerprints import fingerprints, likeness

    rng = random.Random(1)
    a, b = words(rng, 800), words(rng, 800)
    one, shifted, other = fingerprints([a.encode(), (words(rng, 3) + " " + a).encode(), b.encode()])
    assert likeness(one, one) == 1 and likeness(one, shifted) > 0.85 and likeness(one, other) < 0.5
    assert fingerprints([b"", b"aaaa"])[0] == "" and likeness("", "") == 1


def test_token_counts_and_cache(spark, rows, docs, empty, monkeypatch):
    from prosemill.llm import common
    from prosemill.llm import token_counts as tc
    from prosemill.llm.common import new_path
    from prosemill.llm.token_counts import CACHE_SCHEMA, count_tokens
    from prosemill.llm.tokens import public_path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    want = [(r[0], len((r[1] or "").encode()), n := len(t.encode(r[1] or "", add_special_tokens=False).ids), n > 512) for r in rows]
    cache = new_path(spark, "cache")
    for _ in range(2):
        got = [tuple(r) for r in count_tokens(spark, docs, cache=cache).collect()]
        assert sorted(got, key=key_of) == sorted(want, key=key_of)
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).count()
        assert stored == len({r[1] or "" for r in rows})  # the second run encodes nothing
    assert count_tokens(spark, empty).count() == 0
    few = spark.createDataFrame([(1, "a text"), (2, "a text"), (3, "another"), (4, None)], "doc_id long, text string")
    monkeypatch.setattr(tc, "MOST_BROADCAST", 1)  # missing texts are found by a join
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    assert sorted(tuple(r) for r in count_tokens(spark, few).collect()) == [(1, 6, 2, False), (2, 6, 2, False), (3, 7, 1, False), (4, 0, 0, False)]
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        assert count_tokens(spark, docs, tokenizer=public_path(name)).count() == len(rows)


def test_quick_encoder_gives_the_librarys_ids():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from prosemill.llm.tokens import encoder, public_path

    enc = encoder(public_path("byte_bpe_50k.json"))
    assert enc.quick

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=60) | st.text(alphabet="ab '\n\t<|>endoftxé한1 ", max_size=80))
    def same(t):
        assert enc.ids([t])[0].tolist() == enc.full.encode(t, add_special_tokens=False).ids

    same()


def fewest_bins(lengths, capacity):
    """A lower bound: pieces above half a bin don't meet, small ones fill what is left."""
    best = 0
    for t in range(capacity // 2 + 1):
        large = sum(x > capacity - t for x in lengths)
        half = [x for x in lengths if capacity // 2 < x <= capacity - t]
        small = sum(x for x in lengths if t <= x <= capacity // 2)
        best = max(best, large + len(half) + max(0, -(-(small - (capacity * len(half) - sum(half))) // capacity)))
    return best


def test_packing(spark, rows, docs, empty):
    from prosemill.llm.packing import pack
    from prosemill.llm.tokens import public_path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    got = pack(spark, docs, capacity=128, keep_ids=True).collect()
    bins, by_doc = {}, {}
    for r in got:
        assert len(r.ids) == r.length <= 128
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in r.ids))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    total = 0
    for doc in {r[0] for r in rows}:
        ids = sorted((t.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows if r[0] == doc))
        total += sum(map(len, ids))
        if len(ids) == 1:
            parts = sorted(by_doc[doc], key=lambda r: r.piece)
            assert [x for p in parts for x in p.ids] == ids[0]
            assert [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
            assert all(p.length == 128 for p in parts[1:])
    assert sum(r.length for r in got) == total
    assert len(bins) <= fewest_bins([r.length for r in got], 128) * 1.02 + 2
    assert pack(spark, empty).count() == 0


def test_swaps_empty_bins():
    from collections import Counter

    from prosemill.llm.packing import best_fit, swap_search

    # two bins of 6+3 and 4+... become one by exchange
    bins = swap_search(Counter({(6, 3): 1, (4,): 1, (5, 4): 1, (1,): 1}), 10)
    assert sum(bins.values()) <= 3
    rng = random.Random(5)
    for _ in range(20):
        counts = Counter(rng.randint(1, 64) for _ in range(300))
        first = best_fit(counts, 64)
        better = swap_search(first, 64)
        pieces = Counter()
        for p, n in better.items():
            assert sum(p) <= 64
            for x in p:
                pieces[x] += n
        assert pieces == counts and sum(better.values()) <= sum(first.values())


@pytest.mark.parametrize(("hot", "fan", "pack"), [(3, 256, 4096), (2_000, 256, 4096), (2_000, 5, 4096), (3, 3, 2)])
def test_substring_dedup(spark, rows, docs, empty, monkeypatch, hot, fan, pack):
    """Few hot anchors and many, shards met directly and through buckets."""
    from prosemill.llm import substring_dedup as sd

    monkeypatch.setattr(sd, "CHUNK_BYTES", 6_000)
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "FAN", fan)
    monkeypatch.setattr(sd, "PACK", pack)
    monkeypatch.setattr(sd, "SHARD_BYTES", 4_000)
    first = {}
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        if doc is not None:
            for i in range(len(raw) - 49):
                w = raw[i : i + 50]
                first[w] = min(first.get(w, doc), doc)
    want = []
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if doc is not None and first[raw[i : i + 50]] < doc:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        want.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in sd.dedup_substrings(spark, docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=key_of) == sorted(want, key=key_of)
    assert sum(w[2] for w in want) > 1_000
    assert sd.dedup_substrings(spark, empty).count() == 0


def test_fragments_move_once_and_in_turns(spark, monkeypatch):
    """No query's shuffles hold all that moves, on copies that share every fragment."""
    from prosemill.llm import substring_dedup as sd

    monkeypatch.setattr(sd, "CHUNK_BYTES", 40_000)
    monkeypatch.setattr(sd, "FAN", 4)
    monkeypatch.setattr(sd, "SHARD_BYTES", 40_000)
    rng = random.Random(8)
    texts = [words(rng, 300) for _ in range(120)]
    docs = spark.createDataFrame([(k + 1000 * c, t) for c in range(3) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    seen = spark._jsparkSession.sharedState().statusStore()
    before = seen.executionsCount()
    got = sd.dedup_substrings(spark, docs).select("doc_id", "n_bytes", "n_removed").collect()
    assert all(r.n_removed == (r.n_bytes if r.doc_id >= 1000 else 0) for r in got) and len(got) == 360
    stages = spark.sparkContext._jsc.sc().statusStore()
    moved = []
    for k in range(before, seen.executionsCount()):
        ids = seen.executionsList().apply(k).stages().mkString(",")
        moved.append(sum(stages.lastStageAttempt(int(x)).shuffleWriteBytes() for x in ids.split(",") if x))
    assert max(moved) < 0.5 * sum(moved), moved


def test_fragments_of_one_name_are_compared():
    import numpy as np
    from prosemill.llm import substring_dedup as sd

    text = b"abcdefghij" * 40 + b"0123456789" * 40
    chunk = sd.Chunk(np.array([1], "<i8").tobytes(), np.array([len(text)], "<i8").tobytes(), sd.zstandard.compress(text), 50)
    start, n = np.array([0, 10, 400, 20, 0, 30]), np.array([3, 3, 3, 3, 7, 7])
    new = np.array([True, False, False, False, True, False])  # the third is of other bytes
    assert sd._unlike(chunk, new, start, n).tolist() == [True, True, True, True, False, False]
    assert not sd._unlike(chunk, np.array([True, False]), start[:2], n[:2]).any()


def test_shards_are_alike_in_size():
    import numpy as np
    from prosemill.llm import substring_dedup as sd

    rng = random.Random(3)
    text = words(rng, 30_000).encode()
    chunk = sd.Chunk(np.array([1], "<i8").tobytes(), np.array([len(text)], "<i8").tobytes(), sd.zstandard.compress(text), 50)
    shard = sd._shards(np.unique(chunk.fragments(False)["anchor"]), 16)
    assert np.bincount(shard, minlength=16).max() < 2 * len(shard) / 16


def test_refinement_names_equal_prefixes():
    import numpy as np
    from prosemill.llm.substring_dedup import refine

    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, 4_000).astype(np.uint8)
    text[1_000:1_200] = text[3_000:3_200]
    starts = np.arange(len(text) - 50)
    names = refine(text, starts, 50)
    by = {}
    for s, n in zip(starts, names):
        by.setdefault(text[s : s + 50].tobytes(), set()).add(int(n))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_every_language_is_learned(spark):
    from prosemill.llm.language_id import identify

    rng = random.Random(5)
    rows = []
    for k in range(203):
        letters = [chr(0x4E00 + 40 * k + j) for j in range(12)]
        rows += [(10 * k + j, " ".join("".join(rng.choices(letters, k=4)) for _ in range(12)), f"l{k:03}") for j in range(10 if k < 200 else 9)]
    got = identify(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    lang = {d: name for d, _, name in rows}
    assert {r.lang_pred for r in got} == set(lang.values())
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) > 0.95 * len(rows)


def test_swaps_save_bins_that_best_fit_leaves():
    from collections import Counter

    from prosemill.llm.packing import best_fit, swap_search

    saved = 0
    rng = random.Random(14)
    for _ in range(300):
        counts = Counter(rng.randint(8, 30) for _ in range(rng.randint(20, 60)))
        first = best_fit(counts, 50)
        better = swap_search(first, 50)
        assert sum((Counter({x: n * k for x, k in Counter(p).items()}) for p, n in better.items()), Counter()) == counts
        assert sum(better.values()) <= sum(first.values())
        saved += sum(better.values()) < sum(first.values())
    assert saved > 5


def test_swap_search_leaves_no_exchange_that_helps():
    from collections import Counter

    from prosemill.llm.packing import _better, best_fit, swap_search

    counts = {26: 2, 13: 1, 18: 2, 32: 1, 49: 1, 15: 2, 48: 1, 37: 3, 42: 1, 12: 1, 9: 2, 14: 1, 38: 1, 16: 1}
    bins = swap_search(best_fit(counts, 50), 50)
    under = [p for p in bins if sum(p) < 50]
    assert not [(a, b) for a in under for b in under if sum(a) <= sum(b) and (a != b or bins[a] > 1) and _better(a, b, 50)]
    assert sum((Counter({x: n * k for x, k in Counter(p).items()}) for p, n in bins.items()), Counter()) == counts


def test_swap_search_of_many_patterns_ends():
    from collections import Counter

    from prosemill.llm.packing import _better, best_fit, swap_search

    rng = random.Random(15)
    counts = Counter(rng.randint(200, 1_000) for _ in range(20_000))
    bins = swap_search(best_fit(counts, 1_024), 1_024)
    under = [p for p in bins if sum(p) < 1_024]
    pairs = [(a, b) for a in under for b in under if sum(a) <= sum(b) and (a != b or bins[a] > 1)]
    assert not [x for x in rng.sample(pairs, min(len(pairs), 20_000)) if _better(*x, 1_024)]
