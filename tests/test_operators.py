"""Operators on small tables with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from prosemill.operators import cohort, islands, repeats
from prosemill.operators.metrics import metrics, stats
from prosemill.plans.rules import RULES, load
from prosemill.plans.thresholds import COLUMNS, REGISTRY
from prosemill.sources import readers


def values(spark, text, **params):
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    return {r.metric_id: r.value for r in metrics(df, **params).collect()}


def test_every_document_has_every_metric(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "글입니다.")], "doc_id long, text string")
    got = metrics(df).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in got} == {1, 2, 3} and len({r["count"] for r in got}) == 1
    assert {r.metric_id for r in metrics(df).where("value is null").collect()} == set()


def test_adjacent_predicates(spark):
    assert values(spark, "값을 읽어요. 다시 읽어요. 또 읽어요?")["A8.same_predicate_adjacent"] == 1
    assert values(spark, "값을 읽어요.\n\n다시 읽어요.")["A8.same_predicate_adjacent"] == 0
    assert values(spark, "값을 읽어요. 왜 그럴까요? 다시 읽어요.")["A8.same_predicate_adjacent"] == 0
    assert values(spark, "- 값을 읽어요. 다시 읽어요.")["A8.same_predicate_adjacent"] == 0


def test_rule_scopes(spark):
    v = values(spark, "첫 문장입니다. 결국, 값이 같습니다.\n\n- 결국, 목록\n")
    assert v["A4.summary_start"] == 1 and v["A4.gyeolguk"] == 1
    short = "한계도 여전히 남아 있습니다."
    assert values(spark, short)["G9.empty_challenge"] == 1
    assert values(spark, "아주 길게 이어지는 문장을 앞에 두고 나서 " + short)["G9.empty_challenge"] == 0
    assert values(spark, "\"되요\"라고 씁니다.")["G11.spelling"] == 0
    assert values(spark, "# 되요\n\n| 되요 | b |\n|---|---|\n")["G11.spelling"] == 2


def test_rounding_is_half_even_on_the_exact_value(spark):
    from prosemill.operators.metrics import py_round

    df = spark.createDataFrame([([2.675, 2.345, 0.5, None], [2, 2, 0, 1]), (None, None), ([], [])], "v array<double>, p array<int>")
    assert [r[0] for r in df.select(py_round("v", "p")).collect()] == [[2.67, 2.35, 0.0, None], None, []]


def test_stats(spark):
    df = spark.createDataFrame([("d", "# 제목\n\n하나입니다. 둘입니다.\n\n- 항목 `x`\n")], "doc_id string, text string")
    r = stats(df).first()
    assert (r.chars, r.sentences, r.paragraphs, r.headings, r.list_items, r.title, r.tone) == (13, 2, 1, 0, 1, "제목", "default")


def test_rules_from_a_file(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"patterns": {"A5.style_words": {"regex": ["값"]}, "G8.beyond_simple": {"scope": "all", "regex": ["없음"]}, "A16.source_subject": {"regex": ["^논문"]}, "A4.summary_start": {"regex": ["x"]}, "A4.lesson_end": {"regex": ["y"]}, "A1.np_rather": {"regex": ["z"]}, **{k: {"regex": ["q"]} for k in ("A5.policy_verbs", "A12.progressive", "A13.demonstrative_start", "A14.translationese")}}}))
    rules = load(str(path))
    v = values(spark, "값을 씁니다. 논문은 값을 씁니다.", rules=rules)
    assert v["A5.style_words"] == 2 and v["A16.source_subject"] == 1


def test_registry_is_well_formed(spark):
    ids = [(dict(zip(COLUMNS, r))["metric_id"], dict(zip(COLUMNS, r))["tone"]) for r in REGISTRY]
    assert len(ids) == len(set(ids))
    assert len(RULES) == 54 and sum(len(r.patterns) for r in RULES) == 150


def test_repeat_runs(spark):
    text = "모델은 작습니다. 모델은 빠릅니다. 모델은 정확합니다.\n\n# 절\n\n짧습니다. 모델은 가볍습니다. 아주 짧아요. 정말 짧아요.\n"
    got = {(r.id, r.key.split("\t")[-1], r["count"]) for r in repeats.find_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert ("R3", "모델은", 3) in got and ("R7", "짧아요", 1) in got
    assert {x for x in got if x[0] == "R5"} == {("R5", "1", 4)}


def test_runs(spark):
    df = spark.createDataFrame([(1, k, c) for k, c in enumerate("aabbbca")] + [(2, 0, "a")], "g int, i int, k string")
    got = {(r.g, r.key, r.n, r["first"]) for r in islands.runs(df, ["g"], "i", F.col("k"), 2, {}).collect()}
    assert got == {(1, "a", 2, 0), (1, "b", 3, 2)}


def test_selection_caps_named_authors_after_other_reasons(spark):
    rows = [(k, f"2024-0{k}", "kim", k != 1) for k in range(1, 6)] + [(9, "2024-09", None, True), (8, "2024-08", None, True), (7, "2024-07", "", True)]
    a = spark.createDataFrame(rows, "id long, date string, author string, fine boolean")
    got = {r.id: r.reason for r in cohort.select(a, [("bad", ~F.col("fine"))]).collect()}
    assert got == {1: "bad", 2: None, 3: None, 4: "more than 2 of an author", 5: "more than 2 of an author", 7: None, 8: None, 9: None}


def test_holdout(spark):
    import hashlib

    ids = [f"site-{k}" for k in range(390, 420)]
    df = spark.createDataFrame([(i,) for i in ids], "id string").withColumn("h", cohort.holdout(F.col("id")))
    assert {r.id: r.h for r in df.collect()} == {i: int(hashlib.sha1(i.encode()).hexdigest(), 16) % 5 == 0 for i in ids}


def test_quantiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    groups = {"even": rng.normal(size=3_000), "ties": np.repeat([1.0, 2.0, 5.0], [2_000, 3, 700]), "one": np.array([7.0]), "two": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("even", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    qs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 0.999, "f": 1.0}
    got = {r.g: r for r in cohort.quantiles(df, ["g"], "v", qs, top=F.max("v")).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g].n == len(vs) and got[g].top == vs.max()
        for k, q in qs.items():
            assert got[g][k] == pytest.approx(np.quantile(vs, q), abs=1e-12)


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.draft.md").write_bytes("﻿각\r\n끝".encode())
    (tmp_path / "a" / "x.md").write_text("뒤")
    files = readers.read_text(spark, str(tmp_path), glob="*.md")
    assert {r.text for r in files.collect()} == {"각\n끝", "뒤"}
    r = readers.paired(files, ".draft.md", ".md").where("before <> after").first()
    assert (r.before, r.after) == ("각\n끝", "뒤")
    assert [x.case for x in readers.cases(spark, str(tmp_path), ["x.md", "x.draft.md"]).collect()] == ["a"]
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c")]))
    assert {(r.k, r.v) for r in readers.replaced(old, new, ["k"]).collect()} == {(1, "a"), (2, "c")}
    assert [r.k for r in readers.missing(old, new, "k").collect()] == [1]
    note = "---\nt: 1\n---\nimport x\n<Comp a/>\n본문\n[^1]: 주\n## 참고 자료\n끝"
    out = spark.createDataFrame([(note,)], "n string").select(readers.strip_note(F.col("n"))).first()[0]
    assert out.split() == ["본문"]
    feed = "<item><link>https://a/b-123?x=1</link><title><![CDATA[T]]></title><category><![CDATA[c]]></category></item><item><link>https://a/b-123?x=1</link></item><item><guid isPermaLink=\"false\">https://a/p/0123456789abcdef/</guid><link>l</link></item>"
    r = readers.feed_items(spark.createDataFrame([(feed,)], "xml string")).collect()
    assert {(x.id, x.url, x.title) for x in r if x.title} <= {("b123x1", "https://a/b-123", "T")} and {x.id for x in r} == {"b123x1", "456789abcdef"}


def test_a_source_is_for_short_texts(spark):
    from prosemill.operators.lint import lint
    from prosemill.plans.thresholds import registry

    docs = spark.createDataFrame([("d", "값은 `x`이고 3개입니다.", "It is `x` and 3.")], "doc_id string, text string, source string")
    with pytest.raises(ValueError):
        lint(docs, registry(spark), source="source")
    found = lint(docs, registry(spark), short={}, source="source")
    assert {r.metric_id: r.status for r in found.results.where("metric_id like 'F%'").collect()} == {k: "PASS" for k in ("F1.code_blocks", "F2.inline_code", "F3.urls", "F4.slack_tokens", "F5.numbers", "F6.list_items", "F7.headings", "F8.terms")}


def test_following_rows_in_many_ranges(spark):
    rows = [(k % 3, k * 7, f"v{k}") for k in range(200)] + [(None, 5, "n"), (None, 6, "m")]
    df = spark.createDataFrame(rows, "g int, i int, v string").repartition(4)
    want = {}
    for g in (0, 1, 2, None):
        own = sorted((i, v) for h, i, v in rows if h == g)
        want |= dict(zip([v for _, v in own], [v for _, v in own[1:]] + [None]))
    for ranges in (1, 16):
        assert {r.v: r.next for r in islands.following(df, "g", "i", "v", ranges=ranges).collect()} == want


def test_following_on_the_first_columns_of_a_session():
    import os
    import subprocess
    import sys

    code = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from prosemill.operators import islands
df = spark.createDataFrame([("g", 1, "a"), ("g", 5, "b"), ("h", 2, "c"), ("g", 9, "d")], "g string, i int, v string")
got = islands.following(df, "g", "i", "v", ranges=3).select("v", "next").collect()
assert {r.v: r.next for r in got} == {"a": "b", "b": "d", "c": None, "d": None}, got
"""
    subprocess.run([sys.executable, "-B", "-c", code], check=True, env=dict(os.environ))


def test_corpus_operators_can_be_absent(tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op1') or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
