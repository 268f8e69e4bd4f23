"""Hits, judges' items and answers, run steps, reports, short texts."""

from pyspark.sql import functions as F

from prosemill.operators import cohort, hits, judging, reports, repeats, verdict
from prosemill.operators.metrics import metrics, stats
from prosemill.plans.thresholds import registry

TEXT = "# 되요\n\n결국, 값이 같습니다. 값은 30입니다. 짧다.\n\n| a | 되요 |\n|---|---|\n\n표 뒤 문장입니다. 결국, 끝났습니다.\n\n- 항목 이름\n\n## 참고 자료\n\n결국, 목록입니다.\n"


def test_long_hits_are_cut(spark):
    long = "결국 " + "값을 " * 100 + "봅니다."
    r = hits.rule_hits(spark.createDataFrame([(1, long)], "doc_id int, text string")).where("metric_id = 'A4.gyeolguk'").first()
    assert len(r.text) == 160


def test_endings(spark):
    d = spark.createDataFrame([(1, "값을 씁니다. 값을 썼습니다. 왜 그럴까요? 이름.")], "doc_id int, text string")
    m = hits.ending_maps(d).first()
    assert m.classes == {"HAPNIDA": 2, "Q_KKAYO": 1, "NOUN": 1} and m.buckets["D_PAST"] == 1
    t = spark.createDataFrame([(1, m.classes)], "doc_id int, classes map<string,bigint>").select(cohort.tone_group(F.col("classes")).alias("t")).first().t
    assert (t.tone, t.share) == ("default", 1.0)


def test_style_words_of_the_fact_sheet_do_not_count(spark):
    d = spark.createDataFrame([(1, "구조적 문제입니다. 혁신적 도구입니다.", "구조적 분석"), (2, "구조적 문제입니다.", None)], "doc_id int, text string, facts string")
    got = {r.doc_id: r.value for r in metrics(d, facts="facts").where("metric_id = 'A5.style_words'").collect()}
    assert got == {1: 1.0, 2: 1.0}


def test_script_calls(spark):
    s = ("lint.py", "tone.py")
    assert judging.script_calls("python3 a/lint.py --json x && cat tone.py", s) == [{"script": "lint.py", "action": "--json"}]
    assert judging.script_calls("bash -lc 'python lint.py x; python3.13 tone.py y'", s) == [{"script": "lint.py", "action": "x"}, {"script": "tone.py", "action": "y"}]
    assert judging.script_calls("python 'unclosed", s) == []
    df = spark.createDataFrame([("r", 1, "python lint.py go")], "run string, line_no int, command string")
    assert [(r.script, r.action) for r in judging.checker_calls(df, s).collect()] == [("lint.py", "go")]


def test_short_texts(spark):
    limits = verdict.short_profile(registry(spark), drop=["A8.", "A5.native_verbs"], counts={"A14.translationese_per_1k": (0, 1)})
    ids = {r.metric_id for r in limits.collect()}
    assert not any(i.startswith("A8.") for i in ids) and "A5.native_verbs" not in ids and "A9.list_ratio" in ids
    d = spark.createDataFrame([(1, "규칙에 의해 정해집니다. 가장 유명한 도구 중 하나입니다.")], "doc_id int, text string")
    m = verdict.as_counts(metrics(d), hits.rule_hits(d), ["A14.translationese_per_1k"])
    assert verdict.judge(m, limits).where("metric_id = 'A14.translationese_per_1k'").first().status == "FAIL"
    assert verdict.judge(m, limits).where("metric_id like 'A8.%'").count() == 0


def test_reports(spark):
    d = spark.createDataFrame([("d", TEXT), ("e", "")], "doc_id string, text string")
    res = verdict.judge(metrics(d), registry(spark))
    text = reports.document_report("d", res, hits.shown(hits.rule_hits(d)), stats(d))
    assert "[GATE] G11.spelling: 2" in text and "line 1 «되요»" in text and "PASS" not in text
    r = repeats.find_repeats(spark.createDataFrame([(1, "값을 읽어요. 다시 읽어요.")], "doc_id int, text string"))
    assert reports.repeat_report(r, 1).splitlines()[0] == "1: 1 candidates"
    table = reports.markdown_table(spark.createDataFrame([(1, None, "a|b")], "x int, y double, z string"))
    assert table == "| x | y | z |\n|---|---|---|\n| 1 | - | a/b |"


