"""Metrics of terms, sources and verbs, on own sentences."""

import re

import pytest
from pyspark.sql import functions as F

from prosemill.functions import korean as K
from prosemill.operators.terms import ALWAYS, WITH_FACTS, all_metrics, measure, numbers, term_metrics
from prosemill.plans.rules import RULES, by_id

REPORTS = [re.compile(p) for k in ("A14.report_write", "A14.report_write_check") for p in by_id(RULES)[k].patterns]
FACTS = """# 사실

| 원어 | 글에 쓸 표기 | 근거 | 쓰지 않을 표기 | 처음 나올 때 설명 |
|---|---|---|---|---|
| cache | 캐시 | 자료 | 은닉처, store | 자주 쓰는 값을 두는 곳 |
| queue / stack | 큐 / 스택 | 사전 | - | 일반 지식: 12개까지 담는다 |
| node | 노드 | 자료 | 없음 | 설명하지 않음 |

처리량은 1,500건이다.
"""


def of(text, facts=None):
    return measure(text, facts, REPORTS)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("값이 3를 넘습니다.", ["3를"]),
        ("값이 3을 넘습니다. 2를 씁니다.", []),
        ("Llama 3은 큽니다. 값 50%은 큽니다.", ["50%은"]),
        ("서울로 7로 갑니다. 6로 갑니다.", ["6로"]),
        ("수식 $3를$ 안은 보지 않습니다.", []),
    ],
)
def test_number_particles(text, want):
    assert K.wrong_particles(text) == want


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("이 방법을 씁니다.", 1), ("글을 씁니다.", 0), ("로그를 파일에 씁니다.", 0), ("메모리에 값을 씁니다.", 0), ("널리 쓰입니다.", 1), ("시간이 검토에 쓰입니다.", 0),
        ("도구를 쓰고 읽습니다.", 0), ("바로 쓸 수 있습니다.", 1), ("길이를 잽니다.", 1), ("값을 10으로 둡니다.", 1), ("오류를 고칩니다.", 1), ("테스트를 돌립니다.", 1),
        ("하나를 고릅니다.", 1), ("고른 분포를 보입니다.", 0), ("서버가 쓰는 방식입니다.", 1), ("사람이 쓴 글입니다.", 0), ("신경 쓸 수 없습니다.", 0),
    ],
)
def test_native_verbs(text, n):
    assert bool(K.native_verbs(text)) == bool(n)


@pytest.mark.parametrize(("text", "hit"), [("실패라고 봅니다.", True), ("성공한 것으로 봅니다.", True), ("이 값을 오류로 봅니다.", True), ("영역을 주로 봅니다.", False), ("값을 그래프로 봅니다.", False), ("결과를 전체적으로 봅니다.", False)])
def test_judgements(text, hit):
    assert (K.judgement(text) is not None) == hit


def test_approximate_quantities():
    assert K.approximate("수십만 명과 몇백 건, 요청 수만 줄였습니다. 수만 명이 왔습니다.") == ["수십만", "몇백", "수만"]


def test_numbers():
    assert numbers("1,500건과 0.50배, 3개, 7, 042", False) == ["1500", ".5", "3", "42"]
    assert numbers("7과 12", True) == ["7", "12"]


def test_terms_in_two_spellings():
    text = "망막(retina)을 봅니다. 망막은 얇습니다. retina 층이 있습니다."
    assert of(text)["A19.term_mix"] == 1
    assert of("망막(retina)을 봅니다. 망막은 얇습니다.")["A19.term_mix"] == 0
    assert of("다중 버전(MVCC)을 봅니다. 다중 버전은 MVCC 입니다.")["A19.term_mix"] == 0


def test_facts():
    v = of("은닉처를 봅니다. 캐시는 빠릅니다. 큐를 씁니다. 처리량은 1500건이고 12개와 99개가 남습니다. worker 하나와 worker 둘, cache 셋과 cache 넷.", FACTS)
    assert {k: v[k] for k in WITH_FACTS} == {"A19.term_avoid": 1, "A20.term_first": 2, "A20.table_combined_row": 1, "A20.untabled": 1, "A15.unknown_numbers": 2}
    assert not set(WITH_FACTS) & set(of("글입니다."))


def test_terms_introduced_in_lists():
    listed = "수평 세포, 양극 세포, amacrine 세포가 있습니다. 그 층은 얇습니다. "
    assert of(listed + "뒤에서는 amacrine 세포가 빛을 받습니다.")["A20.term_in_list"] == 1
    assert of("수평 세포, 양극 세포, amacrine 세포가 있습니다. 뒤에서는 amacrine 세포가 빛을 받습니다.")["A20.term_in_list"] == 0


def test_abbreviations_and_species():
    assert of("STG는 작습니다. STG를 봅니다. STG가 있습니다.")["A20.abbr_first"] == 1
    assert of("STG(신경절)는 작습니다. STG를 봅니다. STG가 있습니다.")["A20.abbr_first"] == 0
    assert of("USB는 작습니다. USB를 봅니다. USB가 있습니다.")["A20.abbr_first"] == 0
    assert of("C. elegans는 작습니다. C. elegans를 봅니다. *Cancer borealis*는 큽니다.")["A20.species_first"] == 2


def test_bare_authors():
    cites = "Marder (2020)는 값을 쟀습니다. Kim (2021)은 다르게 봤습니다. "
    assert of(cites + "\n\n# 절\n\n저자들은 값이 같다고 합니다.")["A18.bare_author"] == 1
    assert of(cites + "저자들은 값이 같다고 합니다.")["A18.bare_author"] == 0
    assert of("저자들은 값이 같다고 합니다.")["A18.bare_author"] == 0


def test_one_verb_in_two_senses():
    assert of("이 방법을 씁니다. 논문은 값이 같다고 씁니다.")["A21.sseuda_senses"] == 1
    assert of("이 방법을 씁니다.")["A21.sseuda_senses"] == 0


def test_as_tables(spark):
    docs = spark.createDataFrame([(1, "이 방법을 씁니다.", None), (2, None, FACTS)], "doc_id long, text string, facts string")
    got = {}
    for r in term_metrics(docs, facts="facts").collect():
        got.setdefault(r.doc_id, {})[r.metric_id] = r.value
    assert set(got[1]) == set(ALWAYS) and set(got[2]) == set(ALWAYS) | set(WITH_FACTS)
    assert got[1]["A5.native_verbs"] == 1
    every = all_metrics(docs, facts="facts")
    assert every.groupBy("doc_id", "metric_id").count().where(F.col("count") > 1).count() == 0
    assert every.where("chars is null or tone is null").count() == 0
