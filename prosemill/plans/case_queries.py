"""Queries over literal cases: operators on own texts, logs and tables, against results worked out by hand.

Both sides hold the same literals.  Results are rows of subject, name and
value, the value as text, so one comparison serves all kinds of results.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.functions import hangul as H
from prosemill.functions.plan import new_folder
from prosemill.operators import cohort, hits, islands, judging, logs, pairs, repeats, reports, verdict
from prosemill.operators.lint import lint
from prosemill.operators.metrics import metrics, stats
from prosemill.operators.terms import all_metrics
from prosemill.operators.units import units
from prosemill.sources import readers
from prosemill.sources.html import pages_to_markdown

from . import cases
from .registry import query
from .thresholds import _row, registry


def literal(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return str(x)
    return "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    return "select * from (values " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") t({columns})"


def wanted(results: dict[str, dict[str, object]]) -> str:
    """SQL for {subject: {name: value}}."""
    rows = [(s, n, None if v is None else str(v).lower() if isinstance(v, bool) else str(v)) for s, named in results.items() for n, v in named.items()]
    return values(rows, "subject, name, value").replace("null)", "null::varchar)")


def told(df: DataFrame, subject: Column | str, *names: str) -> DataFrame:
    """subject, name, value of the named columns."""
    subject = F.col(subject) if isinstance(subject, str) else subject
    named = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names))
    return df.select(subject.cast("string").alias("subject"), F.inline(named))


def _metric_sql(rows) -> str:
    return values([(d, m, float(v)) for d, *_, named in rows for m, v in named.items()], "doc_id, metric_id, value").replace("select *", "select doc_id, metric_id, value::double as value")


def _only(found: DataFrame, rows) -> DataFrame:
    asked = found.sparkSession.createDataFrame([(d, m) for d, *_, named in rows for m in named], "doc_id string, metric_id string")
    return found.join(F.broadcast(asked), ["doc_id", "metric_id"], "left_semi").select("doc_id", "metric_id", "value")


@query(_metric_sql(cases.MEASURED))
def measured_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules in their scopes, and metrics of style, on texts made for them."""
    docs = spark.createDataFrame([(d, t) for d, t, _ in cases.MEASURED], "doc_id string, text string")
    return _only(metrics(docs), cases.MEASURED)


@query(_metric_sql(cases.TERMED))
def term_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of terms, sources and verbs, with and without a fact sheet, from the same parse as all others."""
    docs = spark.createDataFrame([(d, t, f) for d, t, f, _ in cases.TERMED], "doc_id string, text string, facts string")
    return _only(all_metrics(docs, facts="facts"), cases.TERMED)


@query(values([(c, k, *b) for c, _, found in cases.BLOCKS for k, b in enumerate(found)], "doc_id, nth, type, text, line, level, list_id, depth"))
def block_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of Markdown texts: kinds, lines, levels, lists."""
    docs = spark.createDataFrame([(c, t) for c, t, _ in cases.BLOCKS], "doc_id string, text string")
    u = units(docs).where("kind in ('block', 'heading')")
    return u.select("doc_id", F.col("block").alias("nth"), "type", F.coalesce("raw", "text").alias("text"), "line", "level", "list_id", "depth")


@query(values([(c, k, s) for c, _, found in cases.SENTENCES for k, s in enumerate(found)], "doc_id, nth, text"))
def sentence_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of texts with decimals, abbreviations, quotes and no stop."""
    docs = spark.createDataFrame([(c, t) for c, t, _ in cases.SENTENCES], "doc_id string, text string")
    return units(docs).where("kind = 'sentence'").select("doc_id", "nth", "text")


@query(values([(c, clean, masked, bold) for c, _, clean, masked, bold in cases.INLINES], "doc_id, text, masked, bold"))
def inline_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([(c, t) for c, t, *_ in cases.INLINES], "doc_id string, text string")
    return units(docs).where("kind = 'block'").select("doc_id", "text", "masked", "bold")


REFERENCES = "# 참고 자료\n본문 하나.\n## 참고할 설정\n본문 둘.\n## 2. 참고 문헌 및 링크\n- 항목\n### 다음\n끝."


@query(values([("본문 하나.", False, 1, "heading", 0), ("본문 둘.", False, 2, "heading", 1), ("항목", True, 3, "heading", None), ("끝.", False, 4, "heading", 2)], "text, in_refs, section, after, para"))
def reference_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies in a list of references, and the running numbers of sections and paragraphs."""
    docs = spark.createDataFrame([("d", REFERENCES)], "doc_id string, text string")
    return units(docs).where("kind = 'sentence'").select("text", "in_refs", "section", "after", "para")


@query(values([(c, md) for c, _, md in cases.PAGES], "page_id, markdown"))
def html_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages to Markdown, without what stands after a page's end."""
    return pages_to_markdown(spark.createDataFrame([(c, h) for c, h, _ in cases.PAGES], "page_id string, html string")).select("page_id", "markdown")


HANGUL_CASES = {
    "triads": {"값, 이름, 순서를 봅니다": True, "값, 이름을 봅니다": False, "값, 3개, 순서": False, "API, 이름, 순서": False, "값, 아주 긴 이름이 여기 있음, 순서": False},
    "commas": {"1,000개, 값": 1, "값, 이름, 줄": 2, "12,34": 1},
    "numbers": {"1,500건과 0.50배, 3개, 7, 042": "[1500, .5, 3, 42]", "값은 1.20%이고 1,000,000건": "[1.2, 1000000]"},
    "visible": {"값 ⟦C⟧ 이름.\n줄": 5, "": 0},
    "last words": {"서버가 요청을 처리한다(그림 1).": "처리한다", "값은 ⟦C⟧": "값은", "(설명)": ""},
    "stems": {"서버에서는": "서버", "값을": "값을", "모델보다": "모델"},
    "tokens": {"“값”을 (봅니다). ⟦U⟧ - 끝!": "[값”을, 봅니다, -, 끝]"},
    "syllables": {"습": "[17, 18, 9]", "a": "[-1, -1, -1]", "가": "[0, 0, 0]"},
    "protected": {"값 3개와 API(설명), “말”": "[3, api, 말, 설명]"},
    "squeezed": {" 값  을\t봅니다 ": "값 을 봅니다"},
}


@query(wanted(HANGUL_CASES))
def hangul_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of Korean sentences and words, each on texts of its own."""
    t = F.col("name")
    found = {
        "triads": H.is_triad(t),
        "commas": H.comma_count(t),
        "numbers": H.number_keys(t, drop_bare_digits=True),
        "visible": H.visible_chars(t),
        "last words": H.last_word(t),
        "stems": H.strip_particle(t),
        "tokens": H.tokens(t),
        "syllables": F.array(H.final(t), H.vowel(t), H.initial(t)),
        "protected": pairs.protected(t),
        "squeezed": logs.squeezed(t),
    }
    out = []
    for subject, column in found.items():
        texts = spark.createDataFrame([(k,) for k in HANGUL_CASES[subject]], "name string")
        out.append(texts.select(F.lit(subject).alias("subject"), "name", column.cast("string").alias("value")))
    return _union(out)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


REPEAT_ORDER = [("many", "R7", 1, True), ("many", "R3", 2, True), ("many", "R5", 3, True)]


@query(values(REPEAT_ORDER, 'doc_id, id, "rank", shown'))
def repeat_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which candidates of repetition are shown."""
    docs = spark.createDataFrame([a for a in cases.REPEAT_ARTICLES if a[0] == "many"], "doc_id string, text string")
    return repeats.find_repeats(docs).select("doc_id", "id", "rank", "shown")


STATUSES = (
    ("upper at the limit", {"kind": "upper", "pass_max": 1.0, "warn_max": 2.0}, 1.0, 100, "PASS"),
    ("upper at the next", {"kind": "upper", "pass_max": 1.0, "warn_max": 2.0}, 2.0, 100, "WARN"),
    ("upper beyond", {"kind": "upper", "pass_max": 1.0, "warn_max": 2.0}, 2.1, 100, "FAIL"),
    ("upper without the next", {"kind": "upper", "pass_max": 1.0}, 2.1, 100, "OVER"),
    ("lower", {"kind": "lower", "pass_min": 1.0, "warn_min": 0.5}, 0.5, 100, "WARN"),
    ("lower beyond", {"kind": "lower", "pass_min": 1.0, "warn_min": 0.5}, 0.4, 100, "FAIL"),
    ("range", {"kind": "range", "pass_lo": 1.0, "pass_hi": 2.0, "warn_lo": 0.0, "warn_hi": 3.0}, 2.5, 100, "WARN"),
    ("range beyond", {"kind": "range", "pass_lo": 1.0, "pass_hi": 2.0, "warn_lo": 0.0, "warn_hi": 3.0}, 3.5, 100, "FAIL"),
    ("gate", {"kind": "gate"}, 1.0, 100, "GATE"),
    ("gate of a short text", {"kind": "gate", "min_chars": 1000}, 1.0, 100, "GATE"),
    ("check", {"kind": "check"}, 1.0, 100, "CHECK"),
    ("info", {"kind": "info"}, 9.0, 100, "INFO"),
    ("short text", {"kind": "upper", "pass_max": 1.0, "warn_max": 2.0, "min_chars": 1000}, 9.0, 100, "INFO"),
    ("poisson", {"kind": "poisson", "rate_per_1k": 0.245, "pass_q": 0.95, "warn_q": 0.995}, 2.0, 3000, "PASS"),
    ("poisson next", {"kind": "poisson", "rate_per_1k": 0.245, "pass_q": 0.95, "warn_q": 0.995}, 4.0, 3000, "WARN"),
    ("poisson beyond", {"kind": "poisson", "rate_per_1k": 0.245, "pass_q": 0.95, "warn_q": 0.995}, 5.0, 3000, "FAIL"),
)


@query(wanted({c: {"status": s} for c, *_, s in STATUSES}))
def status_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at and beyond limits of each kind."""
    m = spark.createDataFrame([("d", c, v, n, "default") for c, _, v, n, _ in STATUSES], "doc_id string, metric_id string, value double, chars long, tone string")
    return told(verdict.judge(m, registry(spark, [_row(c, **limits) for c, limits, *_ in STATUSES])), "metric_id", "status")


_VALUE = "metric_id string, value double, chars long, grp string, site string, holdout boolean"
CALIBRATED = [("n", float(v), 1000, "default", "s", False) for v in (1, 2, 3, 10)] + [("n", 99.0, 1000, "default", "s", True), ("n", 99.0, 1000, "other", "s", False), ("n", 50.0, 1000, "default", "left out", False)]
CALIBRATED += [("x_ratio", v, 1000, "default", "s", False) for v in (0.1, 0.2)] + [("p", 1.0, 500, "default", "s", False), ("p", 2.0, 1500, "casual", "s", False)]
CALIBRATED += [("r_ratio", x / 10, 1000, "default", "s", False) for x in range(11)] + [("t", v, 1000, g, "s", False) for v, g in ((1.0, "casual"), (3.0, "casual"), (9.0, "default"))]


@query(
    wanted(
        {
            "n": {"kind": "upper", "pass_max": "9.0", "warn_max": "11.0", "n": 4, "p50": "2.5"},
            "x_ratio": {"kind": "lower", "pass_min": "0.105", "warn_min": "0.08", "n": 2, "p50": "0.15"},
            "p": {"kind": "poisson", "rate_per_1k": "1.5", "n": 2, "p50": "1.5"},
            "r_ratio": {"kind": "range", "pass_lo": "0.05", "pass_hi": "0.95", "warn_lo": "0.0", "warn_hi": "1.2", "n": 11, "p50": "0.5"},
            "t": {"kind": "upper", "pass_max": "3.0", "warn_max": "4.0", "n": 2, "p50": "2.0"},
            "g": {"kind": "gate"},
        }
    )
)
def calibration_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New limits of every kind; held-out values, other groups, other tones and a site that a limit leaves out don't count."""
    v = spark.createDataFrame(CALIBRATED, _VALUE)
    limits = registry(spark, [_row("n", "upper", pass_max=0.0, exclude_site="left out"), _row("x_ratio", "lower", pass_min=0.0), _row("p", "poisson", rate_per_1k=0.0), _row("r_ratio", "range"), _row("t", "upper", pass_max=0.0, tone="casual"), _row("g", "gate")])
    got = cohort.calibrate(v, limits).withColumn("p50", F.round("p50", 6))
    return told(got, "metric_id", "kind", "pass_max", "warn_max", "pass_min", "warn_min", "rate_per_1k", "pass_lo", "pass_hi", "warn_lo", "warn_hi", "n", "p50").where("value is not null")


HELD = [("a", "m", 0.5), ("a", "k", 9.0), ("b", "m", 3.0), ("b", "k", 0.0), ("c", "m", 1.5), ("c", "k", 0.0)]


@query(
    wanted(
        {
            "all": {"held": 3, "passed": 2, "rate": "0.666667"},
            "m": {"PASS": 1, "WARN": 1, "FAIL": 1, "weight": 4},
            "k": {"PASS": 2, "WARN": 0, "FAIL": 1, "weight": 3},
        }
    )
)
def pass_rate_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out articles that pass, policy limits left out, and how often each metric fails."""
    m = spark.createDataFrame([(d, k, v, 2000, "default") for d, k, v in HELD], "doc_id string, metric_id string, value double, chars long, tone string")
    limits = registry(spark, [_row("m", "upper", pass_max=1.0, warn_max=2.0), _row("k", "upper", pass_max=1.0, warn_max=2.0, policy=True)])
    rate = cohort.pass_rate(m, limits).withColumn("rate", F.round("rate", 6))
    return told(rate, F.lit("all"), "held", "passed", "rate").unionByName(told(cohort.status_histogram(verdict.judge(m, limits)), "metric_id", "PASS", "WARN", "FAIL", "weight"))


_ARTICLES = [
    ("a", "2020-01-01", "kim", None, True, 2000), ("b", "2020-01-02", "kim", None, True, 2000), ("c", "2020-01-03", "kim", None, True, 2000), ("d", "2024-09-01", "lee", None, True, 2000), ("e", "2020-01-01", "lee", "404", True, 2000),
    ("f", "2020-01-01", "lee", None, False, 2000), ("g", "2020-01-01", "lee", None, True, 200), ("h", "2023-05-01", "lee", None, True, 2000), ("i", "2025-05-01", "lee", None, True, 2000), ("j", "2020-01-01", "lee", None, True, 500),
    ("k", "2020-01-01", "lee", None, True, 2000), ("l", "2020-01-01", "lee", None, True, 2000), ("m", "2020-01-05", None, None, True, 2000), ("n", "2020-01-06", None, None, True, 2000), ("o", "2020-01-07", None, None, True, 2000),
]


@query(
    wanted(
        {
            "a": {"reason": None, "group": "default", "period": "pre2023", "tone_share": "0.975"},
            "b": {"reason": None, "group": "default", "period": "pre2023", "tone_share": "0.975"},
            "c": {"reason": "more than 2 of an author", "group": None, "period": "pre2023", "tone_share": "0.975"},
            "d": {"reason": cohort.GAP, "group": None, "period": "gap", "tone_share": "0.975"},
            "e": {"reason": cohort.NO_TEXT, "group": None, "period": "pre2023", "tone_share": "0.975"},
            "f": {"reason": cohort.NOT_TECHNICAL, "group": None, "period": "pre2023", "tone_share": "0.975"},
            "g": {"reason": cohort.NO_KOREAN, "group": None, "period": "pre2023", "tone_share": "0.975"},
            "h": {"reason": cohort.LATE, "group": None, "period": "2023-2024H1", "tone_share": "0.975"},
            "i": {"reason": None, "group": "drift-default", "period": "drift", "tone_share": "0.975"},
            "j": {"reason": cohort.LITTLE_KOREAN, "group": None, "period": "pre2023", "tone_share": "0.975"},
            "k": {"reason": cohort.SHORT, "group": None, "period": "pre2023", "tone_share": "0.975"},
            "l": {"reason": cohort.MIXED, "group": None, "period": "pre2023", "tone_share": "0.5"},
            **{k: {"reason": None, "group": "default", "period": "pre2023", "tone_share": "0.975"} for k in "mno"},
        }
    )
)
def selection_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles left out for each reason, at most two of a named author, and the groups of the rest."""
    meta = spark.createDataFrame([(r[0], "s", r[1], "t", *r[2:]) for r in _ARTICLES], "id string, site string, date string, title string, author string, error string, technical boolean, hangul long")
    st = spark.createDataFrame([(r[0], 2000, 20 if r[0] == "k" else 40) for r in _ARTICLES], "doc_id string, chars long, sentences long")
    cl = spark.createDataFrame([(r[0], {"HAPNIDA": 20, "HAEYO": 20} if r[0] == "l" else {"HAPNIDA": 39, "HAERA": 1}) for r in _ARTICLES], "doc_id string, classes map<string,bigint>")
    return told(cohort.measure(meta, st, cl).withColumn("tone_share", F.round("tone_share", 6)), "id", "reason", "group", "period", "tone_share")


STATED = "# 제목\n\n하나입니다. 둘입니다.\n\n- 항목 `x`\n\n## 절\n\n값을 씁니다. 왜 그럴까요? 값을 썼어요.\n"


@query(wanted({"d": {"chars": 31, "sentences": 5, "paragraphs": 2, "headings": 1, "list_items": 1, "title": "제목", "tone": "default", "HAPNIDA": 3, "HAEYO": 1, "Q_KKAYO": 1, "D_COP": 2, "C_PAST": 1}}))
def document_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a document, its tone, and how its sentences end."""
    docs = spark.createDataFrame([("d", STATED)], "doc_id string, text string")
    ends = hits.ending_maps(docs)
    ends = ends.select("doc_id", *(F.col("classes")[k].alias(k) for k in ("HAPNIDA", "HAEYO", "Q_KKAYO")), *(F.col("buckets")[k].alias(k) for k in ("D_COP", "C_PAST")))
    return told(stats(docs), "doc_id", "chars", "sentences", "paragraphs", "headings", "list_items", "title", "tone").unionByName(told(ends, "doc_id", "HAPNIDA", "HAEYO", "Q_KKAYO", "D_COP", "C_PAST"))


HIT_TEXT = "# 되요\n\n결국, 값이 같습니다. 값은 30입니다. 짧다.\n\n| a | 되요 |\n|---|---|\n\n표 뒤 문장입니다. 결국, 끝났습니다.\n\n- 항목 이름\n\n## 참고 자료\n\n결국, 목록입니다.\n"


@query(
    values([("G11.spelling", 1, 1, "되요"), ("G11.spelling", 2, 5, "되요"), ("A4.gyeolguk", 1, 3, "결국,"), ("A4.gyeolguk", 2, 8, " 결국,".strip()), ("A4.gyeolguk", 3, 14, "결국,")], "metric_id, ord, line, match")
)
def hit_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where rules hit: sentences in order, then headings, then table rows."""
    h = hits.rule_hits(spark.createDataFrame([("d", HIT_TEXT)], "doc_id string, text string"))
    return h.where("metric_id in ('G11.spelling', 'A4.gyeolguk')").select("metric_id", "ord", "line", F.trim("match").alias("match"))


@query(wanted({"A4.gyeolguk": {"first": "[3]", "rest": "[8, 14]"}, "G11.spelling": {"first": "[1]", "rest": "[5]"}}))
def shown_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hit of a metric whole, of the others the lines."""
    h = hits.rule_hits(spark.createDataFrame([("d", HIT_TEXT)], "doc_id string, text string")).where("metric_id in ('G11.spelling', 'A4.gyeolguk')")
    line = lambda c: F.transform(c, lambda x: x["line"])
    return told(hits.shown(h, most=1).select("metric_id", line("hits").alias("first"), line("more").alias("rest")), "metric_id", "first", "rest")


@query(wanted({"서버 요청 처리 지연 시간이 깁니다.": {"longest": 4}}))
def noun_stack_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([("d", "서버 요청 처리 지연 시간이 깁니다. 서버의 요청을 처리합니다.")], "doc_id string, text string")
    return told(hits.noun_stacks(d), "text", "longest")


@query(wanted({"A4.gyeolguk": {"changed": 1, "kept": 0, "after": 0}, "INFO.we": {"changed": 0, "kept": 1, "after": 1}}))
def changed_hit_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in sentences that a revision changed and kept, and after it."""
    p = spark.createDataFrame([("p", "결국, 값이 같습니다. 저희 팀은 큽니다.", "값이 같습니다. 저희 팀은 큽니다.")], "pair_id string, before string, after string")
    return told(hits.changed_hits(p), "metric_id", "changed", "kept", "after")


@query(
    wanted(
        {
            "p": {"kept": 1, "changed": 1, "written": 2, "lost_numbers": "[30]", "new_numbers": "[40]", "unsupported": "[]", "must_fix": True, "spelling": True},
            "same": {"kept": 1, "changed": 0, "written": 0, "lost_numbers": "[]", "new_numbers": "[]", "unsupported": None, "must_fix": False, "spelling": False},
            "new": {"kept": 0, "changed": 1, "written": 1, "lost_numbers": "[]", "new_numbers": "[1500]", "unsupported": "[1500]", "must_fix": False, "spelling": False},
        }
    )
)
def revision_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts and revisions: sentences, numbers, and statuses that got worse."""
    rows = [("p", "값은 30입니다. 모델은 빠릅니다.", "값은 40입니다. 모델은 빠릅니다. 되요.", "값은 40이다"), ("same", "하나입니다.", "하나입니다.", None), ("new", "값이 큽니다.", "값이 1,500건입니다.", "값은 크다")]
    c = pairs.compare(spark.createDataFrame(rows, "pair_id string, before string, after string, facts string"), registry(spark))
    c = c.withColumn("spelling", F.array_contains("failing", "G11.spelling"))
    return told(c, "pair_id", "kept", "changed", "written", "lost_numbers", "new_numbers", "unsupported", "must_fix", "spelling")


def _log_lines() -> list[tuple[str, int, str]]:
    at = "2024-01-01T00:00:{:02d}Z"

    def use(message: str, second: int) -> dict:
        call = {"type": "tool_use", "id": f"t{second}", "name": "Bash", "input": {"command": f"step{second}"}}
        return {"type": "assistant", "timestamp": at.format(second), "message": {"id": message, "usage": {"input_tokens": 10}, "content": [call]}}

    lines = [{"type": "system", "subtype": "init", "model": "m", "timestamp": at.format(0)}, use("a", 10), use("a", 20), use("b", 30), use("c", 40)]
    lines.append({"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t20", "is_error": True}]}})
    lines.append({"type": "system", "subtype": "compact_boundary"})
    lines.append({"type": "item.completed", "item": {"type": "command_execution", "command": "python lint.py go && python3 tone.py", "exit_code": 0}})
    lines += 2 * [{"type": "item.completed", "item": {"type": "error", "message": "Failed to load skill x\nrest"}}]
    return [("run", k, t) for k, t in enumerate([*map(json.dumps, lines), "not json", "[1]"])]


@query(
    wanted(
        {
            "t10": {"nth": 0, "error": False, "name": "Bash"}, "t20": {"nth": 1, "error": True, "name": "Bash"}, "t30": {"nth": 2, "error": False, "name": "Bash"}, "t40": {"nth": 3, "error": False, "name": "Bash"},
            "from 20 to 40": {"input_share": "0.666667", "minutes": "0.333333", "time_share": "0.5"}, "from 30": {"input_share": "0.333333", "minutes": "0.166667", "time_share": "0.25"},
            "run": {"command": "python lint.py go && python3 tone.py", "exit_code": 0, "message": "Failed to load skill x", "compactions": 1}, "lint.py": {"action": "go"}, "tone.py": {"action": ""},
        }
    )
)
def log_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls, shares of tokens and time, commands, load errors and script calls of a run's log."""
    ev = logs.events(spark.createDataFrame(_log_lines(), "file string, line_no int, json string"))
    call = F.col("c.input")
    share = lambda name, *ends: told(logs.usage_share(ev, *ends).select(*(F.round(c, 6).alias(c) for c in ("input_share", "minutes", "time_share"))), F.lit(name), "input_share", "minutes", "time_share")
    commands = logs.command_events(ev)
    return _union(
        [
            told(logs.tools(ev), "id", "nth", "error", "name"),
            share("from 20 to 40", call.contains("step20"), call.contains("step40")),
            share("from 30", call.contains("step30")),
            told(commands, "run", "command", "exit_code"),
            told(logs.load_errors(ev), "run", "message"),
            told(judging.compactions(ev), "run", "compactions"),
            told(judging.checker_calls(commands, ("lint.py", "tone.py")), "script", "action"),
        ]
    )


_CALLS = (
    ("Write", {"file_path": "/w/article.md"}), ("Read", {"file_path": "/w/article.md"}), ("Bash", {"command": "python revise.py start article.md"}), ("Read", {"file_path": "C:\\w\\article.candidates.md"}), ("Task", {"prompt": "read how-to-review.md"}),
    ("Edit", {"file_path": "/w/article.md"}), ("Bash", {"command": "python revise.py check article.md"}), ("Bash", {"command": "python revise.py check article.md"}),
)


@query(wanted({"r": {"start": 2, "repeats": 3, "check": 6, "checks": 2, "edits_after_start": 1, "agents": 1, "reviewers": 1, "review_read": False, "read_before_repeats": True}}))
def run_step_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which steps a run took, in which order, and what it read and edited."""
    calls = spark.createDataFrame([("r", k, n, json.dumps(i)) for k, (n, i) in enumerate(_CALLS)], "run string, nth int, name string, input string")
    r = judging.run_steps(calls, script="revise.py", target="article.md", review="how-to-review.md", listing=".candidates.md")
    return told(r, "run", "start", "repeats", "check", "checks", "edits_after_start", "agents", "reviewers", "review_read", "read_before_repeats")


@query(
    wanted(
        {
            "a": {"result": "current", "post": 1, "pre": 1, "tie": 1}, "b": {"result": "split"}, "c": {"result": "tie"},
            "items": {"unchanged": 2, "flips": 1, "pre_only": 1, "post_only": 1, "flip_rate": "0.5"},
            "some": {"jaccard": "0.333333", "both": "[a b]"}, "none": {"jaccard": "1.0", "both": "[]"},
            "one  two": {"found": True}, "three": {"found": False}, "": {"found": False}, "0 missing": {"score": 2}, "2 missing": {"score": 1}, "3 missing": {"score": 0},
        }
    )
)
def vote_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes in both orders, sections, items judged twice, agreement of runs, quotes and scores."""
    v = spark.createDataFrame([("a", 0, "X"), ("a", 1, "Y"), ("b", 0, "X"), ("b", 1, "X"), ("c", 0, "tie"), ("c", 1, "tie")], "case_id string, vote_order int, winner string")
    s = spark.createDataFrame([("a", "s", 0, "A"), ("a", "s", 1, "A"), ("a", "t", 0, "tie")], "case_id string, section string, vote_order int, winner string")
    item = "sentence string, prev string, verdict string"
    pre, post = ([("a", "", "x"), ("b", "a", "x"), ("c", "b", "x")], [("a", "", "x"), ("b", " a", "y"), ("d", "b", "x")])
    terms = spark.createDataFrame([("some", ["A  b", "c"], ["a b", "d"]), ("none", [], [])], "k string, a array<string>, b array<string>")
    terms = terms.select("k", logs.agreement(F.col("a"), F.col("b")).alias("x")).select("k", F.round("x.jaccard", 6).alias("jaccard"), "x.both")
    answers = spark.createDataFrame([("d", "one  two"), ("d", "three"), ("d", "")], "doc_id string, q string")
    texts = spark.createDataFrame([("d", "zero one\ntwo")], "doc_id string, text string")
    scores = spark.createDataFrame([(0,), (2,), (3,)], "n int").select(F.concat("n", F.lit(" missing")).alias("k"), logs.term_score(F.col("n"), F.lit(True)).alias("score"))
    return _union(
        [
            told(logs.pair_votes(v), "case_id", "result"),
            told(logs.section_votes(s), "case_id", "post", "pre", "tie"),
            told(logs.align_items(spark.createDataFrame(pre, item), spark.createDataFrame(post, item)), F.lit("items"), "unchanged", "flips", "pre_only", "post_only", "flip_rate"),
            told(terms, "k", "jaccard", "both"),
            told(logs.found_quotes(answers, texts, key="doc_id", quote="q"), "q", "found"),
            told(scores, "k", "score"),
        ]
    )


@query(
    wanted(
        {
            "(도입)": {"body": "앞"}, "하나": {"body": "a\n```\n## 아님\n```"}, "둘": {"body": "b"},
            "by place/0": {"title": "(도입)", "before": "", "after": "앞"}, "by place/2": {"title": "둘", "before": "b", "after": "c"}, "by title/2": {"title": "둘", "before": "b", "after": "c"},
            "n1": {"passed": True}, "n2": {"passed": True}, "n3": {"passed": True}, "n4": {"passed": False},
        }
    )
)
def section_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections outside fences, those that a revision changed (matched by place or by title), and declared checks."""
    d = spark.createDataFrame([(1, "앞\n## 하나 ##\na\n```\n## 아님\n```\n## 둘\nb")], "doc_id int, text string")
    two = [("by place", "## 하나\na\n## 둘\nb", "앞\n## 하나\n a\n## 둘\nc"), ("by title", "앞\n## 하나\na\n## 둘\nb\n## 셋\n", "앞\n## 둘\nx\n## 하나\na\n## 둘\nc")]
    changed = logs.changed_sections(spark.createDataFrame(two, "pair_id string, before string, after string"))
    checks = [("c", "n1", "regex", "bad", "not_contains"), ("c", "n2", "regex", "(?i)GOOD", "contains"), ("c", "n3", "file_exists", "a\\.md$", None), ("c", "n4", "tool_used", "x", "Bash")]
    graded = logs.grade(
        spark.createDataFrame(checks, "case_id string, name string, type string, pattern string, match string"),
        spark.createDataFrame([("c", "good")], "case_id string, text string"),
        spark.createDataFrame([("c", "/w/a.md")], "case_id string, path string"),
        spark.createDataFrame([("c", "Bash", "y")], "case_id string, name string, input string"),
    )
    return _union([told(logs.sections(d), "title", "body"), told(changed, F.concat_ws("/", "pair_id", "nth"), "title", "before", "after"), told(graded, "name", "passed")])


CLARITY = [
    ("결국, 값이 같습니다.", "되요", "(절의 첫 문장)", True, False, False), ("값은 30입니다.", "되요", "결국, 값이 같습니다.", False, True, False),
    ("표 뒤 문장입니다.", "되요", "(바로 앞은 표)", True, False, False), ("결국, 끝났습니다.", "되요", "표 뒤 문장입니다.", False, False, True),
]


@query(values([(k, *r) for k, r in enumerate(CLARITY, 1)], 'n, sentence, heading, prev, "first", numeric, "check"'))
def clarity_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What judges of clarity are asked: first sentences, numbers and flagged ones, with what stands before."""
    d = spark.createDataFrame([("d", HIT_TEXT)], "doc_id string, text string")
    flagged = spark.createDataFrame([("d", "결국, 끝났습니다.")], "doc_id string, text string")
    return judging.clarity_items(d, flagged).select("n", "sentence", "heading", "prev", "first", "numeric", "check")


@query(
    wanted(
        {
            "clarity": {"checked": 3, "answered": 2, "dependent": 1, "first_dependent": 1, "numeric_dependent": 0, "rate": "0.5", "per_1k": "2.0"},
            "awkward": {"answered": 3, "awkward": 2, "per_1k": "4.0", "types": "[R=1, ?=1]"},
            "claims": {"claims": 2, "unsupported": 1, "general_knowledge": 1, "quote_not_found": 1},
            "style": {"valid": 1, "invalid": 1, "per_1k": "2.0"},
            "quantile": {"v": "3.0"}, "median": {"n": 3, "x": "2.0"}, "A-x": {"other": "A-old"}, "B-x": {"other": "B0-old"}, "lint": {"verdict": "FAIL", "issues": "[FAIL A=1.0]"},
            "items": {"n": 97, "parts": 2, "first": "되요"},
        }
    )
)
def score_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What judges' answers come to, and cases of two iterations matched."""
    make = spark.createDataFrame
    chars = make([("d", 500)], "doc_id string, chars long")
    items = make([("d", 1, True, False), ("d", 2, False, True), ("d", 3, False, False)], "doc_id string, n int, first boolean, numeric boolean")
    clear = judging.clarity_scores(items, make([("d", 1, "needs_prev"), ("d", 2, "self_contained")], "doc_id string, n int, verdict string"), chars)
    awkward = judging.awkward_scores(make([("d", 1, "awkward", "R"), ("d", 2, "awkward", None), ("d", 3, "fine", None)], "doc_id string, n int, verdict string, type string"), chars)
    awkward = awkward.withColumn("types", F.array(*(F.concat(F.lit(f"{k}="), F.col("by_type")[k].cast("string")) for k in ("R", "?"))))
    texts = make([("c", "one two", 500)], "case_id string, text string, chars long")
    claims = judging.fidelity_tallies(make([("c", "unsupported", "one"), ("c", "general_knowledge", "gone")], "case_id string, verdict string, quote string"), texts)
    style = judging.style_scores(make([("a", 1, "one"), ("a", 1, "x")], "name string, run int, quote string"), make([("a", "one two", 500)], "name string, text string, chars long"))
    quantile = make([([3.0, 1.0, 2.0, 9.0],)], "v array<double>").select(judging.floor_quantile(F.col("v"), 0.75).alias("v"))
    median = judging.medians(make([("g", 1.0), ("g", 2.0), ("g", 9.0)], "g string, x double"), "g", ["x"])
    matched = judging.matched_cases(make([("A-x",), ("B-x",), ("C-x",)], "case string"), make([("A-old",), ("B0-old",), ("C1-old",)], "case string"))
    res = make([("d", "A", 1.0, "FAIL"), ("d", "B", 0.0, "PASS")], "doc_id string, metric_id string, value double, status string")
    sheet = make([("d", HIT_TEXT + "\n# 끝말\n" + "\n".join(f"이것은 문장 {k}번입니다.\n" for k in range(90)))], "doc_id string, text string")
    asked = judging.language_items(sheet).agg(F.count("*").alias("n"), F.max("part").alias("parts"), F.min_by("sentence", "n").alias("first"))
    return _union(
        [
            told(clear, F.lit("clarity"), "checked", "answered", "dependent", "first_dependent", "numeric_dependent", "rate", "per_1k"),
            told(awkward, F.lit("awkward"), "answered", "awkward", "per_1k", "types"),
            told(claims, F.lit("claims"), "claims", "unsupported", "general_knowledge", "quote_not_found"),
            told(style, F.lit("style"), "valid", "invalid", "per_1k"),
            told(quantile, F.lit("quantile"), "v"),
            told(median, F.lit("median"), "n", "x"),
            told(matched, "case", "other"),
            told(judging.lint_summaries(res, verdict.verdicts(res)), F.lit("lint"), "verdict", "issues"),
            told(asked, F.lit("items"), "n", "parts", "first"),
        ]
    )


TERM_TEXT = "서버는 캐시와 큐를 둡니다. 캐시는 자주 쓰는 값을 둡니다. 큐는 줄을 세웁니다."
_TERMS = [
    (1, "캐시", "서버는 캐시와 큐를  둡니다.", "자주 쓰는 값을 둡니다", []), (1, "큐", "서버는 캐시와 큐를 둡니다.", "", ["what", "name"]), (1, "서버", "서버는 캐시와 큐를 둡니다.", "답하는 기계", ["what"]), (1, "노드", "노드는 셋입니다.", "", ["what"]),
    (2, "큐 ", "서버는 캐시와 큐를 둡니다.", None, ["name"]), (2, "캐시", "캐시는 자주", None, ["what"]),
]


@query(
    wanted(
        {
            "1": {"terms": 3, "missing": 2, "invalid_quotes": 1, "invalid_explanations": 1, "missing_terms": "[서버, 큐]", "score": 1, "missing_ratio": "0.666667", "missing_per_1k": "40.0", "what": 2, "name": 1},
            "2": {"terms": 2, "missing": 2, "invalid_quotes": 0, "invalid_explanations": 0, "missing_terms": "[캐시, 큐 ]", "score": 0, "missing_ratio": "1.0", "missing_per_1k": "40.0", "what": 1, "name": 1},
            "3": {"terms": 0, "missing": 0, "invalid_quotes": 0, "invalid_explanations": 0, "missing_terms": None, "score": 2, "missing_ratio": None, "missing_per_1k": "0.0", "what": None, "name": None},
            "both": {"jaccard": "0.333333", "both": "[큐]"},
            "a": {"J5": "1.0", "J8": "4.0"}, "b": {"J5": "3.0", "J8": None}, "median": {"J5": "2.0", "J8": "4.0"},
            "flagged": {"passed": True}, "unflagged": {"passed": False},
        }
    )
)
def terms_summary_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a judge of terms, what two of them agree on, a table of runs, and a check with flags."""
    make = spark.createDataFrame
    terms = make([("d", *r) for r in _TERMS], "doc_id string, run int, term string, quote string, explanation string, missing array<string>")
    runs = make([("d", 1, True), ("d", 2, False), ("d", 3, True)], "doc_id string, run int, defined boolean")
    got = judging.terms_summaries(terms, runs, make([("d", TERM_TEXT, 50)], "doc_id string, text string, chars long"))
    got = got.withColumns({"missing_ratio": F.round("missing_ratio", 6), "what": F.col("by_missing")["what"], "name": F.col("by_missing")["name"]})
    both = judging.run_agreement(got).withColumn("jaccard", F.round("jaccard", 6))
    table = judging.run_table(make([("a", "J5", 1.0), ("a", "J8", 4.0), ("b", "J5", 3.0)], "case string, name string, value double"), "case", ["J5", "J8"])
    checks = make([("c", "flagged", "regex", "^two$", "contains", "m"), ("c", "unflagged", "regex", "^two$", "contains", None)], "case_id string, name string, type string, pattern string, match string, flags string")
    none = make([], "case_id string, name string, path string, input string")
    graded = logs.grade(checks, make([("c", "one\ntwo\n")], "case_id string, text string"), none, none)
    return _union(
        [
            told(got, "run", "terms", "missing", "invalid_quotes", "invalid_explanations", "missing_terms", "score", "missing_ratio", "missing_per_1k", "what", "name"),
            told(both, F.lit("both"), "jaccard", "both"),
            told(table, "case", "J5", "J8"),
            told(graded, "name", "passed"),
        ]
    )


SHORT_TEXT = "규칙에 의해 정해집니다. 가장 유명한 도구 중 하나입니다. 문서를 봐 주세요. 문서를 보세요. 이 값인가요?"


@query(
    wanted(
        {
            "article": {"off_tone": "3.0", "translationese": "FAIL", "lengths": 10, "verdict": "FAIL", "code": 1},
            "short": {"off_tone": "0.0", "translationese": "FAIL", "lengths": 0, "verdict": "FAIL", "code": 1},
            "short and good": {"off_tone": "0.0", "translationese": "PASS", "lengths": 0, "verdict": "PASS", "code": 0},
        }
    )
)
def short_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts: requests and questions are of the formal tone, rates are judged as numbers of hits, some limits are left out."""
    limits = registry(spark, [_row("G4.off_tone", "gate"), _row("A14.translationese_per_1k", "upper", pass_max=0.0, warn_max=1.0), *(_row(f"A8.x{k}", "upper", pass_max=0.0) for k in range(10))])
    docs = spark.createDataFrame([("article", SHORT_TEXT), ("short", SHORT_TEXT), ("short and good", "값을 봅니다. 문서를 보세요. 이 값인가요?")], "doc_id string, text string")
    profile = {"drop": ["A8."], "counts": {"A14.translationese_per_1k": (0, 1)}}
    long = lint(docs.where("doc_id = 'article'"), limits, tone="default")
    short = lint(docs.where("doc_id <> 'article'"), limits, tone="default", short=profile)
    out = []
    for found, own in ((long, limits), (short, verdict.short_profile(limits, **profile))):
        seen = found.results.groupBy("doc_id").agg(
            F.max(F.when(F.col("metric_id") == "G4.off_tone", F.col("value"))).alias("off_tone"),
            F.max(F.when(F.col("metric_id") == "A14.translationese_per_1k", F.col("status"))).alias("translationese"),
        )
        lengths = own.where("metric_id like 'A8.%'").count()
        out.append(told(seen.join(found.verdicts, "doc_id").withColumn("lengths", F.lit(lengths)), "doc_id", "off_tone", "translationese", "lengths", "verdict", "code"))
    return _union(out)


REPORT_LINES = ("[GATE] G11.spelling: 2", "line 1 «되요»", "1: 1 candidates", "| 1 | - | a/b |")


@query(wanted({x: {"there": True} for x in REPORT_LINES}))
def report_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text reports and Markdown tables."""
    d = spark.createDataFrame([("d", HIT_TEXT)], "doc_id string, text string")
    text = reports.document_report("d", verdict.judge(metrics(d), registry(spark)), hits.shown(hits.rule_hits(d)), stats(d))
    r = repeats.find_repeats(spark.createDataFrame([(1, "값을 읽어요. 다시 읽어요.")], "doc_id int, text string"))
    whole = "\n".join([text, reports.repeat_report(r, 1), reports.markdown_table(spark.createDataFrame([(1, None, "a|b")], "x int, y double, z string"))])
    return told(spark.createDataFrame([(x, x in whole) for x in REPORT_LINES], "line string, there boolean"), "line", "there")


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file at a path of any file system that Spark knows."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


NOTE = "---\nt: 1\n---\nimport x\n<Comp a/>\n본문\n[^1]: 주\n## 참고 자료\n끝"
FEED = (
    "<item><link>https://a/b-123?x=1</link><title><![CDATA[T]]></title><category><![CDATA[c]]></category><dc:creator><![CDATA[kim]]></dc:creator></item>"
    "<item><guid isPermaLink=\"false\">https://a/p/0123456789abcdef/</guid><link>l</link></item>"
)


@query(
    wanted(
        {
            "a/x.draft.md": {"text": "각\n끝"}, "a/x.md": {"text": "뒤"}, "x": {"before": "각\n끝", "after": "뒤"}, "a": {"case": "a"},
            "log 0": {"json": "{\"a\": 1}"}, "log 2": {"json": "x"}, "k1": {"v": "one"}, "k2": {"v": "two"}, "1": {"new": "a", "missing": 1}, "2": {"new": "c"},
            "note": {"body": "본문"}, "b123x1": {"url": "https://a/b-123", "title": "T", "author": "kim", "tags": "[c]"}, "456789abcdef": {"url": "l", "title": "", "author": "", "tags": "[]"}, "written": {"rows": 2, "parts": 2},
        }
    )
)
def reader_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written and read: texts, log lines, JSON lists, folders with required files, pairs, notes, feeds, tables replaced by key."""
    root = new_folder(spark, "cases")
    for name, text in (("t/a/x.draft.md", "\ufeff각\r\n끝"), ("t/a/x.md", "뒤"), ("t/b/x.md.txt", "no"), ("log/run.jsonl", '{"a": 1}\n\nx\n'), ("json/list.json", '[{"k": "k1", "v": "one"},\n {"k": "k2", "v": "two"}]')):
        _put(spark, f"{root}/{name}", text)
    files = readers.read_text(spark, f"{root}/t", glob="*.md")
    short = lambda c, n: F.array_join(F.slice(F.split(c, "/"), -n, n), "/")
    pair = readers.paired(files, ".draft.md", ".md").where("before <> after")
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c")]))
    readers.write(old, f"{root}/out", form="json", by=["k"])
    back = spark.read.json(f"{root}/out")
    note = spark.createDataFrame([(NOTE,)], "n string").select(F.trim(readers.strip_note(F.col("n")), F.lit("\n ")).alias("body"))
    items = readers.feed_items(spark.createDataFrame([(FEED,)], "xml string"))
    return _union(
        [
            told(files, short("doc_id", 2), "text"),
            told(pair, short("stem", 1), "before", "after"),
            told(readers.cases(spark, f"{root}/t", ["x.md", "x.draft.md"]), "case", "case"),
            told(readers.read_lines(spark, f"{root}/log"), F.concat(F.lit("log "), F.col("line_no").cast("string")), "json"),
            told(readers.read_json(spark, f"{root}/json"), "k", "v"),
            told(readers.replaced(old, new, ["k"]).withColumnRenamed("v", "new"), "k", "new"),
            told(readers.missing(old, new, "k").withColumn("missing", F.col("k")), "k", "missing"),
            told(note, F.lit("note"), "body"),
            told(items, "id", "url", "title", "author", "tags"),
            told(back.agg(F.count("*").alias("rows"), F.count_distinct("k").alias("parts")), F.lit("written"), "rows", "parts"),
        ]
    )


@query(wanted({"a": {"next": "b"}, "b": {"next": "d"}, "c": {"next": None}, "d": {"next": None}}))
def successor_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("g", 1, "a"), ("g", 5, "b"), ("h", 2, "c"), ("g", 9, "d")], "g string, i int, v string")
    return told(islands.following(rows, "g", "i", "v", ranges=3), "v", "next")


@query(wanted({"a": {"place": 1}, "c": {"place": 2}, "all": {"n": 2, "same": True}}))
def control_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dedupe that keeps the first, and a control sample that a seed fixes."""
    rows = spark.createDataFrame([(k, f"v{k}") for k in range(50)], "k int, v string")
    one, two = (cohort.control_sample(d, "k", 2, 5) for d in (rows, rows.orderBy(F.desc("k"))))
    both = one.join(two, "k", "left_semi").agg(F.count("*").alias("n"), (F.count("*") == 2).alias("same"))
    runs = islands.runs(spark.createDataFrame([(1, k, c) for k, c in enumerate("aabcc")], "g int, i int, k string"), ["g"], "i", F.col("k"), 2, {})
    place = F.when(F.col("first") == 0, 1).otherwise(2)
    return _union([told(runs.withColumn("place", place), "key", "place"), told(both, F.lit("all"), "n", "same")])
