"""Registered queries of the prose engine, with the SQL that gives the same rows.

Three kinds: measures of the given tables that don't depend on a language;
Korean and Markdown cases that both sides hold as literals; and whole-table
runs of the kernels, which SQL can't express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosemill.functions import hangul as H
from prosemill.functions.plan import spread
from prosemill.operators import cohort, islands, logs, pairs, repeats, verdict
from prosemill.operators.metrics import any_of, metrics, stats
from prosemill.operators.terms import all_metrics, term_metrics
from prosemill.operators.units import sentences
from prosemill.sources.html import pages_to_markdown

from . import cases
from .registry import query
from .rules import RULES
from .thresholds import registry

FLAT_MARK = "\u0001"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose every row is work for a kernel or for many patterns."""
    return spread(table(spark, sf_dir, name))


def flat_sentences(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, pos, s: text cut after stops that white space follows."""
    cut = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"([.?!…])\s+", "$1" + FLAT_MARK), FLAT_MARK)
    cut = F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")
    return docs.select("doc_id", *keep, F.posexplode(cut).alias("pos", "s"))


FLAT_SQL = """sents as (
  select doc_id, lang, source, generate_subscripts(c, 1) - 1 as pos, unnest(c) as s from (
    select doc_id, lang, source, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.?!…])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as c from documents
  )
)"""


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and sentence measures of each document."""
    n = F.length("s")
    return flat_sentences(docs, "lang", "source").groupBy("doc_id", "lang", "source").agg(
        F.count("*").alias("n_sentences"),
        (F.sum(F.regexp_count("s", F.lit("[,，]"))) / F.count("*")).alias("commas"),
        F.avg(n).alias("len_mean"),
        (F.stddev_pop(n) / F.avg(n)).alias("len_cv"),
        (F.count_if(n >= 80) / F.count("*")).alias("long_ratio"),
    )


PROFILE_SQL = f"""with {FLAT_SQL},
prof as (
  select doc_id, lang, source, count(*) as n_sentences,
    sum(len(regexp_extract_all(s, '[,，]')))::double / count(*) as commas,
    avg(length(s)) as len_mean, stddev_pop(length(s)) / avg(length(s)) as len_cv,
    count(*) filter (where length(s) >= 80)::double / count(*) as long_ratio
  from sents group by doc_id, lang, source
)"""


@query(
    PROFILE_SQL
    + """
select lang, count(*) as n_docs, sum(n_sentences)::bigint as n_sentences,
  round(quantile_cont(len_mean, 0.05), 6) as mean_p05, round(quantile_cont(len_mean, 0.5), 6) as mean_p50, round(quantile_cont(len_mean, 0.95), 6) as mean_p95,
  round(quantile_cont(len_cv, 0.5), 6) as cv_p50, round(quantile_cont(commas, 0.95), 6) as commas_p95, round(quantile_cont(long_ratio, 0.5), 6) as long_p50
from prof group by lang"""
)
def sentence_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence measures by language: per-document rates, then exact quantiles of each cohort."""
    p = profile(texts(spark, sf_dir, "documents"))
    named = F.array(*(F.struct(F.lit(c).alias("m"), F.col(c).alias("v")) for c in ("len_mean", "len_cv", "commas", "long_ratio")))
    long = p.select("lang", "n_sentences", F.inline(named))
    q = cohort.quantiles(long, ["lang", "m"], "v", {"p05": 0.05, "p50": 0.5, "p95": 0.95}, total=F.sum("n_sentences"))
    pick = lambda m, c, name: F.round(F.max(F.when(F.col("m") == m, F.col(c))), 6).alias(name)
    return q.groupBy("lang").agg(
        F.max("n").alias("n_docs"), F.max("total").alias("n_sentences"),
        pick("len_mean", "p05", "mean_p05"), pick("len_mean", "p50", "mean_p50"), pick("len_mean", "p95", "mean_p95"),
        pick("len_cv", "p50", "cv_p50"), pick("commas", "p95", "commas_p95"), pick("long_ratio", "p50", "long_p50"),
    )


@query(PROFILE_SQL + " select doc_id, n_sentences, round(commas, 6) as commas, round(len_mean, 6) as len_mean, round(len_cv, 6) as len_cv, round(long_ratio, 6) as long_ratio from prof")
def sentence_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile(texts(spark, sf_dir, "documents"))
    return p.select("doc_id", "n_sentences", *(F.round(c, 6).alias(c) for c in ("commas", "len_mean", "len_cv", "long_ratio")))


@query(
    f"""with {FLAT_SQL},
o as (select doc_id, array_to_string(w[1:2], ' ') as opener from (select doc_id, string_split_regex(s, '\\s+') as w from sents) where len(w) >= 2),
n as (select doc_id, opener, count(*) as n from o group by all)
select doc_id, max(n) as opener_repeat, min(opener) filter (where n = m) as opener from (select *, max(n) over (partition by doc_id) as m from n) group by doc_id"""
)
def opener_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the most frequent first two words open a sentence; ties by the openers' order."""
    w = F.split("s", r"\s+")
    o = flat_sentences(texts(spark, sf_dir, "documents")).where(F.size(w) >= 2).select("doc_id", F.concat_ws(" ", F.slice(w, 1, 2)).alias("opener"))
    n = o.groupBy("doc_id", "opener").agg(F.count("*").alias("n")).withColumn("m", F.max("n").over(Window.partitionBy("doc_id")))
    return n.where("n = m").groupBy("doc_id").agg(F.max("n").alias("opener_repeat"), F.min("opener").alias("opener"))


@query(
    f"""with {FLAT_SQL},
k as (select doc_id, pos, string_split_regex(s, '\\s+')[1] as key from sents),
g as (select *, row_number() over (partition by doc_id order by pos) - row_number() over (partition by doc_id, key order by pos) as run from k)
select doc_id, key, count(*) as n, min(pos)::integer as first from g group by doc_id, key, run having count(*) >= 2"""
)
def opener_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of sentences that open with the same word."""
    s = flat_sentences(texts(spark, sf_dir, "documents"))
    return islands.runs(s, ["doc_id"], "pos", F.split("s", r"\s+")[0], 2, {})


@query(
    f"""with {FLAT_SQL},
w as (select doc_id, pos, length(s) as n, regexp_extract(s, '(\\S+)$', 1) as word from sents),
l as (select *, lag(word) over (partition by doc_id order by pos) as before from w)
select doc_id, count(*) filter (where word = before) as same_last_word, count(*) filter (where n < 35) as short from l group by doc_id"""
)
def same_last_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring sentences that end in the same word."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    s = flat_sentences(texts(spark, sf_dir, "documents")).withColumn("word", F.regexp_extract("s", r"(\S+)$", 1))
    s = s.withColumn("before", F.lag("word").over(w))
    return s.groupBy("doc_id").agg(F.count_if(F.col("word") == F.col("before")).alias("same_last_word"), F.count_if(F.length("s") < 35).alias("short"))


@query(
    """select source, sum(len(regexp_extract_all(text, '[,，]')))::bigint as hits, sum(length(regexp_replace(text, '\\s', '', 'g')))::bigint as chars,
  round(sum(len(regexp_extract_all(text, '[,，]'))) * 1000.0 / sum(length(regexp_replace(text, '\\s', '', 'g'))), 6) as per_1k,
  count(*) filter (where len(regexp_extract_all(text, '[,，]')) > 0) as articles_with, count(*) as articles, max(len(regexp_extract_all(text, '[,，]')))::bigint as most
from documents group by source"""
)
def pooled_comma_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commas per 1,000 visible characters of a source: a ratio of sums."""
    d = table(spark, sf_dir, "documents").select("source", F.regexp_count("text", F.lit("[,，]")).cast("long").alias("value"), F.length(F.regexp_replace("text", r"\s", "")).cast("long").alias("chars"))
    return cohort.pooled_rates(d, ["source"]).withColumn("per_1k", F.round("per_1k", 6))


@query(
    """select source, count(*) as n, count(*) filter (where h) as held from (
  select source, list_sum(list_transform(string_split(sha1(doc_id::varchar), ''), lambda d: case when d = '' then 0 else instr('0123456789abcdef', d) - 1 end)) % 5 = 0 as h from documents
) group by source"""
)
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the documents, by SHA-1 of the id."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(cohort.holdout(F.col("doc_id"))).alias("held"))


SELECT_SQL = """with r as (
  select doc_id, lang, source, case when text is null or trim(text) = '' then 'no text' when n_chars < 300 then 'below 300 characters' when regexp_matches(text, '[0-9]{6}') then 'long numbers' end as reason from documents
),
c as (select *, row_number() over (partition by lang, source, reason is null order by doc_id) as place from r),
s as (select doc_id, lang, source, case when reason is null and place > 2 then 'more than 2 of an author' else reason end as reason from c)"""


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = [
        ("no text", F.col("text").isNull() | (F.trim("text") == "")),
        ("below 300 characters", F.col("n_chars") < 300),
        ("long numbers", F.col("text").rlike("[0-9]{6}")),
    ]
    return cohort.select(table(spark, sf_dir, "documents"), reasons, author="source", by=["lang"], order=["doc_id"])


@query(SELECT_SQL + " select doc_id, reason, reason is null as included from s")
def capped_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason to leave a document out, then at most two of a source and language."""
    return _selected(spark, sf_dir).select("doc_id", "reason", "included")


@query(SELECT_SQL + " select coalesce(reason, 'included') as reason, lang, count(*) as n from s group by all")
def exclusion_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("included")).alias("reason"), "lang").agg(F.count("*").alias("n"))


@query(
    """with p as (select page_id, regexp_extract_all(html, '<(/?)(h1|p|li|a|script)\\b', 2) as t, regexp_extract_all(html, 'https?://[^\\s)>\\]`"''<]+') as u, html from pages)
select page_id, len(list_filter(t, lambda x: x = 'p'))::integer as p, len(list_filter(t, lambda x: x = 'a'))::integer as a, len(list_distinct(u))::integer as urls, regexp_extract(html, '<h1>([^<]*)', 1) as title from p"""
)
def page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.regexp_extract_all("html", F.lit(r"<(/?)(h1|p|li|a|script)\b"), F.lit(2))
    urls = F.regexp_extract_all("html", F.lit(pairs.LINK), F.lit(0))
    n = lambda k: F.size(F.filter(tags, lambda t: t == k))
    return table(spark, sf_dir, "pages").select("page_id", n("p").alias("p"), n("a").alias("a"), F.size(F.array_distinct(urls)).alias("urls"), F.regexp_extract("html", "<h1>([^<]*)", 1).alias("title"))


@query(
    """with t as (select conv_id, turn, role, length(text) as n, lag(role) over (partition by conv_id order by turn) as before from conversations)
select conv_id, count(*) as turns, round(sum(n) filter (where role = 'assistant')::double / sum(n), 6) as assistant_share,
  count(*) filter (where role = before) as same_role, max(n)::integer as longest
from t group by conv_id"""
)
def conversation_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A role's share of a conversation's characters, and turns that follow one of the same role."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").withColumn("n", F.length("text")).withColumn("before", F.lag("role").over(w))
    return t.groupBy("conv_id").agg(F.count("*").alias("turns"), F.round(F.sum(F.when(F.col("role") == "assistant", F.col("n"))) / F.sum("n"), 6).alias("assistant_share"), F.count_if(F.col("role") == F.col("before")).alias("same_role"), F.max("n").alias("longest"))


@query(
    """with e as (select *, json_extract(props, '$.k')::bigint as k from events),
f as (select user_id, min(ts) as start, max(ts) filter (where event_type = 'purchase') as last from (select * from e where event_type in ('signup', 'purchase')) group by user_id),
b as (select user_id, min(ts) filter (where event_type = 'signup') as start, max(ts) filter (where event_type = 'purchase') as stop, min(ts) as first, max(ts) as last from e group by user_id),
j as (select e.user_id, e.k, e.ts >= b.start and e.ts <= b.stop as inside, b.* exclude (user_id) from e join b on e.user_id = b.user_id)
select user_id, sum(k)::bigint as total, coalesce(sum(k) filter (where inside), 0)::bigint as within,
  round(epoch_us(any_value(stop))::double / 1000000 - epoch_us(any_value(start))::double / 1000000, 3) as seconds
from j group by user_id"""
)
def event_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies between a user's first signup and last purchase."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    w = Window.partitionBy("user_id")
    at = lambda kind: F.when(F.col("event_type") == kind, F.col("ts"))
    e = e.withColumns({"start": F.min(at("signup")).over(w), "stop": F.max(at("purchase")).over(w)})
    inside = F.col("ts").between(F.col("start"), F.col("stop"))
    seconds = lambda c: F.unix_micros(F.to_timestamp_ltz(F.first(c))) / F.lit(1e6)
    return e.groupBy("user_id").agg(F.sum("k").alias("total"), F.coalesce(F.sum(F.when(inside, F.col("k"))), F.lit(0)).alias("within"), F.round(seconds("stop") - seconds("start"), 3).alias("seconds"))


@query(
    """with s as (select source, list(distinct l.doc_id) filter (where quality = 1) as a, list(distinct l.doc_id) filter (where toxic = 0) as b from labels l join documents d on l.doc_id = d.doc_id group by source)
select source, round(case when len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) = 0 then 1.0 else len(list_intersect(coalesce(a, []), coalesce(b, [])))::double / len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) end, 6) as jaccard from s"""
)
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity of two label sets by source; two empty sets agree."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    marked = lambda c: F.max(F.coalesce(c, F.lit(False)))
    d = j.groupBy("source", "doc_id").agg(marked(F.col("quality") == 1).alias("a"), marked(F.col("toxic") == 0).alias("b"))
    s = d.groupBy("source").agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") | F.col("b")).alias("either"))
    return s.select("source", F.round(F.when(F.col("either") > 0, F.col("both") / F.col("either")).otherwise(1.0), 6).alias("jaccard"))


@query(
    """with d as (select doc_id, text, lead(text) over (partition by source order by doc_id) as other from documents),
n as (select doc_id, list_distinct(regexp_extract_all(text, '\\d+(?:[.,]\\d+)*')) as a, list_distinct(regexp_extract_all(other, '\\d+(?:[.,]\\d+)*')) as b from d where other is not null)
select doc_id, len(list_filter(a, lambda x: not list_contains(b, x)))::integer as lost, len(list_filter(b, lambda x: not list_contains(a, x)))::integer as new from n"""
)
def lost_and_new_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a document that its source's next one lacks, and the reverse: two anti-joins as array differences."""
    nums = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", nums("text").alias("a"))
    d = islands.following(d, "source", "doc_id", "a").withColumnRenamed("next", "b").where("b is not null")
    return d.select("doc_id", F.size(F.array_except("a", "b")).alias("lost"), F.size(F.array_except("b", "a")).alias("new"))


JUDGE_SQL = (
    PROFILE_SQL
    + """,
m as (select doc_id, unnest(['commas', 'len_cv', 'long_ratio']) as metric_id, unnest([commas, len_cv, long_ratio]) as value from prof),
s as (select doc_id, metric_id, case
  when metric_id = 'commas' then case when value <= 0.88 then 'PASS' when value <= 1.5 then 'WARN' else 'FAIL' end
  when metric_id = 'len_cv' then case when value >= 0.37 then 'PASS' else 'OVER' end
  else case when value between 0.065 and 0.6 then 'PASS' when value between 0.01 and 0.8 then 'WARN' else 'FAIL' end end as status from m)"""
)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile(texts(spark, sf_dir, "documents"))
    named = F.array(*(F.struct(F.lit(k).alias("metric_id"), F.col(k).alias("value")) for k in ("commas", "len_cv", "long_ratio")))
    m = p.select("doc_id", F.lit(2000).alias("chars"), F.lit("default").alias("tone"), F.inline(named))
    from .thresholds import _row

    rows = [_row("commas", "upper", pass_max=0.88, warn_max=1.5), _row("len_cv", "lower", pass_min=0.37), _row("long_ratio", "range", pass_lo=0.065, pass_hi=0.6, warn_lo=0.01, warn_hi=0.8)]
    return verdict.judge(m, registry(spark, rows))


@query(JUDGE_SQL + " select metric_id, status, count(*) as n from s group by all")
def judged_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics joined with limits: upper, lower without a WARN limit, range."""
    return _judged(spark, sf_dir).groupBy("metric_id", "status").agg(F.count("*").alias("n"))


@query(JUDGE_SQL + " select doc_id, count(*) filter (where status = 'FAIL') as fail, count(*) filter (where status = 'WARN') as warn, case when count(*) filter (where status = 'FAIL') = 0 then 'PASS' else 'FAIL' end as verdict from s group by doc_id")
def document_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.verdicts(_judged(spark, sf_dir)).select("doc_id", "fail", "warn", "verdict")


@query(
    PROFILE_SQL
    + """,
v as (select lang as grp, commas, list_sum(list_transform(string_split(sha1(doc_id::varchar), ''), lambda d: case when d = '' then 0 else instr('0123456789abcdef', d) - 1 end)) % 5 = 0 as held from prof)
select 'commas' as metric_id, round(quantile_cont(commas, 0.95), 3) as pass_max, greatest(round(quantile_cont(commas, 0.95), 3), round(greatest(quantile_cont(commas, 0.99), max(commas)) * 1.2, 3)) as warn_max, count(*) as n
from v where not held and grp in ('en', 'de')"""
)
def calibrated_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new upper limit from percentiles of the calibration groups, holdout left out."""
    from .thresholds import _row

    p = profile(texts(spark, sf_dir, "documents"))
    v = p.select(F.lit("commas").alias("metric_id"), F.col("commas").alias("value"), F.lit(2000).alias("chars"), F.col("lang").alias("grp"), F.col("source").alias("site"), cohort.holdout(F.col("doc_id")).alias("holdout"))
    return cohort.calibrate(v, registry(spark, [_row("commas", "upper", pass_max=0.88)]), groups=("en", "de")).select("metric_id", "pass_max", "warn_max", "n")


@query("select lang, source, count(*) as n from documents group by lang, source")
def language_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each source has in each language."""
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query(
    "select * from (pivot (select lang, quality, l.doc_id from labels l join documents d on l.doc_id = d.doc_id) on quality in (0, 1) using count(doc_id) group by lang) t(lang, low, high)"
)
def language_by_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents of each language, a column for each quality."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").withColumn("grp", F.col("quality").cast("string"))
    return cohort.by_group(j, ["0", "1"], F.count("doc_id"), rows="lang").na.fill(0).withColumnsRenamed({"0": "low", "1": "high"})


POISSON_SQL = """with recursive d as (select doc_id, n_chars * 0.245::double / 1000 as mean from documents),
q(q, name) as (values (0.95::double, 'q950'), (0.995::double, 'q995')),
s as (
  select doc_id, name, q, mean, 0 as k, exp(-mean) as p, exp(-mean) as c from d cross join q where mean > 0
  union all
  select doc_id, name, q, mean, k + 1, p * mean / (k + 1)::double, c + p * mean / (k + 1)::double from s where c < q and k < ceil(mean + 12 * sqrt(mean) + 30)
),
m as (select doc_id, max(k) filter (where name = 'q950') as q950, max(k) filter (where name = 'q995') as q995 from s group by doc_id)
select d.doc_id, coalesce(q950, 0)::integer as q950, coalesce(q995, 0)::integer as q995 from d left join m on d.doc_id = m.doc_id"""


@query(POISSON_SQL)
def poisson_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poisson quantiles at the expected number of hits of each document."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * F.lit(0.245) / 1000).alias("mean"))
    return d.select("doc_id", *(verdict.poisson_quantile(F.lit(q), F.col("mean")).alias(f"q{int(q * 1000)}") for q in (0.95, 0.995)))


# Korean cases, held as literals by both sides


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows: list[tuple], columns: str) -> str:
    literal = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else _sql_text(x)
    return "(values " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") t({columns})"


@query("select * from " + _values([(s, w, c, b) for s, w, c, b in cases.ENDINGS], "sentence, word, cls, bucket"))
def ending_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last word, class and bucket of sentences, against their known labels."""
    s = spark.createDataFrame([(r[0],) for r in cases.ENDINGS], "sentence string")
    asked = F.rtrim(F.col("sentence")).endswith("?")
    s = s.withColumn("word", H.last_word(F.col("sentence"))).withColumn("cls", H.ending_class(F.col("word"), asked))
    return s.withColumn("bucket", H.ending_bucket(F.col("sentence"), F.col("word"), F.col("cls")))


@query("select * from " + _values(cases.CONNECTIVES, "word, connective"))
def connective_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = spark.createDataFrame([(w,) for w, _ in cases.CONNECTIVES], "word string")
    return w.withColumn("connective", H.is_connective(F.col("word")))


#: Rules without look-around, which SQL's pattern engine can run.
PLAIN_RULES = tuple(r for r in RULES if not any("(?!" in p or "(?=" in p or "(?<" in p for p in r.patterns))


@query(
    "with c as (select * from " + _values([(s,) for s in cases.RULE_SENTENCES], "s") + ")\n"
    + "\nunion all ".join(
        f"select {_sql_text(r.id)} as metric_id, count(*) as n from c where " + " or ".join(f"regexp_matches(s, {_sql_text(p)})" for p in r.patterns) + " having count(*) > 0"
        for r in PLAIN_RULES
    )
)
def rule_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the case sentences each rule's patterns occur in."""
    s = spark.createDataFrame([(x,) for x in cases.RULE_SENTENCES], "s string")
    flags = s.select(*(any_of(F.col("s"), r.patterns).cast("long").alias(f"r{i}") for i, r in enumerate(PLAIN_RULES)))
    sums = flags.agg(*(F.sum(f"r{i}").alias(f"r{i}") for i in range(len(PLAIN_RULES))))
    named = F.array(*(F.struct(F.lit(r.id).alias("metric_id"), F.col(f"r{i}").alias("n")) for i, r in enumerate(PLAIN_RULES)))
    return sums.select(F.inline(named)).where("n > 0")


@query("select doc_id, metric_id, value::double as value from " + _values(cases.ARTICLE_VALUES, "doc_id, metric_id, value"))
def article_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of own articles, against values counted by hand."""
    docs = spark.createDataFrame(list(cases.ARTICLES), "doc_id string, text string")
    wanted = spark.createDataFrame([(d, m) for d, m, _ in cases.ARTICLE_VALUES], "doc_id string, metric_id string")
    return metrics(docs).join(wanted, ["doc_id", "metric_id"], "left_semi").select("doc_id", "metric_id", F.col("value").cast("decimal(9,3)").cast("double").alias("value"))


@query("select * from " + _values(cases.TONE_CODES, "pair_id, code, n"))
def tone_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue codes of pairs of a formal and a polite text, against the codes that each was made for."""
    p = spark.createDataFrame(list(cases.TONE_PAIRS), "pair_id string, formal string, polite string")
    return pairs.tone_issues(p).groupBy("pair_id", "code").agg(F.count("*").cast("int").alias("n"))


@query("select * from " + _values(cases.FIDELITY_VALUES, "pair_id, metric_id, value"))
def fidelity_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.createDataFrame(list(cases.FIDELITY_PAIRS), "pair_id string, source string, target string")
    terms = spark.createDataFrame(list(cases.TERMS), "en string, ko string")
    return pairs.fidelity(p, terms).where("value > 0").select("pair_id", "metric_id", "value")


@query("select * from " + _values(cases.REPEATS, 'doc_id, id, key, "count"'))
def repeat_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame(list(cases.REPEAT_ARTICLES), "doc_id string, text string")
    return repeats.find_repeats(docs).select("doc_id", "id", F.regexp_replace("key", "^\\d+\t", "").alias("key"), F.col("count").cast("int").alias("count"))


# whole tables through the kernels: beyond SQL


@query()
def document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of all documents."""
    return metrics(texts(spark, sf_dir, "documents"))


@query()
def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(texts(spark, sf_dir, "documents"))


@query()
def document_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all documents against the published limits."""
    return verdict.verdicts(verdict.judge(all_metrics(texts(spark, sf_dir, "documents")), registry(spark)))


@query()
def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of terms, sources and verbs."""
    return term_metrics(texts(spark, sf_dir, "documents"))


@query()
def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(texts(spark, sf_dir, "documents")).select("doc_id", "pos", "para", "nth", "text", "word", "cls", "bucket")


@query()
def document_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.find_repeats(texts(spark, sf_dir, "documents"))


@query()
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_to_markdown(texts(spark, sf_dir, "pages")).select("page_id", "markdown")


@query()
def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through extraction and all metrics."""
    p = pages_to_markdown(texts(spark, sf_dir, "pages"))
    return metrics(p, doc_id="page_id", text="markdown")
