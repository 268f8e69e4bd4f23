"""What judges are asked and what their answers come to."""

from __future__ import annotations

import re
import shlex

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .logs import agreement, found_quotes, term_score
from .metrics import unicode_rx
from .repeats import NUMBER
from .units import labelled, units

CHUNK = 80
NO_HEADING, SECTION_START, HEADING, NOTHING = "(헤딩 없음)", "(절의 첫 문장)", "(헤딩)", "(없음)"
#: What stands for a block before a sentence.
BEFORE = {"table": "(바로 앞은 표)", "code": "(바로 앞은 코드 블록)", "blockquote": "(바로 앞은 인용문)"}


def _context(docs: DataFrame, **params) -> DataFrame:
    """Sentences and headings outside references, with the section's heading and what stands before."""
    u = labelled(units(docs, **params)).where("not in_refs or kind = 'heading'")
    w = Window.partitionBy("doc_id").orderBy("pos")
    heads = F.col("kind") == "heading"
    hangul = F.regexp_count("text", F.lit("[가-힣]"))
    counts = (F.col("kind") == "sentence") & (hangul >= 4)
    block = F.create_map(*(F.lit(x) for kv in BEFORE.items() for x in kv))[F.col("type")]
    says = F.when(heads, F.lit("")).when(counts, F.col("text")).when(F.col("kind").isin("row", "block") & block.isNotNull(), block)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    u = u.withColumn("heading", F.coalesce(F.last(F.when(heads, F.col("text")), ignorenulls=True).over(before), F.lit(NO_HEADING)))
    last = F.last(says, ignorenulls=True).over(before)
    u = u.withColumn("prev", F.when(F.coalesce(last, F.lit("")) == "", SECTION_START).otherwise(last))
    return u.withColumn("_hangul", hangul).withColumn("_counts", counts)


def clarity_items(docs: DataFrame, flagged: DataFrame | None = None, **params) -> DataFrame:
    """doc_id, n, heading, prev, sentence, first, numeric, check: first sentences of paragraphs, those with numbers, and flagged(doc_id, text) ones."""
    c = _context(docs, **params).where("_counts")
    items = c.select("doc_id", "pos", "heading", "prev", F.col("text").alias("sentence"), ((F.col("type") == "paragraph") & (F.col("nth") == 0)).alias("first"), F.col("text").rlike(unicode_rx(NUMBER)).alias("numeric"))
    if flagged is None:
        items = items.withColumn("check", F.lit(False))
    else:
        f = flagged.select("doc_id", F.substring("text", 1, 60).alias("_k")).distinct().withColumn("check", F.lit(True))
        items = items.withColumn("_k", F.substring("sentence", 1, 60)).join(f, ["doc_id", "_k"], "left").drop("_k").withColumn("check", F.coalesce("check", F.lit(False)))
    w = Window.partitionBy("doc_id").orderBy("pos")
    return items.where("first or numeric or check").withColumn("n", F.row_number().over(w)).drop("pos")


def language_items(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n, part, heading, prev, sentence: all headings and sentences, in parts of 80."""
    c = _context(docs, **params)
    heads = (F.col("kind") == "heading") & ~F.col("in_refs") & (F.col("_hangul") >= 2)
    c = c.where(F.col("_counts") | heads)
    w = Window.partitionBy("doc_id").orderBy("pos")
    n = F.row_number().over(w)
    kind = F.col("kind") == "heading"
    return c.select("doc_id", n.alias("n"), (F.floor((n - 1) / CHUNK) + 1).cast("int").alias("part"), F.when(kind, HEADING).otherwise(F.col("heading")).alias("heading"), F.when(kind, NOTHING).otherwise(F.col("prev")).alias("prev"), F.col("text").alias("sentence"))


def clarity_scores(items: DataFrame, answers: DataFrame, chars: DataFrame) -> DataFrame:
    """doc_id and shares of items(doc_id, n, first, numeric) whose answers(doc_id, n, verdict) lean on what is before; chars(doc_id, chars)."""
    j = items.join(answers, ["doc_id", "n"], "left").join(chars, "doc_id", "left")
    told, leans = F.col("verdict").isNotNull(), F.col("verdict") != "self_contained"
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    got = j.groupBy("doc_id").agg(
        F.count("*").alias("checked"), n(told).alias("answered"), n(leans).alias("dependent"), n(F.col("verdict") == "unclear").alias("unclear"),
        n(leans & F.col("first")).alias("first_dependent"), n(told & F.col("first")).alias("first"), n(leans & F.col("numeric")).alias("numeric_dependent"), n(told & F.col("numeric")).alias("numeric"),
        F.first("chars").alias("chars"),
    )
    return got.withColumn("rate", F.when(F.col("answered") > 0, F.col("dependent") / F.col("answered"))).withColumn("per_1k", F.col("dependent") * 1000 / F.greatest(F.col("chars"), F.lit(1)))


def awkward_scores(answers: DataFrame, chars: DataFrame) -> DataFrame:
    """doc_id, answered, awkward, by_type, per_1k of answers(doc_id, n, verdict, type)."""
    bad = F.col("verdict") == "awkward"
    types = answers.where(bad).groupBy("doc_id", F.when(F.coalesce("type", F.lit("")) == "", "?").otherwise(F.col("type")).alias("type")).agg(F.count("*").alias("k"))
    types = types.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("type", "k"))).alias("by_type"))
    got = answers.groupBy("doc_id").agg(F.count("*").alias("answered"), F.count_if(bad).alias("awkward")).join(types, "doc_id", "left").join(chars, "doc_id", "left")
    return got.withColumn("per_1k", F.col("awkward") * 1000 / F.greatest(F.col("chars"), F.lit(1)))


def fidelity_tallies(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """case_id and counts of claims(case_id, verdict, quote) by verdict, and of quotes that texts(case_id, text) lack."""
    c = found_quotes(claims, texts, key="case_id", quote="quote")
    kinds = ("interpretation", "general_knowledge", "unsupported", "contradicted")
    return c.groupBy("case_id").agg(F.count("*").alias("claims"), *(F.count_if(F.col("verdict") == k).alias(k) for k in kinds), F.count_if(~F.col("found")).alias("quote_not_found"))


def style_scores(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """name, run, valid, invalid, per_1k of quotes(name, run, quote) against texts(name, text, chars)."""
    q = found_quotes(quotes, texts, key="name", quote="quote").join(texts.select("name", "chars"), "name", "left")
    got = q.groupBy("name", "run").agg(F.count_if("found").alias("valid"), F.count_if(~F.col("found")).alias("invalid"), F.first("chars").alias("chars"))
    return got.withColumn("per_1k", F.col("valid") * 1000 / F.greatest(F.col("chars"), F.lit(1))).drop("chars")


def terms_summaries(terms: DataFrame, runs: DataFrame, texts: DataFrame) -> DataFrame:
    """One row a run(doc_id, run, defined) of judged terms(doc_id, run, term, quote, explanation, missing), against texts(doc_id, text, chars).

    Terms whose first quote the text lacks are left out; ``defined`` says
    whether the central term is defined in one place; ``missing`` holds the
    kinds of explanation that a term lacks.
    """
    t = found_quotes(terms, texts, key="doc_id", quote="quote").withColumnRenamed("found", "_there")
    t = found_quotes(t, texts, key="doc_id", quote="explanation")
    c = F.col
    lacks = c("_there") & (F.size(F.coalesce("missing", F.array().cast("array<string>"))) > 0)
    kinds = t.where(lacks).select("doc_id", "run", F.explode(F.array_distinct("missing")).alias("_kind")).groupBy("doc_id", "run", "_kind").agg(F.count("*").alias("_k"))
    kinds = kinds.groupBy("doc_id", "run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_kind", "_k")))).alias("by_missing"))
    n = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    counts = t.groupBy("doc_id", "run").agg(
        n(c("_there")).alias("terms"), n(lacks).alias("missing"), n(~c("_there")).alias("invalid_quotes"),
        n(c("_there") & (F.coalesce("explanation", F.lit("")) != "") & ~c("found")).alias("invalid_explanations"), F.array_sort(F.collect_list(F.when(lacks, c("term")))).alias("missing_terms"),
    )
    out = runs.join(counts, ["doc_id", "run"], "left").join(kinds, ["doc_id", "run"], "left").join(texts.select("doc_id", "chars"), "doc_id", "left")
    out = out.na.fill(0, ["terms", "missing", "invalid_quotes", "invalid_explanations"])
    out = out.withColumn("score", term_score(c("missing"), F.coalesce("defined", F.lit(False))))
    out = out.withColumn("missing_ratio", F.when(c("terms") > 0, c("missing") / c("terms")))
    return out.withColumn("missing_per_1k", c("missing") * 1000 / F.greatest(F.coalesce("chars", F.lit(0)), F.lit(1))).drop("chars")


def run_agreement(summaries: DataFrame) -> DataFrame:
    """doc_id, jaccard, both: terms that the first two runs of terms_summaries both flag."""
    w = Window.partitionBy("doc_id").orderBy("run")
    two = summaries.withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    of = lambda k: F.coalesce(F.max(F.when(F.col("_n") == k, F.col("missing_terms"))), F.array().cast("array<string>"))
    both = two.groupBy("doc_id").agg(agreement(of(1), of(2)).alias("x"))
    return both.select("doc_id", "x.jaccard", "x.both")


def run_table(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """by and a column for each name, of rows(by, name, value): a line a run, and a last one of medians."""
    wide = rows.groupBy(by).pivot("name", columns).agg(F.first("value")).withColumn("_last", F.lit(0))
    middle = wide.agg(*(F.median(c).alias(c) for c in columns)).select(F.lit("median").alias(by), *columns, F.lit(1).alias("_last"))
    return wide.unionByName(middle).orderBy("_last", by).drop("_last")


def floor_quantile(values: Column, q: float) -> Column:
    """The value at index floor(q (n - 1)) of an array in order."""
    return F.get(F.array_sort(values), F.floor(F.lit(q) * (F.size(values) - 1)).cast("int"))


def medians(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), *(F.median(c).alias(c) for c in columns))


def matched_cases(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cases of a with those of b whose prefix is the same, or the same and a 0: two equi-joins."""
    prefix = lambda d, k: d.withColumn(k, F.split("case", "-")[0])
    x, y = prefix(a, "_p").select(F.col("case").alias("case"), "_p"), prefix(b, "_q").select(F.col("case").alias("other"), "_q")
    same = x.join(y, F.col("_p") == F.col("_q"))
    longer = x.join(y, F.concat("_p", F.lit("0")) == F.col("_q"))
    return same.unionByName(longer).groupBy("case").agg(F.min("other").alias("other"))


def lint_summaries(results: DataFrame, summary: DataFrame) -> DataFrame:
    """summary with issues: the statuses that count, each as "STATUS id=value"."""
    bad = results.where(F.col("status").isin("GATE", "FAIL", "WARN")).withColumn("i", F.concat(F.col("status"), F.lit(" "), F.col("metric_id"), F.lit("="), F.col("value").cast("string")))
    return summary.join(bad.groupBy("doc_id").agg(F.array_sort(F.collect_list("i")).alias("issues")), "doc_id", "left").withColumn("issues", F.coalesce("issues", F.array().cast("array<string>")))


# what a run did

SHELLS = ("Bash", "PowerShell")


def run_steps(calls: DataFrame, *, script: str, target: str, review: str, listing: str) -> DataFrame:
    """One row a run of tool calls(run, nth, name, input): which steps ran, in which order, and what was read and edited.

    ``script`` names the checking script, whose first word after it is the step
    (start, repeats, check); ``target`` is the file that is revised, ``review`` a
    file of instructions whose readers are counted, ``listing`` how names of
    files with candidates end.
    """
    command = F.when(F.col("name").isin(*SHELLS), F.coalesce(F.get_json_object("input", "$.command"), F.lit("")))
    path = F.regexp_replace(F.coalesce(F.get_json_object("input", "$.file_path"), F.lit("")), r"\\", "/")
    c = calls.withColumn("_cmd", F.coalesce(command, F.lit(""))).withColumn("_path", path).withColumn("_file", F.substring_index("_path", "/", -1))
    step = lambda k: F.col("_cmd").contains(script) & F.concat("_cmd", F.lit(" ")).contains(f" {k} ")
    w = Window.partitionBy("run")
    first = lambda cond: F.min(F.when(cond, F.col("nth"))).over(w)
    reads = (F.col("name") == "Read") & (F.col("_file") == target)
    edits = F.col("name").isin("Edit", "Write") & (F.col("_file") == target)
    listed = (F.col("name") == "Read") & F.col("_path").endswith(listing)
    c = c.withColumns({"start": first(step("start")), "check": first(step("check")), "_shell": first(step("repeats")), "_list": first(listed)})
    c = c.withColumn("repeats", F.least("_shell", "_list"))
    c = c.withColumn("_last_edit", F.coalesce(F.max(F.when(edits & (F.col("nth") < F.col("start")), F.col("nth"))).over(w), F.lit(-1)))
    between = reads & (F.col("nth") > F.col("_last_edit")) & (F.col("nth") < F.col("repeats"))
    after = F.col("nth") > F.col("start")
    agents = F.col("name").isin("Agent", "Task") & after
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    return c.groupBy("run").agg(
        *(F.first(k).alias(k) for k in ("start", "repeats", "check")), n(step("check")).alias("checks"), n(edits & after).alias("edits_after_start"),
        n(agents).alias("agents"), n(agents & F.col("input").contains(review)).alias("reviewers"), (n((F.col("name") == "Read") & F.col("_path").endswith("/" + review)) > 0).alias("review_read"),
        F.when(F.first("start").isNotNull() & F.first("repeats").isNotNull(), n(between) > 0).alias("read_before_repeats"),
    )


def compactions(ev: DataFrame) -> DataFrame:
    return ev.where("e.type = 'system' and e.subtype = 'compact_boundary'").groupBy("run").agg(F.count("*").alias("compactions"))


def _words(command: str) -> list[str]:
    words = shlex.split(command)
    if words and re.fullmatch(r"(?:sh|bash|zsh|powershell|pwsh)(?:\.exe)?", re.split(r"[\\/]", words[0])[-1].lower()):
        for i, word in enumerate(words[1:-1], 1):
            if word.lower() in ("-c", "-lc", "-command"):
                return _words(" ".join(words[i + 1 :]))
    lexer = shlex.shlex(command, posix=True, punctuation_chars=";&|")
    lexer.whitespace_split = True
    return list(lexer)


def script_calls(command: str, scripts: tuple[str, ...]) -> list[dict]:
    """Calls of Python scripts in a shell command: script and its first word."""
    try:
        words = _words(command)
    except ValueError:
        return []
    base = [re.split(r"[\\/]", w)[-1] for w in words]
    python = [bool(re.fullmatch(r"python(?:\d+(?:\.\d+)*)?(?:\.exe)?", b)) for b in base]
    return [{"script": b, "action": words[i + 1] if i + 1 < len(words) else ""} for i, b in enumerate(base) if i and b in scripts and python[i - 1]]


def checker_calls(commands: DataFrame, scripts: tuple[str, ...]) -> DataFrame:
    """commands(run, line_no, command) with a row for each call: script, action."""

    @F.arrow_udf(T.ArrayType(T.StructType().add("script", T.StringType()).add("action", T.StringType())))
    def calls(command: pa.Array) -> pa.Array:
        return pa.array([script_calls(c or "", scripts) for c in command.to_pylist()], pa.list_(pa.struct([("script", pa.string()), ("action", pa.string())])))

    return commands.select("run", "line_no", F.inline(calls("command")))
