"""Run logs and answers of judges: events, shares of tokens and time, votes, agreement, graders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT = (
    "type string, subtype string, timestamp string, model string, permissionMode string, skills array<string>, is_error boolean, num_turns long, duration_ms long, total_cost_usd double, "
    "message struct<id:string, usage:struct<input_tokens:long, cache_creation_input_tokens:long, cache_read_input_tokens:long, output_tokens:long>, "
    "content:array<struct<type:string, id:string, name:string, input:string, tool_use_id:string, is_error:boolean>>>, "
    "item struct<type:string, command:string, exit_code:int, message:string>"
)
USAGE = ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
#: Fixed value: the title of what stands before the first heading.
OPENING = "(도입)"
LOAD_ERROR = r"Skill `[^`]+` exceeded the main prompt context limit and was truncated\.|Failed to load skill[^\r\n]*"


def events(lines: DataFrame, *, run: str = "file") -> DataFrame:
    """run, line_no, e for lines(run, line_no, json); lines that aren't JSON objects are left out."""
    e = F.from_json("json", EVENT, {"mode": "PERMISSIVE"})
    return lines.select(F.col(run).alias("run"), "line_no", e.alias("e")).where("e.type is not null")


def tools(ev: DataFrame) -> DataFrame:
    """run, nth, id, name, input, error: tool calls in order, flagged by the results that answer them."""
    calls = ev.where("e.type = 'assistant'").select("run", "line_no", F.posexplode("e.message.content").alias("k", "c")).where("c.type = 'tool_use'")
    w = Window.partitionBy("run").orderBy("line_no", "k")
    calls = calls.select("run", (F.row_number().over(w) - 1).alias("nth"), "line_no", "k", F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.col("c.input").alias("input"))
    bad = ev.where("e.type = 'user'").select("run", F.explode("e.message.content").alias("c")).where("c.type = 'tool_result' and c.is_error").select("run", F.col("c.tool_use_id").alias("id"), F.lit(True).alias("error")).distinct()
    return calls.join(bad, ["run", "id"], "left").withColumn("error", F.coalesce("error", F.lit(False)))


def usage_share(ev: DataFrame, start: Column, end: Column | None = None) -> DataFrame:
    """run, input_share, minutes, time_share of what lies between the first call that meets start and the first after it that meets end.

    start and end are conditions on a call c (id, name, input).  A message's
    usage counts once, at its first event.
    """
    w = Window.partitionBy("run").orderBy("line_no", "k")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    call = F.struct(F.lit("tool_use").alias("type"), *(F.lit(None).cast("string").alias(x) for x in ("id", "name", "input")))
    t = F.to_timestamp("e.timestamp")
    stamp = ev.select("run", "line_no", F.lit(-2).alias("k"), t.alias("t"), F.lit(None).cast("string").alias("msg"), F.lit(0).cast("long").alias("tokens"), call.alias("c"))
    used = sum((F.coalesce(F.col(f"e.message.usage.{k}"), F.lit(0)) for k in USAGE), F.lit(0))
    use = ev.where("e.type = 'assistant' and e.message.usage is not null").select("run", "line_no", F.lit(-1).alias("k"), F.lit(None).cast("timestamp").alias("t"), F.col("e.message.id").alias("msg"), used.alias("tokens"), call.alias("c"))
    first_use = Window.partitionBy("run", "msg").orderBy("line_no")
    use = use.withColumn("_n", F.row_number().over(first_use)).where("_n = 1").drop("_n")
    acts = ev.where("e.type = 'assistant'").select("run", "line_no", F.posexplode("e.message.content").alias("k", "c0")).where("c0.type = 'tool_use'")
    acts = acts.select("run", "line_no", "k", F.lit(None).cast("timestamp").alias("t"), F.lit(None).cast("string").alias("msg"), F.lit(0).cast("long").alias("tokens"), F.struct("c0.type", "c0.id", "c0.name", "c0.input").alias("c"))
    rows = stamp.unionByName(use).unionByName(acts)
    rows = rows.withColumn("now", F.last("t", ignorenulls=True).over(so_far)).withColumn("on", F.coalesce(F.max(F.coalesce(start, F.lit(False))).over(so_far), F.lit(False)))
    stop = F.coalesce(end, F.lit(False)) if end is not None else F.lit(False)
    rows = rows.withColumn("off", F.max(stop).over(so_far))
    got = rows.groupBy("run").agg(
        F.sum("tokens").alias("total"), F.sum(F.when(F.col("on") & ~F.col("off"), F.col("tokens")).otherwise(0)).alias("within"),
        F.min("t").alias("first"), F.max("t").alias("last"), F.min(F.when(F.col("on"), F.col("now"))).alias("start"), F.min(F.when(F.col("off"), F.col("now"))).alias("end"),
    )
    span = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 1e6
    until = F.coalesce("end", "last")
    whole, part = span(F.col("first"), F.col("last")), span(F.col("start"), until)
    return got.select("run", F.when(F.col("total") > 0, F.col("within") / F.col("total")).alias("input_share"), (part / 60).alias("minutes"), F.when(whole > 0, part / whole).alias("time_share"))


def command_events(ev: DataFrame) -> DataFrame:
    return ev.where("e.type = 'item.completed' and e.item.type = 'command_execution'").select("run", "line_no", F.coalesce("e.item.command", F.lit("")).alias("command"), F.col("e.item.exit_code").alias("exit_code"))


def load_errors(ev: DataFrame, plain: DataFrame | None = None) -> DataFrame:
    """run, message: distinct load errors that the runtime reports, in events or plain lines(run, json)."""
    said = ev.where("e.type = 'item.completed' and e.item.type = 'error'").select("run", F.col("e.item.message").alias("m"))
    if plain is not None:
        said = said.unionByName(plain.select(F.col("file").alias("run"), F.col("json").alias("m")))
    return said.select("run", F.explode(F.regexp_extract_all("m", F.lit(LOAD_ERROR), F.lit(0))).alias("message")).distinct()


def squeezed(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def found_quotes(answers: DataFrame, texts: DataFrame, *, key: str, quote: str) -> DataFrame:
    """answers with found: the quote, white space squeezed, stands in the text."""
    q, body = squeezed(F.col(quote)), squeezed(F.col("text"))
    return answers.join(texts.select(key, "text"), key, "left").withColumn("found", F.coalesce((q != "") & body.contains(q), F.lit(False))).drop("text")


def term_score(missing: Column, central: Column) -> Column:
    return F.when(~central | (missing >= 3), 0).when(missing > 0, 1).otherwise(2)


def agreement(a: Column, b: Column) -> Column:
    """struct(jaccard, both) of two arrays of terms; two empty ones agree."""
    norm = lambda x: F.array_distinct(F.transform(x, lambda t: F.lower(squeezed(t))))
    both, either = F.array_intersect(norm(a), norm(b)), F.array_union(norm(a), norm(b))
    return F.struct(F.when(F.size(either) > 0, F.size(both) / F.size(either)).otherwise(1.0).alias("jaccard"), F.array_sort(both).alias("both"))


def pair_votes(votes: DataFrame) -> DataFrame:
    """case_id, result of votes(case_id, vote_order, winner): X is current in order 0 and compare in order 1."""
    first = F.when(F.col("winner") == "X", "current").when(F.col("winner") == "Y", "compare").otherwise(F.col("winner"))
    second = F.when(F.col("winner") == "X", "compare").when(F.col("winner") == "Y", "current").otherwise(F.col("winner"))
    v = votes.withColumn("w", F.when(F.col("vote_order") == 0, first).otherwise(second))
    got = v.groupBy("case_id").agg(F.max(F.when(F.col("vote_order") == 0, F.col("w"))).alias("a"), F.max(F.when(F.col("vote_order") == 1, F.col("w"))).alias("b"))
    return got.select("case_id", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("split").alias("result"))


def section_votes(votes: DataFrame) -> DataFrame:
    """case_id, post, pre, tie of votes(case_id, section, vote_order, winner): A is the revision in order 0."""
    who = F.when(F.col("winner") == "tie", "tie").when((F.col("winner") == "A") == (F.col("vote_order") == 0), "post").otherwise("pre")
    return votes.withColumn("who", who).groupBy("case_id").agg(*(F.count_if(F.col("who") == k).alias(k) for k in ("post", "pre", "tie")))


def align_items(pre: DataFrame, post: DataFrame) -> DataFrame:
    """unchanged, flips, flip_rate, pre_only, post_only of items(sentence, prev, verdict): a full outer join on both sentences."""
    side = lambda d, v: d.select(squeezed(F.col("sentence")).alias("s"), squeezed(F.coalesce("prev", F.lit(""))).alias("p"), F.col("verdict").alias(v)).dropDuplicates(["s", "p"])
    j = side(pre, "a").join(side(post, "b"), ["s", "p"], "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    got = j.agg(F.count_if(both).alias("unchanged"), F.count_if(both & (F.col("a") != F.col("b"))).alias("flips"), F.count_if(F.col("b").isNull()).alias("pre_only"), F.count_if(F.col("a").isNull()).alias("post_only"))
    return got.withColumn("flip_rate", F.when(F.col("unchanged") > 0, F.col("flips") / F.col("unchanged")))


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, nth, title, body: documents cut at level-2 headings outside fences."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i")
    lines = lines.withColumn("_fence", F.sum(F.col("line").rlike(r"^ {0,3}(`{3,}|~{3,})").cast("int")).over(w) % 2)
    head = F.when(F.col("_fence") == 0, F.regexp_extract("line", r"(?U)^##\s+(.*?)\s*#*\s*$", 1))
    opens = (F.col("_fence") == 0) & F.col("line").rlike(r"(?U)^##\s+(.*?)\s*#*\s*$")
    lines = lines.withColumn("_title", F.when(opens, F.trim(head))).withColumn("nth", F.sum(opens.cast("int")).over(w))
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("_title").isNull(), F.struct("i", "line")))), lambda x: x["line"])
    return lines.groupBy("doc_id", "nth").agg(F.coalesce(F.max("_title"), F.lit(OPENING)).alias("title"), F.trim(F.concat_ws("\n", body), F.lit("\n ")).alias("body"))


def changed_sections(pairs: DataFrame) -> DataFrame:
    """pair_id, nth, title, before, after of pairs(pair_id, before, after): sections whose words differ.

    Texts with the same titles in the same order match by place, others by
    title, where the last of equal titles in ``after`` counts.
    """
    def side(c: str) -> DataFrame:
        own = sections(pairs.select(F.col("pair_id").alias("doc_id"), F.col(c).alias("text")))
        # what stands before the first heading is a section even if it is empty
        opening = pairs.select(F.col("pair_id").alias("doc_id"), F.lit(0).cast("long").alias("nth"), F.lit(OPENING).alias("title"), F.lit("").alias("body"))
        return own.unionByName(opening.join(own.where("nth = 0").select("doc_id"), "doc_id", "left_anti"))

    b, a = side("before"), side("after")
    titles = lambda d, name: d.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "title"))), lambda x: x["title"]).alias(name))
    same = titles(b, "t").join(titles(a, "u"), "doc_id").select("doc_id", (F.col("t") == F.col("u")).alias("same"))
    b = b.join(same, "doc_id")
    placed = b.where("same").join(a.select("doc_id", "nth", F.col("body").alias("after")), ["doc_id", "nth"])
    last = a.groupBy("doc_id", "title").agg(F.max_by("body", "nth").alias("after"))
    named = b.where("not same").join(last, ["doc_id", "title"])
    cols = (F.col("doc_id").alias("pair_id"), "nth", "title", F.col("body").alias("before"), "after")
    return placed.select(*cols).unionByName(named.select(*cols)).where(squeezed(F.col("before")) != squeezed(F.col("after")))


def grade(checks: DataFrame, answers: DataFrame, files: DataFrame, calls: DataFrame) -> DataFrame:
    """checks(case_id, name, type, pattern, match) with passed: regex over answers, file_exists over files, tool_used over calls.

    A column flags (of i, m, s, x) is put before the pattern.  Checks of other
    types, which a judge has to answer, have no row.
    """
    if "flags" in checks.columns:
        given = F.coalesce("flags", F.lit(""))
        checks = checks.withColumn("pattern", F.when(given != "", F.concat(F.lit("(?"), given, F.lit(")"), "pattern")).otherwise(F.col("pattern")))
    c = checks.where(F.col("type") == "regex").join(answers.select("case_id", "text"), "case_id", "left")
    hit = F.coalesce(F.regexp_like("text", F.col("pattern")), F.lit(False))
    rx = c.select("case_id", "name", F.when(F.col("match") == "not_contains", ~hit).otherwise(hit).alias("passed"))
    there = files.select("case_id", F.col("path").alias("_path"))
    c = checks.where(F.col("type") == "file_exists").join(there, "case_id", "left")
    fe = c.groupBy("case_id", "name").agg(F.coalesce(F.bool_or(F.regexp_like("_path", F.col("pattern"))), F.lit(False)).alias("passed"))
    c = checks.where(F.col("type") == "tool_used").join(calls.select("case_id", F.col("name").alias("_tool"), "input"), "case_id", "left")
    tu = c.groupBy("case_id", "name").agg(F.coalesce(F.bool_or((F.col("_tool") == F.col("match")) & F.coalesce(F.regexp_like("input", F.col("pattern")), F.lit(True))), F.lit(False)).alias("passed"))
    return rx.unionByName(fe).unionByName(tu)
