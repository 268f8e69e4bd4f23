"""Checks of document pairs: source and translation, two tones, draft and revision."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosemill.functions import hangul as H
from prosemill.functions import markdown as M
from prosemill.functions.plan import settled
from prosemill.sources.readers import normal

from .metrics import metrics, unicode_rx
from .repeats import records
from .verdict import RANK, judge, verdicts

# Forms that a translation keeps.
FENCED = r"(?ms)^ {0,3}(`{3,}|~{3,})[^\n]*\n(.*?)^ {0,3}\1[ \t]*$"
SPAN = r"(`+)(?!`)(.+?)(?<!`)\1(?!`)"
LINK = r"https?://[^\s)>\]`\"'<]+"
CHAT_TOKEN = r"<[@#!][^>\s]+>|\{[A-Za-z_]+(?::[^}\s]+)?\}"
DIGITS = r"(?<![\w.])\d+(?:[.,]\d+)*"
LIST_LINE = r"^[ \t]*(?:[-*+]|\d{1,3}[.)])[ \t]+\S"
HEADING_LINE = r"^ {0,3}#{1,6}[ \t]+\S"

#: A glossary goes to every task only up to so many terms.
MOST_TERMS = 10_000

# What two tones may differ in.
TAIL_WORDS = 2
CONTRACTIONS = (("것은", "건"), ("것이", "게"), ("것을", "걸"), ("이것은", "이건"), ("그것은", "그건"), ("이것이", "이게"), ("그것이", "그게"), ("무엇을", "뭘"), ("무엇이", "뭐가"))
CAUSE = "(때문|므로|어서|아서|해서|니까|덕분|이유는)"
NEGATION = r"(않|없|못|아니|(?<![가-힣])안\s)"
FROZEN = ("heading", "code", "table", "blockquote", "html")
DISTRIBUTION = ("A8.", "A9.", "A16.", "A17.")


def structure(text: Column) -> Column:
    """blocks, spans, urls, tokens, numbers, list_items, headings of a text, by lines and forms alone."""
    body = F.regexp_replace(text, FENCED, "\n")
    bare = F.regexp_replace(body, SPAN, " ")
    plain = F.regexp_replace(F.regexp_replace(bare, LINK, " "), CHAT_TOKEN, " ")
    found = lambda s, rx, g=0: F.regexp_extract_all(s, F.lit(rx), F.lit(g))
    lines = F.split(body, "\n")
    return F.struct(
        found(text, FENCED, 2).alias("blocks"),
        found(body, SPAN, 2).alias("spans"),
        found(bare, LINK).alias("urls"),
        found(bare, CHAT_TOKEN).alias("tokens"),
        F.array_distinct(found(plain, unicode_rx(DIGITS))).alias("numbers"),
        F.size(F.filter(lines, lambda x: x.rlike(LIST_LINE))).alias("list_items"),
        F.size(F.filter(lines, lambda x: x.rlike(HEADING_LINE))).alias("headings"),
    )


def lacking(source: Column, output: Column) -> Column:
    """Items of source beyond their number in output: a multiset difference."""
    n = lambda items, x: F.size(F.filter(items, lambda y: y == x))
    more = F.transform(F.array_distinct(source), lambda x: F.array_repeat(x, F.greatest(n(source, x) - n(output, x), F.lit(0))))
    return F.flatten(more)


def fidelity(pairs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """pair_id, metric_id, value, items for pairs(pair_id, source, target); terms(en, ko)."""
    p = pairs.select("pair_id", normal(F.col("source")).alias("source"), normal(F.col("target")).alias("target"))
    p = p.withColumn("s", structure(F.col("source"))).withColumn("t", structure(F.col("target")))
    named = (("F1.code_blocks", "blocks"), ("F2.inline_code", "spans"), ("F3.urls", "urls"), ("F4.slack_tokens", "tokens"), ("F5.numbers", "numbers"))
    rows = [F.struct(F.lit(k).alias("metric_id"), lacking(F.col(f"s.{c}"), F.col(f"t.{c}")).alias("items")) for k, c in named]
    gone = p.select("pair_id", F.inline(F.array(*rows))).select("pair_id", "metric_id", F.size("items").alias("value"), "items")
    none = F.array().cast("array<string>").alias("items")
    diffs = F.array(*(F.struct(F.lit(k).alias("metric_id"), F.abs(F.col(f"s.{c}") - F.col(f"t.{c}")).alias("value")) for k, c in (("F6.list_items", "list_items"), ("F7.headings", "headings"))))
    out = gone.unionByName(p.select("pair_id", F.inline(diffs)).select("pair_id", "metric_id", "value", none))
    if terms is None:
        return out.unionByName(p.select("pair_id", F.lit("F8.terms").alias("metric_id"), F.lit(0).alias("value"), none))
    # a term meets the texts that hold its first run of Latin letters; terms without one meet all texts
    terms = terms.where("en <> '' and ko <> ''").withColumn("word", F.lower(F.regexp_extract("en", "[A-Za-z]+", 0)))
    prose = F.regexp_replace(F.regexp_replace("source", FENCED, " "), SPAN, " ")
    escaped = F.concat(F.lit("\\Q"), F.col("en"), F.lit("\\E"))
    form = F.concat(F.when(F.col("en") == F.lower("en"), "(?i)").otherwise(""), F.lit("(?<![A-Za-z])"), escaped, F.lit("(?![A-Za-z])"))
    said = p.select("pair_id", prose.alias("prose"), "target")
    words = F.array_union(F.array(F.lit("")), F.transform(F.regexp_extract_all("prose", F.lit("[A-Za-z]+"), F.lit(0)), F.lower))
    few = terms.limit(MOST_TERMS + 1).count() <= MOST_TERMS
    met = said.select("pair_id", F.explode(words).alias("word")).join(F.broadcast(terms) if few else terms, "word")
    wrong = said.join(met, "pair_id").where(F.regexp_like("prose", form) & ~F.col("target").contains(F.col("ko")))
    wrong = wrong.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.concat_ws(" → ", "en", "ko"))).alias("items"))
    eight = p.select("pair_id").join(wrong, "pair_id", "left").select("pair_id", F.lit("F8.terms").alias("metric_id"), F.coalesce(F.size("items"), F.lit(0)).alias("value"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.unionByName(eight)


# two tones


def _tone_units(text: str | None) -> list[dict]:
    out = []
    for b in M.parse_blocks(M.normal_text(text)):
        level = str(b["level"]) if b["type"] == "heading" else ""
        clean = M.clean_inline(b["text"])[0]
        frozen = b["type"] in FROZEN
        out.append({"kind": b["type"] + level, "line": b["line"], "raw": b["text"], "clean": clean, "sents": None if frozen else M.split_sentences(clean)})
    return out


_TONE_UNIT = pa.list_(pa.struct([("kind", pa.string()), ("line", pa.int32()), ("raw", pa.string()), ("clean", pa.string()), ("sents", pa.list_(pa.string()))]))


@F.arrow_udf(T.ArrayType(T.StructType().add("kind", T.StringType()).add("line", T.IntegerType()).add("raw", T.StringType()).add("clean", T.StringType()).add("sents", T.ArrayType(T.StringType()))))
def _tone(text: pa.Array) -> pa.Array:
    return pa.array([_tone_units(t) for t in text.to_pylist()], _TONE_UNIT)


def protected(s: Column) -> Column:
    """Numbers, placeholders, Latin words, parenthesised and quoted text, sorted."""
    found = lambda rx, g=0, of=s: F.regexp_extract_all(of, F.lit(rx), F.lit(g))
    latin = F.transform(found(r"[A-Za-z][A-Za-z0-9_.\-+/#]*", 0, F.regexp_replace(s, H.PLACEHOLDER, " ")), F.lower)
    return F.array_sort(F.concat(H.number_keys(s, drop_bare_digits=True), found(H.PLACEHOLDER), latin, found(r"\(([^()]*)\)", 1), found('[“"]([^”"]+)[”"]', 1)))


def _squeezed(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(s, "“”‘’", "\"\"''"), r"(?U)\s+", " "))


def tone_issues(pairs: DataFrame) -> DataFrame:
    """pair_id, code, level, d_line, c_line, sent, default, casual for pairs(pair_id, formal, polite)."""
    p = pairs.select("pair_id", _tone("formal").alias("d"), _tone("polite").alias("c"))

    def kinds(u: Column) -> Column:
        def kind(x):
            word = H.last_word(x["clean"])
            noun = H.ending_class(word, F.rtrim(x["clean"]).endswith("?")).isin("NOUN", "OTHER")
            return F.when((x["kind"] == "list_item") & noun, "list_noun").otherwise(x["kind"])

        return F.transform(u, kind)

    p = p.withColumns({"dk": kinds(F.col("d")), "ck": kinds(F.col("c"))})
    same = F.col("dk") == F.col("ck")
    where = F.filter(F.sequence(F.lit(0), F.greatest(F.size("dk"), F.size("ck"))), lambda i: ~F.get("dk", i).eqNullSafe(F.get("ck", i)))[0]
    line = lambda u: F.coalesce(F.get(u, where)["line"], F.element_at(u, -1)["line"], F.lit(0))
    cols = ["pair_id", "code", "level", "d_line", "c_line", "sent", "default", "casual"]
    none = F.lit("(없음)")
    broken = p.where(~same).select("pair_id", F.lit("STRUCTURE").alias("code"), F.lit("FAIL").alias("level"), line("d").alias("d_line"), line("c").alias("c_line"), F.lit(0).alias("sent"), F.coalesce(F.get("dk", where), none).alias("default"), F.coalesce(F.get("ck", where), none).alias("casual"))
    u = p.where(same).select("pair_id", F.posexplode(F.arrays_zip("d", "c", F.col("dk").alias("k"))).alias("n", "u")).select("pair_id", "n", "u.d", "u.c", F.col("u.k").alias("k"))
    frozen = F.col("k").rlike("^(heading|code|table|blockquote|html|list_noun)")
    at = ("pair_id", F.col("d.line").alias("d_line"), F.col("c.line").alias("c_line"))
    froze = u.where(frozen & (_squeezed(F.col("d.raw")) != _squeezed(F.col("c.raw")))).select(*at, F.lit("FROZEN").alias("code"), F.lit("FAIL").alias("level"), F.lit(0).alias("sent"), F.substring("d.raw", 1, 160).alias("default"), F.substring("c.raw", 1, 160).alias("casual"))
    counted = F.size("d.sents") == F.size("c.sents")
    count = u.where(~frozen & ~counted).select(*at, F.lit("SENT_COUNT").alias("code"), F.lit("FAIL").alias("level"), F.lit(0).alias("sent"), F.substring("d.raw", 1, 160).alias("default"), F.substring("c.raw", 1, 160).alias("casual"))
    s = u.where(~frozen & counted).select(*at, F.posexplode(F.arrays_zip(F.col("d.sents").alias("d"), F.col("c.sents").alias("c"))).alias("sent", "x")).select("pair_id", "d_line", "c_line", (F.col("sent") + 1).alias("sent"), F.col("x.d").alias("d"), F.col("x.c").alias("c"))
    out = broken.select(cols).unionByName(froze.select(cols)).unionByName(count.select(cols))
    return out.unionByName(_sentence_issues(s).select(cols))


def _sentence_issues(s: DataFrame) -> DataFrame:
    d, c = F.col("d"), F.col("c")
    bare = lambda x: H.words(F.regexp_replace(x, H.PLACEHOLDER, " "))
    s = s.withColumns({"dw": bare(d), "cw": bare(c), "dword": H.last_word(d), "cword": H.last_word(c)})
    s = s.withColumns({"dcls": H.ending_class(F.col("dword"), F.rtrim(d).endswith("?")), "ccls": H.ending_class(F.col("cword"), F.rtrim(c).endswith("?"))})
    short = {a: b for a, b in CONTRACTIONS}
    table = F.create_map(*(F.lit(x) for kv in short.items() for x in kv))
    alike = F.zip_with("dw", "cw", lambda a, b: F.coalesce((a == b) | (table[a] == b), F.lit(False)))
    differs = F.array_position(alike, F.lit(False))
    p = F.when(differs > 0, differs - 1).otherwise(F.least(F.size("dw"), F.size("cw"))).cast("int")
    s = s.withColumn("p", p)
    rd, rc = F.size("dw") - F.col("p"), F.size("cw") - F.col("p")
    first = lambda ws: F.substring(F.get(ws, F.col("p")), 1, 1)
    onset = lambda ch: F.when(H.initial(ch) >= 0, H.initial(ch).cast("string")).otherwise(ch)
    masks = lambda x: F.size(F.regexp_extract_all(x, F.lit(NEGATION), F.lit(0)))
    far = (rd > TAIL_WORDS) | (rc > TAIL_WORDS)
    banned = H.ends(F.col("cword"), H.BANNED)
    checks = (
        ("TOKEN", "FAIL", protected(d) != protected(c)),
        ("POLARITY", "FAIL", masks(_unquoted(d)) != masks(_unquoted(c))),
        ("PREFIX", "FAIL", far),
        ("STEM", "WARN", ~far & (rd > 0) & (rc > 0) & (onset(first("dw")) != onset(first("cw")))),
        ("D_TONE", "FAIL", ~F.col("dcls").isin("HAPNIDA", "Q_KKAYO", "NOUN", "OTHER")),
        ("BANNED", "FAIL", banned),
        ("C_TONE", "FAIL", ~banned & ~F.col("ccls").isin("HAEYO", "Q_KKAYO", "NOUN", "OTHER")),
        ("GEUDEUN", "WARN", F.col("cword").endswith("거든요") & ~d.rlike(CAUSE)),
    )
    found = F.filter(F.array(*(F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"))) for code, level, hit in checks)), lambda x: x.isNotNull())
    s = settled(s.select("pair_id", "d_line", "c_line", "sent", F.substring(d, 1, 160).alias("default"), F.substring(c, 1, 160).alias("casual"), found.alias("found")))
    return s.select("pair_id", "d_line", "c_line", "sent", "default", "casual", F.inline("found"))


def _unquoted(s: Column) -> Column:
    """Quoted spans as placeholders; single quotes only around Hangul."""
    for a, z in ("“”", "「」", "『』", "‘’", '""'):
        s = F.regexp_replace(s, f"\\Q{a}\\E[^{z}\\n]{{0,200}}\\Q{z}\\E", M.QUOTED)
    return F.regexp_replace(s, r"'(?=[^'\n]{0,59}[가-힣])[^'\n]{1,60}'", M.QUOTED)


# draft and revision


@F.arrow_udf(T.StructType().add("kept", T.IntegerType()).add("changed", T.IntegerType()).add("written", T.IntegerType()).add("places", T.ArrayType(T.IntegerType())))
def _alignment(before: pa.Array, after: pa.Array) -> pa.Array:
    out = []
    for a, b in zip(before.to_pylist(), after.to_pylist(), strict=True):
        ops = difflib.SequenceMatcher(None, a or [], b or [], autojunk=False).get_opcodes()
        diff = [o for o in ops if o[0] != "equal"]
        out.append({"kept": sum(o[2] - o[1] for o in ops if o[0] == "equal"), "changed": sum(o[2] - o[1] for o in diff), "written": sum(o[4] - o[3] for o in diff), "places": [j for o in diff for j in range(o[3], o[4])]})
    return pa.array(out, pa.struct([("kept", pa.int32()), ("changed", pa.int32()), ("written", pa.int32()), ("places", pa.list_(pa.int32()))]))


def _sided(pairs: DataFrame) -> DataFrame:
    """A documents table of two rows a pair: doc_id is (pair, side)."""
    sides = F.array(F.struct(F.lit("b").alias("side"), F.col("before").alias("text")), F.struct(F.lit("a").alias("side"), F.col("after").alias("text")))
    two = pairs.select("pair_id", F.explode(sides).alias("x")).select("pair_id", "x.*")
    return two.withColumn("doc_id", F.concat_ws("\t", F.col("pair_id").cast("string"), "side"))


def compare(pairs: DataFrame, limits: DataFrame) -> DataFrame:
    """One row a pair(pair_id, before, after, facts): sentences kept and changed, numbers lost and new, statuses that got worse."""
    docs = _sided(pairs)
    keep = ("pair_id", "side")
    recs = records(docs, include_refs=True, keep=keep)
    nums = recs.withColumn("keys", H.number_keys(F.col("text"), drop_bare_digits=True))
    cnt = F.size(F.filter(F.transform(H.words(F.col("masked")), H.strip_end_marks), H.is_connective))
    nums = nums.withColumn("links", cnt)
    ordered = F.array_sort(F.collect_list(F.struct("idx", "text", "line", "links")))
    sides = nums.groupBy("pair_id", "side").agg(ordered.alias("recs"), F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))
    empty = F.array().cast("array<string>")
    b, a = (sides.where(F.col("side") == k).select("pair_id", F.col("recs").alias(f"{k}_recs"), F.col("keys").alias(f"{k}_keys")) for k in ("b", "a"))
    j = pairs.select("pair_id", "facts").join(b, "pair_id", "left").join(a, "pair_id", "left")
    texts = lambda c: F.coalesce(F.transform(c, lambda x: x["text"]), empty)
    j = j.withColumn("al", _alignment(texts("b_recs"), texts("a_recs")))
    old, new = F.coalesce("b_keys", empty), F.coalesce("a_keys", empty)
    facts = F.when(F.col("facts").isNotNull(), F.array_distinct(H.number_keys(F.col("facts"), drop_bare_digits=False)))
    long_new = F.size(F.filter("al.places", lambda i: F.get("a_recs", i)["links"] >= 3))
    j = j.select("pair_id", "al.kept", "al.changed", "al.written", long_new.alias("long_new"), F.array_sort(F.array_except(old, new)).alias("lost_numbers"), F.array_sort(F.array_except(new, old)).alias("new_numbers"), F.array_sort(F.array_except(F.array_except(new, old), facts)).alias("unsupported"))
    res = judge(metrics(docs), limits).select(F.split("doc_id", "\t").alias("d"), "metric_id", "status")
    res = res.select(F.col("d")[0].alias("pair"), F.col("d")[1].alias("side"), "metric_id", "status")
    rank = F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))
    was = res.where("side = 'b'").select("pair", "metric_id", F.col("status").alias("was"))
    now = res.where("side = 'a'").join(was, ["pair", "metric_id"], "left")
    worse = rank[F.col("status")] > F.coalesce(rank[F.col("was")], F.lit(0))
    dist = F.substring_index("metric_id", ".", 1).isin(*(x[:-1] for x in DISTRIBUTION))
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("metric_id"))))
    w = now.groupBy("pair").agg(pick(worse & ~dist).alias("worse_style"), pick(worse & dist).alias("worse_distribution"), pick(F.col("status").isin("GATE", "FAIL")).alias("failing"))
    out = j.join(w, F.col("pair_id").cast("string") == F.col("pair"), "left").drop("pair")
    return out.withColumn("must_fix", (F.size("failing") > 0) | (F.size("worse_style") > 0))


def revision_verdicts(pairs: DataFrame, limits: DataFrame) -> DataFrame:
    return verdicts(judge(metrics(_sided(pairs)), limits))
