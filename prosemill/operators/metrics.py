"""Named metrics of documents, in long form: doc_id, metric_id, value.

All rules and counts are one aggregate by doc_id over the labelled units; what
needs neighbours takes them from one window order (doc_id, pos).  Units are
dealt by doc_id already, so the plan has one exchange, of the texts.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosemill.functions import hangul as H
from prosemill.functions.plan import settled
from prosemill.plans.rules import RULES, Rule, by_id

from .units import labelled, units

# Character classes, question headings, stems.
EMOJI = "[\\x{1F000}-\\x{1FAFF}☀-⛿✀-➿⭐⭕‼⁉]"
EM_DASH = "[—―]"
SPACED_HYPHEN = r"""[가-힣][)\]'"”’]?\s+-{1,2}\s+\S|\S\s+-{1,2}\s+[가-힣]"""
POLICY_MARKS = "[·•‧∙・･–‒−]"
DIGIT_RANGE = r"\d\s?[–‒—―−]\s?\d"
MATH = r"\$\$[^$]+\$\$|\$[^$\n가-힣]+\$"
QUESTION_HEADING = r"(\?|을까|를까|할까|일까|될까|볼까|까요|나요|는가|인가)$"
STEM_ENDING = r"(인|으로|하는\s*바|하|합|해|한|할|했|점|니다|요)$"
SPLIT_CONTRAST = "(아닙니다|아니에요|아니다|않습니다|않아요)[.]?$"
LABEL_RAW = r"^\s*(\*\*|__)[^*_]{1,40}(\*\*|__)\s*[:：]"
LABEL_TEXT = r"^[^\s:：]{1,20}\s*[:：]\s"
CONTRAST_RULES = ("A1.np_anira", "A1.np_rather", "A1.np_geuchi", "A1.np_neomeo", "A1.np_deoisang", "A1.np_simple")
PER_1K = ("A5.style_words", "A5.policy_verbs", "A12.progressive", "A13.demonstrative_start", "A14.translationese")
REPORT_RULES = ("A14.report_write", "A14.report_write_check")
LONG_CHARS, HIT_CHARS, CONTRAST_WORDS = 80, 160, 12

#: Decimal places of metrics that are shares, means or rates.
PLACES = {"A8.sent_len_mean": 1, "A8.sentences_per_para": 2, "A9.bold_per_1k": 2, "A9.heading_per_1k": 2, "A10.triad_per_1k": 2} | {f"{k}_per_1k": 2 for k in PER_1K}


def unicode_rx(pattern: str) -> str:
    return "(?U)" + pattern


def any_of(target: Column, patterns) -> Column:
    return target.rlike(unicode_rx("|".join(f"(?:{p})" for p in patterns)))


def first_match(target: Column, patterns) -> Column:
    """What the first pattern that occurs matches."""
    return F.coalesce(*(F.when(target.rlike(unicode_rx(p)), F.regexp_extract(target, unicode_rx(p), 0)) for p in patterns))


def needs_hangul(pattern: str) -> bool:
    """Whether whatever the pattern matches holds a Korean letter."""
    parts = re._parser

    def hangul(code: int) -> bool:
        return 0xAC00 <= code < 0xAC00 + 11172

    def member(op, arg) -> bool:
        name = str(op)
        if name == "LITERAL":
            return hangul(arg)
        return name == "RANGE" and hangul(arg[0]) and hangul(arg[1])

    def needs(seq) -> bool:
        for op, arg in seq:
            name = str(op)
            if name == "LITERAL" and hangul(arg):
                return True
            if name == "IN" and all(member(*x) for x in arg):
                return True
            if name == "BRANCH" and all(needs(x) for x in arg[1]):
                return True
            if name == "SUBPATTERN" and needs(arg[3]):
                return True
            if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0 and needs(arg[2]):
                return True
        return False

    return needs(parts.parse(pattern))


def rule_hit(rule: Rule) -> Column:
    """Whether a unit counts for the rule.  Patterns that need Korean letters run on text that has some (_ko)."""
    kind, sentence = F.col("kind"), F.col("kind") == "sentence"
    pool = {
        "para_last": sentence & (F.col("type") == "paragraph") & F.col("last"),
        "paragraph": F.col("body") & (F.col("type") == "paragraph"),
        "all": sentence & ~F.col("in_refs"),
    }.get(rule.scope, F.col("body"))
    if rule.max_len:
        pool = pool & (F.length("text") <= rule.max_len)
    if rule.headings:
        pool = pool | (kind == "heading")
    if rule.tables:
        pool = pool | ((kind == "row") & ~F.col("in_refs"))
    if all(map(needs_hangul, rule.patterns)):
        pool = F.col("_ko") & pool
    return pool & any_of(F.col("text") if rule.raw else F.col("masked"), rule.patterns)


def largest_count(values: Column) -> Column:
    """How often the most frequent value stands in an array."""
    state = F.struct(F.lit(None).cast("string").alias("k"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(a, x):
        n = F.when(a["k"] == x, a["n"] + 1).otherwise(1)
        return F.struct(x.alias("k"), n.alias("n"), F.greatest(a["best"], n).alias("best"))

    return F.aggregate(F.array_sort(values), state, step, lambda a: a["best"])


def thrice(values: Column) -> Column:
    """How many numbers stand in an array exactly three times: one walk over it in order."""
    state = F.struct(F.lit(None).cast("int").alias("k"), F.lit(0).alias("n"), F.lit(0).alias("three"))
    closed = lambda a: a["three"] + (a["n"] == 3).cast("int")

    def step(a, x):
        same = F.coalesce(a["k"] == x, F.lit(False))
        return F.struct(x.alias("k"), F.when(same, a["n"] + 1).otherwise(1).alias("n"), F.when(same, a["three"]).otherwise(closed(a)).alias("three"))

    return F.aggregate(F.array_sort(values), state, step, closed)


def paragraph_counts(sentences: Column) -> Column:
    """struct(paras, alone, triad, np) of sentences(p, triad, np): paragraphs, those of one sentence, and those with two or more triads and contrasts.

    One walk over the sentences in order of their paragraphs.
    """
    flags = ("triad", "np")
    zero = lambda *names: [F.lit(0).alias(k) for k in names]
    state = F.struct(F.lit(None).cast("int").alias("p"), *zero("n", *flags, "paras", "alone", *(f"two_{k}" for k in flags)))

    def closed(a) -> dict[str, Column]:
        return {"paras": a["paras"] + (a["n"] > 0).cast("int"), "alone": a["alone"] + (a["n"] == 1).cast("int")} | {f"two_{k}": a[f"two_{k}"] + (a[k] >= 2).cast("int") for k in flags}

    def step(a, x):
        same = F.coalesce(a["p"] == x["p"], F.lit(False))
        hit = {k: F.coalesce(x[k], F.lit(False)).cast("int") for k in flags}
        own = {"n": F.when(same, a["n"] + 1).otherwise(1)} | {k: F.when(same, a[k]).otherwise(0) + hit[k] for k in flags}
        return F.struct(x["p"].alias("p"), *(v.alias(k) for k, v in own.items()), *(F.when(same, a[k]).otherwise(v).alias(k) for k, v in closed(a).items()))

    def done(a):
        c = closed(a)
        return F.struct(c["paras"].alias("paras"), c["alone"].alias("alone"), *(c[f"two_{k}"].alias(k) for k in flags))

    return F.aggregate(F.array_sort(sentences), state, step, done)


def declared(word: Column) -> Column:
    """The last word of a declarative sentence outside references; null of any other."""
    c = F.col
    ok = ~c("in_refs") & ~c("question") & H.ending_class(word, c("question")).isin("HAPNIDA", "HAEYO", "HAERA")
    ok = ok & ~H.ends(word, ["십시오", "세요", "시다", "니까"]) & word.rlike("^[가-힣]+$")
    return F.when(ok, word)


def features(u: DataFrame, rules=RULES, *, short: bool = False) -> DataFrame:
    """Labelled units as narrow rows: flags and numbers that metrics sum up, and text only where a metric needs it.

    All of it is made before units are dealt by document, so what is dealt is
    small beside the texts.
    """
    c = F.col
    kind, text, masked, body = c("kind"), c("text"), c("masked"), c("body")
    sentence, heads = kind == "sentence", kind == "heading"
    prose = (kind == "block") & c("type").isin("paragraph", "list_item")
    item = (kind == "block") & (c("type") == "list_item")
    sub = heads & (c("level") >= 2)
    in_para = sentence & (c("type") == "paragraph")
    some = lambda cond, v: F.when(cond, v)
    u = u.withColumns({"_ko": text.rlike("[가-힣]"), "_plain": some(sentence, F.ltrim(H.last_word(masked), F.lit("*_~")))})
    u = settled(u)
    hit = {r.id: rule_hit(r) for r in rules}
    contrast = reduce(lambda a, b: a | b, (hit[k] for k in CONTRAST_RULES if k in hit), F.lit(False))
    opener = F.regexp_extract(masked, r"(?U)^(\S+?)\s*[,，]", 1)
    head = H.words(F.regexp_replace(masked, r"(?U)^[^\w가-힣⟦]+", ""))
    toks = H.words(masked)
    joined = F.transform(F.slice(toks, 1, F.greatest(F.size(toks) - 1, F.lit(0))), lambda t, i: F.struct(H.strip_end_marks(t).alias("w"), t.rlike("[,，]$").alias("c"), i.alias("i")))
    links = F.filter(joined, lambda x: ~((x["i"] == 0) & x["w"].isin(*H.SENTENCE_ADVERBS)) & H.is_connective(x["w"]))
    target = F.regexp_replace(F.when(kind == "row", c("raw")).otherwise(text), unicode_rx(MATH), "⟦M⟧")
    marked = heads | (kind == "row") | ((kind == "block") & c("type").isin("paragraph", "list_item", "blockquote"))
    in_list = c("in_refs") & ~heads
    marks = lambda rx: F.regexp_count(target, F.lit(unicode_rx(rx)))
    style = by_id(rules).get("A5.style_words")
    out = {
        "f_body": body, "f_prose": prose, "f_item": item, "f_sub": sub, "f_head": heads, "f_in_para": in_para, "f_para": body & (c("type") == "paragraph"),
        "chars": some(prose, H.visible_chars(text)), "size": some(sentence, F.length(text)), "n_bold": some(prose, c("bold")),
        "f_label": item & (c("raw").rlike(unicode_rx(LABEL_RAW)) | text.rlike(unicode_rx(LABEL_TEXT))),
        "f_colon": sub & text.rlike("[:：]"), "f_asked": sub & F.rtrim(text).rlike(unicode_rx(QUESTION_HEADING)),
        "n_commas": some(body, H.comma_count(masked)), "links": some(body & c("_ko"), F.transform(links, lambda x: x["c"])),
        "opener": some(body & (F.size(head) >= 2), F.concat_ws(" ", F.slice(head, 1, 2))),
        "f_triad": some(sentence, H.is_triad(masked)), "n_words": some(sentence, F.size(toks)),
        "f_contrast": contrast, "np_text": some(contrast, F.substring(text, 1, HIT_CHARS)),
        "split_text": some(in_para & c("_ko") & masked.rlike(unicode_rx(SPLIT_CONTRAST)), text),
        "stem": some(hit["A5.style_words"], F.regexp_replace(first_match(masked, style.patterns), unicode_rx(STEM_ENDING), "")) if style else F.lit(None).cast("string"),
        "f_g2": body & H.ends(c("word"), H.EXPERIENCE), "f_g7": body & opener.isin(*H.CONJUNCTIONS),
        "f_adverb": body & opener.isin(*H.SENTENCE_ADVERBS) & ~opener.isin(*H.CONJUNCTIONS),
        "f_emoji": (heads | prose) & text.rlike(EMOJI), "f_semicolon": prose & ~c("in_refs") & F.regexp_replace(text, H.PLACEHOLDER, "").contains(";"),
        "n_emdash": some(marked & ~in_list, marks(EM_DASH) + marks(SPACED_HYPHEN)), "n_policy": some(marked, F.when(in_list, marks(DIGIT_RANGE)).otherwise(marks(POLICY_MARKS))),
        "f_question": body & c("question"), "f_beyond": heads & any_of(masked, by_id(rules)["G8.beyond_simple"].patterns) if "G8.beyond_simple" in hit else F.lit(False),
        "f_off_default": _off_tone("HAPNIDA", "default", short), "f_off_casual": _off_tone("HAEYO", "casual"), "f_banned": _judged() & H.ends(c("word"), H.BANNED),
        "decl": some(in_para, declared(c("_plain"))), "title_text": some(heads, text), "title_masked": some(heads, masked),
    }
    quoted = hit.get("A14.quoted_english_token", F.lit(False))
    out |= {f"r_{i}": hit[r.id] & ~quoted if r.id in REPORT_RULES else hit[r.id] for i, r in enumerate(rules)}
    keep = ["doc_id", "pos", "block", "line", "level", "list_id", "depth", "para", "cls", "bucket"]
    if "more" in u.columns:
        keep.append("more")
    return u.select(*keep, *(v.alias(k) for k, v in out.items()))


def prepared(docs: DataFrame, rules=RULES, *, parsed: DataFrame | None = None, short: bool = False, **params) -> DataFrame:
    """Features with what neighbours bring, from one window order."""
    u = settled(features(labelled(units(docs, **params) if parsed is None else parsed), rules, short=short))
    w = Window.partitionBy("doc_id").orderBy("pos")
    c = F.col
    same_block = lambda shift: shift("block").over(w) == c("block")
    u = u.withColumns({
        "_prev_decl": F.when(same_block(F.lag), F.lag("decl").over(w)),
        "_next_words": F.when(same_block(F.lead), F.lead("n_words").over(w)),
        "_prev_bucket": F.last(F.when(c("f_para"), c("bucket")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "_seq": F.sum(F.coalesce(c("f_para"), F.lit(False)).cast("int")).over(w),
    })
    goes_on = (c("bucket") == c("_prev_bucket")) & ~c("bucket").isin("NOUN", "OTHER")
    u = u.withColumn("_run_start", F.when(c("f_para") & ~F.coalesce(goes_on, F.lit(False)), c("_seq")))
    u = u.withColumn("_run", F.when(c("f_para"), c("_seq") - F.last("_run_start", ignorenulls=True).over(w) + 1))
    return u.withColumn("_cross", F.coalesce(c("split_text").isNotNull() & (c("_next_words") <= CONTRAST_WORDS), F.lit(False)))


def wide(docs: DataFrame, rules=RULES, **params) -> DataFrame:
    """One row for each document: counts and sums from which the metrics are made."""
    u = prepared(docs, rules, **params)
    c = F.col
    count = lambda k: F.count_if(F.coalesce(c(k), F.lit(False)))
    listed = lambda cond, v: F.collect_list(F.when(c(cond), v))
    para = F.struct(c("para").alias("p"), c("f_triad").alias("triad"), (c("f_contrast") & (c("size") <= HIT_CHARS) | c("_cross")).alias("np"))
    title = F.min(F.when(c("f_head"), F.struct((c("level") != 1).alias("other"), c("pos"), c("title_text").alias("text"), c("title_masked").alias("masked"))))
    size = F.when(c("f_para"), c("size"))
    key = lambda t: F.when(c(t).isNotNull(), F.struct(c("line").alias("l"), c(t).alias("t")))
    aggs = {
        "chars": F.sum("chars"), "sentences": count("f_body"), "headings": count("f_sub"), "list_items": count("f_item"), "title": title, "bold": F.sum("n_bold"),
        "list_chars": F.sum(F.when(c("f_item"), c("chars"))), "labels": count("f_label"), "colons": count("f_colon"), "asked": count("f_asked"),
        "commas": F.sum("n_commas"), "with_comma": F.count_if(F.coalesce(c("n_commas") > 0, F.lit(False))),
        "links": F.sum(F.when(c("links").isNotNull(), F.size("links"))), "link_commas": F.sum(F.when(c("links").isNotNull(), F.size(F.filter("links", lambda x: x)))), "openers": F.collect_list("opener"),
        "n_para": count("f_para"), "len_mean": F.avg(size), "len_sd": F.stddev_pop(size), "long": F.count_if(F.coalesce(size >= LONG_CHARS, F.lit(False))),
        "buckets": listed("f_body", c("bucket")), "classes": listed("f_body", c("cls")), "per_para": listed("f_in_para", para),
        "listed": F.collect_list(F.when(c("f_item") & (c("depth") == 0), c("list_id"))), "triads": F.count_if(F.coalesce(c("f_body") & c("f_triad"), F.lit(False))),
        "np_rule": F.collect_set(key("np_text")), "np_cross": F.collect_set(F.when(c("_cross"), key("split_text"))), "stems": F.collect_list("stem"),
        "g2": count("f_g2"), "g7": count("f_g7"), "adverbs": count("f_adverb"), "emoji": count("f_emoji"), "semicolon": count("f_semicolon"),
        "emdash": F.sum("n_emdash"), "policy": F.sum("n_policy"), "questions": count("f_question"), "run4": F.count_if(F.coalesce(c("_run") == 4, F.lit(False))),
        "same": F.count_if(F.coalesce(c("decl") == c("_prev_decl"), F.lit(False))), "beyond": count("f_beyond"),
        "off_default": count("f_off_default"), "off_casual": count("f_off_casual"), "banned": count("f_banned"),
    }
    aggs |= {f"r_{i}": count(f"r_{i}") for i in range(len(rules))}
    if "more" in u.columns:
        aggs["more"] = F.first("more", ignorenulls=True)
    return u.groupBy("doc_id").agg(*(v.alias(k) for k, v in aggs.items()))


def _judged() -> Column:
    """Sentences whose tone counts: a class, and outside reference lists."""
    return F.col("body") & ~F.col("cls").isin("NOUN", "OTHER") & ~F.col("in_refs")


def _off_tone(cls: str, tone: str, short: bool = False) -> Column:
    """Sentences of another tone; in short texts a formal one may ask with "-seyo" and "-ingayo"."""
    word, asked = F.col("word"), F.rtrim("text").endswith("?")
    listed = (F.col("cls") == "NOMINAL") & (F.col("type") != "paragraph")
    off = _judged() & ~listed & ~F.col("cls").isin(cls, "Q_KKAYO")
    if tone == "casual":
        return off & ~H.ends(word, H.BANNED)
    # fixed values: endings of requests and of questions
    return off & ~F.when(asked, word.endswith("인가요")).otherwise(word.endswith("세요")) if short else off


def tone(w: DataFrame) -> Column:
    polite, formal = (F.size(F.filter("classes", lambda c: c == k)) for k in ("HAEYO", "HAPNIDA"))  # noqa: B023
    return F.when(polite > formal, "casual").otherwise("default")


def values(rules=RULES) -> dict[str, Column]:
    """Each metric from the columns of ``wide``; shares with nothing to share are 0."""
    c = F.col
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    place = {r.id: c(f"r_{i}") for i, r in enumerate(rules)}
    chars = F.coalesce(c("chars"), F.lit(0))
    per_k = F.when(chars > 0, F.lit(1000.0) / chars).otherwise(F.lit(0.0))
    n_body = F.greatest(c("sentences"), F.lit(1))
    paras = c("para_counts")
    pred = F.filter("buckets", lambda b: ~b.isin("NOUN", "OTHER"))
    bucket = lambda k: ratio(F.size(F.filter("buckets", lambda b: b == k)), F.greatest(F.size(pred), F.lit(1)))
    triple = thrice(c("listed"))
    title = F.coalesce(reduce(lambda a, b: a | b, (any_of(c("title.masked"), r.patterns) for r in rules if r.id in CONTRAST_RULES)), F.lit(False))
    out = {k: v for k, v in place.items()}
    out["G8.beyond_simple"] = place["G8.beyond_simple"] + c("beyond")
    out |= {
        "A1.np_title": title.cast("int"), "A1.np": F.size(F.array_union("np_rule", "np_cross")),
        "A1.np_first_para": F.size(F.filter("per_para", lambda x: (x["p"] == 0) & x["np"])), "A1.np_same_para": paras["np"],
        "G6.emoji": c("emoji"), "G6.semicolon": c("semicolon"), "G6.emdash": F.coalesce(c("emdash"), F.lit(0)), "G6.punct_policy": F.coalesce(c("policy"), F.lit(0)),
        "G7.conj_comma": c("g7"), "INFO.adverb_comma": c("adverbs"), "G2.exp_ending": c("g2"),
        "A2.comma_per_sentence": F.coalesce(c("commas"), F.lit(0)) / n_body, "A2.comma_sentence_ratio": c("with_comma") / n_body,
        "A2.connective_comma_ratio": ratio(F.coalesce(c("link_commas"), F.lit(0)), F.coalesce(c("links"), F.lit(0))),
        "A17.opener_repeat": largest_count(c("openers")), "A16.source_subject_share": place["A16.source_subject"] / n_body,
        "A4.para_end": place["A4.summary_start"] + place["A4.lesson_end"],
        "A8.sent_len_mean": F.coalesce(c("len_mean"), F.lit(0.0)), "A8.sent_len_cv": F.coalesce(ratio(c("len_sd"), c("len_mean")), F.lit(0.0)), "A8.long_ratio": ratio(c("long"), c("n_para")),
        "A8.ending_run4": c("run4"), "A8.same_predicate_adjacent": c("same"), "A8.ending_top_share": ratio(largest_count(pred), F.size(pred)),
        "A8.sentences_per_para": ratio(F.size("per_para"), paras["paras"]), "A8.single_para_ratio": ratio(paras["alone"], paras["paras"]),
        "A9.bold_per_1k": F.coalesce(c("bold"), F.lit(0)) * per_k, "A9.list_ratio": ratio(F.coalesce(c("list_chars"), F.lit(0)), chars),
        "A9.label_list_ratio": ratio(c("labels"), c("list_items")), "A9.heading_per_1k": c("headings") * per_k, "A9.heading_colon_ratio": ratio(c("colons"), c("headings")),
        "A10.triad_per_1k": (c("triads") + triple) * per_k, "A10.triad_same_para": paras["triad"],
        "A11.body_questions": c("questions"), "A11.question_heading_ratio": ratio(c("asked"), c("headings")),
        "A5.word_max": largest_count(c("stems")),
        "G4.off_tone": F.when(c("tone") == "casual", c("off_casual")).otherwise(c("off_default")), "G4.banned_ending": F.when(c("tone") == "casual", c("banned")).otherwise(0),
        "T.jyo_ratio": bucket("C_JYO"), "T.geudeun_ratio": bucket("C_GEUDEUN"), "T.kkayo_ratio": bucket("Q_KKAYO"), "T.neundeyo_ratio": bucket("C_NEUNDEYO"),
    }
    out |= {f"{k}_per_1k": place[k] * per_k for k in PER_1K}
    return out


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def py_round(values: pa.Array, places: pa.Array) -> pa.Array:
    """Arrays rounded half to even on the exact binary value, which no built-in function does; one call a batch of documents."""
    out = [vs and [None if v is None else float(round(v, p)) for v, p in zip(vs, ps, strict=True)] for vs, ps in zip(values.to_pylist(), places.to_pylist(), strict=True)]
    return pa.array(out, pa.list_(pa.float64()))


def metrics(docs: DataFrame, rules=RULES, *, rounded: bool = True, given_tone: str | None = None, facts: str | None = None, **params) -> DataFrame:
    """doc_id, metric_id, value, chars, tone: every metric of every document.

    Words of style whose stem stands in the document's fact sheet don't count.
    ``parsed`` takes units made elsewhere, with a column more (an array of
    metric_id and value) on each document's first; ``short`` judges the tone as
    that of a short text.
    """
    w = wide(docs, rules, **params)
    style = next((f"r_{i}" for i, r in enumerate(rules) if r.id == "A5.style_words"), None)
    if facts and style:
        sheets = docs.select(F.col(params.get("doc_id", "doc_id")).alias("doc_id"), F.col(facts).alias("_facts"))
        w = w.join(sheets, "doc_id", "left").withColumn("stems", F.filter("stems", lambda s: ~((s != "") & F.coalesce(F.col("_facts").contains(s), F.lit(False)))))
        w = w.withColumn(style, F.size("stems").cast("long"))
    w = settled(w.withColumn("tone", F.lit(given_tone) if given_tone else tone(w)).withColumn("para_counts", paragraph_counts(F.col("per_para"))))
    named = F.array(*(F.struct(F.lit(k).alias("metric_id"), v.cast("double").alias("value"), F.lit(PLACES.get(k, 3)).alias("places")) for k, v in values(rules).items()))
    if "more" in w.columns:
        added = F.transform("more", lambda x: F.struct(x["metric_id"].alias("metric_id"), x["value"].alias("value"), F.lit(0).alias("places")))
        named = F.concat(named, F.coalesce(added, F.array().cast("array<struct<metric_id:string,value:double,places:int>>")))
    w = w.select("doc_id", F.coalesce("chars", F.lit(0)).alias("chars"), "tone", named.alias("named"))
    if rounded:
        w = settled(w.withColumn("exact", py_round(F.transform("named", lambda x: x["value"]), F.transform("named", lambda x: x["places"]))))
        w = w.withColumn("named", F.zip_with("named", "exact", lambda x, v: F.struct(x["metric_id"].alias("metric_id"), v.alias("value"))))
    return w.select("doc_id", "chars", "tone", F.inline("named")).select("doc_id", "metric_id", "value", "chars", "tone")


def stats(docs: DataFrame, rules=RULES, **params) -> DataFrame:
    """doc_id, chars, sentences, paragraphs, headings, list_items, title, tone."""
    w = wide(docs, rules, **params)
    paras = F.size(F.array_distinct(F.transform("per_para", lambda x: x["p"])))
    return w.select("doc_id", F.coalesce("chars", F.lit(0)).alias("chars"), "sentences", paras.alias("paragraphs"), "headings", "list_items", F.coalesce("title.text", F.lit("")).alias("title"), tone(w).alias("tone"))
