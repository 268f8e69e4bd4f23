"""Candidates of repetition in a document: ordered-sequence detectors over its declarative sentences.

R1 same numeric baseline, R3 same subject opener, R4 same frame or last word,
R5 short sentences in a row, R6 a change without a baseline, R7 neighbours with
the same predicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions import hangul as H
from prosemill.functions.plan import settled, written

from .metrics import declared, unicode_rx
from .units import labelled, units

# Endings, openers and patterns.
SUBJECT_ENDINGS = ["은", "는", "이", "가"]
DEMONSTRATIVES = "이 그 저 이런 그런 이러한 그러한 이번 해당 위의 아래".split()
GENERIC_PREDICATES = "있습니다 없습니다 합니다 했습니다 됩니다 됐습니다 되었습니다 않습니다 같습니다 입니다 있었습니다 없었습니다 않았습니다".split()
CHANGE = (
    "(줄었|줄어들|줄어든|줄였|늘었|늘어났|늘어난|늘렸|올랐|올라갔|올라간|떨어졌|떨어뜨|떨어진|내려갔|내려간|낮아졌|낮아진|낮췄|높아졌|높아진|높였|"
    "감소|증가|개선|향상|단축|커졌|커진|작아졌|작아진|빨라졌|빨라진|느려졌|느려진)"
)
TIMES = r"(?<![\w.\-])\d[\d.,]*\s*배(?:$|[^가-힣]|로|가|를|의|에|까지|였|입|이|나|만큼|씩|가량|정도)"
AMOUNT = r"(?<![\w.\-])\d[\d.,]*\s*(%p|%|배|x|×|ms|초|분|시간|개|건|명|GB|MB|KB|TB|토큰|점|회|번)(까지|으로|로)?"
BASELINE = (
    r"(보다|대비|에\s*비해|비교|이전|기준|대신|원래|기존|당초|종전|[가-힣]던\s|[\d.,]+\s*[^\s\d]{0,6}에서\s+(?:약\s+)?[\d.,]+|"
    r"의\s+(?:최대\s+|약\s+|평균\s+)?[\d.,]+\s*배|(?<![가-힣])전(?:보다|에는|과|의|에)?(?=\s|$))"
)
NUMBER = r"(?<![\w.\-])(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d+))?"
SHORT_CHARS = 35
ORDER = ("R6", "R7", "R1", "R4", "R3", "R5")
SHOWN = 8
RUNS = ("k_same", "k_opens", "k_short")


def _sentences(docs: DataFrame, **params) -> DataFrame:
    return labelled(units(docs, **params)).where("kind = 'sentence'")


def _records(sentences: DataFrame, include_refs: bool) -> DataFrame:
    u = sentences.where("type = 'paragraph' or cls not in ('NOUN', 'OTHER')")
    if not include_refs:
        u = u.where("not in_refs")
    w = Window.partitionBy("doc_id").orderBy("pos")
    return u.withColumn("idx", F.row_number().over(w) - 1).withColumn("toks", H.tokens(F.col("masked")))


def records(docs: DataFrame, *, include_refs: bool = False, **params) -> DataFrame:
    """Declarative sentences in order: doc_id, idx (from 0), and a unit's columns, with toks."""
    return _records(_sentences(docs, **params), include_refs)


def baseline_keys(toks):
    """Up to three words that end at what is compared against, if a number is among them."""
    places = F.transform(toks, lambda t, i: F.struct(t.alias("t"), i.alias("i")))

    def end(p):
        t, i = p["t"], p["i"]
        before = F.when(i > 0, F.element_at(toks, F.greatest(i, F.lit(1)))).otherwise("")
        return (
            F.when(t.endswith("보다") & (F.length(t) > 2), i)
            .when((t == "대비") & (i > 0), i - 1)
            .when(t.startswith("비해") & (i > 0) & before.endswith("에"), i - 1)
            .when(t.startswith("비교") & (i > 0) & H.ends(before, ["와", "과"]), i - 1)
        )

    ends = F.filter(F.transform(places, end), lambda e: e.isNotNull())
    windows = F.transform(ends, lambda e: F.slice(toks, F.greatest(e - 1, F.lit(1)), e - F.greatest(e - 2, F.lit(0)) + 1))
    numeric = F.filter(windows, lambda w: F.exists(w, lambda x: x.rlike(unicode_rx(NUMBER))))

    def key(w):
        plain = F.transform(w, H.strip_particle)
        last = F.regexp_replace(F.element_at(plain, -1), "에$", "")
        return F.lower(F.concat_ws(" ", F.filter(F.concat(F.slice(plain, 1, F.size(plain) - 1), F.array(last)), lambda x: x != "")))

    return F.array_distinct(F.transform(numeric, key))


def _ordered(docs: DataFrame, **params) -> DataFrame:
    """Sentences with their place among declarative ones (idx), what stands before, and the numbers of their runs.

    One exchange and one sort by document serve all detectors.
    """
    c = F.col
    u = _sentences(docs, **params)
    counts = (c("type") == "paragraph") | ~c("cls").isin("NOUN", "OTHER")
    # words are made before what is read off them, or the generated code repeats them past what compiles
    u = u.withColumn("counts", counts & ~c("in_refs")).withColumn("toks", H.tokens(c("masked"))).withColumn("_plain", F.ltrim(H.last_word(c("masked")), F.lit("*_~")))
    u = settled(u.drop("raw", "bold", "depth", "level", "list_id", "para", "nth", "last"))
    decl = F.when(c("type") == "paragraph", declared(c("_plain")))
    subject = F.get("toks", F.lit(0))
    u = u.withColumns({
        "decl": decl,
        "k_same": F.when((c("word") != "") & ~c("word").isin(*GENERIC_PREDICATES), c("word")),
        "k_opens": F.when(H.ends(subject, SUBJECT_ENDINGS) & (F.length(subject) >= 2), F.concat_ws("\t", c("section").cast("string"), subject)),
        "k_short": F.when((c("type") == "paragraph") & (F.length("text") < SHORT_CHARS), c("section").cast("string")),
    })
    u = settled(u.select("doc_id", "pos", "block", "type", "line", "section", "after", "text", "masked", "word", "toks", "counts", "decl", "k_same", "k_opens", "k_short"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    u = u.withColumns({f"prev_{k}": F.lag(k).over(w) for k in ("block", "line", "text", "decl")})
    own = Window.partitionBy("doc_id", "counts").orderBy("pos")
    u = u.withColumn("idx", F.row_number().over(own) - 1).withColumn("prev_masked", F.lag("masked").over(own))
    u = u.withColumns({f"n_{k}": (~F.coalesce(F.lag(k).over(own) == c(k), F.lit(False))).cast("int") for k in RUNS})
    return u.withColumns({f"run_{k}": F.sum(f"n_{k}").over(own) for k in RUNS}).drop(*(f"n_{k}" for k in RUNS))


def find_repeats(docs: DataFrame, **params) -> DataFrame:
    """doc_id, id, key, count, adjacent, lines, text, rank: all candidates, in the order in which they are shown."""
    c = F.col
    cut = written(_ordered(docs, **params), "sentences")
    recs = cut.where("counts")
    one = F.lit(0).alias("adjacent")
    cols = ["doc_id", "id", "key", "count", "adjacent", "lines", "text"]

    amounts = F.regexp_extract_all("masked", F.lit(unicode_rx(AMOUNT)), F.lit(1))
    suffix = F.regexp_extract_all("masked", F.lit(unicode_rx(AMOUNT)), F.lit(2))
    change = F.exists(F.arrays_zip(amounts.alias("u"), suffix.alias("s")), lambda x: (x["u"] == "배") | (x["s"] == ""))
    bare = lambda x: ~F.coalesce(x.rlike(unicode_rx(BASELINE)), F.lit(False))
    before = F.when(c("after").isin("sentence", "paragraph"), c("prev_masked"))
    distinct = (F.size(amounts) < 2) | (F.size(F.array_distinct(amounts)) == F.size(amounts))
    says = c("masked").rlike(unicode_rx(CHANGE)) | c("masked").rlike(unicode_rx(TIMES))
    r6 = recs.where(c("masked").rlike("[0-9]") & says & change & bare(c("masked")) & distinct & bare(before))
    r6 = r6.select("doc_id", F.lit("R6").alias("id"), c("after").alias("key"), F.lit(1).cast("long").alias("count"), one, F.array("line").alias("lines"), "text")

    numeric = recs.where(c("masked").rlike("보다|대비|비해|비교") & c("masked").rlike(unicode_rx(NUMBER)))
    k = numeric.select("doc_id", "idx", "section", "line", "text", F.explode(baseline_keys(c("toks"))).alias("key"))
    places = F.array_sort(F.collect_list(F.struct("idx", "section", "line")))
    lines = lambda x: F.transform(x, lambda p: p["line"])
    pairs = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: (b["idx"] == a["idx"] + 1) & (b["section"] == a["section"]))
    r1 = k.groupBy("doc_id", "key").agg(F.count("*").alias("count"), places.alias("p"), F.min_by("text", "idx").alias("text"))
    r1 = r1.withColumn("adjacent", F.size(F.filter(pairs, lambda x: x))).where("count >= 3 or adjacent >= 1").withColumn("lines", lines(c("p"))).withColumn("id", F.lit("R1"))

    usable = recs.where((F.size("toks") >= 3) & (c("word") != "") & ~c("toks")[0].isin(*H.SENTENCE_ADVERBS) & ~c("word").isin(*GENERIC_PREDICATES))
    opener = F.when(c("toks")[0].isin(*DEMONSTRATIVES) & (F.size("toks") > 3), F.concat_ws(" ", F.slice("toks", 1, 2))).otherwise(c("toks")[0])
    r4 = usable.groupBy("doc_id", F.concat(opener, F.lit(" … "), c("word")).alias("key")).agg(F.count("*").alias("count"), lines(places).alias("lines"), F.min_by("text", "idx").alias("text")).where("count >= 3")
    r4 = r4.withColumn("id", F.lit("R4")).withColumn("adjacent", F.lit(0))

    def run(id_: str, key: str, least: int) -> DataFrame:
        got = recs.where(c(key).isNotNull()).groupBy("doc_id", f"run_{key}").agg(F.first(key).alias("key"), F.count("*").alias("count"), lines(places).alias("lines"), F.min_by("text", "idx").alias("text"))
        return got.where(c("count") >= least).select("doc_id", F.lit(id_).alias("id"), "key", "count", one, "lines", "text")

    parts = [r6, r1, r4, run("R4", "k_same", 3), run("R3", "k_opens", 3), run("R5", "k_short", 4)]
    seen = cut.where((c("prev_block") == c("block")) & (c("decl") == c("prev_decl")))
    parts.append(seen.select("doc_id", F.lit("R7").alias("id"), c("decl").alias("key"), F.lit(1).cast("long").alias("count"), one, F.array("prev_line", "line").alias("lines"), F.concat_ws(" ", F.substring("prev_text", 1, 160), F.substring("text", 1, 160)).alias("text")))

    out = parts[0].select(cols)
    for x in parts[1:]:
        out = out.unionByName(x.select(cols))
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("id"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(place, F.desc("count"), F.col("lines")[0], "key"))
    return out.withColumn("rank", rank).withColumn("shown", F.col("rank") <= SHOWN)
