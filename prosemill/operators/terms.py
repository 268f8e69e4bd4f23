"""Metrics of terms, names, sources and verbs: what a sentence means depends on sentences before it.

One Arrow kernel a document, beside the aggregate of ``metrics``; it moves no
rows.  Metrics that need a fact sheet are there only for documents that have
one: no row is not the same as 0.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosemill.functions import korean as K
from prosemill.functions import markdown as M
from prosemill.functions.plan import settled
from prosemill.plans.rules import RULES, by_id

from .metrics import metrics
from .units import ARROW_UNITS, UNITS, exploded, rows_of

ALWAYS = ("G10.num_particle", "A19.term_mix", "A20.species_first", "A20.term_in_list", "A20.abbr_first", "A18.bare_author", "A21.sseuda_senses", "A5.native_verbs", "A7.see_judgment")
WITH_FACTS = ("A19.term_avoid", "A20.term_first", "A20.table_combined_row", "A20.untabled", "A15.unknown_numbers")
MOST = {"A19.term_mix": 5, "A19.term_avoid": 10, "A20.species_first": 5, "A18.bare_author": 10}
REPORT_RULES = ("A14.report_write", "A14.report_write_check")
HANGUL = re.compile("[가-힣]")
NUMBER = re.compile(
    r"(?<![\w.\-])(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d+))?"
    r"(\s*(?:%p|%|배|x|×|ms|초|분|시간|개|건|명|만|억|천|조|GB|MB|KB|TB|토큰|단어|문장|편|회|번|자|어절|쌍|년|점))?"
)


def numbers(text: str, bare_digits: bool) -> list[str]:
    """Normal forms of numbers; single digits without a unit only if asked for."""
    out = []
    for whole, part, unit in NUMBER.findall(text):
        part = part.rstrip("0")
        key = whole.replace(",", "") + ("." + part if part else "")
        if bare_digits or len(key) > 1 or unit.strip():
            out.append(key.lstrip("0") or "0")
    return out


class Article:
    """A document's units in the views that the metrics take."""

    def __init__(self, units: list[dict]):
        self.units = units
        self.sentences = [u for u in self.units if u["kind"] == "sentence"]
        self.body = [u for u in self.sentences if not u["in_refs"]]
        self.korean = [u for u in self.body if HANGUL.search(u["masked"])]
        self.headings = [u for u in self.units if u["kind"] == "heading"]
        self.prose = self.headings + self.body
        raws = [u["raw"] for u in self.units if u["kind"] == "block" and u["type"] in ("paragraph", "list_item")]
        self.italics = list(dict.fromkeys(n for r in raws for n in K.italic_names(r)))
        self.names = frozenset(self.italics) | {n for u in self.sentences if u["in_refs"] for n in K.reference_names(u["text"])}
        self.runs = Counter(r for u in self.body for r in K.latin_runs(u["masked"], self.names))

    def term_mix(self) -> int:
        """Glossed pairs of which both sides come again outside parentheses."""
        pairs = {}
        for u in self.prose:
            if "(" not in u["masked"]:
                continue
            for term, gloss, latin in K.glossed(u["masked"]):
                pairs.setdefault((term.lower(), gloss.lower()), (term, gloss, latin))
        bare = [K.unbracketed(u["masked"]) for u in self.prose]
        here = lambda p: any(re.search(p, b) for b in bare)
        forms = ((K.korean_pattern(t), K.latin_pattern(g)) if latin else (K.latin_pattern(t), K.korean_pattern(g)) for t, g, latin in pairs.values())
        return sum(here(a) and here(b) for a, b in forms)

    def species(self) -> int:
        return len({n.replace(" ", "") for u in self.body for n in K.species(u["masked"], self.italics)})

    def abbreviations(self, described: list[str]) -> int:
        """Abbreviations of three or more uses that no parentheses explain at the first."""
        seen = [a for u in self.body for a in K.abbreviations(u["masked"])]
        count, first = Counter(a for a, _ in seen), dict(reversed(seen))
        skip = K.KNOWN_ABBREVIATIONS | {t.upper() for t in described}
        return sum(n >= 3 and a not in skip and not first[a] for a, n in count.items())

    def in_lists(self, terms: list[str]) -> int:
        """Terms first named in an enumeration, not taken up in the next sentence, and later used alone."""
        found = 0
        low = [u["masked"].lower() for u in self.body]
        for term in terms:
            pattern, near = K.term_pattern(term), term.lower()
            places = [(k, p) for k, u in enumerate(self.body) if near in low[k] and (p := K.place_in_list(u["masked"], pattern))]
            if len(places) < 2:
                continue
            (k, (listed, _, described)), (after, _) = places[:2]
            found += listed and not described and after != k + 1 and any(p[1] for _, p in places[1:])
        return found

    def bare_authors(self) -> int:
        """Subjects like "the authors" where no work is named in the sentence or the one before, if two works are cited."""
        cited = {w for u in self.body for w in K.works(u["text"])}
        named = {w.rsplit(" ", 1)[0] for w in cited if w[0] != "#"}
        if sum(w[0] != "#" or w[1:] not in named for w in cited) < 2:
            return 0
        hits, clear = 0, False
        for u in self.units:
            if u["kind"] != "sentence":
                # headings, tables, code and quotes part what is before from what is after
                clear = clear and u["kind"] == "block" and u["type"] in ("paragraph", "list_item")
                continue
            if u["in_refs"]:
                continue
            source = bool(K.CITED_WORK.search(u["text"]) or K.NAMED_SOURCE.search(u["masked"]))
            if K.BARE_AUTHOR.search(u["masked"].lstrip()) and not source:
                hits += not clear
            else:
                clear = source
        return hits

    def verb_senses(self, reports: list[re.Pattern]) -> int:
        """1 if one verb is used both for using and for reporting what a source says."""
        writing = [u for u in self.korean if K.WRITE.search(u["masked"])]
        said = [any(r.search(u["masked"]) for r in reports) or bool(K.CITED_WORK.search(u["text"])) for u in writing]
        used = any(not s and K.WRITE_AS_USE.search(u["masked"]) for u, s in zip(writing, said, strict=True))
        return int(used and any(said))

    def unknown_numbers(self, facts: str) -> int:
        known = set(numbers(K.without_general_knowledge(facts), True))
        squeezed = re.sub(r"\s+", "", facts)
        views = [(u["text"], u["masked"]) for u in self.sentences] + [(u["text"], u["text"]) for u in self.headings]
        return sum(n not in known for t, _ in views for n in numbers(K.plain(t), False)) + sum(w not in squeezed for _, m in views for w in K.approximate(m))


def measure(text: str | None, facts: str | None, reports: list[re.Pattern]) -> dict[str, int]:
    return measured(M.units(text), facts, reports)


def measured(units: list[dict], facts: str | None, reports: list[re.Pattern]) -> dict[str, int]:
    a = Article(units)
    described = K.described_terms(facts) if facts is not None else []
    inside = {m.group().lower() for d in described for m in K.LATIN_RUN.finditer(d)}
    listed = described + [r for r, n in a.runs.items() if n >= 2 and r not in inside]
    out = {
        "G10.num_particle": sum(len(K.wrong_particles(u["masked"])) for u in a.prose if HANGUL.search(u["masked"])),
        "A19.term_mix": a.term_mix(),
        "A20.species_first": a.species(),
        "A20.term_in_list": a.in_lists(listed),
        "A20.abbr_first": a.abbreviations(described),
        "A18.bare_author": a.bare_authors(),
        "A21.sseuda_senses": a.verb_senses(reports),
        "A5.native_verbs": sum(bool(K.native_verbs(u["masked"])) for u in a.korean),
        "A7.see_judgment": sum(K.judgement(u["masked"]) is not None for u in a.korean),
    }
    if facts is not None:
        bare = [K.unbracketed(u["masked"]) for u in a.prose]
        # a spelling to be avoided counts inside compounds too
        avoided = [K.latin_pattern(t) if re.fullmatch(r"[A-Za-z0-9 .'\-]+", t) else "(?<![가-힣])" + re.escape(t) for t in K.avoided_terms(facts)]
        vocabulary = K.table_words(facts)
        out |= {
            "A19.term_avoid": sum(any(re.search(p, b) for b in bare) for p in avoided),
            "A20.term_first": sum(any(re.search(K.term_pattern(t), u["masked"]) for u in a.body) for t in described),
            "A20.table_combined_row": sum(len(K.split_terms(r["wanted"])) > 1 for r in K.fact_rows(facts)),
            "A20.untabled": sum(n >= 2 and r not in vocabulary for r, n in a.runs.items()),
            "A15.unknown_numbers": a.unknown_numbers(M.normal_text(facts)),
        }
    return {k: min(v, MOST.get(k, v)) for k, v in out.items()}


COUNTS = T.ArrayType(T.StructType().add("metric_id", T.StringType()).add("value", T.DoubleType()))
_ARROW_COUNTS = pa.list_(pa.struct([("metric_id", pa.string()), ("value", pa.float64())]))


def _counted(docs: DataFrame, rules, doc_id: str, text: str, facts: str | None, *, with_units: bool) -> DataFrame:
    """doc_id, more (the document's counts) and, with ``with_units``, _u (its units): one parse of each document."""
    found = by_id(rules)
    patterns = [p for k in REPORT_RULES if k in found for p in found[k].patterns]
    kind = T.StructType().add("more", COUNTS).add("_u", UNITS) if with_units else T.StructType().add("more", COUNTS)
    arrow = pa.struct([("more", _ARROW_COUNTS), *([("_u", ARROW_UNITS)] if with_units else [])])

    @F.arrow_udf(kind)
    def count(texts: pa.Array, sheets: pa.Array) -> pa.Array:
        reports = [re.compile(p) for p in patterns]
        out = []
        for t, s in zip(texts.to_pylist(), sheets.to_pylist(), strict=True):
            units = M.units(t)
            row = {"more": [{"metric_id": k, "value": float(v)} for k, v in measured(units, s, reports).items()]}
            out.append(row | {"_u": rows_of(units)} if with_units else row)
        return pa.array(out, arrow)

    sheet = F.col(facts) if facts else F.lit(None)
    made = docs.select(F.col(doc_id).alias("doc_id"), count(F.col(text), sheet.cast("string")).alias("_m"))
    return settled(made).select("doc_id", "_m.*")


def term_metrics(docs: DataFrame, rules=RULES, *, doc_id: str = "doc_id", text: str = "text", facts: str | None = None) -> DataFrame:
    """doc_id, metric_id, value."""
    return _counted(docs, rules, doc_id, text, facts, with_units=False).select("doc_id", F.inline("more"))


def all_metrics(docs: DataFrame, rules=RULES, *, facts: str | None = None, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """doc_id, metric_id, value, chars, tone: the aggregate's metrics and those of terms; doc_ids don't repeat.

    A document's counts travel with its first unit, so both kinds of metrics
    come of one parse and one exchange.
    """
    u = exploded(_counted(docs, rules, doc_id, text, facts, with_units=True), "more")
    u = u.withColumn("more", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("more")))
    return metrics(docs, rules, facts=facts, parsed=u, doc_id=doc_id, text=text, **params)
