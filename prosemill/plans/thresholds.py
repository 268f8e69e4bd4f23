"""Limits of metrics.  A limit that is not known is null: a value beyond the one before it is OVER, not WARN or FAIL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .rules import RULES

SCHEMA = (
    "metric_id string, kind string, pass_max double, warn_max double, pass_min double, warn_min double, pass_lo double, pass_hi double, "
    "warn_lo double, warn_hi double, rate_per_1k double, pass_q double, warn_q double, tone string, min_chars long, policy boolean, fixed boolean, grp string, exclude_site string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
RHYTHM_CHARS = 1500


def _row(metric_id: str, kind: str, **limits) -> tuple:
    known = {"metric_id": metric_id, "kind": kind, "policy": False, "fixed": False} | limits
    return tuple(known.get(c) for c in COLUMNS)


def _gates() -> list[tuple]:
    own = [r.id for r in RULES if r.id[0] == "G"] + ["G2.exp_ending", "G4.off_tone", "G4.banned_ending", "G6.emoji", "G6.semicolon", "G6.emdash", "G6.punct_policy", "G7.conj_comma", "G10.num_particle"]
    return [_row(k, "gate", pass_max=0.0, policy=not k.startswith(("G8.", "G9."))) for k in own]


# Published limits.
REGISTRY = (
    *_gates(),
    _row("A1.np", "poisson", rate_per_1k=0.245, pass_q=0.95, warn_q=0.995),
    _row("A1.np_simple", "upper", pass_max=1.0),
    _row("A1.np_title", "upper", pass_max=0.0, warn_max=0.0, fixed=True),
    _row("A1.np_same_para", "upper", pass_max=0.0, warn_max=2.0),
    _row("A2.comma_per_sentence", "upper", pass_max=0.88, min_chars=RHYTHM_CHARS),
    _row("A2.connective_comma_ratio", "upper", pass_max=0.34, min_chars=RHYTHM_CHARS),
    _row("A3.salience", "upper", pass_max=2.0, warn_max=3.0),
    _row("A4.para_end", "upper", pass_max=3.0),
    _row("A4.obligation_end", "upper", pass_max=2.0),
    _row("A4.gyeolguk", "upper", pass_max=2.0),
    _row("A4.summary_opener", "upper", pass_max=1.0),
    _row("A5.style_words_per_1k", "upper", pass_max=0.36, min_chars=RHYTHM_CHARS),
    _row("A5.word_max", "upper", pass_max=2.0, warn_max=4.0),
    _row("A6.calque", "upper", pass_max=1.0),
    _row("A7.hedge_stack", "upper", pass_max=1.0),
    _row("A7.hedge_boimnida", "upper", pass_max=0.0, warn_max=2.0),
    _row("A7.must_may", "upper", pass_max=0.0, warn_max=1.0),
    _row("A7.read_as", "upper", pass_max=0.0, warn_max=1.0),
    _row("A7.see_as", "poisson", rate_per_1k=0.023, pass_q=0.95, warn_q=0.995),
    _row("A7.see_judgment", "poisson", rate_per_1k=0.011, pass_q=0.95, warn_q=0.995),
    _row("A5.native_verbs", "poisson", rate_per_1k=0.096, pass_q=0.975, warn_q=0.999),
    _row("A8.sent_len_mean", "info"),
    _row("A8.ending_run4", "info"),
    _row("A8.sent_len_cv", "lower", pass_min=0.37, min_chars=RHYTHM_CHARS),
    _row("A8.long_ratio", "lower", pass_min=0.065, min_chars=RHYTHM_CHARS),
    _row("A8.single_para_ratio", "lower", pass_min=0.115, warn_min=0.059, min_chars=RHYTHM_CHARS),
    _row("A8.same_predicate_adjacent", "check", grp="rhythm"),
    _row("A8.ending_top_share", "upper", pass_max=0.60, tone="default", min_chars=RHYTHM_CHARS),
    _row("A8.ending_top_share", "upper", pass_max=0.52, tone="casual", min_chars=RHYTHM_CHARS),
    _row("A9.bold_per_1k", "upper", pass_max=4.62, min_chars=RHYTHM_CHARS),
    _row("A9.list_ratio", "upper", pass_max=0.305, min_chars=RHYTHM_CHARS),
    _row("A9.label_list_ratio", "upper", pass_max=0.495, min_chars=RHYTHM_CHARS),
    _row("A10.triad_per_1k", "upper", pass_max=2.21, min_chars=RHYTHM_CHARS),
    _row("A12.progressive_per_1k", "upper", pass_max=0.89, min_chars=RHYTHM_CHARS),
    _row("A13.demonstrative_start_per_1k", "upper", pass_max=0.93, min_chars=RHYTHM_CHARS),
    _row("A14.translationese_per_1k", "upper", pass_max=0.46, min_chars=RHYTHM_CHARS),
    *(_row(k, "upper", pass_max=0.0, warn_max=0.0, fixed=True, policy=True) for k in ("A14.doeeojida", "A14.quoted_english_token", "A14.report_write", "A6.window_range")),
    _row("A5.archaic_words", "upper", pass_max=0.0, warn_max=1.0),
    _row("A15.unknown_numbers", "upper", pass_max=0.0, warn_max=0.0, fixed=True),
    _row("A16.source_subject_share", "upper", pass_max=0.06, warn_max=0.10, policy=True),
    _row("T.kkayo_ratio", "upper", pass_max=0.037),
    _row("T.jyo_ratio", "upper", pass_max=0.05, tone="casual", policy=True),
    _row("T.geudeun_ratio", "upper", pass_max=0.05, tone="casual", policy=True),
    _row("T.neundeyo_ratio", "upper", pass_max=0.04, tone="casual", policy=True),
    _row("INFO.closing_wish", "upper", pass_max=1.0, policy=True),
    *(_row(k, "check") for k in ("A18.number_predicate", "A18.bare_reference", "A18.negation_scope", "A21.jeokda_as", "A6.calque_check", "A14.quoted_english_check", "A14.report_write_check", "A14.causative", "A14.adverb_pair", "A5.pleonasm")),
    *(_row(k, "info") for k in ("A18.generic_predicate", "A18.paren_clause", "A18.bundle", "A11.body_questions", "A11.question_heading_ratio", "A9.heading_per_1k", "A9.heading_colon_ratio", "INFO.we", "INFO.adverb_comma")),
)


def registry(spark: SparkSession, rows=REGISTRY) -> DataFrame:
    return spark.createDataFrame(list(rows), SCHEMA)
