"""Reports as text: of one document's results, and tables of a few rows.

Results are tables; a report is for reading.  What it takes is bounded: one
document, or a summary of ``MOST_ROWS`` rows, and more is an error, not a cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 10_000
ORDER = ("GATE", "FAIL", "WARN", "OVER", "CHECK", "INFO", "PASS")


def _rows(df: DataFrame) -> list:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report takes {MOST_ROWS} rows; write the table instead")
    return rows


def _cell(x) -> str:
    if x is None:
        return "-"
    return f"{x:.4g}" if isinstance(x, float) else str(x).replace("|", "/").replace("\n", " ")


def markdown_table(df: DataFrame) -> str:
    """A small table as Markdown, rows in the order given."""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(_cell, r)) + " |" for r in _rows(df)])


def document_report(doc_id, results: DataFrame, hits: DataFrame, stats: DataFrame, *, everything: bool = False) -> str:
    """A document's verdict and, for each status that isn't PASS or INFO, its first hits."""
    own = lambda d: d.where(F.col("doc_id").eqNullSafe(F.lit(doc_id)))
    found = {r["metric_id"]: r for r in _rows(own(hits))}
    rows = sorted(_rows(own(results)), key=lambda r: (ORDER.index(r["status"]), r["metric_id"]))
    n = {k: sum(r["status"] == k for r in rows) for k in ORDER}
    head = [f"{doc_id}: {n['GATE']} gate, {n['FAIL']} fail, {n['WARN']} warn, {n['CHECK']} to check"]
    head += [f"{s['chars']:,} characters, {s['sentences']} sentences, {s['paragraphs']} paragraphs, {s['headings']} headings, tone {s['tone']}" for s in _rows(own(stats))]
    for r in rows:
        if r["status"] in ("PASS", "INFO") and not everything:
            continue
        head.append(f"[{r['status']}] {r['metric_id']}: {_cell(r['value'])}")
        h = found.get(r["metric_id"])
        for x in h["hits"] if h else ():
            head.append(f"    line {x['line']} «{x['match']}»: {x['text']}")
        if h and h["more"]:
            head.append("    more: " + ", ".join(f"line {x['line']} «{x['match']}»" for x in h["more"]))
    return "\n".join(head)


def repeat_report(candidates: DataFrame, doc_id) -> str:
    """The shown candidates of a document, and how many more there are."""
    rows = sorted(_rows(candidates.where(F.col("doc_id").eqNullSafe(F.lit(doc_id)))), key=lambda r: r["rank"])
    lines = [f"{doc_id}: {len(rows)} candidates"]
    for r in rows:
        if r["shown"]:
            at = ", ".join(f"L{x}" for x in sorted(set(r["lines"]))[:6])
            lines.append(f"[{r['id']}] {r['key']} x {r['count']} ({at}): {r['text'][:60]}")
    rest = sum(not r["shown"] for r in rows)
    return "\n".join(lines + ([f"and {rest} more"] if rest else []))
