"""How answers and sources are shown: short names of sources, lists, history with its sources, reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Publishers that are known by their letters.
ACRONYMS = "WHO|RCOG|KDIGO|NICE|CDC|AHA|ACC|ESC|FIGO|ICM|ACOG|ACSM|NHS"


def source_pill(publisher: Column, year: Column, title: Column, index: Column) -> Column:
    """A known acronym or one in parentheses, else a short first word of the publisher, with the year; else the title's start."""
    p = F.coalesce(publisher, F.lit(""))
    letters = F.upper(F.coalesce(F.nullif(F.regexp_extract(p, f"(?i)\\b({ACRONYMS})\\b", 1), F.lit("")), F.nullif(F.regexp_extract(p, "\\(([A-Z]{2,6})\\)", 1), F.lit(""))))
    word = F.get(F.split(p, "[\\s,;(]"), F.lit(0))
    name = F.coalesce(letters, F.when(F.length(word).between(2, 8), word))
    t = F.coalesce(title, F.lit(""))
    cut = F.when(F.length(t) > 12, F.concat(F.substring(t, 1, 12), F.lit("…"))).when(t != "", t).otherwise(index.cast("string"))
    return F.when(name.isNotNull(), F.concat_ws(" ", name, year.cast("string"))).otherwise(cut)


def listed_boxes(text: Column) -> Column:
    """Lines of check boxes as lists."""
    box = "☐"

    def line(x):
        items = F.split(F.trim(x), f"\\s*\\.\\s*{box}\\s*")
        clean = F.transform(items, lambda i: F.trim(F.regexp_replace(F.regexp_replace(i, f"^{box}\\s*", ""), "\\s*\\.$", "")))
        shown = F.array_join(F.transform(F.filter(clean, lambda i: i != ""), lambda i: F.concat(F.lit("- "), i)), "\n")
        return F.when(F.trim(x).startswith(box) | F.contains(F.trim(x), F.lit(f". {box}")), shown).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def with_sources(content: Column, citations: Column) -> Column:
    """An answer with its sources (structs index, title, publisher, year, body) as text, for the next turn of a conversation."""
    one = lambda c: F.concat(
        F.format_string("[%d] ", c["index"]), c["title"], F.when(c["publisher"].isNotNull(), F.concat(F.lit(" — "), c["publisher"])).otherwise(""),
        F.when(c["year"].isNotNull(), F.concat(F.lit(" · "), c["year"].cast("string"))).otherwise(""), F.when(c["body"].isNotNull(), F.concat(F.lit("\n    Content: "), c["body"])).otherwise(""),
    )
    return F.when(F.size(citations) > 0, F.concat(content, F.lit("\n\nReferenced sources:\n"), F.array_join(F.transform(citations, one), "\n"))).otherwise(content)


def markdown(report: dict) -> str:
    """A small report, {section: {metric: value}}, as tables; written by the driver, as its rows are few."""
    lines = [f"# Report {report.get('run_id', '')}".rstrip()]
    for section, metrics in report.items():
        if isinstance(metrics, dict) and metrics:
            lines += ["", f"## {section}", "| Metric | Value |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in sorted(metrics.items())]]
    return "\n".join(lines) + "\n"
