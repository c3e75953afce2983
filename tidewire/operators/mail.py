"""An issue as plain text and as HTML: one ordered aggregation of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import rules
from tidewire.operators.score import priority_level


def _level_label(language: int) -> Column:
    pairs = F.create_map(*[F.lit(x) for p in rules.PRIORITY_LEVELS for x in (p[0], p[3 + language])])
    return F.element_at(pairs, priority_level())


def story_text(language: int = 1) -> Column:
    """A story's lines. Columns of ``with_display`` and ``with_scores``."""
    say = lambda ko, en: F.lit((ko, en)[language])
    s = ("ko", "en")[language]
    reason = F.col("evidence_explanation_en" if language else "evidence_explanation")
    lines = [
        F.concat(F.lit("["), _level_label(language), F.lit("] "), F.col(f"display_title_{s}")),
        F.concat(say("  출처: ", "  Source: "), "publisher_display", say(" | 점수: ", " | Score: "), F.bround("priority_score", 0).cast("int").cast("string"), F.lit(" ("), reason, F.lit(")")),
        F.concat(say("  요약: ", "  Summary: "), F.col(f"display_summary_{s}")),
        F.concat(say("  시사점: ", "  Why it matters: "), F.col(f"display_why_{s}")),
        F.concat(say("  원문: ", "  Link: "), "display_url"),
    ]
    return F.concat_ws("\n", *lines)


def issue_text(shown: DataFrame, day: str, language: int = 1) -> DataFrame:
    """One row: the plain-text edition of the shown stories (section, section_pos, place and the story's columns)."""
    level = priority_level()
    body = shown.select("section", "section_pos", "place", story_text(language).alias("x"), level.alias("level"))
    parts = body.groupBy("section", "section_pos").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("xs"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("level") == "critical").alias("c"), F.count_if(F.col("level") == "high").alias("h"))
    told = parts.select("section_pos", "n", "c", "h", F.concat(F.lit("=== "), "section", F.lit(" ===\n"), F.array_join(F.transform("xs", lambda x: x["x"]), "\n\n")).alias("text"))
    whole = told.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_pos", "text"))), lambda x: x["text"]), "\n\n").alias("text"), F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("h").alias("h"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    head = F.concat(F.lit(f"Intelligence briefing - {day}\n"), F.lit("Total: "), n("n"), F.lit(" / Critical: "), n("c"), F.lit(" / High: "), n("h"), F.lit("\n\n"))
    return whole.select(F.concat(head, F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("n", F.lit(0)).alias("total"), F.coalesce("c", F.lit(0)).alias("critical"), F.coalesce("h", F.lit(0)).alias("high"))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def story_html(language: int = 1) -> Column:
    s = ("ko", "en")[language]
    e = lambda c: html_escape(F.col(c))
    return F.concat(F.lit("<article><h3><a href=\""), e("display_url"), F.lit("\">"), e(f"display_title_{s}"), F.lit("</a></h3><p>"), e(f"display_summary_{s}"), F.lit("</p><p>"), e("publisher_display"), F.lit(" · "), _level_label(language), F.lit("</p></article>"))
