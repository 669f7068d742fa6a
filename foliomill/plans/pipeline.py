"""From pages to research units in one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import lines, quality, sections, units


@dataclass(frozen=True)
class Research:
    pages: DataFrame
    quality: DataFrame
    page_sections: DataFrame
    paragraphs: DataFrame
    sentences: DataFrame
    review_queue: DataFrame
    coverage: DataFrame


def research(pages: DataFrame, ranges: DataFrame, report: str = "report_id", page: str = "page", text_col: str = "text") -> Research:
    """Units of the pages inside the ranges (report, start_page, end_page) of a category, and their audit tables.

    pages need quality_decision and text_source; cleaned text never feeds the units, as it only serves to find boundaries.
    """
    r = ranges.select(report, "start_page", "end_page").distinct()
    inside = pages.join(r, report).where(pages[page].between(r["start_page"], r["end_page"])).drop("start_page", "end_page")
    paragraphs = units.paragraphs(inside, report, page, text_col, "quality_decision", "text_source")
    body = paragraphs.where("unit_type <> 'SECTION_HEADING'")
    return Research(
        inside, quality.metrics(inside, text_col), units.page_sections(inside, report, page, text_col), paragraphs,
        units.sentences(body, "paragraph_id", "paragraph_text"), paragraphs.where("review_flag <> ''"), units.coverage(inside, r, report),
    )


def package(ranges: DataFrame, pages: DataFrame, report: str = "report_id", page: str = "page", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sections with text, audit): ranges that the packaging guard keeps, and every range with what was done to it."""
    guarded = sections.packaging_guard(ranges, report)
    kept = guarded.where("action = 'KEEP' and start_page <= end_page").drop("action", "reason")
    return sections.payloads(kept, pages, report, page, page, text_col), guarded


def running_headers(pages: DataFrame, report: str = "report_id", page: str = "page", text_col: str = "text") -> DataFrame:
    return lines.clean_pages(pages, report, page, text_col)
