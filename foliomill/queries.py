"""Queries of the document-structure operators over whole tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import semantic
from .functions import text as T
from .operators import anchors, lines, metadata, quality, repair, search, sections, units
from .session import ship
from .sources import sinks


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "mda_paragraph_level").drop("ingested_at").distinct()


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "semantic_heading_manifest").drop("ingested_at").distinct()


def _research(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "research_manifest").drop("ingested_at").distinct()


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their reports, doc_id as the page."""
    return _t(spark, sf_dir, "documents").where("report_id is not null").select("report_id", "doc_id", "text")


def _unit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content units as small pages, whose edges hold the notices that come back within a report."""
    return _units(spark, sf_dir).where("unit_type <> 'SECTION_HEADING'").select("report_id", "paragraph_id", "paragraph_text")


def page_metrics(spark, sf_dir):
    return quality.metrics(_t(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")


def quality_screen(spark, sf_dir):
    u = _units(spark, sf_dir)
    return u.select("paragraph_id", F.array_join(quality.screening_reasons(F.col("paragraph_text"), F.col("text_source")), "|").alias("reasons"))


def quality_choice(spark, sf_dir):
    u = _units(spark, sf_dir).withColumn("other", F.lead("paragraph_text").over(Window.partitionBy("report_id").orderBy("paragraph_id")))
    reasons = quality.screening_reasons(F.col("paragraph_text"), F.col("text_source"))
    return u.select("paragraph_id", quality.choose_text(F.col("paragraph_text"), F.col("other"), reasons).alias("decision"))


def quality_summary(spark, sf_dir):
    q = _t(spark, sf_dir, "page_quality_manifest").select("report_id", "page", "decision").distinct()
    return quality.decisions_by(q, "report_id")


def norm_compact(spark, sf_dir):
    c = F.col("original_heading")
    return _headings(spark, sf_dir).select("heading_id", T.norm_line(c).alias("norm"), T.compact(c).alias("compact"), T.semantic_clean(c).alias("semantic"), T.safe_folder(c).alias("folder"), T.safe_label(c).alias("label"))


def heading_lines(spark, sf_dir):
    return lines.lines_of(_pages(spark, sf_dir), ["report_id", "doc_id"], "text").where(T.heading_like(F.col("line")))


def headingish_lines(spark, sf_dir):
    return lines.lines_of(_pages(spark, sf_dir), ["report_id", "doc_id"], "text").where(T.headingish(F.col("line")))


def bullet_lines(spark, sf_dir):
    return lines.lines_of(_units(spark, sf_dir), ["paragraph_id"], "paragraph_text").where(T.is_bullet(F.col("line")))


def subsection_labels(spark, sf_dir):
    u = _units(spark, sf_dir).where("unit_type = 'SECTION_HEADING'")
    return u.select("paragraph_id", T.subsection(F.col("paragraph_text")).alias("label"))


def edge_lines(spark, sf_dir):
    return lines.edge_lines(_unit_pages(spark, sf_dir), "report_id", "paragraph_id", "paragraph_text")


def clean_text(spark, sf_dir):
    c = lines.clean_pages(_unit_pages(spark, sf_dir), "report_id", "paragraph_id", "paragraph_text")
    return c.select("report_id", "paragraph_id", "lines_dropped", F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))


def line_windows(spark, sf_dir):
    return lines.line_windows(lines.lines_of(_pages(spark, sf_dir), ["doc_id"], "text"), ["doc_id"], 5)


def line_context(spark, sf_dir):
    return lines.line_context(lines.lines_of(_pages(spark, sf_dir), ["doc_id"], "text"), ["doc_id"])


def multiset_minus(spark, sf_dir):
    l = lines.lines_of(_units(spark, sf_dir), ["report_id", "paragraph_id"], "paragraph_text")
    number = F.row_number().over(Window.partitionBy("report_id").orderBy("paragraph_id", "line_no"))
    l = l.select("report_id", "paragraph_id", F.col("line_no").alias("n"), "line").withColumn("line_no", F.row_number().over(Window.partitionBy("report_id").orderBy("paragraph_id", "n")))
    heads = l.where("line_no % 2 = 0")
    return lines.multiset_minus(l, heads, ["report_id"]).select("report_id", "paragraph_id", "n", "line")


def _layout_lines(spark, sf_dir) -> DataFrame:
    """Lines of the content units in page order, at regular places of a page, headings larger: geometry as a plain page would have it."""
    u = _units(spark, sf_dir).where("report_id is not null and page is not null and paragraph_text is not null")
    rows = u.select("report_id", "page", "paragraph_id", "unit_type", F.coalesce("start_line", F.lit(0)).alias("s"), F.posexplode(F.split("paragraph_text", "\n")).alias("k", "text")).where(T.norm_line(F.col("text")) != "")
    i = F.row_number().over(Window.partitionBy("report_id", "page").orderBy("s", "paragraph_id", "k")) - 1
    head = F.coalesce(F.col("unit_type") == "SECTION_HEADING", F.lit(False))
    rows = rows.select("report_id", "page", i.alias("line_order"), "text", head.alias("head"))
    return rows.select(
        "report_id", "page", "line_order", "text", F.lit(50.0).alias("x0"), (50.0 + 18 * F.col("line_order")).alias("y0"), F.lit(500.0).alias("x1"), (65.0 + 18 * F.col("line_order")).alias("y1"),
        F.when(F.col("head"), 14.0).otherwise(12.0).alias("size"), F.lit("Helvetica").alias("font"), F.lit(False).alias("bold"), F.when(F.col("head"), "section-header").otherwise("text").alias("layout_class"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"),
    )


def _headings_of(spark, sf_dir) -> list[tuple[str, list[str]]]:
    """The accepted names of each category; the list is small and fixed, and `anchors` refuses a longer one."""
    by: dict[str, list[str]] = {}
    for r in _t(spark, sf_dir, "heading_alias_ref").where("category_code is not null").orderBy("alias_id").limit(anchors.MOST + 1).collect():
        by.setdefault(r["category_code"], []).append(r["alias_text"])
    return sorted(by.items())


def alias_hits(spark, sf_dir):
    found = anchors.window_candidates(_layout_lines(spark, sf_dir), _headings_of(spark, sf_dir))
    return found.select("report_id", "page", "label", "alias", "line_order", "line_end", "matched_text", "score")


def folio_extract(spark, sf_dir):
    return anchors.edge_folios(_layout_lines(spark, sf_dir)).select("report_id", "page", "line_order", "number")


def toc_nearest(spark, sf_dir):
    l = anchors.real_lines(_layout_lines(spark, sf_dir))
    return anchors.numbers_near(l.where(T.heading_like(F.col("t"))), l).where("number is not null").select("report_id", "page", "line_order", F.col("t").alias("title"), "number")


def contents_pages(spark, sf_dir):
    return anchors.contents_pages(_layout_lines(spark, sf_dir))


def section_anchors(spark, sf_dir):
    return anchors.section_anchors(_layout_lines(spark, sf_dir), _headings_of(spark, sf_dir)).select("report_id", "label", "page", "line_order", "matched_text", "score", "printed_page", "contents_page")


def annexure_anchors(spark, sf_dir):
    return anchors.annexure_anchors(_layout_lines(spark, sf_dir)).select("report_id", "page", "line_order", "annexure", "matched_text", "label")


#: Names of categories in the tables that stand for longer ones.
LONG_NAMES = {"Business Responsibility & Sustainability Report": "Business Responsibility & Sustainability Report (BRSR)", "Business Responsibility Report": "Business Responsibility Report (BRR)"}


def _named(c):
    full = F.create_map(*[F.lit(x) for p in LONG_NAMES.items() for x in p])
    return F.coalesce(full[c], c)


def _repaired(spark, sf_dir):
    r = _research(spark, sf_dir).where("report_id is not null and canonical_category is not null")
    # one section a report and category, the one that begins first
    first = F.min(F.struct(F.coalesce("start_page", F.lit(1 << 30)).alias("s"), "start_page", "end_page", "match_type", "original_heading"))
    one = r.groupBy("report_id", _named(F.col("canonical_category")).alias("label")).agg(first.alias("b")).select("report_id", "label", "b.start_page", "b.end_page", "b.match_type", "b.original_heading")
    return repair.repair(one, _layout_lines(spark, sf_dir))


def repair_sections(spark, sf_dir):
    return _repaired(spark, sf_dir)[0]


def repair_audit(spark, sf_dir):
    return _repaired(spark, sf_dir)[1]


def semantic_classify(spark, sf_dir):
    return _headings(spark, sf_dir).select("heading_id", semantic.classify(F.col("original_heading")).alias("c")).select("heading_id", "c.*")


def semantic_best(spark, sf_dir):
    h = _headings(spark, sf_dir).where("canonical_category is not null and report_id is not null")
    rank = F.when(F.col("confidence") == "HIGH", 3).when(F.col("confidence") == "MEDIUM", 2).when(F.col("confidence") == "LOW", 1).otherwise(0)
    best = sections.best_per(h.select("report_id", "canonical_category", "heading_id", "score", "confidence", "hard_boundary"), ["report_id", "canonical_category"], [rank, F.coalesce(F.col("hard_boundary").cast("int"), F.lit(0)), F.coalesce("score", F.lit(-1)), -F.col("heading_id")])
    return best.select("report_id", "canonical_category", "heading_id", "confidence", "score")


def fiscal_year(spark, sf_dir):
    return metadata.fiscal_year(_pages(spark, sf_dir), "report_id", "doc_id", "text")


def company_score(spark, sf_dir):
    return metadata.company(_units(spark, sf_dir).where("report_id is not null and page is not null"), "report_id", "page", "paragraph_text", "paragraph_id")


def report_metadata(spark, sf_dir):
    return metadata.metadata(_units(spark, sf_dir).where("report_id is not null and page is not null"), "report_id", "page", "paragraph_text", "paragraph_id")


def text_quality(spark, sf_dir):
    u = _units(spark, sf_dir)
    return u.select("paragraph_id", *[c.alias(k) for k, c in T.quality_parts(F.col("paragraph_text")).items()], T.text_quality(F.col("paragraph_text")).alias("quality"))


def nearest_page(spark, sf_dir):
    h = _headings(spark, sf_dir).where("pdf_page is not null").select("report_id", "heading_id", "pdf_page").distinct()
    return sections.nearest(h, _research(spark, sf_dir).where("start_page is not null").select("report_id", "start_page"), "report_id", "pdf_page", "start_page", 18)


def next_boundary(spark, sf_dir):
    h = _headings(spark, sf_dir).where("report_id is not null and pdf_page is not null").select("report_id", "heading_id", "pdf_page", "hard_boundary", "generic").distinct()
    ok = F.coalesce(F.col("hard_boundary"), F.lit(False)) | ~F.coalesce(F.col("generic"), F.lit(True))
    return sections.next_boundary(h, "report_id", ["pdf_page", "heading_id"], ok, ["heading_id", "pdf_page"])


def packaging_guard(spark, sf_dir):
    r = _research(spark, sf_dir).select("report_id", "section", _named(F.col("canonical_category")).alias("canonical_category"), "start_page", "end_page").distinct()
    return sections.packaging_guard(r)


def payload_ranges(spark, sf_dir):
    r = _research(spark, sf_dir).where("report_id is not null and start_page <= end_page").select("report_id", "section", "start_page", "end_page").distinct()
    p = sections.payloads(r, _units(spark, sf_dir).where("paragraph_text is not null"), "report_id", "page", "paragraph_id", "paragraph_text")
    return p.withColumn("section_sha256", F.sha2(F.col("section_text").cast("binary"), 256)).drop("section_text")


def subsection_ffill(spark, sf_dir):
    return units.page_sections(_pages(spark, sf_dir), "report_id", "doc_id", "text")


def paragraphs(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").where("report_id is not null").withColumn("page", F.row_number().over(Window.partitionBy("report_id").orderBy("doc_id")))
    return units.paragraphs(d, "report_id", "page", "text")


def sentences(spark, sf_dir):
    return units.sentences(_units(spark, sf_dir).where("unit_type <> 'SECTION_HEADING'"), "paragraph_id", "paragraph_text")


def review_queue(spark, sf_dir):
    return _units(spark, sf_dir).where("review_flag <> ''").select("paragraph_id", "review_flag", "page")


def coverage_audit(spark, sf_dir):
    r = _research(spark, sf_dir).where("report_id is not null").select("report_id", "start_page", "end_page").distinct()
    q = _t(spark, sf_dir, "page_quality_manifest").select("report_id", "page", F.col("decision").alias("quality_decision")).distinct()
    return units.coverage(q, r)


def search_snippets(spark, sf_dir):
    return search.snippets(_t(spark, sf_dir, "documents"), ["doc_id"], "text", "per cent", 50)


def manifest_union(spark, sf_dir):
    r = _research(spark, sf_dir)
    full = r.groupBy("report_id", "company", "year", "source_file").agg(F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page")).withColumn("section", F.lit("Full Report"))
    return sinks.manifest(r.unionByName(full, allowMissingColumns=True))


def quality_join(spark, sf_dir):
    q = _t(spark, sf_dir, "page_quality_manifest").select("report_id", "page", "decision", F.col("text_source").alias("page_source")).distinct()
    return _units(spark, sf_dir).select("paragraph_id", "report_id", "page", "quality_decision").join(q, ["report_id", "page"], "left")


def combined_sections(spark, sf_dir):
    r = _research(spark, sf_dir).where("canonical_category in ('Chairman Message', 'CEO Message', 'Managing Director Message')")
    return sections.combine(r.select("report_id", "canonical_category", "start_page", "end_page"), ["report_id"], "canonical_category", "Leadership Messages")


def node_merge(spark, sf_dir):
    h = _headings(spark, sf_dir).where("report_id is not null and pdf_page is not null").select("report_id", "pdf_page", F.col("heading_id").alias("line_no"), "original_heading", "score", "generic")
    return sections.merge_nodes(h, "report_id", "pdf_page", "line_no", "original_heading", "score", "generic")


def page_gaps(spark, sf_dir):
    p = _t(spark, sf_dir, "page_quality_manifest").where("report_id is not null").select("report_id", "page").distinct()
    w = Window.partitionBy("report_id").orderBy("page")
    return p.withColumn("next_page", F.lead("page").over(w)).where("next_page > page + 1")


def annexure_ids(spark, sf_dir):
    return _headings(spark, sf_dir).select("heading_id", T.annexure_id(F.col("original_heading")).alias("annexure")).where("annexure is not null")


def markdown_plain(spark, sf_dir):
    return _units(spark, sf_dir).select("paragraph_id", F.sha2(T.markdown_plain(F.col("paragraph_text")).cast("binary"), 256).alias("plain_sha256"))


_ALL = (
    page_metrics, quality_screen, quality_choice, quality_summary, norm_compact, heading_lines, headingish_lines, bullet_lines, subsection_labels, edge_lines, clean_text, line_windows, line_context, multiset_minus,
    alias_hits, folio_extract, toc_nearest, contents_pages, section_anchors, annexure_anchors, repair_sections, repair_audit, semantic_classify, semantic_best, fiscal_year, company_score, report_metadata, text_quality, nearest_page, next_boundary, packaging_guard, payload_ranges, subsection_ffill, paragraphs, sentences, review_queue,
    coverage_audit, search_snippets, manifest_union, quality_join, combined_sections, node_merge, page_gaps, annexure_ids, markdown_plain,
)


def _shipped(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    run.__name__ = f.__name__
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: _shipped(f) for f in _ALL}
