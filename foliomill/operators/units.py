"""Research units: pages with their running section, paragraphs, sentences, review queue and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lines import lines_of

GENERAL = "MDA - General"


def page_sections(pages: DataFrame, report: str, page: str, text_col: str) -> DataFrame:
    """(report, page, section_at_page_start, section_at_page_end, subsection_headings_on_page): labels carried forward through a report."""
    found = lines_of(pages, [report, page], text_col).withColumn("label", T.subsection(F.col("line"))).where("label is not null")
    per = found.groupBy(report, page).agg(F.array_sort(F.collect_list(F.struct("line_no", "label"))).alias("_a"))
    per = per.select(report, page, F.array_join(F.array_distinct(F.transform("_a", lambda x: x["label"])), "|").alias("heads"), F.element_at("_a", -1)["label"].alias("_last"))
    rows = pages.select(report, page).join(per, [report, page], "left")
    before = Window.partitionBy(report).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.last("_last", ignorenulls=True).over(before), F.lit(GENERAL))
    return rows.select(report, page, start.alias("section_at_page_start"), F.coalesce("_last", start).alias("section_at_page_end"), F.coalesce("heads", F.lit("")).alias("subsection_headings_on_page"))


def paragraphs(pages: DataFrame, report: str, page: str, text_col: str, quality: str | None = None, source: str | None = None) -> DataFrame:
    """Content units of each page: headings, bullets, and paragraphs cut at sentence ends after 90 words or before a heading line.

    One fold over the lines of a page inside the JVM; section labels and numbers are then carried over the pages by windows.
    """
    lines = F.transform(F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), T.norm_line), lambda x: x != ""), lambda x: F.struct(
        x.alias("t"), T.subsection(x).alias("label"), T.is_bullet(x).alias("bullet"), T.ends_sentence(x).alias("ends"), T.headingish(x).alias("head"), T.word_count(x).alias("words")))
    unit = "struct<type:string,first:int,last:int,reason:string,text:string,label:string>"
    state = f"struct<n:int,first:int,buf:string,words:int,ends:boolean,out:array<{unit}>>"
    start = F.from_json(F.lit('{"n":0,"first":1,"buf":"","words":0,"ends":false,"out":[]}'), state)

    def made(kind, first, last, reason, body, label):
        return F.struct(kind.alias("type"), first.alias("first"), last.alias("last"), reason.alias("reason"), body.alias("text"), label.alias("label"))

    def flushed(s, reason):
        kind = F.when(T.is_bullet(s["buf"]), "BULLET").otherwise("PARAGRAPH")
        one = F.array(made(kind, s["first"], s["n"], reason, s["buf"], F.lit(None).cast("string")))
        return F.when(s["buf"] == "", s["out"]).otherwise(F.concat(s["out"], one))

    def step(s, x):
        n = s["n"] + 1
        none = F.lit(None).cast("string")
        heading, bullet = x["label"].isNotNull(), x["bullet"]
        long = (s["buf"] != "") & s["ends"] & (s["words"] >= 90)
        before = (s["buf"] != "") & s["ends"] & x["head"]
        cut = heading | bullet | long | before
        reason = F.when(heading, "section_heading").when(bullet, "bullet_boundary").when(long, "long_unit_sentence_boundary").otherwise("sentence_or_structural_boundary")
        out = F.when(cut, flushed(s, reason)).otherwise(s["out"])
        out = F.when(heading, F.concat(out, F.array(made(F.lit("SECTION_HEADING"), n, n, F.lit("section_heading"), x["t"], x["label"])))).when(
            bullet, F.concat(out, F.array(made(F.lit("BULLET"), n, n, F.lit("bullet"), x["t"], none)))).otherwise(out)
        alone, fresh = heading | bullet, cut | (s["buf"] == "")
        return F.struct(
            n.alias("n"), F.when(alone, n + 1).when(fresh, n).otherwise(s["first"]).alias("first"),
            F.when(alone, "").when(fresh, x["t"]).otherwise(F.concat_ws(" ", s["buf"], x["t"])).alias("buf"),
            F.when(alone, 0).when(fresh, x["words"]).otherwise(s["words"] + x["words"]).alias("words"),
            F.when(alone, False).otherwise(x["ends"]).alias("ends"), out.alias("out"),
        )

    extra = {"quality_decision": quality, "text_source": source}
    base = pages.select(F.col(report).alias("report_id"), F.col(page).alias("page"), *[(F.col(v) if v else F.lit(None).cast("string")).alias(k) for k, v in extra.items()], lines.alias("_l"))
    folded = base.withColumn("_u", F.aggregate("_l", start.cast(state), lambda s, x: step(s, x).cast(state), lambda s: flushed(s, F.lit("page_end"))))
    rows = folded.select("report_id", "page", *extra, F.posexplode("_u").alias("_i", "u")).select("report_id", "page", *extra, "_i", "u.*")
    # numbers and labels run through a report: sums and last labels a page first, so the window over a report has one row a page
    per = rows.groupBy("report_id", "page").agg(F.count("*").alias("_n"), F.max_by("label", F.when(F.col("label").isNotNull(), F.col("_i"))).alias("_last"))
    w = Window.partitionBy("report_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("report_id", "page", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"), F.last("_last", ignorenulls=True).over(w).alias("_carried"))
    w2 = Window.partitionBy("report_id", "page").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(per, ["report_id", "page"])
    number = F.col("_before") + F.col("_i") + 1
    text = F.col("text")
    words, digits = T.word_count(text), F.regexp_count(text, F.lit("[0-9]"))
    review = F.coalesce(F.col("quality_decision") == "REVIEW", F.lit(False))
    flags = F.array_join(F.filter(F.array(
        F.when((F.col("type") != "SECTION_HEADING") & (words <= 2), "VERY_SHORT_UNIT"), F.when((F.col("type") != "SECTION_HEADING") & (words >= 250), "VERY_LONG_UNIT"),
        F.when((F.col("type") != "SECTION_HEADING") & (digits > 30), "HIGH_NUMERIC_CONTENT_REVIEW"), F.when(review, "PAGE_QUALITY_REVIEW")), lambda x: x.isNotNull()), "|")
    return rows.select(
        F.format_string("%s_MDA_P%04d_PAR%04d", "report_id", F.col("page").cast("int"), number.cast("int")).alias("paragraph_id"), "report_id", "page",
        F.coalesce(F.last("label", ignorenulls=True).over(w2), "_carried", F.lit(GENERAL)).alias("section"), F.col("type").alias("unit_type"),
        F.col("first").alias("start_line"), F.col("last").alias("end_line"), F.col("reason").alias("boundary_reason"), words.alias("paragraph_word_count"),
        "quality_decision", "text_source", flags.alias("review_flag"), text.alias("paragraph_text"),
    )


def sentences(units: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sentence_id, id_col, sentence_number, sentence_text) by the fixed rules of functions.text.sentences."""
    rows = units.select(id_col, F.posexplode(T.sentences(F.col(text_col))).alias("_p", "sentence_text"))
    return rows.select(F.format_string("%s_S%03d", id_col, F.col("_p") + 1).alias("sentence_id"), id_col, (F.col("_p") + 1).alias("sentence_number"), "sentence_text")


def coverage(pages: DataFrame, sections: DataFrame, report: str = "report_id") -> DataFrame:
    """Per section: expected and actual pages, gaps, pages under review, and PASS or REVIEW (MDA_NOT_FOUND without a range).

    A section without any page is under review too, never a pass.
    """
    s = sections.select(report, "start_page", "end_page")
    p = pages.select(F.col(report).alias("_r"), "page", "quality_decision").distinct()
    on = (s[report] == p["_r"]) & p["page"].between(s["start_page"], s["end_page"])
    ordered = F.array_sort(F.collect_set("page"))
    got = s.join(p, on, "left").groupBy(report, "start_page", "end_page").agg(
        ordered.alias("_p"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("quality_decision") == "REVIEW", F.col("page")))), "|").alias("quality_review_pages"))
    gaps = F.transform(F.sequence(F.lit(1), F.size("_p") - 1), lambda i: F.when(F.element_at("_p", i + 1) != F.element_at("_p", i) + 1, F.concat_ws("->", F.element_at("_p", i), F.element_at("_p", i + 1))))
    gaps = F.when(F.size("_p") > 1, F.array_join(F.filter(gaps, lambda x: x.isNotNull()), "|")).otherwise("")
    expected = F.when(F.col("end_page") >= F.col("start_page"), F.col("end_page") - F.col("start_page") + 1).otherwise(0)
    out = got.withColumns({"expected_page_count": expected, "actual_page_count": F.size("_p"), "continuity_gaps": gaps}).drop("_p")
    bad = (F.col("continuity_gaps") != "") | (F.col("actual_page_count") != F.col("expected_page_count")) | (F.col("quality_review_pages") != "") | (F.col("actual_page_count") == 0)
    return out.withColumn("status", F.when(F.col("start_page").isNull(), "MDA_NOT_FOUND").when(bad, "REVIEW").otherwise("PASS"))
