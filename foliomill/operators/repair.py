"""Repair of section ranges by what stands on the pages: leadership messages, statutory annexures, peer headings and long reports that run on.

Sections are (report_id, label, start_page, end_page, match_type, original_heading), lines as in `anchors`; pages are physical and count from 1. Each rule picks candidate lines by
their own features, meets the few sections of a report by a range of pages, and keeps the first. Manual sections (match_type MANUAL_OVERRIDE) never change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut
from .anchors import KEY, real_lines
from .sections import valid_range

SECTIONS = "report_id string, label string, start_page int, end_page int, match_type string, original_heading string"
AUDIT = ["report_id", "section", "start_page", "end_page", "action", "reason"]
CSR = "Corporate Social Responsibility"
#: Titles of leadership messages and the roles that sign them.
LEADERSHIP = {
    "Chairman Message": r"(?i)^(?:message|letter|statement|review|address)\s+from\s+(?:the\s+)?(?:executive\s+)?chair(?:man|person)|^(?:executive\s+)?chair(?:man|person)(?:'s|s)?\s+(?:message|letter|statement|review|address)$",
    "CEO Message": r"(?i)^(?:message|letter|statement|review|address)\s+from\s+(?:the\s+)?(?:chief\s+executive(?:\s+officer)?|ceo)|^(?:chief\s+executive(?:\s+officer)?|ceo)(?:'s|s)?\s+(?:message|letter|statement|review|address)$",
    "Managing Director Message": r"(?i)^(?:message|letter|statement|review|address)\s+from\s+(?:the\s+)?(?:managing\s+director|md)|^(?:managing\s+director|md)(?:'s|s)?\s+(?:message|letter|statement|review|address)$",
}
ROLES = {
    "Chairman Message": r"(?i)\b(?:executive\s+)?chair(?:man|person)\b",
    "CEO Message": r"(?i)\b(?:chief\s+executive\s+officer|ceo)\b",
    "Managing Director Message": r"(?i)\b(?:managing\s+director|whole[-\s]?time\s+director|\bmd\b)\b",
}
#: Sections that may run on, the titles that begin them, and titles of other reports that end them, in order.
LONG_FORM = {
    CSR: r"(?i)^corporate\s+social\s+responsibility$|^annual\s+report\s+on\s+(?:csr|corporate\s+social\s+responsibility)\s+activities?\d*$",
    "Business Responsibility Report (BRR)": r"(?i)^business\s+responsibility\s+report(?:\s*\(.*?\))?$",
    "Business Responsibility & Sustainability Report (BRSR)": r"(?i)^business\s+responsibility\s+(?:and|&)\s+sustainability\s+report(?:\s*\(.*?\))?$",
    "ESG Report": r"(?i)^(?:environmental,?\s*social\s*(?:and|&)\s*governance|esg)(?:\s+report)?$",
    "Sustainability Report": r"(?i)^sustainability\s+report$",
}
PAGE_PREFIX = (
    ("Independent Auditor's Report", r"(?i)^(?:\d+\s+)?independent\s+auditor(?:s|[’']s)?[’']?\s+report(?:\s+to\b.*)?$"),
    ("Auditor's Report", r"(?i)^(?:\d+\s+)?auditor(?:s|[’']s)?[’']?\s+report(?:\s+to\b.*)?$"),
    ("Financial Statements", r"(?i)^(?:\d+\s+)?(?:standalone\s+|consolidated\s+)?financial\s+statements?$"),
)
TOP_LEVEL = (
    ("Independent Auditor's Report", r"(?i)^independent\s+auditor(?:s|[’']s)?[’']?\s+report$"),
    ("Auditor's Report", r"(?i)^auditor(?:s|[’']s)?[’']?\s+report$"),
    ("Financial Statements", r"(?i)^(?:standalone\s+|consolidated\s+)?financial\s+statements?$"),
    ("Board of Directors", r"(?i)^board\s+of\s+directors$"),
    ("Board's Report", r"(?i)^board(?:'s|s')\s+report$"),
    ("Directors' Report", r"(?i)^directors?'?\s+report$"),
    ("Corporate Governance Report", r"(?i)^corporate\s+governance(?:\s+report)?$"),
    ("Management Discussion & Analysis", r"(?i)^management(?:'s)?\s+(?:discussion|review)\s*(?:and|&)\s*analysis(?:\s+report)?$"),
    ("Business Responsibility Report", r"(?i)^business\s+responsibility(?:\s+and\s+sustainability)?\s+report(?:\s*\(.*?\))?$"),
    ("ESG Report", r"(?i)^(?:environmental,\s*social\s*(?:and|&)\s*governance|esg)(?:\s+report)?$"),
    ("Sustainability Report", r"(?i)^sustainability\s+report$"),
    ("Awards and Recognitions", r"(?i)^awards?\s*(?:and|&)\s*recognitions?$"),
    ("Notice", r"(?i)^notice$"),
)
CSR_PEERS = (
    ("Corporate Governance", r"(?i)^corporate\s+governance(?:\s+report)?$"),
    ("Board of Directors", r"(?i)^board\s+of\s+directors$"),
    ("Management Team", r"(?i)^(?:management|leadership)\s+team$"),
)
CSR_TITLE = r"(?i)\b(?:annual\s+report\s+on\s+(?:csr|corporate\s+social\s+responsibility)\s+activities?\s*\d*|report\s+on\s+(?:csr|corporate\s+social\s+responsibility)(?:\s*\(csr\))?\s+activities?\s*\d*|report\s+on\s+csr\s+activities?\s*\d*)\b"


def facts(lines: DataFrame) -> DataFrame:
    """Lines with what the rules ask of them: plain text, letters, place on the page, whether the layout calls them a heading, and the style that a second line of the same text has."""
    real = real_lines(lines).withColumns({"p": T.plain(F.col("text")), "c": T.compact(F.col("t")), "layout": F.lower(F.coalesce("layout_class", F.lit("")))})
    heading = F.contains("layout", F.lit("heading")) | F.contains("layout", F.lit("section"))
    real = real.withColumns({"head": heading, "frac": F.col("y0") / F.col("height"), "annexure": T.annexure_id(F.col("t"))})
    style = real.where("size is not null and size > 0").groupBy(*KEY, "c").agg(F.max_by(F.struct("size", "font", "bold"), F.struct("size", -F.col("line_order"))).alias("_s"))
    real = real.join(style, [*KEY, "c"], "left")
    own = F.coalesce(F.col("size") > 0, F.lit(False))
    real = real.withColumns({k: F.when(own, F.col(k)).otherwise(F.coalesce(F.col(f"_s.{k}"), F.col(k))) for k in ("size", "font", "bold")}).drop("_s")
    first = real.where(F.col("head") & (F.length("t") <= 220)).groupBy(*KEY).agg(F.min_by(F.struct("line_order", "c"), F.struct(F.coalesce("y0", F.lit(1e9)), "line_order")).alias("_first"))
    return real.join(first, KEY, "left")


def top_evidence() -> Column:
    """The layout calls it a heading, or it reads as one near the top of its page."""
    return F.col("head") | T.heading_like(F.col("t")) & ((F.col("line_order") <= 8) | F.coalesce(F.col("y0") <= 0.28 * F.col("height"), F.lit(False)))


def strong_title() -> Column:
    first = F.col("_first").isNull() | (F.col("_first.line_order") == F.col("line_order")) | (F.col("_first.c") == F.col("c"))
    return top_evidence() & F.coalesce(F.col("frac") <= 0.30, F.lit(True)) & first


def labelled(lines: DataFrame, patterns: tuple, on: str = "p") -> DataFrame:
    """Lines with `labels`, those of the patterns that they match, in order; others are left out."""
    made = F.filter(F.array(*[F.when(F.col(on).rlike(p), F.lit(label)) for label, p in patterns]), lambda x: x.isNotNull())
    return lines.withColumn("labels", made).where(F.size("labels") > 0)


def first_after(sections: DataFrame, lines: DataFrame, most: int | None = None, also: Column | None = None) -> DataFrame:
    """(report_id, label, b): of the lines on the pages after a section's start, up to its end or `most` pages on, the first; b holds its page, line_order and title.

    `lines` has report_id, page, line_order and title; a column `also` of both may exclude pairs.
    """
    s = sections.select("report_id", "label", F.col("start_page").alias("_s"), F.col("end_page").alias("_e"), *[c for c in sections.columns if c.startswith("_a_")])
    upto = F.col("_e") if most is None else F.col("_s") + most
    met = s.join(lines, "report_id").where((F.col("page") > F.col("_s")) & (F.col("page") <= upto))
    met = met if also is None else met.where(also)
    return met.groupBy("report_id", "label").agg(F.min(F.struct("page", "line_order", "title")).alias("b"))


def start_anchors(sections: DataFrame, lines: DataFrame) -> DataFrame:
    """(report_id, label, a): the line on a section's first page that begins it: by its original heading, or else its label; headings of the layout first,
    then those nearest in length, then the first. a holds page, line_order, y0, size, font, bold and c."""
    names = F.array(F.struct(F.lit(1).alias("rank"), F.coalesce("original_heading", F.col("label")).alias("name")), F.struct(F.lit(0).alias("rank"), F.col("label").alias("name")))
    s = sections.select("report_id", "label", F.col("start_page").alias("page"), F.explode(names).alias("x")).select("report_id", "label", "page", F.col("x.rank").alias("_rank"), T.compact(F.col("x.name")).alias("_target")).where("_target <> ''")
    met = s.join(lines.where("c <> ''"), KEY).where(F.contains("c", F.col("_target")) | F.contains("_target", F.col("c")))
    rank = F.struct("_rank", F.col("head").cast("int"), -F.abs(F.length("c") - F.length("_target")), -F.col("line_order"))
    return met.groupBy("report_id", "label").agg(F.max_by(F.struct("page", "line_order", "y0", "size", "font", "bold", "c"), rank).alias("a"))


def ended_by(start: Column, order: Column, boundary: Column) -> Column:
    """Last page of a section that begins at (start, order) and ends before a boundary; null if that leaves no page."""
    same = (boundary["page"] == start) & (boundary["line_order"] > order)
    return F.when(same, start).when(boundary["page"] > start, boundary["page"] - 1)


def same_style(band: bool = True) -> Column:
    """Whether a line has the typography and the height of the anchor in the _a_ columns, and another text."""
    same = (F.abs(F.col("y0") - F.col("_a_y0")) <= 24) & (F.col("size") > 0) & (F.abs(F.col("size") - F.col("_a_size")) <= 0.35)
    font = F.lower(F.trim(F.coalesce("font", F.lit("")))), F.lower(F.trim(F.coalesce("_a_font", F.lit(""))))
    return F.coalesce(
        same & ((font[0] == "") | (font[1] == "") | (font[0] == font[1])) & (F.coalesce("bold", F.lit(False)) == F.coalesce("_a_bold", F.lit(False))) & (F.col("c") != F.col("_a_c")), F.lit(False))


def _anchored(sections: DataFrame, anchors: DataFrame) -> DataFrame:
    """Sections with the fields of their anchor as _a_ columns."""
    fields = ("page", "line_order", "y0", "size", "font", "bold", "c")
    return sections.join(anchors, ["report_id", "label"], "left").select(*sections.columns, *[F.col(f"a.{k}").alias(f"_a_{k}") for k in fields])


def _chapter() -> Column:
    """A line that may be the title of a chapter: two to ten words, no folio."""
    return (F.col("layout") != "folio-edge") & T.heading_like(F.col("t")) & F.regexp_count("t", F.lit("[A-Za-z]+")).between(2, 10) & (F.length("t") <= 120)


def manual() -> Column:
    return F.upper(F.coalesce("match_type", F.lit(""))) == "MANUAL_OVERRIDE"


def _applied(sections: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections with changed ranges, audit rows) for changes (report_id, label, new_start, new_end, action, reason)."""
    changes = cut(changes)
    new = sections.join(changes, ["report_id", "label"], "left")
    new = new.withColumns({"start_page": F.coalesce("new_start", "start_page"), "end_page": F.coalesce("new_end", "end_page")}).select(*sections.columns)
    return new, changes.select("report_id", F.col("label").alias("section"), F.col("new_start").alias("start_page"), F.col("new_end").alias("end_page"), "action", "reason")


def repair_leadership(sections: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leadership messages that are missing are found by their exact titles, and each ends before the first of the next message, a page title of its style, or the page after a late signature."""
    f = lines
    there = sections.where(F.col("label").isin(*LEADERSHIP))
    placed = start_anchors(there.where(valid_range()), f)
    strong = F.col("head") | F.coalesce(F.col("frac") <= 0.25, F.lit(False)) & (F.coalesce("bold", F.lit(False)) | F.coalesce(F.col("size") >= 9.0, F.lit(False)))
    titles = labelled(f.where(F.length("p").between(1, 150)), tuple(LEADERSHIP.items())).where(strong).withColumn("label", F.explode("labels"))
    found = titles.groupBy("report_id", "label").agg(F.min_by(F.struct("page", "line_order", "y0", "size", "font", "bold", "c", "t"), F.struct("page", "line_order")).alias("x"))
    missing = cut(found.join(there.select("report_id", "label").where("label is not null"), ["report_id", "label"], "left_anti"))
    made = missing.select("report_id", "label", F.col("x.page").alias("start_page"), F.col("x.page").alias("end_page"), F.lit("LEADERSHIP_VARIANT").alias("match_type"), F.col("x.t").alias("original_heading"))
    recovered = made.select("report_id", F.col("label").alias("section"), "start_page", "end_page", F.lit("RECOVERED_LEADERSHIP_VARIANT").alias("action"), F.col("original_heading").alias("reason"))
    sections = sections.unionByName(made.select(*sections.columns) if set(sections.columns) <= set(made.columns) else made, allowMissingColumns=True)
    anchors = placed.unionByName(missing.select("report_id", "label", F.struct(*[F.col(f"x.{k}").alias(k) for k in ("page", "line_order", "y0", "size", "font", "bold", "c")]).alias("a")))
    own = cut(_anchored(sections.where(F.col("label").isin(*LEADERSHIP) & ~manual()), anchors).where("_a_page is not null").withColumn("start_page", F.col("_a_page")))
    small = ["report_id", "page", "line_order", "title"]
    others = own.select("report_id", F.col("_a_page").alias("page"), F.col("_a_line_order").alias("line_order"), F.col("label").alias("title"))
    following = first_after(own, others, 100_000)
    # folio lines count as titles of a page if they are large
    large = F.coalesce((F.col("size") >= 14) & (F.col("_a_size") >= 14), F.lit(False)) & F.regexp_count("t", F.lit("[A-Za-z]+")).between(1, 10)
    band = F.coalesce(F.col("frac") <= 0.30, F.lit(True))
    peers = first_after(own, f.where(F.length("t") <= 140).withColumn("title", F.col("t")), 12, same_style() & (_chapter() | large) & band)
    signed = labelled(f, tuple(ROLES.items()), "t").where(F.when(F.col("y0").isNotNull() & (F.col("height") > 0), F.col("y0") >= 0.52 * F.col("height")).otherwise(F.col("line_order") >= 8))
    signed = signed.withColumn("title", F.lit("Leadership signature end"))
    last = own.select("report_id", "label", F.col("_a_page").alias("_s")).join(signed.select(*small, "labels"), "report_id").where((F.col("page") > F.col("_s")) & (F.col("page") <= F.col("_s") + 8) & F.array_contains("labels", F.col("label")))
    pages = f.groupBy("report_id").agg(F.max("page").alias("_most"))
    last = last.groupBy("report_id", "label").agg(F.max("page").alias("_p")).join(pages, "report_id").where("_p < _most")
    last = last.select("report_id", "label", F.struct((F.col("_p") + 1).alias("page"), F.lit(0).alias("line_order"), F.lit("Leadership signature end").alias("title")).alias("b"))
    bounds = following.unionByName(peers).unionByName(last).groupBy("report_id", "label").agg(F.min("b").alias("b"))
    end = ended_by(F.col("_a_page"), F.col("_a_line_order"), F.col("b"))
    changed = own.drop("start_page").join(sections.select("report_id", "label", "start_page"), ["report_id", "label"]).join(bounds, ["report_id", "label"]).withColumn("new_end", end)
    changed = changed.where("new_end >= _a_page and not (new_end <=> end_page and _a_page <=> start_page)")
    changes = changed.select("report_id", "label", F.col("_a_page").alias("new_start"), "new_end", F.lit("REPAIRED_LEADERSHIP_BOUNDARY").alias("action"), F.concat(F.lit("NEXT_PEER_"), F.col("b.title")).alias("reason"))
    sections, audit = _applied(sections, changes)
    return sections, recovered.unionByName(audit)


def statutory_annexures(lines: DataFrame) -> DataFrame:
    """(report_id, page, line_order, y0, own): lines that title a statutory report on social responsibility, alone or with one or two lines after them, beside an annexure line of their page, whose identifier is `own`."""
    from pyspark.sql import Window

    w = Window.partitionBy(*KEY).orderBy("line_order")
    two = [F.concat_ws(" ", "t", *[F.lead("t", i).over(w) for i in range(1, k + 1)]) for k in (1, 2)]
    rows = lines.withColumns({"_t1": T.plain(two[0]), "_t2": T.plain(two[1])})
    hit = F.col("p").rlike(CSR_TITLE) | (F.length("_t1") <= 360) & F.col("_t1").rlike(CSR_TITLE) | (F.length("_t2") <= 360) & F.col("_t2").rlike(CSR_TITLE)
    # a line whose continuation alone is the title isn't where it begins
    rows = rows.where((F.length("t") <= 240) & hit).select(*KEY, "line_order", "i", "y0")
    wrap = lines.where(F.col("annexure").isNotNull() & (F.length("t") <= 180)).select(*KEY, F.col("line_order").alias("_o"), F.col("y0").alias("_y"), F.col("annexure").alias("own"))
    near = F.when(F.col("y0").isNotNull() & F.col("_y").isNotNull(), (F.col("_y") <= F.col("y0") + 18) & (F.col("y0") - F.col("_y") <= 110)).otherwise(F.col("_o") <= F.col("i") + 8)
    met = rows.join(wrap, KEY).where(near & (F.col("_o") != F.col("line_order")))
    return met.groupBy(*KEY, "line_order", "y0").agg(F.min_by("own", F.struct(F.abs(F.coalesce(F.col("y0") - F.col("_y"), F.lit(0.0))), "_o")).alias("own"))


def repair_csr(sections: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A CSR section inside a board or directors' report that only refers to the annexure becomes the annexure, up to the next one; one that runs over a peer heading, by style or by name, ends before it."""
    csr = sections.where((F.col("label") == CSR) & ~manual() & valid_range())
    parents = sections.where(F.col("label").isin("Board's Report", "Directors' Report") & valid_range()).select("report_id", F.col("label").alias("_parent"), F.col("start_page").alias("_ps"), F.col("end_page").alias("_pe"))
    inside = csr.join(parents, "report_id").where(F.col("start_page").between(F.col("_ps"), F.col("_pe")))
    inside = inside.groupBy("report_id", "label").agg(F.min_by(F.struct("_parent", "_ps", "_pe", F.col("start_page").alias("s"), F.col("end_page").alias("e")), F.struct(F.col("_pe") - F.col("_ps"), "_parent")).alias("x")).select("report_id", "label", "x.*")
    starts = inside.join(statutory_annexures(lines), "report_id").where(F.col("page").between(F.col("s"), F.col("_pe")))
    starts = starts.groupBy("report_id", "label", "_parent", "_ps", "_pe", "s", "e").agg(F.min(F.struct("page", "line_order", "y0", "own")).alias("a"))
    nexts = lines.where(F.col("annexure").isNotNull() & (F.length("t") <= 220)).select("report_id", "page", "line_order", "y0", F.col("annexure").alias("_id"))
    below = F.when(F.col("y0").isNotNull() & F.col("a.y0").isNotNull(), F.col("y0") > F.col("a.y0") + 8).otherwise(F.col("line_order") > F.col("a.line_order"))
    met = starts.join(nexts, "report_id").where((F.col("page") <= F.col("_pe")) & ((F.col("page") > F.col("a.page")) | (F.col("page") == F.col("a.page")) & (F.col("_id") != F.col("a.own")) & below))
    bound = met.groupBy("report_id", "label", "_parent", "_ps", "_pe", "s", "e", "a").agg(F.min(F.struct("page", "line_order")).alias("b"))
    bound = bound.withColumn("new_end", ended_by(F.col("a.page"), F.col("a.line_order"), F.col("b"))).where("a.page >= _ps and new_end between a.page and _pe and not (a.page = s and new_end = e)")
    statutory = cut(bound).select("report_id", "label", F.col("a.page").alias("new_start"), "new_end", F.lit("RECOVERED_STATUTORY_ANNEXURE").alias("action"), F.concat(F.lit("CSR_ANNEXURE_INSIDE_"), F.col("_parent")).alias("reason"))
    rest = csr.join(statutory.select("report_id", "label"), ["report_id", "label"], "left_anti")
    own = cut(_anchored(rest, start_anchors(rest, lines)).where("_a_page is not null"))
    named = F.get(F.filter(F.array(*[F.when(F.col("t").rlike(p), F.lit(n)) for n, p in CSR_PEERS]), lambda x: x.isNotNull()), F.lit(0))
    peers = lines.where((F.length("t") <= 120) & (_chapter() | named.isNotNull() & top_evidence())).withColumn("_named", F.when(top_evidence(), named))
    styled = first_after(own, peers.where(_chapter()).withColumn("title", F.col("t")), None, same_style())
    by_name = first_after(own, peers.where("_named is not null").withColumn("title", F.col("_named")))
    bounds = styled.unionByName(by_name).groupBy("report_id", "label").agg(F.min("b").alias("b"))
    ends = own.join(bounds, ["report_id", "label"]).withColumn("new_end", ended_by(F.col("_a_page"), F.col("_a_line_order"), F.col("b"))).where("new_end >= start_page and new_end < end_page and _a_page = start_page")
    peer = ends.select("report_id", "label", F.col("start_page").alias("new_start"), "new_end", F.lit("REPAIRED_BOUNDARY").alias("action"), F.concat(F.lit("STRONG_PEER_"), F.col("b.title")).alias("reason"))
    return _applied(sections, statutory.unionByName(peer))


def repair_long_form(sections: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Responsibility reports end before the title of another report, one with page-title evidence first, else one of the plainest titles among a page's first 12 lines;
    their exact title on the page before moves their start there. Ends never move back."""
    long = sections.where(F.col("label").isin(*LONG_FORM) & ~manual() & valid_range() & (F.col("end_page") > F.col("start_page")))
    other = F.get(F.filter("labels", lambda x: x != F.col("label")), F.lit(0))

    def bounds(found: DataFrame) -> DataFrame:
        s = long.select("report_id", "label", F.col("start_page").alias("_s"), F.col("end_page").alias("_e"))
        met = s.join(found.select("report_id", "page", "line_order", "labels"), "report_id").where((F.col("page") > F.col("_s")) & (F.col("page") <= F.col("_e"))).withColumn("title", other).where("title is not null")
        return met.groupBy("report_id", "label").agg(F.min(F.struct("page", "line_order", "title")).alias("b"))

    strong = bounds(labelled(lines.where((F.length("p") <= 180) & strong_title()), TOP_LEVEL)).withColumnRenamed("b", "_strong")
    prefix = bounds(labelled(lines.where(F.col("i") < 12), PAGE_PREFIX)).withColumnRenamed("b", "_prefix")
    titles = labelled(lines.where(F.length("p").between(1, 180)), tuple(LONG_FORM.items()))
    before = long.select("report_id", "label", (F.col("start_page") - 1).alias("page")).join(titles, KEY).where(F.array_contains("labels", F.col("label")))
    before = before.groupBy("report_id", "label").agg(F.min(F.struct("page", "line_order")).alias("_before"))
    rows = long.join(strong, ["report_id", "label"], "left").join(prefix, ["report_id", "label"], "left").join(before, ["report_id", "label"], "left").join(start_anchors(long, lines), ["report_id", "label"], "left")
    start = F.coalesce("_before", F.when(F.col("a").isNotNull(), F.struct(F.col("a.page").alias("page"), F.col("a.line_order").alias("line_order"))))
    rows = rows.withColumns({"_start": start, "_b": F.coalesce("_strong", "_prefix")}).where("_start is not null and _b is not null")
    rows = rows.withColumn("new_end", ended_by(F.col("_start.page"), F.col("_start.line_order"), F.col("_b"))).where("new_end between _start.page and end_page and not (new_end = end_page and _start.page = start_page)")
    how = F.when(F.col("_strong").isNotNull(), "STRONG_TOP_LEVEL_").otherwise("PAGE_PREFIX_")
    changes = rows.select("report_id", "label", F.col("_start.page").alias("new_start"), "new_end", F.lit("REPAIRED_BOUNDARY").alias("action"), F.concat(how, F.col("_b.title")).alias("reason"))
    return _applied(sections, changes)


def repair(sections: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, audit) after the three repairs in order: leadership, social responsibility, long reports.

    The facts of the lines and the sections between steps are written once, as each rule reads them several times.
    """
    f, audits = cut(facts(lines)), []
    for step in (repair_leadership, repair_csr, repair_long_form):
        sections, audit = step(sections, f)
        sections = cut(sections)
        audits.append(audit.select(*AUDIT))
    return sections, audits[0].unionByName(audits[1]).unionByName(audits[2])
