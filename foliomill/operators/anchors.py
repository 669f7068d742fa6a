"""Where sections begin: heading candidates over windows of lines, printed page numbers, contents entries and annexures.

All operators read one table of lines: (report, page, line_order, text, x0, y0, x1, y1, size, font, bold, layout_class, width, height), one row a line,
with null geometry where a line has none. Reference lists of headings are parameters; they are small, stand in the plan as literals and are never joined.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LINES = "report_id string, page int, line_order int, text string, x0 double, y0 double, x1 double, y1 double, size double, font string, bold boolean, layout_class string, width double, height double"
KEY = ["report_id", "page"]
#: Entries that a reference list may have, which bounds the plan.
MOST = 2000
#: Headings that fill a contents page, words that head one, and words of such pages at most.
COMMON = (
    "chairman's message", "chairman's letter", "letter from the chairman", "letter from the ceo", "managing director's message", "directors' report", "board's report", "management discussion and analysis",
    "management discussion & analysis", "corporate governance report", "corporate social responsibility", "business responsibility report", "business responsibility and sustainability report",
    "standalone financial statements", "consolidated financial statements", "independent auditor's report", "clinical governance", "notice", "gri content index",
)
NAVIGATION = ("content", "contents", "index")
#: Pages that may hold contents, and how far apart a title and its number stand at most.
CONTENTS_PAGES, NEAR = 30, 18
ANNEXURE = r"(?i)^\s*annexure\s*[-:]?\s*([ivxlcdm]+|\d{1,3}|[a-z])\b"
BOARD_EXACT = ("boardsreport", "directorsreport", "directorsreporttotheshareholders")


def key_of(s: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", s.lower())


def variants(heading: str | list[str]) -> list[str]:
    """A heading, or several, as they may be written: without brackets, with 'and' for '&' and the reverse; of equal letters and figures the first."""
    out: dict[str, str] = {}
    for raw in [heading] if isinstance(heading, str) else heading:
        h = re.sub(r"\s+", " ", raw or "").strip().replace("’", "'")
        forms = [h, re.sub(r"\s*\([^)]*\)\s*", " ", h).strip(), h.replace("&", "and"), re.sub(r"\band\b", "&", h, flags=re.IGNORECASE)]
        for f in forms:
            if key_of(f):
                out.setdefault(key_of(f), f)
    return list(out.values())


def _dimension(specs: list[tuple[str, list[str]]]) -> list[tuple[str, str, str]]:
    rows = [(label, v, key_of(v)) for label, aliases in specs for v in variants(list(aliases))]
    if len(rows) > MOST:
        raise ValueError(f"a reference list of {len(rows)} headings; {MOST} at most")
    return rows


def _literal(rows: list[tuple[str, str, str]]) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("alias"), F.lit(c).alias("target")) for a, b, c in rows])


def real_lines(lines: DataFrame) -> DataFrame:
    """The lines with text, white space collapsed as `t`, and `i`, their number on the page from 0."""
    w = Window.partitionBy(*KEY).orderBy("line_order")
    return lines.withColumn("t", T.norm_line(F.col("text"))).where("t <> ''").withColumn("i", F.row_number().over(w) - 1)


def upper_median(lines: DataFrame, least: float, most: float, default: float, where: str = "true") -> DataFrame:
    """(report_id, page, body): of the sizes of a page's lines the middle one, of an even number the upper."""
    sizes = F.array_sort(F.collect_list(F.when(F.col("size").between(least, most) & F.expr(where), F.col("size"))))
    return lines.groupBy(*KEY).agg(sizes.alias("s")).select(*KEY, F.coalesce(F.get("s", F.floor(F.size("s") / 2).cast("int")), F.lit(default)).alias("body"))


def body_font(lines: DataFrame, pages: int = 180) -> DataFrame:
    """(report_id, body_size): the median size of long lines on a report's first pages; 9 without any."""
    long = (F.length(T.norm_line(F.col("text"))) >= 30) & F.col("size").between(6, 14) & (F.col("page") <= pages)
    return lines.groupBy("report_id").agg(F.coalesce(F.percentile(F.when(long, F.col("size")), 0.5), F.lit(9.0)).alias("body_size"))


def window_candidates(lines: DataFrame, specs: list[tuple[str, list[str]]], width: int = 5) -> DataFrame:
    """(report_id, page, label, alias, line_order, line_end, matched_text, score, x0, y0, x1, y1): runs of lines that read as a heading of the list.

    A run of up to `width` lines matches an alias if its letters and figures are those of the alias (48 points), or hold them with at most 30 more
    (42; for an annexure 45 more and 8 points). Layout class, size against the page's body, place on the page and capitals add points. Runs
    over folio lines give nothing. Of a line and an alias the best run stays, of equals the shortest.
    """
    rows = _dimension(specs)
    longest = max((len(r[2]) for r in rows), default=0) + 45
    real = real_lines(lines)
    one = F.struct("t", "line_order", "size", "layout_class", "x0", "y0", "x1", "y1")
    w = Window.partitionBy(*KEY).orderBy("line_order")
    ahead = real.withColumn("_g", F.filter(F.array(one, *[F.lead(one, k).over(w) for k in range(1, width)]), lambda x: x.isNotNull()))
    runs = ahead.select(*KEY, "i", "height", F.explode(F.transform(F.sequence(F.lit(1), F.size("_g")), lambda n: F.slice("_g", F.lit(1), n))).alias("g"))
    runs = runs.where(~F.exists("g", lambda x: F.coalesce(x["layout_class"] == "folio-edge", F.lit(False)))).withColumn("run", F.array_join(F.transform("g", lambda x: x["t"]), " "))
    runs = runs.withColumn("c", T.compact(F.col("run"))).where(F.length("c").between(1, longest))

    def fits(a):
        more = F.length("c") - F.length(a["target"])
        return (F.col("c") == a["target"]) | F.contains(F.col("c"), a["target"]) & ((more <= 30) | F.contains("c", F.lit("annexure")) & (more <= 45))

    committee = lambda a: (a["target"] == "corporatesocialresponsibility") & F.contains("c", F.lit("committee"))
    hits = runs.withColumn("a", F.explode(F.filter(_literal(rows), lambda a: fits(a) & ~committee(a)) if rows else F.array().cast("array<struct<label:string,alias:string,target:string>>")))
    hits = hits.join(upper_median(real, 5, 15, 9.0), KEY)
    exact, target, more = F.col("c") == F.col("a.target"), F.col("a.target"), F.length("c") - F.length("a.target")
    has = lambda v: F.exists("g", lambda x: F.coalesce(x["layout_class"] == v, F.lit(False)))
    big = F.coalesce(F.array_max(F.transform("g", lambda x: x["size"])), F.lit(0.0))
    x0, y0, x1, y1 = (f(F.col(f"g.{k}")) for f, k in ((F.array_min, "x0"), (F.array_min, "y0"), (F.array_max, "x1"), (F.array_max, "y1")))
    top = y0 / F.greatest(F.coalesce("height", F.lit(800.0)), F.lit(1.0))
    letters = F.regexp_replace("run", "[^A-Za-z]+", "")
    score = (
        F.when(exact, 48).otherwise(42) + F.when(exact & target.isin(*BOARD_EXACT), 15).otherwise(0)
        + F.when(has("title"), 22).when(has("section-header"), 18).when(has("page-header") | has("page-footer"), -30).otherwise(0)
        + F.when(F.contains("c", F.lit("annexure")) & (more <= 45), 8).otherwise(0)
        + F.when(big >= 16, 18).when(big - F.col("body") >= 3, 14).when(big - F.col("body") >= 1.5, 8).otherwise(0)
        + F.when(y0.isNull(), F.when(F.col("i") < 12, 5).otherwise(0)).when(top < 0.18, 8).when(top < 0.35, 4).otherwise(0)
        + F.when((F.length(letters) >= 8) & (F.upper("run") == F.col("run")), 3).otherwise(0)
    )
    found = hits.select(*KEY, "a.label", "a.alias", F.get("g", F.lit(0))["line_order"].alias("line_order"), F.element_at("g", -1)["line_order"].alias("line_end"), F.col("run").alias("matched_text"), score.cast("int").alias("score"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    rest = ["line_end", "matched_text", "score", "x0", "y0", "x1", "y1"]
    return found.groupBy(*KEY, "label", "alias", "line_order").agg(F.max_by(F.struct(*rest), F.struct("score", -F.col("line_end"))).alias("b")).select(*KEY, "label", "alias", "line_order", "b.*")


def edge_folios(lines: DataFrame) -> DataFrame:
    """(report_id, page, line_order, number, x, y): page numbers printed at the upper or lower edge.

    A line that is a number counts within 6 % of an edge, a number after white space or a bar at the end of a line of up to 150 characters within 12 % (10 % below).
    Years and numbers over 1500 are none; on wide pages a number must stand near a side.
    """
    h, w = F.coalesce("height", F.lit(800.0)), F.coalesce("width", F.lit(600.0))
    t = T.norm_line(F.col("text"))
    strict = (F.col("y0") < 0.06 * h) | (F.col("y1") > 0.94 * h)
    edge = (F.col("y0") < 0.12 * h) | (F.col("y1") > 0.90 * h)
    alone, last = F.regexp_extract(t, r"^0*(\d{1,4})$", 1), F.regexp_extract(t, r"(?:\bI\s+|\|\s*|\s)0*(\d{1,4})\s*$", 1)
    number = F.when(strict & (alone != ""), alone).when(F.length(t) <= 150, last).try_cast("int")
    out = lines.where(F.col("y0").isNotNull() & edge).select(*KEY, "line_order", number.alias("number"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), (w / F.greatest(h, F.lit(1.0)) >= 1.25).alias("_wide"), w.alias("_w"))
    side = (F.col("x") <= 0.20 * F.col("_w")) | (F.col("x") >= 0.80 * F.col("_w"))
    return out.where(_page_number("number", 0) & (~F.col("_wide") | side)).drop("_wide", "_w")


def _page_number(c: str, least: int = 1) -> Column:
    return F.col(c).between(least, 1500) & ~F.col(c).between(1900, 2099)


def two_up(lines: DataFrame, folios: DataFrame | None = None) -> DataFrame:
    """(report_id, page): wide pages with two printed page numbers at least, which are two pages of the report each."""
    f = edge_folios(lines) if folios is None else folios
    wide = lines.where(F.col("width") / F.greatest("height", F.lit(1.0)) >= 1.25).select(*KEY).distinct()
    return f.groupBy(*KEY).agg(F.count_distinct("number").alias("n")).where("n >= 2").select(*KEY).join(wide, KEY, "left_semi")


def printed_pages(anchors: DataFrame, lines: DataFrame) -> DataFrame:
    """Each anchor with `printed_page`: of the folios nearest an edge of its page the one nearest to the anchor's middle, the first for an anchor without a place."""
    heights = lines.groupBy(*KEY).agg(F.coalesce(F.max("height"), F.lit(800.0)).alias("_h"))
    f = edge_folios(lines).join(heights, KEY).withColumn("_edge", F.least(F.col("y"), F.greatest(F.lit(0.0), F.col("_h") - F.col("y"))))
    per = f.groupBy(*KEY).agg(F.min("_edge").alias("_best"), F.collect_list(F.struct("line_order", "number", "x", "_edge")).alias("_f"))
    near = F.filter("_f", lambda p: p["_edge"] <= F.col("_best") + 12)
    middle = (F.col("x0") + F.col("x1")) / 2
    ranked = F.array_sort(F.transform(near, lambda p: F.struct(F.coalesce(F.abs(p["x"] - middle), F.lit(0.0)).alias("d"), p["line_order"].alias("o"), p["number"].alias("n"))))
    return anchors.join(per, KEY, "left").withColumn("printed_page", F.get(ranked, F.lit(0))["n"]).drop("_best", "_f")


def contents_pages(lines: DataFrame) -> DataFrame:
    """(report_id, page, navigation, hits, words): pages that are a contents page: headed as one, or five usual headings among 500 words at most."""
    real = real_lines(lines)
    heads = F.array(*[F.lit(k) for k in dict.fromkeys(map(key_of, COMMON))])
    c = T.compact(F.col("t"))
    hit = F.size(F.filter(heads, lambda h: (F.length(c) <= 90) & ((c == h) | F.contains(c, h) & (F.length(c) <= F.length(h) + 24))))
    nav = F.lower("t").isin(*NAVIGATION) & F.when(F.col("y0").isNotNull(), (F.col("y0") + F.col("y1")) / 2 < 0.35 * F.coalesce("height", F.lit(800.0))).otherwise(F.col("i") < 15)
    per = real.groupBy(*KEY).agg(F.bool_or(nav).alias("navigation"), F.sum(hit).cast("int").alias("hits"), F.sum(F.regexp_count("t", F.lit("[A-Za-z]+"))).cast("int").alias("words"))
    return per.where("navigation or hits >= 5 and words <= 500")


def numbers_near(titles: DataFrame, lines: DataFrame, before: bool = False) -> DataFrame:
    """Each title line with `number`, the nearest line of its page that is a page number at most NEAR points above or below; of equals the smaller.

    With `before` numbers that stand no lower than the title come first. Lines are put into bands of NEAR points, so that each title meets its own band and both neighbours.
    """
    mid = (F.col("y0") + F.col("y1")) / 2
    n = lines.where("y0 is not null").select(*KEY, mid.alias("_ny"), F.regexp_extract(T.norm_line(F.col("text")), r"^0*(\d{1,4})$", 1).try_cast("int").alias("_n")).where(_page_number("_n"))
    n = n.withColumn("_band", F.floor(F.col("_ny") / NEAR))
    t = titles.withColumn("_y", mid).withColumn("_band", F.explode(F.array(*[F.floor(F.col("_y") / NEAR) + d for d in (-1, 0, 1)])))
    met = t.join(n, [*KEY, "_band"]).where(F.abs(F.col("_ny") - F.col("_y")) <= NEAR)
    first = F.when(F.col("_ny") <= F.col("_y") + 2, 0).otherwise(1) if before else F.lit(0)
    best = met.groupBy(*KEY, "line_order").agg(F.min(F.struct(first.alias("f"), F.abs(F.col("_ny") - F.col("_y")).alias("d"), F.col("_n").alias("n"))).alias("b"))
    return titles.join(best.select(*KEY, "line_order", F.col("b.n").alias("number")), [*KEY, "line_order"], "left")


def contents_entries(lines: DataFrame) -> DataFrame:
    """(report_id, title, compact, printed_page): entries of the contents pages among a report's first pages, a number on the line or the nearest one beside it."""
    where = contents_pages(lines).where(F.col("page") <= CONTENTS_PAGES).select(*KEY)
    real = real_lines(lines).join(where, KEY, "left_semi")
    t = F.col("t")
    bare = F.regexp_replace(F.lower(t), "^[ :–—-]+|[ :–—-]+$", "")
    heads = real.where(T.heading_like(t) & ~bare.isin("content", "contents", "index", "table of contents"))
    left, right = F.regexp_extract(t, r"^\s*0*(\d{1,4})\s+(.+)$", 1).try_cast("int"), F.regexp_extract(t, r"^(.+?)\s+0*(\d{1,4})\s*$", 2).try_cast("int")
    ok = lambda x: x.isNotNull() & ~x.between(1900, 2099)
    heads = numbers_near(heads, lines)
    own = F.when(ok(left), left).when(ok(right), right)
    title = F.when(ok(left), F.regexp_extract(t, r"^\s*0*(\d{1,4})\s+(.+)$", 2)).when(ok(right), F.regexp_extract(t, r"^(.+?)\s+0*(\d{1,4})\s*$", 1)).otherwise(t)
    title = F.trim(F.regexp_replace(title, r"^\s*[-–—:]+|[-–—:]+\s*$", ""))
    rows = heads.select("report_id", title.alias("title"), F.coalesce(own, "number").alias("printed_page")).where(F.col("printed_page").isNotNull() & T.heading_like(F.col("title")))
    rows = rows.withColumn("compact", T.compact(F.col("title")))
    return rows.groupBy("report_id", "compact", "printed_page").agg(F.max_by("title", F.struct(F.length("title"), "title")).alias("title"))


def contents_page_of(lines: DataFrame, specs: list[tuple[str, list[str]]]) -> DataFrame:
    """(report_id, label, contents_page): the printed page that the contents give for each heading of the list: the first line that names it with a number at
    its start or end, or beside it, before it if there is one."""
    where = contents_pages(lines).where(F.col("page") <= CONTENTS_PAGES).select(*KEY)
    real = real_lines(lines).join(where, KEY, "left_semi")
    c, t = T.compact(F.col("t")), F.col("t")
    hits = real.withColumn("_c", c).withColumn("a", F.explode(F.filter(_literal(_dimension(specs)), lambda a: F.contains("_c", a["target"]) & (F.length("_c") <= F.length(a["target"]) + 40))))
    start, end = F.regexp_extract(t, r"^\s*0*(\d{1,4})\b", 1).try_cast("int"), F.regexp_extract(t, r"\b0*(\d{1,4})\s*$", 1).try_cast("int")
    ok = lambda x: x.isNotNull() & ~x.between(1900, 2099)
    one = hits.select(*KEY, "line_order", "y0", "y1", F.col("a.label").alias("label"), F.when(ok(start), start).when(ok(end), end).alias("_own")).distinct()
    beside = numbers_near(real, lines, before=True).select(*KEY, "line_order", "number")
    rows = one.join(beside, [*KEY, "line_order"], "left").withColumn("n", F.coalesce("_own", "number")).where("n is not null")
    return rows.groupBy("report_id", "label").agg(F.min_by("n", F.struct("page", "line_order")).alias("contents_page"))


def section_anchors(lines: DataFrame, specs: list[tuple[str, list[str]]], least: int = 54) -> DataFrame:
    """(report_id, label, page, line_order, matched_text, score, printed_page, ...): the best place of each heading of the list, if it has `least` points.

    Contents pages hold no section. A place whose printed page is the one that the contents give gains 45 points, one beside it 12, one more than three pages off loses 15.
    Of equal scores the one nearer to the page of the contents wins, then the earlier.
    """
    found = printed_pages(window_candidates(lines, specs).join(contents_pages(lines).select(*KEY), KEY, "left_anti"), lines).join(contents_page_of(lines, specs), ["report_id", "label"], "left")
    off = F.abs(F.col("printed_page") - F.col("contents_page"))
    score = F.col("score") + F.when(off == 0, 45).when(off == 1, 12).when(off > 3, -15).otherwise(0)
    far = F.when(F.col("contents_page").isNull(), 0).otherwise(-F.abs(F.coalesce("printed_page", F.lit(10**6)) - F.col("contents_page")))
    rows = found.withColumn("score", score).where(F.col("score") >= least)
    rest = [c for c in rows.columns if c not in ("report_id", "label")]
    best = F.max_by(F.struct(*rest), F.struct("score", far, -F.col("page"), -F.col("line_order"), "alias"))
    out = rows.groupBy("report_id", "label").agg(best.alias("b")).select("report_id", "label", "b.*")
    return out.withColumn("printed_page", F.coalesce("printed_page", F.when(F.col("score") >= 66, F.col("contents_page"))))


def annexure_anchors(lines: DataFrame, specs: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """(report_id, page, line_order, annexure, matched_text, label): the first annexure line among the first 40 of each page that is no contents page.

    `label` is the first heading of the list that the line and the eight after it hold, or 'Annexure N'.
    """
    real = real_lines(lines).join(contents_pages(lines).select(*KEY), KEY, "left_anti")
    w = Window.partitionBy(*KEY).orderBy("line_order").rowsBetween(0, 8)
    rows = real.withColumn("_window", F.array_join(F.collect_list("t").over(w), " ")).where(F.col("i") < 40)
    rows = rows.withColumn("annexure", F.regexp_extract(F.translate("t", "’", "'"), ANNEXURE, 1)).where("annexure <> ''")
    first = rows.groupBy(*KEY).agg(F.min_by(F.struct("line_order", "annexure", F.col("t").alias("matched_text"), F.col("_window")), "line_order").alias("b")).select(*KEY, "b.*")
    names = _dimension(specs or [])
    held = F.filter(_literal(names), lambda a: F.contains(T.compact(F.col("_window")), a["target"])) if names else F.array().cast("array<struct<label:string,alias:string,target:string>>")
    return first.withColumn("label", F.coalesce(F.get(held, F.lit(0))["label"], F.concat_ws(" ", F.lit("Annexure"), F.upper("annexure")))).drop("_window")
