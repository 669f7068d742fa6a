"""Report metadata: fiscal year and company, from the first pages of each report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lines import lines_of

#: Pages of a report that are looked at, and those that count as early.
PAGES, EARLY = 60, 10
WS = r"[\s\x{A0}]"
#: How a year range is written after sure words, tried in order, and how a year ended in March is.
RANGES = (
    rf"(?i)(?:integrated{WS}+)?annual{WS}+report(?:{WS}*&{WS}*accounts)?(?:{WS}+for{WS}+the{WS}+year)?{WS}*[:\-]?{WS}*(20[0-9]{{2}}){WS}*[-–—/]{WS}*(20[0-9]{{2}}|[0-9]{{2}})",
    rf"(?i)\bFY{WS}*[:\-]?{WS}*(20[0-9]{{2}}){WS}*[-–—/]{WS}*(20[0-9]{{2}}|[0-9]{{2}})",
    rf"(?i)financial{WS}+year(?:{WS}+reported|{WS}+for{WS}+which{WS}+reporting{WS}+is{WS}+being{WS}+done)?{WS}*[:\-]?{WS}*(20[0-9]{{2}}){WS}*[-–—/]{WS}*(20[0-9]{{2}}|[0-9]{{2}})",
)
MARCHES = (
    rf"(?i)for{WS}+the{WS}+(?:financial{WS}+)?year{WS}+ended{WS}+(?:on{WS}+)?31(?:st)?{WS}+march[,]?{WS}*(20[0-9]{{2}})",
    rf"(?i)year{WS}+ended{WS}+(?:on{WS}+)?(?:march{WS}+31|31(?:st)?{WS}+march)[, ]+{WS}*(20[0-9]{{2}})",
)
PAIR = rf"(?<![\p{{L}}\p{{N}}_])(20[0-9]{{2}}){WS}*[-–—_/]{WS}*([0-9]{{2,4}})(?![\p{{L}}\p{{N}}_])"
PRIORITY = r"(?i)notice|auditors?'s report|auditors' report|annual report"
#: Legal names, what comes before them, and what their neighbourhood says for or against them.
NAME = r"([A-Z][A-Za-z0-9&.,'()\-/ ]{2,110}?(?:Private\s+Limited|Limited|Ltd\.?))\b"
EXPLICIT = r"(?i)(?:name\s+of\s+(?:the\s+)?(?:company|listed\s+entity)|company\s+name)\s*[:\-–—]*\s*([A-Z][A-Za-z0-9&.,'()\-/ ]{2,120}?(?:Private\s+Limited|Limited|Ltd\.?))\b"
LEAD = r"(?i)^(?:name\s+of\s+(?:the\s+)?(?:company|listed\s+entity)|listed\s+entity|company\s+name|for\s+and\s+on\s+behalf\s+of|for)\s*[:\-–—]*\s*"
AGAINST = (
    "registrar", "share transfer agent", "transfer agent", "registrar and transfer agent", "statutory auditor", "secretarial auditor", "internal auditor", "cost auditor", "auditor", "chartered accountants",
    "banker", "depository", "trustee", "assurance provider", "verification provider", "scrutinizer", "legal counsel", "subsidiary", "associate company", "joint venture", "step-down subsidiary",
    "stock exchange", "exchange plaza", "nominee director",
)
FOR = (
    ("integrated annual report", 26), ("annual report", 20), ("annual general meeting", 24), ("registered office", 18), ("corporate identity number", 30), ("cin", 18), ("name of the company", 45),
    ("name of the listed entity", 55), ("listed entity", 20), ("the company", 8),
)


def first_pages(pages: DataFrame, report: str, page: str, most: int = PAGES) -> DataFrame:
    """The first pages of each report with `_nth` from 1; ranks are taken over keys alone, so that no report's texts gather in one task."""
    nth = pages.select(report, page).distinct().withColumn("_nth", F.row_number().over(Window.partitionBy(report).orderBy(page))).where(F.col("_nth") <= most)
    return pages.join(nth, [report, page])


def year_range(a: Column, b: Column) -> Column:
    """(2024, '2025' or '25') as 2024-25."""
    return F.concat_ws("-", F.lpad(a.cast("string"), 4, "0"), F.right(b.cast("string"), F.lit(2)))


def _ranged(c: Column, pattern: str) -> Column:
    a = F.regexp_extract(c, pattern, 1)
    return F.when(a != "", year_range(a, F.regexp_extract(c, pattern, 2)))


def commonest(found: Column) -> Column:
    """The value that stands most often in an array, of equals the first; null for an empty one."""
    # arrays of one element, so that each step is worked out once
    tally = F.transform(F.array(found), lambda xs: F.transform(F.array_distinct(xs), lambda d: F.struct(F.size(F.filter(xs, lambda x: x == d)).alias("n"), d.alias("v"))))
    best = F.transform(tally, lambda t: F.aggregate(t, F.lit(None).cast("struct<n:int,v:string>"), lambda a, x: F.when(a.isNull() | (x["n"] > a["n"]), x).otherwise(a)))
    return F.element_at(best, 1)["v"]


def fiscal_year(pages: DataFrame, report: str, page: str, text_col: str, name: Column | None = None) -> DataFrame:
    """(report, year, confidence): a range after sure words on an early page, then on one that names a notice, auditors or the annual report; a year ended in March;
    the commonest range of the early pages; a range in the name (the report by default); a year in the name.
    """
    first = first_pages(pages.select(report, page, T.text(F.col(text_col)).alias("_t")), report, page)
    said = F.col("_t").rlike(PRIORITY)
    texts = first.groupBy(report).agg(F.array_sort(F.collect_list(F.struct("_nth", "_t", (said | (F.col("_nth") <= EARLY)).alias("p")))).alias("_a"))
    joined = lambda keep: F.array_join(F.transform(F.filter("_a", keep), lambda x: x["_t"]), "\n")
    rows = texts.select(report, joined(lambda x: x["_nth"] <= EARLY).alias("_early"), joined(lambda x: x["p"]).alias("_prior"), T.text(F.col(report) if name is None else name).alias("_name"))
    tiers = [(_ranged(F.col(c), p), "high") for c in ("_early", "_prior") for p in RANGES]
    for p in MARCHES:
        march = F.regexp_extract("_prior", p, 1)
        tiers.append((F.when(march != "", F.concat_ws("-", (march.try_cast("int") - 1).cast("string"), F.right(march, F.lit(2)))), "high"))
    pairs = F.transform(F.regexp_extract_all("_early", F.lit(PAIR), F.lit(0)), lambda x: year_range(F.regexp_extract(x, PAIR, 1), F.regexp_extract(x, PAIR, 2)))
    single = F.regexp_extract("_name", r"(?<![\p{L}\p{N}_])(20[0-9]{2})(?![\p{L}\p{N}_])", 1)
    tiers += [(commonest(pairs), "medium"), (_ranged(F.col("_name"), PAIR), "medium"), (F.when(single != "", single), "low")]
    out = F.struct(F.lit("Year not detected").alias("year"), F.lit("none").alias("confidence"))
    for value, confidence in reversed(tiers):
        out = F.when(value.isNotNull(), F.struct(value.alias("year"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return rows.select(report, out.alias("y")).select(report, "y.*")


def entity_name(c: Column) -> Column:
    """A legal name without what leads to it and the marks around it."""
    bare = F.regexp_replace(F.regexp_replace(T.text(c), r"\s+", " "), "^[ ,.|:-]+|[ ,.|:-]+$", "")
    return F.regexp_replace(F.regexp_replace(bare, LEAD, ""), "^[ ,.|:-]+|[ ,.|:-]+$", "")


def _candidates(line: Column) -> Column:
    """The legal names of a line with their keys, the one of a name field first; of one key the first."""
    named = F.regexp_extract(line, EXPLICIT, 1)
    all_ = F.transform(F.regexp_extract_all(line, F.lit(NAME), F.lit(1)), lambda x: F.struct(entity_name(x).alias("name"), F.lit(False).alias("formal")))
    both = F.when(named != "", F.concat(F.array(F.struct(entity_name(named).alias("name"), F.lit(True).alias("formal"))), all_)).otherwise(all_)
    keyed = F.filter(F.transform(both, lambda x: F.struct(x["name"].alias("name"), x["formal"].alias("formal"), T.entity_key(x["name"]).alias("key"))), lambda x: F.length(x["key"]) >= 4)
    return F.filter(keyed, lambda x, i: F.array_position(F.transform(keyed, lambda y: y["key"]), x["key"]) == i + 1)


def company(units: DataFrame, report: str, page: str, text_col: str, order: str | None = None) -> DataFrame:
    """(report, company, score, pages): the legal name of most weight on the first pages of each report.

    Each occurrence counts by its page, a name field, and the words three lines around it; the pages that hold a name and name fields count once
    more, each up to a limit; a name within the name of another that stands on half as many pages loses 40. Of equal scores the one on more pages, then the one with the
    longer key wins; of a key's spellings the commonest, then the longest, then the last by letters. `order` is a column that orders the rows of a page, if it has several.
    """
    first = first_pages(units.select(report, page, (F.lit(0) if order is None else F.col(order)).alias("_u"), text_col), report, page)
    lined = lines_of(first.select(report, page, "_u", text_col), [report, page, "_u"], text_col)
    w = Window.partitionBy(report, page).orderBy("_u", "line_no").rowsBetween(-3, 3)
    low = F.translate(F.lower("_context"), "’", "'")
    rows = lined.withColumn("_context", F.array_join(F.collect_list("line").over(w), " ")).where(F.col("line").rlike("Limited|Ltd"))
    plus = sum((F.when(F.contains(low, F.lit(t)), n).otherwise(0) for t, n in FOR), F.lit(0))
    minus = sum((F.when(F.contains(low, F.lit(t)), 55).otherwise(0) for t in AGAINST), F.lit(0))
    hits = rows.select(report, page, F.least(F.lit(100), plus).alias("_plus"), F.least(F.lit(260), minus).alias("_minus"), F.lower("_context").alias("_low"), F.explode(_candidates(F.col("line"))).alias("c")).select("*", "c.*").drop("c")
    early = F.when(F.col(page) <= 2, 18).when(F.col(page) <= 5, 10).when(F.col(page) <= 10, 4).otherwise(0)
    led = F.when(F.contains("_low", F.concat(F.lit("for "), F.lower("name"))), 16).otherwise(0)
    points = 5 + F.when(F.col("formal"), 75).otherwise(0) + early + F.col("_plus") - F.col("_minus") + led
    spelt = hits.withColumn("_s", points).groupBy(report, "key", "name").agg(F.count("*").alias("n"), F.sum("_s").alias("_s"), F.count_if("formal").alias("_f"), F.collect_set(page).alias("_p"))
    keys = spelt.groupBy(report, "key").agg(
        F.max_by("name", F.struct("n", F.length("name"), "name")).alias("company"), F.sum("_s").alias("_s"), F.sum("_f").alias("_f"), F.size(F.array_distinct(F.flatten(F.collect_list("_p")))).alias("pages"))
    whole = F.col("_s") + F.least(F.lit(150), 6 * F.col("pages")) + F.least(F.lit(60), 12 * F.col("_f"))
    # one row a report: its names, of which there are at most as many as fit on its first pages
    others = keys.groupBy(report).agg(F.collect_list(F.struct("key", "pages")).alias("_all"))
    inside = F.exists("_all", lambda o: (F.length(o["key"]) - F.length("key") >= 4) & F.contains(o["key"], F.col("key")) & (o["pages"] >= F.greatest(F.lit(2), F.floor(F.col("pages") / 2))))
    scored = keys.join(others, report).withColumn("score", whole - F.when(inside, 40).otherwise(0))
    best = F.max_by(F.struct("company", "score", "pages"), F.struct("score", "pages", F.length("key"), "key"))
    return scored.groupBy(report).agg(best.alias("b")).select(report, "b.*")


def metadata(pages: DataFrame, report: str, page: str, text_col: str, order: str | None = None) -> DataFrame:
    """(report, company, year, year_confidence): the company without its legal form, or the report's name without years where none is found."""
    years = fiscal_year(pages, report, page, text_col)
    names = company(pages, report, page, text_col, order).select(report, "company")
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(report), r"\s*\([0-9]+\)\s*$", ""), "[_-]+", " "), r"(?i)\b(?:Integrated\s+)?Annual\s+Report\b", " ")
    stem = F.regexp_replace(stem, r"\b20[0-9]{2}(?:\s*[-–—_/]?\s*[0-9]{2,4})?\b", " ")
    bare = F.regexp_replace(F.regexp_replace(entity_name(F.coalesce("company", stem)), r"(?i)\s+(?:Private\s+Limited|Limited|Ltd\.?)$", ""), "^[ ,.-]+|[ ,.-]+$", "")
    return years.join(names, report, "left").select(report, F.when(bare != "", bare).otherwise(F.trim(F.replace(F.col(report), F.lit("_"), F.lit(" ")))).alias("company"), "year", F.col("confidence").alias("year_confidence"))
