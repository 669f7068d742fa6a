"""Sections: boundaries, ranges, nesting, payloads and merges."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def next_boundary(nodes: DataFrame, group: str, order: list[str], admissible: Column, take: list[str]) -> DataFrame:
    """Each row with `next_<col>` of the first later row of its group that is admissible: a forward as-of join in one window."""
    after = Window.partitionBy(group).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    later = F.first(F.when(admissible, F.struct(*take)), ignorenulls=True).over(after)
    return nodes.withColumn("_n", later).withColumns({f"next_{c}": F.col(f"_n.{c}") for c in take}).drop("_n")


def best_per(nodes: DataFrame, keys: list[str], rank: list[Column]) -> DataFrame:
    """The best row of each group; of equal ranks none is preferred, so the rank should end with a key."""
    rest = [c for c in nodes.columns if c not in keys]
    return nodes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)])).alias("b")).select(*keys, "b.*")


def nearest(left: DataFrame, right: DataFrame, key: str, a: str, b: str, most: int) -> DataFrame:
    """Rows of left with the value b of right that is nearest to a in the same key, within `most`; of equals the smaller.

    Values are put into cells of `most`, so that each row meets its own cell and both neighbours only.
    """
    cells = left.withColumn("_cell", F.explode(F.array(*[F.floor(F.col(a) / most) + d for d in (-1, 0, 1)])))
    spots = right.select(F.col(key).alias("_k"), F.col(b).alias("_b"), F.floor(F.col(b) / most).alias("_cell2")).distinct()
    near = cells.join(spots, (cells[key] == spots["_k"]) & (cells["_cell"] == spots["_cell2"])).where(F.abs(F.col(a) - F.col("_b")) <= most)
    return near.groupBy(*left.columns).agg(F.min(F.struct(F.abs(F.col(a) - F.col("_b")).alias("gap"), F.col("_b").alias("v"))).alias("m")).select(*left.columns, F.col("m.v").alias(f"nearest_{b}"), F.col("m.gap").alias("gap"))


#: Reports on responsibility of which the foremost is kept, topics that sections hold, sections that hold them, and marks of a risk card.
PRIORITY = {"Business Responsibility & Sustainability Report (BRSR)": 4, "Business Responsibility Report (BRR)": 3, "ESG Report": 2, "Sustainability Report": 1}
TOPICS = ("Risk Management", "Human Resources & Talent", "Cybersecurity & IT Governance")
PARENTS = ("Board's Report", "Directors' Report", "Management Discussion & Analysis")
RISK_CARD = ("risk description", "impact on value", "mitigating measure", "capital at risk", "risk rating")


def valid_range(start: str = "start_page", end: str = "end_page") -> Column:
    return F.coalesce((F.col(start) > 0) & (F.col(end) >= F.col(start)), F.lit(False))


def packaging_guard(ranges: DataFrame, report: str = "report_id", label: str = "canonical_category", start: str = "start_page", end: str = "end_page", manual: Column | None = None, text: Column | None = None) -> DataFrame:
    """Every range with `action` (KEEP or SUPPRESSED_STANDALONE) and `reason`.

    Suppressed are responsibility reports with the very range of a foremost one, topics inside a section that holds them (of several the first by
    start, then by label), a one-page cybersecurity section whose text is a card of a risk register, and responsibility reports inside a board or directors'
    report that ends with them. Containment is closed and uses all ranges; manual ones stay, and so do ranges without valid pages.
    """
    manual = F.lit(False) if manual is None else F.coalesce(manual, F.lit(False))
    prior = F.create_map(*[F.lit(x) for p in PRIORITY.items() for x in p])[F.col(label)]
    same = Window.partitionBy(report, start, end)
    rows = ranges.withColumns({"_m": manual, "_prio": prior, "_v": valid_range(start, end)})
    winner = F.max(F.when(F.col("_v") & ~F.col("_m") & F.col("_prio").isNotNull(), F.struct(F.col("_prio").alias("p"), F.col(label).alias("l")))).over(same)
    # the sections that may hold others, one row a report: at most three labels, with as many ranges as the report gives them
    holders = rows.where(F.col("_v") & F.col(label).isin(*PARENTS)).groupBy(report).agg(F.array_sort(F.collect_set(F.struct(F.col(start).alias("s"), F.col(label).alias("l"), F.col(end).alias("e")))).alias("_h"))
    rows = rows.withColumn("_top", winner).join(holders, report, "left")
    within = lambda h: (h["s"] <= F.col(start)) & (F.col(end) <= h["e"])
    inside = F.get(F.filter("_h", lambda h: within(h) & (h["l"] != F.col(label))), F.lit(0))["l"]
    closing = F.array_min(F.transform(F.filter("_h", lambda h: h["l"].isin("Board's Report", "Directors' Report") & within(h) & (F.col(end) == h["e"])), lambda h: h["l"]))
    low = F.lower(T.text(text)) if text is not None else F.lit("")
    card = sum((F.when(F.contains(low, F.lit(m)), 1).otherwise(0) for m in RISK_CARD), F.lit(0)) >= 3
    reason = (
        F.when(F.col("_m") | ~F.col("_v"), F.lit(None).cast("string"))
        .when(F.col("_prio") < F.col("_top.p"), F.concat(F.lit("DUPLICATE_RANGE_OF_"), F.col("_top.l")))
        .when(F.col(label).isin(*TOPICS) & inside.isNotNull(), F.concat(F.lit("NESTED_SUBSECTION_OF_"), inside))
        .when((F.col(label) == "Cybersecurity & IT Governance") & (F.col(start) == F.col(end)) & card, "RISK_REGISTER_CARD_NOT_PEER_REPORT")
        .when(F.col("_prio").isNotNull() & closing.isNotNull(), F.concat(F.lit("REFERENCE_OR_SUBHEADING_INSIDE_"), closing))
    )
    return rows.withColumn("reason", reason).withColumn("action", F.when(F.col("reason").isNull(), "KEEP").otherwise("SUPPRESSED_STANDALONE")).drop("_m", "_prio", "_v", "_top", "_h")


def payloads(sections: DataFrame, units: DataFrame, report: str, page: str, order: str, text_col: str) -> DataFrame:
    """Each section with the ordered text of the units on its pages: a range join by page, spread over the pages of a section."""
    spread = sections.withColumn("_p", F.explode(F.sequence("start_page", "end_page")))
    u = units.select(F.col(report).alias("_r"), F.col(page).alias("_page"), F.col(order).alias("_o"), F.col(text_col).alias("_t"))
    joined = spread.join(u, (spread[report] == u["_r"]) & (spread["_p"] == u["_page"]))
    keys = sections.columns
    return joined.groupBy(*keys).agg(F.count("*").alias("units"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_t"))), lambda x: x["_t"]), "\n").alias("section_text"))


def combine(sections: DataFrame, keys: list[str], label: str, name: str) -> DataFrame:
    """One combined section a group: first and last page, and the ranges it is made of in order - never the span as content."""
    one = F.struct(F.col("start_page"), F.col("end_page"), F.col(label))
    return sections.groupBy(*keys).agg(
        F.lit(name).alias("label"), F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"),
        F.array_join(F.transform(F.array_sort(F.collect_set(one)), lambda r: F.concat_ws(":", r[label], F.concat_ws("-", r["start_page"], r["end_page"]))), "|").alias("page_ranges"),
    )


def merge_nodes(nodes: DataFrame, report: str, page: str, line: str, text_col: str, score: str, generic: str, alike: float = 0.82) -> DataFrame:
    """Nodes of a report without those that stand for the same heading: same place, or next line with related text; the better stays.

    Only neighbours on one page can be merged, so pages are groups of their own.
    """

    def better(a: tuple, b: tuple) -> bool:
        return a > b

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for r in g.sort_values([line, "_id"]).to_dict("records"):
            rank = (not r[generic], r[score] if r[score] is not None else 0, len(r["_c"]))
            for k, (old, best) in enumerate(kept):
                near = abs(old[line] - r[line]) <= 1
                a, b = old["_c"], r["_c"]
                related = old[line] == r[line] or not a or not b or a in b or b in a or SequenceMatcher(None, b, a).ratio() >= alike
                if near and related:
                    if better(rank, best):
                        kept[k] = (r, rank)
                    break
            else:
                kept.append((r, rank))
        return pd.DataFrame([x for x, _ in kept], columns=g.columns)

    rows = nodes.withColumn("_c", T.compact(F.col(text_col))).withColumn("_id", F.xxhash64(*nodes.columns)).withColumn(generic, F.coalesce(generic, F.lit(False)))
    return rows.groupBy(report, page).applyInPandas(merge, rows.schema).drop("_c", "_id")
