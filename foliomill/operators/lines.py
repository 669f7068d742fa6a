"""Pages and lines: exploding, running headers, windows and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def lines_of(pages: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, line_no from 1, line): the non-blank lines of each page, white space collapsed, numbered without gaps."""
    full = F.filter(F.transform(F.split(F.col(text_col), "\n"), T.norm_line), lambda x: x != "")
    return pages.select(*keys, F.posexplode(full).alias("_p", "line")).select(*keys, (F.col("_p") + 1).alias("line_no"), "line")


def edge_lines(pages: DataFrame, report: str, page: str, text_col: str, depth: int = 7) -> DataFrame:
    """(report, line, pages, needed): lines that stand among the first or last `depth` of a fifth of a report's pages, and of three at least.

    A line needs 5 to 140 characters and two words of ASCII letters. The counts are pre-aggregated a page before anything is exchanged.
    """
    full = F.filter(F.transform(F.split(F.col(text_col), "\n"), T.norm_line), lambda x: x != "")
    edge = F.array_distinct(F.concat(F.slice("_l", 1, depth), F.slice("_l", F.greatest(F.size("_l") - depth + 1, F.lit(1)), depth)))
    wanted = F.filter(edge, lambda x: F.length(x).between(5, 140) & (F.regexp_count(x, F.lit("[A-Za-z]+")) >= 2))
    rows = pages.select(report, page, full.alias("_l")).select(report, page, F.explode(F.when(F.size("_l") > 0, wanted)).alias("line"))
    counts = rows.groupBy(report, "line").agg(F.count("*").alias("pages"))
    total = pages.groupBy(report).agg(F.count("*").alias("_n"))
    needed = F.greatest(F.lit(3), F.floor(F.col("_n") * 0.2)).cast("int")
    return counts.join(total, report).where(F.col("_n") > 1).withColumn("needed", needed).where(F.col("pages") >= F.col("needed")).select(report, "line", "pages", "needed")


def clean_pages(pages: DataFrame, report: str, page: str, text_col: str, depth: int = 7) -> DataFrame:
    """(report, page, clean_text, lines_dropped): pages without their repeated edge lines."""
    found = edge_lines(pages, report, page, text_col, depth).groupBy(report).agg(F.collect_set("line").alias("_drop"))
    full = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), T.norm_line), lambda x: x != "")
    joined = pages.select(report, page, full.alias("_l")).join(found, report, "left")
    edge = lambda i: (i < depth) | (i >= F.size("_l") - depth)
    kept = F.filter("_l", lambda x, i: ~(edge(i) & F.coalesce(F.array_contains("_drop", x), F.lit(False))))
    return joined.select(report, page, F.array_join(kept, "\n").alias("clean_text"), (F.size("_l") - F.size(kept)).alias("lines_dropped"))


def line_windows(lines: DataFrame, keys: list[str], width: int = 5) -> DataFrame:
    """(keys, line_no, width, window): each line with up to width - 1 lines after it, joined by spaces."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    ahead = F.array(F.col("line"), *[F.lead("line", k).over(w) for k in range(1, width)])
    rows = lines.withColumn("_a", F.filter(ahead, lambda x: x.isNotNull()))
    wide = F.transform(F.sequence(F.lit(1), F.size("_a")), lambda n: F.struct(n.alias("width"), F.array_join(F.slice("_a", F.lit(1), n), " ").alias("window")))
    return rows.select(*keys, "line_no", F.explode(wide).alias("w")).select(*keys, "line_no", "w.*")


def line_context(lines: DataFrame, keys: list[str], before: int = 3, after: int = 3) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(-before, after)
    return lines.withColumn("context", F.array_join(F.collect_list("line").over(w), " "))


def multiset_minus(lines: DataFrame, other: DataFrame, keys: list[str], value: str = "line") -> DataFrame:
    """Rows of lines whose n-th occurrence of a value in its group is not in other: a difference that counts repeats."""
    nth = lambda d: d.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, value).orderBy("line_no")))
    return nth(lines).join(nth(other).select(*keys, value, "_n"), [*keys, value, "_n"], "left_anti").drop("_n")


def alias_hits(lines: DataFrame, keys: list[str], aliases: DataFrame) -> DataFrame:
    """Best line of each group for each label: 48 points if it is an alias, 42 if it holds one, fewer for longer lines, by 20 at most however long.

    `aliases` (label, alias) is a reference list; lines meet it by the first three letters of the alias within their compact form,
    so nothing is crossed.
    """
    compact = T.compact(F.col("line"))
    wanted = aliases.withColumn("_c", T.compact(F.col("alias"))).where(F.length("_c") >= 3).select("label", "_c", F.substring("_c", 1, 3).alias("_g"))
    grams = lines.withColumn("_l", compact).where(F.length("_l") >= 3)
    grams = grams.withColumn("_g", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_l") - 2), lambda i: F.substr("_l", i, F.lit(3))))))
    hits = grams.join(wanted, "_g").where(F.contains("_l", "_c"))
    score = F.when(F.col("_l") == F.col("_c"), 48).otherwise(42) - F.least(F.lit(20), (F.length("_l") - F.length("_c")) / 4).cast("int")
    best = hits.withColumn("score", score).groupBy(*keys, "label").agg(F.max(F.struct("score", (-F.col("line_no")).alias("_o"), "line")).alias("b"))
    return best.select(*keys, "label", F.col("b.score").alias("score"), (-F.col("b._o")).alias("line_no"), F.col("b.line").alias("line"))
