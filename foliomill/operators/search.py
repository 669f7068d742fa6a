"""Literal search with snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snippets(df: DataFrame, keys: list[str], text_col: str, query: str, limit: int | None = 50, before: int = 90, after: int = 150) -> DataFrame:
    """(keys, at, snippet): every place of a literal, case ignored, with what stands around it; the first `limit` in key order.

    Places do not overlap. A blank query gives nothing.
    """
    q = query.strip().lower()
    if not q:
        return df.select(*keys, F.lit(0).alias("at"), F.lit("").alias("snippet")).limit(0)
    low = F.lower(F.col(text_col))
    rows = df.where(F.contains(low, F.lit(q))).select(*keys, F.col(text_col).alias("_t"), F.split(F.replace(low, F.lit(q), F.lit("\x00")), "\x00").alias("_s"))
    starts = F.transform(F.sequence(F.lit(1), F.size("_s") - 1), lambda n: F.aggregate(F.slice("_s", F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x)) + (n - 1) * len(q) + 1)
    hits = rows.select(*keys, "_t", F.explode(starts).alias("at"))
    first = F.greatest(F.col("at") - before, F.lit(1))
    text = F.substring(F.col("_t"), first, F.col("at") + len(q) + after - first)
    out = hits.select(*keys, "at", F.trim(F.regexp_replace(text, r"\s+", " ")).alias("snippet"))
    return out.orderBy(*keys, "at").limit(limit) if limit else out
