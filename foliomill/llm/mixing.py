"""Problem 9: mixing sources to target shares along a curriculum that changes over training time.

Each source has a weight schedule w(t) = share * (1 + tilt * (2t - 1)), t from 0 to 1; tilts are balanced so that the weights
sum to one at any time. A record that begins after a fraction u of its source's tokens belongs to the time at which the
integral of its schedule is u. Records are sorted by that time in ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import FOLDER, token_count

#: Records of a part into which sources are cut for running sums, on the average of all, and the strongest tilt.
RECORDS, TILT = 100_000, 0.5


def plan(totals: dict[str, int], targets: list[tuple[str, float, int]], tilt: float = TILT) -> dict[str, dict]:
    """Per target source: tokens there are, its share among the sources that have any, its demand, its tilt.

    The size of the mixture is the largest at which no present source is used more often than it may be.
    """
    rows = {s: {"target": float(w), "repeats": int(r), "there": int(totals.get(s, 0))} for s, w, r in targets}
    there = {s: x for s, x in rows.items() if x["there"] > 0 and x["target"] > 0 and x["repeats"] > 0}
    whole = math.fsum(x["target"] for x in there.values())
    size = min((x["there"] * x["repeats"] * whole / x["target"] for x in there.values()), default=0.0)
    for x in rows.values():
        x |= {"share": 0.0, "demand": 0, "tilt": 0.0}
    for x in there.values():
        x["share"] = x["target"] / whole
        x["demand"] = min(x["there"] * x["repeats"], math.floor(size * x["share"] + 1e-6))
        x["tilt"] = tilt / 2 if x["repeats"] > 1 else -tilt / 2
    mean = math.fsum(x["share"] * x["tilt"] for x in there.values())
    for x in there.values():
        x["tilt"] = max(-1.0, min(1.0, x["tilt"] - mean))
    return rows


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str, folder: str = FOLDER) -> DataFrame:
    return cut(df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), token_count(F.col(text_col), folder).alias("_n")))


def planned(counts: DataFrame, targets: DataFrame, tilt: float = TILT) -> dict[str, dict]:
    """The plan; only one sum for each source that has a target comes to the driver."""
    names = targets.select("source").distinct()
    totals = {r["_source"]: r["n"] for r in counts.join(F.broadcast(names), counts["_source"] == names["source"], "left_semi").groupBy("_source").agg(F.sum("_n").alias("n")).collect()}
    rows = [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.select("source", "target_share", "max_repeats").distinct().collect()]
    return plan(totals, rows, tilt)


def mixture(counts: DataFrame, planned_rows: dict[str, dict], id_col: str) -> DataFrame:
    """Rows (position, source, id_col, repeat_no, tokens), sorted by position in ranges.

    A source is read in a fixed pseudo-random order, over and over until its demand is met; the record that crosses
    the demand is taken if more than half of it lies within. Texts without tokens and sources without a target give nothing.
    """
    spark = counts.sparkSession
    used = [(s, x["demand"], x["there"], x["tilt"], x["repeats"]) for s, x in planned_rows.items() if x["demand"] > 0]
    side = F.broadcast(spark.createDataFrame(used, "_s string, _demand long, _there long, _tilt double, _most int"))
    rows = counts.where("_n > 0").join(side, counts["_source"] == F.col("_s")).drop("_s")
    order = F.xxhash64("_id", F.lit("order"))
    part = F.pmod(F.shiftright(order, 32), F.lit(max(16, rows.count() // RECORDS)))
    rows = rows.withColumns({"_order": order, "_part": part})
    # running sums in two steps: over the parts of a source, then within a part
    sums = rows.groupBy("_source", "_part").agg(F.sum("_n").alias("_sum"))
    before = sums.select("_source", "_part", (F.sum("_sum").over(Window.partitionBy("_source").orderBy("_part")) - F.col("_sum")).alias("_before"))
    within = F.sum("_n").over(Window.partitionBy("_source", "_part").orderBy("_order", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_within", within).join(before, ["_source", "_part"])
    start = F.col("_before") + F.col("_within") - F.col("_n")
    times = F.floor((F.col("_demand") - 1) / F.col("_there"))
    rows = rows.withColumn("_start", start).withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.least(times, F.col("_most") - 1))))
    at = F.col("_start") + F.col("_r") * F.col("_there")
    rows = rows.where(at + F.col("_n") / 2 <= F.col("_demand"))
    u = F.least(F.lit(1.0), (at + F.col("_n") / 2) / F.col("_demand"))
    b = 1 - F.col("_tilt")
    position = 2 * u / (b + F.sqrt(b * b + 4 * F.col("_tilt") * u))
    out = rows.select(position.alias("position"), F.col("_source").alias("source"), F.col("_id").alias(id_col), (F.col("_r") + 1).cast("int").alias("repeat_no"), F.col("_n").alias("tokens"))
    return out.orderBy("position", "source", id_col, "repeat_no")


def shares(counts: DataFrame, planned_rows: dict[str, dict], id_col: str) -> DataFrame:
    """Per source of the targets: target and actual share, tokens there and used, most repeats used and allowed."""
    spark = counts.sparkSession
    side = spark.createDataFrame([(s, x["target"], x["there"], x["repeats"]) for s, x in planned_rows.items()], "source string, target_share double, tokens_there long, max_repeats int")
    got = mixture(counts, planned_rows, id_col).groupBy("source").agg(F.sum("tokens").alias("tokens_used"), F.count("*").alias("records_used"), F.max("repeat_no").alias("repeats_used"))
    total = Window.partitionBy()
    out = side.join(got, "source", "left").fillna(0, ["tokens_used", "records_used", "repeats_used"])
    actual = F.when(F.sum("tokens_used").over(total) > 0, F.col("tokens_used") / F.sum("tokens_used").over(total)).otherwise(F.lit(0.0))
    return out.withColumn("actual_share", actual).withColumn("share_gap", F.col("actual_share") - F.col("target_share"))
