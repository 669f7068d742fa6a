"""Problem 8: filling containers of fixed capacity with texts, by hierarchical residual packing.

Items are dealt over partitions of one size, and each packs its own best fit, largest first. Nearly full containers are final, and so are those
that hardly anything can still enter: of the containers more than half full a partition hands on those with the most room only, as any
two that are at most half full have become one. What is handed on goes on as items, and neighbouring partitions are merged, a fixed
number into one, until one round has packed what is left of all.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokens import FOLDER, token_count

#: A container this full is final; partitions merged into one a round; items of a partition; containers of a kind, more than half full, that a partition hands on.
NEARLY, FAN, ITEMS, CARRY = 0.995, 8, 50_000, 64


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit, largest first: lists of indices into sizes. No size is above the capacity."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    room: list[int] = []  # sorted distinct room of open containers
    open_at: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for i in order:
        s = sizes[i]
        k = bisect.bisect_left(room, s)
        if k < len(room):
            r = room[k]
            b = open_at[r].pop()
            if not open_at[r]:
                del open_at[r], room[k]
            bins[b].append(i)
            r -= s
        else:
            b, r = len(bins), capacity - s
            bins.append([i])
        if r:
            if r not in open_at:
                bisect.insort(room, r)
                open_at[r] = []
            open_at[r].append(b)
    return bins


def residual(bins: list[tuple], capacity: int, nearly: float, carry: int) -> tuple[list[tuple], list[tuple]]:
    """(final containers, those handed on), each a tuple that begins with its tokens."""
    done, small, large = [], [], []
    for b in bins:
        (done if b[0] >= nearly * capacity else small if 2 * b[0] <= capacity else large).append(b)
    large.sort(key=lambda b: b[0])
    return done + large[carry:], small + large[:carry]


def _packer(nearly: float, carry: int, number: int, last: bool):
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[tuple, list[tuple]] = {}
        for f in frames:
            for (kind, capacity), g in f.groupby(["kind", "capacity"], sort=False):
                waiting.setdefault((kind, int(capacity)), []).extend((int(t), [dict(x) if isinstance(x, dict) else x for x in m]) for t, m in zip(g["tokens"], g["members"]))
        part = TaskContext.get().partitionId()
        for (kind, capacity), rows in waiting.items():
            bins = [(sum(rows[i][0] for i in some), [m for i in some for m in rows[i][1]]) for some in best_fit([r[0] for r in rows], capacity)]
            done, left = (bins, []) if last else residual(bins, capacity, nearly, carry)
            for some, final in ((done, True), (left, False)):
                if some:
                    names = [f"{kind}-{number}-{part}-{i}" if final else None for i in range(len(some))]
                    yield pd.DataFrame({"kind": kind, "capacity": capacity, "tokens": [b[0] for b in some], "members": [b[1] for b in some], "name": names, "final": final})

    return pack


def pack(df: DataFrame, id_col: str, text_col: str, capacities: list[tuple[str, int]], folder: str = FOLDER, nearly: float = NEARLY, fan: int = FAN, items: int = ITEMS, carry: int = CARRY) -> DataFrame:
    """Rows (container_kind, capacity_tokens, container_id, id_col, part_no, first_token, tokens) for every text and kind.

    A text above a capacity is cut into parts of exactly the capacity and one rest; every other text is one part, part_no 1.
    Null and empty texts have no tokens and come out with a null container_id, once a kind. Repeated rows are items of
    their own. A container_id is unique within the result. A task holds `items` texts at most, and later at most `fan` times the containers
    that a task hands on.
    """
    kind_type = df.schema[id_col].dataType.simpleString()
    sized = cut(df.select(F.col(id_col).alias("_id"), token_count(F.col(text_col), folder).alias("_n")))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).cast("long").alias("capacity")) for k, c in capacities])
    if not capacities:
        kinds = F.array().cast("array<struct<kind:string,capacity:bigint>>")
    dealt = sized.select("_id", "_n", F.explode(kinds).alias("k")).select("_id", "_n", "k.*")
    empty = dealt.where("_n = 0")
    parts = dealt.where("_n > 0").select(
        "kind", "capacity", "_id", "_n",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / F.col("capacity")))).alias("_p"),
    ).select(
        "kind", "capacity",
        F.least(F.col("capacity"), F.col("_n") - F.col("_p") * F.col("capacity")).alias("tokens"),
        F.array(F.struct(
            F.col("_id").alias("id"), (F.col("_p") + 1).cast("int").alias("part_no"), (F.col("_p") * F.col("capacity")).alias("first_token"),
            F.least(F.col("capacity"), F.col("_n") - F.col("_p") * F.col("capacity")).alias("tokens"),
        )).alias("members"),
    )
    whole = parts.where("tokens = capacity").select("kind", "capacity", "members", F.concat_ws("-", "kind", F.lit("whole"), F.monotonically_increasing_id()).alias("name"))
    schema = f"kind string, capacity long, tokens long, members array<struct<id:{kind_type},part_no:int,first_token:bigint,tokens:bigint>>, name string, final boolean"
    columns = ["kind", "capacity", "members", "name"]
    small = parts.where("tokens < capacity")
    n, number, done = max(1, -(-small.count() // items)), 0, [whole]
    waiting = small.repartition(n)
    while True:
        packed = cut(waiting.coalesce(n).mapInPandas(_packer(nearly, carry, number, n == 1), schema))
        done.append(packed.where("final").select(*columns))
        if n == 1:
            break
        waiting, n, number = packed.where("not final").drop("final", "name"), -(-n // fan), number + 1
    bins = done[0]
    for d in done[1:]:
        bins = bins.unionByName(d)
    out = bins.select("kind", "capacity", F.col("name").alias("container_id"), F.explode("members").alias("m"))
    out = out.select(F.col("kind").alias("container_kind"), F.col("capacity").cast("int").alias("capacity_tokens"), "container_id", F.col("m.id").alias(id_col), F.col("m.part_no").alias("part_no"), F.col("m.first_token").alias("first_token"), F.col("m.tokens").alias("tokens"))
    none = empty.select(F.col("kind").alias("container_kind"), F.col("capacity").cast("int").alias("capacity_tokens"), F.lit(None).cast("string").alias("container_id"), F.col("_id").alias(id_col), F.lit(1).alias("part_no"), F.lit(0).cast("long").alias("first_token"), F.lit(0).cast("long").alias("tokens"))
    return out.unionByName(none)
