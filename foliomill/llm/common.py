"""Shared pieces: reading tables, text keys, token rewriting, checkpoints and small numeric kernels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut as cut

#: A run of anything but the four ASCII white-space characters.
TOKEN = r"[^ \t\r\n]+"
#: Such a run that holds a character beyond ASCII.
WIDE_TOKEN = r"(?<![^ \t\r\n])[\x00-\x08\x0B\x0C\x0E-\x1F\x21-\x7F]*+[^\x00-\x7F][^ \t\r\n]*+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the frame doesn't have yet, compared as Spark does, ignoring case."""
    have, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in have:
        name += "_"
    return name


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores of the cluster: few bytes with much work a row would otherwise be put into one task."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def large(df: DataFrame) -> DataFrame:
    """A side that grows with the data: joined by a sort-merge join, which spills and splits hot keys, however small it is estimated."""
    return df.hint("merge")


#: Parts into which the rows of a hot key are spread in joins with a small side, which is repeated as often.
SALTS = 8


def salted(left: DataFrame, right: DataFrame, keys: list[str], by: Column, how: str = "inner") -> DataFrame:
    """A join on keys that may be hot in left: its rows are spread over SALTS parts by a column of theirs, right stands in each."""
    left = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(large(right), [*keys, "_salt"], how).drop("_salt")


def sample_texts(df: DataFrame, text_col: str, n: int) -> list[str]:
    """The n distinct texts of lowest hash, blank ones left out: hashes alone are ordered, and only the texts up to the n-th are read to the driver."""
    rows = df.where(F.length(F.trim(text_col)) > 0).select(F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    last = rows.select("h").distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return [] if last is None else [r["t"] for r in rows.where(F.col("h") <= last).distinct().orderBy("h", "t").collect()]


def text_key(text: Column) -> list[Column]:
    """Two hashes that together stand for a text in joins; the text itself is never shuffled."""
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit("k2"), text).alias("_k2")]


def rewrite(df: DataFrame, text_col: str, mapping: DataFrame, out: str, pattern: str, context: dict[str, Column] | None = None, only: Callable[[Column], Column] | None = None) -> DataFrame:
    """Replace white-space separated tokens of text_col by mapping(token, fixed, *context), white space kept as it is.

    Adds `out` (the rewritten text) and `{out}_hits` (array of the distinct tokens replaced, null if none).
    Only the tokens found in the mapping come back to their text, in one map a text; its keys are hashes of the text,
    so nulls and repeated rows need no care. `context` adds equality keys that are computed from the row. `only` tells
    the tokens that the mapping can hold, which keeps the others out of the exchange.
    """
    context = context or {}
    t = F.col(text_col)
    ctx = [c.alias(f"_c_{k}") for k, c in context.items()]
    names = [f"_c_{k}" for k in context]
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    if only:
        found = F.filter(found, only)
    tokens = (
        df.where(t.isNotNull() & (t.rlike(r"[^\x00-\x7F]") if pattern == WIDE_TOKEN else F.lit(True)))
        .select(*text_key(t), *ctx, F.explode(found).alias("_token"))
    )
    side = mapping.select(F.col("token").alias("_token"), "fixed", *[F.col(k).alias(f"_c_{k}") for k in context])
    # one token may stand in a third of all texts
    per_text = (
        salted(tokens, side, ["_token", *names], F.col("_k1"))
        .groupBy("_k1", "_k2", *names)
        .agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("_token", "fixed")))).alias("_map"))
    )
    k1, k2, found_map = (fresh(df, x) for x in ("k1", "k2", "map"))
    inner = {n: fresh(df, n.strip("_")) for n in names}
    per_text = per_text.withColumnsRenamed({"_k1": k1, "_k2": k2, "_map": found_map, **inner})
    keyed = df.select("*", *[c.alias(k) for c, k in zip(text_key(t), (k1, k2))], *[c.alias(inner[f"_c_{k}"]) for k, c in context.items()])
    joined = keyed.join(large(per_text), [k1, k2, *inner.values()], "left")
    pieces = F.split(t, r"(?<=[ \t\r\n])|(?=[ \t\r\n])")
    swapped = F.array_join(F.transform(pieces, lambda x: F.coalesce(F.element_at(found_map, x), x)), "")
    return (
        joined.withColumn(out, F.when(F.col(found_map).isNull(), t).otherwise(swapped))
        .withColumn(f"{out}_hits", F.map_keys(found_map))
        .drop(k1, k2, found_map, *inner.values())
    )


#: Bits of a word set's bitmap, which bounds what is collected and sent to the workers, however many words there are.
BITS = 1 << 24


def bitmap(words: DataFrame, col: str) -> bytes:
    """A set of words as bits by hash: a word that isn't in it isn't among them, one that is may be. The driver gets at most a row for 64 bits."""
    bit = F.pmod(F.xxhash64(col), F.lit(BITS))
    rows = words.select(bit.alias("b")).groupBy(F.expr("cast(b >> 6 as int)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("bits")).toPandas()
    out = np.zeros(BITS >> 6, np.int64)
    out[rows["at"]] = rows["bits"]
    return out.tobytes()


def in_bitmap(bits: bytes, word: str) -> bool:
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 42)
    h = (h - (1 << 64) if h >> 63 else h) % BITS
    return bool(bits[h >> 3] >> (h & 7) & 1)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, and the offset at which each begins (one more than texts)."""
    lengths = np.fromiter((len(x) for x in texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    joined = "".join(texts)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that neighbouring values have unlike hashes."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash modulo 2^64 of values[start:end], for many spans, from one running sum."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    n = len(values) + 1
    up = np.full(n, base, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    down = np.full(n, inverse, np.uint64)
    down[0] = 1
    down = np.multiply.accumulate(down)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values.astype(np.uint64) * up[:-1], dtype=np.uint64)])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
