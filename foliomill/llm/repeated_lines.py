"""Problem 5: lines that come back in many texts of one source.

Texts are cut into chunks where a rolling hash of the letters says so, and distinct texts are counted per chunk and source.
`without_repeated_chunks` takes chunks over the whole text, line ends or not, and cuts runs of chunks that are excessive. `repeated_lines`
makes line ends cuts too, so that the chunks of a line depend on its letters alone; a line is looked at only if its first chunk is excessive,
and the exact count of the whole line then decides.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import codes, fresh, large, mix, salted, span_hashes

#: Letters in the rolling window, and letters a chunk has on average.
WINDOW, AVERAGE = 4, 16


def chunks(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Content-defined chunks of each line: (index of the line, number within the line, hash, letters)."""
    c, offsets = codes(lines)
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    line = np.repeat(np.arange(len(lines)), np.diff(offsets))
    v = mix(c.astype(np.uint64) + np.uint64(1))
    roll = np.zeros(len(c), np.uint64)
    for back in range(WINDOW):
        part = np.zeros(len(c), np.uint64)
        part[back:] = v[: len(v) - back] * np.uint64(2 * back * 0x5851F42D4C957F2D % (1 << 64) | 1)
        if back:
            part[back:][line[back:] != line[: len(line) - back]] = 0
        roll += part
    ends = mix(roll) % np.uint64(AVERAGE) == 0
    ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
    end = np.flatnonzero(ends) + 1
    start = np.concatenate([[0], end[:-1]])
    of = line[start]
    first = np.searchsorted(of, of, "left")
    return of, np.arange(len(of)) - first, span_hashes(v, start, end), end - start


def _chunk_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct chunks of each text, as one list a row."""
    for b in batches:
        lists = b.column("_lines")
        of, _, h, _ = chunks(lists.flatten().to_pylist())
        parent = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[of]
        order = np.lexsort((h, parent))
        parent, h = parent[order], h[order].view(np.int64)
        new = np.ones(len(h), bool)
        new[1:] = (parent[1:] != parent[:-1]) | (h[1:] != h[:-1])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(parent[new], minlength=len(lists)))])
        found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h[new], pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column("_source"), b.column("_doc"), found], names=["_source", "_doc", "_chunks"])


def _first_chunks(lines: pd.Series) -> pd.Series:
    out = np.zeros(len(lines), np.int64)
    of, number, h, _ = chunks(lines.tolist())
    out[of[number == 0]] = h[number == 0].view(np.int64)
    return pd.Series(out)


def _excessive(counted: DataFrame, size: DataFrame, by: str, least: int, share: float) -> DataFrame:
    """Of (_source, what, n) those that stand in `least` texts of their source and in `share` of all of them."""
    enough = F.greatest(F.lit(least), F.ceil(F.col("_all") * F.lit(share) - F.lit(1e-9)))
    return salted(counted.where(F.col("n") >= least), size, ["_source"], F.col(by)).where(F.col("n") >= enough)


def repeated_lines(df: DataFrame, id_col: str, source_col: str, text_col: str, least: int = 5, share: float = 0.015, letters: int = 12) -> DataFrame:
    """One row per line that is excessive in its source: (source_col, id_col, line_no from 1, line).

    A line is its letters, case ignored; it needs `letters` of them, and it is excessive if it stands in at least
    `least` ids of its source and in at least `share` of all of them. Repeated rows of one id count once. Rows with a
    null id or source belong to no source and give nothing; null and empty texts count as ids but have no lines.
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(source_col).isNotNull()).select(
        F.col(source_col).alias("_name"), F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.xxhash64(source_col).alias("_source"), F.xxhash64(id_col).alias("_doc"),
    )
    size = rows.select("_source", "_doc").distinct().groupBy("_source").agg(F.count("*").alias("_all"))
    kept = F.filter(
        F.transform(F.split("_text", "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"), F.regexp_replace(F.lower(x), r"[^\p{L}]+", "").alias("_key"))),
        lambda x: F.length(x["_key"]) >= letters,
    )
    lined = rows.select("_name", "_source", "_id", "_doc", kept.alias("_kept")).where(F.size("_kept") > 0)
    # Texts stay where they are read: only hashes of chunks are exchanged, once to drop repeated rows of an id, by parts of a source,
    # so that no source is one task, and once pre-aggregated to count.
    hashed = lined.select("_source", "_doc", F.col("_kept._key").alias("_lines")).mapInArrow(_chunk_lists, "_source long, _doc long, _chunks array<long>")
    once = hashed.groupBy("_source", "_doc").agg(F.array_distinct(F.flatten(F.collect_set("_chunks"))).alias("_chunks"))
    counted = once.select("_source", F.explode("_chunks").alias("_chunk")).groupBy("_source", "_chunk").agg(F.count("*").alias("n"))
    # what comes back most is what is looked for, and one source may hold a third of all rows: the many rows of a key are spread
    often = _excessive(counted, size, "_chunk", least, share).select("_source", F.col("_chunk").alias("_first"))
    lines = lined.select("_name", "_source", "_id", "_doc", F.explode("_kept").alias("_x")).select("_name", "_source", "_id", "_doc", "_x.*")
    likely = salted(lines.withColumn("_first", F.pandas_udf(_first_chunks, "long")("_key")), often, ["_source", "_first"], F.col("_doc"), "left_semi")
    key = [F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("k2"), "_key").alias("_h2")]
    likely = likely.select("_name", "_source", "_id", "_doc", "line_no", "line", *key)
    whole = likely.select("_source", "_h1", "_h2", "_doc").distinct().groupBy("_source", "_h1", "_h2").agg(F.count("*").alias("n"))
    exact = _excessive(whole, size, "_h1", least, share).select("_source", "_h1", "_h2")
    found = salted(likely, exact, ["_source", "_h1", "_h2"], F.col("_doc"), "left_semi")
    return found.select(F.col("_name").alias(source_col), F.col("_id").alias(id_col), F.col("line_no").cast("int").alias("line_no"), "line")


def without_repeated_lines(df: DataFrame, id_col: str, source_col: str, text_col: str, **limits) -> DataFrame:
    """Every row of df with `clean_text` (its text without excessive lines) and `lines_cut`; a column of those names is replaced.

    Null texts stay null; a text of excessive lines alone becomes empty.
    """
    hits = repeated_lines(df, id_col, source_col, text_col, **limits).groupBy(source_col, id_col).agg(F.collect_set("line_no").alias("_cut"))
    base = df.drop("clean_text", "lines_cut")
    a, b = fresh(base, "source"), fresh(base, "id")
    hits = hits.withColumnsRenamed({source_col: a, id_col: b})
    joined = base.join(hits, (base[source_col] == hits[a]) & (base[id_col] == hits[b]), "left").drop(a, b)
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains("_cut", (i + 1).cast("int")))
    return (
        joined.withColumn("clean_text", F.when(F.col("_cut").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
        .withColumn("lines_cut", F.coalesce(F.size("_cut"), F.lit(0)))
        .drop("_cut")
    )


@functools.cache
def _letters() -> np.ndarray:
    """Per code point 0, or for a letter the code point of its small form."""
    out = np.zeros(0x110000, np.uint32)
    for o in range(0x32000):
        if chr(o).isalpha():
            small = chr(o).lower()
            out[o] = ord(small) if len(small) == 1 else o
    return out


def text_chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of whole texts over their letters: (index of the text, hash, first character, character after the last, letters)."""
    c, offsets = codes(texts)
    small = _letters()[c]
    at = np.flatnonzero(small)
    per = np.searchsorted(at, offsets)
    joined = small[at].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    of, _, h, sizes = chunks([joined[a:b] for a, b in zip(per[:-1], per[1:])])
    end = np.cumsum(sizes)
    start = end - sizes
    first = at[start] - offsets[of] if len(of) else start
    last = at[end - 1] - offsets[of] + 1 if len(of) else end
    return of, h, first, last, sizes


def without_repeated_chunks(df: DataFrame, id_col: str, source_col: str, text_col: str, least: int = 5, share: float = 0.015, letters: int = 24) -> DataFrame:
    """Every row of df with `clean_text`, its text without runs of excessive chunks of `letters` letters or more, and `chunks_cut`.

    A chunk is excessive in its source if it stands in at least `least` ids and in at least `share` of all of them. Line ends play no part, so
    that notices inside an unbroken paragraph go too; up to a chunk of a notice may stay at either end, as it shares its letters with what
    stands beside it. Rows with a null id or source belong to no source and stay as they are; null texts stay null.
    """
    base = df.drop("clean_text", "chunks_cut")
    rows = base.where(F.col(id_col).isNotNull() & F.col(source_col).isNotNull()).select(F.xxhash64(source_col).alias("_source"), F.xxhash64(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    size = rows.select("_source", "_doc").distinct().groupBy("_source").agg(F.count("*").alias("_all"))

    def hashes(texts: pd.Series) -> pd.Series:
        of, h, *_ = text_chunks(texts.tolist())
        parts = np.split(h.view(np.int64), np.searchsorted(of, np.arange(1, len(texts))))
        return pd.Series([np.unique(p) for p in parts], dtype=object)

    once = rows.select("_source", "_doc", F.explode(F.pandas_udf(hashes, "array<long>")("_text")).alias("_chunk")).distinct()
    often = _excessive(once.groupBy("_source", "_chunk").agg(F.count("*").alias("n")), size, "_chunk", least, share).select("_source", "_chunk")
    per = salted(once, often, ["_source", "_chunk"], F.col("_doc"), "left_semi").groupBy("_source", "_doc").agg(F.collect_list("_chunk").alias("_cut"))
    a, b, c = (fresh(base, x) for x in ("source", "doc", "cut"))
    joined = base.select("*", F.xxhash64(source_col).alias(a), F.xxhash64(id_col).alias(b)).join(large(per.withColumnsRenamed({"_source": a, "_doc": b, "_cut": c})), [a, b], "left")

    def cut(texts: pd.Series, many: pd.Series) -> pd.DataFrame:
        out = []
        for text, bad in zip(texts, many):
            if text is None or bad is None or not len(bad):
                out.append((text, 0))
                continue
            _, h, first, last, n = text_chunks([text])
            hit = np.isin(h.view(np.int64), np.asarray(bad))
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            kept, at, gone = [], 0, 0
            for i, j in zip(edges[::2], edges[1::2]):
                if n[i:j].sum() >= letters:
                    kept.append(text[at : first[i]])
                    at, gone = int(last[j - 1]), gone + int(j - i)
            out.append(("".join([*kept, text[at:]]), gone))
        return pd.DataFrame(out, columns=["t", "n"])

    r = fresh(base, "r")
    known = F.col(id_col).isNotNull() & F.col(source_col).isNotNull()
    done = joined.withColumn(r, F.pandas_udf(cut, "t string, n int")(F.col(text_col), F.when(known, F.col(c))))
    return done.withColumn("clean_text", F.col(f"{r}.t")).withColumn("chunks_cut", F.col(f"{r}.n")).drop(r, a, b, c)
