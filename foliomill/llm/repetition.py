"""Problem 10: how much of a text repeats earlier content of the same text.

Each text is folded to its words (for scripts without spaces: its letters), each of which is coded in three bytes, so that only what comes
back compresses. zstandard ratios of the codes, as a whole and in fixed chunks, and of the stored text put it into a band by limits that
depend on its length: REPETITIVE, INCOMPRESSIBLE or PLAIN. An exact count of repeated passages follows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

#: Bytes of a fixed chunk, of the code of a unit, and the compression level.
CHUNK, CODE, LEVEL = 4096, 3, 3
#: Fixed limits of the ratio (bytes of codes / compressed bytes), by bytes of codes: a text is repetitive from there on. With three tenths
#: of its units in repeated passages, a text of n units takes 7/10 of its codes, some 5 bytes for each passage of 8 units or more,
#: and 15 bytes in all, so its ratio is 3n / (2.3n + 15) at least; the limits lie below that.
BANDS = ((120, 1.0), (240, 1.08), (480, 1.15), (1 << 62, 1.2))
#: Fixed limits of the ratio of the stored text in UTF-8, by its bytes: under them it holds hardly anything that language repeats.
DENSE = ((250, 0.0), (1000, 1.1), (4096, 1.25), (1 << 62, 1.4))
#: Words, or letters, that make a passage.
WORDS, LETTERS = 8, 16
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def repeated_units(ids: np.ndarray, offsets: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Per list, the units that lie in a passage of window[list] units that began earlier in the same list too."""
    out = np.zeros(len(offsets) - 1, np.int64)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    v = mix(ids.astype(np.uint64) + np.uint64(1))
    for size in np.unique(window):
        size = int(size)
        if len(v) < size:
            continue
        n = len(v) - size + 1
        gram = np.zeros(n, np.uint64)
        for i in range(size):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + v[i : i + n]
        inside = (of[:n] == of[size - 1 :]) & (window[of[:n]] == size)
        at = np.flatnonzero(inside)
        if not len(at):
            continue
        key = mix(gram[at]) ^ mix(of[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(7))
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        again = at[first[inverse] < np.arange(len(at))]
        edge = np.zeros(len(v) + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + size, -1)
        covered = np.cumsum(edge[:-1]) > 0
        out += np.bincount(of[covered], minlength=len(out))
    return out


def _compressor(size: int) -> zstandard.ZstdCompressor:
    """A window over the whole text, however long it is."""
    more = {"window_log": min(30, size.bit_length()), "enable_ldm": True} if size > 1 << 20 else {}
    return zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, **more))


def _limit(bands: tuple, size: int) -> float:
    return next(least for upto, least in bands if size <= upto)


def band(codes: bytes, raw: bytes, small: zstandard.ZstdCompressor) -> tuple[float, float, float, str]:
    """Ratio of the codes, the highest of their chunks, ratio of the text, and the band."""
    if not raw:
        return 1.0, 1.0, 1.0, "PLAIN"

    def ratio(x: bytes) -> float:
        return len(x) / len((small if len(x) <= 1 << 20 else _compressor(len(x))).compress(x)) if x else 1.0

    whole, text = ratio(codes), ratio(raw)
    worst = max((ratio(codes[k : k + CHUNK]) for k in range(0, len(codes), CHUNK)), default=1.0) if len(codes) > CHUNK else whole
    high = whole >= _limit(BANDS, len(codes)) or worst >= _limit(BANDS, min(len(codes), CHUNK))
    return whole, worst, text, "REPETITIVE" if codes and high else "INCOMPRESSIBLE" if text < _limit(DENSE, len(raw)) else "PLAIN"


def _measure(every: bool) -> Callable:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = _compressor(0)
        for b in batches:
            n = b.num_rows
            lists = b.column("_units")
            off = lists.offsets.to_numpy()
            total, off = np.diff(off), off - off[0]
            words = lists.flatten().dictionary_encode()
            ids = words.indices.to_numpy()
            code = np.array([xxhash.xxh32_intdigest(w.encode("utf-8", "replace")) & 0xFFFFFF for w in words.dictionary.to_pylist()], "<u4")
            bytes_ = (code[ids] if len(ids) else np.zeros(0, "<u4")).view(np.uint8).reshape(-1, 4)[:, :CODE].tobytes()
            texts = b.column("_text").to_pylist()
            found = [band(bytes_[off[i] * CODE : off[i + 1] * CODE], texts[i].encode("utf-8", "replace"), small) for i in range(n)]
            repeated = np.zeros(n, np.int64)
            rows = np.flatnonzero([every or x[3] == "REPETITIVE" for x in found])
            if len(rows):
                window = np.where(b.column("_spaced").to_numpy(zero_copy_only=False)[rows], WORDS, LETTERS)
                own = np.concatenate([ids[off[i] : off[i + 1]] for i in rows])
                repeated[rows] = repeated_units(own, np.concatenate([[0], np.cumsum(total[rows])]), window)
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(total.astype(np.int64)), pa.array(repeated), *[pa.array([x[k] for x in found], pa.float64()) for k in range(3)], pa.array([x[3] for x in found], pa.string())],
                names=["_id", "units", "repeated_units", "zstd_ratio", "zstd_worst_chunk", "zstd_text", "band"],
            )

    return measure


def repetition(df: DataFrame, id_col: str, text_col: str, every: bool = True) -> DataFrame:
    """(id_col, units, repeated_units, repeated_share, zstd_ratio, zstd_worst_chunk, zstd_text, band), one row per row of df.

    Units are words without figures, case and punctuation, or letters in texts mostly of Chinese, Japanese or Thai. The share is exact for
    every text, or, unless `every`, for those of the band REPETITIVE, and 0 for the others, which can't have three tenths in repeated
    passages. Null and empty texts have 0 units, ratios of 1 and the band PLAIN.
    """
    stored = F.coalesce(F.col(text_col), F.lit(""))
    text = F.lower(stored)
    dense = F.regexp_count(text, F.lit(UNSPACED))
    rows = df.select(F.col(id_col).alias("_id"), stored.alias("_text"), text.alias("_t"), (dense * 2 <= F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))).alias("_spaced"))
    units = F.when(F.col("_spaced"), F.regexp_extract_all("_t", F.lit(r"[\p{L}\p{M}]+"), F.lit(0))).otherwise(F.regexp_extract_all("_t", F.lit(r"\p{L}"), F.lit(0)))
    rows = rows.select("_id", "_text", "_spaced", units.alias("_units"))
    kind = df.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(_measure(every), f"_id {kind}, units long, repeated_units long, zstd_ratio double, zstd_worst_chunk double, zstd_text double, band string")
    share = F.when(F.col("units") > 0, F.col("repeated_units") / F.col("units")).otherwise(F.lit(0.0))
    return out.select(F.col("_id").alias(id_col), "units", "repeated_units", share.alias("repeated_share"), "zstd_ratio", "zstd_worst_chunk", "zstd_text", "band")
