"""Problem 3: text statistics of each unit, and whether it is prose.

Statistics are counted for all texts in one vectorised pass an Arrow batch. Gradient-boosted trees, fitted on weakly labelled prose and
structural junk and calibrated on hand-checked texts, give the probability that a text is prose.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted
from .checked import JUNK, PROSE
from .common import codes, sample_texts

#: Texts of the bounded sample on which the trees are fitted, and words taken as common (two lists, the second within the first).
SAMPLE, COMMON, VERY_COMMON = 8000, 400, 60

LOWER, UPPER, OTHER_LETTER, DIGIT, SPACE, LINE, END, SOFT, SYMBOL, WIDE = range(10)
ENDS = ".!?。！？।؟…｡"
SOFTS = ",:'\"()-–—‘’“”„‚«»‹›、，：；（）「」『』・،؛¿¡%₹€$£&/"


def _classes() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, WIDE, np.uint8)
    for o in range(0x30000):
        ch = chr(o)
        k = unicodedata.category(ch)
        if ch in ENDS:
            c = END
        elif ch in SOFTS:
            c = SOFT
        elif ch == "\n":
            c = LINE
        elif k == "Ll":
            c = LOWER
        elif k in ("Lu", "Lt"):
            c = UPPER
        elif k[0] in "LM":
            c = OTHER_LETTER
        elif k == "Nd":
            c = DIGIT
        elif k in ("Zs", "Cf") or ch in "\t\r":
            c = SPACE
        elif o < 128:
            c = SYMBOL
        else:
            c = WIDE
        out[o] = c
    return out


_TABLE: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_classes())
    return _TABLE[0]


NAMES = (
    "n_chars", "n_lines", "n_words", "mean_word_length", "symbol_ratio", "wide_symbol_ratio", "digit_ratio", "upper_ratio", "unspaced_ratio",
    "end_per_word", "sentence_ends", "lines_ended_share", "common_share", "very_common_share", "separators_per_word", "gap_share",
    "blank_marks", "tags", "leaders", "capital_word_share", "number_word_share", "mean_line_length", "last_is_end", "colon_per_word", "short_word_share", "nonascii_ratio",
)
_WORD = re.compile(r"\w+")


def statistics(texts: list[str], common: frozenset[str], very: frozenset[str]) -> np.ndarray:
    """One row of the statistics in NAMES for each text; all zero for an empty one."""
    n = len(texts)
    c, off = codes(texts)
    k = classes()[c] if len(c) else np.zeros(0, np.uint8)
    row = np.repeat(np.arange(n), np.diff(off))
    count = np.bincount(row * 10 + k, minlength=n * 10).reshape(n, 10).astype(float)
    chars = np.diff(off).astype(float)

    def per_row(flags: np.ndarray) -> np.ndarray:
        return np.bincount(row[flags], minlength=n).astype(float)

    nxt = np.full(len(k), LINE, np.uint8)
    nxt[:-1] = np.where(row[1:] == row[:-1], k[1:], LINE)
    prev = np.full(len(k), LINE, np.uint8)
    prev[1:] = np.where(row[1:] == row[:-1], k[:-1], LINE)
    wide_end = (k == END) & (c >= 128)
    spaced_mark = (prev == SPACE) & ((c == 33) | (c == 63))
    ends = (k == END) & (((nxt == SPACE) | (nxt == LINE) | (nxt == SOFT)) | wide_end) & (prev != END) & ((prev != SPACE) | spaced_mark)
    gaps = (k == SPACE) & (nxt == SPACE) & (prev != SPACE) | (c == 9)
    seps = (c == 124) | (c == 59) | gaps
    run4 = np.zeros(len(k), bool)
    if len(k) > 3:
        for ch in (46, 95, 45):
            same = (c[:-3] == ch) & (c[1:-2] == ch) & (c[2:-1] == ch) & (c[3:] == ch)
            run4[:-3] |= same
    leader = run4 & (c == 46) & ~np.concatenate([[False], run4[:-1]])
    blanks = run4 & (c != 46) & ~np.concatenate([[False], run4[:-1]])
    lines = np.maximum(per_row(k == LINE) + 1, 1)
    # the last visible character of each line
    visible = (k != SPACE) & (k != LINE)
    line_id = np.cumsum((k == LINE) | (prev == LINE) & (np.arange(len(k)) == off[row])) if len(k) else np.zeros(0, np.int64)
    last = np.zeros(len(k), bool)
    v = np.flatnonzero(visible)
    if len(v):
        last[v[np.concatenate([line_id[v][1:] != line_id[v][:-1], [True]])]] = True
    closed = per_row(last & ((k == END) | (k == SOFT) & np.isin(c, [0x22, 0x27, 0x201D, 0x2019, 0xBB, 0x300D, 0x300F, 0x29])))
    full_lines = np.maximum(per_row(last), 1)
    out = np.zeros((n, len(NAMES)))
    words = np.ones(n)
    for i, text in enumerate(texts):
        found = _WORD.findall(text)
        m = len(found)
        if not m:
            continue
        words[i] = m
        low = [w.lower() for w in found]
        out[i, 2] = m
        out[i, 3] = sum(map(len, found)) / m
        out[i, 12] = sum(map(common.__contains__, low)) / m
        out[i, 13] = sum(map(very.__contains__, low)) / m
        out[i, 19] = sum(w[0].isupper() for w in found) / m
        out[i, 20] = sum(w[0].isdigit() for w in found) / m
        out[i, 24] = sum(len(w) < 3 for w in found) / m
    solid = np.maximum(chars - count[:, SPACE] - count[:, LINE], 1)
    letters = np.maximum(count[:, LOWER] + count[:, UPPER] + count[:, OTHER_LETTER], 1)
    sentence_ends = per_row(ends)
    out[:, 0], out[:, 1] = chars, np.where(chars > 0, lines, 0)
    out[:, 4], out[:, 5], out[:, 6] = count[:, SYMBOL] / solid, count[:, WIDE] / solid, count[:, DIGIT] / solid
    out[:, 7], out[:, 8] = count[:, UPPER] / letters, count[:, OTHER_LETTER] / letters
    out[:, 9], out[:, 10] = sentence_ends / words, sentence_ends
    out[:, 11] = closed / full_lines
    out[:, 14], out[:, 15] = per_row(seps) / words, per_row(gaps) / words
    out[:, 16] = per_row(blanks) + per_row((c == 91) & (nxt == SPACE))
    out[:, 17] = per_row((c == 60) & (nxt != SPACE) & (nxt != LINE) & ((nxt == LOWER) | (nxt == SYMBOL))) / words
    out[:, 18] = per_row(leader)
    out[:, 21] = chars / lines
    final = np.zeros(n)
    if len(v):
        ends_at = v[np.concatenate([row[v][1:] != row[v][:-1], [True]])]
        final[row[ends_at]] = (k[ends_at] == END) | np.isin(c[ends_at], [0x22, 0x201D, 0xBB, 0x300D])
    out[:, 22] = final
    out[:, 23] = per_row((c == 58) & (nxt == SPACE)) / words
    out[:, 25] = per_row(c >= 128) / solid
    out[chars == 0] = 0
    return out


def weak_label(s: np.ndarray) -> np.ndarray:
    """1 for what is surely prose, 0 for what is surely structural junk, -1 for the rest, from the statistics alone."""
    g = {name: s[:, i] for i, name in enumerate(NAMES)}
    out = np.full(len(s), -1)
    spaced = g["unspaced_ratio"] < 0.3
    calm = (g["symbol_ratio"] < 0.06) & (g["tags"] == 0) & (g["leaders"] == 0) & (g["blank_marks"] < 2) & (g["separators_per_word"] < 0.08)
    prose = calm & (g["sentence_ends"] >= 1) & (g["very_common_share"] > 0.12) & (g["number_word_share"] < 0.3)
    prose |= calm & ~spaced & (g["n_chars"] > 20) & (g["number_word_share"] < 0.4) & (g["capital_word_share"] < 0.6)
    prose |= (g["nonascii_ratio"] > 0.4) & (g["symbol_ratio"] < 0.1)  # other scripts, and text decoded wrongly
    junk = (g["symbol_ratio"] > 0.35) | (g["tags"] > 0.15) | (g["leaders"] >= 2) | (g["blank_marks"] >= 4)
    junk |= (g["separators_per_word"] > 0.2) & (g["sentence_ends"] < 2) & spaced
    junk |= spaced & (g["n_words"] >= 6) & (g["sentence_ends"] == 0) & (g["very_common_share"] < 0.05) & (g["wide_symbol_ratio"] < 0.02)
    junk |= spaced & (g["n_words"] >= 6) & (g["sentence_ends"] == 0) & (g["number_word_share"] > 0.5)
    junk &= (g["nonascii_ratio"] < 0.4) | (g["symbol_ratio"] > 0.35)
    out[prose & ~junk] = 1
    out[junk & ~prose] = 0
    return out


def common_words(df: DataFrame, text_col: str, n: int = COMMON) -> list[str]:
    """The n words that stand in the most texts of the whole table; n bounds what the driver gets."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)))
    spaced = F.filter(words, lambda w: F.length(w) > 1)
    counts = df.where(F.col(text_col).isNotNull()).select(F.explode(spaced).alias("w")).groupBy("w").count()
    return [r["w"] for r in counts.orderBy(F.desc("count"), "w").limit(n).collect()]


#: Hand-checked texts: every second one is always learned from, so that the model is defined on any table; the others are held out,
#: never learned from, and calibrate the probabilities.
SEED = ((*PROSE[::2],), (*JUNK[::2],))
HELD = ((*PROSE[1::2],), (*JUNK[1::2],))


def _truth(kinds: tuple) -> np.ndarray:
    return np.array([1.0] * len(kinds[0]) + [0.0] * len(kinds[1]))


def fit(df: DataFrame, text_col: str, common: list[str], sample: int = SAMPLE) -> Boosted:
    """Trees fitted on the seed and on `sample` distinct texts, those with the lowest hash, as far as they have a weak label and aren't held out."""
    held_out = {*HELD[0], *HELD[1]}
    rows = [t for t in sample_texts(df, text_col, sample) if t not in held_out]
    few, very = frozenset(common), frozenset(common[:VERY_COMMON])
    seed, held = (statistics([*k[0], *k[1]], few, very) for k in (SEED, HELD))
    s = statistics(rows, few, very) if rows else np.zeros((0, len(NAMES)))
    y = weak_label(s)
    x, y = np.concatenate([s[y >= 0], seed]), np.concatenate([y[y >= 0].astype(float), _truth(SEED)])
    return Boosted().fit(x, y).calibrate(held, _truth(HELD))


def text_quality(df: DataFrame, text_col: str, model: Boosted | None = None, common: list[str] | None = None) -> DataFrame:
    """Every row of df with the statistics in NAMES, `prose_probability` and `text_kind` (PROSE, STRUCTURE or EMPTY).

    Existing columns of those names are replaced. Null, empty and blank texts are EMPTY, with zero statistics and a null probability.
    """
    common = common_words(df, text_col) if common is None else common
    model = fit(df, text_col, common) if model is None else model
    few, very = frozenset(common), frozenset(common[:VERY_COMMON])

    def measure(texts: pd.Series) -> pd.DataFrame:
        t = [x or "" for x in texts]
        s = statistics(t, few, very)
        blank = np.array([not x.strip() for x in t], bool)
        s[blank] = 0
        out = pd.DataFrame(s, columns=list(NAMES))
        p = model.probability(s)
        out["prose_probability"] = np.where(blank, np.nan, p)
        out["text_kind"] = np.where(blank, "EMPTY", np.where(p >= 0.5, "PROSE", "STRUCTURE"))
        return out

    whole = {"n_chars", "n_lines", "n_words", "sentence_ends", "blank_marks", "leaders"}
    schema = ", ".join(f"{x} double" for x in NAMES) + ", prose_probability double, text_kind string"
    made = [*NAMES, "prose_probability", "text_kind"]
    base = df.drop(*[c for c in made if c != text_col])
    out = base.withColumn("_q", F.pandas_udf(measure, schema)(F.col(text_col))).select(*[base[c] for c in base.columns], "_q.*")
    out = out.withColumn("prose_probability", F.nanvl("prose_probability", F.lit(None).cast("double")))
    return out.withColumns({c: F.col(c).cast("int") for c in NAMES if c in whole})
