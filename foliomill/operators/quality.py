"""Page quality: metrics, screening, and the choice between two texts of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def metrics(df: DataFrame, text_col: str, prefix: str = "") -> DataFrame:
    c = F.col(text_col)
    return df.withColumns({
        f"{prefix}word_count": T.word_count(c), f"{prefix}letters": T.letters(c), f"{prefix}solid_chars": T.solid_chars(c),
        f"{prefix}mojibake_count": T.mojibake_count(c), f"{prefix}replacement_count": T.replacement_count(c), f"{prefix}text_sha256": T.text_hash(c),
    })


def screening_reasons(c: Column, method: Column) -> Column:
    """Array of the signs that a page's text may be wrong; none alone replaces it."""
    moj, repl = T.per_char(T.mojibake_count(c), c), T.per_char(T.replacement_count(c), c)
    signs = (
        ("VERY_LOW_TEXT", F.length(T.norm_ends(c)) < 40),
        ("MOJIBAKE_SIGNAL", moj >= 0.0015),
        ("REPLACEMENT_CHARACTER_SIGNAL", repl >= 0.0005),
        ("LOW_ALPHA_WITH_CORRUPTION_SIGNAL", (T.word_count(c) >= 30) & (T.alpha_ratio(c) < 0.12) & ((moj > 0) | (repl > 0))),
        ("PRODUCTION_OCR_PAGE", F.coalesce(method == "ocr", F.lit(False))),
    )
    return F.filter(F.array(*[F.when(on, F.lit(name)) for name, on in signs]), lambda x: x.isNotNull())


def choose_text(base: Column, other: Column, reasons: Column) -> Column:
    """OCR, NATIVE or REVIEW: whether the other text of a page is safer; REVIEW keeps the base text."""
    bw, ow = T.word_count(base), T.word_count(other)
    bm, om = T.per_char(T.mojibake_count(base), base), T.per_char(T.mojibake_count(other), other)
    better = (bm >= 0.0015) & (om <= F.greatest(F.lit(0.0002), bm * 0.25))
    kept = F.when(bw > 0, ow / bw).otherwise(F.lit(0.0))
    fuller = (T.alpha_ratio(other) >= T.alpha_ratio(base) + 0.08) & (kept >= 0.85) & F.array_contains(reasons, "VERY_LOW_TEXT")
    return (
        F.when((bw <= 3) & (ow >= 8), "OCR").when((bw > 0) & better & (kept >= 0.70), "OCR").when((bw > 0) & better & (kept >= 0.45), "REVIEW")
        .when((bw > 0) & fuller, "OCR").when(F.size(reasons) == 0, "NATIVE").otherwise("REVIEW")
    )


def decisions_by(df: DataFrame, key: str, decision: str = "decision") -> DataFrame:
    return df.groupBy(key).agg(
        F.count("*").alias("pages"), *[F.count_if(F.col(decision) == d).alias(f"{d.lower()}_pages") for d in ("NATIVE", "OCR", "REVIEW")]
    )
