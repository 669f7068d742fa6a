"""The queries of the training-data problems, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import canonical, encoding, forms, mixing, packing, quality, repeated_lines, repetition, scans, sentences
from .common import cut, large, table


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(ship(spark), sf_dir, "mda_paragraph_level")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paragraphs(spark, sf_dir).select("paragraph_id", "paragraph_text")
    return encoding.repair_encoding(p, "paragraph_text").where("garbled").select("paragraph_id").distinct()


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.repair_encoding(_paragraphs(spark, sf_dir).select("paragraph_id", "paragraph_text", "quality_decision"), "paragraph_text")


def _structure(units: DataFrame, all_units: DataFrame) -> DataFrame:
    """(paragraph_id): those of the units that are no prose, by a model fitted on all units."""
    common = quality.common_words(all_units, "paragraph_text")
    model = quality.fit(all_units, "paragraph_text", common)
    judged = quality.text_quality(units.select("paragraph_id", "unit_type", "paragraph_text"), "paragraph_text", model, common)
    return judged.where("text_kind = 'STRUCTURE' and unit_type = 'PARAGRAPH'").select("paragraph_id").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _paragraphs(spark, sf_dir)
    p = every.where("unit_type <> 'SECTION_HEADING' and text_source = 'native' and not contains(paragraph_text, '\n')")
    # counts come from all units, those of many lines too, weights from units like those that are split
    model = sentences.fit(every.select("paragraph_id", "paragraph_text").distinct(), "paragraph_text", like=p)
    ends = sentences.sentence_ends(p.select("paragraph_id", "paragraph_text"), "paragraph_text", model)
    rows = ends.select("paragraph_id", F.explode(F.slice("sentence_ends", 1, F.greatest(F.size("sentence_ends") - 1, F.lit(0)))).alias("end_char"))
    return rows.join(large(_structure(p, every)), "paragraph_id", "left_anti").distinct()


def p2_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paragraphs(spark, sf_dir).select("paragraph_id", "paragraph_text").distinct()
    return sentences.sentences(p, "paragraph_id", "paragraph_text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paragraphs(spark, sf_dir)
    return _structure(p, p)


def p3_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paragraphs(spark, sf_dir).select("paragraph_id", "unit_type", "paragraph_word_count", "review_flag", "paragraph_text")
    return quality.text_quality(p, "paragraph_text").drop("paragraph_text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paragraphs(spark, sf_dir).select("paragraph_id", "unit_type", "paragraph_text")
    damaged = cut(scans.repair_scans(p, "paragraph_text").where("size(scan_damage) > 0").select("paragraph_id", "unit_type", "paragraph_text"))
    # cases of other problems are looked for among the damaged units only, with words, counts and models of all units
    garbled = encoding.repair_encoding(damaged, "paragraph_text", corpus=p).where("garbled").select("paragraph_id")
    odd = forms.one_form(damaged, "paragraph_text").where("out_of_form").select("paragraph_id")
    other = garbled.unionByName(odd).unionByName(_structure(damaged, p)).distinct()
    return damaged.select("paragraph_id").distinct().join(large(other), "paragraph_id", "left_anti")


def p4_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repair_scans(_paragraphs(spark, sf_dir).select("paragraph_id", "text_source", "paragraph_text"), "paragraph_text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paragraphs(spark, sf_dir)
    lines = repeated_lines.repeated_lines(p, "paragraph_id", "report_id", "paragraph_text")
    heads = p.where("unit_type = 'SECTION_HEADING'").select("paragraph_id").distinct()
    return lines.join(heads, "paragraph_id", "left_anti").select("paragraph_id", "line_no").distinct()


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paragraphs(spark, sf_dir).select("paragraph_id", "report_id", "paragraph_text")
    return repeated_lines.without_repeated_lines(p, "paragraph_id", "report_id", "paragraph_text")


def p5_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paragraphs(spark, sf_dir).select("paragraph_id", "report_id", "paragraph_text")
    return repeated_lines.without_repeated_chunks(p, "paragraph_id", "report_id", "paragraph_text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paragraphs(spark, sf_dir).select("paragraph_id", "paragraph_text")
    h = table(spark, sf_dir, "semantic_heading_manifest")
    odd = cut(forms.one_form(p, "paragraph_text").where("out_of_form").select("paragraph_id", "paragraph_text"))
    # garbled text is looked for among the units out of form only, by the words of all units
    garbled = encoding.repair_encoding(odd, "paragraph_text", corpus=p).where("garbled").select("paragraph_id").distinct()
    found = odd.select("paragraph_id").distinct().join(large(garbled), "paragraph_id", "left_anti")
    heads = forms.one_form(h.select("heading_id", "original_heading"), "original_heading").where("out_of_form")
    return (
        found.select(F.lit("mda_paragraph_level").alias("table_name"), F.col("paragraph_id").alias("record_key"))
        .unionByName(heads.select(F.lit("semantic_heading_manifest").alias("table_name"), F.col("heading_id").cast("string").alias("record_key")))
        .distinct()
    )


def p6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.one_form(_paragraphs(spark, sf_dir).select("paragraph_id", "paragraph_text"), "paragraph_text")


def p6_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.one_form(table(ship(spark), sf_dir, "semantic_heading_manifest").select("heading_id", "original_heading"), "original_heading")


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    refs = table(spark, sf_dir, "heading_category_ref"), table(spark, sf_dir, "heading_alias_ref")
    names = refs[0].select("category_code", F.col("canonical_category").alias("name"), F.lit(0).alias("n")).unionByName(refs[1].select("category_code", F.col("alias_text").alias("name"), F.col("alias_id").alias("n")))
    entries = [(r["category_code"], r["name"]) for r in names.where("category_code is not null and name is not null").distinct().orderBy("n", "category_code", "name").collect()]
    h = table(spark, sf_dir, "semantic_heading_manifest").where("canonical_category is null").select("heading_id", "original_heading")
    return canonical.canonical(h, "original_heading", entries)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headings(spark, sf_dir).select("heading_id", "category_code").distinct()


def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headings(spark, sf_dir)


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    kinds = [(r["container_kind"], r["capacity_tokens"]) for r in table(spark, sf_dir, "pack_capacity").select("container_kind", "capacity_tokens").distinct().orderBy("container_kind").collect()]
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", kinds)


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    ship(spark)
    counts = mixing.sized(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return counts, mixing.planned(counts, table(spark, sf_dir, "mix_target"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(*_mix(spark, sf_dir), "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mix(spark, sf_dir), "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(ship(spark), sf_dir, "documents")
    return repetition.repetition(d, "doc_id", "text", every=False).where("band = 'REPETITIVE' and repeated_units * 10 >= units * 3").select("doc_id").distinct()


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(ship(spark), sf_dir, "documents"), "doc_id", "text").select("doc_id", "units", "repeated_units", "repeated_share")


def p10_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(ship(spark), sf_dir, "documents"), "doc_id", "text", every=False).select("doc_id", "units", "zstd_ratio", "zstd_worst_chunk", "zstd_text", "band")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_sentences, p3_found, p3_statistics, p4_found, p4_readable, p5_found, p5_clean, p5_chunks, p6_found, p6_paragraphs, p6_headings, p7_found, p7_scores, p8_pack, p9_mixture, p9_shares, p10_found, p10_shares, p10_bands)
}

#: Per document its units and those in passages that occurred before.
_PASSAGES = r"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
s AS (SELECT doc_id, t, len(regexp_extract_all(t, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]')) * 2 <= length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS spaced FROM d),
u AS (SELECT doc_id, CASE WHEN spaced THEN regexp_extract_all(t, '[\p{L}\p{M}]+') ELSE regexp_extract_all(t, '\p{L}') END AS w, CASE WHEN spaced THEN 8 ELSE 16 END AS k FROM s),
g AS (SELECT doc_id, k, len(w) AS n, list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')) AS grams FROM u WHERE len(w) >= k),
e AS (SELECT doc_id, k, n, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS i FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) AS nth FROM e),
c AS (SELECT doc_id, any_value(n) AS n, count(DISTINCT i + o) AS covered FROM r, (SELECT unnest(range(0, 16)) AS o) WHERE nth > 1 AND o < k GROUP BY doc_id)
"""

ORACLE: dict[str, str] = {
    "p5_found": r"""
WITH u AS (SELECT DISTINCT paragraph_id, report_id, unit_type, paragraph_text FROM mda_paragraph_level),
l AS (SELECT paragraph_id, report_id, unit_type, unnest(string_split(paragraph_text, chr(10))) AS line,
             generate_subscripts(string_split(paragraph_text, chr(10)), 1) AS line_no FROM u),
k AS (SELECT *, regexp_replace(lower(line), '[^\p{L}]', '', 'g') AS letters FROM l),
c AS (SELECT report_id, letters, count(DISTINCT paragraph_id) AS n FROM k WHERE length(letters) >= 12 GROUP BY ALL),
t AS (SELECT report_id, count(DISTINCT paragraph_id) AS total FROM u GROUP BY ALL)
SELECT DISTINCT paragraph_id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN c USING (report_id, letters) JOIN t USING (report_id)
WHERE unit_type <> 'SECTION_HEADING' AND n >= 5 AND n >= 0.015 * total""",
    "p10_found": _PASSAGES + "SELECT doc_id FROM c WHERE covered * 10 >= n * 3",
    "p10_shares": _PASSAGES + """SELECT u.doc_id, CAST(len(w) AS BIGINT) AS units, CAST(coalesce(covered, 0) AS BIGINT) AS repeated_units,
CASE WHEN len(w) > 0 THEN coalesce(covered, 0) / len(w) ELSE 0.0 END AS repeated_share FROM u LEFT JOIN c USING (doc_id)""",
}
