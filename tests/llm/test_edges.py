"""Each operator on nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from foliomill.llm import canonical, encoding, forms, mixing, packing, quality, repeated_lines, repetition, scans, sentences

LONG = "The plant tested the pump. " * 4000 + "x" * 60000 + " 報告" * 3000
ROWS = [("a", "r", None), ("b", "r", ""), ("c", "r", "   \n  "), ("d", None, "Only text."), (None, "r", "Text of no id."), ("e", "r", LONG), ("f", "r", "Repeated row."), ("f", "r", "Repeated row."), ("g", "r", "x" * 30000)]
SCHEMA = "id string, source string, text string"
ENTRIES = [("CSR", "Corporate Social Responsibility"), ("RISK", "Risk Management")]

ADDING = {
    "encoding": (lambda d: encoding.repair_encoding(d, "text"), ["repaired_text", "garbled"]),
    "forms": (lambda d: forms.one_form(d, "text"), ["normal_text", "out_of_form"]),
    "quality": (lambda d: quality.text_quality(d, "text"), ["n_words", "text_kind", "prose_probability"]),
    "scans": (lambda d: scans.repair_scans(d, "text"), ["readable_text", "scan_damage"]),
    "sentences": (lambda d: sentences.sentence_ends(d, "text"), ["sentence_ends"]),
    "canonical": (lambda d: canonical.canonical(d, "text", ENTRIES), ["category_code", "match_score"]),
    "lines": (lambda d: repeated_lines.without_repeated_lines(d, "id", "source", "text"), ["clean_text", "lines_cut"]),
}


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("name", ADDING)
def test_every_row_comes_back(spark, rows, name):
    make, added = ADDING[name]
    clash = rows.withColumn(added[0], F.lit("old")).withColumn("_k1", F.lit(1)).withColumn("token", F.lit("t")).withColumn("form", F.lit(2))
    out = make(clash)
    assert len(out.columns) == len(set(out.columns)) and set(added) <= set(out.columns)
    got = out.collect()
    assert sorted(str(r["id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert {(r["id"], r["text"]) for r in got} == {(r[0], r[2]) for r in ROWS}
    assert all(r[added[0]] != "old" for r in got)


@pytest.mark.parametrize("name", ADDING)
def test_empty_table(spark, rows, name):
    assert ADDING[name][0](rows.limit(0)).count() == 0
    nulls = spark.createDataFrame([("a", "r", None)] * 2, SCHEMA)
    assert ADDING[name][0](nulls).count() == 2


def test_null_results(spark, rows):
    def of(df):
        return {r["id"]: r for r in df.collect()}

    e = of(encoding.repair_encoding(rows, "text"))
    assert e["a"]["repaired_text"] is None and not e["a"]["garbled"] and e["b"]["repaired_text"] == ""
    q = of(quality.text_quality(rows, "text"))
    assert q["a"]["text_kind"] == q["b"]["text_kind"] == q["c"]["text_kind"] == "EMPTY" and q["a"]["prose_probability"] is None
    s = of(sentences.sentence_ends(rows, "text"))
    assert s["a"]["sentence_ends"] == s["b"]["sentence_ends"] == s["c"]["sentence_ends"] == [] and s["d"]["sentence_ends"] == [10]
    k = of(canonical.canonical(rows, "text", ENTRIES))
    assert k["a"]["category_code"] == "UNMATCHED" and k["a"]["match_score"] == 0.0
    p = of(scans.repair_scans(rows, "text"))
    assert p["a"]["readable_text"] is None and p["a"]["scan_damage"] == []


def test_repetition_edges(spark, rows):
    got = {r["id"]: r for r in repetition.repetition(rows, "id", "text").collect()}
    assert got["a"]["units"] == got["b"]["units"] == got["c"]["units"] == 0 and got["a"]["repeated_share"] == 0.0
    assert got["e"]["repeated_share"] > 0.9
    assert repetition.repetition(rows.limit(0), "id", "text").count() == 0


def test_packing_edges(spark, rows):
    out = packing.pack(rows, "id", "text", [("k", 100)]).collect()
    assert {r["id"] for r in out if r["container_id"] is None} == {"a", "b"}
    assert packing.pack(rows.limit(0), "id", "text", [("k", 100)]).count() == 0
    assert packing.pack(rows, "id", "text", []).count() == 0


def test_mixing_edges(spark, rows):
    counts = mixing.sized(rows, "id", "text", "source")
    targets = spark.createDataFrame([("r", 0.6, 2), ("gone", 0.4, 3)], "source string, target_share double, max_repeats int")
    plan = mixing.planned(counts, targets)
    shares = {r["source"]: r for r in mixing.shares(counts, plan, "id").collect()}
    assert shares["gone"]["actual_share"] == 0 and shares["r"]["actual_share"] == 1.0
    empty = mixing.sized(rows.limit(0), "id", "text", "source")
    assert mixing.mixture(empty, mixing.planned(empty, targets), "id").count() == 0
