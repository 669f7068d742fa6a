"""Files in and out, the content cache and the stream."""

from foliomill.operators import units
from foliomill.plans import pipeline
from foliomill.sources import files, sinks
from foliomill.streaming import ingest


def test_read_and_cache(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("===== PAGE 1 =====\nfirst\n===== PAGE 2 =====\nsecond\n")
    (src / "b.md").write_text("just one")
    (src / "c.docx").write_bytes(sinks.docx("Title & more", "para one\n\npara two"))
    (src / "d.docx").write_bytes(b"not a zip")
    found = files.files(spark, str(src))
    got = {(r["path"].rsplit("/", 1)[1], r["page_index"]): (r["page"], r["text"], r["status"]) for r in files.pages(found).collect()}
    assert got[("a.txt", 0)] == (1, "first", "OK") and got[("a.txt", 1)] == (2, "second", "OK")
    assert got[("b.md", 0)] == (None, "just one", "OK")
    assert got[("c.docx", 0)][1] == "Title & more\npara one\npara two"
    assert got[("d.docx", 0)][2].startswith("ERROR")
    cache = str(tmp_path / "cache")
    first = files.pages_cached(spark, found, cache).count()
    assert files.pages_cached(spark, found, cache).count() == first == 4


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A & B", "text")], "label string, body string")
    sinks.write_sections(df, str(tmp_path / "s"), "label", "body")
    assert spark.read.text(str(tmp_path / "s")).collect()[0]["value"] == "text"
    empty = sinks.manifest(df.limit(0).withColumnRenamed("label", "section"))
    sinks.write_table(empty.coalesce(1), str(tmp_path / "m"), "csv")
    assert empty.columns == sinks.MANIFEST
    assert sinks.with_docx(df, "label", "body").collect()[0]["docx"][:2] == b"PK"


def test_stream(spark, tmp_path):
    schema = "paragraph_id string, report_id string, paragraph_text string, ingested_at timestamp"
    rows = spark.sql("select * from values ('p1','r','one two',timestamp'2024-01-01'),('p1','r','one two',timestamp'2024-01-02'),('p2','r','three',timestamp'2024-01-02') as t(paragraph_id, report_id, paragraph_text, ingested_at)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.page_stream(spark, str(tmp_path / "in"), schema)
    ingest.quality_stream(stream, "paragraph_text", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["paragraph_id"], r["word_count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("p1", 2), ("p2", 1)]


def test_research_plan(spark):
    pages = spark.createDataFrame([("r", 1, "Industry Overview\nText here. More of it.", "NATIVE", "native"), ("r", 2, "Last page.", "REVIEW", "ocr"), ("r", 9, "outside", "NATIVE", "native")], "report_id string, page int, text string, quality_decision string, text_source string")
    ranges = spark.createDataFrame([("r", 1, 2)], "report_id string, start_page int, end_page int")
    plan = pipeline.research(pages, ranges)
    assert plan.paragraphs.count() == 3 and plan.sentences.count() == 3 and plan.review_queue.count() == 1
    assert plan.coverage.collect()[0]["status"] == "REVIEW"


def test_empty_pages(spark):
    none = spark.createDataFrame([], "report_id string, page int, text string")
    assert units.paragraphs(none, "report_id", "page", "text").count() == 0
