"""Operators on small frames with known results, ties, nulls and empty tables."""

from pyspark.sql import functions as F

from foliomill.operators import lines, metadata, quality, search, sections, units

PAGES = "report_id string, page int, text string"


def test_clean_pages_drops_what_comes_back_at_the_edges(spark):
    rows = [("r", i, f"Acme Annual Report\nBody of page {i} stands here.\nMore text\nAcme Annual Report") for i in range(5)]
    df = spark.createDataFrame(rows, PAGES)
    got = {r["page"]: r for r in lines.clean_pages(df, "report_id", "page", "text").collect()}
    assert all(r["clean_text"].startswith("Body of page") and r["lines_dropped"] == 3 for r in got.values())


def test_single_page_is_left_alone(spark):
    df = spark.createDataFrame([("r", 1, "Acme Annual Report\nBody"), ("s", 1, None)], PAGES)
    got = {r["report_id"]: r["clean_text"] for r in lines.clean_pages(df, "report_id", "page", "text").collect()}
    assert got == {"r": "Acme Annual Report\nBody", "s": ""}


def test_windows_and_context(spark):
    l = spark.createDataFrame([("a", i, x) for i, x in enumerate("pqr", 1)], "k string, line_no int, line string")
    got = {(r["line_no"], r["width"]): r["window"] for r in lines.line_windows(l, ["k"], 2).collect()}
    assert got == {(1, 1): "p", (1, 2): "p q", (2, 1): "q", (2, 2): "q r", (3, 1): "r"}
    assert [r["context"] for r in lines.line_context(l, ["k"], 1, 1).orderBy("line_no").collect()] == ["p q", "p q r", "q r"]


def test_multiset_difference_counts_repeats(spark):
    s = "k string, line_no int, line string"
    a = spark.createDataFrame([("a", i, "x") for i in range(3)] + [("a", 9, "y")], s)
    b = spark.createDataFrame([("a", 1, "x")], s)
    assert sorted(r["line"] for r in lines.multiset_minus(a, b, ["k"]).collect()) == ["x", "x", "y"]


def test_next_boundary_is_strictly_later(spark):
    n = spark.createDataFrame([("r", 1, True), ("r", 2, False), ("r", 3, True), ("q", 1, False)], "g string, o int, hard boolean")
    got = {(r["g"], r["o"]): r["next_o"] for r in sections.next_boundary(n, "g", ["o"], F.col("hard"), ["o"]).collect()}
    assert got == {("r", 1): 3, ("r", 2): 3, ("r", 3): None, ("q", 1): None}


def test_packaging_guard(spark):
    rows = [
        ("a", "Directors' Report", 27, 45), ("a", "Business Responsibility Report (BRR)", 29, 45), ("a", "Risk Management", 29, 45), ("a", "Corporate Social Responsibility", 31, 45), ("a", "Management Discussion & Analysis", 62, 76),
        ("a", "Human Resources & Talent", 76, 76), ("b", "Business Responsibility & Sustainability Report (BRSR)", 130, 171), ("b", "Sustainability Report", 130, 171), ("c", "Risk Management", None, 3),
    ]
    df = spark.createDataFrame(rows, "report_id string, canonical_category string, start_page int, end_page int")
    kept = {(r["report_id"], r["canonical_category"]) for r in sections.packaging_guard(df).where("action = 'KEEP'").collect()}
    assert kept == {("a", "Directors' Report"), ("a", "Corporate Social Responsibility"), ("a", "Management Discussion & Analysis"), ("b", "Business Responsibility & Sustainability Report (BRSR)"), ("c", "Risk Management")}
    manual = sections.packaging_guard(df, manual=F.col("canonical_category") == "Risk Management").where("action <> 'KEEP' and canonical_category = 'Risk Management'")
    assert manual.count() == 0


def test_nearest_takes_the_smaller_of_equals(spark):
    a = spark.createDataFrame([("r", 10), ("r", 100)], "k string, x int")
    b = spark.createDataFrame([("r", 8), ("r", 12), ("r", 50)], "k string, y int")
    assert [(r["x"], r["nearest_y"], r["gap"]) for r in sections.nearest(a, b, "k", "x", "y", 5).collect()] == [(10, 8, 2)]


def test_merge_keeps_the_better_of_neighbours(spark):
    rows = [("r", 1, 1, "Risk Management", 50, False), ("r", 1, 2, "Risk Managment", 70, True), ("r", 1, 9, "Outlook", 10, None), ("r", 2, 1, "Risk Management", 5, False)]
    df = spark.createDataFrame(rows, "report_id string, page int, line_no int, t string, score int, generic boolean")
    got = sorted((r["page"], r["line_no"]) for r in sections.merge_nodes(df, "report_id", "page", "line_no", "t", "score", "generic").collect())
    assert got == [(1, 1), (1, 9), (2, 1)]


def test_payloads_keep_order(spark):
    s = spark.createDataFrame([("r", 1, 2)], "report_id string, start_page int, end_page int")
    u = spark.createDataFrame([("r", 2, "b", "two"), ("r", 1, "a", "one"), ("r", 3, "c", "three")], "report_id string, page int, id string, t string")
    r = sections.payloads(s, u, "report_id", "page", "id", "t").collect()
    assert [(x["units"], x["section_text"]) for x in r] == [(2, "one\ntwo")]


def fold(text):
    """The paragraph rules once more, line by line."""
    from foliomill.functions.text import BULLET
    import re

    out, buf = [], []
    for line in [re.sub(r"\s+", " ", x).strip() for x in text.split("\n") if x.strip()]:
        if re.match(BULLET, line):
            out += [" ".join(buf)] if buf else []
            out.append(line)
            buf = []
            continue
        if buf and re.search(r"[.!?]$", buf[-1]) and len(re.findall(r"\w+", " ".join(buf))) >= 90:
            out.append(" ".join(buf))
            buf = []
        buf.append(line)
    return out + ([" ".join(buf)] if buf else [])


def test_paragraph_fold(spark):
    long = "\n".join("this line has exactly ten words in it for counting." for _ in range(25))
    texts = [long, "first line\n• a bullet\nafter it", "", "one"]
    df = spark.createDataFrame([(f"r{i}", 1, t) for i, t in enumerate(texts)], PAGES)
    rows = units.paragraphs(df, "report_id", "page", "text").orderBy("paragraph_id").collect()
    for i, t in enumerate(texts):
        assert [r["paragraph_text"] for r in rows if r["report_id"] == f"r{i}"] == fold(t)
    assert [r["boundary_reason"] for r in rows if r["report_id"] == "r0"] == ["long_unit_sentence_boundary"] * 2 + ["page_end"]


def test_paragraph_sections_run_over_pages(spark):
    df = spark.createDataFrame([("r", 1, "Industry Overview\ntext here"), ("r", 2, "more text"), ("r", 3, "OUTLOOK")], PAGES)
    got = [(r["paragraph_id"], r["section"], r["unit_type"]) for r in units.paragraphs(df, "report_id", "page", "text").orderBy("paragraph_id").collect()]
    assert got == [("r_MDA_P0001_PAR0001", "Industry Overview", "SECTION_HEADING"), ("r_MDA_P0001_PAR0002", "Industry Overview", "PARAGRAPH"), ("r_MDA_P0002_PAR0003", "Industry Overview", "PARAGRAPH"), ("r_MDA_P0003_PAR0004", "Outlook", "SECTION_HEADING")]
    p = {r["page"]: (r["section_at_page_start"], r["section_at_page_end"]) for r in units.page_sections(df, "report_id", "page", "text").collect()}
    assert p == {1: ("MDA - General", "Industry Overview"), 2: ("Industry Overview", "Industry Overview"), 3: ("Industry Overview", "Outlook")}


def test_coverage(spark):
    s = spark.createDataFrame([("a", 1, 3), ("b", 1, 3), ("c", 5, 6), ("d", None, None)], "report_id string, start_page int, end_page int")
    p = spark.createDataFrame([("a", 1, "NATIVE"), ("a", 2, "OCR"), ("a", 3, "NATIVE"), ("b", 1, "REVIEW"), ("b", 3, "NATIVE")], "report_id string, page int, quality_decision string")
    got = {r["report_id"]: (r["status"], r["continuity_gaps"], r["quality_review_pages"]) for r in units.coverage(p, s).collect()}
    assert got == {"a": ("PASS", "", ""), "b": ("REVIEW", "1->3", "1"), "c": ("REVIEW", "", ""), "d": ("MDA_NOT_FOUND", "", "")}


def test_quality_choice(spark):
    good, garbled = "word " * 40, "wordâ€™ " * 40
    rows = [(1, garbled, good), (2, garbled, "word " * 20), (3, good, good), (4, "x", "word " * 9), (5, None, None)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    reasons = quality.screening_reasons(F.col("a"), F.lit(None).cast("string"))
    got = {r["i"]: r["d"] for r in df.select("i", quality.choose_text(F.col("a"), F.col("b"), reasons).alias("d")).collect()}
    assert got == {1: "OCR", 2: "REVIEW", 3: "NATIVE", 4: "OCR", 5: "REVIEW"}


def test_fiscal_year(spark):
    rows = [
        ("a", ["Annual Report 2019-20"]), ("b", ["for the year ended 31 March, 2018"]), ("c", ["1999 and 2012/2013 here"]), ("x 2010-11", [""]), ("x 2009", [None]), ("none", [None, ""]), ("FY first", ["FY 2015-16", "Annual report: 2018-2019"]),
        ("often", ["Since 2018-19 much changed: 2019-20, 2019/2020 and 2019 – 20."]), ("tie", ["2011-12, 2012-13, 2012-13, 2011-12"]), ("late", ["plain"] * 12 + ["NOTICE of the financial year 2013-14", "Annual Report 2003-04"]), ("far", ["plain"] * 12 + ["2013-14"]),
        ("never", ["plain"] * 61 + ["Annual Report 2003-04"]), ("odd", ["2018-19999 or x2017-18"]),
    ]
    df = spark.createDataFrame([(r, i, t) for r, texts in rows for i, t in enumerate(texts, 1)], PAGES)
    got = {r["report_id"]: (r["year"], r["confidence"]) for r in metadata.fiscal_year(df, "report_id", "page", "text").collect()}
    none = ("Year not detected", "none")
    assert got == {"a": ("2019-20", "high"), "b": ("2017-18", "high"), "c": ("2012-13", "medium"), "x 2010-11": ("2010-11", "medium"), "x 2009": ("2009", "low"), "none": none, "FY first": ("2018-19", "high"), "often": ("2019-20", "medium"), "tie": ("2011-12", "medium"),
                   "late": ("2003-04", "high"), "far": none, "never": none, "odd": none}


def test_company(spark):
    rows = [
        ("a", 1, "Name of the Company: Acme Mills Limited\nRegistered office at Alby"), ("a", 2, "Statutory auditor\nBig Four Auditors Private Limited\nauditor and banker"), ("a", 3, "Acme Mills Ltd. grew\nAcme Mills Limited again"),
        ("b", 1, "For Zeta Pumps Limited"), ("b", 9, "the subsidiary Zeta Pumps Holdings Limited"), ("c", 1, None), ("d", 1, "no name here"),
    ]
    df = spark.createDataFrame(rows, PAGES)
    got = {r["report_id"]: (r["company"], r["score"], r["pages"]) for r in metadata.company(df, "report_id", "page", "text").collect()}
    assert got["a"] == ("Acme Mills Limited", (5 + 75 + 18 + 45 + 18 + 8) + 2 * (5 + 10) + 6 * 2 + 12, 2) and got["b"] == ("Zeta Pumps Limited", 5 + 18 + 16 + 6, 1) and set(got) == {"a", "b"}
    m = {r["report_id"]: (r["company"], r["year"]) for r in metadata.metadata(df, "report_id", "page", "text").collect()}
    assert m["a"] == ("Acme Mills", "Year not detected") and m["d"][0] == "d"


def test_search(spark):
    df = spark.createDataFrame([(1, "aXbxc"), (2, None), (3, "none")], "i int, t string")
    assert [(r["i"], r["at"]) for r in search.snippets(df, ["i"], "t", "X").collect()] == [(1, 2), (1, 4)]
    assert search.snippets(df, ["i"], "t", "  ").count() == 0
