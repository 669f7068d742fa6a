"""Section ranges before and after repair, on small reports of known layout."""

import pytest
from pyspark.sql import functions as F

from foliomill.operators import anchors, repair, sections

TOP = {"size": 20.0, "font": "Corp-Bold", "bold": True, "bbox": [50, 70, 300, 95]}
STYLE = {"size": 18.0, "font": "Helvetica-Bold", "bold": True, "bbox": [55, 70, 400, 92]}


def header(text, bbox, **more):
    return {"text": text, "layout_class": "section-header", "bbox": bbox, "bold": True, **more}


def bare(title, size):
    return [header(title, [42, 79, 260, 91], size=None, font=None), {"text": "body", "layout_class": "text", "bbox": [42, 140, 520, 300], "size": None},
            {"text": title, "layout_class": "folio-edge", "bbox": [42.5, 76.6, 260, 91.8], "size": size, "font": "Adani-SemiBold", "bold": True}]


#: Pages, sections before, ranges after, and a reason of the audit.
CASES = {
    "statutory annexure": (
        [["Directors' Report"], ["Corporate Social Responsibility", "The CSR report is annexed as Annexure II."], ["Directors report body"], ["More directors report body"], ["Annexure II", "Annual Report on CSR Activities1", "CSR content"],
         ["CSR content continues"], ["Annexure III", "Form MGT-9"], ["Directors report appendix"]],
        [("Directors' Report", 1, 8, None), (repair.CSR, 2, 4, None)], {repair.CSR: (5, 6)}, "CSR_ANNEXURE_INSIDE_Directors' Report"),
    "same style peer": (
        [["Intro"], [{**STYLE, "text": "Corporate social responsibility"}, "CSR body"], ["CSR body continues"], [{**STYLE, "text": "Responsible supply chain"}, "Supply-chain body"], ["Supply-chain body continues"],
         [{**STYLE, "text": "Corporate governance"}, "Governance body"]],
        [(repair.CSR, 2, 6, "Corporate social responsibility")], {repair.CSR: (2, 3)}, "STRONG_PEER_Responsible supply chain"),
    "wrapper after the title": (
        [["Directors' Report"], ["Corporate Social Responsibility", "CSR is set out in Annexure II"], ["Directors body"], ["Directors body"],
         [header("Annual Report on CSR Activities<sup>1</sup>", [288, 57, 432, 67], size=None), {"text": "CSR content", "bbox": [36, 82, 500, 120]}, {"text": "Annexure II", "layout_class": "folio-edge", "bbox": [645, 36, 684, 44], "size": 8.0}],
         ["CSR content continues"], [{"text": "Annexure III", "layout_class": "folio-edge", "bbox": [643, 39, 684, 48], "size": 8.0}, "Form MGT-9"]],
        [("Directors' Report", 1, 7, None), (repair.CSR, 2, 4, None)], {repair.CSR: (5, 6)}, None),
    "style of a second line": (
        [["Intro"], bare("Corporate social responsibility", 12.0), bare("Expenditure in CSR Focus Areas in FY 2024-25", 10.0), bare("Focus Area – Community Development", 11.0), bare("Responsible supply chain", 12.0), ["Supply chain continues"]],
        [(repair.CSR, 2, 6, "Corporate social responsibility")], {repair.CSR: (2, 4)}, "STRONG_PEER_Responsible supply chain"),
    "auditor's report": (
        [["Business Responsibility Report"], ["BRR body"], ["BRR body"], [header("Independent Auditor’s Report", [50, 70, 330, 92]), "Audit body"], ["Financial statements"]],
        [("Business Responsibility Report (BRR)", 1, 5, "Business Responsibility Report")], {"Business Responsibility Report (BRR)": (1, 3)}, "STRONG_TOP_LEVEL_Independent Auditor's Report"),
    "leadership": (
        [[header("Chairman’s Message", [50, 70, 300, 95], size=None, font=None), {**TOP, "text": "Chairman’s Message", "layout_class": "folio-edge"}, "Chairman body"], ["Chairman continuation"],
         [header("Chief Executive’s Review", [50, 70, 320, 95], size=None, font=None), {**TOP, "text": "Chief Executive’s Review", "layout_class": "folio-edge"}, "CEO body"], ["CEO continuation"],
         [{**TOP, "text": "Operating Environment", "layout_class": "folio-edge"}, "Next chapter"]],
        [("Chairman Message", 1, 5, "Chairman’s Message")], {"Chairman Message": (1, 2), "CEO Message": (3, 4)}, "Chief Executive’s Review"),
    "awards": (
        [[header("Corporate Social Responsibility", [50, 70, 330, 92], size=20.0, font="Corp-Bold"), {"text": "CSR body", "layout_class": "text", "bbox": [50, 140, 500, 300], "size": None, "font": None}],
         [{"text": "CSR continuation", "layout_class": "text", "bbox": [50, 80, 500, 300], "size": None, "font": None}], [header("Awards and Recognitions", [50, 80, 250, 100], size=18.0, font="Corp-Bold"), "Awards body"], ["Board of Directors"]],
        [(repair.CSR, 1, 3, None)], {repair.CSR: (1, 2)}, "STRONG_TOP_LEVEL_Awards and Recognitions"),
    "plain prefix and page before": (
        [["Corporate governance body"], ["Earlier content", "BUSINESS RESPONSIBILITY REPORT", "Section A: General Information about the Company"], ["BRR body"], ["BRR body"],
         ["78 Independent Auditor’s Report", "To the Members of Example Limited", "Audit body"], ["Audit continuation"]],
        [("Business Responsibility Report (BRR)", 3, 6, "BUSINESS RESPONSIBILITY REPORT")], {"Business Responsibility Report (BRR)": (2, 4)}, "PAGE_PREFIX_Independent Auditor's Report"),
    "mention in the body": (
        [["Business Responsibility Report"], ["BRR body", "The independent auditor's report is available elsewhere."], ["BRR body continues"], ["Independent Auditor's Report", "To the Members", "Audit body"]],
        [("Business Responsibility Report (BRR)", 1, 4, "Business Responsibility Report")], {"Business Responsibility Report (BRR)": (1, 3)}, None),
}


def line_rows(report, pages):
    out = []
    for n, page in enumerate(pages, 1):
        for i, x in enumerate(page):
            x = {"text": x} if isinstance(x, str) else x
            b = [float(v) for v in x.get("bbox", [50, 50 + i * 18, 500, 65 + i * 18])]
            out.append((report, n, i, x["text"], *b, x.get("size", 12.0), x.get("font", "Helvetica"), x.get("bold", False), x.get("layout_class"), 595.0, 842.0))
    return out


@pytest.fixture(scope="module")
def repaired(spark):
    lines = [r for name, (pages, *_) in CASES.items() for r in line_rows(name, pages)]
    before = [(name, label, a, b, "MANUAL_OVERRIDE" if manual else "GRAPH", heading or label) for name, (_, some, *_) in CASES.items() for label, a, b, heading in some for manual in (False,)]
    before += [("manual", repair.CSR, 1, 3, "MANUAL_OVERRIDE", repair.CSR), ("none", "ESG Report", None, None, None, None)]
    lines += line_rows("manual", CASES["awards"][0])
    s, a = repair.repair(spark.createDataFrame(before, repair.SECTIONS), spark.createDataFrame(lines, anchors.LINES))
    ranges, reasons = {}, {}
    for r in s.collect():
        assert (r["report_id"], r["label"]) not in ranges
        ranges[r["report_id"], r["label"]] = r["start_page"], r["end_page"]
    for r in a.collect():
        reasons.setdefault(r["report_id"], set()).add(r["reason"])
    return ranges, reasons


@pytest.mark.parametrize("name", CASES)
def test_repair(repaired, name):
    ranges, reasons = repaired
    _, before, after, reason = CASES[name]
    for label, want in after.items():
        assert ranges[name, label] == want
    for label, a, b, _ in before:
        assert label in after or ranges[name, label] == (a, b)
    assert reason is None or reason in reasons[name]


def test_manual_and_empty_sections_stay(repaired):
    ranges, reasons = repaired
    assert ranges["manual", repair.CSR] == (1, 3) and "manual" not in reasons and ranges["none", "ESG Report"] == (None, None)


def test_risk_card_and_reasons(spark):
    rows = [("a", "Cybersecurity & IT Governance", 41, 41, "Cyber Security Risk\nRisk Description\nImpact on Value\nMitigating Measure\nCapital at Risk"), ("b", "Cybersecurity & IT Governance", 41, 41, "Risk Description"),
            ("c", "Business Responsibility & Sustainability Report (BRSR)", 130, 171, ""), ("c", "Sustainability Report", 130, 171, ""), ("d", "Management Discussion & Analysis", 10, 20, ""), ("d", "Risk Management", 15, 16, None),
            ("e", "Board's Report", 1, 9, None), ("e", "ESG Report", 4, 9, None), ("e", "Sustainability Report", 4, 8, None), ("f", "Board's Report", 0, 9, None), ("f", "ESG Report", 4, 9, None)]
    df = spark.createDataFrame(rows, "report_id string, canonical_category string, start_page int, end_page int, t string")
    got = {(r["report_id"], r["canonical_category"]): r["reason"] for r in sections.packaging_guard(df, text=F.col("t")).where("action <> 'KEEP'").collect()}
    assert got == {("a", "Cybersecurity & IT Governance"): "RISK_REGISTER_CARD_NOT_PEER_REPORT", ("c", "Sustainability Report"): "DUPLICATE_RANGE_OF_Business Responsibility & Sustainability Report (BRSR)",
                   ("d", "Risk Management"): "NESTED_SUBSECTION_OF_Management Discussion & Analysis", ("e", "ESG Report"): "REFERENCE_OR_SUBHEADING_INSIDE_Board's Report"}


def page(report, n, rows, width=595.0):
    return [(report, n, i, t, *map(float, b), s, "F", False, c, width, 842.0) for i, (t, b, s, c) in enumerate(rows)]


def test_anchors_by_contents_and_folios(spark):
    lines = page("r", 1, [("Contents", [50, 60, 200, 80], 14.0, None), ("Risk Management", [50, 100, 300, 115], 10.0, None), ("57", [400, 101, 420, 116], 10.0, None), ("12 Corporate Governance Report", [50, 130, 300, 145], 10.0, None), ("Notice 90", [50, 160, 300, 175], 10.0, None)])
    lines += page("r", 2, [("Risk Management", [50, 300, 300, 320], 10.0, None), ("is one of many tasks", [50, 330, 300, 345], 10.0, None), ("56", [290, 820, 300, 835], 8.0, None)])
    lines += page("r", 3, [("RISK", [50, 60, 300, 80], 18.0, "title"), ("MANAGEMENT", [50, 85, 300, 105], 18.0, "title"), ("Body text of the page", [50, 330, 300, 345], 10.0, None), ("Acme Limited | 57", [290, 820, 300, 835], 8.0, None)])
    lines += page("r", 4, [("Annexure II", [50, 60, 300, 80], 12.0, None), ("Annual report on corporate social responsibility", [50, 90, 300, 110], 12.0, None), ("58", [10, 820, 30, 835], 8.0, None), ("59", [1150, 820, 1170, 835], 8.0, None)], 1190.0)
    df = spark.createDataFrame(lines, anchors.LINES)
    specs = [("Risk", ["risk management"]), ("CSR", ["corporate social responsibility"])]
    assert {(r["page"], r["number"]) for r in anchors.edge_folios(df).collect()} == {(2, 56), (3, 57), (4, 58), (4, 59)}
    assert [(r["report_id"], r["page"]) for r in anchors.two_up(df).collect()] == [("r", 4)]
    assert {(r["title"], r["printed_page"]) for r in anchors.contents_entries(df).collect()} == {("Risk Management", 57), ("Corporate Governance Report", 12), ("Notice", 90)}
    assert {(r["label"], r["contents_page"]) for r in anchors.contents_page_of(df, specs).collect()} == {("Risk", 57)}
    got = {r["label"]: r for r in anchors.section_anchors(df, specs).collect()}
    assert (got["Risk"]["page"], got["Risk"]["line_order"], got["Risk"]["line_end"], got["Risk"]["printed_page"]) == (3, 0, 1, 57)
    assert got["Risk"]["score"] == 48 + 22 + 18 + 8 + 3 + 45
    assert [(r["page"], r["annexure"], r["label"]) for r in anchors.annexure_anchors(df, specs).collect()] == [(4, "II", "CSR")]
    assert anchors.variants(["Management Discussion & Analysis (MD&A)", None]) == ["Management Discussion & Analysis (MD&A)", "Management Discussion & Analysis", "Management Discussion and Analysis (MDandA)"]
    assert anchors.body_font(df).first()["body_size"] == 11.0 and anchors.body_font(df.where("page = 2")).first()["body_size"] == 9.0
    assert anchors.section_anchors(df.limit(0), specs).count() == 0
