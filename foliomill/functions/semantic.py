"""Classifying headings into canonical categories by ordered rules, as one CASE expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm_line, semantic_clean

_MDA = "Management Discussion & Analysis"
#: Category, confidence, match type and pattern, in the order in which they are tried.
RULES = (
    (_MDA, "HIGH", "MDA_CORE", r"\bmanagement('s)? (discussion|review) (and|&) analysis\b|\bmanagement analysis (and|&) (discussion|review)\b|\b(discussion|analysis) (and|&) (analysis|discussion) (by|of) management\b|\bmd ?& ?a\b"),
    (_MDA, "MEDIUM", "MDA_VARIANT", r"\boperating (and|&) financial review\b|\bfinancial (and|&) operating review\b|\bmanagement (discussion|review)\b|\bdiscussion of management\b|\bmanagement commentary\b"),
    (_MDA, "MEDIUM", "AMBIGUOUS_BUSINESS_REVIEW", r"^business review( and outlook)?$"),
    ("Board's Report", "HIGH", "BOARD_REPORT", r"\bboard'?s report\b|\breport of the board( of directors)?\b|\bboard of directors'? report\b"),
    ("Directors' Report", "HIGH", "DIRECTORS_REPORT", r"\bdirectors?'? report\b|\breport of (the )?directors\b"),
    ("Corporate Governance Report", "HIGH", "CORPORATE_GOVERNANCE", r"\bcorporate governance( report)?\b|\breport on corporate governance\b"),
    ("Business Responsibility & Sustainability Report (BRSR)", "HIGH", "BRSR", r"\bbusiness responsibility (and|&) sustainability( report(ing)?)?\b|\bbrsr\b"),
    ("Business Responsibility Report (BRR)", "HIGH", "BRR", r"\bbusiness responsibility report\b|\bbrr\b"),
    ("ESG Report", "HIGH", "ESG", r"\besg (report|review|disclosures?)\b|\benvironment(al)? social (and|&) governance report\b"),
    ("Sustainability Report", "HIGH", "SUSTAINABILITY", r"\bsustainability (report|review|disclosures?)\b|\bintegrated and sustainability report\b"),
    ("Corporate Social Responsibility", "HIGH", "CSR", r"\bcorporate social responsibility( (report|activities))?\b|\bcsr (report|activities)\b"),
    ("Independent Auditor's Report", "HIGH", "AUDITOR", r"\bindependent auditors?'? report\b|\bstatutory auditors?'? report\b|\breport of (the )?independent auditors?\b"),
    ("Standalone Financial Statements", "HIGH", "STANDALONE_FINANCIALS", r"\bstandalone financial statements\b|\bstandalone financials\b"),
    ("Consolidated Financial Statements", "HIGH", "CONSOLIDATED_FINANCIALS", r"\bconsolidated financial statements\b|\bconsolidated financials\b"),
    ("Financial Statements", "MEDIUM", "FINANCIAL_STATEMENTS", r"^financial statements$|^financials$"),
    ("Risk Management", "HIGH", "RISK_MANAGEMENT", r"^risk management( report)?$|\benterprise risk management\b|^risk report$"),
    ("Cybersecurity & IT Governance", "HIGH", "CYBERSECURITY", r"\bcyber ?security\b|\binformation security\b"),
    ("Cybersecurity & IT Governance", "MEDIUM", "IT_GOVERNANCE", r"^it governance$|\binformation technology governance\b"),
    ("Human Resources & Talent", "HIGH", "HUMAN_RESOURCES", r"\bhuman resources?\b"),
    ("Human Resources & Talent", "MEDIUM", "PEOPLE_TALENT", r"^people (and|&) (culture|talent)$|^talent management$|^human capital$"),
    ("Chairman Message", "HIGH", "CHAIRMAN_MESSAGE", r"\b(message|letter|statement) from the (executive )?chair(man|person)\b|\bchair(man|person)'?s (message|letter|statement)\b"),
    ("CEO Message", "HIGH", "CEO_MESSAGE", r"\b(message|letter) from the (chief executive officer|ceo)\b|\bceo'?s (message|letter)\b"),
    ("Managing Director Message", "HIGH", "MD_MESSAGE", r"\b(message|letter) from the managing director\b|\bmanaging director'?s (message|letter)\b"),
)
#: Labels a structural graph may already carry, that stand for themselves or for a longer category.
GRAPH_LABELS = {c: c for c in dict.fromkeys(r[0] for r in RULES) if c != "Financial Statements"} | {
    "BRSR": "Business Responsibility & Sustainability Report (BRSR)", "BRR": "Business Responsibility Report (BRR)", "About Company": "About Company", "Board of Directors": "Board of Directors",
    "Management Team": "Management Team", "Performance Highlights": "Performance Highlights", "Awards": "Awards", "Notice": "Notice", "GRI Index": "GRI Index", "Clinical Governance": "Clinical Governance",
}


def _result(category: Column, confidence: str, match: str) -> Column:
    return F.struct(category.alias("canonical_category"), F.lit(confidence).alias("confidence"), F.lit(match).alias("match_type"))


def classify(heading: Column, graph_label: Column | None = None) -> Column:
    """struct(canonical_category, confidence, match_type); a heading that no rule knows keeps its own text, LOW."""
    raw = norm_line(heading)
    clean = semantic_clean(heading)
    tokens = F.array_distinct(F.regexp_extract_all(clean, F.lit("[a-z]+"), F.lit(0)))

    def holds(*words: str) -> Column:
        return F.size(F.array_intersect(tokens, F.array(*map(F.lit, words)))) == len(words)

    out = _result(raw, "LOW", "GENERIC_STRUCTURAL")
    for category, confidence, match, pattern in reversed(RULES):
        out = F.when(clean.rlike(pattern), _result(F.lit(category), confidence, match)).otherwise(out)
    token_set = (holds("management", "discussion", "analysis") | holds("management", "review", "analysis")) & (F.size(tokens) <= 12)
    out = F.when(token_set, _result(F.lit(_MDA), "HIGH", "MDA_TOKEN_SET")).otherwise(out)
    out = F.when(clean.rlike(r"\bfinancial risk management\b"), _result(raw, "LOW", "FINANCIAL_NOTE_NOT_ENTERPRISE_RISK")).otherwise(out)
    out = F.when(clean == "", _result(F.when(raw == "", "Unclassified").otherwise(raw), "LOW", "EMPTY_OR_UNKNOWN")).otherwise(out)
    if graph_label is not None:
        known = F.create_map(*[F.lit(x) for pair in GRAPH_LABELS.items() for x in pair])
        out = F.when(known[graph_label].isNotNull(), _result(known[graph_label], "HIGH", "GRAPH_CANONICAL")).otherwise(out)
    return out
