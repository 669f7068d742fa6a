"""The SQL twin of each query, written for DuckDB on the same tables. Pieces of SQL text stand for the scalar functions."""

from __future__ import annotations

#: Fixed values, stated here once more, so that the SQL takes none from what it checks.
_WORD = r"[\p{L}\p{N}_]+"
_MOJIBAKE = "Ã|Â|â€|ƒ|œ|ž|�"
_BULLET = r"^\s*(?:[•●▪◦‣·\-–—]|\(?[a-zA-Z0-9]{1,4}[.)])\s+"
_NUMBERING = r"^\s*(?:section\s+)?(?:\d+(?:\.\d+)*|[ivxlcdm]+)[.)\-:]?\s+"
_ABBREVIATIONS = ("mr.", "mrs.", "ms.", "dr.", "rs.", "no.", "nos.", "fig.", "figs.", "approx.", "etc.", "e.g.", "i.e.", "fy.", "q1.", "q2.", "q3.", "q4.", "ltd.", "inc.", "co.", "vs.")
_NO_HEADING = (
    "na", "nil", "yes", "no", "and", "or", "on", "in", "for", "the", "a", "an", "sr", "it", "we", "share", "capital", "rate", "age", "financial", "statement", "statements", "total", "particulars", "note", "notes",
)
_NOISY_STARTS = ("section a", "section b", "section c", "principle ", "note ", "notes ", "sr no", "sr. no", "particulars", "question ", "table ", "figure ", "amount in", "(`", "(%", "source:", "source ", "page ")
_SUBSECTIONS = (
    ("Economic Environment", ("economic overview", "economic environment", "global economy", "indian economy", "macroeconomic")),
    ("Industry Overview", ("industry overview", "industry scenario", "industry outlook", "market overview", "industry trends")),
    ("Business Overview", ("business overview", "business review", "business model")),
    ("Business Performance", ("business performance", "operational performance", "operating performance")),
    ("Financial Performance", ("financial performance", "financial review", "financial highlights", "results of operations")),
    ("Risk & Risk Management", ("risk management", "risks and concerns", "principal risks", "key risks")),
    ("Internal Controls", ("internal controls?", "internal financial controls?", "internal audit")),
    ("Human Capital", ("human resources", "human capital", "employee engagement", "people and culture")),
    ("Outlook", ("outlook", "business outlook", "future outlook", "way forward")),
)
_RULES = (
    ("Management Discussion & Analysis", "HIGH", "MDA_CORE", r"\bmanagement('s)? (discussion|review) (and|&) analysis\b|\bmanagement analysis (and|&) (discussion|review)\b|\b(discussion|analysis) (and|&) (analysis|discussion) (by|of) management\b|\bmd ?& ?a\b"),
    ("Management Discussion & Analysis", "MEDIUM", "MDA_VARIANT", r"\boperating (and|&) financial review\b|\bfinancial (and|&) operating review\b|\bmanagement (discussion|review)\b|\bdiscussion of management\b|\bmanagement commentary\b"),
    ("Management Discussion & Analysis", "MEDIUM", "AMBIGUOUS_BUSINESS_REVIEW", r"^business review( and outlook)?$"),
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

_WS = r"[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+"
_UNITS = "(SELECT DISTINCT * EXCLUDE (ingested_at) FROM mda_paragraph_level)"
_HEADS = "(SELECT DISTINCT * EXCLUDE (ingested_at) FROM semantic_heading_manifest)"
_RES = "(SELECT DISTINCT * EXCLUDE (ingested_at) FROM research_manifest)"
_PAGES = "(SELECT report_id, doc_id, text FROM documents WHERE report_id IS NOT NULL)"


def _q(s: str) -> str:
    return s.replace("'", "''")


def _count(x: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{_q(pattern)}')) AS INTEGER)"


def _txt(x: str) -> str:
    return f"coalesce({x}, '')"


def _norm(x: str) -> str:
    return f"trim(regexp_replace({_txt(x)}, '{_WS}', ' ', 'g'))"


def _compact(x: str) -> str:
    return f"regexp_replace(lower({_txt(x)}), '[^a-z0-9]+', '', 'g')"


def _semantic(x: str) -> str:
    low = f"replace(lower({_norm(x)}), '’', '''')"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({low}, '[_\\-/]+', ' ', 'g'), '[^a-z0-9&'' ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _lines(source: str, keys: str, text: str) -> str:
    """The numbered non-blank lines of each row of a source."""
    return f"""(SELECT {keys}, CAST(n AS INTEGER) AS line_no, l[n] AS line FROM (SELECT {keys}, l, unnest(range(1, len(l) + 1)) AS n
        FROM (SELECT {keys}, list_filter(list_transform(string_split({text}, chr(10)), lambda x: {_norm('x')}), lambda x: x <> '') AS l FROM {source} WHERE {text} IS NOT NULL)))"""


def _words(x: str) -> str:
    return _count(_txt(x), _WORD)


def _alpha(x: str) -> str:
    solid = f"length(regexp_replace({_txt(x)}, '{_WS}', '', 'g'))"
    return f"(CASE WHEN {solid} > 0 THEN {_count(_txt(x), chr(92) + 'p{L}')} / {solid} ELSE 0.0 END)"


def _repl(x: str) -> str:
    return f"CAST(length({_txt(x)}) - length(replace({_txt(x)}, '�', '')) AS INTEGER)"


def _per(n: str, x: str) -> str:
    return f"(CASE WHEN length({_txt(x)}) > 0 THEN {n} / length({_txt(x)}) ELSE 0.0 END)"


def _reasons(x: str, method: str) -> str:
    moj, repl = _per(_count(_txt(x), _MOJIBAKE), x), _per(_repl(x), x)
    ends = f"regexp_replace({_txt(x)}, '^{_WS}|{_WS}$', '', 'g')"
    parts = (
        ("VERY_LOW_TEXT", f"length({ends}) < 40"), ("MOJIBAKE_SIGNAL", f"{moj} >= 0.0015"), ("REPLACEMENT_CHARACTER_SIGNAL", f"{repl} >= 0.0005"),
        ("LOW_ALPHA_WITH_CORRUPTION_SIGNAL", f"{_words(x)} >= 30 AND {_alpha(x)} < 0.12 AND ({moj} > 0 OR {repl} > 0)"), ("PRODUCTION_OCR_PAGE", f"coalesce({method} = 'ocr', false)"),
    )
    return "list_filter([" + ", ".join(f"CASE WHEN {on} THEN '{n}' END" for n, on in parts) + "], lambda x: x IS NOT NULL)"


def _title(x: str) -> str:
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    return rf"(regexp_matches({x}, '[\p{{Lu}}\p{{Lt}}]') AND NOT regexp_matches({x}, '[{cased}][\p{{Lu}}\p{{Lt}}]') AND NOT regexp_matches({x}, '(^|[^{cased}])\p{{Ll}}'))"


def _headingish(x: str) -> str:
    n = f"{_norm(x)}"
    letters, caps, words = _count(n, r"\p{L}"), _count(n, r"\p{Lu}"), _words(n)
    return f"""(length({n}) BETWEEN 1 AND 160 AND {words} <= 16 AND NOT (regexp_matches({n}, '[.?!]$') AND {words} > 5)
        AND ({_title(n)} OR ({letters} > 0 AND {caps} * 100 >= {letters} * 65) OR regexp_matches(lower({n}), '{_NUMBERING}')))"""


def _subsection(x: str) -> str:
    bare = f"regexp_replace(lower({_norm(x)}), '{_NUMBERING}', '')"
    whens = " ".join(f"WHEN regexp_matches({bare}, '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(names)})($|[^\\p{{L}}\\p{{N}}_])') THEN '{_q(label)}'" for label, names in _SUBSECTIONS)
    return f"(CASE WHEN {_headingish(x)} THEN CASE {whens} END END)"


def _heading_like(x: str) -> str:
    n = _norm(x)
    bare = f"regexp_replace(lower({n}), '^[ :–—-]+|[ :–—-]+$', '', 'g')"
    noisy = " OR ".join(f"starts_with({bare}, '{s}')" for s in _NOISY_STARTS)
    none = ", ".join(f"'{w}'" for w in _NO_HEADING)
    words = _count(n, "[A-Za-z][A-Za-z&'’/-]*")
    return f"""(length({n}) BETWEEN 2 AND 150 AND {words} BETWEEN 1 AND 18 AND NOT regexp_matches(lower({n}), '^\\(?[a-z]{{1,3}}\\)?[.)]?$') AND {_compact(n)} NOT IN ({none})
        AND NOT regexp_matches({n}, '[.;,]$') AND NOT ({noisy}) AND {_count(n, '[0-9]')} <= greatest(6.0, length({n}) * 0.25))"""


def _classify() -> str:
    whens = "\n".join(f"WHEN regexp_matches(clean, '{_q(p)}') THEN '{_q(c)}~{k}~{m}'" for c, k, m, p in _RULES)
    has = lambda *w: " AND ".join(f"list_contains(tok, '{x}')" for x in w)
    return f"""WITH h AS (SELECT heading_id, {_norm('original_heading')} AS raw, {_semantic('original_heading')} AS clean FROM {_HEADS}),
t AS (SELECT *, list_distinct(regexp_extract_all(clean, '[a-z]+')) AS tok FROM h),
r AS (SELECT heading_id, raw, CASE WHEN clean = '' THEN CASE WHEN raw = '' THEN 'Unclassified' ELSE raw END || '~LOW~EMPTY_OR_UNKNOWN'
 WHEN regexp_matches(clean, '\\bfinancial risk management\\b') THEN raw || '~LOW~FINANCIAL_NOTE_NOT_ENTERPRISE_RISK'
 WHEN len(tok) <= 12 AND ({has('management', 'discussion', 'analysis')} OR {has('management', 'review', 'analysis')}) THEN 'Management Discussion & Analysis~HIGH~MDA_TOKEN_SET'
 {whens} ELSE raw || '~LOW~GENERIC_STRUCTURAL' END AS c FROM t)
SELECT heading_id, regexp_replace(c, '~[A-Z]+~[A-Z_]+$', '') AS canonical_category, regexp_extract(c, '~([A-Z]+)~[A-Z_]+$', 1) AS confidence, regexp_extract(c, '~([A-Z_]+)$', 1) AS match_type FROM r"""


def _sentences() -> str:
    x = _norm("paragraph_text")
    for a in _ABBREVIATIONS:
        x = f"regexp_replace({x}, '{a.replace('.', chr(92) + '.')}', '{a.replace('.', '<prd>')}', 'gi')"
    # figures with several points need the second pass, as a match takes the figure after the point
    for _ in range(2):
        x = f"regexp_replace({x}, '(\\d)\\.(\\d)', '\\1<prd>\\2', 'g')"
    for _ in range(2):
        x = f"regexp_replace({x}, '([.!?])\\s+([A-Z0-9₹(])', '\\1' || chr(1) || '\\2', 'g')"
    return f"""WITH s AS (SELECT paragraph_id, list_filter(list_transform(string_split({x}, chr(1)), lambda p: trim(replace(p, '<prd>', '.'))), lambda p: p <> '') AS l FROM {_UNITS} WHERE unit_type <> 'SECTION_HEADING'),
e AS (SELECT paragraph_id, l, unnest(range(1, len(l) + 1)) AS n FROM s)
SELECT paragraph_id || '_S' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS sentence_id, paragraph_id, CAST(n AS INTEGER) AS sentence_number, l[n] AS sentence_text FROM e"""


_PARTPAGES = f"(SELECT report_id, paragraph_id AS doc_id, paragraph_text AS text FROM {_UNITS} WHERE unit_type <> 'SECTION_HEADING')"


def _edge(depth: int = 7) -> str:
    return f"""l AS (SELECT report_id, doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_norm('x')}), lambda x: x <> '') AS l FROM {_PARTPAGES} WHERE text IS NOT NULL),
x AS (SELECT DISTINCT report_id, doc_id, unnest(list_concat(l[1:{depth}], l[greatest(len(l) - {depth - 1}, 1):len(l)])) AS line FROM l),
n AS (SELECT report_id, count(*) AS n FROM {_PARTPAGES} GROUP BY ALL),
e AS (SELECT report_id, line, count(*) AS pages, CAST(greatest(3, floor(any_value(n) * 0.2)) AS INTEGER) AS needed FROM x JOIN n USING (report_id)
      WHERE length(line) BETWEEN 5 AND 140 AND {_count('line', '[A-Za-z]+')} >= 2 AND n > 1 GROUP BY report_id, line HAVING count(*) >= greatest(3, floor(any_value(n) * 0.2)))"""


_PRIO = "CASE canonical_category WHEN 'Business Responsibility & Sustainability Report (BRSR)' THEN 4 WHEN 'Business Responsibility Report (BRR)' THEN 3 WHEN 'ESG Report' THEN 2 WHEN 'Sustainability Report' THEN 1 END"
_LIST = lambda xs: ", ".join(f"'{_q(x)}'" for x in xs)
_PARTS = {
    "n_chars": "CAST(length({x}) AS INTEGER)", "unprintable": _count("{x}", r"[\x00-\x08\x0B-\x1F\x7F-\x9F\x{{E000}}-\x{{F8FF}}]"), "n_letters": _count("{x}", r"\p{{L}}"),
    "bad": _count("{x}", r"[�\x{{E000}}-\x{{F8FF}}]"), "odd": _count("{x}", r"[\x{{180}}-\x{{24F}}]{{2,}}|[\x00-\x08\x0B\x0C\x0E-\x1F]"),
}

ORACLE: dict[str, str] = {
    "page_metrics": f"""SELECT doc_id, {_words('text')} AS word_count, {_count(_txt('text'), chr(92) + 'p{L}')} AS letters, CAST(length(regexp_replace({_txt('text')}, '{_WS}', '', 'g')) AS INTEGER) AS solid_chars,
        {_count(_txt('text'), _MOJIBAKE)} AS mojibake_count, {_repl('text')} AS replacement_count, sha256({_txt('text')}) AS text_sha256 FROM documents""",
    "quality_screen": f"SELECT paragraph_id, array_to_string({_reasons('paragraph_text', 'text_source')}, '|') AS reasons FROM {_UNITS}",
    "quality_choice": f"""WITH u AS (SELECT paragraph_id, paragraph_text AS b, lead(paragraph_text) OVER (PARTITION BY report_id ORDER BY paragraph_id) AS o, text_source FROM {_UNITS}),
m AS (SELECT paragraph_id, {_words('b')} AS bw, {_words('o')} AS ow, {_per(_count(_txt('b'), _MOJIBAKE), 'b')} AS bm, {_per(_count(_txt('o'), _MOJIBAKE), 'o')} AS om, {_alpha('b')} AS ba, {_alpha('o')} AS oa, {_reasons('b', 'text_source')} AS r FROM u),
k AS (SELECT *, bm >= 0.0015 AND om <= greatest(0.0002, bm * 0.25) AS better, CASE WHEN bw > 0 THEN ow / bw ELSE 0.0 END AS kept FROM m)
SELECT paragraph_id, CASE WHEN bw <= 3 AND ow >= 8 THEN 'OCR' WHEN bw > 0 AND better AND kept >= 0.7 THEN 'OCR' WHEN bw > 0 AND better AND kept >= 0.45 THEN 'REVIEW'
 WHEN bw > 0 AND oa >= ba + 0.08 AND kept >= 0.85 AND list_contains(r, 'VERY_LOW_TEXT') THEN 'OCR' WHEN len(r) = 0 THEN 'NATIVE' ELSE 'REVIEW' END AS decision FROM k""",
    "quality_summary": """SELECT report_id, count(*) AS pages, count(*) FILTER (decision = 'NATIVE') AS native_pages, count(*) FILTER (decision = 'OCR') AS ocr_pages, count(*) FILTER (decision = 'REVIEW') AS review_pages
        FROM (SELECT DISTINCT report_id, page, decision FROM page_quality_manifest) GROUP BY report_id""",
    "norm_compact": f"""SELECT heading_id, {_norm('original_heading')} AS norm, {_compact('original_heading')} AS compact, {_semantic('original_heading')} AS semantic,
        coalesce(nullif(trim(regexp_replace({_txt('original_heading')}, '[^A-Za-z0-9._-]+', '_', 'g'), '_'), ''), 'report') AS folder, trim(regexp_replace({_txt('original_heading')}, '[^A-Za-z0-9]+', '_', 'g'), '_') AS label FROM {_HEADS}""",
    "heading_lines": f"SELECT * FROM {_lines(_PAGES, 'report_id, doc_id', 'text')} WHERE {_heading_like('line')}",
    "headingish_lines": f"SELECT * FROM {_lines(_PAGES, 'report_id, doc_id', 'text')} WHERE {_headingish('line')}",
    "bullet_lines": f"SELECT * FROM {_lines(_UNITS, 'paragraph_id', 'paragraph_text')} WHERE regexp_matches(line, '{_BULLET}')",
    "subsection_labels": f"SELECT paragraph_id, {_subsection('paragraph_text')} AS label FROM {_UNITS} WHERE unit_type = 'SECTION_HEADING'",
    "edge_lines": f"WITH {_edge()} SELECT report_id, line, pages, needed FROM e",
    "clean_text": f"""WITH {_edge()}, a AS (SELECT report_id, doc_id, list_filter(list_transform(string_split({_txt('text')}, chr(10)), lambda x: {_norm('x')}), lambda x: x <> '') AS l FROM {_PARTPAGES}),
p AS (SELECT report_id, doc_id, l, unnest(CASE WHEN len(l) > 0 THEN range(1, len(l) + 1) ELSE [0] END) AS i FROM a),
k AS (SELECT p.report_id, doc_id, i, l[i] AS line, len(l) AS n, e.line IS NOT NULL AND (i <= 7 OR i > len(l) - 7) AS dropped FROM p LEFT JOIN e ON e.report_id = p.report_id AND e.line = l[i])
SELECT report_id, doc_id AS paragraph_id, CAST(count(*) FILTER (dropped) AS INTEGER) AS lines_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped AND i > 0), '')) AS clean_sha256 FROM k GROUP BY report_id, doc_id""",
    "line_windows": f"""WITH l AS {_lines(_PAGES, 'doc_id', 'text')} SELECT a.doc_id, a.line_no, CAST(w.width AS INTEGER) AS width, string_agg(b.line, ' ' ORDER BY b.line_no) AS "window"
        FROM l a JOIN (SELECT unnest(range(1, 6)) AS width) w ON true JOIN l b ON a.doc_id = b.doc_id AND b.line_no BETWEEN a.line_no AND a.line_no + w.width - 1
        GROUP BY a.doc_id, a.line_no, w.width HAVING count(*) = w.width""",
    "line_context": f"SELECT doc_id, line_no, line, string_agg(line, ' ') OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS context FROM {_lines(_PAGES, 'doc_id', 'text')}",
    "multiset_minus": f"""WITH l AS (SELECT report_id, paragraph_id, line_no AS n, line, row_number() OVER (PARTITION BY report_id ORDER BY paragraph_id, line_no) AS k FROM {_lines(_UNITS, 'report_id, paragraph_id', 'paragraph_text')}),
a AS (SELECT *, row_number() OVER (PARTITION BY report_id, line ORDER BY k) AS nth FROM l), b AS (SELECT report_id, line, row_number() OVER (PARTITION BY report_id, line ORDER BY k) AS nth FROM l WHERE k % 2 = 0)
SELECT report_id, paragraph_id, n, line FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.report_id = a.report_id AND b.line = a.line AND b.nth = a.nth)""",
    "semantic_classify": _classify(),
    "semantic_best": f"""SELECT report_id, canonical_category, heading_id, confidence, score FROM {_HEADS} WHERE canonical_category IS NOT NULL AND report_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY report_id, canonical_category ORDER BY CASE confidence WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END DESC, coalesce(CAST(hard_boundary AS INTEGER), 0) DESC, coalesce(score, -1) DESC, heading_id) = 1""",
    "fiscal_year": r"""WITH d AS (SELECT report_id, coalesce(text, '') AS t, row_number() OVER (PARTITION BY report_id ORDER BY doc_id) AS k FROM documents WHERE report_id IS NOT NULL),
f AS (SELECT report_id, coalesce(string_agg(t, chr(10) ORDER BY k) FILTER (k <= 10), '') AS early, coalesce(string_agg(t, chr(10) ORDER BY k) FILTER (k <= 10 OR regexp_matches(t, '(?i)notice|auditors?''s report|auditors'' report|annual report')), '') AS prior FROM d WHERE k <= 60 GROUP BY report_id),
c AS (SELECT report_id, early, prior,
 regexp_extract_all(regexp_replace(early, '([^\p{L}\p{N}_])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])20[0-9]{2}[\s\x{A0}]*(?:--|––|——|//|_)[\s\x{A0}]*[0-9]{2,4}(?:$|[^\p{L}\p{N}_])') AS pairs,
 regexp_extract_all(prior, '(?i)for[\s\x{A0}]+the[\s\x{A0}]+(?:financial[\s\x{A0}]+)?year[\s\x{A0}]+ended[\s\x{A0}]+(?:on[\s\x{A0}]+)?31(?:st)?[\s\x{A0}]+march[,]?[\s\x{A0}]*(20[0-9]{2})', 1) AS m1,
 regexp_extract_all(prior, '(?i)year[\s\x{A0}]+ended[\s\x{A0}]+(?:on[\s\x{A0}]+)?(?:march[\s\x{A0}]+31|31(?:st)?[\s\x{A0}]+march)[, ]+[\s\x{A0}]*(20[0-9]{2})', 1) AS m2 FROM f),
p AS (SELECT report_id, unnest(pairs) AS x, unnest(range(1, len(pairs) + 1)) AS i FROM c),
q AS (SELECT report_id, i, regexp_extract(x, '(20[0-9]{2})', 1) || '-' || right(regexp_extract(x, '([0-9]+)[^0-9]*$', 1), 2) AS y FROM p),
o AS (SELECT report_id, arg_max(y, n * 1000000 - first) AS often FROM (SELECT report_id, y, count(*) AS n, min(i) AS first FROM q GROUP BY ALL) GROUP BY report_id),
g AS (SELECT c.*, often,
 regexp_extract(early, '(?i)(?:integrated[\s\x{A0}]+)?annual[\s\x{A0}]+report(?:[\s\x{A0}]*&[\s\x{A0}]*accounts)?(?:[\s\x{A0}]+for[\s\x{A0}]+the[\s\x{A0}]+year)?[\s\x{A0}]*[:\-]?[\s\x{A0}]*(20[0-9]{2})[\s\x{A0}]*[-–—/][\s\x{A0}]*(20[0-9]{2}|[0-9]{2})', ['a', 'b']) AS e1,
 regexp_extract(early, '(?i)\bFY[\s\x{A0}]*[:\-]?[\s\x{A0}]*(20[0-9]{2})[\s\x{A0}]*[-–—/][\s\x{A0}]*(20[0-9]{2}|[0-9]{2})', ['a', 'b']) AS e2,
 regexp_extract(early, '(?i)financial[\s\x{A0}]+year(?:[\s\x{A0}]+reported|[\s\x{A0}]+for[\s\x{A0}]+which[\s\x{A0}]+reporting[\s\x{A0}]+is[\s\x{A0}]+being[\s\x{A0}]+done)?[\s\x{A0}]*[:\-]?[\s\x{A0}]*(20[0-9]{2})[\s\x{A0}]*[-–—/][\s\x{A0}]*(20[0-9]{2}|[0-9]{2})', ['a', 'b']) AS e3,
 regexp_extract(prior, '(?i)(?:integrated[\s\x{A0}]+)?annual[\s\x{A0}]+report(?:[\s\x{A0}]*&[\s\x{A0}]*accounts)?(?:[\s\x{A0}]+for[\s\x{A0}]+the[\s\x{A0}]+year)?[\s\x{A0}]*[:\-]?[\s\x{A0}]*(20[0-9]{2})[\s\x{A0}]*[-–—/][\s\x{A0}]*(20[0-9]{2}|[0-9]{2})', ['a', 'b']) AS p1,
 regexp_extract(prior, '(?i)\bFY[\s\x{A0}]*[:\-]?[\s\x{A0}]*(20[0-9]{2})[\s\x{A0}]*[-–—/][\s\x{A0}]*(20[0-9]{2}|[0-9]{2})', ['a', 'b']) AS p2,
 regexp_extract(prior, '(?i)financial[\s\x{A0}]+year(?:[\s\x{A0}]+reported|[\s\x{A0}]+for[\s\x{A0}]+which[\s\x{A0}]+reporting[\s\x{A0}]+is[\s\x{A0}]+being[\s\x{A0}]+done)?[\s\x{A0}]*[:\-]?[\s\x{A0}]*(20[0-9]{2})[\s\x{A0}]*[-–—/][\s\x{A0}]*(20[0-9]{2}|[0-9]{2})', ['a', 'b']) AS p3
 FROM c LEFT JOIN o USING (report_id)),
y AS (SELECT report_id, often, CASE WHEN e1.a <> '' THEN e1 WHEN e2.a <> '' THEN e2 WHEN e3.a <> '' THEN e3 WHEN p1.a <> '' THEN p1 WHEN p2.a <> '' THEN p2 WHEN p3.a <> '' THEN p3 END AS r, CASE WHEN len(m1) > 0 THEN m1[1] WHEN len(m2) > 0 THEN m2[1] END AS m FROM g),
s AS (SELECT *, regexp_extract(report_id, '(?:^|[^\p{L}\p{N}_])(20[0-9]{2})(?:$|[^\p{L}\p{N}_])', 1) AS own FROM y)
SELECT report_id, CASE WHEN r IS NOT NULL THEN r.a || '-' || right(r.b, 2) WHEN m IS NOT NULL THEN CAST(CAST(m AS INTEGER) - 1 AS VARCHAR) || '-' || right(m, 2) WHEN often IS NOT NULL THEN often WHEN own <> '' THEN own ELSE 'Year not detected' END AS year,
 CASE WHEN r IS NOT NULL OR m IS NOT NULL THEN 'high' WHEN often IS NOT NULL THEN 'medium' WHEN own <> '' THEN 'low' ELSE 'none' END AS confidence FROM s""",
    "text_quality": "WITH p AS (SELECT paragraph_id, " + ", ".join(v.format(x=_txt("paragraph_text")) + f" AS {k}" for k, v in _PARTS.items()) + f""" FROM {_UNITS})
SELECT *, CASE WHEN n_chars = 0 THEN 0.0::DOUBLE WHEN n_letters = 0 THEN (n_chars - unprintable) / greatest(1, n_chars) * 0.35::DOUBLE
 ELSE (n_chars - unprintable) / greatest(1, n_chars) * (1 - least(1.0::DOUBLE, (bad * 4 + odd * 6) / greatest(1, n_letters))) END AS quality FROM p""",
    "nearest_page": f"""WITH h AS (SELECT DISTINCT report_id, heading_id, pdf_page FROM {_HEADS} WHERE pdf_page IS NOT NULL), r AS (SELECT DISTINCT report_id, start_page FROM research_manifest WHERE start_page IS NOT NULL)
SELECT h.report_id, heading_id, pdf_page, start_page AS nearest_start_page, abs(pdf_page - start_page) AS gap FROM h JOIN r ON h.report_id = r.report_id AND abs(pdf_page - start_page) <= 18
QUALIFY row_number() OVER (PARTITION BY h.report_id, heading_id, pdf_page ORDER BY abs(pdf_page - start_page), start_page) = 1""",
    "next_boundary": f"""WITH h AS (SELECT DISTINCT report_id, heading_id, pdf_page, hard_boundary, generic FROM {_HEADS} WHERE report_id IS NOT NULL AND pdf_page IS NOT NULL),
j AS (SELECT a.*, b.heading_id AS next_heading_id, b.pdf_page AS next_pdf_page, row_number() OVER (PARTITION BY a.report_id, a.heading_id ORDER BY b.pdf_page, b.heading_id) AS k
 FROM h a LEFT JOIN h b ON a.report_id = b.report_id AND (b.pdf_page, b.heading_id) > (a.pdf_page, a.heading_id) AND (coalesce(b.hard_boundary, false) OR NOT coalesce(b.generic, true)))
SELECT * EXCLUDE (k) FROM j WHERE k = 1""",
    "packaging_guard": f"""WITH r AS (SELECT DISTINCT report_id, section, CASE canonical_category WHEN 'Business Responsibility & Sustainability Report' THEN 'Business Responsibility & Sustainability Report (BRSR)' WHEN 'Business Responsibility Report' THEN 'Business Responsibility Report (BRR)' ELSE canonical_category END AS canonical_category, start_page, end_page FROM research_manifest),
v AS (SELECT *, {_PRIO} AS prio, coalesce(start_page > 0 AND end_page >= start_page, false) AS ok FROM r),
h AS (SELECT * FROM v WHERE ok AND canonical_category IN ('Board''s Report', 'Directors'' Report', 'Management Discussion & Analysis')),
t AS (SELECT report_id, start_page, end_page, max(prio) AS top, arg_max(canonical_category, prio) AS foremost FROM v WHERE ok AND prio IS NOT NULL GROUP BY ALL),
n AS (SELECT v.report_id, v.canonical_category, v.start_page, v.end_page, arg_min(h.canonical_category, (h.start_page, h.canonical_category)) AS holder FROM v JOIN h ON h.report_id = v.report_id AND h.canonical_category <> v.canonical_category AND h.start_page <= v.start_page AND v.end_page <= h.end_page GROUP BY ALL),
e AS (SELECT v.report_id, v.canonical_category, v.start_page, v.end_page, min(h.canonical_category) AS closing FROM v JOIN h ON h.report_id = v.report_id AND h.canonical_category <> 'Management Discussion & Analysis' AND h.start_page <= v.start_page AND v.end_page = h.end_page GROUP BY ALL),
x AS (SELECT v.report_id, section, v.canonical_category, v.start_page, v.end_page, CASE WHEN NOT ok THEN NULL WHEN prio < top THEN 'DUPLICATE_RANGE_OF_' || foremost
 WHEN v.canonical_category IN ('Risk Management', 'Human Resources & Talent', 'Cybersecurity & IT Governance') AND holder IS NOT NULL THEN 'NESTED_SUBSECTION_OF_' || holder
 WHEN prio IS NOT NULL AND closing IS NOT NULL THEN 'REFERENCE_OR_SUBHEADING_INSIDE_' || closing END AS reason
 FROM v LEFT JOIN t ON t.report_id = v.report_id AND t.start_page = v.start_page AND t.end_page = v.end_page LEFT JOIN n ON n.report_id = v.report_id AND n.canonical_category = v.canonical_category AND n.start_page = v.start_page AND n.end_page = v.end_page
 LEFT JOIN e ON e.report_id = v.report_id AND e.canonical_category = v.canonical_category AND e.start_page = v.start_page AND e.end_page = v.end_page)
SELECT *, CASE WHEN reason IS NULL THEN 'KEEP' ELSE 'SUPPRESSED_STANDALONE' END AS action FROM x""",
    "payload_ranges": f"""WITH r AS (SELECT DISTINCT report_id, section, start_page, end_page FROM research_manifest WHERE report_id IS NOT NULL AND start_page <= end_page)
SELECT r.report_id, r.section, start_page, end_page, count(*) AS units, sha256(string_agg(paragraph_text, chr(10) ORDER BY paragraph_id, paragraph_text)) AS section_sha256
FROM r JOIN {_UNITS} u ON u.report_id = r.report_id AND u.page BETWEEN start_page AND end_page WHERE paragraph_text IS NOT NULL GROUP BY ALL""",
    "subsection_ffill": f"""WITH l AS (SELECT *, {_subsection('line')} AS label FROM {_lines(_PAGES, 'report_id, doc_id', 'text')}), f AS (SELECT * FROM l WHERE label IS NOT NULL),
h AS (SELECT report_id, doc_id, string_agg(label, '|' ORDER BY first) AS heads FROM (SELECT report_id, doc_id, label, min(line_no) AS first FROM f GROUP BY ALL) GROUP BY ALL), e AS (SELECT report_id, doc_id, arg_max(label, line_no) AS last FROM f GROUP BY ALL),
p AS (SELECT p.report_id, p.doc_id, heads, last FROM {_PAGES} p LEFT JOIN h USING (report_id, doc_id) LEFT JOIN e USING (report_id, doc_id)),
s AS (SELECT *, coalesce(last_value(last IGNORE NULLS) OVER (PARTITION BY report_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'MDA - General') AS start FROM p)
SELECT report_id, doc_id, start AS section_at_page_start, coalesce(last, start) AS section_at_page_end, coalesce(heads, '') AS subsection_headings_on_page FROM s""",
    "sentences": _sentences(),
    "review_queue": f"SELECT paragraph_id, review_flag, page FROM {_UNITS} WHERE review_flag <> ''",
    "coverage_audit": """WITH r AS (SELECT DISTINCT report_id, start_page, end_page FROM research_manifest WHERE report_id IS NOT NULL), p AS (SELECT DISTINCT report_id, page, decision FROM page_quality_manifest),
d AS (SELECT DISTINCT r.report_id, start_page, end_page, page FROM r JOIN p ON p.report_id = r.report_id AND page BETWEEN start_page AND end_page),
g AS (SELECT *, lead(page) OVER (PARTITION BY report_id, start_page, end_page ORDER BY page) AS nxt FROM d),
a AS (SELECT report_id, start_page, end_page, count(*) AS n, coalesce(string_agg(page || '->' || nxt, '|' ORDER BY page) FILTER (nxt <> page + 1), '') AS gaps FROM g GROUP BY ALL),
v AS (SELECT report_id, start_page, end_page, string_agg(page, '|' ORDER BY page) AS rev FROM (SELECT DISTINCT r.report_id, start_page, end_page, page FROM r JOIN p ON p.report_id = r.report_id AND page BETWEEN start_page AND end_page WHERE decision = 'REVIEW') GROUP BY ALL),
f AS (SELECT r.*, coalesce(v.rev, '') AS quality_review_pages, CAST(CASE WHEN r.end_page >= r.start_page THEN r.end_page - r.start_page + 1 ELSE 0 END AS INTEGER) AS expected_page_count, CAST(coalesce(n, 0) AS INTEGER) AS actual_page_count, coalesce(gaps, '') AS continuity_gaps
 FROM r LEFT JOIN a ON a.report_id = r.report_id AND a.start_page IS NOT DISTINCT FROM r.start_page AND a.end_page IS NOT DISTINCT FROM r.end_page LEFT JOIN v ON v.report_id = r.report_id AND v.start_page = r.start_page AND v.end_page = r.end_page)
SELECT *, CASE WHEN start_page IS NULL THEN 'MDA_NOT_FOUND' WHEN continuity_gaps <> '' OR actual_page_count <> expected_page_count OR quality_review_pages <> '' OR actual_page_count = 0 THEN 'REVIEW' ELSE 'PASS' END AS status FROM f""",
    "search_snippets": """WITH RECURSIVE h AS (SELECT doc_id, text AS t, CAST(instr(lower(text), 'per cent') AS BIGINT) AS p FROM documents WHERE contains(lower(text), 'per cent')
 UNION ALL SELECT doc_id, t, p + 7 + instr(substr(lower(t), p + 8), 'per cent') AS p FROM h WHERE instr(substr(lower(t), p + 8), 'per cent') > 0)
SELECT doc_id, CAST(p AS INTEGER) AS "at", trim(regexp_replace(substr(t, greatest(p - 90, 1), p + 8 + 150 - greatest(p - 90, 1)), '\\s+', ' ', 'g')) AS snippet FROM h ORDER BY doc_id, p LIMIT 50""",
    "manifest_union": f"""WITH r AS {_RES}, f AS (SELECT company, year, source_file, 'Full Report' AS section, NULL AS original_heading, NULL AS canonical_category, NULL AS confidence, NULL AS match_type, min(start_page) AS start_page, max(end_page) AS end_page, NULL AS printed_start_page, NULL AS printed_end_page, NULL AS formats FROM r GROUP BY report_id, company, year, source_file),
u AS (SELECT company, year, source_file, section, original_heading, canonical_category, confidence, match_type, start_page, end_page, printed_start_page, printed_end_page, formats FROM r UNION ALL SELECT * FROM f)
SELECT """ + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in "company year source_file section original_heading canonical_category confidence match_type start_page end_page printed_start_page printed_end_page formats".split()) + " FROM u",
    "quality_join": f"""SELECT u.report_id, u.page, paragraph_id, quality_decision, q.decision, q.text_source AS page_source FROM {_UNITS} u LEFT JOIN (SELECT DISTINCT report_id, page, decision, text_source FROM page_quality_manifest) q ON q.report_id = u.report_id AND q.page = u.page""",
    "combined_sections": f"""WITH r AS (SELECT DISTINCT report_id, canonical_category, start_page, end_page FROM {_RES} WHERE canonical_category IN ('Chairman Message', 'CEO Message', 'Managing Director Message'))
SELECT report_id, 'Leadership Messages' AS label, min(start_page) AS start_page, max(end_page) AS end_page,
 string_agg(canonical_category || CASE WHEN start_page IS NULL AND end_page IS NULL THEN ':' ELSE ':' || concat_ws('-', start_page, end_page) END, '|' ORDER BY start_page NULLS FIRST, end_page NULLS FIRST, canonical_category) AS page_ranges FROM r GROUP BY report_id""",
    "page_gaps": """SELECT report_id, page, next_page FROM (SELECT report_id, page, lead(page) OVER (PARTITION BY report_id ORDER BY page) AS next_page FROM (SELECT DISTINCT report_id, page FROM page_quality_manifest WHERE report_id IS NOT NULL)) WHERE next_page > page + 1""",
    "annexure_ids": f"""SELECT heading_id, upper(x) AS annexure FROM (SELECT heading_id, regexp_extract({_norm('original_heading')}, '(?i)^\\W*annex(?:ure)?\\s*[-–—:]?\\s*([A-Z]|\\d+|[IVXLCDM]+)\\b', 1) AS x FROM {_HEADS}) WHERE x <> ''""",
}

#: The lines of the content units at regular places of their pages, as the query lays them out.
_LAYOUT = f"""l0 AS (SELECT report_id, page, paragraph_id, unit_type, coalesce(start_line, 0) AS s, string_split(paragraph_text, chr(10)) AS a FROM {_UNITS} WHERE report_id IS NOT NULL AND page IS NOT NULL AND paragraph_text IS NOT NULL),
l1 AS (SELECT report_id, page, paragraph_id, unit_type, s, unnest(a) AS text, unnest(range(1, len(a) + 1)) AS k FROM l0),
l AS (SELECT report_id, page, coalesce(unit_type = 'SECTION_HEADING', false) AS head, {_norm('text')} AS t, CAST(row_number() OVER (PARTITION BY report_id, page ORDER BY s, paragraph_id, k) - 1 AS INTEGER) AS i FROM l1 WHERE {_norm('text')} <> '')"""
ORACLE["folio_extract"] = f"""WITH {_LAYOUT},
n AS (SELECT report_id, page, i AS line_order, TRY_CAST(CASE WHEN (50 + 18 * i < 0.06 * 842 OR 65 + 18 * i > 0.94 * 842) AND regexp_matches(t, '^0*[0-9]{{1,4}}$') THEN regexp_extract(t, '^0*([0-9]{{1,4}})$', 1)
 WHEN length(t) <= 150 THEN regexp_extract(t, '(?:\\bI\\s+|\\|\\s*|\\s)0*([0-9]{{1,4}})\\s*$', 1) END AS INTEGER) AS number FROM l WHERE 50 + 18 * i < 0.12 * 842 OR 65 + 18 * i > 0.90 * 842)
SELECT * FROM n WHERE number BETWEEN 0 AND 1500 AND number NOT BETWEEN 1900 AND 2099"""
ORACLE["toc_nearest"] = f"""WITH {_LAYOUT}, n AS (SELECT report_id, page, i, TRY_CAST(regexp_extract(t, '^0*([0-9]{{1,4}})$', 1) AS INTEGER) AS number FROM l WHERE regexp_matches(t, '^0*[0-9]{{1,4}}$')),
m AS (SELECT * FROM n WHERE number BETWEEN 1 AND 1500 AND number NOT BETWEEN 1900 AND 2099)
SELECT l.report_id, l.page, l.i AS line_order, l.t AS title, m.number FROM l JOIN m ON m.report_id = l.report_id AND m.page = l.page AND abs(m.i - l.i) * 18 <= 18 WHERE {_heading_like('l.t')}
QUALIFY row_number() OVER (PARTITION BY l.report_id, l.page, l.i ORDER BY abs(m.i - l.i), m.number) = 1"""
ORACLE["annexure_anchors"] = f"""WITH {_LAYOUT}, c AS (SELECT *, {_compact('t')} AS c FROM l), h AS (SELECT unnest(['chairmansmessage', 'chairmansletter', 'letterfromthechairman', 'letterfromtheceo', 'managingdirectorsmessage', 'directorsreport', 'boardsreport', 'managementdiscussionandanalysis', 'managementdiscussionanalysis',
 'corporategovernancereport', 'corporatesocialresponsibility', 'businessresponsibilityreport', 'businessresponsibilityandsustainabilityreport', 'standalonefinancialstatements', 'consolidatedfinancialstatements', 'independentauditorsreport', 'clinicalgovernance', 'notice', 'gricontentindex']) AS h),
hits AS (SELECT report_id, page, count(*) AS hits FROM c JOIN h ON length(c) <= 90 AND (c = h OR contains(c, h) AND length(c) <= length(h) + 24) GROUP BY ALL),
toc AS (SELECT report_id, page FROM l LEFT JOIN hits USING (report_id, page) GROUP BY report_id, page HAVING bool_or(lower(t) IN ('content', 'contents', 'index') AND 57.5 + 18 * i < 0.35 * 842) OR max(coalesce(hits, 0)) >= 5 AND sum(len(regexp_extract_all(t, '[A-Za-z]+'))) <= 500),
a AS (SELECT report_id, page, i AS line_order, regexp_extract(replace(t, '’', ''''), '(?i)^\\s*annexure\\s*[-:]?\\s*([ivxlcdm]+|[0-9]{{1,3}}|[a-z])\\b', 1) AS annexure, t AS matched_text FROM l WHERE i < 40 AND NOT EXISTS (SELECT 1 FROM toc WHERE toc.report_id = l.report_id AND toc.page = l.page))
SELECT *, 'Annexure ' || upper(annexure) AS label FROM a WHERE annexure <> '' QUALIFY row_number() OVER (PARTITION BY report_id, page ORDER BY line_order) = 1"""
ORACLE["alias_hits"] = f"""WITH {_LAYOUT},
v0 AS (SELECT category_code AS label, alias_id, 0 AS f, replace(trim(regexp_replace(alias_text, '\\s+', ' ', 'g')), '’', '''') AS v FROM heading_alias_ref WHERE category_code IS NOT NULL),
v1 AS (SELECT * FROM v0 UNION ALL SELECT label, alias_id, 1, trim(regexp_replace(v, '\\s*\\([^)]*\\)\\s*', ' ', 'g')) FROM v0 UNION ALL SELECT label, alias_id, 2, replace(v, '&', 'and') FROM v0 UNION ALL SELECT label, alias_id, 3, regexp_replace(v, '(?i)\\band\\b', '&', 'g') FROM v0),
v AS (SELECT label, v AS alias, {_compact('v')} AS target FROM v1 WHERE {_compact('v')} <> '' QUALIFY row_number() OVER (PARTITION BY label, {_compact('v')} ORDER BY alias_id, f) = 1),
r AS (SELECT a.report_id, a.page, a.i, w.w, string_agg(b.t, ' ' ORDER BY b.i) AS run, max(CASE WHEN b.head THEN 14 ELSE 12 END) AS size, bool_or(b.head) AS head FROM l a JOIN (SELECT unnest(range(1, 6)) AS w) w ON true JOIN l b ON b.report_id = a.report_id AND b.page = a.page AND b.i BETWEEN a.i AND a.i + w.w - 1 GROUP BY ALL HAVING count(*) = w.w),
s AS (SELECT report_id, page, list_sort(list(CASE WHEN head THEN 14 ELSE 12 END)) AS z FROM l GROUP BY ALL), body AS (SELECT report_id, page, z[len(z) // 2 + 1] AS body FROM s),
c AS (SELECT r.*, {_compact('run')} AS c, body FROM r JOIN body USING (report_id, page)),
h AS (SELECT c.*, label, alias, CASE WHEN c = target THEN 48 ELSE 42 END + CASE WHEN c = target AND target IN ('boardsreport', 'directorsreport', 'directorsreporttotheshareholders') THEN 15 ELSE 0 END + CASE WHEN head THEN 18 ELSE 0 END
 + CASE WHEN contains(c, 'annexure') AND length(c) - length(target) <= 45 THEN 8 ELSE 0 END + CASE WHEN size - body >= 3 THEN 14 WHEN size - body >= 1.5 THEN 8 ELSE 0 END
 + CASE WHEN (50 + 18 * i) / 842 < 0.18 THEN 8 WHEN (50 + 18 * i) / 842 < 0.35 THEN 4 ELSE 0 END + CASE WHEN length(regexp_replace(run, '[^A-Za-z]+', '', 'g')) >= 8 AND upper(run) = run THEN 3 ELSE 0 END AS score
 FROM c JOIN v ON contains(c, target) AND (length(c) - length(target) <= 30 OR contains(c, 'annexure') AND length(c) - length(target) <= 45) WHERE NOT (target = 'corporatesocialresponsibility' AND contains(c, 'committee')))
SELECT report_id, page, label, alias, i AS line_order, CAST(i + w - 1 AS INTEGER) AS line_end, run AS matched_text, CAST(score AS INTEGER) AS score FROM h QUALIFY row_number() OVER (PARTITION BY report_id, page, label, alias, i ORDER BY score DESC, w) = 1"""
_NAME = r"([A-Z][A-Za-z0-9&.,''()\-/ ]{2,110}?(?:Private\s+Limited|Limited|Ltd\.?))\b"
_EXPLICIT = r"(?i)(?:name\s+of\s+(?:the\s+)?(?:company|listed\s+entity)|company\s+name)\s*[:\-–—]*\s*([A-Z][A-Za-z0-9&.,''()\-/ ]{2,120}?(?:Private\s+Limited|Limited|Ltd\.?))\b"
_LEAD = r"(?i)^(?:name\s+of\s+(?:the\s+)?(?:company|listed\s+entity)|listed\s+entity|company\s+name|for\s+and\s+on\s+behalf\s+of|for)\s*[:\-–—]*\s*"
_BARE = "^[ ,.|:-]+|[ ,.|:-]+$"
_PLUS = (("integrated annual report", 26), ("annual report", 20), ("annual general meeting", 24), ("registered office", 18), ("corporate identity number", 30), ("cin", 18), ("name of the company", 45), ("name of the listed entity", 55), ("listed entity", 20), ("the company", 8))
_MINUS = (
    "registrar", "share transfer agent", "transfer agent", "registrar and transfer agent", "statutory auditor", "secretarial auditor", "internal auditor", "cost auditor", "auditor", "chartered accountants", "banker", "depository",
    "trustee", "assurance provider", "verification provider", "scrutinizer", "legal counsel", "subsidiary", "associate company", "joint venture", "step-down subsidiary", "stock exchange", "exchange plaza", "nominee director",
)
ORACLE["company_score"] = f"""WITH u AS (SELECT * FROM {_UNITS} WHERE report_id IS NOT NULL AND page IS NOT NULL),
g AS (SELECT report_id, page, row_number() OVER (PARTITION BY report_id ORDER BY page) AS k FROM (SELECT DISTINCT report_id, page FROM u)),
l AS (SELECT *, string_agg(line, ' ') OVER (PARTITION BY report_id, page ORDER BY paragraph_id, line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS ctx FROM {_lines('u', 'report_id, page, paragraph_id', 'paragraph_text')} JOIN g USING (report_id, page) WHERE k <= 60),
c AS (SELECT *, replace(lower(ctx), '’', '''') AS low, regexp_extract(line, '{_EXPLICIT}', 1) AS ex, regexp_extract_all(line, '{_NAME}', 1) AS names FROM l WHERE regexp_matches(line, 'Limited|Ltd')),
d AS (SELECT *, CASE WHEN ex <> '' THEN list_prepend(ex, names) ELSE names END AS a FROM c), n AS (SELECT * EXCLUDE (a), unnest(a) AS raw, unnest(range(1, len(a) + 1)) AS o FROM d),
m AS (SELECT *, o = 1 AND ex <> '' AS formal, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\\s+', ' ', 'g'), '{_BARE}', '', 'g'), '{_LEAD}', ''), '{_BARE}', '', 'g') AS name FROM n),
k AS (SELECT *, regexp_replace(regexp_replace(lower(name), '\\b(?:private\\s+limited|limited|ltd\\.?)', '', 'g'), '[^a-z0-9]+', '', 'g') AS key FROM m),
h AS (SELECT *, 5 + CASE WHEN formal THEN 75 ELSE 0 END + CASE WHEN page <= 2 THEN 18 WHEN page <= 5 THEN 10 WHEN page <= 10 THEN 4 ELSE 0 END + least(100, {" + ".join(f"CASE WHEN contains(low, '{t}') THEN {v} ELSE 0 END" for t, v in _PLUS)})
 - least(260, 55 * ({" + ".join(f"CAST(contains(low, '{t}') AS INTEGER)" for t in _MINUS)})) + CASE WHEN contains(lower(ctx), 'for ' || lower(name)) THEN 16 ELSE 0 END AS pts FROM k WHERE length(key) >= 4 QUALIFY row_number() OVER (PARTITION BY report_id, page, paragraph_id, line_no, key ORDER BY o) = 1),
b AS (SELECT report_id, key, sum(pts) + least(150, 6 * count(DISTINCT page)) + least(60, 12 * count(*) FILTER (formal)) AS s, count(DISTINCT page) AS pages FROM h GROUP BY ALL),
w AS (SELECT report_id, key, name FROM (SELECT report_id, key, name, count(*) AS n FROM h GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY report_id, key ORDER BY n DESC, length(name) DESC, name DESC) = 1),
s AS (SELECT b.report_id, b.key, pages, s - CASE WHEN EXISTS (SELECT 1 FROM b o WHERE o.report_id = b.report_id AND length(o.key) - length(b.key) >= 4 AND contains(o.key, b.key) AND o.pages >= greatest(2, b.pages // 2)) THEN 40 ELSE 0 END AS score FROM b)
SELECT s.report_id, name AS company, CAST(score AS BIGINT) AS score, CAST(pages AS INTEGER) AS pages FROM s JOIN w USING (report_id, key) QUALIFY row_number() OVER (PARTITION BY s.report_id ORDER BY score DESC, pages DESC, length(key) DESC, key DESC) = 1"""
