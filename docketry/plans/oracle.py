"""The registered queries once more, as plain SQL for DuckDB.

Written apart from the operators: set-wise where they work in the row, by brute
force where they use a shortcut. Only word lists, patterns and messages are
shared.
"""

from __future__ import annotations

from docketry.functions import fixed_values as V
from docketry.functions.recognizers import RECOGNIZERS
from docketry.plans.views import TABLES, VIEWS, references

SQL_VIEWS: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def q(text: str) -> str:
    """A literal; braces are doubled because the SQL is a format string."""
    return "'" + text.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'"


def oracle(name: str, sql: str) -> None:
    """Register a query with the views it needs in front, as a WITH list."""
    needed: list[str] = []

    def visit(view: str) -> None:
        if view in TABLES or view in needed:
            return
        for dependency in references(_view(view)):
            visit(dependency)
        needed.append(view)

    for view in references(sql):
        visit(view)
    names = {n: n for n in [*TABLES, *VIEWS, *SQL_VIEWS]}
    # As views may hold doubled braces, each is formatted exactly once.
    ctes = ",\n".join(f"{n} AS ({_view(n).format(**names).strip()})" for n in needed)
    body = sql.format(**names).strip()
    ORACLES[name] = f"WITH {ctes}\n{body}" if ctes else body


def _view(name: str) -> str:
    return SQL_VIEWS[name] if name in SQL_VIEWS else VIEWS[name]


def hits(words, text: str = "lower(text)") -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {q(w)}) AS INT)" for w in words) + ")"


def per_list(lists: dict, prefix: str) -> str:
    return ", ".join(f"{hits(words)} AS {prefix}_{name}" for name, words in lists.items())


def rounded(cents: str, divisor: str) -> str:
    """cents / divisor, rounded half away from zero to whole cents, as money."""
    return (
        f"CAST(sign({cents}) * ((2 * abs({cents}) + {divisor}) // (2 * {divisor})) / 100.0 AS decimal(18,2))"
    )


# --- sources ------------------------------------------------------------------------

oracle("assemble_pages", """
SELECT doc_id, string_agg('--- Page ' || page_num || ' ---' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY page_num) AS text,
  coalesce(first(text ORDER BY page_num), '') AS first_page_text
FROM {fx_page} GROUP BY doc_id
""")

oracle("load_extractions", """
SELECT r.doc_id, ok AS readable,
  CASE WHEN ok THEN CASE WHEN r.doc_id % 53 = 0 THEN 'invoice' ELSE document_type END END AS document_type,
  CASE WHEN ok THEN monthly_net_estimated END AS monthly_net_estimated,
  CASE WHEN ok THEN source END AS sources,
  CASE WHEN ok THEN opening_balance END AS opening_balance,
  CASE WHEN ok AND r.doc_id % 61 <> 0 THEN CAST(nsf_fee_occurrences AS bigint) END AS nsf_fee_occurrences,
  CASE WHEN ok AND r.doc_id % 61 <> 0 THEN gambling_transactions END AS gambling_transactions,
  CASE WHEN ok THEN CAST(CASE WHEN document_type = 'bank_statement' THEN 1 ELSE 0 END AS bigint) END AS expense_count
FROM (SELECT doc_id, json_valid(body) AS ok FROM {fx_raw_extraction}) AS r JOIN {fx_extraction} AS e ON r.doc_id = e.doc_id
""")

# Files hold one line for each text; their sizes add up to texts and line ends.
oracle("scan_raw_documents", """
SELECT 'lang=' || lang AS folder, CAST(sum(strlen(text) + 1) AS bigint) AS bytes FROM {documents} GROUP BY lang
""")

# --- gates -----------------------------------------------------------------------------

before, after = (q(part) for part in V.REJECT_PII_DUMP)
SQL_VIEWS["ox_screened"] = f"""
SELECT d.*, CASE
    WHEN content_type <> 'application/pdf' THEN {q(V.REJECT_CONTENT_TYPE)}
    WHEN magic <> '%PDF' THEN {q(V.REJECT_MAGIC)}
    WHEN size_bytes < 1024 THEN {q(V.REJECT_TOO_SMALL)}
    WHEN size_bytes > 52428800 THEN {q(V.REJECT_TOO_LARGE)}
    WHEN trim(first_page_text) = '' THEN {q(V.REJECT_NO_TEXT)}
    WHEN ssns >= 3 AND strong = 0 THEN {before} || ssns || {after}
    WHEN strong = 0 THEN {q(V.REJECT_NOT_FINANCIAL)} END AS reason
FROM (
  SELECT *, {hits(V.STRONG_KEYWORDS, 'lower(first_page_text)')} AS strong,
    {hits(V.SUPPORTING_KEYWORDS, 'lower(first_page_text)')} AS supporting,
    len(regexp_extract_all(first_page_text, {q(V.SSN_PATTERN)})) AS ssns
  FROM {{fx_document}}
) AS d
"""
oracle("guardrail_screen", "SELECT doc_id, reason IS NULL AS accepted, reason FROM {ox_screened}")
oracle("pii_dump_screen", "SELECT doc_id, CAST(ssns AS bigint) AS ssn_count, ssns >= 3 AND strong = 0 AS is_pii_dump FROM {ox_screened}")
oracle("financial_keyword_screen", """
SELECT doc_id, CAST(strong AS bigint) AS strong_hits, CAST(supporting AS bigint) AS supporting_hits, strong >= 1 AS is_financial
FROM {ox_screened}
""")

SQL_VIEWS["ox_repeat"] = """
SELECT batch_id, doc_id, filename, content_hash, first_doc_id FROM (
  SELECT batch_id, doc_id, filename, sha256(content) AS content_hash,
    min(doc_id) OVER (PARTITION BY batch_id, sha256(content)) AS first_doc_id
  FROM {fx_file}
) AS f WHERE doc_id <> first_doc_id
"""
oracle("duplicate_files_in_batch", "SELECT * FROM {ox_repeat}")
oracle("rejected_batches", """
SELECT batch_id, count(*) AS repeats, 'Duplicate file detected: ' || arg_min(filename, doc_id) AS reason
FROM {ox_repeat} GROUP BY batch_id
""")
oracle("required_document_set", f"""
SELECT doc_id, batch_id, guessed_type, met AS requirements_met,
  CASE WHEN met THEN 'QUEUED' ELSE 'NEEDS_REVIEW' END AS status,
  CASE WHEN NOT met THEN {q(V.MISSING_DOCUMENTS_MESSAGE)} END AS error_message
FROM (
  SELECT *, coalesce(bool_or(guessed_type = 'bank_statement') OVER (PARTITION BY batch_id), false)
    AND coalesce(bool_or(guessed_type = 'paystub') OVER (PARTITION BY batch_id), false) AS met
  FROM (
    SELECT doc_id, batch_id, CASE WHEN filename ILIKE '%bank%' THEN 'bank_statement' WHEN filename ILIKE '%pay%' THEN 'paystub' END AS guessed_type
    FROM {{fx_document}}
  ) AS g
) AS m
""")

SQL_VIEWS["ox_relevance"] = f"""
SELECT *, CASE WHEN best < 2 THEN 'unknown' WHEN h_bank_statement = best THEN 'bank_statement' WHEN h_paystub = best THEN 'paystub'
  WHEN h_w2 = best THEN 'w2' ELSE 'tax_return' END AS category
FROM (SELECT *, greatest(h_bank_statement, h_paystub, h_w2, h_tax_return) AS best
  FROM (SELECT *, {per_list(V.RELEVANCE_KEYWORDS, 'h')} FROM {{ox_screened}}) AS counted) AS ranked
"""
oracle("relevance_classify", "SELECT doc_id, best >= 2 AS is_financial, category FROM {ox_relevance}")
oracle("relevance_quarantine", f"""
SELECT doc_id, 'FAILED' AS status, left({q(V.NOT_FINANCIAL_MESSAGE[0])} || category || {q(V.NOT_FINANCIAL_MESSAGE[1])}, 1024) AS error_message
FROM {{ox_relevance}} WHERE best < 2
""")

# --- authenticity -------------------------------------------------------------------------

SQL_VIEWS["ox_typed"] = f"""
SELECT *, CASE WHEN best = 0 THEN 'unknown' WHEN t_bank_statement = best THEN 'bank_statement' WHEN t_paystub = best THEN 'paystub'
    WHEN t_w2 = best THEN 'w2' ELSE 'tax_return' END AS document_type,
  CAST(CASE best WHEN 0 THEN 0.00 WHEN 1 THEN 0.33 WHEN 2 THEN 0.67 ELSE 1.00 END AS decimal(4,2)) AS type_confidence
FROM (SELECT *, greatest(t_bank_statement, t_paystub, t_w2, t_tax_return) AS best FROM (
  SELECT doc_id, batch_id, created_at, text, producer, creation_date, mod_date, reason,
    {", ".join(f"least({hits(words)}, 3) AS t_{name}" for name, words in V.TYPE_KEYWORDS.items())}
  FROM {{ox_screened}}) AS counted) AS ranked
"""


def amount(patterns) -> str:
    tries = [f"try_cast(replace(regexp_extract(text, {q(p)}, 1, 'i'), ',', '') AS decimal(18,2))" for p in patterns]
    return f"coalesce({', '.join(tries)})"


SQL_VIEWS["ox_balance"] = f"""
SELECT *, delta <= 1.00 AS reconciled, CASE WHEN delta IS NULL THEN {q(V.NOTE_BALANCE_MISSING)}
    WHEN delta <= 1.00 THEN {q(V.NOTE_BALANCE_OK)}
    ELSE 'Balance mismatch: expected ' || expected || ', found ' || closing_balance || ' (delta $' || delta || ')' END AS note
FROM (SELECT *, CAST(abs(expected - closing_balance) AS decimal(18,2)) AS delta
  FROM (SELECT *, CAST(opening_balance + total_deposits - total_withdrawals AS decimal(18,2)) AS expected
    FROM (SELECT *, {", ".join(f"{amount(p)} AS {name}" for name, p in V.AMOUNT_PATTERNS.items())} FROM {{ox_typed}}) AS a) AS b) AS c
"""
oracle("classify_document_type", "SELECT doc_id, document_type, type_confidence FROM {ox_typed}")
oracle("extract_amounts", "SELECT doc_id, opening_balance, closing_balance, total_deposits, total_withdrawals FROM {ox_balance}")
oracle("reconcile_balances", "SELECT doc_id, reconciled, delta, note FROM {ox_balance}")

SQL_VIEWS["ox_meta"] = f"""
SELECT *, ({" OR ".join(f"contains(lower(producer), {q(p)})" for p in V.SUSPICIOUS_PRODUCERS)}) AS suspicious,
  creation_date <> '' AND mod_date <> '' AND creation_date <> mod_date AS modified,
  document_type = 'bank_statement' AS bank
FROM {{ox_balance}}
"""
oracle("inspect_document_metadata", "SELECT doc_id, suspicious AS suspicious_producer, modified AS metadata_modified FROM {ox_meta}")

SQL_VIEWS["ox_report"] = f"""
SELECT *, confidence >= 0.60 AS authentic FROM (
  SELECT *,
    CAST(greatest(1.00 - CASE WHEN document_type = 'unknown' THEN 0.45 WHEN type_confidence < 0.5 THEN 0.10 ELSE 0 END
      - CASE WHEN bank AND reconciled = false THEN 0.45 WHEN bank AND reconciled IS NULL THEN 0.10 ELSE 0 END
      - CASE WHEN suspicious THEN 0.30 ELSE 0 END - CASE WHEN modified THEN 0.20 ELSE 0 END, 0) AS decimal(4,2)) AS confidence,
    list_filter([
      CASE WHEN document_type = 'unknown' THEN {q(V.FLAG_TYPE_UNKNOWN)}
        WHEN type_confidence < 0.5 THEN 'Low confidence on document type (' || document_type || ', ' || CAST(type_confidence * 100 AS int) || '%)' END,
      CASE WHEN bank AND reconciled = false THEN 'Balance mismatch: ' || note
        WHEN bank AND reconciled IS NULL THEN {q(V.FLAG_BALANCE_MISSING)} END,
      CASE WHEN suspicious THEN {q(V.FLAG_EDITING_TOOL[0])} || producer || {q(V.FLAG_EDITING_TOOL[1])} END,
      CASE WHEN modified THEN {q(V.FLAG_MODIFIED)} END], lambda x: x IS NOT NULL) AS flags
  FROM {{ox_meta}}) AS r
"""
oracle("authenticity_report", """
SELECT doc_id, authentic, confidence, array_to_string(flags, ' | ') AS flags, document_type, type_confidence,
  CASE WHEN bank THEN reconciled END AS reconciled, CASE WHEN bank THEN delta END AS delta
FROM {ox_report}
""")
# Reports exist for documents that passed the screening.
SQL_VIEWS["ox_auth"] = "SELECT * FROM {ox_report} WHERE reason IS NULL"

# --- personal data ----------------------------------------------------------------------------

# RE2 has no look-around: what surrounds the match is captured. Pattern, group
# of the value, number of characters in front of it.
RE2 = {
    "firstname_then_initial": (r"(\b[A-Z][a-z]{2,}\s+[A-Z]\.)(\s|$|,)", 1, 0),
    "tabular_name_after_c3": (r"(C\d\d\d )([A-Z][a-z]{2,}(?:\s+[A-Z]\.)?\s+[A-Z][a-z]{2,})", 2, 5),
    "tabular_name_after_c4": (r"(C\d\d\d\d )([A-Z][a-z]{2,}(?:\s+[A-Z]\.)?\s+[A-Z][a-z]{2,})", 2, 6),
}
# Its \b knows ASCII only, so accented letters are first made word characters
# of the same length (not for e-mail, whose pattern takes the stand-in itself).
ASCII_WORDS = "regexp_replace(text, '[À-ÖØ-öø-ſ]', '_', 'g')"
LUHN = """list_sum(list_transform(range(1, length({d}) + 1), lambda i:
  CASE WHEN (length({d}) - i) % 2 = 0 THEN CAST(substr({d}, i, 1) AS int)
       WHEN CAST(substr({d}, i, 1) AS int) > 4 THEN 2 * CAST(substr({d}, i, 1) AS int) - 9
       ELSE 2 * CAST(substr({d}, i, 1) AS int) END)) % 10 = 0"""


def luhn(value: str) -> str:
    return LUHN.replace("{d}", f"regexp_replace({value}, '[ -]', '', 'g')")


def near(r) -> str:
    ahead = "lower(substr(t, greatest(span_start - 40, 0) + 1, span_start - greatest(span_start - 40, 0)))"
    return "(" + " OR ".join(f"contains({ahead}, {q(w)})" for w in r.context) + ")"


def spans(table: str) -> str:
    parts = []
    for r in RECOGNIZERS:
        pattern, group, lead = RE2.get(r.name, (r.pattern, 0, 0))
        text = "text" if r.name == "email" else ASCII_WORDS
        p = q(pattern)
        parts.append(f"""
SELECT doc_id, {q(r.entity)} AS entity_type, span_start, span_start + length(value) AS span_end,
  CAST({r.score} AS decimal(3,2)) AS score, {q(r.name)} AS recognizer
FROM (
  SELECT doc_id, t, value, CAST({lead} + sum(length(gap)) OVER run + sum(length(whole)) OVER run - length(whole) AS bigint) AS span_start
  FROM (
    SELECT doc_id, t, unnest(wholes) AS whole, unnest(vals) AS value, unnest(gaps[1:len(wholes)]) AS gap, unnest(range(1, len(wholes) + 1)) AS i
    FROM (SELECT doc_id, t, regexp_extract_all(t, {p}, 0) AS wholes, regexp_extract_all(t, {p}, {group}) AS vals, regexp_split_to_array(t, {p}) AS gaps
      FROM (SELECT doc_id, {text} AS t FROM {{{table}}}) AS x) AS y
    WHERE len(wholes) > 0) AS z
  WINDOW run AS (PARTITION BY doc_id ORDER BY i)) AS placed
{"WHERE " + luhn("value") if r.luhn else ""}{"WHERE " + near(r) if r.needs_context else ""}""")
    return " UNION ALL ".join(parts)


SQL_VIEWS["ox_spans"] = spans("documents")
SQL_VIEWS["ox_statement_spans"] = spans("fx_document")
oracle("detect_pii_spans", "SELECT * FROM {ox_spans}")
oracle("detect_pii_spans_in_statements", "SELECT * FROM {ox_statement_spans}")

context = " OR ".join(
    f"(recognizer = {q(r.name)} AND (" + " OR ".join(f"contains(ahead, {q(w)})" for w in r.context) + "))"
    for r in RECOGNIZERS if r.context
)


def in_context(spans_view: str, table: str) -> str:
    return f"""
SELECT doc_id, entity_type, span_start, span_end, recognizer, score, near AS in_context,
  CAST(CASE WHEN near THEN least(score + 0.35, 1.00) ELSE score END AS decimal(3,2)) AS boosted_score
FROM (SELECT *, {context} AS near FROM (
  SELECT s.*, lower(substr(d.text, greatest(span_start - 40, 0) + 1, span_start - greatest(span_start - 40, 0))) AS ahead
  FROM {{{spans_view}}} AS s JOIN {{{table}}} AS d ON s.doc_id = d.doc_id) AS a) AS b
"""


SQL_VIEWS["ox_boosted"] = in_context("ox_spans", "documents")
SQL_VIEWS["ox_statement_boosted"] = in_context("ox_statement_spans", "fx_document")
oracle("boost_spans_by_context", "SELECT * FROM {ox_statement_boosted}")

SQL_VIEWS["ox_merged"] = """
SELECT doc_id, entity_type, span_start, span_end, score, 'first_pass' AS detector FROM {ox_spans}
UNION ALL
SELECT doc_id, CASE label WHEN 'PERSON' THEN 'PERSON' ELSE 'LOCATION' END, span_start, span_end, CAST(0.65 AS decimal(3,2)), 'second_pass'
FROM {fx_ner_span} AS n
WHERE label IN ('PERSON', 'GPE', 'LOC') AND NOT EXISTS (
  SELECT 1 FROM {ox_spans} AS s WHERE s.doc_id = n.doc_id AND s.span_start < n.span_end AND s.span_end > n.span_start)
"""
oracle("merge_second_pass_spans", "SELECT doc_id, entity_type, CAST(span_start AS bigint) AS span_start, CAST(span_end AS bigint) AS span_end, score, detector FROM {ox_merged}")
oracle("redaction_audit", """
SELECT doc_id, entity_type, CAST(span_start AS bigint) AS span_start, CAST(span_end AS bigint) AS span_end,
  CAST(span_end - span_start AS bigint) AS char_count, detector FROM {ox_merged}
""")


# Spans that overlap form an island; its strongest span names it, and the text
# between islands is what stays.
def redacted_texts(table: str, all_spans: str) -> str:
    return f"""
SELECT d.doc_id, CASE WHEN i.doc_id IS NULL THEN d.text ELSE i.front || substr(d.text, i.last_end + 1) END AS redacted_text
FROM {{{table}}} AS d LEFT JOIN (
  SELECT doc_id, max(island_end) AS last_end,
    string_agg(substr(text, previous_end + 1, island_start - previous_end) || '[' || label || ']', '' ORDER BY island_start) AS front
  FROM (
    SELECT g.*, t.text, coalesce(lag(island_end) OVER (PARTITION BY g.doc_id ORDER BY island_start), 0) AS previous_end
    FROM (
      SELECT doc_id, island, min(span_start) AS island_start, max(span_end) AS island_end,
        arg_max(entity_type, (strength, span_end - span_start, -span_start, entity_type)) AS label
      FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY span_start, span_end, entity_type ROWS UNBOUNDED PRECEDING) AS island
        FROM (
          SELECT *, CASE WHEN span_start < max(span_end) OVER (PARTITION BY doc_id ORDER BY span_start, span_end, entity_type
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
          FROM ({all_spans}) AS every) AS marked) AS numbered
      GROUP BY doc_id, island) AS g JOIN {{{table}}} AS t ON g.doc_id = t.doc_id) AS placed
  GROUP BY doc_id) AS i ON d.doc_id = i.doc_id
"""


FIRST_SPANS = "SELECT doc_id, entity_type, span_start, span_end, boosted_score AS strength FROM "
SQL_VIEWS["ox_redacted"] = redacted_texts(
    "documents",
    FIRST_SPANS + "{ox_boosted}"
    " UNION ALL SELECT doc_id, entity_type, span_start, span_end, score FROM {ox_merged} WHERE detector = 'second_pass'",
)
SQL_VIEWS["ox_statement_redacted"] = redacted_texts(
    "fx_document", FIRST_SPANS + "{ox_statement_boosted}"
)
oracle("redact_text", "SELECT doc_id, redacted_text FROM {ox_redacted}")
oracle("redact_statements", "SELECT doc_id, redacted_text FROM {ox_statement_redacted}")
oracle("entity_counts_per_document", """
SELECT d.doc_id, count(s.doc_id) AS entity_count, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS pii_types_found
FROM {documents} AS d LEFT JOIN {ox_spans} AS s ON d.doc_id = s.doc_id GROUP BY d.doc_id
""")
oracle("entity_counts_after_second_pass", """
SELECT d.doc_id, count(s.doc_id) AS entity_count, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS pii_types_found
FROM {documents} AS d LEFT JOIN {ox_merged} AS s ON d.doc_id = s.doc_id GROUP BY d.doc_id
""")
oracle("entity_totals", "SELECT entity_type, count(*) AS entities FROM {ox_merged} GROUP BY entity_type")
oracle("redacted_preview", """
SELECT d.doc_id, d.redacted_text, coalesce(r.listed, '') AS redaction_report
FROM {ox_redacted} AS d LEFT JOIN (
  SELECT doc_id, string_agg(item, ' | ' ORDER BY item) AS listed
  FROM (SELECT doc_id, entity_type || ':' || span_start || ':' || span_end AS item FROM {ox_merged}) AS i GROUP BY doc_id
) AS r ON d.doc_id = r.doc_id WHERE d.redacted_text IS NOT NULL
""")

# --- extraction results ----------------------------------------------------------------------------

oracle("extraction_conformance", """
SELECT doc_id, CASE WHEN NOT json_valid(body) THEN 'invalid_json' ELSE array_to_string(list_filter([
  CASE WHEN doc_id % 53 = 0 THEN 'enum:document_type' END,
  CASE WHEN doc_id % 37 = 0 THEN 'missing:income.sources' END,
  CASE WHEN doc_id % 59 = 0 THEN 'type:income.frequency' END,
  CASE WHEN doc_id % 61 = 0 THEN 'missing:risk_flags' END,
  CASE WHEN doc_id % 61 <> 0 AND doc_id % 41 = 0 THEN 'type:risk_flags.overdraft_occurrences' END,
  CASE WHEN doc_id % 61 <> 0 AND doc_id % 41 = 0 THEN 'type:risk_flags.nsf_fee_occurrences' END,
  CASE WHEN json_type(body, '$.recurring_expenses[0].category') <> 'VARCHAR' THEN 'type:recurring_expenses.category' END,
  CASE WHEN json_type(body, '$.recurring_expenses[0].average_monthly_amount') = 'VARCHAR' THEN 'type:recurring_expenses.average_monthly_amount' END,
  CASE WHEN json_array_length(body, '$.recurring_expenses') > 0 AND json_type(body, '$.recurring_expenses[0].frequency') IS NULL
    THEN 'missing:recurring_expenses.frequency' END,
  CASE WHEN json_extract_string(body, '$.recurring_expenses[0].frequency') NOT IN ('weekly', 'biweekly', 'monthly', 'irregular')
    THEN 'enum:recurring_expenses.frequency' END], lambda x: x IS NOT NULL), ' | ') END AS violations
FROM (SELECT doc_id, CASE WHEN json_valid(body) THEN body ELSE 'x' END AS body FROM {fx_raw_extraction}) AS r
""")

leaks = " || ".join(
    f"list_transform(regexp_extract_all({'text' if label == 'EMAIL' else ASCII_WORDS}, {q(p)}), lambda m: "
    f"'Potential {label} found in LLM output: ''' || left(m, 30) || '''')"
    for label, p in V.OUTPUT_LEAK_PATTERNS
)
oracle("output_pii_scan", f"""
SELECT conv_id, turn, len(w) > 0 AS blocked, array_to_string(w, ' | ') AS warnings
FROM (SELECT conv_id, turn, {leaks} AS w FROM {{fx_response}}) AS r
""")
oracle("output_pii_scan_over_documents", f"""
SELECT doc_id, len(w) > 0 AS blocked, array_to_string(w, ' | ') AS warnings
FROM (SELECT doc_id, {leaks} AS w FROM {{documents}}) AS r
""")
oracle("stamp_provenance", "SELECT conv_id, turn, 'model-1' AS model, 'v5.1' AS prompt_version, doc_id, job_id FROM {fx_response}")
oracle("normalize_income", f"""
SELECT doc_id, document_type, CASE WHEN document_type IN ('w2', 'tax_return')
    THEN {rounded('CAST(annual_gross * 100 AS bigint)', '12')} ELSE monthly_net_estimated END AS monthly_net,
  CASE WHEN document_type IN ('w2', 'tax_return') THEN 'annual' ELSE frequency END AS cadence
FROM {{fx_extraction}}
""")
oracle("statement_period_months", """
SELECT s.doc_id, CASE WHEN document_type = 'bank_statement' THEN m.months END AS statement_period_months
FROM {fx_statement} AS s LEFT JOIN (
  SELECT doc_id, count(DISTINCT date_trunc('month', day)) AS months
  FROM (SELECT doc_id, unnest(generate_series(CAST(period_start AS timestamp), CAST(period_end AS timestamp), INTERVAL 1 DAY)) AS day
    FROM {fx_statement} WHERE document_type = 'bank_statement') AS days GROUP BY doc_id
) AS m ON s.doc_id = m.doc_id
""")
oracle("risk_event_counts", """
SELECT e.doc_id,
  count(*) FILTER (WHERE document_type = 'bank_statement' AND description = 'NSF Fee') AS nsf_fee_occurrences,
  count(*) FILTER (WHERE document_type = 'bank_statement' AND description = 'Overdraft Fee') AS overdraft_occurrences,
  coalesce(bool_or(document_type = 'bank_statement' AND description = 'ATM Withdrawal' AND amount < -1000), false) AS large_cash_withdrawals,
  coalesce(bool_or(document_type = 'bank_statement' AND description = 'Sportsbook Bet'), false) AS gambling_transactions
FROM {fx_extraction} AS e LEFT JOIN {fx_txn} AS t ON e.doc_id = t.doc_id GROUP BY e.doc_id
""")
oracle("irregular_large_deposits", """
SELECT e.doc_id, CAST(mid AS decimal(20,4)) AS median_deposit, largest AS largest_unexplained, coalesce(largest > mid * 1.5, false) AS irregular_large_deposits
FROM {fx_extraction} AS e LEFT JOIN (
  SELECT doc_id, median(amount) AS mid, max(amount) FILTER (WHERE description = 'Wire Deposit') AS largest
  FROM {fx_txn} WHERE amount > 0 GROUP BY doc_id) AS d ON e.doc_id = d.doc_id AND e.document_type = 'bank_statement'
""")
oracle("average_daily_balance", f"""
SELECT s.doc_id, b.average AS average_daily_balance
FROM {{fx_statement}} AS s LEFT JOIN (
  SELECT doc_id, {rounded('sum(cents)', 'count(*)')} AS average
  FROM (
    SELECT days.doc_id, CAST(opening_balance * 100 AS bigint) + coalesce(CAST(sum(net) OVER (PARTITION BY days.doc_id ORDER BY day) * 100 AS bigint), 0) AS cents
    FROM (SELECT doc_id, opening_balance, CAST(unnest(generate_series(CAST(period_start AS timestamp), CAST(period_end AS timestamp), INTERVAL 1 DAY)) AS date) AS day
      FROM {{fx_statement}} WHERE document_type = 'bank_statement') AS days
    LEFT JOIN (SELECT doc_id, txn_date, sum(amount) AS net FROM {{fx_txn}} GROUP BY doc_id, txn_date) AS n
      ON days.doc_id = n.doc_id AND days.day = n.txn_date
  ) AS daily GROUP BY doc_id
) AS b ON s.doc_id = b.doc_id
WHERE s.document_type = 'bank_statement'
""")
CATEGORY = (
    f"trim(regexp_replace(trim(regexp_replace(regexp_replace(description, {q(V.CHANGING_WORDS)}, ' ', 'g'), "
    f"'\\s+', ' ', 'g')), {q(V.LOOSE_ENDS)}, ''))"
)
oracle("recurring_expenses", f"""
SELECT doc_id, category, {rounded('cents', 'months')} AS average_monthly_amount,
  CASE WHEN gap BETWEEN 5 AND 9 THEN 'weekly' WHEN gap BETWEEN 12 AND 17 THEN 'biweekly' WHEN gap BETWEEN 26 AND 35 THEN 'monthly'
    ELSE 'irregular' END AS frequency
FROM (
  SELECT doc_id, min(category) AS category, CAST(sum(spent) * 100 AS bigint) AS cents, median(gap) AS gap,
    12 * (year(max(txn_date)) - year(min(txn_date))) + month(max(txn_date)) - month(min(txn_date)) + 1 AS months
  FROM (
    SELECT *, txn_date - lag(txn_date) OVER (PARTITION BY doc_id, kind ORDER BY txn_date) AS gap
    FROM (SELECT doc_id, lower(category) AS kind, txn_date, sum(-amount) AS spent, min(category) AS category
      FROM (SELECT *, coalesce(nullif({CATEGORY}, ''), description) AS category FROM {{fx_txn}} WHERE amount < 0) AS n
      GROUP BY doc_id, lower(category), txn_date) AS d
  ) AS g GROUP BY doc_id, kind
) AS c WHERE gap IS NOT NULL AND doc_id IN (SELECT doc_id FROM {{fx_extraction}} WHERE document_type = 'bank_statement')
""")
oracle("document_integrity_rules", """
SELECT doc_id, array_to_string(r, ' | ') AS broken_rules, len(r) > 0 AS document_integrity_flag
FROM (SELECT doc_id, list_filter([
  CASE WHEN regexp_matches(lower(text), 'doctored|fraudulent|test fraud') THEN 'SELF_LABELLED' END,
  CASE WHEN net_pay + deductions > gross_pay THEN 'NET_ABOVE_GROSS' END,
  CASE WHEN social_security_wages > wages THEN 'SS_WAGES_ABOVE_WAGES' END,
  CASE WHEN tax > income THEN 'TAX_ABOVE_INCOME' END], lambda x: x IS NOT NULL) AS r FROM {fx_figures}) AS f
""")
# By brute force: a day is broken if its last printed balance is not the one of
# the day before (or the opening balance) plus the day's amounts.
oracle("statement_total_audit", """
SELECT s.doc_id, coalesce(l.paid_in, 0) <> total_deposits AS deposits_differ, coalesce(l.paid_out, 0) <> total_withdrawals AS withdrawals_differ,
  coalesce(b.breaks, 0) AS balance_breaks
FROM {fx_statement} AS s
LEFT JOIN (SELECT doc_id, sum(greatest(amount, 0)) AS paid_in, -sum(least(amount, 0)) AS paid_out FROM {fx_ledger} GROUP BY doc_id) AS l ON s.doc_id = l.doc_id
LEFT JOIN (
  SELECT doc_id, count(*) FILTER (WHERE printed <> previous + net) AS breaks
  FROM (SELECT d.doc_id, d.net, d.printed, coalesce(lag(d.printed) OVER (PARTITION BY d.doc_id ORDER BY txn_date), opening_balance) AS previous
    FROM (SELECT doc_id, txn_date, sum(amount) AS net, arg_max(balance, line_no) AS printed FROM {fx_ledger} GROUP BY doc_id, txn_date) AS d
    JOIN {fx_statement} AS h ON d.doc_id = h.doc_id) AS chain GROUP BY doc_id
) AS b ON s.doc_id = b.doc_id
WHERE s.document_type = 'bank_statement'
""")

# --- scorecard ----------------------------------------------------------------------------------------

def dollars(column: str) -> str:
    return "format('{{:,.2f}}', CAST(" + column + " AS double))"


# Everything one scorecard looks at, for documents and for applications.
def scored_input(source: str, key: str) -> str:
    return f"""
SELECT {key}, document_type, monthly_net_estimated, annual_gross, source, frequency, opening_balance, closing_balance,
  statement_period_months AS months, nsf_fee_occurrences, overdraft_occurrences, authentic, auth_flags,
  coalesce(confidence, 0) AS confidence, coalesce(nsf_fee_occurrences, 0) AS nsf, coalesce(overdraft_occurrences, 0) AS od,
  coalesce(gambling_transactions, false) AS gambling, coalesce(irregular_large_deposits, false) AS irregular,
  coalesce(large_cash_withdrawals, false) AS cash, document_integrity_flag, document_type = 'bank_statement' AS bank,
  CAST(monthly_net_estimated IS NOT NULL AS int) + CAST(frequency <> 'unknown' AS int) + CAST(source IS NOT NULL AS int)
    + CAST(overdraft_occurrences IS NOT NULL AS int) + CAST(document_integrity_flag IS NOT NULL AS int)
    + CASE WHEN document_type = 'bank_statement' THEN CAST(opening_balance IS NOT NULL AS int) + CAST(closing_balance IS NOT NULL AS int)
           WHEN document_type IN ('w2', 'tax_return') THEN CAST(annual_gross IS NOT NULL AS int) ELSE 0 END AS filled,
  CASE WHEN document_type = 'bank_statement' THEN 7 WHEN document_type IN ('w2', 'tax_return') THEN 6 ELSE 5 END AS required
FROM {{{source}}}
"""


SQL_VIEWS["ox_ext"] = """
SELECT e.*, a.authentic, a.confidence, a.flags AS auth_flags FROM {fx_extraction} AS e LEFT JOIN {ox_auth} AS a ON e.doc_id = a.doc_id
"""
SQL_VIEWS["ox_card_in"] = scored_input("ox_ext", "doc_id")


def quoted_flags(count: int, otherwise: str) -> str:
    return f"coalesce(nullif(array_to_string(auth_flags[1:{count}], '; '), ''), '{otherwise}')"


# name -> (category, possible, [(condition, code, points, severity, detail, flags)]).
CARD = {
    "score_document_type": ("completeness", 5, [
        ("document_type <> 'unknown'", "DOC_TYPE_IDENTIFIED", "5", "'none'", "'Document classified as ' || document_type", "''"),
        ("true", "DOC_TYPE_UNKNOWN", "0", "'high'", "'Document type could not be determined — classification failed'", "'DOC_TYPE_UNKNOWN'"),
    ]),
    "score_income": ("completeness", 10, [
        ("monthly_net_estimated > 0", "INCOME_VERIFIED", "10", "'none'", "'Monthly net income present: $' || " + dollars("monthly_net_estimated"), "''"),
        ("monthly_net_estimated = 0", "INCOME_ZERO", "4", "'medium'", "'Income field present but reported as $0 — verify with source'", "'INCOME_ZERO'"),
        ("true", "INCOME_MISSING", "0", "'high'", "'Monthly net income could not be extracted from document'", "'INCOME_MISSING'"),
    ]),
    "score_balance_data": ("completeness", 10, [
        ("NOT bank", "BALANCE_DATA_NA", "10", "'none'", "'Balance data not applicable for ' || document_type", "''"),
        ("opening_balance IS NULL OR closing_balance IS NULL", "BALANCE_DATA_MISSING", "0", "'medium'", "'Opening or closing balance not found in bank statement'", "'BALANCE_DATA_MISSING'"),
        ("true", "BALANCE_DATA_PRESENT", "10", "'none'", "'Opening $' || " + dollars("opening_balance") + " || ' → Closing $' || " + dollars("closing_balance"), "''"),
    ]),
    "score_history_depth": ("completeness", 0, [
        ("NOT bank", "", "0", "'none'", "''", "''"),
        ("months IS NULL", "HISTORY_DEPTH_UNKNOWN", "0", "'medium'", "'Statement period could not be determined from document'", "'INSUFFICIENT_HISTORY'"),
        ("months < 3", "INSUFFICIENT_HISTORY", "0", "'high'", "'Bank statement covers ' || months || ' month(s); 3 months required for underwriting'", "'INSUFFICIENT_HISTORY'"),
        ("true", "HISTORY_DEPTH_OK", "0", "'none'", "'Bank statement covers ' || months || ' months — meets minimum'", "''"),
    ]),
    "score_authenticity": ("integrity", 15, [
        ("authentic AND confidence >= 0.8", "AUTH_PASSED", "15", "'none'", "'Passed all authenticity checks (auth confidence: ' || confidence || ')'", "''"),
        ("authentic AND confidence >= 0.6", "AUTH_LOW_CONFIDENCE", "8", "'medium'", "'Passed checks but auth confidence low (' || confidence || '): ' || " + quoted_flags(2, "minor anomalies"), "'AUTH_LOW_CONFIDENCE'"),
        ("true", "AUTH_FAILED", "0", "'high'", "'Authentication failed: ' || " + quoted_flags(3, "unknown reason"), "'AUTH_FAILED'"),
    ]),
    "score_integrity": ("integrity", 10, [
        ("document_integrity_flag", "INTEGRITY_FAIL", "0", "'critical'", "'Document integrity issue: figures are self-contradictory'", "'INTEGRITY_FAIL'"),
        ("true", "INTEGRITY_OK", "10", "'none'", "'No mathematical inconsistencies or self-contradictions detected'", "''"),
    ]),
    "score_nsf": ("risk", 10, [
        ("nsf = 0", "NO_NSF_FEES", "10", "'none'", "'No NSF fee events'", "''"),
        ("nsf <= 2", "NSF_FEES_LOW", "5", "'medium'", "nsf || ' NSF fee event(s) — moderate risk signal'", "'NSF_FEES'"),
        ("true", "NSF_FEES_HIGH", "0", "'high'", "nsf || ' NSF fee events — elevated risk'", "'NSF_FEES_HIGH'"),
    ]),
    "score_overdrafts": ("risk", 10, [
        ("od = 0", "NO_OVERDRAFTS", "10", "'none'", "'No overdraft events'", "''"),
        ("od <= 2", "OVERDRAFTS_LOW", "5", "'medium'", "od || ' overdraft event(s)'", "'OVERDRAFTS'"),
        ("true", "OVERDRAFTS_HIGH", "0", "'high'", "od || ' overdraft events — elevated risk'", "'OVERDRAFTS_HIGH'"),
    ]),
    "score_behavior": ("risk", 10, [
        ("NOT gambling AND NOT irregular AND NOT cash", "BEHAVIORAL_CLEAN", "10", "'none'", "'No gambling, irregular deposits, or large cash withdrawals'", "''"),
        ("gambling", "BEHAVIORAL_FLAGS", "5 - 3 * CAST(irregular AS int) - 2 * CAST(cash AS int)", "'high'",
         "'Gambling transactions present' || CASE WHEN irregular THEN '; unexplained large deposits' ELSE '' END || CASE WHEN cash THEN '; large cash withdrawals (>$1,000)' ELSE '' END",
         "'GAMBLING_TRANSACTIONS' || CASE WHEN irregular THEN ' | IRREGULAR_DEPOSITS' ELSE '' END || CASE WHEN cash THEN ' | LARGE_CASH_WITHDRAWALS' ELSE '' END"),
        ("irregular AND cash", "BEHAVIORAL_FLAGS", "5", "'high'", "'Unexplained large deposits; large cash withdrawals (>$1,000)'", "'IRREGULAR_DEPOSITS | LARGE_CASH_WITHDRAWALS'"),
        ("irregular", "BEHAVIORAL_FLAGS", "7", "'medium'", "'Unexplained large deposits'", "'IRREGULAR_DEPOSITS'"),
        ("true", "BEHAVIORAL_FLAGS", "8", "'medium'", "'Large cash withdrawals (>$1,000)'", "'LARGE_CASH_WITHDRAWALS'"),
    ]),
    "score_field_coverage": ("coverage", 20, [
        ("filled = required", "FULL_FIELD_COVERAGE", "20", "'none'", "'All ' || required || ' required fields populated by LLM'", "''"),
        ("true", "PARTIAL_FIELD_COVERAGE", "CAST(round(20.0 * filled / required) AS int)", "CASE WHEN filled * 10 >= required * 7 THEN 'medium' ELSE 'high' END",
         "(required - filled) || ' of ' || required || ' required fields missing or null'", "CASE WHEN filled * 10 >= required * 7 THEN '' ELSE 'LOW_FIELD_COVERAGE' END"),
    ]),
}


def pick(outcomes, place: int) -> str:
    values = [f"WHEN {o[0]} THEN {q(o[1]) if place == 1 else o[place]}" for o in outcomes]
    return f"CASE {' '.join(values)} END"


def check_rows(source: str, key: str) -> str:
    """One row per check that applies, numbered in scorecard order."""
    return " UNION ALL ".join(
        f"SELECT {key}, {n} AS nr, {pick(outcomes, 1)} AS code, {q(category)} AS category, CAST({pick(outcomes, 2)} AS bigint) AS points_earned, "
        f"CAST({possible} AS bigint) AS points_possible, {pick(outcomes, 3)} AS severity, {pick(outcomes, 4)} AS detail, {pick(outcomes, 5)} AS flags "
        f"FROM {{{source}}}" + (" WHERE bank" if name == "score_history_depth" else "")
        for n, (name, (category, possible, outcomes)) in enumerate(CARD.items())
    )


def card_totals(rows: str, key: str) -> str:
    return f"""
SELECT *, CASE WHEN score < 0.80 OR regexp_matches(flags, 'INTEGRITY_FAIL|AUTH_FAILED|DOC_TYPE_UNKNOWN|INSUFFICIENT_HISTORY')
  THEN 'NEEDS_REVIEW' ELSE 'PASS' END AS recommendation
FROM (SELECT {key}, CAST(sum(points_earned) / 100.0 AS decimal(5,4)) AS score, CAST(sum(points_earned) AS bigint) AS total_earned,
    CAST(sum(points_possible) AS bigint) AS total_possible, coalesce(string_agg(nullif(flags, ''), ' | ' ORDER BY nr), '') AS flags,
    string_agg(code, ' | ' ORDER BY nr) AS codes
  FROM {{{rows}}} GROUP BY {key}) AS t
"""


SQL_VIEWS["ox_checks"] = check_rows("ox_card_in", "doc_id")
SQL_VIEWS["ox_card"] = card_totals("ox_checks", "doc_id")
for n, name in enumerate(CARD):
    oracle(name, f"SELECT doc_id, code, category, points_earned, points_possible, severity, detail, flags FROM {{ox_checks}} WHERE nr = {n}")
oracle("scorecard", """
SELECT c.doc_id, document_type, score, total_earned, total_possible, recommendation, flags
FROM {ox_card} AS c JOIN {fx_extraction} AS e ON c.doc_id = e.doc_id
""")
oracle("score_breakdown", """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nr) - 1 AS position, code, category, points_earned, points_possible, severity, detail
FROM {ox_checks}
""")
messages = " ".join(f"WHEN {q(flag)} THEN {q(text)}" for flag, text in V.REVIEW_MESSAGES.items())
oracle("review_routing", f"""
SELECT c.doc_id, CASE WHEN bad THEN 'NEEDS_REVIEW' ELSE 'SUCCEEDED' END AS status,
  CASE WHEN bad THEN coalesce(m.message, CASE WHEN authentic = false THEN {q(V.REVIEW_NOT_AUTHENTIC)} END,
    'Confidence ' || CAST(round(score, 2) AS decimal(4,2)) || ' below threshold') END AS error_message
FROM (SELECT k.*, i.authentic, recommendation = 'NEEDS_REVIEW' OR coalesce(i.authentic = false, false) AS bad
  FROM {{ox_card}} AS k JOIN {{ox_card_in}} AS i ON k.doc_id = i.doc_id) AS c
LEFT JOIN (
  SELECT doc_id, arg_min(message, (nr, place)) AS message FROM (
    SELECT doc_id, nr, place, CASE flag {messages} END AS message
    FROM (SELECT doc_id, nr, unnest(string_split(flags, ' | ')) AS flag, unnest(range(1, len(string_split(flags, ' | ')) + 1)) AS place FROM {{ox_checks}} WHERE flags <> '') AS f
  ) AS w WHERE message IS NOT NULL GROUP BY doc_id
) AS m ON c.doc_id = m.doc_id
""")
oracle("risk_band", """
SELECT job_id, CAST(confidence_score AS decimal(5,4)) AS score, CASE WHEN confidence_score IS NULL THEN 'Unknown' WHEN confidence_score >= 0.9 THEN 'Low Risk'
  WHEN confidence_score >= 0.8 THEN 'Moderate Risk' ELSE 'Elevated Risk' END AS risk_band
FROM {fx_job}
""")
oracle("review_findings", """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['critical', 'high', 'medium', 'low', 'none'], severity), nr) - 1 AS place,
  code, category, points_earned, points_possible, severity, detail
FROM {ox_checks} WHERE severity IN ('medium', 'high', 'critical') OR points_earned < points_possible
""")

# --- applications ----------------------------------------------------------------------------------------

SQL_VIEWS["ox_income"] = """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY monthly_net_estimated IS NULL OR document_type = 'unknown',
    CASE WHEN monthly_net_estimated IS NULL OR document_type = 'unknown' THEN 0
      ELSE list_position(['paystub', 'w2', 'tax_return', 'bank_statement'], document_type) END, created_at, doc_id) AS place
  FROM {fx_extraction}) AS r WHERE place = 1
"""
oracle("application_income", """
SELECT batch_id, document_type AS income_source_document, monthly_net_estimated, frequency FROM {ox_income}
""")
SQL_VIEWS["ox_profile"] = """
SELECT i.batch_id, CASE WHEN b.batch_id IS NOT NULL THEN 'bank_statement' ELSE f.document_type END AS document_type,
  i.document_type AS income_source_document, i.monthly_net_estimated, i.annual_gross, i.source, i.frequency,
  b.opening_balance, b.closing_balance, b.statement_period_months,
  CASE WHEN b.batch_id IS NULL THEN 0 ELSE b.nsf_fee_occurrences END AS nsf_fee_occurrences,
  CASE WHEN b.batch_id IS NULL THEN 0 ELSE b.overdraft_occurrences END AS overdraft_occurrences,
  coalesce(b.gambling_transactions, false) AS gambling_transactions, coalesce(b.irregular_large_deposits, false) AS irregular_large_deposits,
  coalesce(b.large_cash_withdrawals, false) AS large_cash_withdrawals, coalesce(b.document_integrity_flag, false) AS document_integrity_flag,
  s.signal, s.received
FROM {ox_income} AS i
JOIN (SELECT * FROM {fx_extraction} QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY created_at, doc_id) = 1) AS f ON i.batch_id = f.batch_id
LEFT JOIN (SELECT * FROM {fx_extraction} WHERE document_type = 'bank_statement'
  QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY created_at, doc_id) = 1) AS b ON i.batch_id = b.batch_id
JOIN {ox_signal} AS s ON i.batch_id = s.batch_id
"""
SQL_VIEWS["ox_signal"] = """
SELECT batch_id, string_agg(document_type || '=' || n, ' | ' ORDER BY first_upload) AS received,
  CASE WHEN bool_or(document_type = 'bank_statement') AND bool_or(document_type IN ('paystub', 'w2', 'tax_return')) THEN 'DOC_SET_COMPLETE'
    WHEN bool_or(document_type IN ('paystub', 'w2', 'tax_return')) THEN 'DOC_SET_MISSING_BANK_STATEMENT'
    WHEN bool_or(document_type = 'bank_statement') THEN 'DOC_SET_MISSING_INCOME_DOCUMENT' ELSE 'DOC_SET_INCOMPLETE' END AS signal
FROM (SELECT batch_id, document_type, count(*) AS n, min((created_at, doc_id)) AS first_upload FROM {fx_extraction} GROUP BY batch_id, document_type) AS t GROUP BY batch_id
"""
oracle("application_profile", """
SELECT batch_id, document_type, received AS documents_received, income_source_document, monthly_net_estimated, opening_balance,
  CAST(statement_period_months AS bigint) AS statement_period_months, CAST(nsf_fee_occurrences AS bigint) AS nsf_fee_occurrences, gambling_transactions
FROM {ox_profile}
""")
oracle("application_documents", """
SELECT batch_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, doc_id, document_type FROM {fx_extraction}
""")
SQL_VIEWS["ox_flags"] = """
SELECT batch_id, created_at, doc_id, unnest(flags) AS flag, unnest(range(0, len(flags))) AS position FROM {ox_auth} WHERE len(flags) > 0
"""
oracle("application_flags", "SELECT batch_id, doc_id, position, flag FROM {ox_flags}")
SQL_VIEWS["ox_app_auth"] = """
SELECT a.batch_id, bool_and(authentic) AS authentic, min(confidence) AS confidence, CAST(sum(len(flags)) AS bigint) AS flag_count,
  any_value(l.listed) AS listed
FROM {ox_auth} AS a LEFT JOIN (SELECT batch_id, list(flag ORDER BY created_at, doc_id, position) AS listed FROM {ox_flags} GROUP BY batch_id) AS l
  ON a.batch_id = l.batch_id GROUP BY a.batch_id
"""
oracle("application_authenticity", """
SELECT batch_id, authentic, confidence, flag_count FROM {ox_app_auth}
""")
oracle("document_set_signals", "SELECT batch_id, signal FROM {ox_signal}")

SQL_VIEWS["ox_latest"] = """
SELECT * FROM {fx_job} QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, job_id) = 1
"""
SQL_VIEWS["ox_batch"] = """
SELECT b.batch_id, count(j.job_id) AS jobs, CASE WHEN count(j.job_id) = 0 THEN 'EMPTY' WHEN count(*) FILTER (WHERE status = 'FAILED') > 0 THEN 'FAILED'
  WHEN count(*) FILTER (WHERE status IN ('RUNNING', 'QUEUED')) > 0 THEN 'RUNNING'
  WHEN count(*) FILTER (WHERE status = 'NEEDS_REVIEW') > 0 THEN 'NEEDS_REVIEW' ELSE 'SUCCEEDED' END AS status
FROM {fx_batch} AS b LEFT JOIN {ox_latest} AS j ON b.batch_id = j.batch_id GROUP BY b.batch_id
"""
SQL_VIEWS["ox_app_in"] = """
SELECT p.*, a.authentic, a.confidence, a.listed AS auth_flags FROM {ox_profile} AS p JOIN {ox_app_auth} AS a ON p.batch_id = a.batch_id
"""
SQL_VIEWS["ox_app_card_in"] = scored_input("ox_app_in", "batch_id")
SQL_VIEWS["ox_app_checks"] = check_rows("ox_app_card_in", "batch_id")
SQL_VIEWS["ox_app_card"] = card_totals("ox_app_checks", "batch_id")
oracle("application_decision", """
SELECT b.batch_id, b.status, p.document_type, p.income_source_document, p.authentic, p.confidence,
  p.signal || CASE WHEN p.income_source_document IS NULL THEN '' ELSE ' | INCOME_SOURCE' END || ' | ' || c.codes AS codes,
  c.score, c.total_earned, c.total_possible, c.recommendation,
  CASE WHEN c.batch_id IS NULL THEN NULL WHEN p.signal = 'DOC_SET_COMPLETE' THEN c.flags WHEN c.flags = '' THEN p.signal ELSE c.flags || ' | ' || p.signal END AS flags
FROM {ox_batch} AS b LEFT JOIN {ox_app_in} AS p ON b.batch_id = p.batch_id LEFT JOIN {ox_app_card} AS c ON b.batch_id = c.batch_id
""")
oracle("per_document_summary", """
SELECT d.batch_id, d.doc_id, j.job_id, d.filename, j.status, j.error_message, strftime(j.created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
  e.document_type, c.score, coalesce(c.flags, '') AS flags
FROM {fx_document} AS d JOIN {ox_latest} AS j ON d.doc_id = j.document_id LEFT JOIN {fx_extraction} AS e ON d.doc_id = e.doc_id
LEFT JOIN {ox_card} AS c ON d.doc_id = c.doc_id
""")
oracle("batch_status", "SELECT batch_id, status, jobs FROM {ox_batch}")
oracle("latest_job_per_document", "SELECT document_id, job_id, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM {ox_latest}")

# --- review and lifecycle -----------------------------------------------------------------------------------

oracle("review_queue", """
SELECT job_id, document_id, filename, confidence_score, authentic, auth_confidence, CAST(entity_count AS bigint) AS entity_count, pii_types_found,
  error_message, strftime(j.created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM {fx_job} AS j JOIN {fx_document} AS d ON j.document_id = d.doc_id WHERE status = 'NEEDS_REVIEW'
""")
SQL_VIEWS["ox_first_review"] = "SELECT * FROM {fx_review} QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY submitted_at, review_id) = 1"
SQL_VIEWS["ox_decided"] = """
SELECT j.job_id, j.document_id, CASE WHEN hit AND decision = 'approved' THEN 'SUCCEEDED' WHEN hit THEN 'FAILED' ELSE status END AS status,
  CASE WHEN hit THEN decision ELSE review_status END AS review_status,
  CASE WHEN hit AND decision = 'rejected' AND notes <> '' THEN left(notes, 1024) ELSE error_message END AS error_message
FROM (SELECT j.*, r.decision, r.notes, j.status = 'NEEDS_REVIEW' AND r.job_id IS NOT NULL AS hit
  FROM {fx_job} AS j LEFT JOIN {ox_first_review} AS r ON j.job_id = r.job_id) AS j
"""
oracle("apply_review_decisions", "SELECT job_id, status, review_status, error_message FROM {ox_decided}")
oracle("conflicting_review_decisions", """
SELECT r.review_id, r.job_id, r.decision, j.status, CASE WHEN j.job_id IS NULL THEN 'not_found' ELSE 'conflict' END AS reason
FROM {fx_review} AS r LEFT JOIN {fx_job} AS j ON r.job_id = j.job_id LEFT JOIN {ox_first_review} AS f ON r.review_id = f.review_id
WHERE j.job_id IS NULL OR j.status <> 'NEEDS_REVIEW' OR f.review_id IS NULL
""")
SQL_VIEWS["ox_span_report"] = """
SELECT doc_id, string_agg(item, ' | ' ORDER BY item) AS listed
FROM (SELECT doc_id, entity_type || ':' || span_start || ':' || span_end AS item FROM {ox_statement_spans}) AS i GROUP BY doc_id
"""
oracle("job_results", """
SELECT j.job_id, j.document_id AS doc_id, e.document_type, e.monthly_net_estimated, c.score, c.recommendation, c.codes,
  a.authentic, a.confidence, array_to_string(a.flags, ' | ') AS auth_flags, r.listed AS redaction_report
FROM {fx_job} AS j
LEFT JOIN {fx_extraction} AS e ON j.document_id = e.doc_id AND e.doc_id % 37 <> 5
LEFT JOIN {ox_card} AS c ON j.document_id = c.doc_id AND c.doc_id % 37 <> 5
LEFT JOIN {ox_auth} AS a ON j.document_id = a.doc_id
LEFT JOIN (SELECT s.* FROM {ox_span_report} AS s JOIN {ox_relevance} AS v ON s.doc_id = v.doc_id WHERE v.best >= 2 AND v.reason IS NULL) AS r
  ON j.document_id = r.doc_id
WHERE e.doc_id IS NOT NULL OR c.doc_id IS NOT NULL OR a.doc_id IS NOT NULL OR r.doc_id IS NOT NULL
""")
oracle("job_state_from_events", """
SELECT job_id, status, message FROM {fx_status_event} QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1
""")
oracle("purge_manifest", """
SELECT doc_id, k AS object_key FROM (
  SELECT doc_id, 'raw/' || doc_id || '/' || filename AS k FROM {fx_document} UNION ALL SELECT doc_id, 'parsed/' || doc_id || '/extracted.txt' FROM {fx_document}
) AS keys WHERE doc_id IN (SELECT document_id FROM {fx_job} WHERE status IN ('SUCCEEDED', 'FAILED', 'NEEDS_REVIEW') AND error_message IS NULL)
""")
oracle("adverse_action_notes", """
SELECT d.job_id, d.document_id AS doc_id, d.review_status AS decision, replace(coalesce(c.flags, ''), ' | ', '; ') AS reason_codes
FROM {ox_decided} AS d LEFT JOIN {ox_card} AS c ON d.document_id = c.doc_id
WHERE d.review_status = 'rejected' OR c.recommendation = 'NEEDS_REVIEW'
""")

# The bodies of seven kinds of artifact, one line for each document and kind.
oracle("write_step_artifacts", """
SELECT 'parsed_text' AS step, doc_id, text AS content FROM {fx_document} WHERE doc_id IN (SELECT doc_id FROM {ox_auth})
UNION ALL SELECT 'authenticity_report', doc_id, document_type || '|' || authentic || '|' || confidence || '|' || len(flags) FROM {ox_auth}
UNION ALL SELECT 'redacted_text', t.doc_id, t.redacted_text FROM {ox_statement_redacted} AS t JOIN {ox_auth} AS a ON t.doc_id = a.doc_id
UNION ALL SELECT 'redaction_report', a.doc_id, coalesce(s.listed, '') FROM {ox_auth} AS a LEFT JOIN {ox_span_report} AS s ON a.doc_id = s.doc_id
UNION ALL SELECT 'extraction', doc_id, document_type || '|' || coalesce(CAST(monthly_net_estimated AS varchar), '') FROM {fx_extraction}
UNION ALL SELECT 'extraction_meta', doc_id, 'model-1|v5.1|' || doc_id FROM {fx_extraction}
UNION ALL SELECT 'score_breakdown', doc_id, score || '|' || total_earned || '|' || codes FROM {ox_card}
""")

# --- dashboard ---------------------------------------------------------------------------------------------------

oracle("status_counts", """
SELECT s.status, count(j.job_id) AS jobs
FROM (SELECT unnest(['QUEUED', 'RUNNING', 'SUCCEEDED', 'FAILED', 'NEEDS_REVIEW']) AS status) AS s LEFT JOIN {fx_job} AS j ON s.status = j.status GROUP BY s.status
""")
oracle("processing_totals", """
SELECT count(*) AS all_jobs, CAST(coalesce(sum(entity_count), 0) AS bigint) AS pii_entities_redacted,
  CAST(round(avg(confidence_score), 6) AS decimal(18,6)) AS avg_confidence, CAST(round(avg(auth_confidence), 6) AS decimal(18,6)) AS avg_auth_confidence
FROM {fx_job}
""")
oracle("auto_approval_rate", """
SELECT CAST(round(count(*) FILTER (WHERE status = 'SUCCEEDED' AND review_status IS NULL) / CAST(nullif(count(*), 0) AS double), 6) AS decimal(18,6)) AS auto_approval_rate
FROM {fx_job} WHERE status IN ('SUCCEEDED', 'FAILED', 'NEEDS_REVIEW')
""")
oracle("auth_pass_rate", """
SELECT CAST(round(avg(CAST(authentic AS int)), 6) AS decimal(18,6)) AS auth_pass_rate FROM {fx_job}
""")
oracle("processed_last_24h", """
SELECT count(*) AS processed_24h FROM {fx_job} WHERE created_at >= (SELECT max(created_at) FROM {fx_job}) - INTERVAL 24 HOUR
""")
oracle("daily_volume", """
SELECT CAST(created_at AS date) AS day, count(*) AS jobs FROM {fx_job}
WHERE created_at >= (SELECT max(created_at) FROM {fx_job}) - INTERVAL 14 DAY GROUP BY 1
""")
oracle("document_type_mix", "SELECT document_type, count(*) AS jobs FROM {fx_job} WHERE document_type IS NOT NULL GROUP BY document_type")
buckets = ", ".join(q(b) for b in V.CONFIDENCE_BUCKETS)
oracle("confidence_histogram", f"""
SELECT b.bucket, count(j.job_id) AS jobs
FROM (SELECT unnest([{buckets}]) AS bucket, unnest(range(0, 10)) AS i) AS b
LEFT JOIN {{fx_job}} AS j ON least(CAST(floor(confidence_score * 10) AS int), 9) = b.i GROUP BY b.bucket
""")
oracle("pii_type_ranking", """
SELECT pii_type, count(*) AS documents FROM (SELECT trim(unnest(string_split(pii_types_found, ','))) AS pii_type FROM {fx_job}) AS t
WHERE pii_type <> '' GROUP BY pii_type
""")
oracle("success_rate", """
SELECT CAST(round(100.0 * count(*) FILTER (WHERE status = 'SUCCEEDED') / count(*), 6) AS decimal(18,6)) AS success_rate FROM {fx_job}
""")
oracle("step_durations", """
SELECT step, CAST(round(avg(seconds), 6) AS decimal(18,6)) AS avg_seconds, count(*) AS runs FROM {fx_step_event} WHERE step IS NOT NULL GROUP BY step
""")
oracle("step_failures", """
SELECT step AS metric, count(*) AS failures FROM {fx_step_event} WHERE outcome <> 'ok' AND step IS NOT NULL GROUP BY step
UNION ALL SELECT 'classify_rejected', count(*) FROM {fx_step_event} WHERE outcome = 'rejected'
UNION ALL SELECT 'pii_leak_blocks', count(*) FROM {fx_step_event} WHERE outcome = 'leak_block'
""")
oracle("latency_p95", """
SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  CAST(round(quantile_cont(CAST(seconds AS double), 0.95), 4) AS decimal(20,4)) AS p95_seconds
FROM {fx_step_event} GROUP BY 1
""")
SQL_VIEWS["ox_rate"] = """
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests, CAST(round(count(*) / 120.0, 6) AS decimal(18,6)) AS per_second
FROM (SELECT time_bucket(INTERVAL 15 SECOND, ts) - unnest(range(0, 8)) * INTERVAL 15 SECOND AS start FROM {fx_step_event}) AS w GROUP BY 1
"""
oracle("request_rate", "SELECT * FROM {ox_rate}")
oracle("status_over_time", """
SELECT strftime(date_trunc('day', created_at), '%Y-%m-%d %H:%M:%S') AS window_start, status, count(*) AS jobs FROM {fx_job} GROUP BY 1, 2
""")

# --- streaming ------------------------------------------------------------------------------------------------------

SQL_VIEWS["ox_gate"] = f"""
SELECT v.*, coalesce('Duplicate file detected: ' || r.name, v.reason, CASE WHEN NOT r.met THEN {q(V.MISSING_DOCUMENTS_MESSAGE)} END) AS gate_reason,
  CASE WHEN r.name IS NOT NULL OR v.reason IS NOT NULL THEN 'REJECTED' WHEN NOT r.met THEN 'NEEDS_REVIEW' END AS gate_outcome
FROM {{ox_relevance}} AS v JOIN (
  SELECT batch_id, arg_min(filename, doc_id) FILTER (WHERE doc_id > first_doc) AS name,
    bool_or(filename ILIKE '%bank%') AND bool_or(filename ILIKE '%pay%' AND filename NOT ILIKE '%bank%') AS met
  FROM (SELECT *, min(doc_id) OVER (PARTITION BY batch_id, text) AS first_doc FROM {{fx_document}}) AS f GROUP BY batch_id
) AS r ON v.batch_id = r.batch_id
"""
INTAKE = """
SELECT v.doc_id, v.batch_id, coalesce(v.gate_outcome, CASE WHEN v.best < 2 THEN 'FAILED' ELSE 'PROCESSED' END) AS outcome, v.gate_reason AS reason,
  CASE WHEN gate_outcome IS NULL THEN v.category END AS category,
  CASE WHEN done THEN r.document_type END AS document_type, CASE WHEN done THEN r.authentic END AS authentic,
  CASE WHEN done THEN r.confidence END AS confidence, CASE WHEN done THEN array_to_string(r.flags, ' | ') END AS flags,
  CASE WHEN done THEN t.redacted_text END AS redacted_text
FROM (SELECT *, gate_outcome IS NULL AND best >= 2 AS done FROM {ox_gate}) AS v JOIN {ox_report} AS r ON v.doc_id = r.doc_id
JOIN {ox_statement_redacted} AS t ON v.doc_id = t.doc_id
"""
oracle("stream_intake", INTAKE)
oracle("stream_intake_in_parts", INTAKE)
oracle("stream_dedup", """
SELECT doc_id, batch_id, content_hash, first_doc_id, doc_id <> first_doc_id AS is_repeat
FROM (SELECT *, first_value(doc_id) OVER (PARTITION BY batch_id, content_hash ORDER BY created_at, doc_id) AS first_doc_id
  FROM (SELECT doc_id, batch_id, sha256(content) AS content_hash, created_at FROM {fx_file}) AS h) AS f
""")
oracle("stream_dedup_keys", "SELECT DISTINCT batch_id, sha256(content) AS content_hash FROM {fx_file}")
oracle("stream_step_metrics", """
SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS window_start, step, count(*) AS runs, CAST(sum(seconds) AS decimal(28,4)) AS seconds,
  count(*) FILTER (WHERE outcome <> 'ok') AS failures
FROM {fx_step_event} GROUP BY 1, 2
""")
oracle("stream_request_rate", "SELECT * FROM {ox_rate}")
oracle("stream_latency_p95", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(seconds) AS requests, TRUE AS rank_within_error
FROM {fx_step_event} GROUP BY 1 HAVING count(seconds) > 0
""")
oracle("stream_batch_status", "SELECT batch_id, status, jobs FROM {ox_batch}")
oracle("stream_stuck_batches", """
SELECT batch_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, arg_max(status, (ts, event_id)) AS last_status, count(*) AS events
FROM (SELECT *, sum(fresh) OVER (PARTITION BY batch_id ORDER BY ts, event_id) AS session
  FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY batch_id ORDER BY ts, event_id) <= INTERVAL 120 SECOND THEN 0 ELSE 1 END AS fresh
    FROM {fx_status_event}) AS f) AS s
GROUP BY batch_id, session HAVING arg_max(status, (ts, event_id)) IN ('RUNNING', 'QUEUED')
""")
oracle("stream_stuck_now", """
SELECT batch_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_event, arg_max(status, (ts, event_id)) AS last_status, count(*) AS events
FROM {fx_status_event} GROUP BY batch_id
HAVING arg_max(status, (ts, event_id)) IN ('RUNNING', 'QUEUED') AND max(ts) <= (SELECT max(ts) FROM {fx_status_event}) - INTERVAL 120 SECOND
""")
