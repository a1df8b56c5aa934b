"""Test views: loan-document data derived from the given tables.

Each view is one SELECT that Spark and DuckDB both accept. Names in braces are
given tables or earlier views. Every row of the source tables is used.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {}

VIEWS["fx_batch"] = "SELECT c_custkey AS batch_id FROM {customer}"

# One document per order: two kinds of bank statement, paystub, W-2, tax
# return, receipt, by order key. Some have a blank first page or a cover letter.
VIEWS["fx_document"] = """
SELECT *, CASE WHEN doc_id % 101 = 0 THEN ' ' WHEN doc_id % 103 = 0 THEN 'Cover letter' ELSE text END AS first_page_text
FROM (
SELECT doc_id, batch_id, kind, created_at,
  (CASE kind WHEN 0 THEN 'bank_' WHEN 1 THEN 'bank_' WHEN 2 THEN 'paystub_' WHEN 3 THEN 'w2_'
             WHEN 4 THEN 'tax_return_' ELSE 'receipt_' END) || CAST(doc_id AS string) || '.pdf' AS filename,
  CASE WHEN doc_id % 97 = 0 THEN 'text/plain' ELSE 'application/pdf' END AS content_type,
  CASE WHEN doc_id % 89 = 0 THEN 'PNG!' ELSE '%PDF' END AS magic,
  CASE WHEN doc_id % 83 = 0 THEN 500 WHEN doc_id % 79 = 0 THEN 52428801
       ELSE 2048 + doc_id % 100000 END AS size_bytes,
  CASE WHEN doc_id % 13 = 0 THEN 'Microsoft Word' ELSE 'Core Banking 4.2' END AS producer,
  'D:20250401' AS creation_date,
  CASE WHEN doc_id % 17 = 0 THEN 'D:20250402' ELSE 'D:20250401' END AS mod_date,
  CASE
    WHEN kind IN (0, 1) THEN
      'Statement Period: March 2025 Routing Number: 099000999 Account: **** **** **** '
      || CAST(1000 + doc_id % 9000 AS string)
      || ' Opening Balance $' || CAST(opening AS string)
      || (CASE WHEN doc_id % 19 = 0 THEN '' ELSE ' Total Deposits $' || CAST(price AS string) END)
      || ' Total Withdrawals $' || CAST(withdrawn AS string)
      || ' Closing Balance $' || CAST(CAST(opening + price - withdrawn
           + CASE WHEN doc_id % 11 = 0 THEN 500 ELSE 0 END AS decimal(18,2)) AS string)
    WHEN kind = 2 THEN
      'Earnings Statement Pay Period Gross Pay: $' || CAST(price AS string)
      || ' Net Pay: $' || CAST(CAST(price - 100 AS decimal(18,2)) AS string)
      || ' SSN (last 4): ' || CAST(1000 + doc_id % 9000 AS string)
      || (CASE WHEN doc_id % 4 = 0 THEN ' C' || CAST(100 + doc_id % 900 AS string) || ' Nadia Q. Okafor 1609 Juniper Lane, Unit 7C'
          ELSE ' Paid to Nadia Q. Okafor SSN 55' || CAST(1000000 + doc_id % 9000000 AS string) END)
    WHEN kind = 3 THEN
      'Form W-2 Wage and Tax Statement Wages, Tips: $' || CAST(price AS string)
      || ' Medicare Wages: $' || CAST(price AS string)
      || ' Social Security Number: ' || CAST(100 + doc_id % 900 AS string) || '-45-'
      || CAST(1000 + doc_id % 9000 AS string)
    WHEN kind = 4 THEN
      'Form 1040 Adjusted Gross Income: $' || CAST(price AS string)
      || ' Filing Status: Single Call 1-800-555-0192'
    WHEN doc_id % 4 = 1 THEN 'List A 123-45-6789 B 223-45-6789 C 323-45-6789'
    WHEN doc_id % 8 = 3 THEN 'Receipt Subtotal $' || CAST(price AS string)
      || ' Card 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 or 41-11 11-11 11-11 11-11 of account 00'
      || CAST(1000000 + doc_id % 9000000 AS string) || '1 voucher 55' || CAST(10000000 + doc_id % 9000000 AS string)
    ELSE 'Receipt Subtotal $' || CAST(price AS string)
  END AS text
FROM (
  SELECT o_orderkey AS doc_id, o_custkey AS batch_id, o_orderkey % 6 AS kind,
    CAST(o_orderdate AS timestamp) AS created_at,
    CAST(o_totalprice AS decimal(18,2)) AS price,
    CAST(1000 + o_orderkey % 5000 AS decimal(18,2)) AS opening,
    CAST(CASE WHEN o_orderkey % 29 = 0 THEN CAST(o_totalprice AS decimal(18,2)) + 9000
              ELSE CAST(o_totalprice AS decimal(18,2)) - o_orderkey % 900 END AS decimal(18,2)) AS withdrawn
  FROM {orders}
) AS base
) AS whole
"""

# Bank transactions: one per line item.
VIEWS["fx_txn"] = """
SELECT l_orderkey AS doc_id, CAST(l_shipdate AS date) AS txn_date,
  CASE l_partkey % 10 WHEN 0 THEN 'Direct Deposit - Payroll' WHEN 1 THEN 'Rent Payment' WHEN 2 THEN 'NSF Fee'
    WHEN 3 THEN 'Overdraft Fee' WHEN 4 THEN 'ATM Withdrawal' WHEN 5 THEN 'Sportsbook Bet'
    WHEN 6 THEN 'Grocery Purchase' WHEN 7 THEN 'Utility Bill no. ' || CAST(l_partkey AS string) WHEN 8 THEN 'Subscription'
    ELSE 'Wire Deposit' END AS description,
  CAST(CASE WHEN l_partkey % 10 IN (0, 9) THEN CAST(l_quantity AS decimal(18,2)) * 40
            WHEN l_partkey % 10 IN (2, 3) THEN -35
            ELSE -CAST(l_quantity AS decimal(18,2)) * 40 END AS decimal(18,2)) AS amount,
  ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey,
    l_quantity, l_extendedprice, l_discount, l_tax) AS line_no
FROM {lineitem}
"""

# What the extraction step returned, one per order, flat.
VIEWS["fx_extraction"] = """
SELECT o_orderkey AS doc_id, o_custkey AS batch_id, CAST(o_orderdate AS timestamp) AS created_at,
  CASE o_orderkey % 6 WHEN 0 THEN 'bank_statement' WHEN 1 THEN 'bank_statement' WHEN 2 THEN 'paystub'
    WHEN 3 THEN 'w2' WHEN 4 THEN 'tax_return' ELSE 'unknown' END AS document_type,
  CAST(CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN 0
    WHEN o_orderkey % 31 = 0 THEN -50 ELSE 1500 + o_orderkey % 4000 END AS decimal(18,2)) AS monthly_net_estimated,
  CASE WHEN o_orderkey % 6 IN (3, 4) AND o_orderkey % 5 <> 0 THEN CAST(o_totalprice AS decimal(18,2)) END AS annual_gross,
  CASE WHEN o_orderkey % 37 <> 0 THEN 'employer' END AS source,
  CASE o_orderkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'weekly' WHEN 2 THEN 'biweekly' WHEN 3 THEN 'monthly'
    ELSE 'annual' END AS frequency,
  CAST(CASE WHEN o_orderkey % 6 IN (0, 1) AND o_orderkey % 8 <> 0 THEN 1000 + o_orderkey % 5000 END AS decimal(18,2)) AS opening_balance,
  CAST(CASE WHEN o_orderkey % 6 IN (0, 1) AND o_orderkey % 9 <> 0 THEN 2000 + o_orderkey % 5000 END AS decimal(18,2)) AS closing_balance,
  CAST(CASE WHEN o_orderkey % 6 IN (0, 1) AND o_orderkey % 10 <> 0 THEN 1 + o_orderkey % 5 END AS int) AS statement_period_months,
  CAST(CASE WHEN o_orderkey % 41 <> 0 THEN o_orderkey % 4 END AS int) AS nsf_fee_occurrences,
  CAST(CASE WHEN o_orderkey % 41 <> 0 THEN o_custkey % 4 END AS int) AS overdraft_occurrences,
  (o_orderkey % 14 = 0) AS gambling_transactions, (o_orderkey % 15 = 0) AS irregular_large_deposits,
  (o_orderkey % 16 = 0) AS large_cash_withdrawals, (o_orderkey % 21 = 0) AS document_integrity_flag
FROM {orders}
"""

# The same as the JSON text a model would return, with some defects.
VIEWS["fx_raw_extraction"] = """
SELECT doc_id, CASE WHEN doc_id % 43 = 0 THEN substring(body, 1, 40) ELSE body END AS body
FROM (
  SELECT doc_id,
    '{{"document_type":"' || (CASE WHEN doc_id % 53 = 0 THEN 'invoice' ELSE document_type END) || '"'
    || ',"income":{{"monthly_net_estimated":' || COALESCE(CAST(monthly_net_estimated AS string), 'null')
    || ',"annual_gross":' || COALESCE(CAST(annual_gross AS string), 'null')
    || (CASE WHEN source IS NULL THEN '' ELSE ',"sources":["' || source || '"]' END)
    || ',"frequency":' || (CASE WHEN doc_id % 59 = 0 THEN '5' ELSE '"' || frequency || '"' END) || '}}'
    || ',"account_summary":{{"opening_balance":' || COALESCE(CAST(opening_balance AS string), 'null')
    || ',"closing_balance":' || COALESCE(CAST(closing_balance AS string), 'null')
    || ',"average_daily_balance_estimated":null'
    || ',"statement_period_months":' || COALESCE(CAST(statement_period_months AS string), 'null') || '}}'
    || (CASE WHEN doc_id % 61 = 0 THEN '' ELSE
       ',"risk_flags":{{"overdraft_occurrences":' || COALESCE(CAST(overdraft_occurrences AS string), 'null')
    || ',"nsf_fee_occurrences":' || COALESCE(CAST(nsf_fee_occurrences AS string), 'null')
    || ',"large_cash_withdrawals":' || CAST(large_cash_withdrawals AS string)
    || ',"gambling_transactions":' || CAST(gambling_transactions AS string)
    || ',"irregular_large_deposits":' || CAST(irregular_large_deposits AS string)
    || ',"document_integrity_flag":' || CAST(document_integrity_flag AS string) || ',"notes":null}}' END)
    || ',"recurring_expenses":' || (CASE WHEN document_type <> 'bank_statement' THEN '[]'
       ELSE '[{{"category":' || (CASE WHEN doc_id % 67 = 0 THEN '5' ELSE '"rent"' END)
       || (CASE WHEN doc_id % 71 = 0 THEN ',"average_monthly_amount":"abc"' WHEN doc_id % 5 = 0 THEN ',"average_monthly_amount":null' ELSE '' END)
       || (CASE WHEN doc_id % 73 = 0 THEN '' ELSE ',"frequency":"' || (CASE WHEN doc_id % 47 = 0 THEN 'daily' ELSE 'monthly' END) || '"' END) || '}}]' END)
    || '}}' AS body
  FROM {fx_extraction}
) AS built
"""

# One run per document, a second one for every third.
VIEWS["fx_job"] = """
SELECT job_id, document_id, batch_id, created_at, status,
  CASE WHEN status = 'NEEDS_REVIEW' AND document_id % 10 = 0
    THEN 'Missing required documents: Need both Bank Statement and Paystub.' END AS error_message,
  document_type, authentic, auth_confidence, confidence_score, entity_count, pii_types_found, review_status
FROM (
  SELECT o_orderkey * 10 + run AS job_id, o_orderkey AS document_id, o_custkey AS batch_id,
    CAST(o_orderdate AS timestamp) + (CASE run WHEN 2 THEN INTERVAL '1' DAY ELSE INTERVAL '0' DAY END) AS created_at,
    CASE (o_orderkey + o_custkey + run) % 9 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'FAILED'
      WHEN 3 THEN 'NEEDS_REVIEW' WHEN 4 THEN 'NEEDS_REVIEW' ELSE 'SUCCEEDED' END AS status,
    CASE o_orderkey % 6 WHEN 0 THEN 'bank_statement' WHEN 1 THEN 'bank_statement' WHEN 2 THEN 'paystub'
      WHEN 3 THEN 'w2' WHEN 4 THEN 'tax_return' END AS document_type,
    CASE WHEN o_orderkey % 12 <> 0 THEN o_orderkey % 5 <> 0 END AS authentic,
    CAST(CASE WHEN o_orderkey % 12 <> 0 THEN (o_orderkey % 21) * 0.05 END AS decimal(9,4)) AS auth_confidence,
    CAST(CASE WHEN o_orderkey % 12 <> 0 THEN (o_orderkey % 101) * 0.01 END AS decimal(9,4)) AS confidence_score,
    CAST(o_orderkey % 6 AS int) AS entity_count,
    CASE o_orderkey % 4 WHEN 1 THEN 'PERSON' WHEN 2 THEN 'PERSON,US_SSN'
      WHEN 3 THEN 'LOCATION,PERSON,PHONE_NUMBER' END AS pii_types_found,
    CASE WHEN o_orderkey % 25 = 0 THEN 'approved' END AS review_status
  FROM (
    SELECT o_orderkey, o_custkey, o_orderdate, 1 AS run FROM {orders}
    UNION ALL SELECT o_orderkey, o_custkey, o_orderdate, 2 AS run FROM {orders} WHERE o_orderkey % 3 = 0
  ) AS runs
) AS jobs
"""

# A reviewer's decision per order: some for unknown jobs, some twice.
VIEWS["fx_review"] = """
SELECT o_orderkey * 2 + nth AS review_id,
  CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey * 10 + 1000000000 ELSE o_orderkey * 10 + 1 END AS job_id,
  CASE WHEN (o_orderkey + nth) % 3 = 0 THEN 'approved' ELSE 'rejected' END AS decision,
  CASE WHEN o_orderkey % 2 = 0 THEN 'income unclear' END AS notes,
  CAST(o_orderdate AS timestamp) + (CASE nth WHEN 1 THEN INTERVAL '3' DAY ELSE INTERVAL '2' DAY END) AS submitted_at
FROM (
  SELECT o_orderkey, o_orderdate, 0 AS nth FROM {orders}
  UNION ALL SELECT o_orderkey, o_orderdate, 1 AS nth FROM {orders} WHERE o_orderpriority = '1-URGENT'
) AS tries
"""

VIEWS["fx_step_event"] = """
SELECT event_id, ts, job_id, step, seconds,
  CASE WHEN event_id % 10 <> 0 THEN 'ok'
       WHEN step = 'classify' AND event_id % 20 = 0 THEN 'rejected'
       WHEN step = 'extract' AND event_id % 30 = 0 THEN 'leak_block'
       ELSE 'error' END AS outcome
FROM (
  SELECT event_id, CAST(ts AS timestamp) AS ts, user_id AS job_id,
    CASE event_type WHEN 'view' THEN 'parse' WHEN 'click' THEN 'classify' WHEN 'signup' THEN 'authenticate'
      WHEN 'purchase' THEN 'redact' WHEN 'error' THEN 'extract' END AS step,
    CAST(value AS decimal(18,2)) AS seconds
  FROM {events}
) AS base
"""

# Status changes: each user's events as the history of one batch.
VIEWS["fx_status_event"] = """
SELECT event_id, CAST(ts AS timestamp) AS ts, user_id AS batch_id, user_id * 7 + event_id % 5 AS job_id,
  CASE (event_id + user_id) % 9 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'FAILED'
    WHEN 3 THEN 'NEEDS_REVIEW' WHEN 4 THEN 'NEEDS_REVIEW' ELSE 'SUCCEEDED' END AS status,
  CASE WHEN (event_id + user_id) % 9 = 2 THEN '[extract] failed at event ' || CAST(event_id AS string) END AS message
FROM {events}
"""

VIEWS["fx_page"] = """
SELECT conv_id AS doc_id, turn + 1 AS page_num,
  CASE WHEN (conv_id + turn) % 11 = 0 THEN NULL ELSE text END AS text
FROM {conversations}
"""

VIEWS["fx_response"] = """
SELECT conv_id AS doc_id, conv_id * 100 + turn AS job_id, conv_id, turn, text
FROM {conversations} WHERE role = 'assistant'
"""

# Files with real content: exact copies occur; a batch is one language, so a
# few batches hold all rows.
VIEWS["fx_file"] = """
SELECT doc_id, lang AS batch_id, 'bank_' || CAST(doc_id AS string) || '.pdf' AS filename, text AS content,
  CAST('2024-01-01 00:00:00' AS timestamp) AS created_at
FROM {documents}
"""

# Spans of a second detector: a common word, and a stretch around an at sign.
VIEWS["fx_ner_span"] = """
SELECT doc_id, instr(text, 'the ') - 1 AS span_start, instr(text, 'the ') + 2 AS span_end,
  CASE doc_id % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'GPE' WHEN 2 THEN 'LOC' ELSE 'ORG' END AS label
FROM {documents} WHERE instr(text, 'the ') > 0
UNION ALL
SELECT doc_id, instr(text, '@') - 2 AS span_start, instr(text, '@') + 1 AS span_end, 'PERSON' AS label
FROM {documents} WHERE instr(text, '@') > 2
"""

# Figures of a document, some of them impossible.
VIEWS["fx_figures"] = """
SELECT o_orderkey AS doc_id, price AS gross_pay, CAST(price / 4 AS decimal(18,2)) AS deductions,
  CAST(CASE WHEN o_orderkey % 18 = 0 THEN price ELSE price / 2 END AS decimal(18,2)) AS net_pay,
  price AS wages,
  CAST(CASE WHEN o_orderkey % 20 = 0 THEN price + 1 WHEN o_orderkey % 7 = 0 THEN NULL ELSE price END AS decimal(18,2)) AS social_security_wages,
  CAST(o_orderkey % 3000 * 100 AS decimal(18,2)) AS tax, price AS income,
  CASE o_orderkey % 40 WHEN 3 THEN 'This copy was DOCTORED for training' WHEN 9 THEN 'Fraudulent sample'
    ELSE 'Ordinary statement' END AS text
FROM (SELECT o_orderkey, CAST(o_totalprice AS decimal(18,2)) AS price FROM {orders}) AS base
"""

# Statement lines with the balance as printed; some lines were altered.
VIEWS["fx_ledger"] = """
SELECT doc_id, txn_date, line_no, description, amount,
  CAST(1000 + doc_id % 5000
    + SUM(amount) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    + CASE WHEN doc_id % 11 = 0 AND line_no = 2 THEN 10 ELSE 0 END AS decimal(18,2)) AS balance
FROM {fx_txn}
"""

# The statement header: stated totals (some altered) and the period.
VIEWS["fx_statement"] = """
SELECT e.doc_id, e.document_type, CAST(1000 + e.doc_id % 5000 AS decimal(18,2)) AS opening_balance,
  CAST(COALESCE(t.paid_in, 0) AS decimal(18,2)) AS total_deposits,
  CAST(COALESCE(t.paid_out, 0) + CASE WHEN e.doc_id % 7 = 0 THEN 12 ELSE 0 END AS decimal(18,2)) AS total_withdrawals,
  t.period_start, t.period_end
FROM {fx_extraction} AS e
LEFT JOIN (
  SELECT doc_id, SUM(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS paid_in,
    SUM(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS paid_out,
    MIN(txn_date) AS period_start, MAX(txn_date) AS period_end
  FROM {fx_txn} GROUP BY doc_id
) AS t ON e.doc_id = t.doc_id
"""


def references(sql: str) -> list[str]:
    """Names in braces, in order of appearance."""
    return list(dict.fromkeys(name for _, name, _, _ in Formatter().parse(sql) if name))


class Catalog:
    """The given tables and the views of one data folder, built on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._built: dict[str, DataFrame] = {}

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}.parquet"

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = (
                self.spark.read.parquet(self.path(name)) if name in TABLES else self.view(name)
            )
        return self._built[name]

    def view(self, name: str, **sources: DataFrame) -> DataFrame:
        """A view; ``sources`` may replace tables, e.g. by a stream."""
        sql = VIEWS[name]
        return self.spark.sql(sql, **{n: sources.get(n) or self[n] for n in references(sql)})
