"""Model results: conformance, leak scan, provenance, and the figures a
statement's own rows yield."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import fixed_values as V
from docketry.functions.text import any_keyword, match_texts
from docketry.operators.quantiles import exact_quantile

MONEY = "decimal(18,2)"

# Path, type, nullable, allowed values, required.
SCHEMA_RULES = (
    ("document_type", "string", False, V.DOCUMENT_TYPES, True),
    ("analysis_period", "string", True, (), False),
    ("income", "object", False, (), True),
    ("income.monthly_net_estimated", "number", True, (), True),
    ("income.annual_gross", "number", True, (), False),
    ("income.sources", "strings", False, (), True),
    ("income.frequency", "string", False, V.INCOME_FREQUENCIES, True),
    ("account_summary", "object", False, (), True),
    ("account_summary.opening_balance", "number", True, (), True),
    ("account_summary.closing_balance", "number", True, (), True),
    ("account_summary.average_daily_balance_estimated", "number", True, (), True),
    ("account_summary.statement_period_months", "integer", True, (), True),
    ("risk_flags", "object", False, (), True),
    ("risk_flags.overdraft_occurrences", "integer", False, (), True),
    ("risk_flags.nsf_fee_occurrences", "integer", False, (), True),
    ("risk_flags.large_cash_withdrawals", "boolean", False, (), True),
    ("risk_flags.gambling_transactions", "boolean", False, (), True),
    ("risk_flags.irregular_large_deposits", "boolean", False, (), True),
    ("risk_flags.document_integrity_flag", "boolean", False, (), True),
    ("risk_flags.notes", "string", True, (), False),
    ("recurring_expenses", "array", False, (), True),
)

_TYPE_NAMES = {
    "string": "^STRING$",
    "number": "^(BIGINT|DECIMAL.*|DOUBLE)$",
    "integer": "^BIGINT$",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT<",
    "strings": "^ARRAY<(STRING|VOID)>$",
    "array": "^ARRAY<",
}


def extraction_conformance(raw: DataFrame) -> DataFrame:
    """Violations of the response schema per document, in schema order.

    ``raw`` has doc_id and body (JSON text). The body is parsed once, into a
    variant; a child is only judged if its parent is an object.
    """
    parsed = raw.select("doc_id", F.try_parse_json("body").alias("_doc"))
    names = {path: f"_at_{i}" for i, (path, *_) in enumerate(SCHEMA_RULES)}
    opened = parsed.withColumns(
        {
            name: F.try_variant_get("_doc", f"$.{path}", "variant")
            for path, name in names.items()
        }
    )
    kinds = {path: f"_kind_{i}" for i, (path, *_) in enumerate(SCHEMA_RULES)}
    typed = opened.withColumns(
        {kinds[path]: F.schema_of_variant(F.col(name)) for path, name in names.items()}
    )
    found = []
    for path, kind, nullable, allowed, required in SCHEMA_RULES:
        shape = F.col(kinds[path])
        parent = path.rpartition(".")[0]
        judged = F.col(kinds[parent]).rlike(_TYPE_NAMES["object"]) if parent else F.lit(True)
        is_null = shape == "VOID"
        wrong = ~shape.rlike(_TYPE_NAMES[kind]) & (~is_null if nullable else F.lit(True))
        checks = F.when(wrong, f"type:{path}")
        if required:
            checks = F.when(shape.isNull(), f"missing:{path}").when(wrong, f"type:{path}")
        if allowed:
            value = F.try_variant_get(F.col(names[path]), "$", "string")
            checks = checks.when((shape == "STRING") & ~value.isin(*allowed), f"enum:{path}")
        found.append(F.when(judged, checks))
    found.extend(_expense_violations(F.col(names["recurring_expenses"]), F.col(kinds["recurring_expenses"])))
    return typed.select(
        "doc_id",
        F.when(F.col("_doc").isNull(), F.array(F.lit("invalid_json")))
        .otherwise(F.array_compact(F.array(*found)))
        .alias("violations"),
    )


# Name, type, nullable, allowed values, required.
EXPENSE_RULES = (
    ("category", "string", False, (), True),
    ("average_monthly_amount", "number", True, (), False),
    ("frequency", "string", False, V.EXPENSE_FREQUENCIES, True),
)


def _expense_violations(expenses: Column, shape: Column) -> list[Column]:
    """Violations that some item of the list has, each named once."""
    items = F.try_variant_get(expenses, "$", "array<variant>")
    listed = shape.rlike(_TYPE_NAMES["array"])

    def some(test) -> Column:
        return listed & F.coalesce(F.exists(items, test), F.lit(False))

    def is_object(item: Column) -> Column:
        return F.schema_of_variant(item).rlike(_TYPE_NAMES["object"])

    def kind_of(item: Column, name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant"))

    def expense_checks(name: str, kind: str, nullable: bool, allowed: tuple, required: bool) -> list[Column]:
        path = f"recurring_expenses.{name}"
        accepted = f"{_TYPE_NAMES[kind]}|^VOID$" if nullable else _TYPE_NAMES[kind]
        checks = [F.when(some(lambda i: is_object(i) & ~kind_of(i, name).rlike(accepted)), f"type:{path}")]
        if required:
            checks.insert(0, F.when(some(lambda i: is_object(i) & kind_of(i, name).isNull()), f"missing:{path}"))
        if allowed:

            def other_value(i: Column) -> Column:
                value = F.try_variant_get(i, f"$.{name}", "string")
                return (kind_of(i, name) == "STRING") & ~value.isin(*allowed)

            checks.append(F.when(some(other_value), f"enum:{path}"))
        return checks

    found = [F.when(some(lambda i: ~F.coalesce(is_object(i), F.lit(False))), "type:recurring_expenses[]")]
    for rule in EXPENSE_RULES:
        found.extend(expense_checks(*rule))
    return found


def output_pii_scan(responses: DataFrame, text: str = "text") -> DataFrame:
    """Add ``warnings`` (pattern order, then position) and ``blocked``."""
    found = [
        f"transform({match_texts(text, pattern)}, hit_ -> concat('Potential {label} found in LLM output: \\'', "
        f"left(hit_, {V.LEAK_SAMPLE_CHARS}), '\\''))"
        for label, pattern in V.OUTPUT_LEAK_PATTERNS
    ]
    return responses.withColumn("warnings", F.expr(f"concat({', '.join(found)})")).withColumn(
        "blocked", F.size("warnings") > 0
    )


def stamp_provenance(results: DataFrame, model: str, prompt_version: str) -> DataFrame:
    """Add ``_meta``: which model and prompt made this result for which job."""
    return results.withColumn(
        "_meta",
        F.struct(
            F.lit(model).alias("model"),
            F.lit(prompt_version).alias("prompt_version"),
            F.col("doc_id"),
            F.col("job_id"),
        ),
    )


def normalize_income(extractions: DataFrame) -> DataFrame:
    """Monthly net and cadence: annual documents give a twelfth of the year."""
    annual = F.col("document_type").isin("w2", "tax_return")
    return extractions.withColumns(
        {
            "monthly_net": F.when(annual, F.round(F.col("annual_gross").cast(MONEY) / 12, 2).cast(MONEY))
            .otherwise(F.col("monthly_net_estimated")),
            "cadence": F.when(annual, "annual").otherwise(F.col("frequency")),
        }
    )


def statement_period_months(statements: DataFrame) -> DataFrame:
    """Distinct calendar months between period_start and period_end, bank
    statements only."""
    months = F.months_between(F.trunc("period_end", "MM"), F.trunc("period_start", "MM")).cast("int") + 1
    return statements.withColumn(
        "statement_period_months", F.when(F.col("document_type") == "bank_statement", months)
    )


# Words that mark a transaction; lists of our own, free to extend.
GAMBLING_WORDS = ("sportsbook", "casino", "betting", "draftkings", "fanduel", "betmgm", "pokerstars", "lottery")
CASH_WORDS = ("atm", "cash withdrawal", "cash advance")
PAYROLL_WORDS = ("direct deposit", "payroll")


def _mentions(words: tuple[str, ...]) -> Column:
    return F.expr(any_keyword("description", words))


def risk_event_counts(documents: DataFrame, transactions: DataFrame) -> DataFrame:
    """NSF and overdraft counts, large cash withdrawals and gambling per
    document; 0 and false for other types and for statements without rows."""
    cash = _mentions(CASH_WORDS) & (F.col("amount") < -F.lit(V.LARGE_CASH_AMOUNT).cast(MONEY))
    observed = transactions.groupBy("doc_id").agg(
        F.count_if(_mentions(("nsf",))).alias("nsf"),
        F.count_if(_mentions(("overdraft",))).alias("overdrafts"),
        F.bool_or(cash).alias("cash"),
        F.bool_or(_mentions(GAMBLING_WORDS)).alias("gambling"),
    )
    is_bank = F.coalesce(F.col("document_type") == "bank_statement", F.lit(False))
    return documents.select("doc_id", "document_type").join(observed, "doc_id", "left").select(
        "doc_id",
        F.when(is_bank, F.coalesce("nsf", F.lit(0))).otherwise(0).alias("nsf_fee_occurrences"),
        F.when(is_bank, F.coalesce("overdrafts", F.lit(0))).otherwise(0).alias("overdraft_occurrences"),
        (is_bank & F.coalesce("cash", F.lit(False))).alias("large_cash_withdrawals"),
        (is_bank & F.coalesce("gambling", F.lit(False))).alias("gambling_transactions"),
    )


def of_bank_statements(documents: DataFrame, transactions: DataFrame) -> DataFrame:
    """The transactions of documents whose type is bank_statement."""
    banks = documents.where("document_type = 'bank_statement'").select("doc_id")
    return transactions.join(banks, "doc_id", "left_semi")


def irregular_large_deposits(documents: DataFrame, transactions: DataFrame, factor: str = "3") -> DataFrame:
    """Whether a document has a deposit other than payroll above ``factor``
    times its median deposit: one row for every document, false for other types
    than bank statements and without deposits. Only aggregates per document
    meet in the joins."""
    deposits = of_bank_statements(documents, transactions.where("amount > 0"))
    unexplained = ~_mentions(PAYROLL_WORDS)
    largest = deposits.groupBy("doc_id").agg(
        F.max(F.when(unexplained, F.col("amount"))).alias("largest_unexplained")
    )
    median = exact_quantile(deposits, ["doc_id"], "amount", 50, "median_deposit")
    return documents.select("doc_id").join(largest, "doc_id", "left").join(median, "doc_id", "left").select(
        "doc_id",
        "median_deposit",
        "largest_unexplained",
        F.coalesce(
            F.col("largest_unexplained") > F.col("median_deposit") * F.lit(factor).cast("decimal(6,2)"),
            F.lit(False),
        ).alias("irregular_large_deposits"),
    )


def average_daily_balance(statements: DataFrame, transactions: DataFrame) -> DataFrame:
    """Mean end-of-day balance from period_start to period_end.

    A transaction on day d counts on every day from d to the end, so the mean
    is opening + sum(amount * days left) / days: sums only, no row per day and
    no window. Transactions are netted per day before they meet their
    statement; those outside the period do not count.
    """
    daily = transactions.groupBy("doc_id", "txn_date").agg(F.sum("amount").alias("net"))
    joined = daily.join(
        statements.select("doc_id", "period_start", "period_end"), "doc_id", "inner"
    ).where("txn_date BETWEEN period_start AND period_end")
    days_left = F.datediff("period_end", "txn_date") + 1
    weighted = joined.groupBy("doc_id").agg(F.sum(F.col("net") * days_left).alias("_weighted"))
    days = F.datediff("period_end", "period_start") + 1
    mean = F.col("opening_balance") + F.coalesce("_weighted", F.lit(0)) / days.cast("decimal(9,0)")
    return statements.join(weighted, "doc_id", "left").select(
        "doc_id", F.round(mean, 2).cast(MONEY).alias("average_daily_balance")
    )


def expense_category(description: Column) -> Column:
    """The words of a description that stay from payment to payment.

    Dates, amounts and reference numbers (words with a digit) go, with a label such
    as REF in front of them; a description of nothing else stays as it is.
    """
    words = F.regexp_replace(description, V.CHANGING_WORDS, " ")
    plain = F.btrim(F.regexp_replace(F.btrim(F.regexp_replace(words, r"\s+", " ")), V.LOOSE_ENDS, ""))
    return F.when(plain == "", description).otherwise(plain)


def recurring_expenses(documents: DataFrame, transactions: DataFrame) -> DataFrame:
    """Average monthly amount and cadence per bank statement and expense
    category (``expense_category``, whatever its case); other types have none.

    Expenses are netted per day before anything is sorted, so a category has
    at most one row per calendar day. A category seen on one day only is not
    recurring. Cadence is the median gap between days with an expense.
    """
    named = of_bank_statements(documents, transactions.where("amount < 0")).withColumn(
        "category", expense_category(F.col("description"))
    )
    daily = named.groupBy("doc_id", F.lower("category").alias("kind"), "txn_date").agg(
        F.sum(-F.col("amount")).alias("spent"), F.min("category").alias("category")
    )
    in_order = Window.partitionBy("doc_id", "kind").orderBy("txn_date")
    gaps = daily.withColumn("gap", F.datediff("txn_date", F.lag("txn_date").over(in_order)))
    grouped = gaps.groupBy("doc_id", "kind").agg(
        F.min("category").alias("category"),
        F.sum("spent").alias("spent"),
        F.min("txn_date").alias("first"),
        F.max("txn_date").alias("last"),
        F.median("gap").alias("typical_gap"),
    )
    months = F.months_between(F.trunc("last", "MM"), F.trunc("first", "MM")).cast("int") + 1
    gap = F.col("typical_gap")
    return grouped.where("typical_gap IS NOT NULL").select(
        "doc_id",
        "category",
        F.round(F.col("spent") / months.cast("decimal(6,0)"), 2).cast(MONEY).alias("average_monthly_amount"),
        F.when(gap.between(5, 9), "weekly")
        .when(gap.between(12, 17), "biweekly")
        .when(gap.between(26, 35), "monthly")
        .otherwise("irregular")
        .alias("frequency"),
    )


def document_integrity_rules(figures: DataFrame) -> DataFrame:
    """Names of the broken rules and the flag.

    ``figures`` has doc_id, document_type, text, gross_pay, deductions, net_pay, wages,
    social_security_wages, tax, income; a missing figure breaks no rule.
    """
    rules = F.array_compact(
        F.array(
            F.when(F.expr(any_keyword("text", V.SELF_LABELS)), "SELF_LABELLED"),
            F.when(F.col("net_pay") > F.col("gross_pay") - F.col("deductions"), "NET_ABOVE_GROSS"),
            F.when(F.col("social_security_wages") > F.col("wages"), "SS_WAGES_ABOVE_WAGES"),
            F.when(F.col("tax") > F.col("income"), "TAX_ABOVE_INCOME"),
        )
    )
    return figures.select("doc_id", rules.alias("broken_rules")).withColumn(
        "document_integrity_flag", F.size("broken_rules") > 0
    )


def statement_total_audit(statements: DataFrame, lines: DataFrame) -> DataFrame:
    """Stated totals against the rows, and the printed running balance.

    ``statements``: doc_id, opening_balance, total_deposits, total_withdrawals.
    ``lines``: doc_id, txn_date, line_no, amount, balance (as printed). Lines
    are netted per day first, with the last printed balance of the day, so the
    sorted part has at most one row per document and calendar day.
    """
    daily = lines.groupBy("doc_id", "txn_date").agg(
        F.sum("amount").alias("net"),
        F.sum(F.greatest(F.col("amount"), F.lit(0).cast(MONEY))).alias("paid_in"),
        F.sum(F.greatest(-F.col("amount"), F.lit(0).cast(MONEY))).alias("paid_out"),
        F.max_by("balance", "line_no").alias("printed"),
    )
    in_order = Window.partitionBy("doc_id").orderBy("txn_date")
    compared = daily.withColumn("previous", F.lag("printed").over(in_order))
    # The first day continues the opening balance, known after the join.
    per_document = compared.groupBy("doc_id").agg(
        F.sum("paid_in").alias("rows_in"),
        F.sum("paid_out").alias("rows_out"),
        F.sum(F.when(F.col("previous").isNull(), F.col("printed") - F.col("net"))).alias("implied_opening"),
        F.count_if(F.col("printed") != F.col("previous") + F.col("net")).alias("balance_breaks"),
    )
    zero = F.lit(0).cast(MONEY)
    return statements.join(per_document, "doc_id", "left").select(
        "doc_id",
        (F.coalesce("rows_in", zero) != F.col("total_deposits")).alias("deposits_differ"),
        (F.coalesce("rows_out", zero) != F.col("total_withdrawals")).alias("withdrawals_differ"),
        (
            F.coalesce("balance_breaks", F.lit(0))
            + F.when(F.col("implied_opening") != F.col("opening_balance"), 1).otherwise(0)
        ).alias("balance_breaks"),
    )
