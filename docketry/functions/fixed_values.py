"""Word lists, patterns, limits and messages the results depend on.

Everything here is data. The rules that use it live in the other modules.
"""

# --- fixed values: upload screening -----------------------------------------

ACCEPTED_CONTENT_TYPE = "application/pdf"
ACCEPTED_MAGIC = "%PDF"
MIN_FILE_BYTES = 1024
MAX_FILE_BYTES = 50 * 1024 * 1024
SSN_PATTERN = r"\b\d{3}-\d{2}-\d{4}\b"
SSN_DUMP_COUNT = 3

STRONG_KEYWORDS = (
    "balance", "account number", "routing", "deposit", "withdrawal",
    "statement", "transaction",
    "gross pay", "net pay", "ytd", "pay period", "payroll",
    "deduction", "earnings",
    "wages", "withholding", "adjusted gross", "taxable income",
    "federal income tax", "form 1040", "w-2", "employer identification",
)

SUPPORTING_KEYWORDS = (
    "income", "employer", "employee", "federal", "tax", "payment",
    "amount", "total", "salary", "compensation", "benefits", "irs",
)

REJECT_CONTENT_TYPE = "GUARDRAIL_REJECTED: File must be a PDF (invalid content type)"
REJECT_MAGIC = "GUARDRAIL_REJECTED: File must be a PDF (invalid magic bytes)"
REJECT_TOO_SMALL = "GUARDRAIL_REJECTED: File is too small (minimum 1 KB)"
REJECT_TOO_LARGE = "GUARDRAIL_REJECTED: File is too large (maximum 50 MB)"
REJECT_NO_TEXT = "GUARDRAIL_REJECTED: No extractable text found on page 1"
REJECT_PII_DUMP = (
    "GUARDRAIL_REJECTED: Document appears to be a PII data dump (",
    " SSNs found with no financial document structure). "
    "Only genuine financial documents are accepted.",
)
REJECT_NOT_FINANCIAL = (
    "GUARDRAIL_REJECTED: Document does not appear to be a supported "
    "financial document (bank statement, paystub, W-2, or tax return)"
)

MISSING_DOCUMENTS_MESSAGE = (
    "Missing required documents: Need both Bank Statement and Paystub."
)

# --- fixed values: relevance gate -------------------------------------------

RELEVANCE_MIN_MATCHES = 2

RELEVANCE_KEYWORDS = {
    "bank_statement": (
        "account balance", "checking account", "savings account",
        "available balance", "statement period", "beginning balance",
        "ending balance", "withdrawal", "routing number", "overdraft",
        "direct deposit", "account number", "daily balance",
    ),
    "paystub": (
        "gross pay", "net pay", "pay period", "pay date", "year to date",
        "ytd", "federal income tax", "social security", "medicare",
        "deductions", "hours worked", "earnings statement", "pay stub",
        "payroll",
    ),
    "w2": (
        "form w-2", "wages, tips", "federal income tax withheld",
        "social security wages", "medicare wages", "employer identification",
        "wage and tax statement",
    ),
    "tax_return": (
        "form 1040", "adjusted gross income", "taxable income",
        "filing status", "standard deduction", "tax refund", "schedule a",
        "schedule b", "schedule c", "form 1099",
    ),
}

NOT_FINANCIAL_MESSAGE = (
    "[classify] Document is not a financial statement: classified as '",
    "'. Upload a bank statement, paystub, W-2, or tax return.",
)

MESSAGE_LIMIT = 1024

# --- fixed values: authenticity ---------------------------------------------

TYPE_KEYWORDS = {
    "bank_statement": (
        "routing number", "account number", "opening balance",
        "closing balance", "statement period", "deposit", "withdrawal",
        "transaction", "routing", "beginning balance", "ending balance",
        "available balance",
    ),
    "paystub": (
        "gross pay", "net pay", "ytd", "year to date", "pay period",
        "deductions", "earnings", "hours worked", "pay date", "regular pay",
        "overtime", "federal income tax", "fica",
    ),
    "w2": (
        "wages, tips", "federal income tax withheld",
        "employer identification", "social security wages", "medicare wages",
        "w-2", "wage and tax statement", "employee's social security",
        "allocated tips",
    ),
    "tax_return": (
        "adjusted gross income", "taxable income", "form 1040", "schedule",
        "standard deduction", "itemized deductions", "tax liability",
        "total income", "agi", "filing status",
    ),
}
TYPE_FULL_HITS = 3

AMOUNT_PATTERNS = {
    "opening_balance": (
        r"(?:opening|beginning|starting|prior)\s+balance[^\d\-]*\$?([\d,]+\.?\d*)",
    ),
    "closing_balance": (
        r"(?:closing|ending|final)\s+balance[^\d\-]*\$?([\d,]+\.?\d*)",
    ),
    "total_deposits": (
        r"total\s+(?:deposits?|credits?)[^\d\-]*\$?([\d,]+\.?\d*)",
        r"(?:deposits?|credits?)\s+total[^\d\-]*\$?([\d,]+\.?\d*)",
    ),
    "total_withdrawals": (
        r"total\s+(?:withdrawals?|debits?|charges?)[^\d\-]*\$?([\d,]+\.?\d*)",
        r"(?:withdrawals?|debits?)\s+total[^\d\-]*\$?([\d,]+\.?\d*)",
    ),
}
BALANCE_TOLERANCE = "1.00"

SUSPICIOUS_PRODUCERS = (
    "adobe acrobat", "microsoft word", "libreoffice", "openoffice",
    "photoshop", "gimp", "canva", "inkscape", "paint", "preview",
    "google docs", "pages",
)

AUTHENTIC_MIN_CONFIDENCE = "0.60"
DEDUCT_UNKNOWN_TYPE = "0.45"
DEDUCT_WEAK_TYPE = "0.10"
DEDUCT_BALANCE_MISMATCH = "0.45"
DEDUCT_BALANCE_MISSING = "0.10"
DEDUCT_EDITING_TOOL = "0.30"
DEDUCT_MODIFIED = "0.20"

NOTE_BALANCE_MISSING = "Could not find all four balance fields in document"
NOTE_BALANCE_OK = "Balances reconcile within rounding tolerance"
FLAG_TYPE_UNKNOWN = "Document type could not be determined from content"
FLAG_BALANCE_MISSING = "Balance fields not found — could not verify math"
FLAG_EDITING_TOOL = (
    "PDF produced by editing tool: '",
    "' — legitimate financial documents come from bank/payroll systems",
)
FLAG_MODIFIED = "PDF was modified after creation (ModDate != CreationDate)"

# --- fixed values: model output ----------------------------------------------

DOCUMENT_TYPES = ("bank_statement", "paystub", "w2", "tax_return", "unknown")
INCOME_FREQUENCIES = ("weekly", "biweekly", "monthly", "annual", "irregular", "unknown")
EXPENSE_FREQUENCIES = ("weekly", "biweekly", "monthly", "irregular")

OUTPUT_LEAK_PATTERNS = (
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("PHONE_HYPHENS", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b"),
    ("ACCOUNT_MASKED", r"\*{4}\s\*{4}\s\*{4}\s\d{4}"),
    ("ROUTING", r"(?i)(?:routing|aba|rtn)[^\d]{0,10}\d{9}\b"),
)
LEAK_SAMPLE_CHARS = 30

LARGE_CASH_AMOUNT = "1000.00"
SELF_LABELS = ("doctored", "fraudulent", "test fraud")

# --- fixed values: scorecard -------------------------------------------------

SCORE_THRESHOLD = "0.80"
MIN_STATEMENT_MONTHS = 3
AUTH_FULL_CONFIDENCE = "0.80"
HARD_STOP_FLAGS = (
    "INTEGRITY_FAIL", "AUTH_FAILED", "DOC_TYPE_UNKNOWN", "INSUFFICIENT_HISTORY",
)
LOW_RISK_SCORE = "0.90"
SEVERITY_ORDER = ("critical", "high", "medium", "low", "none")

REVIEW_MESSAGES = {
    "INSUFFICIENT_HISTORY": "Bank statement covers fewer months than required for underwriting",
    "INTEGRITY_FAIL": "Document failed integrity checks (math or self-contradictions)",
    "AUTH_FAILED": "Document failed authenticity verification",
    "DOC_TYPE_UNKNOWN": "Document type could not be classified",
    "INCOME_MISSING": "Monthly income could not be extracted",
    "INCOME_ZERO": "Income reported as $0 — manual verification needed",
    "BALANCE_DATA_MISSING": "Bank statement missing opening or closing balance",
    "NSF_FEES_HIGH": "Elevated NSF fee activity",
    "OVERDRAFTS_HIGH": "Elevated overdraft activity",
    "GAMBLING_TRANSACTIONS": "Gambling transactions detected",
    "LOW_FIELD_COVERAGE": "Many required fields could not be extracted",
}
REVIEW_NOT_AUTHENTIC = "Document failed authenticity verification"
REVIEW_NO_SCORE = "Confidence score unavailable"

# --- fixed values: application ------------------------------------------------

INCOME_SOURCE_PRIORITY = ("paystub", "w2", "tax_return", "bank_statement")
DOC_SET_COMPLETE_DETAIL = "Both income and bank-statement evidence provided"
DOC_SET_INCOMPLETE_DETAIL = "Document set is incomplete for full underwriting"

# --- fixed values: lifecycle and dashboard -------------------------------------

JOB_STATUSES = ("QUEUED", "RUNNING", "SUCCEEDED", "FAILED", "NEEDS_REVIEW")
TERMINAL_STATUSES = ("SUCCEEDED", "FAILED", "NEEDS_REVIEW")
STEPS = ("parse", "classify", "authenticate", "redact", "extract")
CONFIDENCE_BUCKETS = (
    "0.0–0.1", "0.1–0.2", "0.2–0.3", "0.3–0.4", "0.4–0.5",
    "0.5–0.6", "0.6–0.7", "0.7–0.8", "0.8–0.9", "0.9–1.0",
)
PII_RANKING_SHOWN = 8
VOLUME_DAYS = 14
SCRAPE_SECONDS = 15
RATE_WINDOW_SECONDS = 120
LATENCY_WINDOW_SECONDS = 300
STUCK_AFTER_SECONDS = 120

# What changes from payment to payment in a description: words with a digit, with
# the label in front of them; then signs left at the end. Ours.
CHANGING_WORDS = r"(?i)(\b(?:ref|reference|no|nr|id|conf|trace|inv|invoice|txn|trn)\b[.:#]*\s*)?\S*[0-9]\S*"
LOOSE_ENDS = r"[ .:#*/-]+$"
