"""Upload gates: screening rules, duplicate files, required sets, relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import fixed_values as V
from docketry.functions.sql import case, let, quoted, strings, struct
from docketry.functions.text import any_keyword, is_blank, keyword_hits, match_texts


def ssn_count(text: str = "text") -> str:
    """Number of SSN-shaped values; no dash, no search."""
    return f"(CASE WHEN contains({text}, '-') THEN size({match_texts(text, V.SSN_PATTERN)}) ELSE 0 END)"


def first_broken_rule(text: str = "text") -> str:
    """Reason of the first failing screening rule, NULL if all hold.

    CASE WHEN stops at the first hit, so the text is only searched in files
    whose type, magic bytes and size are right, and SSNs are only counted in
    texts without a strong keyword.
    """
    before, after = V.REJECT_PII_DUMP
    dump = let(
        "ssns_",
        ssn_count(text),
        case(
            [(f"ssns_ >= {V.SSN_DUMP_COUNT}", f"concat({quoted(before)}, string(ssns_), {quoted(after)})")],
            quoted(V.REJECT_NOT_FINANCIAL),
        ),
    )
    return case(
        [
            (f"NOT content_type <=> {quoted(V.ACCEPTED_CONTENT_TYPE)}", quoted(V.REJECT_CONTENT_TYPE)),
            (f"NOT magic <=> {quoted(V.ACCEPTED_MAGIC)}", quoted(V.REJECT_MAGIC)),
            (f"size_bytes < {V.MIN_FILE_BYTES}", quoted(V.REJECT_TOO_SMALL)),
            (f"size_bytes > {V.MAX_FILE_BYTES}", quoted(V.REJECT_TOO_LARGE)),
            (is_blank(text), quoted(V.REJECT_NO_TEXT)),
            (any_keyword(text, V.STRONG_KEYWORDS), "NULL"),
        ],
        dump,
    )


def first_page(documents: DataFrame) -> str:
    """The column that upload rules look at: page 1 (``first_page_text``, which
    ``assemble_pages`` supplies), or the text where pages are not told apart."""
    return "first_page_text" if "first_page_text" in documents.columns else "text"


def guardrail_screen(documents: DataFrame) -> DataFrame:
    """Add ``reason`` (of the first rule broken) and ``accepted``."""
    broken = first_broken_rule(first_page(documents))
    return documents.withColumn("reason", F.expr(broken)).withColumn(
        "accepted", F.col("reason").isNull()
    )


def pii_dump_screen(documents: DataFrame) -> DataFrame:
    """Number of SSN-shaped values and whether the page is a bare list of them."""
    page = first_page(documents)
    counted = documents.withColumn("ssn_count", F.expr(ssn_count(page)))
    return counted.withColumn(
        "is_pii_dump",
        F.expr(f"ssn_count >= {V.SSN_DUMP_COUNT} AND NOT {any_keyword(page, V.STRONG_KEYWORDS)}"),
    )


def financial_keyword_screen(documents: DataFrame) -> DataFrame:
    """Counts of strong and supporting keywords; one strong hit is enough."""
    hits = keyword_hits(first_page(documents), (V.STRONG_KEYWORDS, V.SUPPORTING_KEYWORDS))
    return documents.withColumn("_hits", F.expr(hits)).selectExpr(
        *documents.columns,
        "_hits[0] AS strong_hits",
        "_hits[1] AS supporting_hits",
        "_hits[0] >= 1 AS is_financial",
    )


def with_content_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("content_hash", F.sha2(F.col(content), 256))


def duplicate_files_in_batch(files: DataFrame) -> DataFrame:
    """Files whose content came earlier in the same batch; one row per repeat.

    ``files`` has batch_id, doc_id, filename, content_hash. The first file of
    each hash is found by a partially aggregated minimum, so a batch or a hash
    that holds a large part of all rows is cut down before the shuffle. The
    join back keeps the big side on the left, where a hot key can be split.
    """
    slim = files.select("batch_id", "doc_id", "filename", "content_hash")
    repeated = (
        slim.groupBy("batch_id", "content_hash")
        .agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("copies"))
        .where("copies > 1")
    )
    return slim.join(repeated, ["batch_id", "content_hash"], "inner").where(
        "doc_id <> first_doc_id"
    )


def rejected_batches(duplicates: DataFrame) -> DataFrame:
    """Batches with at least one repeated file, and the first one found."""
    return duplicates.groupBy("batch_id").agg(
        F.count("*").alias("repeats"),
        F.min(F.struct("doc_id", "filename")).alias("_first"),
    ).select(
        "batch_id",
        "repeats",
        F.concat(F.lit("Duplicate file detected: "), F.col("_first.filename")).alias("reason"),
    )


def batch_gate(documents: DataFrame) -> DataFrame:
    """Add ``gate_reason`` (NULL if the document may enter the pipeline) and
    ``gate_outcome``.

    A repeated file rejects its whole batch; a file that breaks a screening
    rule is rejected; a batch without a bank statement and a paystub waits for
    review. ``documents`` has the columns of ``guardrail_screen``, batch_id,
    doc_id, filename and whole batches. Hashes, names and verdicts meet per
    batch; the facts of the batches are joined to the documents. A column
    ``content_hash`` is taken as it is: who shuffles the documents first adds it
    before, so that these facts are found without another shuffle of texts.
    """
    if "content_hash" not in documents.columns:
        documents = with_content_hash(documents, "text")
    named = documents.select("doc_id", "batch_id", "filename", "content_hash")
    screened = guardrail_screen(documents.drop("content_hash"))
    repeated = rejected_batches(duplicate_files_in_batch(named)).select(
        "batch_id", F.col("reason").alias("_repeated")
    )
    lacking = (
        required_document_set(named)
        .where(~F.col("requirements_met"))
        .groupBy("batch_id")
        .agg(F.first("error_message").alias("_lacking"))
    )
    return (
        screened.join(repeated, "batch_id", "left")
        .join(lacking, "batch_id", "left")
        .withColumn("gate_reason", F.coalesce("_repeated", "reason", "_lacking"))
        .withColumn(
            "gate_outcome",
            F.when(F.coalesce("_repeated", "reason").isNotNull(), "REJECTED").when(
                F.col("_lacking").isNotNull(), "NEEDS_REVIEW"
            ),
        )
        .drop("_repeated", "_lacking")
    )


def type_from_filename(filename: Column) -> Column:
    lowered = F.lower(filename)
    return F.when(lowered.contains("bank"), "bank_statement").when(
        lowered.contains("pay"), "paystub"
    )


def required_document_set(documents: DataFrame) -> DataFrame:
    """Initial job status per document: QUEUED, or NEEDS_REVIEW if the batch
    lacks a bank statement or a paystub.

    Only keys and names are shuffled, never the text. The documents are on the
    left of the join, where a batch with very many of them can be split.
    """
    guessed = documents.select(
        "doc_id", "batch_id", "filename", type_from_filename(F.col("filename")).alias("guessed_type")
    )
    per_batch = guessed.groupBy("batch_id").agg(
        (
            F.coalesce(F.bool_or(F.col("guessed_type") == "bank_statement"), F.lit(False))
            & F.coalesce(F.bool_or(F.col("guessed_type") == "paystub"), F.lit(False))
        ).alias("requirements_met")
    )
    return guessed.join(per_batch, "batch_id", "inner").select(
        guessed["*"],
        "requirements_met",
        F.when(F.col("requirements_met"), "QUEUED").otherwise("NEEDS_REVIEW").alias("status"),
        F.when(~F.col("requirements_met"), V.MISSING_DOCUMENTS_MESSAGE).alias("error_message"),
    )


def relevance(text: str = "text") -> str:
    """struct<is_financial, category>: the category with most keywords, ties to
    the one listed first; fewer than two hits mean ``unknown``."""
    enough = f"coalesce(array_max(hits_) >= {V.RELEVANCE_MIN_MATCHES}, false)"
    winner = f"get({strings(V.RELEVANCE_KEYWORDS)}, int(array_position(hits_, array_max(hits_)) - 1))"
    return let(
        "hits_",
        keyword_hits(text, V.RELEVANCE_KEYWORDS.values()),
        struct(is_financial=enough, category=case([(enough, winner)], "'unknown'")),
    )


def relevance_classify(documents: DataFrame) -> DataFrame:
    """Add is_financial and category."""
    return documents.withColumn("_relevance", F.expr(relevance())).select(
        *documents.columns, "_relevance.is_financial", "_relevance.category"
    )


def relevance_quarantine(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into accepted documents and rejected ones with status and message."""
    before, after = V.NOT_FINANCIAL_MESSAGE
    rejected = classified.where(~F.col("is_financial")).withColumns(
        {
            "status": F.lit("FAILED"),
            "error_message": F.left(
                F.concat(F.lit(before), F.col("category"), F.lit(after)),
                F.lit(V.MESSAGE_LIMIT),
            ),
        }
    )
    return classified.where("is_financial"), rejected
