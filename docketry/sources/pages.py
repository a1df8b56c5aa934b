"""Page texts to document texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble_pages(pages: DataFrame) -> DataFrame:
    """One text per document: its pages in order, each under a header line,
    blank lines between them; a page without text stays as a header.
    ``first_page_text`` is the plain text of the first page.

    A document's pages meet in one row because the text is one value; that an
    upload is at most 50 MB is a contract of the input, not checked here.
    """
    in_order = F.array_sort(F.collect_list(F.struct("page_num", F.coalesce("text", F.lit("")).alias("text"))))
    headed = F.transform(
        "_pages",
        lambda page: F.concat(
            F.lit("--- Page "), page["page_num"].cast("string"), F.lit(" ---\n"), page["text"]
        ),
    )
    return (
        pages.groupBy("doc_id")
        .agg(in_order.alias("_pages"))
        .select(
            "doc_id",
            F.array_join(headed, "\n\n").alias("text"),
            F.col("_pages")[0]["text"].alias("first_page_text"),
        )
    )
