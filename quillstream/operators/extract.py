"""From PDF bytes to dataset or failure records. Readers of PDF and OCR are given functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Limits in characters.
MIN_PAGE, MIN_DOCUMENT = 10, 100


def looks_like_pdf(content: Column, content_type: Column) -> Column:
    magic = F.substring(content, 1, 4) == F.lit(b"%PDF")
    return F.coalesce(magic, F.lit(False)) | F.coalesce(F.contains(F.lower(tx.strip(content_type)), F.lit("application/pdf")), F.lit(False))


def kept_pages(pages: Column, least: int = MIN_PAGE) -> Column:
    """Cleaned pages of `least` characters or more."""
    return F.filter(F.transform(pages, tx.clean_page), lambda p: F.length(p) >= least)


def external_pages(pages: Column) -> Column:
    return F.filter(F.transform(pages, tx.clean_external), lambda p: p != "")


def page_rows(d: DataFrame, pages: str) -> DataFrame:
    """A row for each page that isn't blank, with its 1-based number; text as it was read."""
    x = d.select(*[c for c in d.columns if c != pages], F.posexplode(pages).alias("__pos", "page_text"))
    return x.filter(tx.strip(F.col("page_text")) != "").withColumn("page", F.col("__pos") + 1).drop("__pos")


def outcome(d: DataFrame, done: DataFrame | None = None, key: str = "ada") -> DataFrame:
    """d (key, document_url, content, content_type, error, pages) with `outcome`: completed, already_completed or a failure's reason.

    `error` is what fetching or reading reported: download_failed, encrypted_pdf, pdf_read_error or null. pages are the texts read.
    """
    k = F.coalesce(tx.strip(F.col(key).cast("string")), F.lit(""))
    if done is None:
        d = d.withColumn("__done", F.lit(False))
    else:
        marks = done.select(F.col(key).alias("__k")).filter("__k is not null").distinct().withColumn("__done", F.lit(True))
        d = d.join(marks, k == F.col("__k"), "left").drop("__k").withColumn("__done", F.coalesce("__done", F.lit(False)))
    kept = kept_pages(F.col("pages"))
    d = d.withColumns({"pages": kept, "text": F.array_join(kept, "\n\n")})
    url = F.coalesce(tx.strip(F.col("document_url")), F.lit(""))
    why = F.when(k == "", "missing_ada").when(F.col("__done"), "already_completed").when(url == "", "missing_document_url")
    why = why.when((F.col("error") == "download_failed") | F.col("content").isNull() | (F.length("content") == 0), "download_failed")
    why = why.when(~looks_like_pdf(F.col("content"), F.col("content_type")), "invalid_pdf_response").when(F.col("error").isNotNull(), F.col("error"))
    why = why.when(F.coalesce(F.length("text"), F.lit(0)) < MIN_DOCUMENT, "insufficient_extracted_text").otherwise("completed")
    return d.withColumn("outcome", why).drop("__done")


def dataset_records(d: DataFrame) -> DataFrame:
    """Completed rows of outcome() with sizes and digest; the content is dropped."""
    c = d.filter(F.col("outcome") == "completed")
    return c.withColumns({"total_page_count": F.col("total_page_count") if "total_page_count" in d.columns else F.size("pages"), "text_page_count": F.size("pages"), "pdf_size_bytes": F.length("content").cast("long"), "pdf_sha256": F.sha2("content", 256), "text_character_count": F.length("text")}).drop("content", "content_type", "error", "outcome")


def failed_records(d: DataFrame) -> DataFrame:
    return d.filter(~F.col("outcome").isin("completed", "already_completed")).select("ada", "document_url", F.col("outcome").alias("reason"), "error")


def external_record(d: DataFrame) -> DataFrame:
    """(source_id, subject, document_title, organization, pages) to the corpus schema of external documents."""
    return d.select(F.lit(None).cast("string").alias("ada"), "source_id", "subject", "document_title", "organization", F.lit("external_pdf").alias("source"), F.size("pages").alias("total_page_count"), F.size("pages").alias("text_page_count"), F.array_join("pages", "\n\n").alias("text"), F.length(F.array_join("pages", "\n\n")).alias("text_character_count"))


def content(subject: Column, text: Column) -> Column:
    """What is indexed: the subject before the text, where there is one."""
    s = F.coalesce(tx.strip(subject), F.lit(""))
    return F.when(s != "", F.concat(F.lit("Θέμα: "), s, F.lit("\n\nΚείμενο:\n"), text)).otherwise(text)
