"""Replacing records by key, with integrity checks, and the union with external records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .ingest import keep_last


def replace_by_key(original: DataFrame, repaired: DataFrame, key: str, order: str) -> DataFrame:
    """Each original row, or the last repaired row of its key in place of it, whole. Blank keys never match.

    Both sides have the same columns; `order` is a column of the repaired side alone. `replaced` says what happened.
    """
    cols = original.columns
    good = repaired.filter(F.coalesce(tx.strip(F.col(key).cast("string")), F.lit("")) != "")
    last = keep_last(good, key, order).select(F.col(key).alias("__k"), F.struct(*cols).alias("__r"))
    j = original.select(F.struct(*cols).alias("__o")).join(last, F.col(f"__o.{key}") == F.col("__k"), "left")
    return j.select(F.when(F.col("__k").isNotNull(), F.col("__r")).otherwise(F.col("__o")).alias("x"), F.col("__k").isNotNull().alias("replaced")).select("x.*", "replaced")


def orphans(repaired: DataFrame, original: DataFrame, key: str) -> DataFrame:
    """Keys of repaired rows that no original has."""
    return repaired.select(key).filter(F.col(key).isNotNull()).distinct().join(original.select(key), key, "left_anti")


def integrity(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: numbers of rows and of keys before and after, keys lost and gained, and whether all agrees."""
    a = before.groupBy(key).agg(F.count("*").alias("nb"))
    b = after.groupBy(key).agg(F.count("*").alias("na"))
    j = a.withColumnRenamed(key, "ka").join(b.withColumnRenamed(key, "kb"), F.col("ka").eqNullSafe(F.col("kb")), "full")
    s = j.agg(F.coalesce(F.sum("nb"), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("na"), F.lit(0)).alias("rows_after"), F.count("ka").alias("keys_before"), F.count("kb").alias("keys_after"), F.count_if(F.col("na").isNull()).alias("lost"), F.count_if(F.col("nb").isNull()).alias("gained"))
    return s.withColumn("ok", (F.col("rows_before") == F.col("rows_after")) & (F.col("lost") == 0) & (F.col("gained") == 0))


def checked(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """after, or an error if rows or keys were lost."""
    r = integrity(before, after, key).head()
    if not r["ok"]:
        raise RuntimeError(f"the merge changed rows or keys: {r.asDict()}")
    return after


def union_by_name(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def repair(suspicious: DataFrame, dataset: DataFrame, key: str, order: str, recognise) -> tuple[DataFrame, DataFrame]:
    """(repaired records, failures): each suspicious key's last record, its text replaced by `recognise(url column)`.

    recognise returns an array of page texts, null where it failed.
    """
    last = keep_last(dataset.filter(F.col(key).isNotNull()), key, order)
    j = suspicious.select(key).distinct().join(last, key, "left")
    j = j.withColumn("__pages", F.when(F.col("document_url").isNotNull(), recognise(F.col("document_url"))))
    pages = F.filter(F.transform("__pages", tx.clean_ocr), lambda x: x != "")
    error = F.when(F.col(order).isNull(), "not_in_dataset").when(F.col("document_url").isNull(), "missing_document_url").when(F.col("__pages").isNull(), "ocr_failed").when(F.size(pages) == 0, "no_text")
    j = j.withColumn("error", error)
    good = j.filter("error is null").withColumn("pages", pages).withColumn("text", F.array_join("pages", "\n\n"))
    good = good.withColumns({"text_page_count": F.size("pages"), "text_character_count": F.length("text"), "extraction_method": F.lit("tesseract_ocr"), "repaired": F.lit(True)})
    return good.drop("error", "__pages"), j.filter("error is not null").select(key, "document_url", "error")
