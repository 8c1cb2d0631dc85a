"""Text quality: profile, reasons, histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def profile(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with text_length, letter_ratio, word_count, corrupted_accent_count, symbol_ratio, reasons, status; text is dropped.

    Thresholds look at the unrounded ratios.
    """
    t, seen = F.col("__t"), F.col("__seen")
    # What several measures need is a column of its own, computed once.
    d = docs.withColumn("__t", tx.strip(tx.filled(F.col(text)))).withColumn("__seen", tx.visible(t))
    d = d.withColumns({"text_length": F.length(t), "letter_ratio": tx.letter_ratio(t, seen), "word_count": tx.word_count(t), "corrupted_accent_count": tx.corrupted_accents(t), "symbol_ratio": tx.symbol_ratio(t, seen)}).drop("__t", "__seen")
    bad: list[Column] = [F.col("text_length") < tx.MIN_LENGTH, F.col("letter_ratio") < tx.MIN_LETTERS, F.col("word_count") < tx.MIN_WORDS, F.col("corrupted_accent_count") >= tx.MAX_ACCENTS, F.col("symbol_ratio") > tx.MAX_SYMBOLS]
    d = d.withColumn("reasons", F.array_compact(F.array(*[F.when(b, F.lit(r)) for b, r in zip(bad, tx.REASONS, strict=True)])))
    d = d.withColumns({"status": F.when(F.size("reasons") > 0, "suspicious").otherwise("good"), "letter_ratio": F.round("letter_ratio", 4), "symbol_ratio": F.round("symbol_ratio", 4)})
    return d.drop(text)


def histogram(report: DataFrame, order: str) -> DataFrame:
    """(reason, n, place): counts of reasons, most frequent first, ties by first appearance in `order`."""
    from pyspark.sql import Window as W

    # The outer form, since the plain one would have the reasons computed once more to leave out rows without any.
    x = report.select(order, F.posexplode_outer("reasons").alias("pos", "reason")).filter("reason is not null")
    h = x.groupBy("reason").agg(F.count("*").alias("n"), F.min(F.struct(order, "pos")).alias("seen"))
    return h.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "seen"))).select("reason", "n", "place")


def status_counts(report: DataFrame, *by: str) -> DataFrame:
    return report.groupBy("status", *by).agg(F.count("*").alias("n"))


def split(report: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all rows, the suspicious ones)."""
    return report, report.filter(F.col("status") == "suspicious")
