"""Retrieval and answer metrics, averaged overall and by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

DEPTHS = (1, 3, 5)
# Fixed value: the sentence that counts as a refusal.
REFUSAL = "Δεν βρέθηκε σαφής απάντηση στις διαθέσιμες πληροφορίες."


def first_relevant(queries: DataFrame, ranking: DataFrame) -> DataFrame:
    """queries (qid, expected: array) with first_rank, that of the first expected document, or null."""
    hit = ranking.join(queries.select("qid", F.explode("expected").alias("document")).distinct(), ["qid", "document"], "left_semi")
    return queries.join(hit.groupBy("qid").agg(F.min("rank").alias("first_rank")), "qid", "left")


def with_hits(d: DataFrame) -> DataFrame:
    r = F.col("first_rank")
    d = d.withColumns({f"hit_{k}": F.coalesce((r <= k).cast("int"), F.lit(0)) for k in DEPTHS})
    return d.withColumn("rr", F.coalesce(1.0 / r, F.lit(0.0)))


def retrieval_summary(d: DataFrame, *by: str) -> DataFrame:
    """Means over all queries; those without a hit count as 0."""
    return d.groupBy(*by).agg(F.count("*").alias("queries"), *[F.avg(f"hit_{k}").alias(f"hit_{k}") for k in DEPTHS], F.avg("rr").alias("mrr"))


def source_accuracy(first_rank: Column, expected: Column) -> Column:
    """Null where no source is expected."""
    return F.when(F.size(expected) > 0, F.when(first_rank.isNotNull(), 1.0).otherwise(0.0))


def is_refusal(answer: Column, sentence: str = REFUSAL) -> Column:
    return F.contains(F.lower(tx.strip(tx.filled(answer))), F.lit(sentence.lower()))


def overall_and_by(results: DataFrame, keys: list[str], category: str, metrics: list[str]) -> DataFrame:
    """One pass of grouping sets: means by keys (category `overall`) and by keys and category; null metrics are left out of means."""
    sets = [[F.col(k) for k in keys], [*[F.col(k) for k in keys], F.col(category)]]
    g = results.groupingSets(sets, *keys, category).agg(F.grouping(category).alias("__all"), F.count("*").alias("cases"), *[F.avg(m).alias(m) for m in metrics])
    return g.withColumn(category, F.when(F.col("__all") == 1, "overall").otherwise(F.col(category))).drop("__all")


def judged(results: DataFrame, keys: list[str], category: str | None = None) -> DataFrame:
    """Judged scores: answerable cases have all four, unanswerable ones the first two and whether the answer refuses."""
    a = F.col("answerable")
    groups = keys + ([category] if category else [])
    names = ["faithfulness", "answer_relevancy", "contextual_precision", "contextual_recall"]
    refused = F.avg(F.when(~a, is_refusal(F.col("answer")).cast("double")))
    return results.groupBy(*groups).agg(*[F.avg(F.when(a, F.col(n))).alias(n) for n in names], F.avg(F.when(~a, F.col(names[0]))).alias("unanswerable_faithfulness"), F.avg(F.when(~a, F.col(names[1]))).alias("unanswerable_relevancy"), refused.alias("refusal_accuracy"), (1 - refused).alias("hallucination_rate"))


def grid(models: DataFrame, retrievers: DataFrame, summary: DataFrame) -> DataFrame:
    """A row for each experiment, model by retriever, with its summary or nulls where it failed. Both sides are short lists of names."""
    return models.join(retrievers, F.lit(True)).join(summary, ["model", "retriever"], "left")


def invalid_cases(cases: DataFrame, required: list[str]) -> DataFrame:
    """Rows that lack a required value, with the names of what is missing."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in required]))
    return cases.withColumn("missing", missing).filter(F.size("missing") > 0)


def shown(metric: Column) -> Column:
    return F.when(metric.isNotNull(), F.printf(F.lit("%.3f"), metric)).otherwise("-")
