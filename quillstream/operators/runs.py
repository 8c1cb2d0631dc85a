"""Evaluation of whole runs: cases, source accuracy, deterministic and judged runs, registries, histories."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from . import evaluate, search

# Fields that a case needs, and the metrics of both kinds of run.
REQUIRED = ["question", "expected_answer", "expected_adas", "category", "answerable"]
METRICS = ["answer_exactness", "number_accuracy", "source_accuracy", "source_rank"]
JUDGED = ["faithfulness", "answer_relevancy", "contextual_precision", "contextual_recall"]
SNIPPET = 500


class Registry:
    """Configurations by key, and how each provider loads one."""

    def __init__(self, providers: dict[str, Callable] | None = None):
        self.providers, self.configs = providers or {}, {}

    def add(self, key: str, provider: str, **config) -> None:
        self.configs[key] = {"provider": provider, **config}

    def config(self, key: str) -> dict:
        if key not in self.configs:
            raise ValueError(f"no such model: {key}")
        return self.configs[key]

    def load(self, key: str):
        c = self.config(key)
        if c["provider"] not in self.providers:
            raise ValueError(f"no such provider: {c['provider']}")
        return self.providers[c["provider"]](c)


def checked_cases(cases: DataFrame) -> DataFrame:
    """cases, or ValueError: a field is absent, or a case lacks one, has a blank question or answer or no list of ids."""
    absent = [c for c in REQUIRED if c not in cases.columns]
    if absent:
        raise ValueError(f"cases have no {', '.join(absent)}")
    blank = lambda c: tx.strip(tx.filled(F.col(c))) == ""
    bad = cases.filter(blank("question") | blank("expected_answer") | blank("category") | F.col("expected_adas").isNull() | F.col("answerable").isNull()).limit(5)
    found = [r["question"] for r in bad.select("question").collect()]
    if found:
        raise ValueError(f"incomplete cases, such as {found}")
    return cases


def parted(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answerable cases, the others)."""
    return cases.filter("answerable"), cases.filter("not answerable")


def expected_ids(*lists: Column) -> Column:
    """The union of lists of ids; null lists are empty."""
    none = F.array().cast("array<string>")
    out = F.array_distinct(F.coalesce(lists[0], none))
    for c in lists[1:]:
        out = F.array_union(out, F.coalesce(c, none))
    return out


def identifier(*cols: Column) -> Column:
    """The first of the columns that is not blank, without blanks around it, or an empty text."""
    return F.coalesce(*[tx.truthy(tx.strip(tx.filled(c))) for c in cols], F.lit(""))


def with_sources(cases: DataFrame, ranked: DataFrame, document: str = "document", most: int = search.SEARCH_K) -> DataFrame:
    """cases (qid, expected: array) with retrieved_ids, source_rank and source_accuracy; without expected ids [], null and null.

    ranked (qid, rank, document) may repeat documents and have blank ones.
    """
    ranking = search.unique_documents(ranked, document, most)
    some = cases.filter(F.size("expected") > 0).select("qid")
    lists = ranking.join(some, "qid", "left_semi").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("document").cast("string").alias("document")))).alias("x"))
    d = evaluate.first_relevant(cases, ranking).withColumnRenamed("first_rank", "source_rank")
    d = d.join(lists.select("qid", F.transform("x", lambda r: r["document"]).alias("retrieved_ids")), "qid", "left")
    return d.withColumns({"retrieved_ids": F.coalesce("retrieved_ids", F.array().cast("array<string>")), "source_accuracy": evaluate.source_accuracy(F.col("source_rank"), F.col("expected"))})


def details(cases: DataFrame, answers: DataFrame, ranked: DataFrame, model: str, retriever: str, document: str = "document") -> DataFrame:
    """One deterministic run over the answerable cases (qid, question, expected_answer, expected, category, answerable).

    answers (qid, answer, context) are a model's; a case without one counts as answered with an empty text.
    """
    d = with_sources(parted(cases)[0], ranked, document).join(answers.select("qid", "answer", "context"), "qid", "left")
    d = d.withColumns({"answer": tx.filled(F.col("answer")), "context": tx.filled(F.col("context"))})
    return d.withColumns({
        "model": F.lit(model), "retriever": F.lit(retriever),
        "answer_exactness": tx.exactness(F.col("answer"), F.col("expected_answer")),
        "number_accuracy": tx.number_accuracy(F.col("answer"), F.col("expected_answer")),
    })


def summary(runs: DataFrame) -> DataFrame:
    """Means of all metrics for each model and retriever, overall and by category; nulls are left out of means."""
    return evaluate.overall_and_by(runs, ["model", "retriever"], "category", METRICS)


def judged_details(runs: DataFrame, judge: Callable[[str, dict], float | None]) -> DataFrame:
    """runs (question, answer, context, expected_answer, answerable, ...) with a column for each judged metric.

    judge(metric, case) gives a score or None; it may ask a model. Unanswerable cases are judged by the first two metrics alone.
    An error of the judge is a null score: one case must not end a run.
    """
    d = runs.drop(*JUDGED)
    schema = T.StructType(list(d.schema))
    for m in JUDGED:
        schema = schema.add(m, "double")

    def scored(metric: str, case: dict) -> float | None:
        if not case["answerable"] and metric in JUDGED[2:]:
            return None
        try:
            s = judge(metric, case)
        except Exception:  # noqa: BLE001
            return None
        return None if s is None else float(s)

    def run(batches):
        for b in batches:
            rows = b.select(["question", "answer", "context", "expected_answer", "answerable"]).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([scored(m, r) for r in rows], pa.float64()) for m in JUDGED)], [*b.schema.names, *JUDGED])

    return d.mapInArrow(run, schema)


def passed(scores: Column, least: float = 0.5) -> Column:
    return F.when(scores.isNotNull(), scores >= least)


def history(turns: DataFrame, chat: str, order: str, *columns: str) -> DataFrame:
    """(chat, history): each chat's turns in order, as structs. A chat has a bounded number of turns."""
    g = turns.groupBy(chat).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("__h"))
    return g.select(chat, F.transform("__h", lambda r: F.struct(*[r[c].alias(c) for c in columns])).alias("history"))


def snippet(text: Column, n: int = SNIPPET) -> Column:
    return F.substring(tx.filled(text), 1, n)


def totals(outcomes: DataFrame) -> DataFrame:
    """Of rows of extract.outcome(): pages read, counted before short documents are turned away, and characters of completed ones."""
    read = F.col("outcome").isin("completed", "insufficient_extracted_text")
    return outcomes.agg(
        F.coalesce(F.sum(F.when(read, F.size("pages"))), F.lit(0)).cast("long").alias("pages"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "completed", F.length("text"))), F.lit(0)).cast("long").alias("characters"),
    )
