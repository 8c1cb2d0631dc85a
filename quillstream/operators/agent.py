"""Question answering as one plan over many questions: route, retrieve, assemble, generate, clean up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Greetings, thanks, their replies, and the marks that end or begin an answer.
HELLOS = ["γεια", "καλημέρα", "καλησπέρα", "hi", "hello", "θέλω βοήθεια", "sos"]
BYES = ["ευχαριστώ", "ευχαριστώ πολύ", "thanks", "βοήθησες πολύ, ευχαριστώ"]
HELLO_REPLY = "Γεια σου συνάδελφε! Πώς μπορώ να σε βοηθήσω;"
BYE_REPLY = "Η ευχαρίστηση είναι όλη δική μου!"
ANSWER_MARK = "Απάντηση:"
STOPS = ["Πόσοι", "Πόσες", "Ερώτηση:", "Χρήστης:", "Question:", "User:", "Context:", "Απάντηση:"]
MOST_ITERATIONS = 2


def _says(question: Column, phrases: list[str], whole_words: bool) -> Column:
    q = F.lower(tx.strip(tx.filled(question)))
    if not whole_words:
        return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(q, p))
    edge = r"[^\p{L}\p{N}]"
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.concat(F.lit(" "), F.regexp_replace(q, edge, " "), F.lit(" ")), F.concat(F.lit(" "), p, F.lit(" "))))


def route(question: Column, iterations: Column | None = None, context: Column | None = None, whole_words: bool = False) -> Column:
    """greeting, thanks, generate or retrieve. Phrases count anywhere in the question unless whole_words."""
    ready = F.lit(False)
    if iterations is not None:
        ready = ready | (iterations >= MOST_ITERATIONS)
    if context is not None:
        ready = ready | (tx.filled(context) != "")
    return F.when(_says(question, HELLOS, whole_words), "greeting").when(_says(question, BYES, whole_words), "thanks").when(ready, "generate").otherwise("retrieve")


def context_part(subject: Column, ada: Column, date: Column, url: Column, content: Column) -> Column:
    """One source's block; absent fields read None."""
    n = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.concat(F.lit("Θέμα: "), n(subject), F.lit("\nΑΔΑ: "), n(ada), F.lit("\nΗμερομηνία: "), n(date), F.lit("\nURL: "), n(url), F.lit("\n\n"), tx.filled(content))


def assemble(ranked: DataFrame, part: Column, source: Column) -> DataFrame:
    """Ranked rows to (qid, context, sources), in rank order. A question has a bounded number of ranks."""
    g = ranked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part"), source.alias("source")))).alias("x"))
    return g.select("qid", F.array_join(F.transform("x", lambda r: r["part"]), "\n\n").alias("context"), F.transform("x", lambda r: r["source"]).alias("sources"))


def prompt(question: Column, context: Column, rules: str) -> Column:
    return F.concat(F.lit(rules + "\n\nContext:\n"), tx.filled(context), F.lit("\n\nΕρώτηση:\n"), tx.filled(question), F.lit("\n\nΑπάντηση:\n"))


def post_process(raw: Column) -> Column:
    """The answer after its mark, up to the first of each stop in turn, its lines trimmed and each kept once."""
    t = tx.filled(raw)
    at = F.instr(t, ANSWER_MARK)
    t = F.when(at > 0, F.substr(t, at + len(ANSWER_MARK))).otherwise(t)
    for s in STOPS:
        t = F.substring_index(t, s, 1)
    lines = F.transform(F.split(F.regexp_replace(t, "\r\n?", "\n"), "\n"), tx.strip)
    return F.array_join(F.array_distinct(F.filter(lines, lambda x: x != "")), "\n")


def answer(questions: DataFrame, retrieve, generate, rules: str = "", whole_words: bool = False) -> DataFrame:
    """questions (qid, question) to (qid, question, route, context, sources, iterations: how often was searched, answer).

    retrieve(questions to search) gives (qid, context, sources); generate(prompt column) gives a text column.
    """
    q = questions.withColumn("route", route(F.col("question"), whole_words=whole_words))
    found = retrieve(q.filter(F.col("route") == "retrieve").select("qid", "question"))
    j = q.join(found, "qid", "left")
    text = F.when(F.col("route") == "greeting", HELLO_REPLY).when(F.col("route") == "thanks", BYE_REPLY).otherwise(post_process(generate(prompt(F.col("question"), F.col("context"), rules))))
    return j.withColumn("iterations", (F.col("route") == "retrieve").cast("int")).withColumn("answer", text)
