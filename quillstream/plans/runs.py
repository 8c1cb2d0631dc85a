"""Queries that write and read back, fetch, embed, judge and evaluate whole runs, and their SQL.

What lies outside Spark is a plain function here: the encoder counts letters, the connection answers from the address,
the judge scores by length. SQL can say what they do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import agent, chunk, embed, evaluate, ingest, merge, runs
from ..sources import fetch, paged, readers, saved, writers
from ..store import shared, written
from ..streaming import crawl, log
from .queries import _RAW, _REASON, _STRIP, ORACLES, _arrived, _found, _labelled, _norm_sql, _numbers_sql, _raw, _topk_sql, _unique_sql, query, table, texts

# --- files --------------------------------------------------------------------------------------------------------


def _at(spark: SparkSession, name: str) -> str:
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def _records(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("ada"), F.col("lang").alias("subject"), "source", "text")


@query("SELECT ada, subject, source, times FROM (SELECT doc_id::VARCHAR AS ada, lang AS subject, source, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS times FROM documents) UNION ALL SELECT 'bad', NULL, NULL, 2")
def jsonl_round_trip(spark, sf_dir):
    """Overwritten twice, appended to, spoilt with lines that are no objects, and read tolerantly."""
    d, path = _records(spark, sf_dir).drop("text"), _at(spark, "jsonl")
    writers.overwrite(d.limit(1), path)
    writers.overwrite(d, path)
    writers.append(d.filter(F.col("ada").cast("long") % 3 == 0), path)
    spark.createDataFrame([("{broken",), ("",), ("[1, 2]",)], "value string").coalesce(1).write.mode("append").text(path)
    good, bad = readers.tolerant(spark, path, "ada string, subject string, source string")
    rows = good.groupBy("ada", "subject", "source").agg(F.count("*").alias("times"))
    none = F.lit(None).cast("string")
    return rows.union(bad.agg(F.lit("bad"), none, none, F.count("*")))


@query("""SELECT mode, n FROM (SELECT 'silent' AS mode, count(*) AS n FROM documents UNION ALL SELECT 'strict', count(*) FROM documents UNION ALL SELECT 'omitted', 0 UNION ALL SELECT 'keys', count(DISTINCT doc_id) - 1 FROM documents UNION ALL SELECT 'missing', 0)""")
def jsonl_modes(spark, sf_dir):
    """Rows by each degree of strictness; a blank key is no key, a missing file has none."""
    first = table(spark, sf_dir, "documents").agg(F.min("doc_id").cast("string")).scalar()
    d = _records(spark, sf_dir).select(F.when(F.col("ada") == first, "  ").otherwise(F.concat(F.lit(" "), "ada")).alias("ada"), "source")
    path = _at(spark, "modes")
    writers.overwrite(d, path)
    strict = readers.strict(spark, path, "ada string, source string").select("ada", "source")
    spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.text(f"{path}-spoilt")
    both = [path, f"{path}-spoilt"]
    parts = {"silent": readers.silent(spark, both, "ada string, source string").select("ada", "source"), "strict": strict, "omitted": readers.silent(spark, f"{path}-spoilt", "ada string"), "keys": readers.keys(spark, path, "ada"), "missing": readers.keys(spark, f"{path}-none", "ada")}
    out = None
    for name, x in parts.items():
        row = x.filter(F.lit(True)).agg(F.lit(name).alias("mode"), F.count("*").alias("n"))
        out = row if out is None else out.union(row)
    return out


@query(f"""SELECT ada, md5(CASE WHEN doc_id % 2 = 0 THEN 'Θέμα: ' || lang || chr(10) || chr(10) || 'Κείμενο:' || chr(10) || t ELSE t END) AS digest, CASE WHEN doc_id % 5 = 0 THEN 'external_pdf' ELSE 'diavgeia' END AS kind
 FROM (SELECT doc_id, doc_id::VARCHAR AS ada, lang, {_STRIP % 'text'} AS t FROM documents) WHERE t <> ''""")
def corpus_scan(spark, sf_dir):
    """Records written as JSON lines and scanned as a corpus."""
    k = F.col("ada").cast("long")
    d = _records(spark, sf_dir).withColumn("subject", F.when(k % 2 == 0, F.col("subject"))).withColumn("source", F.when(k % 5 == 0, "external_pdf").otherwise("diavgeia"))
    path = _at(spark, "corpus")
    writers.overwrite(d, path)
    return readers.corpus(spark, path).select("ada", F.md5("page_content").alias("digest"), F.col("source").alias("kind"))


@query("SELECT coalesce(lang, '-') AS sink, count(*) AS n, sum(doc_id)::BIGINT AS keys FROM (SELECT CASE WHEN lang IN ('en', 'de') THEN lang END AS lang, doc_id FROM documents) GROUP BY ALL")
def sink_split(spark, sf_dir):
    """Rows by language to a file each, the others to a last one."""
    path = _at(spark, "split")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    writers.split(d, {x: f"{path}/{x}" for x in ("en", "de")}, "lang", rest=f"{path}/rest")
    out = None
    for x in ("en", "de", "rest"):
        part = spark.read.schema("doc_id long, lang string").json(f"{path}/{x}")
        row = part.groupBy(F.lit("-" if x == "rest" else x).alias("sink")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("keys"))
        out = row if out is None else out.union(row)
    return out


@query("SELECT lang, 'm' || (doc_id % 3) AS model, count(*) AS n, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources, CASE WHEN doc_id % 3 > 0 THEN round(avg(n_chars), 3) END AS mean FROM documents GROUP BY lang, doc_id % 3")
def results_files(spark, sf_dir):
    """A summary as a CSV file with a byte order mark and as nested JSON, both read back and joined."""
    d = table(spark, sf_dir, "documents").withColumn("model", F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")))
    s = d.groupBy("lang", "model").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("source")).alias("sources"), F.round(F.avg("n_chars"), 3).alias("mean"))
    s = s.withColumn("mean", F.when(F.col("model") != "m0", F.col("mean")))
    path = _at(spark, "results")
    writers.results_csv_file(s, f"{path}/summary.csv")
    writers.results_json(s.select("lang", "model", "n"), ["lang", "model"], f"{path}/summary.json")
    c = spark.read.option("header", True).schema("lang string, model string, n long, sources string, mean double").csv(f"{path}/summary.csv")
    j = spark.read.option("multiLine", True).schema("value string").text(f"{path}/summary.json", wholetext=True)
    j = j.select(F.explode(F.from_json("value", "map<string, struct<n: long>>")).alias("name", "x")).select("name", F.col("x.n").alias("n"))
    return c.drop("n").join(j, F.concat_ws("_", "lang", "model") == F.col("name")).select("lang", "model", "n", "sources", "mean")


@query("SELECT count(*) AS n, sum(length(text))::BIGINT AS characters, true AS same, true AS rebuilt FROM benchmark")
def index_build_or_load(spark, sf_dir):
    """Built once, loaded afterwards, built anew for a changed corpus."""
    c = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), F.col("text").alias("page_content"))
    folder, made = _at(spark, "index"), spark.sparkContext.accumulator(0)

    def counted(texts):
        made.add(len(texts))
        return letters(texts)

    x = embed.index(spark, folder, "bge", c, counted)
    once = made.value
    y = embed.index(spark, folder, "bge", c, counted)
    same = made.value == once and x.exceptAll(y).isEmpty()
    embed.index(spark, folder, "bge", c.withColumn("page_content", F.concat("page_content", F.lit("x"))), counted).count()
    return y.join(c, "chunk_id").agg(F.count("*").alias("n"), F.sum(F.length("page_content")).alias("characters"), F.lit(same).alias("same"), F.lit(made.value > once).alias("rebuilt"))


def answered(url: str):
    """A connection that fails for addresses that end in 0, and is empty for those that end in 5."""
    if url.endswith("0"):
        raise OSError("refused")
    return ([] if url.endswith("5") else [b"%PDF-1.4 ", url.encode()]), "application/pdf"


def upper_case(raw: bytes) -> bytes:
    if raw.endswith(b"3"):
        raise RuntimeError("damaged")
    return raw.upper()


@query("""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 10 IN (0, 5) THEN 'download_failed' END AS error, CASE WHEN page_id % 7 > 0 AND page_id % 10 NOT IN (0, 5) THEN md5('%PDF-1.4 u/' || page_id) END AS digest,
 CASE WHEN page_id % 7 > 0 AND page_id % 10 NOT IN (0, 3, 5) THEN md5('%PDF-1.4 U/' || page_id) END AS rewritten, CASE WHEN page_id % 7 > 0 AND page_id % 10 = 3 THEN 'damaged' END AS rewrite_error FROM pages""")
def pdf_fetch(spark, sf_dir):
    """Contents by a connection, fetched with retries and rewritten."""
    url = F.when(F.col("page_id") % 7 > 0, F.concat(F.lit("u/"), F.col("page_id").cast("string")))
    d = fetch.contents(table(spark, sf_dir, "pages").select("page_id", url.alias("document_url")), answered, pause=lambda s: None)
    d = fetch.rewritten(d, upper_case)
    return d.select("page_id", "error", F.md5("content").alias("digest"), F.md5("rewritten").alias("rewritten"), "rewrite_error")


@query("SELECT file_id, folder, place FROM (SELECT s_suppkey % 40 AS file_id, s_nationkey::VARCHAR AS folder, s_suppkey AS place, row_number() OVER (PARTITION BY s_suppkey % 40 ORDER BY CASE s_nationkey WHEN 7 THEN 0 WHEN 3 THEN 1 ELSE 2 END, s_suppkey) AS r FROM supplier WHERE s_nationkey IN (3, 7, 11)) WHERE r = 1")
def folder_files(spark, sf_dir):
    """Files of several folders, each once."""
    d = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("folder"), (F.col("s_suppkey") % 40).alias("file_id"), F.col("s_suppkey").alias("place"))
    return fetch.in_folders(d, [" 7 ", "", None, "3", "11", "7"]).select("file_id", "folder", "place")


# --- texts and vectors --------------------------------------------------------------------------------------------

_LETTERS = "aeinorst"


def letters(texts: list[str]) -> list:
    return [[t.count(x) for x in _LETTERS] for t in texts]


def letters_(texts: list[str]) -> list:
    return [[t.count(x) for x in _LETTERS[::-1][:5]] for t in texts]


def _vector_sql(text: str, kinds: str) -> str:
    return "[" + ", ".join(f"(length({text}) - length(replace({text}, '{x}', '')))::DOUBLE" for x in kinds) + "]"


def _ranked_sql(kinds: str, k: int) -> str:
    return f"""SELECT qid, turn, id, row_number() OVER (PARTITION BY qid, turn ORDER BY score DESC, id) AS rank, score FROM (SELECT qid, turn, id, list_inner_product(list_transform(qv, lambda x: x / qn), list_transform(v, lambda x: x / n)) AS score FROM
 (SELECT *, sqrt(list_inner_product(qv, qv)) AS qn FROM (SELECT conv_id AS qid, turn, {_vector_sql('text', kinds)} AS qv FROM conversations)),
 (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM (SELECT item_id AS id, {_vector_sql('text', kinds)} AS v FROM benchmark)) WHERE qn > 0 AND n > 0) QUALIFY rank <= {k}"""


def _modes_sql() -> str:
    part = lambda i, kinds, w: f"SELECT qid, turn, id, {i} AS list, rank, {w}::DOUBLE / (60 + rank) AS part FROM ({_ranked_sql(kinds, 5)})"
    fused = f"SELECT qid, turn, id, row_number() OVER (PARTITION BY qid, turn ORDER BY round(score, 12) DESC, first) AS rank FROM (SELECT qid, turn, id, sum(part) AS score, min(list * 1000 + rank) AS first FROM ({part(0, _LETTERS, 0.3)} UNION ALL {part(1, _LETTERS[::-1][:5], 0.7)}) GROUP BY qid, turn, id) QUALIFY rank <= 15"
    one = lambda m, kinds: f"SELECT '{m}' AS mode, qid, turn, id, rank::INT AS rank FROM ({_ranked_sql(kinds, 5)})"
    return f"{one('minilm', _LETTERS)} UNION ALL {one('bge', _LETTERS[::-1][:5])} UNION ALL SELECT 'ensemble', qid, turn, id, rank::INT FROM ({fused})"


@query(_modes_sql())
def retriever_modes(spark, sf_dir):
    """From texts to ranked items by each mode: encoded, indexed, searched and fused. Every turn of every conversation is a question."""
    c = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), F.col("text").alias("page_content"))
    folder, encoders = _at(spark, "modes"), {"minilm": letters, "bge": letters_}
    build = lambda m: lambda: embed.index(spark, folder, m, c, encoders[m]).select(F.col("chunk_id").alias("id"), F.col("embedding").alias("v"))
    r = embed.Retrievers({m: build(m) for m in encoders}, encoders)
    q = texts(spark, sf_dir, "conversations").select(F.struct(F.col("conv_id").alias("qid"), "turn").alias("qid"), F.col("text").alias("question"))
    out = None
    for mode in (" MiniLM", "bge", "ensemble"):
        part = r.load(mode)(q).select(F.lit(mode.strip().lower()).alias("mode"), "qid.qid", "qid.turn", "id", "rank")
        out = part if out is None else out.union(part)
    return out


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) / list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 9) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 9) AS first FROM embeddings")
def embedding_normalize(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", embed.normalized(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 9).alias("norm"), F.round(F.col("v")[0], 9).alias("first"))


@query("SELECT doc_id, md5(substring(text, 1, 500)) AS digest, length(substring(text, 1, 500))::INT AS n FROM documents")
def snippets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", runs.snippet(F.col("text")).alias("s"))
    return d.select("doc_id", F.md5("s").alias("digest"), F.length("s").alias("n"))


@query(f"""SELECT doc_id, CASE WHEN length(t) = 0 THEN 0 WHEN length(t) <= 1000 THEN 1 END::INT AS exact, length(t) = 0 OR true AS within, true AS covers, length(regexp_replace(t, '{tx.SP}', '', 'g'))::INT AS visible FROM (SELECT doc_id, {_STRIP % "coalesce(text, '')"} AS t FROM documents)""")
def recursive_chunks_cover(spark, sf_dir):
    """What every recursive split must keep: chunks within their size, each a part of the text, that leave out nothing but blanks and overlap by no more than they may."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("whole"))
    c = chunk.recursive(d).select("doc_id", F.length("chunk").alias("size"), F.contains("whole", "chunk").alias("part"), F.length(tx.visible(F.col("chunk"))).alias("seen"))
    per = c.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"), F.max("size").alias("longest"), F.min("part").alias("parts"), F.sum("seen").alias("seen"))
    d = d.select("doc_id", tx.strip(tx.filled(F.col("whole"))).alias("t")).join(per, "doc_id", "left").withColumn("visible", F.length(tx.visible(F.col("t"))))
    n, seen = F.coalesce("n", F.lit(0)), F.coalesce("seen", F.lit(0))
    return d.select(
        "doc_id", F.when(F.length("t") == 0, n).when(F.length("t") <= chunk.SIZE, n).alias("exact"), (F.coalesce("longest", F.lit(0)) <= chunk.SIZE).alias("within"),
        (F.coalesce("parts", F.lit(True)) & seen.between(F.col("visible"), F.col("visible") + F.greatest(F.lit(0), n - 1) * chunk.OVERLAP)).alias("covers"), "visible",
    )


# --- runs ---------------------------------------------------------------------------------------------------------


def _ranked(spark, sf_dir) -> DataFrame:
    return _labelled(spark, sf_dir, _found(spark, sf_dir, 15)).select("qid", "rank", F.col("label").cast("string").alias("document"))


def _source_cases(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0")
    label, other = F.col("label").cast("string"), ((F.col("label") + 3) % 10).cast("string")
    adas = F.when(F.col("vec_id") % 300 == 0, F.array().cast("array<string>")).otherwise(F.array(other))
    ids = F.when(F.col("vec_id") % 200 == 0, F.array(label, other))
    return v.select(F.col("vec_id").alias("qid"), runs.expected_ids(adas, ids).alias("expected"))


_EXPECTED = "list_distinct(list_concat(CASE WHEN vec_id % 300 = 0 THEN [] ELSE [((label + 3) % 10)::VARCHAR] END, CASE WHEN vec_id % 200 = 0 THEN [label::VARCHAR, ((label + 3) % 10)::VARCHAR] ELSE [] END))"


@query(f"""WITH u AS (SELECT qid, document::VARCHAR AS document, rank FROM ({_unique_sql(_topk_sql(15))})), c AS (SELECT vec_id AS qid, {_EXPECTED} AS expected FROM embeddings WHERE vec_id % 100 = 0),
 r AS (SELECT c.qid, c.expected, min(CASE WHEN list_contains(c.expected, u.document) THEN u.rank END) AS source_rank, string_agg(u.document, ',' ORDER BY u.rank) AS ids FROM c LEFT JOIN u USING (qid) GROUP BY ALL)
 SELECT qid, len(expected)::INT AS n_expected, source_rank::INT AS source_rank, CASE WHEN len(expected) > 0 THEN CASE WHEN source_rank IS NULL THEN 0.0 ELSE 1.0 END END::DOUBLE AS source_accuracy, CASE WHEN len(expected) > 0 THEN coalesce(ids, '') ELSE '' END AS retrieved_ids FROM r""")
def source_accuracy(spark, sf_dir):
    """Two lists of expected ids, either of which may be empty."""
    d = runs.with_sources(_source_cases(spark, sf_dir), _ranked(spark, sf_dir))
    return d.select("qid", F.size("expected").alias("n_expected"), F.col("source_rank").cast("int").alias("source_rank"), "source_accuracy", F.array_join("retrieved_ids", ",").alias("retrieved_ids"))


def _run(spark, sf_dir) -> DataFrame:
    """Embeddings stand for questions, documents of the same number for what is expected and answered."""
    d = table(spark, sf_dir, "documents")
    cases = _source_cases(spark, sf_dir).join(d.select(F.col("doc_id").alias("qid"), F.col("lang").alias("category"), F.col("text").alias("expected_answer")), "qid")
    cases = cases.withColumns({"question": F.concat(F.lit("q"), F.col("qid").cast("string")), "answerable": F.col("qid") % 400 != 0, "expected_adas": F.col("expected")})
    a = F.col("expected_answer")
    answers = cases.filter("qid % 500 != 0").select("qid", F.when(F.col("qid") % 200 == 0, F.upper(F.translate(a, "ß", "s"))).otherwise(F.concat(a, F.lit(" 12"))).alias("answer"), F.lit("c").alias("context"))
    return runs.details(runs.checked_cases(cases.withColumn("expected_answer", F.concat(F.translate(a, "ß", "s"), F.when(F.col("qid") % 300 == 0, " 12").otherwise("")))), answers, _ranked(spark, sf_dir), "m0", "bge")


_ASKED = "(SELECT vec_id AS qid, lang AS category, text AS a FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 100 = 0 AND vec_id % 400 <> 0)"
_RUN = f"""SELECT q.qid, category, CASE WHEN {_norm_sql('answer')} = {_norm_sql('expected_answer')} THEN 1.0 ELSE 0.0 END::DOUBLE AS answer_exactness,
 CASE WHEN len({_numbers_sql('expected_answer')}) > 0 THEN CASE WHEN len(list_filter({_numbers_sql('expected_answer')}, lambda z: NOT list_contains({_numbers_sql('answer')}, z))) = 0 THEN 1.0 ELSE 0.0 END END::DOUBLE AS number_accuracy, source_accuracy, source_rank
 FROM (SELECT qid, category, CASE WHEN qid % 500 = 0 THEN '' WHEN qid % 200 = 0 THEN upper(replace(a, 'ß', 's')) ELSE a || ' 12' END AS answer, replace(a, 'ß', 's') || CASE WHEN qid % 300 = 0 THEN ' 12' ELSE '' END AS expected_answer FROM {_ASKED}) q JOIN (SOURCES) s USING (qid)"""


@query("SELECT model, retriever, category, cases, round(answer_exactness, 9) AS answer_exactness, round(number_accuracy, 9) AS number_accuracy, round(source_accuracy, 9) AS source_accuracy, round(source_rank, 9) AS source_rank FROM (SELECT 'm0' AS model, 'bge' AS retriever, CASE WHEN grouping(category) = 1 THEN 'overall' ELSE category END AS category, count(*) AS cases, avg(answer_exactness) AS answer_exactness, avg(number_accuracy) AS number_accuracy, avg(source_accuracy) AS source_accuracy, avg(source_rank) AS source_rank FROM (" + _RUN.replace("SOURCES", ORACLES["source_accuracy"]) + ") GROUP BY GROUPING SETS ((), (category)))")
def deterministic_run(spark, sf_dir):
    """A run's details and its summary, overall and by category."""
    return runs.summary(_run(spark, sf_dir)).withColumns({m: F.round(m, 9) for m in runs.METRICS})


def by_length(metric: str, case: dict) -> float | None:
    """A judge: the metric's place and the length of the answer; it fails for answers that begin with T."""
    if case["answer"].startswith("T"):
        raise RuntimeError("no judgement")
    return (len(case["answer"]) + runs.JUDGED.index(metric)) % 5 / 5


def _judge_sql(i: int) -> str:
    return f"CASE WHEN NOT starts_with(answer, 'T') {'AND answerable' if i > 1 else ''} THEN ((length(answer) + {i}) % 5) / 5.0::DOUBLE END"


@query("SELECT category, " + ", ".join(f"round(avg(CASE WHEN answerable THEN {_judge_sql(i)} END), 9) AS {m}" for i, m in enumerate(runs.JUDGED)) + f", round(avg(CASE WHEN NOT answerable THEN {_judge_sql(0)} END), 9) AS unanswerable_faithfulness, round(avg(CASE WHEN NOT answerable THEN refused END), 9) AS refusal_accuracy, round(1 - avg(CASE WHEN NOT answerable THEN refused END), 9) AS hallucination_rate FROM (SELECT role AS category, turn % 2 = 1 AS answerable, CASE WHEN conv_id % 4 = 0 THEN 'x ' || '{evaluate.REFUSAL}' || ' y' ELSE text END AS answer, (conv_id % 4 = 0)::INT::DOUBLE AS refused FROM conversations WHERE role <> 'system') GROUP BY category")
def judged_run(spark, sf_dir):
    """Cases judged by a given judge, unanswerable ones by the first two metrics and by their refusals."""
    d = table(spark, sf_dir, "conversations").filter("role <> 'system'")
    answer = F.when(F.col("conv_id") % 4 == 0, F.lit(f"x {evaluate.REFUSAL} y")).otherwise(F.col("text"))
    d = d.select(F.lit("q").alias("question"), answer.alias("answer"), F.lit("").alias("context"), F.lit("").alias("expected_answer"), (F.col("turn") % 2 == 1).alias("answerable"), F.col("role").alias("category"))
    j = evaluate.judged(runs.judged_details(d, by_length), [], "category")
    return j.select("category", *[F.round(c, 9).alias(c) for c in (*runs.JUDGED, "unanswerable_faithfulness", "refusal_accuracy", "hallucination_rate")])


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history, count(*)::INT AS turns FROM conversations GROUP BY conv_id")
def chat_history(spark, sf_dir):
    h = runs.history(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    said = F.transform("history", lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    return h.select("conv_id", F.array_join(said, "\n").alias("history"), F.size("history").alias("turns"))


@query("SELECT sum(CASE WHEN doc_id % 3 > 0 THEN len(string_split(text, chr(10))) ELSE 0 END)::BIGINT AS pages, sum(CASE WHEN doc_id % 3 = 1 THEN length(text) ELSE 0 END)::BIGINT AS characters FROM documents")
def build_totals(spark, sf_dir):
    k = F.col("doc_id") % 3
    d = table(spark, sf_dir, "documents").select(F.when(k == 0, "download_failed").when(k == 1, "completed").otherwise("insufficient_extracted_text").alias("outcome"), F.split("text", "\n").alias("pages"), "text")
    return runs.totals(d)


# --- streaming ----------------------------------------------------------------------------------------------------


@query(f"SELECT event_id, ada, day, reason FROM (SELECT event_id, ada, day, {_REASON} AS reason FROM ({_RAW})) WHERE reason IS NOT NULL")
def stream_rejects(spark, sf_dir):
    """Three micro-batches under one checkpoint, the stream ended and begun again between them; rejected rows are stored once."""
    at = _at(spark, "rejects")
    d = _raw(spark, sf_dir).select("ada", "event_id", "day", "reason")
    top = d.agg(F.max("event_id")).head()[0] or 0
    s = None
    for lo, hi in ((-1, top // 3), (top // 3, 2 * top // 3), (2 * top // 3, top)):
        _arrived(d, (F.col("event_id") > lo) & (F.col("event_id") <= hi), f"{at}/in")
        s = spark.readStream.schema(d.schema).parquet(f"{at}/in") if s is None else s
        crawl.run(s, f"{at}/checkpoint", f"{at}/accepted", f"{at}/rejected", "ada", "event_id")
    crawl.run(s, f"{at}/checkpoint", f"{at}/accepted", f"{at}/rejected", "ada", "event_id")
    return spark.read.schema(d.schema).parquet(f"{at}/rejected").select("event_id", "ada", "day", "reason")


# --- a paged service, its stream, and files -----------------------------------------------------------------------


def _service(spark, sf_dir) -> tuple[str, int]:
    """(address of the raw records as a service's table, records on a page so that there are some two dozen pages)."""
    path = _at(spark, "service")
    d = _raw(spark, sf_dir).drop("reason")
    record = F.to_json(F.struct("event_id", "ada", F.col("org").alias("organizationId"), F.col("event_type").alias("status"), F.col("day").alias("issueDate")))
    saved.save(d.select("event_id", "org", F.col("event_type").alias("status"), F.to_date("day").alias("issue_date"), record.alias("record")), path, "event_id")
    return path, max(paged.PAGE_SIZE, -(-d.count() // 24))


def _parsed(records: DataFrame) -> DataFrame:
    r = records.select(F.from_json("record", "event_id long, ada string, organizationId string, issueDate string").alias("r")).select("r.event_id", "r.ada", F.col("r.issueDate").alias("day"), F.col("r.organizationId").alias("org"))
    return ingest.validate(r, "day", "org", "ada", "7", "2024-01-05", "2024-01-25").select("event_id", "ada", "day", "reason")


@query(f"""WITH e AS (SELECT event_id, ada, day, {_REASON} AS reason FROM ({_RAW})) SELECT event_id, ada, day, reason FROM e WHERE reason IS NOT NULL
 UNION ALL SELECT event_id, ada, day, NULL FROM (SELECT *, row_number() OVER (PARTITION BY ada ORDER BY event_id) AS r FROM e WHERE reason IS NULL) WHERE r = 1""")
def crawl_pages(spark, sf_dir):
    """A service crawled page by page as a stream: ended midway within the pages, resumed under the same checkpoint, and begun again when nothing is left."""
    path, size = _service(spark, sf_dir)
    at = _at(spark, "crawl")
    spark.dataSource.register(paged.PagedRecords)
    source = spark.readStream.format("paged_records").option("fetch", paged.given(saved.answers(path))).option("size", size).option("batch", 5).option("progress", f"{at}/progress")
    for pages in (9, None, None):
        s = source.option("pages", pages if pages else 1 << 40).load()
        crawl.run(_parsed(s), f"{at}/checkpoint", f"{at}/accepted", f"{at}/rejected", "ada", "event_id")
    good = spark.read.schema("event_id long, ada string, day string").parquet(f"{at}/accepted")
    bad = spark.read.schema("event_id long, ada string, day string, reason string").parquet(f"{at}/rejected")
    return bad.unionByName(good, allowMissingColumns=True)


@query(f"""WITH e AS (SELECT event_id, org, event_type, day FROM ({_RAW}) WHERE org IN ('7', '99') AND day >= '2024-01-08' AND day < '2024-01-20'),
 s AS (SELECT greatest({paged.PAGE_SIZE}, ceil(count(*) / 24.0)::BIGINT) AS size FROM events),
 p AS (SELECT event_id, org, (row_number() OVER (PARTITION BY org ORDER BY event_id) - 1) // size AS page FROM (SELECT event_id, org, day FROM ({_RAW}) WHERE day >= '2024-01-08' AND day <= '2024-01-20') CROSS JOIN s WHERE org IN ('7', '99'))
 SELECT e.org, count(*) AS n, sum(e.event_id)::BIGINT AS ids, count(DISTINCT page) AS pages, max(page) AS last_page FROM e JOIN p USING (event_id) GROUP BY e.org""")
def page_push_down(spark, sf_dir):
    """Filters on days and organisations become parameters of the requests: the pages asked for are those of the answers that fit, not those of all records."""
    path, size = _service(spark, sf_dir)
    spark.dataSource.register(paged.PagedRecords)
    old = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        d = spark.read.format("paged_records").option("fetch", paged.given(saved.answers(path))).option("size", size).load()
        d = d.filter("org in ('7', '99') and issue_date >= date'2024-01-08' and issue_date < date'2024-01-20'")
        ids = F.get_json_object("record", "$.event_id").cast("long")
        rows = written(d.select("org", "page", ids.alias("event_id")), "pushed")
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", old)
    return rows.groupBy("org").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.count_distinct("page").alias("pages"), F.max("page").alias("last_page"))


@query("SELECT page_id, octet_length(encode(html)) AS bytes, sha256(encode(html)) AS digest FROM pages WHERE html IS NOT NULL")
def binary_files(spark, sf_dir):
    """A file for each page, written by a sink that commits all of them at once, and read back."""
    path = _at(spark, "files")
    d = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("name"), F.col("html").cast("binary").alias("content"))
    writers.contents(d, path, "name", "content", ".pdf")
    read = readers.files(spark, path)
    return read.select(F.regexp_extract("path", r"([0-9]+)\.pdf$", 1).cast("long").alias("page_id"), F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("digest"))


@query("SELECT doc_id, start::BIGINT AS start FROM (SELECT doc_id, sum(len(coalesce(text, ''))) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s, coalesce(s, 0) AS start FROM (SELECT doc_id, text, CASE WHEN doc_id % 997 = 0 THEN 4611686018427387904 + doc_id ELSE doc_id END AS id FROM documents))")
def skewed_ordinals(spark, sf_dir):
    """Where each text begins in the whole corpus, in an order whose ids lie close together but for a few far away."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(k % 997 == 0, F.lit(1 << 62) + k).otherwise(k).alias("id"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return ingest.dense_ids(d, "id", "n", "start").select("doc_id", F.col("start").cast("long").alias("start"))


@query("""SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::BIGINT AS line, doc_id, doc_id % 7 = 3 AS bad FROM documents WHERE lang IS NOT NULL QUALIFY bad""")
def numbered_bad_lines(spark, sf_dir):
    """JSON lines, a folder for each language whose files go on where the one before ends, some of them broken: all of those with their numbers."""
    path = _at(spark, "lines")
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").filter("lang is not null").select("lang", "doc_id", "text").repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id")
    line = F.when(k % 7 == 3, F.concat(F.lit('{"ada": '), k.cast("string"), F.lit(', "text":'))).otherwise(F.to_json(F.struct(k.alias("ada"), "text")))
    d.select("lang", line.alias("value")).write.partitionBy("lang").text(path)
    bad = readers.bad_lines(spark, path, folders=True)
    return bad.select(F.regexp_extract("file", "lang=([^/]*)", 1).alias("lang"), "line", F.regexp_extract("text", "([0-9]+)", 1).cast("long").alias("doc_id"), F.lit(True).alias("bad"))


@query(f"SELECT coalesce({_REASON}, 'accepted') AS outcome, count(*) AS n FROM ({_RAW}) GROUP BY ALL")
def counted_write(spark, sf_dir):
    """Outcomes counted by the job that writes the records."""
    path = _at(spark, "counted")
    got = log.written_and_counted(_raw(spark, sf_dir).select("event_id", "ada", "reason"), path)
    rows = [(k, v) for k, v in got.items() if v]
    return spark.createDataFrame(rows, "outcome string, n long")


@query(f"SELECT outcome, sum(n)::BIGINT AS n, 2::BIGINT AS batches FROM (SELECT coalesce({_REASON}, 'accepted') AS outcome, count(*) AS n FROM ({_RAW}) GROUP BY ALL UNION ALL SELECT unnest(['accepted', 'invalid_or_out_of_range_date', 'wrong_organization', 'missing_ada']), 0) GROUP BY outcome")
def run_log(spark, sf_dir):
    """Two batches of a stream whose listener logs what each counted; the log is a table."""
    at = _at(spark, "logged")
    d = _raw(spark, sf_dir).select("ada", "event_id", "day", "reason")
    middle = (d.agg(F.max("event_id")).head()[0] or 0) // 2
    listener = log.RunLog(f"{at}/log")
    spark.streams.addListener(listener)
    try:
        for part in (F.col("event_id") <= middle, F.col("event_id") > middle):
            _arrived(d, part, f"{at}/in")
            s = spark.readStream.schema(d.schema).parquet(f"{at}/in").observe("outcomes", *log.outcomes())
            crawl.run(s, f"{at}/checkpoint", f"{at}/accepted", f"{at}/rejected", "ada", "event_id")
        e = log.entries(spark, f"{at}/log")
    finally:
        spark.streams.removeListener(listener)
    return e.groupBy("outcome").agg(F.sum("n").alias("n"), F.count("*").alias("batches"))


# --- texts of other scripts ---------------------------------------------------------------------------------------

#: Vowels as letters of other scripts that decompose, and what is left of those.
_FAR, _FAR_BASE = "ёйќक़שׁЁЙЌक़שׁ", "еикकשеикकש"
_GREEK = "ΑΒΨΔΕΦΓΗΙΞΚΛΜΝΟΠΘΡΣΤΥΩΧΖΑΕ"


@query(f"SELECT doc_id, md5({_norm_sql(f'''translate(text, 'aeiouAEIOU', '{_FAR_BASE}')''')}) AS digest FROM documents")
def normalized_scripts(spark, sf_dir):
    """Texts with Cyrillic, Devanagari and Hebrew letters in place of vowels, normalised."""
    return texts(spark, sf_dir).select("doc_id", F.md5(tx.normalize(F.translate("text", "aeiouAEIOU", _FAR))).alias("digest"))


_CAPITALS = f"translate(upper(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{_GREEK}')"


@query(f"SELECT doc_id, md5(regexp_replace(lower({_CAPITALS}), '(\\p{{L}})σ( |$)', '\\1ς\\2', 'g')) AS digest FROM documents")
def final_sigma(spark, sf_dir):
    """Greek capitals to small letters: a sigma that ends a word of several letters is a final one."""
    capitals = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z ]", " ")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", _GREEK)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower(capitals)).alias("digest"))


# --- repair by recognition, strict reads, and whole answers -------------------------------------------------------


@query("""SELECT s.key AS ada, CASE WHEN d.doc_id IS NULL THEN 'not_in_dataset' WHEN d.doc_id % 5 = 0 THEN 'missing_document_url' WHEN d.doc_id % 7 = 0 THEN 'ocr_failed' WHEN d.doc_id % 11 = 0 THEN 'no_text' END AS error,
 CASE WHEN error IS NULL THEN md5('u' || d.doc_id || ' one' || chr(10) || chr(10) || 'x' || chr(10) || chr(10) || 'two') END AS digest, CASE WHEN error IS NULL THEN 2 END::INT AS pages
 FROM (SELECT 'A' || (doc_id * 2) AS key FROM documents WHERE doc_id % 3 = 0) s LEFT JOIN documents d ON s.key = 'A' || d.doc_id""")
def ocr_repair(spark, sf_dir):
    """Suspicious keys looked up in the dataset, whose last record of a key counts; recognised pages cleaned and joined, what fails told by reason."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    data = d.select(F.concat(F.lit("A"), k.cast("string")).alias("ada"), k.alias("line_no"), F.when(k % 5 != 0, F.concat(F.lit("u"), k.cast("string"))).alias("document_url"), "text")
    data = data.unionByName(data.withColumns({"line_no": F.col("line_no") - 1_000_000, "document_url": F.lit("an older one")}))
    n = lambda u: F.substring(u, 2, 20).cast("long")
    recognise = lambda u: F.when(n(u) % 7 == 0, None).when(n(u) % 11 == 0, F.array(F.lit(" \r\n"))).otherwise(F.array(F.concat(u, F.lit(" one\r\n\n\n\nx")), F.lit(" \n"), F.lit("two\n")))
    suspicious = d.filter(k % 3 == 0).select(F.concat(F.lit("A"), (k * 2).cast("string")).alias("ada"))
    good, bad = merge.repair(suspicious, data, "ada", "line_no", recognise)
    good = good.select("ada", F.lit(None).cast("string").alias("error"), F.md5("text").alias("digest"), F.size("pages").alias("pages"))
    return good.unionByName(bad.select("ada", "error"), allowMissingColumns=True)


@query("SELECT min(line)::BIGINT AS line, true AS fails, count(*)::BIGINT AS whole FROM (SELECT doc_id, CASE WHEN doc_id % 100 = 37 THEN row_number() OVER (ORDER BY doc_id) END AS line FROM documents)")
def strict_failure(spark, sf_dir):
    """A folder of JSON lines with broken ones: a strict read fails, the checked one tells the first bad line; without them both read all."""
    path = _at(spark, "strict")
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(k.alias("ada"), "source")).alias("value")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    d.select("value").write.text(f"{path}/good")
    d.select(F.when(k % 100 == 37, "{broken").otherwise(F.col("value")).alias("value")).write.text(f"{path}/bad")
    line, fails = None, False
    try:
        readers.checked(spark, f"{path}/bad", "ada long, source string", folders=True)
    except RuntimeError as e:
        line = int(str(e).split("line ")[1].split(" ")[0])
    try:
        readers.strict(spark, f"{path}/bad", "ada long, source string").agg(F.max("ada")).head()
    except Exception as e:  # noqa: BLE001  what kind of error Spark raises is Spark's
        fails = "MALFORMED_RECORD" in str(e) or "Malformed" in str(e)
    whole = readers.checked(spark, f"{path}/good", "ada long, source string", folders=True)
    return whole.agg(F.lit(line).cast("long").alias("line"), F.lit(fails).alias("fails"), F.count("*").alias("whole"))


_QUESTION = "CASE WHEN qid % 500 = 0 THEN 'Hello' WHEN qid % 700 = 0 THEN 'thanks' ELSE 'Q' || qid END"


@query(f"""WITH c AS (SELECT qid, string_agg('Θέμα: ' || id || chr(10) || 'ΑΔΑ: None' || chr(10) || 'Ημερομηνία: None' || chr(10) || 'URL: u/' || id || chr(10) || chr(10) || 'c' || id, chr(10) || chr(10) ORDER BY rank) AS context, string_agg(id::VARCHAR, ',' ORDER BY rank) AS sources FROM ({_topk_sql(5)}) GROUP BY qid),
 q AS (SELECT qid, {_QUESTION} AS question, context, sources FROM c)
 SELECT qid, CASE question WHEN 'Hello' THEN 'greeting' WHEN 'thanks' THEN 'thanks' ELSE 'retrieve' END AS route, CASE WHEN question LIKE 'Q%' THEN 1 ELSE 0 END::INT AS iterations, CASE WHEN question LIKE 'Q%' THEN sources END AS sources,
 CASE question WHEN 'Hello' THEN '{agent.HELLO_REPLY}' WHEN 'thanks' THEN '{agent.BYE_REPLY}' ELSE md5('Rules' || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Ερώτηση:' || chr(10) || question || chr(10) || chr(10) || 'Απάντηση:' || chr(10)) END AS answer FROM q""")
def agent_answers(spark, sf_dir):
    """Questions routed, searched, assembled, answered by a generator that signs its prompt, and cleaned up."""
    found = _found(spark, sf_dir, 5)
    qid = F.col("qid")
    questions = found.select("qid").distinct().withColumn("question", F.when(qid % 500 == 0, "Hello").when(qid % 700 == 0, "thanks").otherwise(F.concat(F.lit("Q"), qid.cast("string"))))
    s = F.col("id").cast("string")

    def retrieve(asked):
        return agent.assemble(found.join(asked, "qid", "left_semi"), agent.context_part(s, F.lit(None), F.lit(None), F.concat(F.lit("u/"), s), F.concat(F.lit("c"), s)), s)

    signed = lambda p: F.concat(F.lit("thinking ... Απάντηση: "), F.md5(p), F.lit("\n"), F.md5(p), F.lit("\nUser: more"))
    a = agent.answer(questions, retrieve, signed, "Rules")
    return a.select("qid", "route", "iterations", F.array_join("sources", ",").alias("sources"), "answer")
