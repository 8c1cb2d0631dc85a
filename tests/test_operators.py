"""Operators on small frames."""

import json

import pytest
from pyspark.sql import functions as F

from quillstream.operators import agent, chunk, evaluate, extract, ingest, merge, search
from quillstream.sources import paged, readers, writers
from quillstream.streaming import crawl


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def ranked(spark, *items):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(items, 1)], "qid long, rank int, id string")


def test_fusion(spark):
    a, b = ranked(spark, "x", "y"), ranked(spark, "y", "z")
    for weights in ([0.3, 0.7], [3, 7]):
        got = search.fuse([a, b], weights, 15).orderBy("rank").collect()
        assert [r["id"] for r in got] == ["y", "z", "x"]
        assert [round(r["score"], 7) for r in got] == [0.0163141, 0.0112903, 0.0049180]
    tie = search.fuse([ranked(spark, "p"), ranked(spark, "q")], None, 15).orderBy("rank").collect()
    assert [r["id"] for r in tie] == ["p", "q"]
    for weights in ([1], [0, 0]):
        with pytest.raises(ValueError):
            search.fuse([a, b], weights)


def test_top_k_and_slices(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)], "id long, v array<float>")
    q = v.filter("id < 4").select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    whole = rows(search.top_k(q, v, 3, others_only=True))
    monkeypatch.setattr(search, "MOST_QUERIES", 2)
    assert rows(search.top_k(q, v, 3, others_only=True)) == whole
    assert [r[2] for r in whole if r[0] == 2] == [5, 8, 1]


@pytest.mark.parametrize("fused", [False, True])
def test_top_k_of_few_vectors(spark, monkeypatch, fused):
    """Many queries on few vectors, which are broadcast in their stead: the same rows, with copies, nulls and other lengths, in one slice or several."""
    v = [(i, [0.1 * (i % 4), 0.3, 0.7]) for i in range(20)] + [(30, None), (31, [1.0, None, 2.0]), (32, [9.0, 9.0]), (33, [0.0, 0.0, 0.0]), (34, [None])]
    q = [(i, [0.1 * (i % 7) - 0.2, 0.3, 0.1 * (i % 3)]) for i in range(50)] + [(50, [1.0, 1.0]), (51, None), (52, [0.0, 0.0, 0.0]), (53, [None, 1.0, 1.0]), (54, [1.0])]
    d = spark.createDataFrame(v, "id long, v array<double>").repartition(3)
    q = spark.createDataFrame(q, "qid long, qv array<double>").repartition(3)
    for others_only in (False, True):
        whole = rows(search.top_k(q, d, 5, others_only, fused))
        assert len(whole) == 51 * 5 + 1
        for block, most in ((7, 100), (7, 6)):
            with monkeypatch.context() as m:
                m.setattr(search, "BLOCK", block)
                m.setattr(search, "MOST_QUERIES", most)
                assert rows(search.top_k(q, d, 5, others_only, fused)) == whole


def test_unique_documents_and_metrics(spark):
    r = spark.createDataFrame([(1, i, d) for i, d in enumerate(["d1", "d1", "d2", "", "d3"], 1)], "qid long, rank int, document string")
    u = search.unique_documents(r, "document")
    assert [x[1:] for x in rows(u)] == [(1, "d1"), (2, "d2"), (3, "d3")]
    q = spark.createDataFrame([(1, ["d2"]), (2, ["d9"])], "qid long, expected array<string>")
    m = {x["qid"]: x for x in evaluate.with_hits(evaluate.first_relevant(q, u)).collect()}
    assert (m[1]["first_rank"], m[1]["hit_1"], m[1]["hit_3"], m[1]["rr"]) == (2, 0, 1, 0.5)
    assert (m[2]["first_rank"], m[2]["rr"]) == (None, 0.0)
    s = evaluate.retrieval_summary(evaluate.with_hits(evaluate.first_relevant(q, u))).head()
    assert (s["queries"], s["hit_3"], s["mrr"]) == (2, 0.5, 0.25)


def test_validation_cascade(spark):
    d = spark.createDataFrame([("2020-12-31", "9", ""), ("2021-01-01", "9", ""), ("2026-12-31", None, ""), ("2022-02-02", None, "A"), (None, "7", "A"), ("2027-01-01", "7", "A")], "d string, o string, k string")
    got = [r["reason"] for r in ingest.validate(d, "d", "o", "k", "7").collect()]
    assert got == ["invalid_or_out_of_range_date", "wrong_organization", "missing_ada", None, "invalid_or_out_of_range_date", "invalid_or_out_of_range_date"]


def test_unwrap(spark):
    body = ['[{"a":1},2]', '{"decisions":[],"results":[{"a":1}]}', '{"data":{"items":[{"a":2}]}}', '{"data":{},"response":{"data":{"documents":[{"a":3}]}}}', "{}", None, "bad"]
    got = rows(ingest.unwrap(spark.createDataFrame(list(enumerate(body)), "i int, payload string")))
    assert [(i, json.loads(r)["a"]) for i, _, r in got] == [(0, 1), (2, 2), (3, 3)]


def test_normalize_record(spark):
    raw = spark.createDataFrame([("", " B ", 0, "1609459200000", "", None)], "ada string, iun string, x int, submissionTimestamp string, organizationId string, privateData boolean")
    r = ingest.normalize(raw, "7").head()
    assert (r["ada"], r["issue_date"], r["organization_id"], r["unit_ids"], r["private_data"], r["document_url"]) == ("B", "2021-01-01", "7", [], False, "https://documents.invalid/B")


def test_keep_first_last_and_resume(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, None)], "k string, n int, v string")
    assert rows(ingest.keep_first(d, "k", "n")) == [("a", 1, "x"), ("b", 3, None)]
    assert rows(ingest.keep_last(d, "k", "n")) == [("a", 2, "y"), ("b", 3, None)]
    once = ingest.keep_first(d, "k", "n")
    assert rows(ingest.keep_first(once, "k", "n")) == rows(once)
    assert rows(ingest.not_yet(d, spark.createDataFrame([("a",), (None,)], "k string"), "k")) == [("b", 3, None)]


def test_merge(spark):
    o = spark.createDataFrame([("A", "a"), ("B", "b"), ("B", "b2"), (None, "n")], "ada string, t string")
    r = spark.createDataFrame([("B", "B1", 1), ("B", None, 2), ("C", "c", 3), (None, "z", 4)], "ada string, t string, line_no int")
    m = merge.replace_by_key(o, r, "ada", "line_no")
    assert rows(m) == sorted([("A", "a", False), ("B", None, True), ("B", None, True), (None, "n", False)], key=str)
    assert rows(merge.orphans(r, o, "ada")) == [("C",)]
    assert merge.checked(o, m, "ada") is m
    with pytest.raises(RuntimeError):
        merge.checked(o, m.limit(2), "ada")


def test_repair(spark):
    data = spark.createDataFrame([("A", "u", "old", 1), ("B", None, "old", 2)], "ada string, document_url string, text string, line_no int")
    s = spark.createDataFrame([("A",), ("B",), ("X",)], "ada string")
    good, bad = merge.repair(s, data, "ada", "line_no", lambda u: F.array(F.concat(u, F.lit(" page\r\n\n\n\nx")), F.lit(" ")))
    assert [(r["ada"], r["text"], r["text_page_count"], r["repaired"]) for r in good.collect()] == [("A", "u page\n\nx", 1, True)]
    assert rows(bad.select("ada", "error")) == [("B", "missing_document_url"), ("X", "not_in_dataset")]


def test_outcomes(spark):
    long = "word " * 40
    data = [
        ("", "u", b"%PDF", None, None, [long], "missing_ada"),
        ("A", "u", b"%PDF", None, None, [long], "already_completed"),
        ("B", " ", b"%PDF", None, None, [long], "missing_document_url"),
        ("C", "u", b"", None, None, [long], "download_failed"),
        ("D", "u", b"<html", "text/html", None, [long], "invalid_pdf_response"),
        ("E", "u", b"%PDF", None, "encrypted_pdf", None, "encrypted_pdf"),
        ("F", "u", b"%PDF", None, None, ["short page text"], "insufficient_extracted_text"),
        ("G", "u", b"xx", " Application/PDF", None, [long, "tiny"], "completed"),
    ]
    d = spark.createDataFrame(data, "ada string, document_url string, content binary, content_type string, error string, pages array<string>, want string")
    o = extract.outcome(d, spark.createDataFrame([("A",)], "ada string"))
    assert all(r["outcome"] == r["want"] for r in o.collect())
    (r,) = extract.dataset_records(o).collect()
    assert (r["ada"], r["text_page_count"], r["pdf_size_bytes"]) == ("G", 1, 2)
    assert extract.failed_records(o).count() == 6


def test_pdf_pages_and_rows(spark):
    def read(raw):
        if raw == b"locked":
            raise PermissionError
        return raw.decode().split("|")

    d = spark.createDataFrame([(1, b"a| |b"), (2, b"locked"), (3, b"\xff"), (4, None)], "i int, content binary")
    p = readers.pdf_pages(d, read)
    assert rows(p.select("i", "error")) == [(1, None), (2, "encrypted_pdf"), (3, "pdf_read_error"), (4, None)]
    assert rows(extract.page_rows(p.select("i", "pages"), "pages").select("i", "page", "page_text")) == [(1, 1, "a"), (1, 3, "b")]


def test_chunks(spark):
    assert chunk.pieces("aaaa bbbb cccc", [" ", ""], 9, 4) == ["aaaa bbbb", "cccc"]
    assert chunk.pieces("ab cd ef gh", [" ", ""], 6, 3) == ["ab cd", "cd ef", "ef gh"]
    assert chunk.pieces("x" * 25, chunk.SEPARATORS, 10, 2) == ["x" * 10, "x" * 10, "x" * 9]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(["p " * 1200, "", None, "short", "q\n\n" * 900])], "doc_id long, text string")
    for how in (chunk.recursive, chunk.fixed):
        c = chunk.with_ids(how(d), "doc_id").orderBy("chunk_id").collect()
        assert [r["chunk_id"] for r in c] == list(range(len(c)))
        assert [r["doc_id"] for r in c] == sorted(r["doc_id"] for r in c)
        assert all(0 < len(r["chunk"]) <= 1000 for r in c)


def test_grouping_and_grid(spark):
    d = spark.createDataFrame([("m", "r", "a", 1.0), ("m", "r", "b", None), ("m", "r", "b", 0.0)], "model string, retriever string, category string, x double")
    assert rows(evaluate.overall_and_by(d, ["model", "retriever"], "category", ["x"])) == [("m", "r", "a", 1, 1.0), ("m", "r", "b", 2, 0.0), ("m", "r", "overall", 3, 0.5)]
    s = d.groupBy("model", "retriever").agg(F.avg("x").alias("x"))
    m = spark.createDataFrame([("m",), ("n",)], "model string")
    assert rows(evaluate.grid(m, spark.createDataFrame([("r",)], "retriever string"), s)) == [("m", "r", 0.5), ("n", "r", None)]


def test_answer(spark):
    q = spark.createDataFrame([(1, "γεια"), (2, "Πού;")], "qid long, question string")
    found = lambda d: d.select("qid", F.lit("ctx").alias("context"), F.array(F.lit("s")).alias("sources"))
    got = {r["qid"]: r for r in agent.answer(q, found, lambda p: F.concat(F.lit("Απάντηση: "), F.length(p).cast("string"))).collect()}
    assert got[1]["answer"] == agent.HELLO_REPLY and got[1]["context"] is None
    assert got[2]["context"] == "ctx" and got[2]["answer"].isdigit()


def test_json_modes_and_sinks(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"ada":"A"}\nbad\n\n{"ada":null}\n[1,2]\n')
    good, bad = readers.tolerant(spark, str(p), "ada string")
    assert good.count() == 2 and bad.count() == 2
    assert readers.silent(spark, str(p), "ada string").count() == 2
    with pytest.raises(Exception):  # noqa: B017
        readers.strict(spark, str(p), "ada string").collect()
    assert rows(readers.keys(spark, str(p), "ada")) == [("A",)]
    assert readers.keys(spark, str(tmp_path / "none"), "ada").count() == 0
    d = spark.createDataFrame([("good", 1, ["a", "b"]), ("suspicious", 2, None)], "status string, n int, r array<string>")
    writers.split(d, {"good": str(tmp_path / "g"), "suspicious": str(tmp_path / "s")}, "status")
    assert spark.read.json(str(tmp_path / "g")).count() == 1
    writers.results_csv(d, str(tmp_path / "c"))
    assert {r["r"] for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {"a, b", None}
    writers.results_json(d.select("status", "n"), ["status"], str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["good"] == {"n": 1}
    index = readers.index(spark, str(tmp_path / "i"), lambda: d.select("n"))
    assert index.count() == 2 and readers.index(spark, str(tmp_path / "i"), lambda: None).count() == 2


def test_corpus(spark, tmp_path):
    p = tmp_path / "final.jsonl"
    p.write_text('{"ada":"A","subject":"s","text":"t"}\n{"ada":"B","text":"  "}\n{"source_id":"x","source":"external_pdf","text":"u"}\nbad\n')
    c = readers.corpus(spark, str(p))
    assert rows(c.select("page_content")) == [("u",), ("Θέμα: s\n\nΚείμενο:\nt",)]
    assert rows(readers.source_counts(c)) == [("diavgeia", 1), ("external_pdf", 1)]
    (tmp_path / "empty.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        readers.corpus(spark, str(tmp_path / "empty.jsonl"))


def answer_page(params):
    return json.dumps({"decisions": [{"ada": f"{params.get('org')}-{params['page']}"}]})


def test_paged_source(spark):
    tries = []

    def flaky(params):
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "[]"

    waits = []
    assert paged.fetch_with_retries(flaky, {}, pause=waits.append) == "[]" and waits == [1, 2]
    with pytest.raises(RuntimeError):
        paged.fetch_with_retries(lambda p: "<html>", {}, pause=waits.append)
    r = paged.PagedReader({"fetch": "json:dumps", "pages": "2"})
    assert [p.value for p in r.partitions()] == [0, 1]
    assert list(r.pushFilters([paged.EqualTo(("org",), "7"), paged.EqualTo(("page",), 1)])) == [paged.EqualTo(("page",), 1)]
    assert r.params == {"org": "7"}
    (row,) = r.read(paged.Page(1))
    assert row[0] == 1 and json.loads(row[-1]) == {"org": "7", "page": 1, "size": 20}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(paged.PagedSource)
    d = spark.read.format("paged").option("fetch", "json:dumps").option("pages", "2").load()
    assert d.count() == 2
    (row,) = d.filter("org = '7' and page = 1").collect()
    assert json.loads(row["payload"])["org"] == "7"
    dated = d.filter("from_date = '2024-01-01' and to_date = '2024-02-01' and page = 0").collect()
    assert [json.loads(r["payload"])["from_date"] for r in dated] == ["2024-01-01"]


def test_walk(spark):
    n = spark.createDataFrame([("a", "root", "A"), ("b", "a", "B"), ("c", "b", "C"), ("z", "y", "Z")], "id string, parent string, name string")
    assert rows(readers.walk(spark, n, "root")) == [("a", "A", 0), ("b", "A/B", 1), ("c", "A/B/C", 2)]


def test_stream_reruns(spark, tmp_path):
    d = spark.createDataFrame([("A", 1, None), ("A", 2, None), ("B", 3, None), ("C", 4, "bad")], "ada string, n int, reason string")
    for i in range(2):
        d.coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
        s = spark.readStream.schema(d.schema).parquet(str(tmp_path / f"in{i}"))
        crawl.run(s, str(tmp_path / f"ck{i}"), str(tmp_path / "ok"), str(tmp_path / "no"), "ada", "n")
    assert rows(spark.read.parquet(str(tmp_path / "ok"))) == [("A", 1), ("B", 3)]


def test_invalid_cases(spark):
    d = spark.createDataFrame([("q", ""), (None, "x"), ("q", "x")], "question string, category string")
    assert sorted(r["missing"] for r in evaluate.invalid_cases(d, ["question", "category"]).collect()) == [["category"], ["question"]]
