"""Fetching, embedding, retrievers, registries, cases and result files, beside their queries."""

import pytest
from pyspark.sql import functions as F

from quillstream.operators import embed, evaluate, runs
from quillstream.sources import fetch, readers, writers


def test_fetch_retries():
    tries, waits = [], []

    def get(url):
        tries.append(url)
        if len(tries) < 3:
            raise OSError("refused")
        return [b"%P", b"DF"], None

    assert fetch.fetch(get, "u", 3, waits.append) == (b"%PDF", "") and waits == [1, 2]
    for bad in (lambda u: (b"", "x"), lambda u: ([], "x")):
        with pytest.raises(RuntimeError):
            fetch.fetch(bad, "u", 2, waits.append)
    once = []
    with pytest.raises(RuntimeError):
        fetch.fetch(lambda u: once.append(u) or (b"", ""), "u", 1, waits.append)
    assert len(once) == 1


def test_contents_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(fetch, "MOST", 10)
    d = spark.createDataFrame([(1, "a"), (2, None), (3, "  "), (4, "b" * 30), (5, "no")], "error int, document_url string")

    def get(u):
        if u == "no":
            raise OSError
        return u.encode(), "t"

    got = fetch.contents(d, get, tries=1).collect()
    assert [(r["content"] and bytes(r["content"]), r["error"]) for r in sorted(got, key=lambda r: str(r["document_url"]))] == [(None, None), (None, None), (b"a", None), (b"b" * 30, None), (None, "download_failed")]
    assert fetch.contents(d.limit(0), get).count() == 0


def test_folders(spark):
    assert fetch.folder_ids([" a", None, "", "b "]) == ["a", "b"]
    with pytest.raises(ValueError):
        fetch.folder_ids(["", None])
    d = spark.createDataFrame([("a", "f", 2), ("a", "f", 1), ("b", "f", 0), ("c", "g", 0)], "folder string, file_id string, place int")
    assert [tuple(r) for r in fetch.in_folders(d, ["a", "b", "a"]).collect()] == [("a", "f", 1)]


def test_encode_and_modes(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None), (3, "a a b")], "id long, text string")
    calls = []
    got = {r["id"]: r["embedding"] for r in embed.encode(d, embed.hashed_words(8), batch=2).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-12 and got[2] == [0.0] * 8 and calls == []
    with pytest.raises(Exception, match="another number"):
        embed.encode(d, lambda t: []).collect()
    v = embed.encode(d.filter("id <> 2"), embed.hashed_words(8)).select("id", F.col("embedding").alias("v"))
    r = embed.Retrievers({m: lambda: v for m in embed.BATCH}, dict.fromkeys(embed.BATCH, embed.hashed_words(8)))
    q = spark.createDataFrame([(7, "a a a b")], "qid long, question string")
    for mode in (" BGE ", "minilm", "Ensemble"):
        assert [x["id"] for x in r.load(mode)(q).orderBy("rank").collect()] == [3, 1]
    with pytest.raises(ValueError):
        r.load("other")
    assert len(r.held) == 2
    r.clear()
    assert not r.held


def test_registry():
    r = runs.Registry({"local": lambda c: c["size"]})
    r.add("m", "local", size=3)
    r.add("n", "remote")
    assert r.load("m") == 3
    for key in ("n", "o"):
        with pytest.raises(ValueError):
            r.load(key)


def test_cases(spark):
    row = ("q", "a", ["x"], "c", True)
    schema = "question string, expected_answer string, expected_adas array<string>, category string, answerable boolean"
    good = spark.createDataFrame([row, ("r", "b", [], "c", False)], schema)
    assert [x.count() for x in runs.parted(runs.checked_cases(good))] == [1, 1]
    for i in range(5):
        bad = [*row]
        bad[i] = None if i in (2, 4) else " "
        with pytest.raises(ValueError):
            runs.checked_cases(spark.createDataFrame([tuple(bad)], schema))
    with pytest.raises(ValueError):
        runs.checked_cases(good.drop("category"))
    ids = good.select(runs.expected_ids(F.array(F.lit("a"), F.lit("a")), F.lit(None).cast("array<string>"), F.array(F.lit("b"), F.lit("a")))).head()[0]
    assert ids == ["a", "b"]
    assert good.select(runs.identifier(F.lit(" "), F.lit(" s "))).head()[0] == "s"


def test_judge_errors(spark):
    d = spark.createDataFrame([("q", "a", "", "", True), ("q", "b", "", "", False)], "question string, answer string, context string, expected_answer string, answerable boolean")

    def judge(metric, case):
        if metric == "answer_relevancy":
            raise RuntimeError
        return 0.5

    got = [tuple(r[m] for m in runs.JUDGED) for r in runs.judged_details(d, judge).orderBy("answer").collect()]
    assert got == [(0.5, None, 0.5, 0.5), (0.5, None, None, None)]
    assert evaluate.judged(runs.judged_details(d, judge), []).head()["faithfulness"] == 0.5


def test_files(spark, tmp_path):
    d = spark.createDataFrame([("a", 1, ["x", "y"]), (None, 2, None)], "k string, n int, l array<string>")
    writers.results_csv_file(d.orderBy("n"), f"file://{tmp_path}/s.csv")
    assert (tmp_path / "s.csv").read_bytes() == b"\xef\xbb\xbfk,n,l\r\na,1,\"x, y\"\r\n,2,\r\n"
    with pytest.raises(ValueError):
        writers.split(d, {"a": str(tmp_path / "a")}, "k")
    assert not (tmp_path / "a").exists()
    writers.split(d, {"a": str(tmp_path / "a")}, "k", rest=str(tmp_path / "r"))
    assert [spark.read.json(str(tmp_path / x)).count() for x in "ar"] == [1, 1]
    (tmp_path / "x.jsonl").write_text('{"a":1}\n\n{"a":2}\nbroken\nworse\n')
    at = readers.first_bad(spark, f"file://{tmp_path}/x.jsonl")
    assert at[1:] == (4, "broken") and readers.first_bad(spark, str(tmp_path / "a")) is None
    odd = spark.createDataFrame([("1", "it's", "n"), ("2", "1", "m")], "id string, parent string, name string")
    assert [r["path"] for r in readers.walk(spark, odd, "it's", "'").orderBy("depth").collect()] == ["n", "n'm"]
