"""The paged service as batches and as a stream, state keyed by record, and sinks that commit as a whole."""

import json
import os
import time
from functools import reduce

import pytest
from pyspark.sql import functions as F

from quillstream.operators import ingest, search
from quillstream.sources import paged, readers, saved, writers
from quillstream.store import Folder
from quillstream.streaming import crawl, log


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def service(spark, path, n, orgs=("7", "9")):
    d = spark.range(n).select("id", F.element_at(F.array(*map(F.lit, orgs)), (F.col("id") % len(orgs) + 1).cast("int")).alias("org"), F.lit("PUBLISHED").alias("status"), F.date_add(F.lit("2024-01-01"), (F.col("id") % 10).cast("int")).alias("issue_date"))
    d = d.withColumn("record", F.to_json(F.struct("id", F.col("org").alias("organizationId"), "status", F.col("issue_date").alias("issueDate"))))
    saved.save(d.repartition(3), path, "id")
    return paged.given(saved.answers(path))


def test_answers(spark, tmp_path):
    path = f"file://{tmp_path}/service"
    service(spark, path, 25)
    fetch = saved.answers(path)
    ids = lambda **p: [r["id"] for r in paged.records_of(fetch({"size": 10} | p))]
    assert ids(page=0) == list(range(10)) and ids(page=2) == list(range(20, 25)) and ids(page=3) == []
    assert ids(page=0, org="9") == list(range(1, 20, 2)) and ids(page=1, org="9") == [21, 23]
    assert ids(page=0, from_date="2024-01-04", to_date="2024-01-05") == [3, 4, 13, 14, 23, 24]


def test_answers_over_many_blocks(spark, tmp_path, monkeypatch):
    """Pages of records that fit, over many blocks and parts of files."""
    monkeypatch.setattr(saved, "BLOCK", 100)
    monkeypatch.setattr(saved, "GROUP", 1000)
    path = f"file://{tmp_path}/service"
    service(spark, path, 5000, ("7", "9", "8"))
    fetch = saved.answers(path)
    day = lambda i: f"2024-01-{i % 10 + 1:02d}"
    for p in ({}, {"org": "9"}, {"org": "9", "from_date": "2024-01-04", "to_date": "2024-01-05"}, {"org": "x"}, {"from_date": "2024-01-09"}):
        want = [i for i in range(5000) if p.get("org", ("7", "9", "8")[i % 3]) == ("7", "9", "8")[i % 3] and p.get("from_date", "") <= day(i) <= p.get("to_date", "3")]
        for page in (0, 1, 3, len(want) // 70, len(want) // 70 + 1):
            assert [r["id"] for r in paged.records_of(fetch({"page": page, "size": 70} | p))] == want[page * 70 : page * 70 + 70]


def test_large_pages_come_in_parts(spark, tmp_path):
    """No request asks for more than `request` records, whatever the pages' size; rows are numbered by pages as before."""
    sizes, answer = [], saved.answers(f"file://{tmp_path}/service")
    service(spark, f"file://{tmp_path}/service", 333)

    def fetch(p):
        sizes.append(p["size"])
        return answer(p)

    whole = [(r // 100, r % 100, r) for r in range(333)]
    options = {"fetch": paged.given(fetch), "size": "100", "request": "30", "batch": "2", "progress": f"{tmp_path}/p"}
    s = paged.Service(options)
    s.fetch = fetch
    assert s.records({}) == 333 and s.pages({}) == 4 and s.length({}, 0, 3) == 300 and s.length({}, 1, 8) == 333 and set(sizes) == {30}
    reader = paged.RecordsReader(options)
    read = lambda r, ps: sorted((x[0], x[1], json.loads(x[-1])["id"]) for p in ps for x in r.read(p))
    assert read(reader, reader.partitions()) == whole
    list(reader.pushFilters([paged.In(("org",), ("7", "9"))]))
    assert len(read(reader, reader.partitions())) == 333
    stream = paged.RecordsStream(options)
    assert stream.latestOffset() == {"record": 200} and stream.latestOffset() == {"record": 333}
    assert [x for a, b in ((0, 200), (200, 333)) for x in read(stream, stream.partitions({"record": a}, {"record": b}))] == whole


def test_records_of():
    assert paged.records_of('{"response": {"data": {"items": [{"a": 1}, 2]}}}') == [{"a": 1}]
    assert paged.records_of('{"decisions": [], "results": [{"a": 1}]}') == [] and paged.records_of("{}") == [] and paged.records_of("3") == []


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 40, 57])
def test_ends_are_found(n):
    asked = []

    def fetch(p):
        asked.append(p["page"])
        return json.dumps([{"id": i} for i in range(n)][p["page"] * 10 : (p["page"] + 1) * 10])

    s = paged.Service({"fetch": paged.given(fetch), "size": "10"})
    s.fetch = fetch
    assert s.pages({}) == -(-n // 10) and len(asked) < 10
    assert s.length({}, 0, 8) == n and s.length({}, 0, 2) == min(n, 20)


def test_filters_are_sent(spark, tmp_path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(paged.PagedRecords)
    d = spark.read.format("paged_records").option("fetch", service(spark, f"file://{tmp_path}/service", 200)).option("size", 10).load()
    assert d.count() == 200 and d.agg(F.max("page")).head()[0] == 19
    some = d.filter("org = '9' and issue_date >= date'2024-01-04' and issue_date < date'2024-01-07'")
    got = [(r["page"], json.loads(r["record"])["id"]) for r in some.collect()]
    want = [i for i in range(200) if i % 2 and 3 <= i % 10 < 6]
    assert sorted(i for _, i in got) == want and max(p for p, _ in got) == len([i for i in range(200) if i % 2 and 3 <= i % 10 < 7]) // 10 - 1
    reader = paged.RecordsReader({"fetch": paged.given(lambda p: "[]")})
    list(reader.pushFilters([paged.In(("org",), ("7", "9")), paged.EqualTo(("org",), "9"), paged.EqualTo(("status",), "x")]))
    assert reader.requests() == [{"org": "9", "status": "x"}] and [r.pages for r in reader.partitions()] == [[]]


def test_stream_goes_on_within_a_page(spark, tmp_path):
    path = f"file://{tmp_path}/service"
    fetch = service(spark, path, 33)
    r = paged.RecordsStream({"fetch": fetch, "size": "10", "batch": "2", "progress": f"{tmp_path}/p"})
    assert r.initialOffset() == {"record": 0} and r.latestOffset() == {"record": 20}
    read = lambda a, b: [json.loads(x[-1])["id"] for p in r.partitions({"record": a}, {"record": b}) for x in r.read(p)]
    assert read(0, 20) == list(range(20))
    assert r.latestOffset() == {"record": 33} and read(20, 33) == list(range(20, 33)) and r.latestOffset() == {"record": 33}
    again = paged.RecordsStream({"fetch": service(spark, f"{path}2", 48), "size": "10", "batch": "2", "progress": f"{tmp_path}/p"})
    assert again.latestOffset() == {"record": 48} and read(33, 33) == []
    r = again
    assert [json.loads(x[-1])["id"] for p in r.partitions({"record": 33}, {"record": 48}) for x in r.read(p)] == list(range(33, 48))
    few = paged.RecordsStream({"fetch": fetch, "size": "10", "batch": "8", "pages": "1", "progress": f"{tmp_path}/q"})
    assert few.latestOffset() == {"record": 10} == few.latestOffset()


def test_crawl_that_fails_midway(spark, tmp_path):
    """Pages of a service; the third fails for good in the first run, which has stored two batches; the second run does the rest."""
    spark.dataSource.register(paged.PagedRecords)
    answer, broken = saved.answers(f"file://{tmp_path}/service"), f"{tmp_path}/broken"
    service(spark, f"file://{tmp_path}/service", 100)

    def fetch(p):
        import os

        if p["page"] >= 5 and os.path.exists(broken):
            raise OSError("out of order")
        return answer(p)

    open(broken, "w").close()
    s = spark.readStream.format("paged_records").option("fetch", paged.given(fetch)).option("size", 10).option("batch", 2).option("tries", 1).option("progress", f"{tmp_path}/p").load()
    s = s.select((F.get_json_object("record", "$.id").cast("long") % 60).alias("k"), F.get_json_object("record", "$.id").cast("long").alias("n"), F.when(F.col("org") == "9", "bad").alias("reason"))
    go = lambda: crawl.run(s, f"{tmp_path}/check", f"{tmp_path}/ok", f"{tmp_path}/no", "k", "n")
    with pytest.raises(Exception, match="failed"):
        go()
    stored = spark.read.parquet(f"{tmp_path}/ok").count()
    assert 0 < stored < 30
    import os

    os.remove(broken)
    go()
    assert rows(spark.read.parquet(f"{tmp_path}/ok").select("k", "n")) == sorted([(k, k) for k in range(0, 60, 2)], key=str)
    assert spark.read.parquet(f"{tmp_path}/no").count() == 50


def test_state_of_a_batch_is_its_own_keys(spark, tmp_path):
    """Batches read no stored rows and look up as many keys in the tenth batch as in the second."""
    s = spark.readStream.schema("k string, n long, reason string").parquet(f"{tmp_path}/in/*")
    looked, stored = [], []
    for i in range(6):
        spark.range(i * 100, i * 100 + 150).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("n"), F.lit(None).cast("string").alias("reason")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        got = crawl.run(s, f"{tmp_path}/check", f"{tmp_path}/ok", None, "k", "n")
        ops = [p["stateOperators"][0] for p in got if p["numInputRows"]]
        looked.append(sum(o["customMetrics"]["rocksdbGetCount"] for o in ops))
        stored.append(ops[-1]["numRowsTotal"])
    assert stored[-1] == 650 and max(looked[1:]) <= min(looked[1:]) * 1.2
    assert rows(spark.read.parquet(f"{tmp_path}/ok")) == sorted([(f"k{i}", i) for i in range(650)], key=str)


def test_a_new_checkpoint_over_stored_rows(spark, tmp_path):
    d = lambda *k: spark.createDataFrame([(x, i, None if x != "Z" else "bad") for i, x in enumerate(k)], "k string, n int, reason string")
    for i, keys in enumerate((["A", "B", "Z"], ["B", "C", "Z"])):
        d(*keys).coalesce(1).write.parquet(f"{tmp_path}/in{i}")
        s = spark.readStream.schema(d("A").schema).parquet(f"{tmp_path}/in{i}")
        crawl.run(s, f"{tmp_path}/ck{i}", f"{tmp_path}/ok", f"{tmp_path}/no", "k", "n")
    assert rows(spark.read.parquet(f"{tmp_path}/ok").select("k")) == [("A",), ("B",), ("C",)]
    assert rows(spark.read.parquet(f"{tmp_path}/no")) == [("Z", 2, "bad")]


def test_split_is_one_job(spark, tmp_path):
    d = spark.range(30).select("id", (F.col("id") % 3).cast("string").alias("k"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("split", "split")
    writers.split(d, {"0": f"{tmp_path}/a", "1": f"{tmp_path}/b"}, "k", rest=f"{tmp_path}/c")
    assert len(tracker.getJobIdsForGroup("split")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    writers.split(d, {"0": f"{tmp_path}/a", "1": f"{tmp_path}/b"}, "k", rest=f"{tmp_path}/c")
    assert [spark.read.json(f"{tmp_path}/{x}").count() for x in "abc"] == [20, 20, 20]
    writers.split(d, {"0": f"{tmp_path}/a", "9": f"{tmp_path}/e"}, "k", "overwrite", rest=f"{tmp_path}/c")
    assert [spark.read.json(f"{tmp_path}/{x}").count() for x in "ac"] == [10, 20] and (tmp_path / "e").exists()


def test_files_are_committed_together(spark, tmp_path):
    d = spark.range(40).select(F.concat(F.lit("a/"), "id").alias("name"), F.encode(F.concat(F.lit("é"), "id"), "utf-8").alias("content")).repartition(4)
    assert writers.contents(d, f"{tmp_path}/out", "name", "content", ".pdf") == 40
    got = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]).decode() for r in readers.files(spark, f"{tmp_path}/out").collect()}
    assert got["a%2F7.pdf"] == "é7" or got["a%252F7.pdf"] == "é7"
    with pytest.raises(Exception, match="twice"):
        writers.contents(d.union(d), f"{tmp_path}/twice", "name", "content")
    bad = d.withColumn("content", F.when(F.col("name") == "a/39", F.raise_error(F.lit("no such bytes")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no such bytes"):
        writers.contents(bad, f"{tmp_path}/bad", "name", "content")
    assert [Folder(spark, f"{tmp_path}/{x}").names(f"{tmp_path}/{x}") for x in ("twice", "bad")] == [[], []]


def test_dense_ids_of_far_ids(spark):
    ids = [*range(3000), (1 << 62) + 5, 1 << 61, -7]
    d = spark.createDataFrame([(i, i % 5 if i >= 0 else 2) for i in ids], "id long, n long").repartition(7)
    want, total = {}, 0
    for i in sorted(ids):
        want[i] = total
        total += i % 5 if i >= 0 else 2
    got = ingest.dense_ids(d, "id", "n", "start")
    assert {r["id"]: r["start"] for r in got.collect()} == want
    assert ingest.dense_ids(d.limit(0), "id", "n", "start").collect() == []


def test_top_k_ties_lengths_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 7)
    v = [(i, [0.1 * (i % 4), 0.3, 0.7]) for i in range(60)] + [(100, None), (101, [1.0, None, 2.0]), (102, [9.0, 9.0]), (103, [0.0, 0.0, 0.0])]
    d = spark.createDataFrame(v, "id long, v array<double>").repartition(3)
    q = spark.createDataFrame([(0, [0.2, 0.3, 0.1]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0, 0.0])], "qid long, qv array<double>")
    dot = lambda a, b: reduce(lambda s, x: s + x[0] * x[1], zip(a, b, strict=True), 0.0)  # noqa: E731  from left to right
    got = {}
    for r in search.top_k(q, d, 5, others_only=True).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["id"], r["score"]))
    for i, w in ((0, [0.2, 0.3, 0.1]), (1, [1.0, 1.0]), (3, [0.0, 0.0, 0.0])):
        fits = [(x, dot(w, y)) for x, y in v if y and None not in y and len(y) == len(w) and x != i]
        assert got[i] == sorted(fits, key=lambda x: (-x[1], x[0]))[:5]
    assert 2 not in got


def test_top_k_by_fused_sums(spark):
    """Of vectors whose scores differ in the last bit at most, the order is that of the engine that answers the SQL."""
    duckdb = pytest.importorskip("duckdb")
    n = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    v = [(i, n([float(x * k) for x in base])) for i, (k, base) in enumerate((k, b) for k in range(1, 40) for b in ((3, 1, 4, 1, 5), (2, 7, 1, 8, 2), (3, 1, 4, 1, 6)))]
    q = [(i, n([float(x) for x in w])) for i, w in enumerate(((1, 2, 3, 4, 5), (5, 3, 1, 2, 2), (9, 1, 7, 1, 3), (2, 2, 9, 4, 1)))]
    got = search.top_k(spark.createDataFrame(q, "qid long, qv array<double>"), spark.createDataFrame(v, "id long, v array<double>"), 30, fused=True)
    con = duckdb.connect()
    con.execute("CREATE TABLE q (qid BIGINT, qv DOUBLE[])")
    con.execute("CREATE TABLE v (id BIGINT, v DOUBLE[])")
    con.executemany("INSERT INTO q VALUES (?, ?)", q)
    con.executemany("INSERT INTO v VALUES (?, ?)", v)
    want = con.execute("SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, id, score FROM (SELECT *, list_inner_product(qv, v) AS score FROM q, v) QUALIFY rank <= 30").fetchall()
    assert rows(got) == sorted(want, key=str)
    assert search.fused_sums(search.np.array([1e308, 1e308]), search.np.array([[1.0, 1.0], [2.0, 1.0]])).tolist() == [float("inf")] * 2


def test_delay_is_within_a_task():
    s = paged.Service({"fetch": paged.given(lambda p: "[]"), "delay": "0.05"})
    began = time.time()
    list(paged.asked_for(s, paged.Run({}, [7000, 7001, 7002])))
    assert 0.1 <= time.time() - began < 5


def test_bad_lines_over_splits(spark, tmp_path):
    """Files of several splits, with blank lines, lines of many bytes, and Windows ends of lines."""
    want = []
    for f, end in (("a.json", "\n"), ("b.json", "\r\n"), ("c.json", "\n")):
        lines = []
        for i in range(1, 401):
            kind = (i * 7 + ord(f[0])) % 11
            lines.append("" if kind == 0 else "{broken %d" % i if kind == 1 else json.dumps({"k": i, "t": "é" * (i % 90)}))
            if kind == 1:
                want.append((f, i, "{broken %d" % i))
        (tmp_path / f).write_bytes(end.join(lines).encode() + end.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = [(r["file"].rsplit("/", 1)[1], r["line"], r["text"]) for r in readers.bad_lines(spark, str(tmp_path)).collect()]
        first = readers.first_bad(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got) == sorted(want) and first[0].endswith("a.json") and first[1:] == min(w for w in want if w[0] == "a.json")[1:]
    with pytest.raises(RuntimeError, match="a.json: line"):
        readers.checked(spark, str(tmp_path), "k long")
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "x.json").write_text('{"k": 1}\n\n{"k": 2}\n')
    assert readers.first_bad(spark, f"{tmp_path}/good") is None and readers.checked(spark, f"{tmp_path}/good", "k long").count() == 2


def test_bad_lines_through_folders(spark, tmp_path):
    """Two folders of several files each, of several splits: lines are counted on from file to file."""
    d = spark.range(900).select(F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("lang"), "id", F.when(F.col("id") % 7 == 3, F.concat(F.lit("{broken "), "id")).otherwise(F.to_json(F.struct("id"))).alias("value"))
    d.repartitionByRange(5, "lang", "id").sortWithinPartitions("lang", "id").select("lang", "value").write.partitionBy("lang").text(f"{tmp_path}/in")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = readers.bad_lines(spark, f"{tmp_path}/in", folders=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    kinds = {k: [i for i in range(900) if (i % 3 == 0) == (k == "x")] for k in "xy"}
    want = [(k, n, "{broken %d" % i) for k, ids in kinds.items() for n, i in enumerate(ids, 1) if i % 7 == 3]
    assert sorted((r["file"].split("lang=")[1][0], r["line"], r["text"]) for r in got) == sorted(want)
    assert len({r["file"] for r in got}) > 2


def test_no_task_writes_all_lines(spark, tmp_path):
    """Lines of one language are dealt to several files."""
    import __spark_entry__ as entry

    folders = lambda: {f"{p}/{x}" for p in [spark.conf.get("spark.checkpoint.dir").removeprefix("file://")] for x in os.listdir(p) if x.startswith("lines-")}
    spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.repeat(F.lit("text "), 200).alias("text")).write.parquet(f"{tmp_path}/in/documents.parquet")
    old = folders() if os.path.isdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) else set()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = entry.queries()["numbered_bad_lines"](spark, f"{tmp_path}/in")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert rows(got.select("line", "doc_id")) == sorted([(i + 1, i) for i in range(4000) if i % 7 == 3], key=str)
    assert max(len([x for x in os.listdir(f"{p}/lang=en") if x.startswith("part-")]) for p in folders() - old if os.path.isdir(f"{p}/lang=en")) > 1


@pytest.mark.parametrize("name, folder, batches", [("stream_rejects", "rejects-", 3), ("stream_dedup", "stream-", 4), ("run_log", "logged-", 2)])
def test_no_task_writes_all_that_arrives(spark, tmp_path, name, folder, batches):
    """What arrives for a batch is dealt to several files of about equal size, and is one batch nevertheless."""
    import __spark_entry__ as entry

    duckdb = pytest.importorskip("duckdb")
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    folders = lambda: {x for x in (os.listdir(base) if os.path.isdir(base) else []) if x.startswith(folder)}
    i = F.col("event_id")
    d = spark.range(90_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 28).alias("ts"), (F.col("id") % 9).alias("user_id"))
    d.select("*", F.lit("view").alias("event_type"), (i % 7).cast("double").alias("value"), F.lit("{}").alias("props")).coalesce(1).write.parquet(f"{tmp_path}/in/events.parquet")
    old = folders()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows(entry.queries()[name](spark, f"{tmp_path}/in"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/in/events.parquet/*.parquet'")
        assert got == sorted(con.execute(entry.oracle_sql()[name]).fetchall(), key=str)
    (made,) = folders() - old
    per = spark.read.parquet(f"file://{base}/{made}/in").groupBy(F.input_file_name()).count().collect()
    assert len(per) > batches and max(r["count"] for r in per) < 90_000 // batches * 3 // 4
    done = [x for x in os.listdir(f"{base}/{made}/checkpoint/commits") if x.isdigit()]
    assert len(done) == batches


def test_counters_and_log(spark, tmp_path):
    d = spark.createDataFrame([("A", 1, None), ("A", 2, None), ("B", 3, "missing_ada"), ("C", 4, "wrong_organization")], "k string, n int, reason string")
    assert log.written_and_counted(d, f"{tmp_path}/t") == {"accepted": 2, "invalid_or_out_of_range_date": 0, "wrong_organization": 1, "missing_ada": 1}
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4
    listener = log.RunLog(f"{tmp_path}/log")
    spark.streams.addListener(listener)
    try:
        for i in range(3):
            d.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            crawl.run(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in").observe("outcomes", *log.outcomes()), f"{tmp_path}/check", f"{tmp_path}/ok", None, "k", "n")
            crawl.run(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in").observe("outcomes", *log.outcomes()), f"{tmp_path}/check", f"{tmp_path}/ok", None, "k", "n")
        e = log.entries(spark, f"{tmp_path}/log")
        assert rows(e.groupBy("batch").agg(F.sum(F.when(F.col("outcome") == "accepted", F.col("n"))), F.sum("n"))) == [(i, 2, 4) for i in range(3)]
    finally:
        spark.streams.removeListener(listener)
