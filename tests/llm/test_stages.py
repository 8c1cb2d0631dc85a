"""Each stage of the pipeline by itself: against brute force where its decision is one, and on empty tables, nulls and repeated rows."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline as cp
from quillstream.llm import minhash, oracles

rnd = random.Random(11)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n):
    return " ".join("".join(rnd.choice(["ba", "ko", "mi", "tu", "re", "sal", "en", "dor"]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def edited(t, share):
    return " ".join("x" + w if rnd.random() < share else w for w in t.split())


@pytest.fixture(scope="module")
def rows():
    a, b, c = prose(120), prose(90), prose(200)
    texts = [a, b, edited(a, 0.03), a, b + " " + prose(3), c, prose(60), prose(60) + " " + c[:400], None, "", " \n", "12 !", "é" * 60 + c[:300]]
    out = [(i, t, "xx", f"s{i % 3}") for i, t in enumerate(texts)]
    out += [(0, a, "xx", "s0"), (0, c, "xx", "s1"), (None, a, "xx", None), (None, prose(70), None, "s1"), (None, None, None, None), (20, prose(8000), "xx", "s2"), (21, edited(c, 0.5), "xx", "s0")]
    return [(*r, len(r[1] or "")) for r in out]


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES])
def test_nothing_in_nothing_out(spark, docs, folder, stage):
    out = stage(spark, docs.limit(0), folder)
    assert out.collect() == [] and (stage is cp.mixed or out.columns == cp.COLUMNS)


def test_language(spark, docs, rows, folder):
    got = sorted(map(tuple, cp.language(spark, docs, folder).collect()), key=str)
    # One language is learned, so every text with a letter is surely its.
    assert got == sorted((r for r in rows if r[1] and any(c.isalpha() for c in r[1])), key=str)


def test_near_duplicates(spark, docs, rows, folder):
    texts = sorted({r[1] or "" for r in rows})
    w = [minhash.hashed(t.encode()) for t in texts]
    sk = [set(enumerate(minhash.sketches(minhash.labelled(x)).tolist())) if len(x) else set() for x in w]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sk[i] & sk[j] and minhash.similar(w[i], w[j]):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if x == hi else x for x in root]
    # Rows that share an id are one document.
    for i in {r[0] for r in rows if r[0] is not None}:
        own = [texts.index(r[1] or "") for r in rows if r[0] == i]
        for k in own[1:]:
            lo, hi = sorted((root[own[0]], root[k]))
            root = [lo if x == hi else x for x in root]
    of = {t: root[i] for i, t in enumerate(texts)}
    first = {}
    for r in rows:
        if r[0] is not None:
            first[of[r[1] or ""]] = min(first.get(of[r[1] or ""], r[0]), r[0])
    got = cp.near_duplicates(spark, docs, folder).collect()
    named = {(r["doc_id"], r["text"]) for r in got if r["doc_id"] is not None}
    assert named == {(r[0], r[1]) for r in rows if r[0] is not None and first[of[r[1] or ""]] == r[0]}
    alone = [r["text"] for r in got if r["doc_id"] is None]
    assert sorted(map(str, alone)) == sorted({str(r[1]) for r in rows if r[0] is None and of[r[1] or ""] not in first})


def test_repeated_passages(spark, docs, rows, folder):
    """Strings of 100 bytes that start earlier, in order of id, of a shared id in order of the text's digest; copies of a row are one document."""
    order = sorted({(-(2**63) if r[0] is None else r[0], hashlib.sha256((r[1] or "").encode()).hexdigest(), r[1] or "") for r in rows})
    seen, left = set(), {}
    for i, _, t in order:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        rest = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")
        left[i, t] = None if gone.any() and not any(c.isalnum() for c in rest) else rest
    want = [(r[0], left[-(2**63) if r[0] is None else r[0], r[1] or ""]) for r in rows]
    got = [(r["doc_id"], r["text"]) for r in cp.repeated_passages(spark, docs, folder).collect()]
    assert sorted(map(str, got)) == sorted(str(w) for w in want if w[1] is not None)


def test_benchmark_copies(spark, docs, rows, tmp_path):
    item = rows[5][1]
    spark.createDataFrame([(0, item), (1, None), (2, ""), (0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, cp.benchmark_copies(spark, docs, str(tmp_path)).collect()), key=str)
    whole = [r for r in rows if r[1] and item in r[1]]
    assert whole and not any(r in got for r in whole)
    assert [r for r in rows if not r[1] or not set(r[1].split()) & set(item.split())] == [r for r in rows if r in got and (not r[1] or not set(r[1].split()) & set(item.split()))]
    empty = spark.createDataFrame([], "item_id long, text string")
    empty.write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert sorted(map(tuple, cp.benchmark_copies(spark, docs, f"{tmp_path}/none").collect()), key=str) == sorted(rows, key=str)


def test_mixed(spark, docs, tmp_path):
    docs.dropDuplicates(["doc_id", "text"]).coalesce(1).write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet' WHERE doc_id IS NOT NULL")
    names = ["doc_id", "source", "size", "source_size", "target", "taken"]
    want = con.sql(oracles.MIX).select(*names).fetchall()
    out = cp.mixed(spark, d.filter("doc_id is not null"), "")
    assert out.columns == names
    key = lambda r: str((r[0], r[1], r[2], r[3], round(r[4], 6)))
    assert sorted(map(key, map(tuple, out.collect()))) == sorted(map(key, want))
    sums = lambda some: {s: sum(r[5] for r in some if r[1] == s) for s in {r[1] for r in some}}
    assert sums(list(map(tuple, out.collect()))) == sums(want)
