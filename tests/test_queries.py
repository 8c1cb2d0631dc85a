"""Every registered query with SQL gives the same rows in DuckDB, on the smallest tables; the package works without its optional part."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillstream.operators import search

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in entry.plans.QUERIES if n in entry.plans.ORACLES]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def shown(x):
    if x is None or x != x:
        return "-"
    if isinstance(x, (float, int)) and not isinstance(x, bool):
        return f"{float(x):.7f}"
    return str(x)


@pytest.mark.parametrize("name", OWN)
def test_same_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    mine, theirs = entry.queries()[name](spark, DATA), con.sql(entry.oracle_sql()[name])
    order = sorted(mine.columns)
    assert order == sorted(theirs.columns)
    a = sorted(tuple(shown(r[c]) for c in order) for r in mine.collect())
    b = sorted(tuple(shown(x) for x in r) for r in theirs.select(*[f'"{c}"' for c in order]).fetchall())
    assert a == b


def same_as_sql(spark, name, folder):
    """The query over tables in a folder of their own, and its SQL."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}/*.parquet'")
    mine, theirs = entry.queries()[name](spark, str(folder)), con.sql(entry.oracle_sql()[name])
    order = sorted(mine.columns)
    a = sorted(tuple(shown(r[c]) for c in order) for r in mine.collect())
    b = sorted(tuple(shown(x) for x in r) for r in theirs.select(*[f'"{c}"' for c in order]).fetchall())
    assert a == b and a


def test_dates_of_large_tables(spark, tmp_path):
    """Ids of larger tables: seconds beyond 1e10 and days beyond year 9999."""
    e = spark.read.parquet(f"{DATA}/events.parquet").filter("event_id < 100")
    for k in (0, 2_330_700, 5_999_900, 35_999_900):
        e.withColumn("event_id", F.col("event_id") + k).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    same_as_sql(spark, "date_normalization", tmp_path)


def test_every_turn_is_a_question(spark, tmp_path, monkeypatch):
    """Turns and conversations of any number, turns that are null or twice, texts without the letters that one encoder or both count."""
    t = [(i, j, "user", f"{'enters train'[i : i + 4]} noise {'s' * j} {'t' * i} {j}") for i in range(7) for j in (0, 1, 5)]
    t += [(7, None, "user", "no turn"), (8, 1, "user", "said once"), (8, 1, "user", "said twice, in other words"), (9, 0, "user", ""), (9, 1, "user", "17 %"), (9, 2, "user", "aie iae")]
    spark.createDataFrame(t, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").union(spark.createDataFrame([(99_998, "123"), (99_999, "ai")], "item_id long, text string")).write.parquet(f"{tmp_path}/benchmark.parquet")
    for block in (search.BLOCK, 10):
        monkeypatch.setattr(search, "BLOCK", block)
        same_as_sql(spark, "retriever_modes", tmp_path)
    got = {(r["qid"], r["turn"]) for r in entry.queries()["retriever_modes"](spark, str(tmp_path)).collect()}
    assert got == {(i, j) for i, j, _, _ in t} - {(9, 0), (9, 1)}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_optional_part(tmp_path):
    """With quillstream.llm, its tests and the pipeline deleted, all other queries register, and nothing needs what is gone."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(here, copy, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__", "llm", "corpus_pipeline.py")])
    code = "import __spark_entry__ as e; assert e.llm is None and len(e.queries()) > 60 and not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); assert e.oracle_sql().keys() <= e.queries().keys()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
