"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot i of the schedule has the point frac((i + 1/2) * golden ratio); the cumulative weights of the sources' blocks map
it to a source. Slots are ranked within their source, and rank r takes block r, BLOCK words, of that source's shuffled
token stream, wrapping around for repeats; a source's last block is as short as its target, rounded to words, demands.
Defined results: a null text has size 0 and is never taken; a null source is a source of its own, last; repeated rows are
separate documents; if no row has a word, all targets are 0 and nothing is taken; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import written

GOLDEN = 0.6180339887498949
#: Weights of the sources in code point order, repeating.
WEIGHTS = [5.0, 2.0, 1.0]
REPEATS = 3
BLOCK = 512
#: Words in a bucket of a source's shuffled order, and slots in a part of the schedule, about which prefix sums are made.
BUCKET, PART = 1 << 24, 4096
#: Equal parts of [0, 1) by which slots meet the sources whose bounds fall there.
CELLS = 1024


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to target: min(REPEATS * size, level * weight), the level such that all sizes are shared out.

    With sources in the order of REPEATS * size / weight, those before the first whose ratio exceeds the
    level that the rest would get are full; that is where repeated resharing ends. The rows are one per source.
    """
    order = W.orderBy(F.asc_nulls_last("source"))
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (((F.row_number().over(order) - 1) % len(WEIGHTS)) + 1).cast("int")))
    w = w.withColumn("most", F.col("source_size").cast("double") * REPEATS).withColumn("ratio", F.col("most") / F.col("weight"))
    by = W.orderBy("ratio", F.asc_nulls_last("source"))
    everything = W.partitionBy(F.lit(0))
    w = w.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    w = w.withColumn("before", F.coalesce(F.sum("most").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("rest", F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)))
    w = w.withColumn("try", (F.col("total") - F.col("before")) / F.col("rest"))
    w = w.withColumn("level", F.max(F.when(F.col("try") <= F.col("ratio"), F.col("try"))).over(everything))
    return w.select("source", "source_size", "total", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with size and place in their source's shuffled stream, sources with targets, blocks and bounds), both written.

    The texts are read once. Places are prefix sums over buckets of the shuffled order, which are as many as the words need
    (about BUCKET words in each), and within them.
    """
    d = docs.select("doc_id", "text", "source").select("doc_id", "source", token_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"), F.xxhash64("text").alias("tie"))
    d = written(d, "sizes")
    src = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")))
    src = src.withColumn("most", F.floor(F.col("target") + 0.5).cast("long")).withColumn("blocks", F.ceil(F.col("most") / BLOCK).cast("long"))
    up = W.orderBy(F.asc_nulls_last("source"))
    src = src.withColumn("hi", F.try_divide(F.sum("blocks").over(up), F.sum("blocks").over(W.partitionBy(F.lit(0))))).withColumn("lo", F.coalesce(F.lag("hi").over(up), F.lit(0.0)))
    src = written(src.withColumn("last", F.col("hi") == F.max("hi").over(W.partitionBy(F.lit(0)))), "sources")
    total = src.agg(F.max("total")).head()[0] or 0
    digits = max(1, min(8, math.ceil(math.log(max(total / BUCKET, 1), 16))))
    d = d.withColumn("bucket", F.substring("h", 1, digits))
    per = d.groupBy("source", "bucket").agg(F.sum("size").alias("tokens"))
    per = per.withColumn("ahead", F.sum("tokens").over(W.partitionBy("source").orderBy("bucket")) - F.col("tokens"))
    ahead = per.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), "ahead")
    placed = d.join(ahead, d["source"].eqNullSafe(F.col("s2")) & (d["bucket"] == F.col("b2"))).drop("s2", "b2")
    inside = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("h", "doc_id", "tie", "size").rowsBetween(W.unboundedPreceding, -1))
    placed = placed.withColumn("start", F.col("ahead") + F.coalesce(inside, F.lit(0))).select("doc_id", "source", "size", "start")
    return written(placed, "places"), src


def slots_of(spark: SparkSession, src: DataFrame) -> DataFrame:
    """Rows (slot, source, rank): the slots that take a block, ranked within their source by prefix sums over parts of the schedule.

    A source's share of the points is that of its blocks. Of n points of the golden ratio any interval of length x holds
    n * x / 2.62 at least, so three times as many slots as blocks give each source its blocks; the slots beyond them go empty.
    """
    s = src.filter("blocks > 0")
    slots = 3 * int(s.agg(F.sum("blocks")).head()[0] or 0)
    i = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 0.5) * GOLDEN % 1.0).alias("u"))
    i = i.withColumn("cell", F.floor(F.col("u") * CELLS))
    cells = s.select("source", "lo", "hi", "last", "blocks", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.when(F.col("last"), CELLS).otherwise(F.floor(F.col("hi") * CELLS)))).alias("cell"))
    hit = i.join(cells, "cell").filter((F.col("u") >= F.col("lo")) & ((F.col("u") < F.col("hi")) | F.col("last")))
    at = hit.select("slot", "source", "blocks", F.floor(F.col("slot") / PART).alias("part"))
    per = at.groupBy("source", "part").agg(F.count("*").alias("n"))
    per = per.select(F.col("source").alias("s1"), F.col("part").alias("p1"), (F.sum("n").over(W.partitionBy("source").orderBy("part")) - F.col("n")).alias("ahead"))
    at = at.join(per, at["source"].eqNullSafe(per["s1"]) & (at["part"] == per["p1"]))
    at = at.withColumn("rank", F.col("ahead") + F.row_number().over(W.partitionBy("source", "part").orderBy("slot")) - 1)
    return at.filter("rank < blocks").select("slot", "source", "rank")


def blocks(placed: DataFrame, src: DataFrame) -> DataFrame:
    """Rows (slot, source, doc_id, start, size, first_word, last_word, turn): the parts of documents that each slot's block holds.

    Rank r of a source takes words r * BLOCK to (r + 1) * BLOCK of its unrolled stream, the last rank what is left of the
    target. Such a range is cut where the stream begins anew; it meets the documents of the stream by equal parts of block
    length, and both parts that a pair may share count once.
    """
    at = slots_of(placed.sparkSession, src)
    s = src.select(F.col("source").alias("s2"), "source_size", "most")
    at = at.join(s, at["source"].eqNullSafe(s["s2"])).select("slot", "source", "source_size", (F.col("rank") * BLOCK).alias("from"), F.least((F.col("rank") + 1) * BLOCK, F.col("most")).alias("to"))
    turn = F.explode(F.sequence(F.floor(F.col("from") / F.col("source_size")), F.floor((F.col("to") - 1) / F.col("source_size"))))
    at = at.withColumn("turn", turn).withColumn("lo", F.greatest(F.lit(0), F.col("from") - F.col("turn") * F.col("source_size"))).withColumn("hi", F.least(F.col("source_size"), F.col("to") - F.col("turn") * F.col("source_size")))
    cell = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / BLOCK), F.floor((F.col(hi) - 1) / BLOCK)))
    at = at.select("slot", F.col("source").alias("s3"), "turn", "lo", "hi", cell("lo", "hi").alias("cell"))
    d = placed.filter("size > 0").withColumn("stop", F.col("start") + F.col("size"))
    d = d.select("doc_id", "source", "start", "stop", "size", cell("start", "stop").alias("c3"))
    j = d.join(at, d["source"].eqNullSafe(at["s3"]) & (d["c3"] == at["cell"])).filter((F.col("lo") < F.col("stop")) & (F.col("start") < F.col("hi")))
    j = j.filter(F.col("cell") == F.floor(F.greatest("lo", "start") / BLOCK))
    first, last = F.greatest("lo", "start") - F.col("start"), F.least("hi", "stop") - F.col("start")
    return j.select("slot", "source", "doc_id", "start", "size", first.alias("first_word"), last.alias("last_word"), "turn")


def mixture(docs: DataFrame) -> DataFrame:
    """The mix in its order: rows (slot, source, doc_id, first_word, last_word, turn, start), a part of a document for each.

    Within a slot the order is by turn and start.
    """
    return blocks(*plan(docs)).select("slot", "source", "doc_id", "first_word", "last_word", "turn", "start")


def mix(docs: DataFrame) -> DataFrame:
    """documents to (doc_id, source, size, source_size, target, taken): what the blocks of the schedule hold of each document."""
    placed, src = plan(docs)
    parts = blocks(placed, src).groupBy("source", "start").agg(F.sum(F.col("last_word") - F.col("first_word")).alias("held"))
    parts = parts.select(F.col("source").alias("s4"), F.col("start").alias("at"), "held")
    # A document with words is known by where it starts in its source's stream.
    j = placed.join(parts, placed["source"].eqNullSafe(F.col("s4")) & (placed["start"] == F.col("at")) & (placed["size"] > 0), "left").drop("s4", "at")
    s = src.select(F.col("source").alias("s2"), "source_size", "target")
    j = j.join(s, j["source"].eqNullSafe(s["s2"])).drop("s2")
    return j.select("doc_id", "source", "size", "source_size", "target", F.coalesce("held", F.lit(0)).cast("long").alias("taken"))


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source")
