"""Tables in the shared folder, connected components, and Arrow helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Edges that a task contracts at a time.
EDGES = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode, where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillstream-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files behind a table made by written()."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds Arrow batches of long texts, unless the session already asks for less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def let_go(spark: SparkSession) -> None:
    """Frees what the driver still holds of finished work: plans that Python refers to in cycles, generated classes, shuffles to be cleaned."""
    gc.collect()
    spark._jvm.System.gc()


def parts(batches, rows: int = 200):
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def binary_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def text_slices(batches, column: str, limit: int = 1 << 20):
    """Splits record batches by bytes of text: yields (slice, data, offsets); a longer text comes alone."""
    for b in batches:
        if not b.num_rows:
            continue
        data, off = binary_parts(b.column(b.schema.get_field_index(column)))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield b.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def merged(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root (of each row the smallest row of its component) after the links of rows i with j."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to edges that connect the same: in each task, EDGES at a time, from every vertex to the smallest it reaches."""

    def flush(held):
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = merged(np.arange(len(ids)), at[: len(a)], at[len(a) :])
        i = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[root[i]])], ["a", "b"])

    def run(batches):
        held, count = [], 0
        for x in batches:
            held.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
            count += x.num_rows
            if count > EDGES:
                yield flush(held)
                held, count = [], 0
        if count:
            yield flush(held)

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, name: str, most: int = 60) -> DataFrame:
    """Connected components of edges (a, b: long): rows (id, root), root the smallest id reachable.

    Each task first contracts the edges it has. Then large-star and small-star rounds alternate; each joins every edge's ends
    with the smallest neighbour, found by a combining aggregate, so no vertex's neighbours meet in one task. A round that
    leaves the edges as they are is the last: what a round leaves alone are stars.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        j = both.join(low, "a")
        if large:
            out = j.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = j.filter(F.col("b") <= F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                low.select("a", F.col("m").alias("b"))
            )
        return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def kept(e: DataFrame) -> tuple[DataFrame, dict]:
        # What tells one set of edges from another is gathered while they are written.
        seen = Observation()
        e = e.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64("b", "a")).alias("x"))
        return written(e, name), seen.get

    now, mark = kept(contracted(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    for _ in range(most):
        # Parts of one component that tasks contracted alone may repeat an edge: rounds end in distinct edges.
        new, last = kept(star(star(contracted(now), True), False))
        forget(now)
        now = new
        if last == mark:
            break
        mark = last
    else:
        raise RuntimeError("components did not converge")
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("id"), "root").distinct())


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
