"""JSON lines, split sinks, result files and indexes."""

from __future__ import annotations

import csv
import io
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import Folder

#: Rows that one file written by the driver may have.
MOST_ROWS = 100_000


def append(d: DataFrame, path: str) -> None:
    d.write.mode("append").json(path)


def overwrite(d: DataFrame, path: str) -> None:
    d.write.mode("overwrite").json(path)


def placed(folder: Folder, made: str, path: str, tag: str | None = None) -> None:
    """Moves the files of a finished write to path. Files of a tag are numbered, so that a write that is done again replaces the first."""
    folder.make(path)
    files = sorted(x for x in folder.names(made) if x.startswith("part-"))
    for n, x in enumerate(files):
        if tag:
            folder.delete(f"{path}/{tag}-{n:05d}")
        folder.move(f"{made}/{x}", f"{path}/{tag}-{n:05d}" if tag else f"{path}/{x}")
    if tag:
        n = len(files)
        while folder.exists(f"{path}/{tag}-{n:05d}"):
            folder.delete(f"{path}/{tag}-{n:05d}")
            n += 1


def split(d: DataFrame, sinks: dict[str, str], by: str, mode: str = "append", rest: str | None = None) -> None:
    """Writes the rows of each value of `by` to its path, all others to `rest`, by one job: its files, parted by sink, are moved to where they belong.

    Without `rest`, a row of another value is an error, before anything is in its place. Every path exists afterwards.
    """
    paths = list(sinks.items())
    number = F.lit(len(paths))
    for n, (value, _) in reversed(list(enumerate(paths))):
        number = F.when(F.col(by).eqNullSafe(F.lit(value)), n).otherwise(number)
    where = [p for _, p in paths] + [rest]
    beside, _, _ = (where[0] if paths else rest).rstrip("/").rpartition("/")
    folder, made = Folder(d.sparkSession, beside), f"{beside}/_split-{uuid.uuid4().hex}"
    try:
        d.withColumn("__sink", number).write.partitionBy("__sink").json(made)
        if rest is None and folder.names(f"{made}/__sink={len(paths)}"):
            raise ValueError(f"rows of other values of {by} than {sorted(sinks)}")
        for n, path in enumerate(where):
            if path is None:
                continue
            if mode == "overwrite":
                folder.delete(path)
            placed(folder, f"{made}/__sink={n}", path)
    finally:
        folder.delete(made)


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """One file, written by the driver to any store that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def short(d: DataFrame) -> list:
    rows = d.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows are no summary; write them as a table")
    return rows


def results_json(summary: DataFrame, keys: list[str], path: str) -> None:
    """A short summary as one JSON file, nested by the keys joined with underscores. More than MOST_ROWS are refused."""
    rows = [r.asDict(True) for r in short(summary.orderBy(*keys))]
    out = {"_".join(str(r[k]) for k in keys): {k: v for k, v in r.items() if k not in keys} for r in rows}
    put(summary.sparkSession, path, json.dumps(out, ensure_ascii=False, indent=4, default=str).encode())


def flat(d: DataFrame, separator: str = ", ") -> DataFrame:
    """Arrays joined to text, for CSV."""
    return d.select(*[F.array_join(c, separator).alias(c) if t.startswith("array<string") else F.col(c) for c, t in d.dtypes])


def results_csv(d: DataFrame, path: str, separator: str = ", ") -> None:
    flat(d, separator).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def results_csv_file(d: DataFrame, path: str, separator: str = ", ") -> None:
    """A short table as one CSV file that begins with a byte order mark: a header, empty cells for nulls, arrays joined.

    It fits a run's summary as well as its details, a row for each case. More than MOST_ROWS are refused.
    """
    rows = short(flat(d, separator))
    text = io.StringIO()
    out = csv.writer(text)
    out.writerow(d.columns)
    out.writerows([["" if x is None else x for x in r] for r in rows])
    put(d.sparkSession, path, b"\xef\xbb\xbf" + text.getvalue().encode())


def vectors(d: DataFrame, path: str) -> None:
    d.select("chunk_id", "embedding").write.mode("overwrite").parquet(path)


def contents(d: DataFrame, path: str, name: str, content: str, suffix: str = "") -> int:
    """A file for each row, named by `name` and suffix, with the bytes of `content`; rows without one have none. Gives how many were written.

    The files appear all at once when every task is done, those of one attempt of each; if a task fails for good or a name comes twice, none does.
    """
    from . import files

    d.sparkSession.dataSource.register(files.Files)
    d.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content")).filter("name is not null and content is not null").write.format("files").option("path", path).option("suffix", suffix).mode("append").save()
    return len(Folder(d.sparkSession, path).names(path))
