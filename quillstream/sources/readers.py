"""JSON lines in their several degrees of strictness, the corpus scan, key sets, PDF and folder scans."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx
from ..operators.extract import content
from ..store import written

BAD = "_corrupt_record"


def tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, lines that are no JSON object); blank lines vanish. A missing file is an error."""
    lines = spark.read.text(path).withColumnRenamed("value", BAD).filter(tx.strip(F.col(BAD)) != "")
    whole = F.from_json(BAD, "map<string,string>").isNotNull()
    return lines.filter(whole).select(F.from_json(BAD, schema).alias("r")).select("r.*"), lines.filter(~whole)


def silent(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fails on the first line that is no JSON object; first_bad() tells which it is."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str | list[str], folders: bool = False) -> DataFrame:
    """(file, line from 1, text) of every line that is neither blank nor JSON, over any number of files.

    Lines are counted within their file or, with `folders`, through all files of a folder in order of their names, as a sorted write leaves them.

    One scan counts the lines of each split and gives its bad ones with their places there; a split's first line has the lines of the file's
    earlier splits before it. A split holds the lines that begin in it, so the counts of a file add up.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    bad = (tx.strip(F.col("value")) != "") & F.try_parse_json("value").isNull()

    def run(batches):
        now, count = None, 0
        for b in batches:
            file, start, bad = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            out = []
            wrong = [i for i, x in enumerate(bad.is_valid().to_pylist()) if x]
            cut = [0, *(i for i in range(1, len(file)) if (file[i], start[i]) != (file[i - 1], start[i - 1])), len(file)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if hi > lo:
                    if (file[lo], start[lo]) != now:
                        if now:
                            out.append((*now, count, None))
                        now, count = (file[lo], start[lo]), 0
                    out += [(*now, count + i - lo, bad[i].as_py()) for i in wrong if lo <= i < hi]
                    count += hi - lo
            if out:
                yield rows(out)
        if now:
            yield rows([(*now, count, None)])

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["file", "start", "place", "value"])

    found = written(lines.select("file", "start", F.when(bad, F.col("value"))).mapInArrow(run, "file string, start long, place long, value string"), "lines")
    before = W.partitionBy(F.regexp_extract("file", "^(.*)/", 1) if folders else "file").orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)
    splits = found.filter("value is null").select("file", "start", F.coalesce(F.sum("place").over(before), F.lit(0)).alias("ahead"))
    return found.filter("value is not null").join(splits, ["file", "start"]).select("file", (F.col("ahead") + F.col("place") + 1).alias("line"), F.col("value").alias("text"))


def first_bad(spark: SparkSession, path: str, folders: bool = False) -> tuple[str, int, str] | None:
    """(file, line from 1, text) of the first line that is neither blank nor JSON, for the report of a failed strict read."""
    r = bad_lines(spark, path, folders).orderBy("file", "line").head()
    return tuple(r) if r else None


def checked(spark: SparkSession, path: str, schema: str, folders: bool = False) -> DataFrame:
    """A strict read that is tried at once: a line that is no JSON fails it with the file, the number and the text of the first such line."""
    bad = first_bad(spark, path, folders)
    if bad:
        raise RuntimeError("{}: line {} is no JSON: {:.200}".format(*bad))
    return strict(spark, path, schema)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Records with text: the metadata of a chunk and page_content. An error if there is none."""
    d, _ = tolerant(spark, path, schemas.CORPUS)
    d = d.withColumn("text", tx.strip(F.col("text"))).filter("text <> ''")
    keep = ["ada", "source_id", "subject", "document_title", "issue_date", "organization_id", "organization", "decision_type_id", "document_url", "source"]
    d = d.select(*keep, content(F.col("subject"), F.col("text")).alias("page_content"))
    if d.isEmpty():
        raise ValueError("no document with text")
    return d


def source_counts(d: DataFrame, source: str = "source") -> DataFrame:
    kind = F.when(F.col(source) == "external_pdf", "external_pdf").otherwise("diavgeia")
    return d.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The keys, trimmed and not blank, of a JSON-lines table; a missing one has none."""
    try:
        d = silent(spark, path, f"{key} string")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{key} string")
    return d.select(tx.strip(F.col(key)).alias(key)).filter(F.col(key) != "").distinct()


def files(spark: SparkSession, folder: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """(path, content) of files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def walk(spark: SparkSession, nodes: DataFrame, root: str, separator: str = "/") -> DataFrame:
    """nodes (id, parent, name) below `root`: with path of names and depth. A tree of any depth by a recursive query."""
    return spark.sql(
        """
        WITH RECURSIVE t(id, path, depth) AS (
          SELECT id, name, 0 FROM {nodes} WHERE parent = :root
          UNION ALL
          SELECT n.id, concat(t.path, :separator, n.name), t.depth + 1 FROM {nodes} n JOIN t ON n.parent = t.id)
        SELECT id, path, depth FROM t""",
        args={"root": root, "separator": separator},
        nodes=nodes,
    )


def pdf_pages(d: DataFrame, read: Callable[[bytes], Iterable[str]]) -> DataFrame:
    """d (with content binary) and pages, error: `read` gives a PDF's page texts; its errors become rows, not failures.

    PermissionError says encrypted_pdf, any other error pdf_read_error.
    """
    from pyspark.sql import types as T

    def one(raw):
        if not raw:
            return None, None
        try:
            return list(read(raw)), None
        except PermissionError:
            return None, "encrypted_pdf"
        except Exception:  # noqa: BLE001  one damaged file must not stop the run
            return None, "pdf_read_error"

    def run(batches):
        for b in batches:
            got = [one(x.as_py()) for x in b.column(b.schema.get_field_index("content"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in got], pa.list_(pa.string())), pa.array([e for _, e in got], pa.string())], [*b.schema.names, "pages", "error"])

    return d.drop("pages", "error").mapInArrow(run, T.StructType(list(d.drop("pages", "error").schema)).add("pages", T.ArrayType(T.StringType())).add("error", "string"))


def index(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored vectors at path, built and stored first if there are none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)
