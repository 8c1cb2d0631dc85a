"""Files over a connection that the caller gives: fetching with and without retries, rewriting, listings of several folders."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators.ingest import keep_first

# Tries of a fetch, and the base of the growing waits between them, in seconds.
TRIES, BASE = 3, 2
#: Bytes after which a batch of contents is sent on.
MOST = 16 << 20


def fetch(get: Callable, url: str, tries: int = TRIES, pause: Callable = time.sleep) -> tuple[bytes, str]:
    """get(url) gives (content, content type); the content is bytes or pieces of them. OSError and an empty body count as failures."""
    for i in range(tries):
        try:
            body, kind = get(url)
            body = bytes(body) if isinstance(body, (bytes, bytearray, memoryview)) else b"".join(body)
            if not body:
                raise OSError("an empty body")
            return body, kind or ""
        except OSError as e:
            if i + 1 == tries:
                raise RuntimeError(f"the fetch failed {tries} times: {e}") from e
            pause(BASE**i)
    raise ValueError("a fetch needs a try at least")


def _sent(d: DataFrame, schema: T.StructType, work: Callable, column: str) -> DataFrame:
    """d with what work(value of `column`) gives, a dict of the columns that schema adds, in batches of bounded bytes."""
    added = schema.fields[len(d.columns) :]
    kinds = {"binary": pa.binary(), "string": pa.string()}

    def run(batches):
        for b in batches:
            values = b.column(b.schema.get_field_index(column))
            first, size, rows = 0, 0, []
            for i in range(b.num_rows):
                rows.append(work(values[i].as_py()))
                size += sum(len(x) for x in rows[-1].values() if isinstance(x, bytes))
                if size > MOST or i + 1 == b.num_rows:
                    part = b.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([r[f.name] for r in rows], kinds[f.dataType.typeName()]) for f in added)], schema.names)
                    first, size, rows = i + 1, 0, []

    return d.mapInArrow(run, schema)


def contents(d: DataFrame, get: Callable, url: str = "document_url", tries: int = TRIES, pause: Callable = time.sleep) -> DataFrame:
    """d with content, content_type and error: download_failed where every try failed; a blank url has none of them. tries=1 fetches once."""
    d = d.drop("content", "content_type", "error")
    schema = T.StructType(list(d.schema)).add("content", "binary").add("content_type", "string").add("error", "string")

    def work(u):
        if not (u or "").strip():
            return {"content": None, "content_type": None, "error": None}
        try:
            body, kind = fetch(get, u, tries, pause)
        except RuntimeError:
            return {"content": None, "content_type": None, "error": "download_failed"}
        return {"content": body, "content_type": kind, "error": None}

    return _sent(d, schema, work, url)


def rewritten(d: DataFrame, rewrite: Callable[[bytes], bytes]) -> DataFrame:
    """d with `rewritten`, the content as rewrite() gives it, and rewrite_error: what it raised. A null content stays null."""
    d = d.drop("rewritten", "rewrite_error")
    schema = T.StructType(list(d.schema)).add("rewritten", "binary").add("rewrite_error", "string")

    def work(raw):
        if raw is None:
            return {"rewritten": None, "rewrite_error": None}
        try:
            return {"rewritten": bytes(rewrite(raw)), "rewrite_error": None}
        except Exception as e:  # noqa: BLE001  one damaged file must not stop the run
            return {"rewritten": None, "rewrite_error": str(e)}

    return _sent(d, schema, work, "content")


def folder_ids(ids: Iterable[str | None]) -> list[str]:
    """The ids without blanks around them; blank ones are left out, and none at all is an error."""
    out = [x.strip() for x in ids if x and x.strip()]
    if not out:
        raise ValueError("no folder is given")
    return out


def in_folders(listing: DataFrame, ids: Iterable[str | None], folder: str = "folder", file: str = "file_id", order: str = "place") -> DataFrame:
    """Files of the folders asked for, each file once: where the first folder in the order of `ids` has it, at its first place there."""
    spark = listing.sparkSession
    ranks = spark.createDataFrame([(x, i) for i, x in reversed(list(enumerate(folder_ids(ids))))], f"{folder} string, __rank int").groupBy(folder).agg(F.min("__rank").alias("__rank"))
    d = listing.withColumn(folder, tx.strip(F.col(folder).cast("string"))).join(F.broadcast(ranks), folder)
    return keep_first(d, file, "__rank", order).drop("__rank")
