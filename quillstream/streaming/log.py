"""Counters that are gathered while rows are written, and the log of a stream's batches as a table."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.ingest import REASON_DATE, REASON_KEY, REASON_ORGANIZATION
from ..store import opened

OUTCOMES = [REASON_DATE, REASON_ORGANIZATION, REASON_KEY]
SCHEMA = "run string, batch long, rows long, outcome string, n long"


def outcomes(reason: str = "reason", others: list[str] | None = None) -> list:
    """Aggregates for observe(): rows that were accepted, and by each reason why not."""
    c = F.col(reason)
    return [F.count(F.when(c.isNull(), 1)).alias("accepted"), *[F.count(F.when(c == r, 1)).alias(r) for r in others or OUTCOMES]]


def written_and_counted(d: DataFrame, path: str, reason: str = "reason", mode: str = "append") -> dict[str, int]:
    """Writes d as a table and gives the counts of its outcomes, which the same job gathers."""
    seen = Observation()
    d.observe(seen, *outcomes(reason)).write.mode(mode).parquet(path)
    return dict(seen.get)


class RunLog(StreamingQueryListener):
    """Appends what each batch of the streams that observe `name` counted, a file a batch, to a folder that `entries` reads as a table."""

    def __init__(self, path: str, name: str = "outcomes"):
        self.path, self.name = path, name

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        seen = p.observedMetrics.get(self.name)
        if seen is None or not p.numInputRows:
            return
        rows = [{"run": str(p.runId), "batch": p.batchId, "rows": p.numInputRows, "outcome": k, "n": v} for k, v in seen.asDict().items()]
        fs, at = opened(self.path)
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/{p.batchId:09d}-{uuid.uuid4().hex}.json") as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows).encode())


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The log as a table, after all that has happened so far is in it."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark.read.schema(SCHEMA).json(path)
