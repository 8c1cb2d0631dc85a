"""A stored table behind the protocol of the paged service, so that a crawl can be run again, or tried, from what was once fetched."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import dense_ids
from ..store import opened

#: Request parameters and the columns they are held against.
EQUAL = {"org": "org", "status": "status"}


#: Records of consecutive numbers that are counted together, and bytes of a part of a file that is read as a whole.
BLOCK, GROUP = 10_000, 1 << 20


def save(records: DataFrame, path: str, order: str) -> None:
    """records (order, org, status, issue_date, record: JSON text) as a table that answers() serves, numbered in order from 0.

    Files hold consecutive numbers in small parts. Beside them, in `_counts`, lies how many records of each block have which org, status and day, so that a
    page of those that fit is found without a look at all records.
    """
    d = records.select(order, *[F.col(c) for c in ("org", "status", "issue_date", "record")], F.lit(1).alias("one"))
    d = dense_ids(d, order, "one", "n").select(F.col("n").cast("long").alias("n"), "org", "status", "issue_date", "record")
    d.repartitionByRange("n").sortWithinPartitions("n").write.option("parquet.block.size", GROUP).parquet(path)
    t = d.sparkSession.read.schema(d.schema).parquet(path)
    t.groupBy(F.floor(F.col("n") / BLOCK).cast("long").alias("block"), "org", "status", "issue_date").count().write.parquet(f"{path}/_counts")


def answers(path: str) -> Callable[[dict], str]:
    """A fetch function: a page of the records that fit org, status, from_date and to_date, in their order. It reads the blocks that hold the page, no others."""
    held: dict = {}

    def fetch(params: dict) -> str:
        import bisect
        import datetime

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        if not held:
            fs, at = opened(path)
            table, held["counts"] = (ds.dataset(x, filesystem=fs, format="parquet") for x in (at, f"{at.rstrip('/')}/_counts"))
            known = [(g, g.row_groups[0].statistics["n"]) for f in table.get_fragments() for g in f.split_by_row_group() if g.row_groups]
            known.sort(key=lambda x: x[1]["min"])
            held["parts"], held["empty"] = [g for g, _ in known], table.schema.empty_table().select(["n", "record"])
            held["first"], held["last"] = ([n[k] for _, n in known] for k in ("min", "max"))
        page, size = int(params["page"]), int(params["size"])
        fits = None
        for k, c in EQUAL.items():
            if params.get(k) is not None:
                fits = (pc.field(c) == params[k]) if fits is None else fits & (pc.field(c) == params[k])
        for k, bound in (("from_date", lambda x, d: x >= d), ("to_date", lambda x, d: x <= d)):
            if params.get(k):
                test = bound(pc.field("issue_date"), datetime.date.fromisoformat(params[k]))
                fits = test if fits is None else fits & test
        first = page * size
        if fits is None:  # numbers of records say which page they are on
            low, high, skipped = first, first + size, first
        else:
            blocks, before = held.get(str(fits)) or held.setdefault(str(fits), _places(held["counts"], fits, np))
            # The blocks from that of the page's first record to that of its last.
            a, b = (int(np.searchsorted(before, x, "right")) - 1 for x in (first, first + size - 1))
            if a >= len(blocks):
                return json.dumps({"decisions": []})
            b = min(b, len(blocks) - 1)
            low, high, skipped = int(blocks[a]) * BLOCK, (int(blocks[b]) + 1) * BLOCK, int(before[a])
        near = (pc.field("n") >= low) & (pc.field("n") < high)
        parts = held["parts"][bisect.bisect_left(held["last"], low) : bisect.bisect_left(held["first"], high)]
        read = [g.to_table(columns=["n", "record"], filter=near if fits is None else near & fits, use_threads=False) for g in parts]
        t = pa.concat_tables([held["empty"], *read]).sort_by("n").slice(first - skipped, size)
        return '{"decisions": [' + ", ".join(t.column("record").to_pylist()) + "]}"

    return fetch


def _places(counts, fits, np) -> tuple:
    """(blocks that hold records that fit, how many of those lie before each, and at the end before none)."""
    per: dict[int, int] = {}
    for b in counts.scanner(columns=["block", "count"], filter=fits, use_threads=False).to_batches():
        for block, n in zip(b.column("block").to_pylist(), b.column("count").to_pylist(), strict=True):
            per[block] = per.get(block, 0) + n
    blocks = sorted(per)
    return blocks, np.cumsum([0, *(per[x] for x in blocks)])
