"""Overlapping chunks of texts, with ids that count on through the corpus."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ingest import dense_ids

# Characters of a chunk and of overlap, and what a text is split at, first to last.
SIZE, OVERLAP = 1000, 150
SEPARATORS = ["\n\n", "\n", ". ", " ", ""]


def pieces(text: str, separators: list[str], size: int, overlap: int) -> list[str]:
    """A recursive split: at the first separator found, which stays before what follows it; parts that are too long are split at the next one."""
    sep = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(sep) + 1 :] if sep in separators else []
    if sep:
        head, *tail = text.split(sep)
        parts = [x for x in (head, *(sep + t for t in tail)) if x]
    else:
        parts = list(text)
    out: list[str] = []
    short: list[str] = []
    for p in parts:
        if len(p) < size:
            short.append(p)
            continue
        out += packed(short, size, overlap)
        short = []
        out += pieces(p, rest, size, overlap) if rest else [p]
    return out + packed(short, size, overlap)


def packed(parts: list[str], size: int, overlap: int) -> list[str]:
    """Joins parts to chunks of at most `size`; each begins with the last parts, up to `overlap`, of the one before."""
    out: list[str] = []
    now: list[str] = []
    total = first = 0
    for p in parts:
        if total + len(p) > size and first < len(now):
            out.append("".join(now[first:]))
            while total > overlap or (total + len(p) > size and total > 0):
                total -= len(now[first])
                first += 1
            now, first = now[first:], 0
        now.append(p)
        total += len(p)
    if first < len(now):
        out.append("".join(now[first:]))
    return [c for c in (x.strip() for x in out) if c]


def recursive(docs: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """docs with a row for each chunk: all columns but the text, chunk_no (from 0) and chunk. A null or blank text has none."""
    rest = [c for c in docs.columns if c != text]

    def split(batches):
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([pieces(t or "", SEPARATORS, size, overlap) for t in part.column(part.schema.get_field_index(text)).to_pylist()], pa.list_(pa.string()))], [*part.schema.names, "chunks"])

    from pyspark.sql import types as T

    d = docs.mapInArrow(split, T.StructType(list(docs.schema)).add("chunks", T.ArrayType(T.StringType())))
    return d.select(*rest, F.posexplode("chunks").alias("chunk_no", "chunk"))


def fixed(docs: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Extension: windows of `size` characters every size - overlap, as expressions only."""
    rest = [c for c in docs.columns if c != text]
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / (size - overlap)).cast("int"))
    d = docs.filter(F.length(text) > 0).withColumn("chunk_no", F.explode(starts))
    return d.select(*rest, "chunk_no", F.substr(text, F.col("chunk_no") * (size - overlap) + 1, F.lit(size)).alias("chunk"))


def with_ids(chunks: DataFrame, order: str) -> DataFrame:
    """chunks with chunk_id: their place in the corpus by document (`order`, an integer) and chunk_no, counted from 0 without gaps."""
    per = chunks.groupBy(order).agg(F.count("*").alias("__c"))
    ahead = dense_ids(per, order, "__c", "__start").select(order, "__start")
    return chunks.join(ahead, order).withColumn("chunk_id", (F.col("__start") + F.col("chunk_no")).cast("long")).drop("__start")
