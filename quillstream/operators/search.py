"""Exact vector search, ranked lists, and their weighted reciprocal rank fusion.

A ranked list has the columns qid, rank (from 1, dense) and the item's columns; order is explicit.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Results per retriever, results of the ensemble, fusion's constant and weights.
SEARCH_K, ENSEMBLE_K, RRF = 5, 15, 60
ENSEMBLE_WEIGHTS = [0.3, 0.7]
#: More queries or vectors than this are not broadcast; they are worked on in slices.
MOST_QUERIES = 20_000
#: Vectors that are multiplied with all queries of a slice at once.
BLOCK = 1024
#: Products that are held at once, and pairs whose sums are, where vectors are broadcast.
PRODUCTS, PAIRS = 2_000_000, 50_000


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def matrix(col: pa.Array, width: int | None) -> tuple[np.ndarray, np.ndarray, int | None]:
    """(rows of a list column that hold `width` numbers and no null, those as a matrix of doubles, width); the first list gives a missing width."""
    size = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
    if width is None:
        known = size[size > 0]
        width = int(known[0]) if len(known) else None
    if width is None:
        return np.zeros(0, np.int64), np.zeros((0, 0)), None
    fits = np.flatnonzero(size == width)
    values = col.take(pa.array(fits)).flatten()
    m = pc.cast(values, pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    if values.null_count:
        whole = ~values.is_null().to_numpy(zero_copy_only=False).reshape(-1, width).any(1)
        fits, m = fits[whole], m[whole]
    return fits, m, width


def plain_sums(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of a, or of each row of a, with each row, from left to right."""
    return np.add.accumulate(a * rows, axis=1)[:, -1]


def fused_sums(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """As plain_sums, but a product is added before it is rounded, as engines do that use the instruction for it."""
    out = np.zeros(len(rows))
    for i, (one, row) in enumerate(zip(np.broadcast_to(a, rows.shape).tolist(), rows.tolist(), strict=True)):
        s = 0.0
        try:
            for x, y in zip(one, row, strict=True):
                s = math.fma(x, y, s)
        except (OverflowError, ValueError):  # numbers that are infinite, or become so
            s = plain_sums(np.array(one), rows[i : i + 1])[0]
        out[i] = s
    return out


class Best:
    """The k best vectors seen of each query: score from the highest, then id from the smallest."""

    def __init__(self, qid: list, q: np.ndarray, k: int, others_only: bool, sums=plain_sums):
        self.qid, self.q, self.k, self.sums = qid, q, k, sums
        self.own = {x: i for i, x in enumerate(qid)} if others_only else {}
        self.found: list[tuple[np.ndarray, list]] = [(np.zeros(0), []) for _ in qid]
        self.least = np.full(len(qid), -np.inf)

    def add(self, ids: list, v: np.ndarray) -> None:
        near = self.q @ v.T
        for x, column in ((self.own[x], n) for n, x in enumerate(ids) if x in self.own):
            near[x, column] = -np.inf
        # Products of blocks round otherwise than sums from left to right, which alone decide: what could be among the k best is summed so.
        slack = 1e-12 * (1 + np.abs(self.q).sum(1) * (np.abs(v).max() if v.size else 0.0))
        k = min(self.k, near.shape[1])
        least = np.maximum(np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k], -np.inf) if near.shape[1] > k else np.full(len(self.qid), -np.inf)
        bound = np.maximum(least, self.least) - slack
        for i in np.flatnonzero((near >= bound[:, None]).any(1)).tolist():
            at = np.flatnonzero((near[i] >= bound[i]) & (near[i] > -np.inf))
            if not len(at):
                continue
            score = self.sums(self.q[i], v[at])
            old, names = self.found[i]
            score, names = np.concatenate([old, score]), names + [ids[n] for n in at.tolist()]
            keep = sorted(range(len(names)), key=lambda n: (-score[n], names[n]))[: self.k]
            self.found[i] = score[keep], [names[n] for n in keep]
            if len(keep) == self.k:
                self.least[i] = score[keep[-1]]

    def rows(self):
        for x, (score, names) in zip(self.qid, self.found, strict=True):
            for s, n in zip(score.tolist(), names, strict=True):
                yield x, n, s


def best_known(q: np.ndarray, v: np.ndarray, k: int, sums=plain_sums, never=()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of v, score) of the k best rows of v for each row of q: score from the highest, then row of v from the first. Pairs in `never` have no score."""
    near = q @ v.T
    near[np.isnan(near)] = -np.inf
    for i, j in never:
        near[i, j] = -np.inf
    # As in Best: products tell what could be among the k best, and sums from left to right decide.
    slack = 1e-12 * (1 + np.abs(q).sum(1) * (np.abs(v).max() if v.size else 0.0))
    bound = np.full(len(q), -np.inf) if len(v) <= k else np.partition(near, len(v) - k, axis=1)[:, len(v) - k]
    with np.errstate(invalid="ignore"):
        bound = np.nan_to_num(bound - slack, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
    i, j = np.nonzero((near >= bound[:, None]) & (near > -np.inf))
    score = np.concatenate([np.zeros(0), *(sums(q[i[x : x + PAIRS]], v[j[x : x + PAIRS]]) for x in range(0, len(i), PAIRS))])
    order = np.lexsort((j, -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first], score[first]


def held(d: DataFrame, key: str, vector: str, slices: int, i: int) -> list[tuple[list, np.ndarray]]:
    """(keys, vectors as a matrix) for each length of vectors, of slice i of d."""
    part = d if slices == 1 else d.filter(F.pmod(F.xxhash64(key), F.lit(slices)) == i)
    got = part.select(key, vector).toArrow().combine_chunks()
    ids, col = got.column(key).to_pylist(), got.column(vector).combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.float64()))
    out = []
    for width in sorted({x for x in pc.list_value_length(col).to_pylist() if x}):
        fits, m, _ = matrix(col, width)
        if len(fits):
            out.append(([ids[x] for x in fits.tolist()], m))
    return out


def top_k(queries: DataFrame, vectors: DataFrame, k: int = SEARCH_K, others_only: bool = False, fused: bool = False, n: int | None = None) -> DataFrame:
    """queries (qid, qv) and vectors (id, v) to (qid, rank, id, score): the k vectors of largest inner product, ties by id.

    The smaller side alone is broadcast, in slices of at most MOST_QUERIES rows, and the other is scanned once for each slice: a task multiplies blocks of
    vectors with all queries of the slice, or blocks of queries with all its vectors, and keeps the k best of each query; only those leave it. Scores are sums in
    double precision from left to right. A vector that is null, holds a null, or is of another length than the query has no score and no rank.
    others_only leaves out the vector whose id is the query's; fused adds products before they are rounded, which may order vectors otherwise whose
    scores differ in the last bit only. n is the number of queries, where it is known, or about that; it decides how, not what.
    """
    n = queries.count() if n is None else n
    m = vectors.count() if n > BLOCK else n
    kinds = {c: queries.schema[c].dataType if c == "qid" else vectors.schema[c].dataType for c in ("qid", "id")}
    schema = T.StructType().add("qid", kinds["qid"]).add("id", kinds["id"]).add("score", "double")
    context = queries.sparkSession.sparkContext
    sums = fused_sums if fused else plain_sums
    out_schema = to_arrow_schema(schema)

    def of_queries(known):
        def run(batches):
            bests = [Best(ids, q, k, others_only, sums) for ids, q in known.value]
            for b in batches:
                for at in range(0, b.num_rows, BLOCK):
                    part = b.slice(at, BLOCK)
                    ids, col = part.column(0).to_pylist(), part.column(1)
                    for best in bests:
                        fits, v, _ = matrix(col, best.q.shape[1])
                        if len(fits):
                            best.add([ids[i] for i in fits.tolist()], v)
            rows = [r for best in bests for r in best.rows()]
            for i in range(0, len(rows), 50_000):
                cols = list(zip(*rows[i : i + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out_schema, strict=True)], schema=out_schema)

        return run

    def of_vectors(known):
        def run(batches):
            sides = []
            for ids, v in known.value:
                order = sorted(range(len(ids)), key=lambda x: (0,) if ids[x] is None else (1, ids[x]))
                # Of equal vectors only the first k can be among the k best, if none is left out.
                seen, first = Counter(), []
                for x in order:
                    seen[v[x].tobytes()] += 1
                    if others_only or seen[v[x].tobytes()] <= k:
                        first.append(x)
                sides.append(([ids[x] for x in first], v[first]))
            places = [{} for _ in sides]
            for at, (ids, _) in zip(places, sides, strict=True):
                for j, x in enumerate(ids if others_only else ()):
                    at.setdefault(x, []).append(j)
            names = [pa.array(ids, out_schema.field("id").type) for ids, _ in sides]
            for b in batches:
                for (_, v), at, name in zip(sides, places, names, strict=True):
                    size = max(1, min(BLOCK, PRODUCTS // len(v)))
                    for part in (b.slice(x, size) for x in range(0, b.num_rows, size)):
                        fits, q, _ = matrix(part.column(1), v.shape[1])
                        if len(fits):
                            qid = part.column(0).take(pa.array(fits))
                            never = [(i, j) for i, x in enumerate(qid.to_pylist()) for j in at.get(x, ())] if others_only else ()
                            i, j, score = best_known(q, v, k, sums, never)
                            yield pa.RecordBatch.from_arrays([qid.take(pa.array(i)).cast(out_schema.field("qid").type), name.take(pa.array(j)), pa.array(score)], schema=out_schema)

        return run

    out = None
    slices = max(1, -(-min(n, m) // MOST_QUERIES))
    for i in range(slices):
        if m < n:
            part = queries.select("qid", "qv").mapInArrow(of_vectors(context.broadcast(held(vectors, "id", "v", slices, i))), schema)
        else:
            part = vectors.select("id", "v").mapInArrow(of_queries(context.broadcast(held(queries, "qid", "qv", slices, i))), schema)
        out = part if out is None else out.union(part)
    w = W.partitionBy("qid").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("qid", "rank", "id", "score")


def unique_documents(ranked: DataFrame, document: str, most: int = SEARCH_K) -> DataFrame:
    """(qid, rank, document): each document once, at its first rank, renumbered; items without a document are left out."""
    first = ranked.filter(F.col(document).isNotNull() & (F.col(document).cast("string") != "")).groupBy("qid", document).agg(F.min("rank").alias("at"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("at"))).filter(F.col("rank") <= most).select("qid", "rank", F.col(document).alias("document"))


def fuse(lists: list[DataFrame], weights: list[float] | None = None, k: int = SEARCH_K, key: str = "id", constant: int = RRF) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists to (qid, rank, key, score).

    Weights are made to sum to 1. Ties keep the order in which items first come: by list, then by rank there.
    """
    weights = weights or [1.0] * len(lists)
    if len(weights) != len(lists):
        raise ValueError("as many weights as retrievers are needed")
    if sum(weights) <= 0:
        raise ValueError("weights must have a positive sum")
    total = sum(weights)
    both = None
    for i, (r, w) in enumerate(zip(lists, weights, strict=True)):
        # Dealt out anew, since a union of lists that are each partitioned by qid may be taken for one that is.
        part = r.hint("rebalance").select("qid", key, F.lit(i).alias("list"), "rank", (F.lit(w / total) / (F.col("rank") + constant)).alias("part"))
        both = part if both is None else both.union(part)
    s = both.groupBy("qid", key).agg(F.sum("part").alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    w = W.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "first")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("qid", "rank", key, "score")
