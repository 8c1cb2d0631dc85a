"""Near duplicates of embeddings by lattice hashing, verified by cosine.

In each of TABLES tables a random projection to BLOCKS times eight dimensions is decoded to the nearest points of the
E8 lattice; vectors also probe the cells that differ in one block by its second nearest point. Vectors of one label
(and dimension) that meet in a cell, at least one of them at home there, are compared by cosine in double precision.
A pair counts in the first table, and there the smallest cell, where it meets.

Equal vectors of a label are one class with a weight. Cells of more than BLOCK rows are cut into blocks, and blocks
are compared with each other in separate groups; what comes out of a group is a row for each vector with its number of
links and one vector of its component in the group (of small groups a row for each link and end), not the pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label,
have no links and are their own components; equal vectors of one label link with each other; rows that share a vec_id
count as one vector for components; a null vec_id is a vector like any other; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, merged, small_batches, written
from .textcore import BASE, mix

LEAST = 0.93
TABLES, BLOCKS, SCALE = 8, 2, 3.2
BLOCK = 2048
NONE = -(2**63)
#: Groups of fewer rows are compared pair by pair, many groups at a time.
FEW = 8


def _d8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and a next point of D8 (integer points of even sum) to each row."""
    r = np.rint(x)
    e = x - r
    o = np.argsort(-np.abs(e), axis=1)
    rows = np.arange(len(x))
    up = np.where(e >= 0, 1.0, -1.0)

    def flip(p, j):
        p = p.copy()
        p[rows, j] += up[rows, j]
        return p

    odd = (r.sum(1) % 2 != 0)[:, None]
    one, two = flip(r, o[:, 0]), flip(r, o[:, 1])
    both = flip(one, o[:, 1])
    return np.where(odd, one, r), np.where(odd, two, both)


def e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and second nearest found point of E8 = D8 and D8 + 1/2, doubled to integers."""
    a = _d8(x)
    b = tuple(p + 0.5 for p in _d8(x - 0.5))
    c = np.stack([*a, *b])
    d = ((c - x) ** 2).sum(2)
    o = np.argsort(d, axis=0, kind="stable")
    rows = np.arange(len(x))
    return (2 * c[o[0], rows]).astype(np.int64), (2 * c[o[1], rows]).astype(np.int64)


def projections(dim: int) -> np.ndarray:
    """Random directions with orthonormal rows where there are enough dimensions, scaled so that lengths are kept on average."""
    g = np.random.default_rng(dim).standard_normal((TABLES, dim, 8 * BLOCKS))
    out = np.stack([np.linalg.qr(x)[0] if dim >= 8 * BLOCKS else x / np.sqrt(dim) for x in g])
    return out * SCALE * np.sqrt(dim / 64.0)


def cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (n, dim) to (home cells (n, TABLES), probed cells (n, TABLES, BLOCKS))."""
    n = len(x)
    p = projections(x.shape[1])
    home, probe = np.empty((n, TABLES), np.uint64), np.empty((n, TABLES, BLOCKS), np.uint64)

    def name(points):
        h = np.full(n, t + 1, np.uint64)
        for block in points:
            for j in range(8):
                h = mix(h * BASE + block[:, j].view(np.uint64))
        return h

    for t in range(TABLES):
        y = x @ p[t]
        near = [e8(y[:, 8 * b : 8 * b + 8]) for b in range(BLOCKS)]
        home[:, t] = name([a for a, _ in near])
        for b in range(BLOCKS):
            probe[:, t, b] = name([near[c][1] if c == b else near[c][0] for c in range(BLOCKS)])
    return home.view(np.int64), probe.view(np.int64)


def unit(col: pa.Array) -> np.ndarray:
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), float).reshape(len(col), -1)
    return flat / np.sqrt((flat * flat).sum(1))[:, None]


def addressed(classes: DataFrame) -> DataFrame:
    """classes (id, w, label, v) to rows (cell, id): one for each cell at home or probed."""

    def run(batches):
        for b in batches:
            size = np.diff(b.column(2).offsets.to_numpy())
            for dim in np.unique(size):
                part = b.filter(pa.array(size == dim))
                home, probe = cells(unit(part.column(2)))
                salt = mix(part.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) * BASE + np.uint64(dim))
                for h in [home[:, t] for t in range(TABLES)] + [probe[:, t, k] for t in range(TABLES) for k in range(BLOCKS)]:
                    yield pa.RecordBatch.from_arrays([pa.array(mix(h.view(np.uint64) ^ salt).view(np.int64)), part.column(0)], ["cell", "id"])

    return classes.select("id", "label", "v").mapInArrow(run, "cell long, id long")


class Met:
    """The rows of some groups: unit vectors and cells as they were addressed."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        self.id, self.w, self.cell = (t.column(c).to_numpy() for c in ("id", "w", "cell"))
        v = t.column("v").chunk(0)
        self.dim = np.diff(v.offsets.to_numpy())
        self.label = t.column("label").to_numpy()
        self.x = np.zeros((len(self.id), int(self.dim.max())))
        self.home, self.probe = np.zeros((len(self.id), TABLES), np.int64), np.zeros((len(self.id), TABLES, BLOCKS), np.int64)
        for d in np.unique(self.dim):
            i = np.flatnonzero(self.dim == d)
            u = unit(v.take(pa.array(i)))
            self.x[i, :d] = u
            h, p = cells(u)
            salt = mix(self.label[i].astype(np.int64).view(np.uint64) * BASE + np.uint64(d))
            self.home[i] = mix(h.view(np.uint64) ^ salt[:, None]).view(np.int64)
            self.probe[i] = mix(p.view(np.uint64) ^ salt[:, None, None]).view(np.int64)

    def counts(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the pair of rows i, j, met in the cell of both, counts here: no earlier table or smaller cell where it meets."""
        here = self.cell[i]
        ok = np.zeros(len(i), bool)
        open_ = self.id[i] != self.id[j]
        for t in range(TABLES):
            hi, hj = self.home[i, t], self.home[j, t]
            at_i = (hi[:, None] == self.probe[j, t]).any(1)
            at_j = (hj[:, None] == self.probe[i, t]).any(1)
            same = hi == hj
            meets = same | at_i | at_j
            where = np.where(same, hi, np.where(at_i & at_j, np.minimum(hi, hj), np.where(at_i, hi, hj)))
            ok |= open_ & meets & (where == here)
            open_ &= ~meets
        return ok


def compare(rows: DataFrame) -> DataFrame:
    """Rows (cell, side, group, id, w, v, label), a partition holding whole groups, to (id, other, n).

    n is a number of links of id, other a vector of its component; the rows (id, other) join what the links join.

    side 0 stands for a group in which all are compared; in others rows of side 1 are compared with those of side 2.
    """

    def run(batches):
        got = list(batches)
        t = pa.Table.from_batches(got) if got else None
        if t is None or not t.num_rows:
            return
        g = t.column("group").to_numpy()
        o = np.argsort(g, kind="stable")
        size = np.diff(np.flatnonzero(np.concatenate([[True], g[o][1:] != g[o][:-1], [True]])))
        o = o[np.repeat(size > 1, size)]
        if not len(o):
            return
        g = g[o]
        side = t.column("side").to_numpy()[o]
        m = Met(t.take(pa.array(o)))
        cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
        size = np.diff(cut)
        out_i, out_j, out_n = [], [], []
        few = cut[:-1][size < FEW]
        n = size[size < FEW]
        for a in range(FEW - 1):
            for b in range(a + 1, FEW - 1):
                s = few[n > b]
                for k in range(0, len(s), 50_000):
                    i, j = s[k : k + 50_000] + a, s[k : k + 50_000] + b
                    link = np.einsum("ij,ij->i", m.x[i], m.x[j]) >= LEAST
                    i, j = i[link & ((side[i] == 0) | (side[i] != side[j]))], j[link & ((side[i] == 0) | (side[i] != side[j]))]
                    ok = m.counts(i, j)
                    i, j = i[ok], j[ok]
                    out_i += [m.id[i], m.id[j]]
                    out_j += [m.id[j], m.id[i]]
                    out_n += [m.w[j], m.w[i]]
        for s, k in zip(cut[:-1][size >= FEW], size[size >= FEW], strict=True):
            total, root = np.zeros(k, np.int64), np.arange(k)
            x = m.x[s : s + k]
            for r in range(0, k, 256):
                link = x[r : r + 256] @ x.T >= LEAST
                a = side[s + r : s + min(r + 256, k)]
                link &= (a[:, None] == 0) | (a[:, None] != side[s : s + k][None, :])
                i, j = np.nonzero(link)
                i += r
                ok = m.counts(s + i, s + j)
                i, j = i[ok], j[ok]
                np.add.at(total, i, m.w[s + j])
                root = merged(root, i[i < j], j[i < j])
            some = np.flatnonzero(total)
            out_i.append(m.id[s + some])
            out_j.append(m.id[s + root[some]])
            out_n.append(total[some])
        if out_i:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (out_i, out_j, out_n)], ["id", "other", "n"])

    return rows.mapInArrow(run, "id long, other long, n long")


def links(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding, label) to (vec_id, n_links, component_id, kept)."""
    v = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NONE)).alias("id"), F.col("embedding").cast("array<float>").alias("v"), F.col("label").cast("long").alias("label"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.withColumn("live", F.coalesce(whole & F.col("label").isNotNull(), F.lit(False)))
    v = v.withColumn("same", F.when(F.col("live"), F.sha2(F.to_json(F.struct("label", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0).cast("float")).otherwise(x)).alias("v"))), 256)))
    classes = written(v.filter("live").groupBy("same").agg(F.min("id").alias("id"), F.count("*").alias("w"), F.first("label").alias("label"), F.first("v").alias("v")), "vectors")
    at = written(addressed(classes), "cells")
    # Every row of a cell of k blocks goes to the k groups in which its block takes part.
    size = at.groupBy("cell").agg(F.count("*").alias("size")).filter("size > 1").withColumn("k", F.ceil(F.col("size") / BLOCK).cast("int"))
    r = at.join(size, "cell").withColumn("b", F.pmod(F.xxhash64("id", "cell"), F.col("k")).cast("int"))
    r = r.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    r = r.withColumn("side", F.when(F.col("o") == F.col("b"), 0).when(F.col("b") < F.col("o"), 1).otherwise(2))
    r = r.withColumn("group", F.when(F.col("k") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("b", "o"), F.greatest("b", "o"))))
    # A pair of rows of one block meets in that block's own group alone, a pair of different blocks in theirs. Only names of
    # cells were dealt out so far; the vectors follow to the groups that have more than one.
    r = r.select("cell", "side", "group", "id").join(classes.select("id", "w", "v", "label").hint("shuffle_hash"), "id")
    met = written(compare(r.select("cell", "side", "group", "id", "w", "v", "label").repartition("group")), "links")
    n = met.groupBy("id").agg(F.sum("n").alias("n"))
    all_ = v.join(classes.select("same", F.col("id").alias("rep"), "w"), "same", "left").select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("w", F.lit(1)).alias("w"))
    edges = met.select(F.col("id").alias("a"), F.col("other").alias("b")).union(all_.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    root = components(edges, "groups").withColumnRenamed("id", "x")
    out = all_.join(n.withColumnRenamed("id", "rep"), "rep", "left")
    out = out.join(root, out["id"] == root["x"], "left").withColumn("root", F.coalesce("root", "id"))
    named = lambda c: F.when(F.col(c) != NONE, F.col(c))
    return out.select(named("id").alias("vec_id"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).cast("long").alias("n_links"), named("root").alias("component_id"), (F.col("id") == F.col("root")).alias("kept"))


def embeddings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
