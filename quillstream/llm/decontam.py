"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Seeds are the GRAM-word strings of the test items (whole items where shorter). Documents that hold a seed are
counted over the whole corpus; a seed is rare for its item if that count is at most TYPICAL times the median of the
item's seeds that occur (or LEAST_DOCS). Around the seeds that a document shares with an item, its words are aligned
locally with the item's: 2 for equal words, -1 for others and for gaps. The score over twice the item's length is at
most 1; a document is contaminated if it reaches SCORE for some item.

Places with a rare seed are always aligned. Those with common ones alone are left out only where too few of the item's
words occur for SCORE, or for more than the document's score so far: no alignment there could count. So rarity decides
only which scores below SCORE are reported.

Items are few enough for their seeds to be broadcast; more than MOST_SEEDS are worked on in slices of the items, each
over all documents.

Defined results: a null or wordless document is clean; so is every document if there are no items with words; repeated rows
are judged alike; of several items the best score counts, then the smallest item_id; items that share an item_id count
as one each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches, text_slices
from .textcore import shingles, words

GRAM = 4
TYPICAL, LEAST_DOCS = 2.0, 10
SCORE = 0.4
MOST_SEEDS = 2_000_000


class Items:
    """Words and seeds of test items."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        self.ids, self.words = [], []
        for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
            data = np.frombuffer((t or "").encode(), np.uint8)
            w = words(data, np.array([0, len(data)]))[0]
            if len(w):
                self.ids.append(i)
                self.words.append(w)
        self.vocabulary = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, np.uint64)
        self.places = [np.searchsorted(self.vocabulary, w) for w in self.words]
        seeds, item, at, size = [], [], [], []
        for k, w in enumerate(self.words):
            n = min(GRAM, len(w))
            s = shingles(w, n)
            seeds.append(s)
            item.append(np.full(len(s), k))
            at.append(np.arange(len(s)))
            size.append(np.full(len(s), n))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        seeds, self.item, self.at, size = cat(seeds, np.uint64), cat(item, np.int64), cat(at, np.int64), cat(size, np.int64)
        # Seeds of one length and hash stand together; `first` is where each different one begins.
        o = np.lexsort((seeds, size))
        self.seed, self.size, self.item, self.at = seeds[o], size[o], self.item[o], self.at[o]
        new = np.concatenate([[True], (self.seed[1:] != self.seed[:-1]) | (self.size[1:] != self.size[:-1])]) if len(o) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)
        self.number = np.cumsum(new) - 1
        self.rare = np.ones(len(o), bool)

    def keep_rare(self, docs: np.ndarray) -> None:
        """docs: number of documents with each different seed."""
        n = docs[self.number]
        o = np.lexsort((n, self.item))
        x = n[o]
        head = np.flatnonzero(np.concatenate([[True], self.item[o][1:] != self.item[o][:-1]]))
        found = np.add.reduceat((x > 0).astype(np.int64), head)
        lo = np.append(head[1:], len(o)) - found
        middle = (x[np.minimum(lo + np.maximum(found - 1, 0) // 2, len(o) - 1)] + x[np.minimum(lo + found // 2, len(o) - 1)]) / 2
        most = np.zeros(len(self.words))
        most[self.item[o][head]] = np.maximum(LEAST_DOCS, np.where(found > 0, TYPICAL * middle, 0))
        self.rare = n <= most[self.item]

    def known(self, w: np.ndarray) -> np.ndarray:
        """Which words of the vocabulary are among w."""
        out = np.zeros(len(self.vocabulary), bool)
        i = np.minimum(np.searchsorted(self.vocabulary, w), len(out) - 1)
        out[i[self.vocabulary[i] == w]] = True
        return out

    def hits(self, w: np.ndarray, first: np.ndarray):
        """(number of the different seed, place of its first word) for seeds that lie within one text."""
        found = []
        last = np.repeat(first[1:], np.diff(first))
        for n in np.unique(self.size):
            mine = self.first[self.size[self.first] == n]
            s = shingles(w, int(n))
            i = np.minimum(np.searchsorted(self.seed[mine], s), len(mine) - 1)
            at = np.flatnonzero((self.seed[mine][i] == s) & (np.arange(len(s)) + n <= last[: len(s)]))
            found.append((self.number[mine][i[at]], at))
        return (np.concatenate(x) for x in zip(*found, strict=True))


def align(item: np.ndarray, text: np.ndarray) -> int:
    """Best local alignment: 2 for a match, -1 for a mismatch or a gap of one word."""
    h, best = np.zeros(len(text) + 1, np.int64), 0
    place = np.arange(len(text) + 1)
    for w in item:
        t = np.maximum(h - 1, 0)
        t[1:] = np.maximum(t[1:], h[:-1] + np.where(text == w, 2, -1))
        h = np.maximum.accumulate(t + place) - place
        best = max(best, int(h.max()))
    return best


def seed_counts(docs: DataFrame, items: Items) -> np.ndarray:
    """Number of documents with each different seed, over all documents."""

    def run(batches):
        n = np.zeros(len(items.first), np.int64)
        for _, data, off in text_slices(batches, "text"):
            w, _, _, first = words(data, off)
            seed, at = items.hits(w, first)
            doc = np.searchsorted(first, at, "right") - 1
            n += np.bincount(np.unique(doc * len(n) + seed) % len(n), minlength=len(n))
        i = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(n[i])], ["seed", "n"])

    got = docs.select("text").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(items.first), np.int64)
    out[got.column("seed").to_numpy()] = got.column("n").to_numpy()
    return out


def _may_reach(most: float, score: float) -> bool:
    """Whether a score of at most `most` can count in a text whose score so far is `score`."""
    return most >= SCORE and most > score


def best_matches(items: Items, w: np.ndarray, first: np.ndarray):
    """For each text: (best score, number of its item or -1, first and last word aligned around)."""
    n = len(first) - 1
    score, which = np.zeros(n), np.full(n, -1)
    seed, at = items.hits(w, first)
    if not len(seed):
        return score, which
    # Every (text, item, diagonal) of a seed.
    start = items.first[seed]
    count = np.append(items.first[1:], len(items.seed))[seed] - start
    row = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
    at = np.repeat(at, count)
    doc, item, diagonal = np.searchsorted(first, at, "right") - 1, items.item[row], at - items.at[row]
    o = np.lexsort((diagonal, item, doc))
    doc, item, diagonal, rare = doc[o], item[o], diagonal[o], items.rare[row[o]]
    size = np.array([len(x) for x in items.words])[item]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > size[1:])]) if len(doc) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(doc)) - 1
    rare = np.logical_or.reduceat(rare, head)
    here, mine = None, -1  # the vocabulary in text `mine`
    for a, b, always in zip(head.tolist(), tail.tolist(), rare.tolist(), strict=True):
        d, k = doc[a], item[a]
        m = len(items.words[k])
        if not always:
            if mine != d:
                here, mine = items.known(w[first[d] : first[d + 1]]), d
            if not _may_reach(here[items.places[k]].sum() / m, score[d]):
                continue
        lo = max(first[d], diagonal[a] - m // 2)
        hi = min(first[d + 1], diagonal[b] + m + m // 2)
        if not always and not _may_reach(np.isin(items.words[k], w[lo:hi]).sum() / m, score[d]):
            continue
        s = align(items.words[k], w[lo:hi]) / (2 * m)
        if s > score[d]:
            score[d], which[d] = s, k
    return score, which


def check(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs to (all of its columns, contaminated, item_id, item_score); columns of docs with these names are replaced."""
    spark = docs.sparkSession
    docs = docs.drop("contaminated", "item_id", "item_score")
    total = benchmark.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)))).head()[0] or 0
    slices = -(-total // (2 * MOST_SEEDS)) or 1  # a word takes two characters at least
    out = None
    for i in range(slices):
        part = benchmark.select("item_id", "text")
        part = part if slices == 1 else part.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == i)
        got = part.toArrow()
        items = Items(got.column("item_id").to_pylist(), got.column("text").to_pylist())
        if len(items.first):
            items.keep_rare(seed_counts(docs, items))
        shared = spark.sparkContext.broadcast(items)
        out = _matched(docs if out is None else out, shared, out is None)
    return out


def _matched(docs: DataFrame, shared, fresh: bool) -> DataFrame:
    names = docs.columns if fresh else docs.columns[:-3]
    schema = T.StructType(list(docs.schema)).add("contaminated", "boolean").add("item_id", "long").add("item_score", "double") if fresh else docs.schema

    def run(batches):
        items = shared.value
        for part, data, off in text_slices(batches, "text"):
            n = part.num_rows
            score, ids = np.zeros(n), [None] * n
            if len(items.first):
                w, _, _, first = words(data, off)
                score, which = best_matches(items, w, first)
                ids = [items.ids[k] if k >= 0 else None for k in which.tolist()]
            if not fresh:
                before, old = part.column(len(names) + 2).to_numpy(), part.column(len(names) + 1).to_pylist()
                better = [s > x or (s == x and (i is not None and (o is None or i < o))) for s, x, i, o in zip(score, before, ids, old, strict=True)]
                ids = [i if b else o for i, o, b in zip(ids, old, better, strict=True)]
                score = np.maximum(score, before)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(score >= SCORE), pa.array(ids, pa.int64()), pa.array(score)], [*names, "contaminated", "item_id", "item_score"])

    return docs.mapInArrow(run, schema)


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return check(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")
