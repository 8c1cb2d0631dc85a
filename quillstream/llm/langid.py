"""Language identification by prediction by partial matching.

For each language a byte context tree of order ORDER is counted over all training texts and then frozen.
In a context seen T times, followed by q different bytes, a byte seen c times has probability c / (T + q);
the escape to the next shorter context has q / (T + q). A text's code length under a language is the sum of
its bytes' exact costs; the shortest wins, ties going to the first language in order.

Texts are lower-cased, and what stands between words counts as one space. Every context counted is kept. All contexts
of a byte share the byte before it, so the trees fall apart by that byte: where they are over MOST costs, parts of at most as
many are broadcast one after the other, each adds its bytes' costs to the texts' code lengths, and the sums are the same.

Defined results: null texts and those without a letter are `und` with score 0; so is every text if nothing can
be learned; repeated rows are judged alike. The score is the posterior of the language chosen, with code lengths
divided by TEMPER.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import forget, small_batches, text_slices, written
from .textcore import fold
from .toxicity import held_out

ORDER = 4
#: Costs, one for each context with byte and language, in a part of the trees.
MOST = 12_000_000
TEMPER = 4.0
UNKNOWN = "und"
SPACE = 32


def codes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ORDER + 1 bytes up to and with each byte as one integer, places where texts start)."""
    low, word = fold(data)
    word &= ~((low >= 48) & (low <= 57))
    before = np.concatenate([[False], word[:-1]])
    before[off[off < len(data)]] = False
    keep = word | before
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.flatnonzero(keep)
    out = np.full(len(at) + ORDER * len(off), SPACE, np.uint64)
    out[np.arange(len(at)) + ORDER * (doc[at] + 1)] = np.where(word[at], low[at], SPACE)
    code = out[ORDER:].copy()
    for j in range(1, ORDER + 1):
        code |= out[ORDER - j : len(out) - j] << np.uint64(8 * j)
    n = np.bincount(doc[at], minlength=len(off) - 1)
    real = np.ones(len(code), bool)
    first = np.concatenate([[0], np.cumsum(n)])
    for j in range(ORDER):
        real[first[1:] + ORDER * np.arange(len(n)) + j] = False
    return code[real], first


def count(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of docs (text, lang); partial counts are summed before the shuffle."""

    def merge(parts):
        g, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        o = np.argsort(g, kind="stable")
        g, n = g[o], n[o]
        head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        return g[head], np.add.reduceat(n, head)

    def send(lang, parts):
        g, n = merge(parts)
        for i in range(0, len(g), 50_000):
            k = len(g[i : i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array(g[i : i + k].astype(np.int64)), pa.array(n[i : i + k])], ["lang", "gram", "n"])

    def run(batches):
        held: dict[str, list] = {}
        for part, data, off in text_slices(batches, "text"):
            code, first = codes(data, off)
            lang = np.array(part.column("lang").to_pylist(), object)
            at = np.repeat(np.arange(len(lang)), np.diff(first))
            for x in sorted(set(lang)):
                g = np.sort(code[(lang == x)[at]])
                if len(g):
                    head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                    parts = held.setdefault(x, [])
                    parts.append((g[head], np.diff(np.append(head, len(g)))))
                    if len(parts) > 1 and sum(len(p[0]) for p in parts) > 400_000:
                        held[x] = parts = [merge(parts)]
                        if len(parts[0][0]) > 200_000:
                            yield from send(x, held.pop(x))
        for x, parts in held.items():
            yield from send(x, parts)

    return docs.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Trees:
    """Costs in bits, for all languages at once, of every known context with byte, by order."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], counts: list[np.ndarray], single: list[np.ndarray] | None = None, before: np.ndarray | None = None):
        """Counts of grams by language; for a part of the trees also the counts of single bytes and which bytes before are its."""
        self.langs, k, self.before = langs, len(langs), before
        self.known: list[np.ndarray] = []
        self.cost: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        lower = lambda g, o: self.lookup(o - 1, g & np.uint64((1 << 8 * o) - 1)) if o else np.full((len(g), k), 8.0)
        for o in range(ORDER + 1):
            mask = np.uint64((1 << 8 * (o + 1)) - 1)
            per = []
            for j, (g, n) in enumerate(zip(grams, counts, strict=True)):
                if not o and single is not None:
                    u = np.flatnonzero(single[j]).astype(np.uint64)
                    per.append((u, single[j][u]))
                    continue
                u, back = np.unique(g & mask, return_inverse=True)
                per.append((u, np.bincount(back, n)))
            all_ = np.unique(np.concatenate([p[0] for p in per])) if o else np.arange(256, dtype=np.uint64)
            ctx = np.unique(all_ >> np.uint64(8))
            esc = np.zeros((len(ctx), k))
            cost = lower(all_, o)
            home = np.searchsorted(ctx, all_ >> np.uint64(8))
            for j, (u, n) in enumerate(per):
                c = np.searchsorted(ctx, u >> np.uint64(8))
                total, kinds = np.bincount(c, n, len(ctx)), np.bincount(c, minlength=len(ctx))
                seen = total > 0
                esc[seen, j] = -np.log2(kinds[seen] / (total[seen] + kinds[seen]))
                cost[:, j] += esc[home, j]
                cost[np.searchsorted(all_, u), j] = -np.log2(n / (total[c] + kinds[c]))
            self.known.append(all_)
            self.cost.append(cost)
            self.contexts.append(ctx)
            self.escape.append(esc)

    def lookup(self, o: int, g: np.ndarray) -> np.ndarray:
        """Costs of grams of order o, falling to shorter contexts where one isn't known."""
        i = np.minimum(np.searchsorted(self.known[o], g), len(self.known[o]) - 1)
        out = self.cost[o][i]
        miss = np.flatnonzero(self.known[o][i] != g)
        if len(miss):
            m = g[miss]
            c = np.minimum(np.searchsorted(self.contexts[o], m >> np.uint64(8)), len(self.contexts[o]) - 1)
            add = np.where((self.contexts[o][c] == m >> np.uint64(8))[:, None], self.escape[o][c], 0.0)
            out[miss] = add + self.lookup(o - 1, m & np.uint64((1 << 8 * o) - 1))
        return out

    def totals(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Code length of each text in each language; every different gram is looked up once."""
        o = np.argsort(code)
        g = code[o]
        head = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
        here = g[head]
        if self.before is None:
            cost = self.lookup(ORDER, here).astype(np.float32)
        else:
            cost = np.zeros((len(here), len(self.langs)), np.float32)
            mine = np.flatnonzero(self.before[(here >> np.uint64(8) & np.uint64(255)).astype(np.int64)])
            if len(mine):
                cost[mine] = self.lookup(ORDER, here[mine])
        which = np.empty(len(g), np.int32)
        which[o] = np.cumsum(head) - 1
        out = np.zeros((len(first) - 1, len(self.langs)))
        some = np.flatnonzero(np.diff(first))
        if len(some):
            for j in range(len(self.langs)):
                out[some, j] = np.add.reduceat(cost[:, j][which], first[some], dtype=np.float64)
        return out


class Fit:
    """All counts, as a table in the shared folder, and how they are dealt out to parts of the trees."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        before = F.shiftright("gram", 8).bitwiseAND(255)
        self.counts = written(count(docs).withColumn("before", before), "grams")
        self.langs = sorted(r[0] for r in self.counts.select("lang").distinct().collect())
        size = {r[0]: r[1] * len(self.langs) for r in self.counts.groupBy("before").agg(F.count("*")).collect()}
        self.parts: list[list[int]] = []
        held = MOST
        for b in sorted(size):
            if held + size[b] > MOST:
                self.parts.append([])
                held = 0
            self.parts[-1].append(b)
            held += size[b]

    def single(self) -> list[np.ndarray]:
        out = {x: np.zeros(256) for x in self.langs}
        for x, b, n in self.counts.groupBy("lang", F.col("gram").bitwiseAND(255)).agg(F.sum("n")).collect():
            out[x][b] = n
        return [out[x] for x in self.langs]

    def trees(self, part: list[int], single) -> Trees:
        got = self.counts.filter(F.col("before").isin(part)) if single else self.counts
        code = F.create_map(*(x for i, l in enumerate(self.langs) for x in (F.lit(l), F.lit(i))))
        got = got.select(code[F.col("lang")].alias("lang"), "gram", "n").toArrow()
        lang, gram, num = got.column("lang").to_numpy(), got.column("gram").to_numpy().astype(np.uint64), got.column("n").to_numpy().astype(float)
        before = np.isin(np.arange(256), part) if single else None
        every = range(len(self.langs))
        return Trees(self.langs, [gram[lang == i] for i in every], [num[lang == i] for i in every], single, before)


def identify(docs: DataFrame, fit: Fit) -> DataFrame:
    """docs to (all of its columns, lang_pred, score); a column of docs with one of these names is replaced."""
    docs = docs.drop("lang_pred", "score", "__bits")
    names, context = docs.columns, docs.sparkSession.sparkContext
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letters")
    schema = docs.schema.add("lang_pred", "string").add("score", "double")

    def judged(part, bits, found):
        best = bits.argmin(1)
        rest = np.exp2(-np.minimum((bits - bits.min(1, keepdims=True)) / TEMPER, 1000))
        score = np.where(found, 1 / rest.sum(1), 0.0)
        pred = np.where(found, np.array(langs, object)[best], UNKNOWN)
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(pred.tolist(), pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    langs = fit.langs
    if not langs:
        return docs.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if len(fit.parts) == 1:
        trees = context.broadcast(fit.trees(fit.parts[0], None))

        def whole(batches):
            for part, data, off in text_slices(batches, "text"):
                yield judged(part, trees.value.totals(*codes(data, off)), part.column("__letters").to_numpy(zero_copy_only=False))

        return docs.select(*names, letters).mapInArrow(whole, schema)

    def added(trees):
        def run(batches):
            for part, data, off in text_slices(batches, "text"):
                have = part.column("__bits")
                bits = trees.value.totals(*codes(data, off)) + have.flatten().to_numpy().reshape(len(have), -1)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(list(bits), pa.list_(pa.float64()))], [*names, "__bits"])

        return run

    single = fit.single()
    d = docs.withColumn("__bits", F.array(*[F.lit(0.0)] * len(langs)))
    for n, p in enumerate(fit.parts):
        trees = context.broadcast(fit.trees(p, single))
        new = written(d.mapInArrow(added(trees), d.schema), "bits")
        trees.unpersist()
        if n:
            forget(d)
        d = new

    def last(batches):
        for part, _, _ in text_slices(batches, "text"):
            have = part.column("__bits")
            yield judged(part, have.flatten().to_numpy().reshape(len(have), -1), part.column("__letters").to_numpy(zero_copy_only=False))

    return d.select(*names, "__bits", letters).mapInArrow(last, schema)


def fitted(docs: DataFrame) -> Fit:
    """The counts of docs' training rows."""
    return Fit(docs.filter("text is not null and lang is not null").filter(~held_out(F.col("doc_id"), 4, 2)))


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "text"), fitted(docs)).select("doc_id", "held_out", "lang_pred", "score")
