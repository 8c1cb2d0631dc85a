"""Quality rules: counted properties of texts, and perplexity under a modified Kneser-Ney model of each language.

The model's units are bytes of words, each word followed by one space. Grams of ORDER bytes are counted over all texts of a language;
a shorter gram counts how many different bytes stand before it. With c the count of a gram, t and n1, n2, n3 the total and the numbers
of bytes seen once, twice and more often after its context, and D1, D2, D3 the discounts of its order (from the numbers of grams
seen 1 to 4 times), its probability is (c - D(c)) / t + (D1 n1 + D2 n2 + D3 n3) / t * that of the gram without its first byte; below
single bytes lie 1 / 256. A discount that can't be estimated between 0 and i is i / 2. Counts, discounts and probabilities are aggregates and joins. Scoring looks up sorted arrays of hashes (a
bijection of language and gram, so none collide) by binary search. The arrays fall apart by the two bytes before the last, and are
broadcast in parts of at most MOST entries where they are more (a pair of bytes has 2**24 grams a language at most).

A text's bits are the mean cost of its words. With m the median bits of a language's different texts and s 1.4826 times their median
distance from it, each times the root of its number of words, a text of n words is rejected if its bits lie further from m than WIDTH
times the root of s * s / n + (LEAST * m)**2: below or above the band of its language, which is as wide as chance makes it at that length.

Defined results: null texts have no words; texts without words have bits null and no verdict of the model (the base rules reject
them); rows without a language form one of their own; repeated rows are judged alike, and count as often as they occur in the model and
once in the band. A model's languages are taken to be some thousands at most. Other columns are carried along by `judge`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import forget, small_batches, text_slices, written
from .textcore import mix, prefix, shingles, span_hash

ORDER = 5
#: Entries of the arrays that are broadcast at a time.
MOST = 6_000_000
WIDTH, LEAST = 5.0, 0.02
#: Steps of a binary logarithm in which medians are taken.
STEPS = 1000
#: Fixed values of the contract.
FEWEST, SPAN, PERCENT = 10, 5, 20
SYMBOLS = b"#*$%&|<>"
GAP = np.zeros(256, bool)
GAP[[32, *range(9, 14)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(SYMBOLS)] = True
SPACE = 32


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte start, byte end) of the words of all texts, and the first word of each text plus the total."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~GAP[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = off[(off > 0) & (off < len(data))]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def codes(data: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ORDER bytes up to and with each byte as one integer, where texts start)."""
    long = e - s + 1
    n = np.concatenate([[0], np.cumsum(long)])[first]
    texts = len(first) - 1
    of = np.repeat(np.arange(texts), np.diff(first))
    # Before each text stand ORDER - 1 spaces, after each word one.
    out = np.full(int(n[-1]) + (ORDER - 1) * texts, SPACE, np.uint64)
    at = np.cumsum(long) - long + (ORDER - 1) * (of + 1)
    k = e - s
    into = np.repeat(at - np.cumsum(k) + k, k) + np.arange(int(k.sum()))
    out[into] = data[np.repeat(s - np.cumsum(k) + k, k) + np.arange(int(k.sum()))]
    code = out[ORDER - 1 :].copy()
    for j in range(1, ORDER):
        code |= out[ORDER - 1 - j : len(out) - j] << np.uint64(8 * j)
    real = np.ones(len(code), bool)
    for j in range(ORDER - 1):
        real[n[1:-1] + (ORDER - 1) * np.arange(texts - 1) + j] = False
    return code[real] if texts > 1 else code, n


def properties(part: pa.RecordBatch, data: np.ndarray, off: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text, one row each."""
    texts = len(off) - 1
    out = np.zeros((5, texts), np.int64)
    out[0] = np.diff(first)
    if not len(data):
        return out
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[off])
    out[1] = total(~GAP[data] & ((data & 0xC0) != 0x80))
    out[2] = total(SYMBOL[data])
    raw = data.tobytes()
    for i in np.flatnonzero(total(data == 10)).tolist():
        lines = [x for x in raw[off[i] : off[i + 1]].split(b"\n") if x.strip(b" \t\n\v\f\r")]
        out[3, i] = len(lines) - len(set(lines))
    if len(s):
        w = mix(span_hash(prefix(data), s, e))
        h = shingles(w, SPAN)
        of = np.repeat(np.arange(texts), out[0])
        inside = np.flatnonzero(of[: len(h)] == of[SPAN - 1 :]) if len(h) else np.zeros(0, np.int64)
        order = inside[np.lexsort((h[inside], of[inside]))]
        same = (h[order[1:]] == h[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        cover = np.zeros(len(s) + 1, np.int64)
        np.add.at(cover, order[again], 1)
        np.add.at(cover, order[again] + SPAN, -1)
        out[4] = np.bincount(of, np.cumsum(cover)[:-1] > 0, texts)
    return out


def count(docs: DataFrame) -> DataFrame:
    """docs (lang, text) to (lang, gram, n: occurrences); what a task has seen is summed before the shuffle."""

    def merge(parts):
        g, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        u, at = np.unique(g, return_inverse=True)
        return u, np.bincount(at, n).astype(np.int64)

    def send(lang, g, n):
        for i in range(0, len(g), 100_000):
            k = len(g[i : i + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array(g[i : i + k].astype(np.int64)), pa.array(n[i : i + k])], ["lang", "gram", "n"])

    def run(batches):
        held: dict[str, list] = {}
        for part, data, off in text_slices(batches, "text"):
            code, at = codes(data, *spans(data, off))
            lang = np.array(part.column("lang").to_pylist(), object)
            of = np.repeat(np.arange(len(lang)), np.diff(at))
            for x in set(lang):
                g, n = np.unique(code[(lang == x)[of]], return_counts=True)
                parts = held.setdefault(x, [])
                parts.append((g, n))
                if len(parts) > 1 and sum(len(p[0]) for p in parts) > 400_000:
                    held[x] = parts = [merge(parts)]
                if len(parts) == 1 and len(parts[0][0]) > 200_000:
                    yield from send(x, *held.pop(x)[0])
        for x, parts in held.items():
            yield from send(x, *merge(parts))

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def mask(k: int) -> Column:
    return F.lit((1 << 8 * k) - 1)


class Model:
    """Tables (lang, k, gram, cost) of the grams of k bytes and (lang, k, gram, cost) of what leaving a context of k - 1 bytes costs, in the shared folder."""

    def __init__(self, docs: DataFrame):
        counts = {ORDER: written(count(docs), "grams")}
        for k in range(ORDER - 1, 0, -1):
            counts[k] = written(counts[k + 1].groupBy("lang", F.col("gram").bitwiseAND(mask(k)).alias("gram")).agg(F.count("*").alias("n")), "grams")
        self.spark = docs.sparkSession
        self.costs, self.leaving = [], []
        lower = None
        for k in range(1, ORDER + 1):
            c, n = counts[k], F.col("n")
            of = [F.sum((n == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
            # None where a number of them is 0; then, or where a discount isn't between 0 and the count, half the count is taken off.
            y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
            cut = [(i, i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))) for i in (1, 2, 3)]
            # A row for each language.
            discounts = F.broadcast(c.groupBy("lang").agg(*of).select("lang", *(F.when((x > 0) & (x < i), x).otherwise(i / 2).alias(f"d{i}") for i, x in cut)))
            c = c.join(discounts, "lang").withColumn("d", F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))).withColumn("context", F.shiftright("gram", 8))
            ends = c.groupBy("lang", "context").agg(F.sum("n").cast("double").alias("t"), F.sum("d").alias("cut")).withColumn("leave", F.col("cut") / F.col("t"))
            p = c.join(ends, ["lang", "context"])
            if lower is None:
                p = p.withColumn("below", F.lit(1 / 256.0))
            else:
                p = p.withColumn("shorter", F.col("gram").bitwiseAND(mask(k - 1))).join(lower.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("below")), ["lang", "shorter"])
            lower = written(p.select("lang", "gram", ((n - F.col("d")) / F.col("t") + F.col("leave") * F.col("below")).alias("p")), "costs")
            self.costs.append(lower)
            self.leaving.append(written(ends.select("lang", F.col("context").alias("gram"), F.col("leave").alias("p")), "leaving"))
        for x in counts.values():
            forget(x)
        self.langs = sorted(r[0] for r in self.costs[0].select("lang").distinct().collect())

    def pair(self, k: int, context: bool) -> Column:
        return F.col("gram").bitwiseAND(mask(2)) if context else F.shiftright("gram", 8).bitwiseAND(mask(2))

    def parts(self) -> list[list[int]]:
        """Pairs of bytes, by how many entries they have."""
        size: dict[int, int] = {}
        for k in range(3, ORDER + 1):
            for table, context in ((self.costs[k - 1], False), (self.leaving[k - 1], True)):
                for pair, n in table.groupBy(self.pair(k, context)).agg(F.count("*")).collect():
                    size[pair] = size.get(pair, 0) + n
        out, held = [], MOST
        for pair in sorted(size):
            if held + size[pair] > MOST:
                out.append([])
                held = 0
            out[-1].append(pair)
            held += size[pair]
        return out or [[]]

    def arrays(self, part: list[int] | None) -> list:
        """For each order, hashes and costs of grams and of contexts, sorted by hash; of a part, or all."""
        code = F.create_map(*(x for i, l in enumerate(self.langs) for x in (F.lit(l), F.lit(i)))) if self.langs else F.create_map(F.lit(""), F.lit(0))
        out = []
        for k in range(1, ORDER + 1):
            two = []
            for table, context in ((self.costs[k - 1], False), (self.leaving[k - 1], True)):
                if part is not None and k > 2:
                    # At most 65,536 pairs.
                    mine = F.broadcast(self.spark.createDataFrame([(x,) for x in part], "pair long"))
                    table = table.withColumn("pair", self.pair(k, context)).join(mine, "pair", "left_semi")
                got = table.select(code[F.col("lang")].alias("lang"), "gram", "p").toArrow()
                h = mix(keys(got.column("lang").to_numpy(), got.column("gram").to_numpy().astype(np.uint64)))
                o = np.argsort(h)
                with np.errstate(divide="ignore"):
                    two += [h[o], -np.log2(got.column("p").to_numpy()[o])]
            out.append(two)
        return out

    def forget(self) -> None:
        for x in [*self.costs, *self.leaving]:
            forget(x)


def keys(lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
    return lang.astype(np.uint64) << np.uint64(8 * ORDER) | gram


def looked_up(arrays: list, key: np.ndarray, k: int = ORDER) -> np.ndarray:
    """Cost in bits of each gram of k bytes, given as language and gram; one that isn't known is left for the next shorter."""
    if not k:
        return np.full(len(key), 8.0)
    hashes, cost, contexts, leave = arrays[k - 1]
    found = lambda h, known: np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
    out = np.zeros(len(key))
    if len(hashes):
        h = mix(key)
        i = found(h, hashes)
        hit = hashes[i] == h
        out[hit] = cost[i[hit]]
    else:
        hit = np.zeros(len(key), bool)
    miss = np.flatnonzero(~hit)
    if len(miss):
        m = key[miss]
        lang, gram = m >> np.uint64(8 * ORDER), m & np.uint64((1 << 8 * ORDER) - 1)
        more = np.zeros(len(m))
        if len(contexts):
            h = mix(keys(lang, gram >> np.uint64(8)))
            i = found(h, contexts)
            more = np.where(contexts[i] == h, leave[i], 0.0)
        out[miss] = more + looked_up(arrays, keys(lang, gram & np.uint64((1 << 8 * (k - 1)) - 1)), k - 1)
    return out


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def summed(docs: DataFrame, model: Model, part: list[int] | None, keep: list[str], base: bool) -> DataFrame:
    """docs (keep, lang, text) to (keep, BASE if asked for, cost: of all bytes whose grams are of the part)."""
    known = docs.sparkSession.sparkContext.broadcast(model.arrays(part))
    langs = {x: i for i, x in enumerate(model.langs)}
    pairs = None
    if part is not None:
        pairs = np.zeros(1 << 16, bool)
        pairs[part] = True

    def run(batches):
        for b, data, off in text_slices(batches, "text"):
            s, e, first = spans(data, off)
            code, at = codes(data, s, e, first)
            n = np.diff(at)
            lang = np.array([langs.get(x, (1 << 20) - 1) for x in b.column("lang").to_pylist()], np.int64)
            of = np.repeat(np.arange(len(n)), n)
            if pairs is not None:
                mine = pairs[(code >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.int64)]
                code, of = code[mine], of[mine]
            u, back = np.unique(keys(lang[of], code), return_inverse=True)
            cost = looked_up(known.value, u)[back]
            more = [pa.array(x) for x in properties(b, data, off, s, e, first)] if base else []
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *more, pa.array(np.bincount(of, cost, len(n)).astype(float))], [*keep, *(BASE if base else []), "cost"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + ([f"{x} long" for x in BASE] if base else []) + ["cost double"]
    return docs.select(*keep, *(c for c in ("lang", "text") if c not in keep)).mapInArrow(run, ", ".join(kinds))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs to (all of its columns but the text, BASE, cost, digest of the text), as a written table; `lang` null counts as ''."""
    docs = docs.withColumn("lang", F.coalesce("lang", F.lit(""))).withColumn("digest", F.xxhash64("text"))
    keep = [c for c in docs.columns if c != "text"]
    parts = model.parts()
    if len(parts) == 1:
        return written(summed(docs, model, None, keep, True), "scored")
    # Equal texts of a language have equal sums: those of the parts meet by digest.
    docs = docs.withColumn("digest", F.sha2("text", 256))
    sums = None
    for i, part in enumerate(parts):
        s = summed(docs.select("lang", "digest", "text"), model, part, ["lang", "digest"], False).groupBy("lang", "digest").agg(F.max("cost").alias("cost"))
        s = written(s.withColumn("part", F.lit(i)), "sums")
        sums = s if sums is None else sums.union(s)
    sums = sums.groupBy(F.col("lang").alias("l"), F.col("digest").alias("g")).agg(F.sum("cost").alias("cost"))
    based = summed(docs, model, [], keep, True).drop("cost")
    return written(based.join(sums, (F.col("lang") == F.col("l")) & F.col("digest").eqNullSafe(F.col("g"))).drop("l", "g"), "scored")


def median(values: DataFrame) -> DataFrame:
    """(lang, value > 0) to (lang, middle: the median, to a step of its logarithm); an aggregate over some tens of thousands of steps at most."""
    steps = values.select("lang", F.floor(F.log2("value") * STEPS).cast("double").alias("step"))
    return steps.groupBy("lang").agg(F.pow(F.lit(2.0), (F.percentile("step", 0.5) + 0.5) / STEPS).alias("middle"))


def bands(rows: DataFrame) -> DataFrame:
    """scored() to a row for each language: (lang, middle: median of its texts' bits, spread of one word)."""
    one = rows.filter("n_words > 0").groupBy("lang", "digest").agg(F.max(F.col("cost") / F.col("n_words")).alias("value"), F.max("n_words").alias("n"))
    middle = F.broadcast(median(one))
    away = F.greatest(F.abs(F.col("value") - F.col("middle")) * F.sqrt("n"), F.lit(1e-6))
    spread = median(one.join(middle, "lang").select("lang", away.alias("value"))).select("lang", (F.lit(1.4826) * F.col("middle")).alias("spread"))
    return middle.join(spread, "lang")


def judge(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs (text, lang and others) to (its columns but text, BASE, base_failed, bits, kept); a column of docs with one of these names is replaced.

    Where no model is given, one is counted from docs. Bits are the mean cost of a word; its perplexity is 2 to their power.
    """
    docs = docs.drop(*BASE, "cost", "base_failed", "bits", "kept", "middle", "spread", "digest")
    mine = model is None
    asked = docs.withColumn("__lang", F.col("lang"))
    if mine:
        model = Model(docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text"))
    rows = scored(asked, model)
    if mine:
        model.forget()
    # A row for each language.
    rows = rows.join(F.broadcast(bands(rows)), "lang", "left")
    n, bits = F.col("n_words"), F.col("cost") / F.col("n_words")
    failed = (n < FEWEST) | (100 * F.col("n_repeat_words") > PERCENT * n)
    width = WIDTH * F.sqrt(F.col("spread") * F.col("spread") / n + F.pow(LEAST * F.col("middle"), F.lit(2.0)))
    fits = F.when(n > 0, F.abs(bits - F.col("middle")) <= width).otherwise(False)
    rows = rows.withColumn("base_failed", failed).withColumn("bits", F.when(n > 0, F.round(bits, 6))).withColumn("kept", ~failed & F.coalesce(fits, F.lit(False)))
    return rows.withColumn("lang", F.col("__lang")).select(*[c for c in docs.columns if c != "text"], *BASE, "base_failed", "bits", "kept")


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")).select("doc_id", *BASE, "base_failed", "kept", "bits")
