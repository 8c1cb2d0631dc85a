"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared window by window.

Windows are words and the beginnings and ends of words. A window's two compressed lengths, one under each dictionary,
have a calibrated log-likelihood ratio: how much more often that pair of lengths comes from toxic text. A word's evidence
is that of its best window, calibrated once more over words; a text's is the greatest sum over consecutive words, so that
neither its length nor a repeated passage hides or makes a hit. A logistic curve of it and the text's length is the score.

Training takes a bounded sample of labelled rows (about SAMPLE, those with the smallest hashes).
1. Words are counted: in toxic texts by different pairs of neighbours, so that copies count once; in ordinary ones by places.
2. Pieces (whole words, beginnings and ends of SIZES letters) are typical of toxic text if they have LEAST places there, RATIO
   times their share in ordinary text and SURE standard deviations more. The surest is taken, its words set aside, and so on.
3. The toxic dictionary is trained on the windows of those pieces, the ordinary one on windows of as many rarer ordinary words;
   a dictionary trained on frequent ordinary words belongs to both, and all of them come from zstandard's own training.

Defined results: null, empty and wordless texts have no evidence and the score of such; repeated rows are
scored alike; words of over LONGEST bytes are cut into words of that length; with no toxic label, or nothing typical
of toxic text, every score is 0; rows with a null doc_id are scored but not learned from.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import forget, small_batches, text_slices, written
from .textcore import BASE, fold, mix, words

#: About how many labelled training rows are learned from, at most.
SAMPLE = 40_000
SIZES = range(3, 9)
LEAST, RATIO, SURE = 5, 5.0, 6.0
DICTIONARY = 16_384
FREQUENT, ORDINARY = 4000, 20_000
LEVEL = 9
CACHE = 800_000
LONGEST = 64


def held_out(doc_id, mod: int, rest: int):
    """Whether crc32 of the id as text leaves the remainder; a null id counts as an empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod) == rest


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, mod: int, rest: int, most: int = SAMPLE) -> DataFrame:
    """(doc_id, text, y) of about `most` labelled training rows: those whose hash lies below a bound. Their ids are broadcast."""
    some = labels.select("doc_id", F.col(column).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    some = some.filter(~held_out(F.col("doc_id"), mod, rest)).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = some.count()
    if n > most:
        some = some.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")


def cut_words(data: np.ndarray, off: np.ndarray):
    """words(), those of over LONGEST bytes cut into several."""
    w, s, e, first = words(data, off)
    if len(s) and (e - s).max() > LONGEST:
        k = -(-(e - s) // LONGEST)
        home = np.repeat(np.arange(len(s)), k)
        step = np.arange(len(home)) - np.repeat(np.cumsum(k) - k, k)
        s, e = s[home] + step * LONGEST, np.minimum(s[home] + (step + 1) * LONGEST, e[home])
        w = np.where(k[home] > 1, mix(w[home] + step.astype(np.uint64) * BASE), w[home])
        first = np.concatenate([[0], np.cumsum(k)])[first]
    return w, s, e, first


def counted(sample: DataFrame) -> DataFrame:
    """(word, t: its different surroundings in toxic texts, o: its places in ordinary ones)."""

    def run(batches):
        for part, data, off in text_slices(batches, "text", 1 << 22):
            w, s, e, first = cut_words(data, off)
            low = fold(data)[0].tobytes()
            toxic = np.repeat(part.column("y").to_numpy() > 0, np.diff(first))
            left, right = np.zeros(len(w), np.uint64), np.zeros(len(w), np.uint64)
            left[1:], right[:-1] = w[:-1], w[1:]
            left[first[:-1][first[:-1] < len(w)]] = 0
            right[first[1:][first[1:] > 0] - 1] = 0
            key = np.where(toxic, mix(left * BASE + right) | np.uint64(1), np.uint64(0))
            o = np.lexsort((key, w))
            x, y = w[o], key[o]
            head = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(o) else o
            n, at = np.diff(np.append(head, len(o))), o[head]
            word = pa.array([low[i:j] for i, j in zip(s[at].tolist(), e[at].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([word, pa.array(key[at].view(np.int64)), pa.array(n.astype(np.int64))], ["word", "around", "n"])

    c = sample.select("text", "y").mapInArrow(run, "word binary, around long, n long")
    c = c.groupBy("word", "around").agg(F.sum("n").alias("n"))
    return c.groupBy(F.col("word").cast("string").alias("word")).agg(F.count(F.when(F.col("around") != 0, 1)).alias("t"), F.coalesce(F.sum(F.when(F.col("around") == 0, F.col("n"))), F.lit(0)).alias("o"))


def pieces(word):
    """Column of a word's pieces, as windows: a space stands where the word's border is."""
    sizes = F.filter(F.array(*map(F.lit, SIZES)), lambda k: k < F.length(word))
    front = F.transform(sizes, lambda k: F.concat(F.lit(" "), F.substring(word, F.lit(1), k)))
    back = F.transform(sizes, lambda k: F.concat(F.substring(word, -k, k), F.lit(" ")))
    return F.concat(F.array(F.concat(F.lit(" "), word, F.lit(" "))), front, back)


def typical(vocabulary: DataFrame, nt: int, no: int) -> dict[str, int]:
    """Pieces typical of toxic text with their places there that no surer piece explains."""
    rows = vocabulary.select("word", "t", "o", F.explode(pieces(F.col("word"))).alias("piece"))
    expected = F.col("po") * F.lit(nt / max(no, 1))
    sure = (F.col("pt") >= LEAST) & (F.col("pt") + 0.5 >= RATIO * (expected + 0.5)) & (F.col("pt") - expected >= SURE * F.sqrt(expected + 1))
    good = rows.groupBy("piece").agg(F.sum("t").alias("pt"), F.sum("o").alias("po")).filter(sure)
    got = rows.filter("t > 0").join(good, "piece").select("piece", "pt", "po", "word", "t", "o").collect()
    under: dict[str, list] = {}
    of: dict[str, list[str]] = {}
    for r in got:
        under.setdefault(r[0], [r[1], r[2]])
        of.setdefault(r[3], []).append(r[0])
    count = {r[3]: (r[4], r[5]) for r in got}
    holds: dict[str, list[str]] = {}
    for w, ps in of.items():
        for p in ps:
            holds.setdefault(p, []).append(w)
    out: dict[str, int] = {}
    while under:
        best = None
        for p, (t, o) in under.items():
            e = o * nt / max(no, 1)
            if t >= LEAST and t + 0.5 >= RATIO * (e + 0.5) and t - e >= SURE * math.sqrt(e + 1):
                k = ((t - e) / math.sqrt(e + 1), len(p), p)
                best = k if best is None or k > best else best
        if best is None:
            break
        out[best[2]] = under[best[2]][0]
        for w in holds[best[2]]:
            for p in of.pop(w, ()):
                if p in under:
                    under[p][0] -= count[w][0]
                    under[p][1] -= count[w][1]
        del under[best[2]]
    return out


def trained(windows: dict[str, int], most: int = 100_000) -> bytes:
    """A dictionary of windows with their frequencies; where they are too few to train on, all of them."""
    share = min(1.0, most / max(1, sum(windows.values())))
    each = [w.encode() for w, n in sorted(windows.items()) for _ in range(max(1, round(n * share)))]
    np.random.default_rng(0).shuffle(each)
    samples = [b"\n".join(each[i : i + 8]) for i in range(0, len(each), 8)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(w.encode() for w in sorted(windows))[-DICTIONARY:]


class Model:
    """Two dictionaries, the ratios of pairs of compressed lengths, and the curve of scores."""

    def __init__(self, toxic: dict[str, int], frequent: dict[str, int], ordinary: dict[str, int]):
        self.empty = not toxic
        self.kinds = sorted({(1, len(p) - 1) if p[-1] != " " else (2, len(p) - 1) if p[0] != " " else (0, len(p) - 2) for p in toxic})
        both = trained(frequent) if frequent else b""
        self.parts = [both + trained(x) for x in (toxic, ordinary)] if toxic else [b"", b""]
        self.carrier = both[-96:-32]
        self.ratio: dict[tuple, float] = {}
        self.steps: dict[int, float] = {}
        self.curve = (0.0, 0.0, 0.0)

    def start(self) -> None:
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, strategy=zstandard.STRATEGY_BTLAZY2, min_match=4, window_log=17, hash_log=16, chain_log=16, search_log=8, target_length=0, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.by = [zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for x in self.parts]
        self.known: dict[bytes, float] = {}
        self.begins = {k[:j] for k in self.ratio for j in (3, 4)}

    def windows(self, word: str):
        """(kind, letters, bytes) of a word's windows; only kinds and sizes of pieces that were learned."""
        size = len(word)
        for kind, n in self.kinds:
            if kind == 1 and size >= n:
                yield kind, n, f" {word[:n]}".encode("utf-8", "surrogateescape")
            elif kind == 2 and size >= n:
                yield kind, n, f"{word[-n:]} ".encode("utf-8", "surrogateescape")
            elif kind == 0 and size == n:
                yield kind, n, f" {word} ".encode("utf-8", "surrogateescape")

    def pair(self, kind: int, n: int, x: bytes) -> tuple:
        """What is calibrated: the window's kind and size, its lengths under the toxic and the ordinary dictionary."""
        return (kind, n, len(x), *[len(c.compress(x + self.carrier)) for c in self.by])

    def lookup(self, kind: int, n: int, x: bytes) -> float:
        """The ratio of a window's pair; lengths that no pair with a ratio begins with need no further compression."""
        if (kind, n, len(x)) not in self.begins:
            return 0.0
        toxic = (kind, n, len(x), len(self.by[0].compress(x + self.carrier)))
        return self.ratio.get((*toxic, len(self.by[1].compress(x + self.carrier))), 0.0) if toxic in self.begins else 0.0

    def best(self, word: str) -> float:
        top = 0.0
        for kind, n, x in self.windows(word):
            got = self.known.get(x)
            if got is None:
                if len(self.known) > CACHE:
                    self.known.clear()
                got = self.known[x] = self.lookup(kind, n, x)
            if got > top:
                top = got
        return top

    def evidence(self, word: str) -> float:
        return self.steps.get(int(self.best(word) * 2), 0.0)

    def score(self, evidence: np.ndarray, size: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * evidence + c * np.log1p(size), -30, 30)))


def text_evidence(model: Model, batches, column: str):
    """Yields (slice, greatest sum of evidence over consecutive words of each text, number of words)."""
    cache: dict[int, float] = {}
    model.start()
    for part, data, off in text_slices(batches, column):
        w, s, e, first = cut_words(data, off)
        different, at, back = np.unique(w, return_index=True, return_inverse=True)
        low = fold(data)[0].tobytes()
        if len(cache) > CACHE:
            cache.clear()
        m = np.zeros(len(different))
        for i, (h, k) in enumerate(zip(different.tolist(), at.tolist(), strict=True)):
            x = cache.get(h)
            if x is None:
                x = cache[h] = model.evidence(low[s[k] : e[k]].decode("utf-8", "surrogateescape"))
            m[i] = x
        c = np.concatenate([[0.0], np.cumsum(m[back])])
        top = np.zeros(len(first) - 1)
        for i in np.flatnonzero(np.diff(first)).tolist():
            d = c[first[i] : first[i + 1] + 1]
            top[i] = (d - np.minimum.accumulate(d)).max()
        yield part, top, np.diff(first)


def ratios(rows: list, nt: int, no: int) -> dict:
    """(key, t, o) to the logarithm of how much more often a key comes from toxic text."""
    return {k: math.log((t + 0.5) / (nt + 1)) - math.log((o + 0.5) / (no + 1)) for k, t, o in rows}


def fit(sample: DataFrame) -> Model:
    """Counts are made where the texts are; the driver gets typical pieces, frequent words and histograms."""
    vocabulary = written(counted(sample), "vocabulary")
    nt, no = (x or 0 for x in vocabulary.agg(F.sum("t"), F.sum("o")).head())
    toxic = typical(vocabulary, nt, no) if nt else {}
    top = vocabulary.filter("o > 0").orderBy(F.desc("o"), "word").limit(ORDINARY).select("word", "o").collect() if toxic else []
    plain = [(f" {w} ", o) for w, o in top if not any((f" {w} ").startswith(p) or (f" {w} ").endswith(p) for p in toxic)]
    model = Model(toxic, dict(plain[:FREQUENT]), dict(plain[FREQUENT:] or plain))
    if model.empty:
        forget(vocabulary)
        return model

    def lengths(batches):
        model.start()
        seen: dict[tuple, list[int]] = {}
        sums: dict[tuple, list[int]] = {}

        def measure():
            for k, (t, o) in seen.items():
                x = sums.setdefault(model.pair(*k), [0, 0])
                x[0] += t
                x[1] += o
            seen.clear()

        for b in batches:
            for w, t, o in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for k in model.windows(w):
                    x = seen.setdefault(k, [0, 0])
                    x[0] += t
                    x[1] += o
            if len(seen) > CACHE:
                measure()
        measure()
        yield pa.RecordBatch.from_pylist([{"k": list(k), "t": t, "o": o} for k, (t, o) in sums.items()], schema=pa.schema([("k", pa.list_(pa.int64())), ("t", pa.int64()), ("o", pa.int64())]))

    def words_(batches):
        model.start()
        sums: dict[int, list[int]] = {}
        for b in batches:
            for w, t, o in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = sums.setdefault(int(model.best(w) * 2), [0, 0])
                x[0] += t
                x[1] += o
        yield pa.RecordBatch.from_pylist([{"k": k, "t": t, "o": o} for k, (t, o) in sums.items()], schema=pa.schema([("k", pa.int64()), ("t", pa.int64()), ("o", pa.int64())]))

    v = vocabulary.select("word", "t", "o")
    summed = lambda f, kind: v.mapInArrow(f, f"k {kind}, t long, o long").groupBy("k").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    got = ratios([(tuple(r[0]), r[1], r[2]) for r in summed(lengths, "array<long>").filter(F.col("t") >= LEAST).collect()], nt, no)
    model.ratio = {k: x for k, x in got.items() if x > 0.7}
    model.steps = ratios([tuple(r) for r in summed(words_, "long").collect()], nt, no)
    forget(vocabulary)
    calibrate(model, sample)
    return model


def calibrate(model: Model, sample: DataFrame) -> None:
    """The logistic curve of labels over evidence and length, from a histogram of all rows of the sample."""

    def run(batches):
        table: dict[tuple, int] = {}
        for part, top, size in text_evidence(model, batches, "text"):
            for x, n, y in zip(np.round(np.minimum(top, 40) * 4).astype(int).tolist(), np.round(np.log1p(size) * 4).astype(int).tolist(), part.column("y").to_pylist(), strict=True):
                k = (x, n, int(y > 0))
                table[k] = table.get(k, 0) + 1
        rows = [(*k, v) for k, v in table.items()] or [(0, 0, 0, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["x", "n", "y", "times"])

    got = sample.select("text", "y").mapInArrow(run, "x long, n long, y long, times long").groupBy("x", "n", "y").agg(F.sum("times").alias("times")).collect()
    a = np.array([tuple(r) for r in sorted(got)], float)
    x, y, times = np.column_stack([np.ones(len(a)), a[:, 0] / 4, a[:, 1] / 4]), a[:, 2], a[:, 3]
    b = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (times * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-2, 1e-1])
        b = b + np.linalg.solve(h, x.T @ (times * (y - p)) - np.array([1e-3, 1e-2, 1e-1]) * b)
    model.curve = tuple(b.tolist())


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents (doc_id, text) to (doc_id, held_out, score, predicted, evidence)."""
    model = fit(labelled_sample(docs, labels, "toxic", 5, 0))

    def run(batches):
        if model.empty:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.zeros(b.num_rows)), pa.array(np.zeros(b.num_rows, np.int32)), pa.array(np.zeros(b.num_rows))], names)
            return
        for part, top, size in text_evidence(model, batches, "text"):
            s = model.score(np.minimum(top, 40), size)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(top)], names)

    names = ["doc_id", "held_out", "score", "predicted", "evidence"]
    return docs.select("doc_id", "text", held_out(F.col("doc_id"), 5, 0).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence double")


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
