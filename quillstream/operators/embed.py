"""Embedding of texts with an encoder that the caller gives, indexes of embeddings, and retrievers over them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import search

# Names of the two models and how many texts each encodes at a time.
BATCH = {"minilm": 32, "bge": 4}
Encoder = Callable[[list[str]], list]


def normalized(v: Column) -> Column:
    """A vector of length 1 in double precision; null and zero vectors stay as they are."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def encode(d: DataFrame, encoder: Encoder, text: str = "text", batch: int = 32, name: str = "embedding") -> DataFrame:
    """d with `name`, the embedding of each text as an array of doubles of length 1.

    `encoder` takes at most `batch` texts and gives a vector for each; a null text is encoded as an empty one. It is called
    in Arrow batches, on executors, so a model is loaded at most once for a worker that reuses what its module holds.
    """
    d = d.drop(name)

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            out = []
            for i in range(0, len(texts), batch):
                got = encoder(texts[i : i + batch])
                if len(got) != len(texts[i : i + batch]):
                    raise ValueError("the encoder gave another number of vectors than of texts")
                for v in got:
                    x = np.asarray(v, float)
                    n = float(np.sqrt(x @ x))
                    out.append((x / n if n else x).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], [*b.schema.names, name])

    return d.mapInArrow(run, T.StructType(list(d.schema)).add(name, T.ArrayType(T.DoubleType())))


def hashed_words(size: int = 64) -> Encoder:
    """An encoder that needs no model: words counted by a hash."""

    def encoder(texts: list[str]) -> list:
        out = np.zeros((len(texts), size))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, zlib.crc32(w.encode()) % size] += 1
        return list(out)

    return encoder


def fingerprint(d: DataFrame, *columns: str) -> str:
    """A number for the rows of d, whatever their order: it changes when a row does."""
    r = d.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), *columns))).head()
    return f"{r[0]}-{(int(r[1] or 0) ^ int(r[2] or 0)) & (2**64 - 1):016x}"


def index(spark: SparkSession, folder: str, model: str, chunks: DataFrame, encoder: Encoder, key: str = "chunk_id", text: str = "page_content") -> DataFrame:
    """(key, embedding) of chunks by a model: as stored for just these chunks, or else built and stored.

    The folder of an index is named by the model and the chunks' fingerprint, so a changed corpus never meets an old index.
    """
    path = f"{folder.rstrip('/')}/model={model}/{fingerprint(chunks, key, text)}"
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    encode(chunks.select(key, text), encoder, text, BATCH.get(model, 32)).select(key, "embedding").write.parquet(path)
    return spark.read.parquet(path)


def _directed(v: str) -> Column:
    return F.exists(v, lambda x: x != 0)


class Retrievers:
    """Retrievers by mode: one model's, or the fusion of both. Scores are fused sums, as their SQL's are.

    A text whose embedding is zero has no direction: it finds nothing and is not found.
    `indexes` has a function for each model that gives its vectors (id, v); they are called once and kept until clear().
    """

    def __init__(self, indexes: dict[str, Callable[[], DataFrame]], encoders: dict[str, Encoder], k: int = search.SEARCH_K, fused: int = search.ENSEMBLE_K, weights: list[float] | None = None):
        self.indexes, self.encoders, self.k, self.fused = indexes, encoders, k, fused
        self.weights = weights or search.ENSEMBLE_WEIGHTS
        self.held: dict[str, DataFrame] = {}
        self.lists: dict[str, tuple[DataFrame, DataFrame]] = {}

    def clear(self) -> None:
        for d in self.held.values():
            d.unpersist()
        self.held, self.lists = {}, {}

    def _vectors(self, model: str) -> DataFrame:
        if model not in self.held:
            self.held[model] = self.indexes[model]().filter(_directed("v")).persist()
        return self.held[model]

    def _one(self, model: str) -> Callable[[DataFrame], DataFrame]:
        def find(questions: DataFrame) -> DataFrame:
            # The same list for the same questions, so that a plan that needs it twice can use one exchange.
            if model not in self.lists or self.lists[model][0] is not questions:
                q = encode(questions.select("qid", "question"), self.encoders[model], "question", BATCH.get(model, 32), "qv")
                got = search.top_k(q.select("qid", "qv").filter(_directed("qv")), self._vectors(model), self.k, fused=True, n=questions.count())
                self.lists[model] = questions, got
            return self.lists[model][1]

        return find

    def load(self, mode: str = "bge") -> Callable[[DataFrame], DataFrame]:
        """A function from questions (qid, question) to (qid, rank, id, score). Case and blanks around the mode don't count."""
        mode = mode.lower().strip()
        if mode == "ensemble":
            return lambda questions: search.fuse([self._one(m)(questions) for m in BATCH], self.weights, self.fused)
        if mode not in BATCH:
            raise ValueError(f"no such retriever: {mode}")
        return self._one(mode)
