"""Cross-tokenizer alignment: minimal groups of tokens of two tokenizers that cover the same bytes, and how often ids are linked.

Each text is encoded by a byte-level BPE (A) and by a piece BPE (B). The tokens are the two sides of a graph whose edges are overlaps
of byte ranges; union-find gives its connected components, which are the minimal groups: a cut lies exactly where tokens of both end.
The members of a component are linked, each of A with each of B. A pair's count is the number of documents that hold it linked.

Neither tokenizer joins what one space between two other characters parts (`Tokens` checks that of its files), so texts fall into
stretches at such spaces and every different stretch is encoded and grouped once for as long as a task remembers it. Pairs of a
document, with how often they occur, are written once; their counts come from a combining aggregate, and are looked up by every
document in slices of at most SLICE pairs, so what is broadcast is bounded whatever the corpus holds.

Defined results: texts that are null or empty, or whose tokens' bytes differ from space + text, have no tokens: zeros and an empty
`groups_sha256`. Rows count as documents by themselves, also where ids repeat or are null. Columns other than doc_id and text are
not returned, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import forget, merged, small_batches, text_slices, written

#: Parameters of the registered query.
FOLDER, FILE_A, FILE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Linked pairs, with their counts, that are broadcast at a time.
SLICE = 4_000_000
#: Stretches that a task remembers, their characters, and bytes of text that it treats at a time.
REMEMBERED, CHARACTERS, BATCH = 500_000, 1 << 24, 1 << 22
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Up to here both libraries' classes of characters surely agree.
PLAIN = re.compile("[\0-ɏ]*")
#: Fixed value: how byte-level BPE parts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "▁"


def byte_of() -> dict[str, int]:
    """Which byte a character of a byte-level vocabulary stands for: printable ones for themselves, the others numbered from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokens:
    """Both tokenizers, and the bytes of each id."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letter, vocab = byte_of(), self.a.get_vocab(with_added_tokens=False)
        ranks = {bytes(letter[c] for c in t): i for t, i in vocab.items() if all(c in letter for c in t)}
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for t, i in ranks.items():
            self.bytes_a[i] = t
        special = {str(t.content) for t in self.a.get_added_tokens_decoder().values()}
        ranks = {t: i for t, i in ranks.items() if t.decode("utf-8", "replace") not in special}
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.size_b = len(pieces)
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.long_a, self.long_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))

    def stretches(self, text: str) -> list[str]:
        return CUT.split(text) if self.apart else [text]

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        return [self.fast.encode_ordinary(" " + t) if PLAIN.fullmatch(t) else self.a.encode(" " + t, add_special_tokens=False).ids for t in texts]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)

    def code(self, a, b):
        """A pair of ids as one number."""
        return a * self.size_b + b

    def kind(self) -> str:
        return "int" if len(self.bytes_a) * self.size_b < 1 << 31 else "long"


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of n numbers for each."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def components(long_a: np.ndarray, long_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each token of A and of B, numbered in order, by union-find over the overlaps of tokens laid end to end.

    Both must cover the same bytes; no token is empty.
    """
    end_a, end_b = np.cumsum(long_a), np.cumsum(long_b)
    first = np.searchsorted(end_b, end_a - long_a, "right")
    last = np.searchsorted(end_b - long_b, end_a, "left")
    n = last - first
    i, j = np.repeat(np.arange(len(long_a)), n), spread(first, n) + len(long_a)
    root = merged(np.arange(len(long_a) + len(long_b)), i, j)
    # The smallest member of a component is its first token of A.
    return tuple(np.searchsorted(np.unique(root[: len(long_a)]), root[s]) for s in (slice(0, len(long_a)), slice(len(long_a), None)))


class Memory:
    """Aligned stretches of text, by number: the groups of each as text, its sizes, and where its linked pairs lie."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self.clear()

    def clear(self):
        self.number: dict[str, int] = {}
        self.groups: list[str | None] = []
        self.characters = 0
        self.sizes, self.pairs = np.zeros((0, 4), np.int64), np.zeros(0, np.int64)

    def learn(self, new: list[str]) -> None:
        t = self.tokens
        ids = [t.encode_a(new), t.encode_b(new)]
        n = [np.fromiter(map(len, x), np.int64, len(new)) for x in ids]
        flat = [np.fromiter(chain.from_iterable(x), np.int64, int(k.sum())) for x, k in zip(ids, n, strict=True)]
        raw = [(" " + s).encode() for s in new]
        length = np.fromiter(map(len, raw), np.int64, len(new))
        whole = b"".join(raw)
        good = np.ones(len(new), bool)
        for i, (names, long) in enumerate(((t.bytes_a, t.long_a), (t.bytes_b, t.long_b))):
            # Most often all bytes agree at once; else each stretch is looked at.
            if b"".join([names[x] for x in flat[i].tolist()]) != whole:
                good &= [b"".join([names[x] for x in one]) == r for one, r in zip(ids[i], raw, strict=True)]
            else:
                good &= np.add.reduceat(long[flat[i]], np.cumsum(n[i]) - n[i]) == length
        keep = [f[np.repeat(good, k)] for f, k in zip(flat, n, strict=True)]
        size = np.zeros((len(new), 4), np.int64)
        text: list[str | None] = [None] * len(new)
        if good.any():
            of_a, of_b = components(t.long_a[keep[0]], t.long_b[keep[1]])
            in_a, in_b = np.bincount(of_a), np.bincount(of_b)
            start_a, start_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
            at = np.flatnonzero(good)
            home = np.repeat(at, n[0][at])[start_a]  # stretch of each group
            left = np.repeat(keep[0], in_b[of_a])
            right = keep[1][spread(start_b[of_a], in_b[of_a])]
            self.pairs = np.concatenate([self.pairs, t.code(left, right)])
            size[:, 0], size[:, 1] = n[0] * good, n[1] * good
            size[:, 2], size[:, 3] = np.bincount(home, minlength=len(new)), np.bincount(home, in_a * in_b, len(new))
            a, b = (list(map(str, x.tolist())) for x in keep)
            shown = [
                f"{a[i]}|{b[j]}" if k == m == 1 else f"{','.join(a[i : i + k])}|{','.join(b[j : j + m])}"
                for i, k, j, m in zip(*(x.tolist() for x in (start_a, in_a, start_b, in_b)), strict=True)
            ]
            edge = np.searchsorted(home, np.arange(len(new) + 1)).tolist()
            for k in at.tolist():
                text[k] = ";".join(shown[edge[k] : edge[k + 1]])
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.groups += text
        self.characters += int(length.sum())
        self.sizes = np.concatenate([self.sizes, size])

    def align(self, texts: list[str | None]):
        """(n_a, n_b, n_groups, n_links of each text; digests; number of different pairs of each; those pairs; how often each is linked)."""
        cut = [self.tokens.stretches(x) if x else [] for x in texts]
        new = set(chain.from_iterable(cut)).difference(self.number)
        if len(self.number) + len(new) > REMEMBERED or self.characters > CHARACTERS:
            self.clear()
            new = set(chain.from_iterable(cut))
        if new:
            self.learn(list(new))
        rows = [[self.number[s] for s in c] for c in cut]
        digests = []
        for k, r in enumerate(rows):
            shown = [self.groups[i] for i in r]
            if None in shown:
                rows[k], shown = [], []
            digests.append(hashlib.sha256(";".join(shown).encode()).hexdigest() if shown else "")
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        held, often = np.unique(np.repeat(np.arange(len(rows)), n) * len(self.number) + np.fromiter(chain.from_iterable(rows), np.int64, int(n.sum())), return_counts=True)
        row, which = np.divmod(held, max(len(self.number), 1))
        out = np.zeros((len(texts), 4), np.int64)
        for j in range(4):
            out[:, j] = np.bincount(row, self.sizes[which, j] * often, len(texts))
        links = self.sizes[:, 3]
        pair = self.pairs[spread((np.cumsum(links) - links)[which], links[which])]
        row, often = np.repeat(row, links[which]), np.repeat(often, links[which])
        order = np.lexsort((pair, row))
        pair, row, often = pair[order], row[order], often[order]
        head = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])])) if len(pair) else np.zeros(0, np.int64)
        times = np.add.reduceat(often, head) if len(head) else often
        return out, digests, np.bincount(row[head], minlength=len(texts)), pair[head], times


def lists(n: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(values))


SIZES = ["n_a", "n_b", "n_groups", "n_links"]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): a row's linked pairs and how often each is linked."""
    kind = Tokens(path_a, path_b).kind()
    number = np.int32 if kind == "int" else np.int64

    def run(batches):
        memory = Memory(Tokens(path_a, path_b))
        for part, _, _ in text_slices(batches, "text", BATCH):
            size, digests, n, pairs, times = memory.align(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(size[:, i]) for i in range(4)), pa.array(digests, pa.string()), lists(n, pairs.astype(number)), lists(n, times)],
                ["doc_id", *SIZES, "groups_sha256", "pairs", "times"],
            )

    of = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {of}, {', '.join(f'{x} long' for x in SIZES)}, groups_sha256 string, pairs array<{kind}>, times array<long>")


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """(pair, count: documents that hold it linked, best: whether no pair of its A id has more)."""
    counts = written(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")), "pairs")
    a = F.floor(F.col("pair") / F.lit(size_b)).alias("a")
    # A row for each id of A's vocabulary at most.
    most = counts.groupBy(a).agg(F.max("count").alias("most"))
    return counts.withColumn("a", F.floor(F.col("pair") / F.lit(size_b))).join(F.broadcast(most), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def looked_up(rows: DataFrame, counts: DataFrame, keep: list[str]) -> DataFrame:
    """rows (keep, pairs, times) to (keep, n_best, count_sum) by the pairs of counts, which are broadcast; other pairs add nothing."""
    held = counts.orderBy("pair").toArrow()
    known = rows.sparkSession.sparkContext.broadcast(tuple(held.column(c).to_numpy() for c in ("pair", "count", "best")))
    kinds = [f.dataType.simpleString() for f in rows.select(*keep).schema]

    def run(batches):
        pair, count, best = known.value
        for b in batches:
            at, times = b.column(b.schema.get_field_index("pairs")), b.column(b.schema.get_field_index("times")).flatten().to_numpy(zero_copy_only=False)
            p = at.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), at.value_lengths().to_numpy(zero_copy_only=False))
            i = np.minimum(np.searchsorted(pair, p), len(pair) - 1) if len(pair) else np.zeros(len(p), np.int64)
            hit = np.flatnonzero(pair[i] == p) if len(pair) else np.zeros(0, np.int64)
            i, row, times = i[hit], row[hit], times[hit]
            sums = np.zeros((2, b.num_rows), np.int64)
            np.add.at(sums[0], row, times * best[i])
            np.add.at(sums[1], row, times * count[i])
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(sums[0]), pa.array(sums[1])], [*keep, "n_best", "count_sum"])

    return rows.select(*keep, "pairs", "times").mapInArrow(run, ", ".join(f"{c} {k}" for c, k in zip(keep, kinds, strict=True)) + ", n_best long, count_sum long")


def align(docs: DataFrame, path_a: str = f"{FOLDER}/{FILE_A}", path_b: str = f"{FOLDER}/{FILE_B}") -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    # Numbers of rows are written with them, so they stay what they are.
    rows = written(aligned(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = written(pair_counts(rows, Tokens(path_a, path_b).size_b), "counts")
    slices = -(-counts.count() // SLICE)
    keep = ["doc_id", *SIZES, "groups_sha256"]
    if slices <= 1:
        out = looked_up(rows, counts, keep)
    else:
        part = F.pmod(F.xxhash64("pair"), F.lit(slices))
        sums = None
        for i in range(slices):
            s = written(looked_up(rows, counts.filter(part == i), ["row"]), "sums")
            sums = s if sums is None else sums.union(s)
        sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        out = rows.select("row", *keep).join(sums, "row")
    forget(counts)
    return out.select("doc_id", *SIZES, "n_best", "count_sum", "groups_sha256")


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
