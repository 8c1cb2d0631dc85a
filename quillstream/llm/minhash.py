"""Near duplicates by Order MinHash, verified by banded alignment.

A text's k-mers are its shingles of SHINGLE words, each labelled with its occurrence number. For each of SKETCHES
random orders the KEPT smallest k-mers are kept in text order and hashed: two texts agree in a sketch if the same
k-mers are smallest and stand in the same order. Two texts that share a bucket link if their words, aligned in a band,
are alike in a share LEAST: twice the words that match, in order, by the words of both. The words the texts have in common in
any order bound that share from above, so pairs below it are not aligned; nothing else stands between a shared bucket and a link.

Equal texts are one class from the start. In a bucket of at most SMALL classes all are compared; in a larger one
each is compared with the most central class (that with the largest buckets) first. Larger buckets whose classes these
links don't connect are then compared in blocks of BLOCK, all pairs but those that are connected by then; what comes out
are the links that connect, not the pairs. Connected links make a group; its id is its smallest doc_id.

Changing a share x of the words leaves a share s = (1 - x)**5 of the shingles; with J = s / (2 - s) a pair shares no sketch with
probability (1 - J**2)**SKETCHES: below 1e-6 for 5 % of the words, 0.02 for 10 %, 0.13 for 15 %.

Defined results: null, empty and wordless texts are groups of their own by equal text and link with no other; texts
of fewer than SHINGLE words are one shingle; rows that share a doc_id count as one document; a row with a null doc_id takes part under
a number made of its text, beyond all ids (key), and is named null; ids from UNNAMED on are numbered in their order for that; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, forget, let_go, small_batches, text_slices, written
from .textcore import BASE, mix, shingles, words

SHINGLE, LEAST = 5, 0.8
SKETCHES, KEPT = 24, 2
SMALL = 8
#: Classes of a large bucket are compared with each other in blocks of about so many.
BLOCK = 256
#: A text's pairs are dealt out to as many tasks as there are this many of them.
DEAL = 200
#: Texts of at most so many words have their words' places kept while they are aligned (a bit a word for each word).
KNOWN = 20_000
#: Rows without an id have numbers from here on.
UNNAMED = 1 << 62


def labelled(w: np.ndarray) -> np.ndarray:
    """Hashes of the shingles in text order, with their occurrence numbers; one for texts shorter than a shingle."""
    if not len(w):
        return w
    s = shingles(w, min(SHINGLE, len(w)))
    o = np.argsort(s, kind="stable")
    t = s[o]
    head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    number = np.empty(len(s), np.uint64)
    number[o] = np.arange(len(s)) - np.repeat(head, np.diff(np.append(head, len(s))))
    return mix(s + number * BASE)


ORDERS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * BASE)[:, None]


def sketches(x: np.ndarray) -> np.ndarray:
    """The Order MinHash sketches of labelled shingles, one 64-bit number for each random order."""
    n = len(x)
    out = np.zeros(SKETCHES, np.uint64)
    for i in range(0, SKETCHES, max(1, (1 << 22) // max(n, 1))):
        r = ORDERS[i : i + max(1, (1 << 22) // max(n, 1))]
        y = (x[None, :] ^ r) * (r | np.uint64(1))
        y ^= y >> np.uint64(29)
        keep = np.argpartition(y, KEPT - 1, axis=1)[:, :KEPT] if n > KEPT else np.tile(np.arange(n), (len(r), 1))
        keep = np.sort(keep, axis=1)
        h = r[:, 0].copy()
        for j in range(keep.shape[1]):
            h = mix(h * BASE + x[keep[:, j]])
        out[i : i + len(r)] = h
    return out


def distance_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """How many insertions and deletions, `most` at most, turn a into b: None if more are needed.

    A whole row of the alignment is one integer, a bit for each word of a; a row follows from the one before by a few operations on all its bits.
    Only places in the band count, at most `most` from the diagonal: no alignment of that distance leaves it.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    words_, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.argsort(at[:n], kind="stable")
    cut = np.searchsorted(at[:n][order], np.arange(len(words_) + 1)).tolist()
    order = order.tolist()
    places: dict[int, int] = {}
    full, wide = (1 << n) - 1, 2 * most + 1
    band = (1 << wide) - 1
    row = full
    for j, w in enumerate(at[n:].tolist()):
        if cut[w] == cut[w + 1]:
            continue
        have = places.get(w)
        if have is None:
            have = 0
            if cut[w + 1] - cut[w] < 64:
                for i in order[cut[w] : cut[w + 1]]:
                    have |= 1 << i
            else:
                bits = np.zeros(n + 7 & -8, np.uint8)
                bits[order[cut[w] : cut[w + 1]]] = 1
                have = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if n <= KNOWN:
                places[w] = have
        shift = j - most
        if wide < n:
            have &= band << shift if shift > 0 else band >> -shift
        u = row & have
        row = (row + u | row - u) & full
    d = n + m - 2 * (n - row.bit_count())
    return d if d <= most else None


def alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many words a and b have in common, in any order."""
    u, n = np.unique(a, return_counts=True)
    v, m = np.unique(b, return_counts=True)
    _, x, y = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    return int(np.minimum(n[x], m[y]).sum())


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether two texts, given as word hashes, link."""
    both = len(a) + len(b)
    most = int((1 - least) * both + 1e-9)
    if not len(a) or not len(b) or abs(len(a) - len(b)) > most or 2 * alike(a, b) < both - most:
        return False
    return distance_within(a, b, most) is not None


def key_of(doc_id, text):
    """Column of a row's number: its doc_id, or one made of its text."""
    return F.coalesce(doc_id.cast("long"), F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).bitwiseAND(UNNAMED - 1) + F.lit(UNNAMED))


def sketched(docs: DataFrame) -> DataFrame:
    """docs to (id, same: digest of the text, sk: sketches, empty for wordless texts)."""
    d = docs.select(key_of(F.col("doc_id"), F.col("text")).alias("id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("same"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for part, data, off in text_slices(batches, "text"):
            w, _, _, first = words(data, off)
            sk = [sketches(labelled(w[first[i] : first[i + 1]])).view(np.int64) if first[i + 1] > first[i] else () for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sk, pa.list_(pa.int64()))], ["id", "same", "sk"])

    return d.mapInArrow(run, "id long, same string, sk array<long>")


def bucketed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, id) to candidate pairs (a, b) with a < b, with the central class alone in large buckets, and the rows of these."""
    size = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    r = written(rows.join(size, "key"), "buckets")
    central = r.groupBy("id").agg(F.sum("size").alias("c"))
    large = r.filter(F.col("size") > SMALL)
    lead = large.join(central, "id").groupBy("key").agg(F.max_by("id", F.struct("c", -F.col("id"))).alias("lead"))
    star = large.join(lead, "key").filter("id <> lead").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
    few = r.filter(F.col("size") <= SMALL).select("key", "id")
    pairs = few.withColumnRenamed("id", "a").join(few.withColumnRenamed("id", "b"), "key").filter("a < b").select("a", "b")
    return pairs.union(star).distinct(), large.select("key", "id")


def unsettled(large: DataFrame, root: DataFrame) -> DataFrame:
    """Rows (key, id) of large buckets to rows (group, side, id, root) of those not within one component (id, root).

    Buckets of the same classes count once. A bucket of k blocks makes groups of one and of two blocks; in the latter
    rows of side 1 are compared with those of side 2, in the former all.
    """
    r = large.join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
    per = r.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    per = per.filter("lo <> hi").groupBy("size", "x", "y").agg(F.min("key").alias("key"))
    r = r.join(per.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("k")), "key").withColumn("b", F.pmod(F.xxhash64("id", "key"), F.col("k")).cast("int"))
    r = r.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    side = F.when(F.col("o") == F.col("b"), 0).when(F.col("b") < F.col("o"), 1).otherwise(2)
    return r.select(F.xxhash64("key", F.least("b", "o"), F.greatest("b", "o")).alias("group"), side.alias("side"), "id", "root")


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, col = row[times[col] > 1], np.unique(col[times[col] > 1], return_inverse=True)[1]
    o = np.argsort(col, kind="stable")
    row, col = row[o], col[o]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(col.max()) + 1 if len(col) else 0, 4096):
        a, b = np.searchsorted(col, [lo, lo + 4096])
        x = np.zeros((len(sets), 4096), np.float32)
        x[row[a:b], col[a:b] - lo] = 1
        out += x @ x.T
    return out.astype(np.int64)


def occurrences(w: np.ndarray) -> np.ndarray:
    """Words labelled with their occurrence numbers, so that sets of them meet in as many words as texts have in common."""
    o = np.argsort(w, kind="stable")
    t = w[o]
    head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    return mix(t + (np.arange(len(t)) - np.repeat(head, np.diff(np.append(head, len(t))))).astype(np.uint64) * BASE)


def connecting(group: pa.Table) -> pa.RecordBatch:
    """Links (a, b) of one group that connect what isn't yet."""
    ids, side = group.column("id").to_numpy(), group.column("side").to_numpy()
    root = np.unique(group.column("root").to_numpy(), return_inverse=True)[1]
    out = []
    if root.any():
        ws = [hashed(t) for t in group.column("text").cast(pa.binary()).to_pylist()]
        n, both = np.array([len(w) for w in ws]), common([occurrences(w) for w in ws])
        total = n[:, None] + n[None]
        near = (2 * both >= total - ((1 - LEAST) * total + 1e-9).astype(np.int64)) & (root[:, None] != root[None])
        near &= (side[:, None] == 0) | (side[:, None] != side[None])
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))), strict=True):
            if root[i] != root[j] and similar(ws[i], ws[j]):
                root[root == root[j]] = root[i]
                out.append((ids[i], ids[j]))
    return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], ["a", "b"])


def dealt(rows: DataFrame, column: str, other: str, docs: DataFrame, text: str) -> DataFrame:
    """Rows with the text of the id in `column`; an id with many rows has a copy of its text for each DEAL of them.

    The join is a shuffled hash join of the texts by (id, part), so no id's rows meet in one task.
    """
    n = rows.groupBy(F.col(column).alias("id")).agg(F.ceil(F.count("*") / DEAL).cast("int").alias("k"))
    named = docs.select(key_of(F.col("doc_id"), F.col("text")).alias("id"), F.col("text").cast("string").alias(text)).join(n.hint("shuffle_hash"), "id")
    named = named.select("id", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"), text)
    r = rows.join(n.withColumnRenamed("id", column), column).withColumn("part", F.pmod(F.xxhash64(other), F.col("k")).cast("int")).drop("k")
    return r.join(named.withColumnRenamed("id", column), [column, "part"]).drop("part")


def compared(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (group, side, id, root) to the links (a, b) that connect different roots of a group."""

    def run(batches):
        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            g = held.column("group").to_numpy()
            cut = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist()]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                yield connecting(held.slice(lo, hi - lo))
            held = held.slice(cut[-1])
        if held is not None and held.num_rows:
            yield connecting(held)

    return dealt(rows, "id", "group", docs, "text").select("group", "side", "id", "root", "text").repartition("group").sortWithinPartitions("group", "id").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids to those that link."""
    j = dealt(dealt(pairs, "a", "b", docs, "ta"), "b", "a", docs, "tb").select("a", "b", "ta", "tb")

    def run(batches):
        last = (None, None)
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                a_, b_ = [], []
                for x, y, s, t in zip(*(part.column(c).to_pylist() if c < 2 else part.column(c).cast(pa.binary()).to_pylist() for c in range(4)), strict=True):
                    if last[0] != t:
                        last = (t, hashed(t))
                    if similar(hashed(s), last[1]):
                        a_.append(x)
                        b_.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(a_, pa.int64()), pa.array(b_, pa.int64())], ["a", "b"])

    return j.mapInArrow(run, "a long, b long").distinct()


def hashed(text: bytes) -> np.ndarray:
    data = np.frombuffer(text or b"", np.uint8)
    return words(data, np.array([0, len(data)]))[0]


def classes(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to (doc_id, class_id, kept, key): one row for each row; kept where the row's number is its class's smallest."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    top = docs.agg(F.max("doc_id")).head()[0]
    if top is None or top < UNNAMED:
        return numbered_classes(docs)
    # Ids that reach into the numbers of unnamed rows are numbered anew, in their order: a number names its partition of the order and its place there.
    ids = docs.select(F.col("doc_id").alias("name")).filter("name is not null").distinct()
    ids = written(ids.repartitionByRange("name").sortWithinPartitions("name").withColumn("n", F.monotonically_increasing_id()), "names")
    inner = docs.join(ids, docs["doc_id"] == ids["name"], "left").select(F.col("n").alias("doc_id"), "text")
    res = numbered_classes(inner)
    own, lead = ids.select(F.col("n").alias("doc_id"), F.col("name").alias("own")), ids.select(F.col("n").alias("class_id"), F.col("name").alias("lead"))
    res = res.join(own, "doc_id", "left").join(lead, "class_id", "left")
    return res.select(F.col("own").alias("doc_id"), F.col("lead").alias("class_id"), "kept", F.coalesce("own", "key").alias("key"))


def numbered_classes(docs: DataFrame) -> DataFrame:
    """classes() of ids below UNNAMED."""
    all_ = written(sketched(docs), "sketches")
    same = written(all_.groupBy("same").agg(F.min("id").alias("id"), F.first("sk").alias("sk")), "texts")
    live = same.filter(F.size("sk") > 0)
    rows = live.select("id", F.posexplode("sk").alias("i", "v")).select(F.xxhash64("i", "v").alias("key"), "id").distinct()
    pairs, large = bucketed(rows)
    spark = docs.sparkSession
    pairs = written(pairs, "pairs")
    links = written(verified(pairs, docs), "links")
    # Tables that are done with, and the shuffles of texts behind them, make room for what follows.
    forget(pairs)
    let_go(spark)
    first = components(links, "linked")
    forget(links)
    apart = written(unsettled(large, first), "unsettled")
    more = written(compared(apart, docs), "links")
    forget(apart)
    let_go(spark)
    links = first.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more)
    # Rows with equal texts belong together too, and so do texts that share a doc_id.
    equal = all_.join(same.select("same", F.col("id").alias("rep")), "same").select("id", "rep").distinct()
    root = components(links.union(equal.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))), "groups")
    out = equal.join(root, "id", "left").groupBy("id").agg(F.min(F.coalesce("root", "rep")).alias("class"))
    named = lambda c: F.when(F.col(c) < UNNAMED, F.col(c))
    res = docs.select(key_of(F.col("doc_id"), F.col("text")).alias("id")).join(out, "id")
    return res.select(named("id").alias("doc_id"), named("class").alias("class_id"), (F.col("id") == F.col("class")).alias("kept"), F.col("id").alias("key"))


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("key")
