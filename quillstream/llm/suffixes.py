"""Suffix-array deduplication of byte strings of at least LENGTH bytes across all documents.

Every byte that lies in a LENGTH-byte string which also starts earlier (smaller doc_id, or earlier in the same
document) is removed; strings are judged on the input.

How it is spread out. In each window of LENGTH bytes the smallest hash of its K-byte pieces is its anchor;
equal windows have equal anchors. Consecutive windows with one anchor are a run, a string of some 140 bytes.
1. Runs meet at their anchor's hash. A run equal to an earlier one is a repeat; if an anchor has different runs,
   their windows are unsettled. Each task first settles what it can by itself and sends one row for each different
   run, or a mark for an anchor it knows to be unsettled, so no anchor has more rows than two for each task.
2. The bytes of unsettled runs meet at their anchor's hash, where their windows are suffix-sorted: mergesort, each
   comparison finding the common extension by binary search over prefix polynomial hashes; neighbours with a common
   extension of LENGTH are compared byte by byte before they count as equal. All but the first of equal windows are repeats.
   The runs of an anchor with more than HOT of them are not brought together; their single windows meet at 128-bit
   fingerprints instead, of each of which a task sends one row.
3. The removed windows return to their texts.

Defined results: a null text is an empty one; texts shorter than LENGTH lose nothing; rows that repeat a doc_id
with the same text are one document (each row gets its result), with other texts they are separate documents
in order of the texts' SHA-256, of which there may be 2**32; a null doc_id stands before all others; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import binary_parts, small_batches, text_slices, written
from .textcore import BASE, mix, powers, prefix, span_hash

LENGTH, K = 100, 24
#: Longer texts are worked on in pieces that overlap by LENGTH - 1 bytes.
PIECE = 1 << 22
FLUSH = 500_000
#: Unsettled runs of an anchor beyond which they meet window by window, and windows sorted at a time.
HOT, WINDOWS = 4096, 600_000
#: A place is a text's number among those that share ids, and a byte in it; no text has 2**31 bytes.
PLACE = 31
POS = np.int64((1 << PLACE) - 1)
PLACE_BITS = np.uint64(24)
CANDIDATE, MARK, REPEAT, UNSETTLED = 0, 1, 2, 3


def anchor_runs(data: np.ndarray, off: np.ndarray, length: int = LENGTH, k: int = K):
    """Runs of all texts: (anchor hash, run hash, text number, first window, windows after the first)."""
    z = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), z, z, z
    w = length - k + 1
    p = prefix(data)
    at = np.arange(n - k + 1)
    h = mix(span_hash(p, at, at + k))
    m = (h >> PLACE_BITS << PLACE_BITS) | at.astype(np.uint64)
    s = 1
    while 2 * s <= w:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    m = np.minimum(m[: len(m) - (w - s)], m[w - s :]) if w > s else m
    size = np.diff(off)
    doc = np.repeat(np.arange(len(size)), np.maximum(size - length + 1, 0))
    per = np.maximum(size - length + 1, 0)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + off[:-1][doc]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), z, z, z
    a = (m[start] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(head[1:], len(start)) - 1
    first = start[head]
    more = start[last] - first
    run = mix(span_hash(p, first, first + more + length) ^ (more.astype(np.uint64) * BASE))
    return h[a[head]], run, doc[head], first - off[:-1][doc[head]], more


def pieces(data: np.ndarray, off: np.ndarray, length: int):
    """(bytes, offsets, byte of the text where they begin): texts longer than PIECE in overlapping pieces."""
    if len(off) > 2 or off[-1] <= PIECE:
        yield data, off, 0
        return
    for i in range(0, len(data) - length + 1, PIECE - length + 1):
        part = data[i : i + PIECE]
        yield part, np.array([0, len(part)]), i


def settle(h, c, d, p, n, marks):
    """One row for each different run: (row, whether its anchor is unsettled), and the rows that repeat an earlier run."""
    o = np.lexsort((p, d, c, h))
    h, c, d, p = h[o], c[o], d[o], p[o]
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new = new_h | np.concatenate([[True], c[1:] != c[:-1]])
    group = np.cumsum(new) - 1
    lead = np.flatnonzero(new)
    same = (d == d[lead][group]) & (p == p[lead][group])
    anchor = (np.cumsum(new_h) - 1)[lead]
    unsettled = (np.bincount(anchor) > 1)[anchor]
    if len(marks):
        unsettled |= np.isin(h[lead], marks)
    return o[lead], unsettled, o[~same]


SCHEMA = "h long, c long, d long, p long, nf long"


def rows(h, c, d, p, n, flag):
    cols = [np.asarray(x).astype(np.int64) if x.dtype != np.uint64 else x.view(np.int64) for x in (h, c, d, p)]
    return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(n * 4 + flag)], ["h", "c", "d", "p", "nf"])


def scan(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Runs of docs (d, t, text) that each task can't settle alone, and what it has settled."""

    def flush(held):
        h, c, d, p, n = (np.concatenate(x) for x in zip(*held, strict=True))
        lead, unsettled, repeats = settle(h, c, d, p, n, ())
        away = lambda i: mix(d[i].view(np.uint64))  # noqa: E731  what is settled needs no anchor, but an even spread
        i = lead[~unsettled]
        yield rows(h[i], c[i], d[i], p[i], n[i], CANDIDATE)
        i = lead[unsettled]
        u = np.unique(h[i])
        yield rows(u, u, np.zeros(len(u), np.int64), np.zeros(len(u), np.int64), np.zeros(len(u), np.int64), MARK)
        yield rows(away(i), h[i], d[i], p[i], n[i], UNSETTLED)
        yield rows(away(repeats), c[repeats], d[repeats], p[repeats], n[repeats], REPEAT)

    def run(batches):
        held, count = [], 0
        for part, data, off in text_slices(batches, "text"):
            d, t = part.column(0).to_numpy(), part.column(1).to_numpy()
            for piece, o, skip in pieces(data, off, length):
                h, c, doc, p, n = anchor_runs(piece, o, length, k)
                held.append((h, c, d[doc], p + skip + (t[doc] << PLACE), n))
                count += len(h)
            if count > FLUSH:
                yield from flush(held)
                held, count = [], 0
        if count:
            yield from flush(held)

    return docs.mapInArrow(run, SCHEMA)


def gathered(batches, names):
    got = list(batches)
    t = pa.Table.from_batches(got) if got else None
    return None if t is None or not t.num_rows else [t.column(x).to_numpy() for x in names]


def meet_at_anchors(batches):
    cols = gathered(batches, ["h", "c", "d", "p", "nf"])
    if cols is None:
        return
    h, c, d, p, nf = cols
    flag = nf & 3
    n = nf >> 2
    for f in (REPEAT, UNSETTLED):
        i = np.flatnonzero(flag == f)
        yield pa.RecordBatch.from_arrays([pa.array(d[i]), pa.array(p[i]), pa.array(n[i]), pa.array(flag[i]), pa.array(c[i])], ["d", "p", "n", "f", "h"])
    i = np.flatnonzero(flag == CANDIDATE)
    if len(i):
        lead, unsettled, repeats = settle(h[i], c[i], d[i], p[i], n[i], np.unique(h[flag == MARK]))
        for x, f in ((i[lead[unsettled]], UNSETTLED), (i[repeats], REPEAT)):
            yield pa.RecordBatch.from_arrays([pa.array(d[x]), pa.array(p[x]), pa.array(n[x]), pa.array(np.full(len(x), f)), pa.array(h[x])], ["d", "p", "n", "f", "h"])


class Suffixes:
    """Suffixes of one byte array that start at given places, each counted up to `length` bytes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.p = prefix(data)
        self.down = powers(len(data) + 1)[1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search over hashes of prefixes."""
        lo = np.zeros(len(a), np.int64)
        step = 1 << (self.length.bit_length() - 1)
        pa_, pb, da, db = self.p[a], self.p[b], self.down[a], self.down[b]
        while step:
            try_ = lo + step
            ok = try_ <= self.length
            e = np.where(ok, try_, 0)
            ok &= (self.p[a + e] - pa_) * da == (self.p[b + e] - pb) * db
            lo = np.where(ok, try_, lo)
            step >>= 1
        return lo

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffix at a stands before that at b; equal ones do not."""
        n = self.common(a, b)
        i = np.minimum(n, self.length - 1)
        return (n < self.length) & (self.data[a + i] < self.data[b + i])

    def order(self, at: np.ndarray) -> np.ndarray:
        """Mergesort of the suffixes: runs of doubling length, each element's place in its sibling run found by binary search."""
        key = np.zeros(len(at), np.uint64)
        for j in range(min(8, self.length)):
            key = key << np.uint64(8) | self.data[at + j].astype(np.uint64)
        o = np.argsort(key, kind="stable")
        at, key = at[o], key[o]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(cut, len(at)))
        group0, width = np.repeat(cut, size), np.repeat(size, size)
        within = np.arange(len(at)) - group0
        n, run = len(at), 1
        longest = int(size.max()) if n else 0
        while run < longest:
            act = np.flatnonzero(width > run)
            w, g, size_g = within[act], group0[act], width[act]
            pair = w // (2 * run) * (2 * run)
            right = (w - pair) >= run
            other = np.where(right, pair, pair + run)
            end = np.minimum(other + run, size_g)
            lo, hi = np.minimum(other, size_g), end.copy()
            lo0 = lo.copy()
            mine = at[act]
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) // 2
                x = at[g[open_] + mid]
                r = right[open_]
                a = np.where(r, mine[open_], x)
                b = np.where(r, x, mine[open_])
                lt = self.less(a, b)
                # From the left run: pass x if x < mine. From the right run: pass x unless mine < x.
                go = np.where(r, ~lt, lt)
                lo[open_] = np.where(go, mid + 1, lo[open_])
                hi[open_] = np.where(go, hi[open_], mid)
            place = pair + (w - pair - np.where(right, run, 0)) + (lo - lo0)
            out = at.copy()
            back = o.copy()
            out[g + place], back[g + place] = at[act], o[act]
            at, o = out, back
            run *= 2
        return o

    def classes(self, at: np.ndarray) -> np.ndarray:
        """A number for each place; equal for equal strings of `length` bytes, which are compared byte by byte."""
        if not len(at):
            return np.zeros(0, np.int64)
        o = self.order(at)
        a, b = at[o][:-1], at[o][1:]
        same = self.common(a, b) >= self.length
        for i in np.array_split(np.flatnonzero(same), max(1, len(a) // 20_000)):
            same[i] = (self.data[a[i][:, None] + np.arange(self.length)] == self.data[b[i][:, None] + np.arange(self.length)]).all(1)
        out = np.empty(len(at), np.int64)
        out[o] = np.concatenate([[0], np.cumsum(~same)])
        return out


def spread(first: np.ndarray, more: np.ndarray) -> np.ndarray:
    """first[i] .. first[i] + more[i], one after the other."""
    n = more + 1
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def intervals(d: np.ndarray, p: np.ndarray):
    """(d, p, n) of the runs of consecutive places."""
    o = np.lexsort((p, d))
    d, p = d[o], p[o]
    head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)])) if len(d) else np.zeros(0, np.int64)
    last = np.append(head[1:], len(d)) - 1
    return d[head], p[head], (p[last] - p[head]) if len(d) else head


def fingerprints(data: np.ndarray, p: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the strings at the places; the second mixes four bytes at a time."""
    two = np.zeros(len(at), np.uint64)
    for j in range(0, length, 4):
        word = np.zeros(len(at), np.uint64)
        for x in range(j, min(j + 4, length)):
            word = word << np.uint64(8) | data[at + x].astype(np.uint64)
        two = mix(two ^ word)
    return mix(span_hash(p, at, at + length)), two


RUNS = "h long, c long, d long, p long, nf long, bytes binary"


def unsettled_bytes(joined: DataFrame, length: int) -> DataFrame:
    """Unsettled runs (d, t, text, runs) with their bytes; those of hot anchors as single windows, by fingerprint."""

    def send(h, c, d, p, nf, raw=None):
        cols = [pa.array(np.asarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)) for x in (h, c, d, p, nf)]
        return pa.RecordBatch.from_arrays([*cols, pa.nulls(len(h), pa.binary()) if raw is None else raw], ["h", "c", "d", "p", "nf", "bytes"])

    def flush(held):
        one, two, d, p = (np.concatenate(x) for x in zip(*held, strict=True))
        o = np.lexsort((p, d, two, one))
        lead = np.concatenate([[True], (one[o][1:] != one[o][:-1]) | (two[o][1:] != two[o][:-1])])
        i = o[lead]
        yield send(one[i], two[i], d[i], p[i], np.full(len(i), CANDIDATE))
        first = i[np.cumsum(lead) - 1]
        j = o[(d[o] != d[first]) | (p[o] != p[first])]
        x, y, n = intervals(d[j], p[j])
        yield send(mix(x.view(np.uint64)), y, x, y, n * 4 + REPEAT)

    def run(batches):
        held, count = [], 0
        for part, data, off in text_slices(batches, "text"):
            d, t, lists = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(3)
            doc = np.repeat(np.arange(len(d)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            pos, more, h, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            place = pos & POS
            begin = off[:-1][doc] + place
            i = np.flatnonzero(~hot)
            if len(i):
                size = more[i] + length
                raw = data[spread(begin[i], size - 1)]
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield send(h[i], h[i], d[doc[i]], pos[i], more[i] * 4 + UNSETTLED, pa.Array.from_buffers(pa.binary(), len(i), [None, pa.py_buffer(ends), pa.py_buffer(raw)]))
            i = np.flatnonzero(hot)
            if len(i):
                # Bytes of the runs, one after the other, so that hashes reach over runs only.
                size = more[i] + length
                raw = data[spread(begin[i], size - 1)]
                at = spread(np.cumsum(size) - size, more[i])
                one, two = fingerprints(raw, prefix(raw), at, length)
                held.append((one, two, np.repeat(d[doc[i]], more[i] + 1), spread(pos[i], more[i])))
                count += len(at)
                if count > 2 * WINDOWS:
                    yield from flush(held)
                    held, count = [], 0
        if count:
            yield from flush(held)

    return joined.mapInArrow(run, RUNS)


def sort_runs(length: int):
    """Settles what meets in a partition: suffix-sorts the windows of whole anchors, some hundred thousand at a time."""

    def repeats(cls, d, p):
        o = np.lexsort((p, d, cls))
        new = np.concatenate([[True], cls[o][1:] != cls[o][:-1]])
        first = o[new][np.cumsum(new) - 1]
        j = o[(d[o] != d[first]) | (p[o] != p[first])]
        x, y, n = intervals(d[j], p[j])
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(n)], ["d", "p", "n"])

    def run(batches):
        got = list(batches)
        table = pa.Table.from_batches(got) if got else None
        if table is None or not table.num_rows:
            return
        h, c, d, p, nf = (table.column(x).to_numpy() for x in ("h", "c", "d", "p", "nf"))
        flag = nf & 3
        i = np.flatnonzero(flag == REPEAT)
        yield pa.RecordBatch.from_arrays([pa.array(d[i]), pa.array(p[i]), pa.array(nf[i] >> 2)], ["d", "p", "n"])
        i = np.flatnonzero(flag == CANDIDATE)
        if len(i):
            o = i[np.lexsort((c[i], h[i]))]
            cls = np.empty(len(h), np.int64)
            cls[o] = np.cumsum(np.concatenate([[True], (h[o][1:] != h[o][:-1]) | (c[o][1:] != c[o][:-1])]))
            yield repeats(cls[i], d[i], p[i])
        i = np.flatnonzero(flag == UNSETTLED)
        i = i[np.argsort(h[i], kind="stable")]
        more = nf[i] >> 2
        head = np.flatnonzero(np.concatenate([[True], h[i][1:] != h[i][:-1]])) if len(i) else i
        whole = np.add.reduceat(more + 1, head) if len(i) else i
        batch = np.cumsum(whole) // WINDOWS
        cuts = np.append(head[np.flatnonzero(np.concatenate([[True], batch[1:] != batch[:-1]]))] if len(i) else head, len(i))
        raw = table.column("bytes").combine_chunks()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows_ = i[a:b]
            data, off = binary_parts(raw.take(pa.array(rows_)))
            n = more[a:b]
            at = spread(off[:-1], n)
            yield repeats(Suffixes(data, length).classes(at), np.repeat(d[rows_], n + 1), spread(p[rows_], n))

    return run


def d_of() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def digest_of() -> Column:
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)


def numbered(docs: DataFrame) -> DataFrame | None:
    """(d, digest, t): a number for each different text of an id that several rows have, in order of (id, digest); None if there is no such id."""
    several = docs.select(d_of().alias("d")).groupBy("d").agg(F.count("*").alias("rows")).filter(F.col("rows") > 1).select("d")
    several = written(several, "several")
    if several.isEmpty():
        return None
    texts = docs.select(d_of().alias("d"), digest_of().alias("digest")).join(several, "d", "left_semi").distinct()
    texts = written(texts.repartitionByRange("d", "digest").sortWithinPartitions("d", "digest").withColumn("at", F.monotonically_increasing_id()), "numbered")
    texts = texts.withColumn("part", F.shiftright("at", 33))
    per = texts.groupBy("part").agg(F.count("*").alias("n"))
    if (per.agg(F.sum("n")).head()[0] or 0) >= 1 << 32:
        raise ValueError("over 2**32 texts share their ids with others")
    # A row for each partition.
    ahead = F.broadcast(per.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead")))
    return written(texts.join(ahead, "part").select("d", "digest", (F.col("ahead") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("t")), "numbered")


def keyed(docs: DataFrame, numbers: DataFrame | None) -> DataFrame:
    """(d, t, text, rest): d orders documents, t different texts of one doc_id, rest holds all columns but text."""
    text, rest = F.col("text").cast("string"), F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("rest")
    if numbers is None:
        return docs.select(d_of().alias("d"), F.lit(0).cast("long").alias("t"), F.coalesce(text, F.lit("")).alias("text"), rest)
    k = docs.select(d_of().alias("d"), digest_of().alias("digest"), F.coalesce(text, F.lit("")).alias("text"), rest)
    return k.join(numbers, ["d", "digest"], "left").select("d", F.coalesce("t", F.lit(0).cast("long")).alias("t"), "text", "rest")


def removed_windows(docs: DataFrame, numbers: DataFrame | None, length: int = LENGTH, k: int = K) -> DataFrame:
    """(d, t, list of (p, n)): first removed window and the number after it, for each document that loses any."""
    base = keyed(docs, numbers).select("d", "t", "text")
    met = scan(base, length, k).repartition("h").mapInArrow(meet_at_anchors, "d long, p long, n long, f long, h long")
    met = written(met, "runs")
    t = F.shiftright("p", PLACE).alias("t")
    open_ = met.filter(F.col("f") == UNSETTLED)
    hot = open_.groupBy("h").agg(F.count("*").alias("runs")).filter(F.col("runs") > HOT).select("h", F.lit(True).alias("hot"))
    open_ = open_.join(hot, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    lists = open_.groupBy("d", t).agg(F.collect_list(F.struct("p", "n", "h", "hot")).alias("runs"))
    # `rest` is there so that this exchange of the texts is the one that the removal uses again.
    joined = keyed(docs, numbers).join(lists, ["d", "t"]).select("d", "t", "text", "runs", "rest")
    late = unsettled_bytes(joined, length).repartition("h").mapInArrow(sort_runs(length), "d long, p long, n long")
    both = met.filter(F.col("f") == REPEAT).select("d", "p", "n").union(late)
    return both.groupBy("d", t).agg(F.collect_list(F.struct(F.col("p").bitwiseAND(int(POS)).alias("p"), "n")).alias("gone"))


def dedup(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """docs (doc_id, text) to a row for each row: all columns but text, spans: array of removed (start, end), kept: the remaining bytes, n_bytes.

    Columns of docs with these names are replaced.
    """
    docs = docs.drop("spans", "kept", "n_bytes")

    def run(batches):
        for part, data, off in text_slices(batches, "text"):
            gone, n = part.column(1), part.num_rows
            doc = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(gone), 0).to_numpy())
            flat = gone.flatten()
            p, more = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            size = np.diff(off)
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, off[:-1][doc] + p, 1)
            np.add.at(edge, off[:-1][doc] + np.minimum(size[doc], p + more + length), -1)
            cut = np.cumsum(edge)[:-1] > 0
            begin, stop = cut.copy(), cut.copy()
            begin[1:] &= ~cut[:-1]
            stop[:-1] &= ~cut[1:]
            inner = off[(off > 0) & (off < len(data))]
            begin[inner], stop[inner - 1] = cut[inner], cut[inner - 1]
            s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
            at = np.searchsorted(off, s, "right") - 1
            number = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))]).astype(np.int32)
            base = off[:-1][at]
            spans = pa.ListArray.from_arrays(pa.array(number), pa.StructArray.from_arrays([pa.array(s - base), pa.array(e - base)], ["start", "end"]))
            left = np.concatenate([[0], np.cumsum(~cut)])[off].astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(left), pa.py_buffer(data[~cut])])
            yield pa.RecordBatch.from_arrays([part.column(2), spans, kept, pa.array(size)], ["rest", "spans", "kept", "n_bytes"])

    numbers = numbered(docs)
    both = keyed(docs, numbers).join(removed_windows(docs, numbers, length, k), ["d", "t"], "left").select("text", "gone", "rest")
    schema = T.StructType([both.schema["rest"]]).add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))).add("kept", "binary").add("n_bytes", "long")
    return both.mapInArrow(run, schema).select("rest.*", "spans", "kept", "n_bytes")


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    d = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return d.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
