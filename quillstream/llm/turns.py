"""Conversation structure repair: the cheapest edits that give roles in the order ``(s?(ua)+)?``, by a min-plus matrix scan.

The order of roles is an automaton of 4 states (START, after system, after user, after assistant). Each turn becomes a 4x4 matrix whose
entry (i, j) is the cheapest way from i to j by that turn's edit after any insertions (the closure of inserting). Entries are (cost,
audit); sums take the cheaper, then the ASCII-least audit. The audits of a row of a matrix end with the same turn's edit, so none
begins another, and which is least is settled by their order alone: an entry carries its cost and its audit's rank within the row, of
constant size however many turns it spans. Products are associative, so turns are reduced by a tree; on the way down each product
tells the state between its halves, and at the leaves the audit is read off.

Turns are dealt out by range of (conversation, turn), so a conversation of any length spreads over partitions. Those that lie within one
are reduced there, many at once. Those that reach over a border or are longer than HELD turns are cut into segments of SEGMENT turns; the
segments' products meet by partition, then by conversation, and the states found go back to the segments. Equal rows are counted
before they are dealt out. Only the digest of a long conversation passes through one task, as a stream of pieces.

Defined results: null role or text counts as one space, a role without a character as a space; of a conversation's rows with equal turn (nulls first)
those with the smaller role, then text, come first; rows without a conversation id are one conversation; other columns are ignored.
A span of turns beyond 64 bits has gaps null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, written

#: Turns and characters of a conversation that are held at once, turns of a segment (a power of two), turns that are reduced at once.
HELD, CHARACTERS, SEGMENT_BITS, TOGETHER = 2048, 1 << 23, 8, 20_000
#: Fixed values of the contract.
REROLE, DELETE, INSERT, OPEN = 3, 4, 3, 3
ROLES = {"s": "system", "u": "user", "a": "assistant"}
INITIALS = "sua"
GAP = r"\x20\x09-\x0D"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
LEGAL = {(0, 1), (1, 2), (2, 1)}
FAR = 1 << 40


def added(state: int) -> tuple[str, int]:
    """(initial, next state) of the one turn that can be inserted after a state."""
    c = "a" if state == 2 else "u"
    return c, NEXT[state, c]


#: What is inserted at the end, by state.
TAIL = ["", "II", "I", ""]


def leaves() -> tuple[np.ndarray, np.ndarray, list]:
    """(cost, rank, edits) of a turn's matrix by its kind: 4 * (place of its initial in INITIALS, else 3) + 2 * (must go) + (open)."""
    cost, rank = np.full((16, 4, 4), FAR), np.zeros((16, 4, 4), np.int64)
    edits = [[[""] * 4 for _ in range(4)] for _ in range(16)]
    for kind in range(16):
        c, must, more = (INITIALS + "-")[kind // 4], kind & 2, OPEN * (kind & 1)
        for i in range(4):
            best: dict[int, tuple[int, str]] = {}
            state, before, paid = i, "", 0
            for _ in range(4):
                ways = [(state, DELETE, "D")]
                if not must:
                    ways += [(NEXT[state, x], (0 if e == "K" else REROLE) + more, e) for x, e in ((c, "K"), ("u", "R"), ("a", "R")) if (state, x) in NEXT]
                for j, price, e in ways:
                    best[j] = min(best.get(j, (FAR, "")), (paid + price, before + e))
                state, before, paid = added(state)[1], before + "I", paid + INSERT
            for j, (price, e) in best.items():
                cost[kind, i, j], edits[kind][i][j] = price, e
            for n, j in enumerate(sorted(range(4), key=lambda j: (j not in best, edits[kind][i][j]))):
                rank[kind, i, j] = n
    return cost, rank, edits


COST, RANK, EDITS = leaves()


def product(a, b):
    """(cost, rank, state between) of many pairs of matrices."""
    key = (a[0][:, :, :, None] + b[0][:, None, :, :]) * 4 + a[1][:, :, :, None]
    mid = key.argmin(2)
    cost = np.minimum(np.take_along_axis(key, mid[:, :, None, :], 2)[:, :, 0, :] >> 2, FAR)
    n, i, j = np.ogrid[: len(mid), :4, :4]
    order = a[1][n, i, mid] * 4 + b[1][n, mid, j] + np.where(cost < FAR, 0, 16)
    return cost, order.argsort(2).argsort(2), mid


class Tree:
    """Products of runs of matrices, all runs at once, and the states along each run's cheapest way."""

    def __init__(self, cost: np.ndarray, rank: np.ndarray, lengths: np.ndarray):
        self.levels = []
        n = np.asarray(lengths)
        while (n > 1).any():
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            left = np.flatnonzero(place % 2 == 0)
            both = np.flatnonzero((place + 1 < np.repeat(n, n))[left])
            new_cost, new_rank = cost[left], rank[left]
            new_cost[both], new_rank[both], mid = product((cost[left[both]], rank[left[both]]), (cost[left[both] + 1], rank[left[both] + 1]))
            self.levels.append((len(cost), left, both, mid))
            cost, rank, n = new_cost, new_rank, (n + 1) // 2
        self.cost, self.rank = cost, rank

    def exits(self) -> tuple[np.ndarray, np.ndarray]:
        """(cost, exit state) of each run that begins at START and can be completed, insertions at the end included."""
        tail = np.array([INSERT * len(t) for t in TAIL])
        key = (self.cost[:, 0] + tail) * 4 + self.rank[:, 0]
        end = key.argmin(1)
        return np.take_along_axis(key, end[:, None], 1)[:, 0] >> 2, end

    def ways(self, entry: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, exit) of every matrix, given those of each run; further axes are other ways of the same runs."""
        for size, left, both, mid in reversed(self.levels):
            i, j = np.zeros((size, *entry.shape[1:]), np.int64), np.zeros((size, *entry.shape[1:]), np.int64)
            i[left], j[left] = entry, end
            rows = np.arange(len(both)).reshape(-1, *[1] * (entry.ndim - 1))
            m = mid[rows, entry[both], end[both]]
            j[left[both]] = m
            i[left[both] + 1], j[left[both] + 1] = m, end[both]
            entry, end = i, j
        return entry, end


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: (conv_id, turn, role, text, n), n the number of copies, 0 for a dropped row."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    d = rows.select("conv_id", "turn", "role", "text", h.alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return d.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("h") == 0, 0).when(F.col("h") == 3, 2).otherwise(1).alias("n"))


def kinds(code: np.ndarray, must: np.ndarray, open_: np.ndarray) -> np.ndarray:
    return code * 4 + np.where(must, 2, open_ & ~must)


def illegal(code: np.ndarray) -> np.ndarray:
    """Whether each turn but the first can't follow the one before it."""
    ok = np.zeros((4, 4), bool)
    for p in LEGAL:
        ok[p] = True
    return ~ok[code[:-1], code[1:]]


def edited(kind: int, entry: int, end: int, role: str, text: str) -> tuple[str, list[tuple[str, str]]]:
    """(edits of one turn, turns that it becomes)."""
    edits, out = EDITS[kind][entry][end], []
    for e in edits:
        if e == "I":
            c, entry = added(entry)
            out.append((ROLES[c], ""))
        elif e == "K":
            out.append((role, text))
        elif e == "R":
            out.append((ROLES["a" if end == 3 else "u"], text))
    return edits, out


def ending(state: int) -> list[tuple[str, str]]:
    """Turns inserted at the end."""
    out = []
    for _ in TAIL[state]:
        c, state = added(state)
        out.append((ROLES[c], ""))
    return out


def shown(lines) -> bytes:
    return "\n".join(f"{r}:{t}" for r, t in lines).encode()


def gaps(turns: list) -> int | None:
    known = sorted({t for t in turns if t is not None})
    n = known[-1] - known[0] + 1 - len(known) if known else 0
    return n if n < 1 << 63 else None


FIELDS = ["conv", "turn", "role", "text", "n", "code", "blank", "open", "at"]
SUMS = ["blank", "duplicate", "truncated", "illegal"]
LINES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, turns array<struct<role: string, text: string>>"


def whole(convs: list[list[tuple]], keep: bool) -> list[tuple]:
    """Results of conversations that are at hand as a whole: rows in the order of FIELDS, each conversation's in its order."""
    flat = [(c, r) for c, rows in enumerate(convs) for r in rows if r[4]]
    first, seen, last = [], set(), None
    for c, r in flat:
        if c != last:
            seen, last = set(), c
        first.append((r[2], r[3]) not in seen)
        seen.add((r[2], r[3]))
    n = np.array([r[4] for _, r in flat], np.int64)
    take = np.repeat(np.arange(len(flat)), n)
    copy = np.arange(len(take)) - np.repeat(np.cumsum(n) - n, n)
    blank, again = np.array([r[6] for _, r in flat], bool)[take], ~np.array(first, bool)[take] | (copy > 0)
    open_, code = np.array([r[7] for _, r in flat], bool)[take], np.array([r[5] for _, r in flat], np.int64)[take]
    home = np.array([c for c, _ in flat], np.int64)[take]
    again &= ~blank
    kind = kinds(code, blank | again, open_)
    lengths = np.bincount(home, minlength=len(convs))
    some = np.flatnonzero(lengths)
    tree = Tree(COST[kind], RANK[kind], lengths[some])
    cost, end = tree.exits() if len(some) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    entry, leave = tree.ways(np.zeros(len(some), np.int64), end)
    per = {"blank": blank, "duplicate": again, "truncated": open_ & ~blank & ~again}
    per = {k: np.bincount(home, v, len(convs)).astype(int).tolist() for k, v in per.items()}
    wrong = np.bincount(home[1:], illegal(code) & (home[1:] == home[:-1]), len(convs)).astype(int).tolist()
    out, at = [], 0
    total = dict(zip(some.tolist(), zip(cost.tolist(), end.tolist(), strict=True), strict=True))
    kind, entry, leave, take = kind.tolist(), entry.tolist(), leave.tolist(), take.tolist()
    for c, rows in enumerate(convs):
        price, state = total.get(c, (0, 0))
        audit, lines = [], []
        for k in range(at, at + int(lengths[c])):
            r = flat[take[k]][1]
            e, more = edited(kind[k], entry[k], leave[k], r[2], r[3])
            audit.append(e)
            lines += more
        at += int(lengths[c])
        lines += ending(state)
        out.append((rows[0][0], gaps([r[1] for r in rows if r[4]]), per["blank"][c], per["duplicate"][c], per["truncated"][c], wrong[c], price, "".join(audit) + TAIL[state], hashlib.sha256(shown(lines)).hexdigest(), [{"role": x, "text": y} for x, y in lines] if keep else None))
    return out


def by_partition(keep: bool):
    """Rows in order to results of conversations that lie within the partition, and the rows of the others as they are."""
    held_schema = pa.schema([("conv", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("code", pa.int32()), ("blank", pa.bool_()), ("open", pa.bool_()), ("at", pa.int64())])
    result = pa.schema([("gaps", pa.int64()), *((x, pa.int64()) for x in ("blanks", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("turns", LINES)])
    names = [*held_schema.names, *result.names]

    def rest(rows):
        cols = list(zip(*rows, strict=True))
        arrays = [pa.array(c, f.type) for c, f in zip(cols, held_schema, strict=True)] + [pa.nulls(len(rows), f.type) for f in result]
        return pa.RecordBatch.from_arrays(arrays, names)

    def done(convs):
        got = list(zip(*whole(convs, keep), strict=True))
        n = len(convs)
        arrays = [pa.array(got[0], pa.string()), *(pa.nulls(n, f.type) for f in list(held_schema)[1:]), *(pa.array(c, f.type) for c, f in zip(got[1:], result, strict=True))]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches):
        now, rows, size, long_, border = None, [], 0, False, True
        ready, waiting = [], 0
        for b in batches:
            for r in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in FIELDS), strict=True):
                if r[0] != now:
                    if now is not None and (border or long_):
                        if rows:
                            yield rest(rows)
                        border = False
                    elif now is not None:
                        ready.append(rows)
                        waiting += size
                        if waiting > TOGETHER:
                            yield done(ready)
                            ready, waiting = [], 0
                    now, rows, size, characters, long_ = r[0], [], 0, 0, False
                rows.append(r)
                size += max(r[4], 1)
                characters += len(r[3])
                if size > HELD or characters > CHARACTERS:
                    yield rest(rows)
                    rows, size, characters, long_ = [], 0, 0, True
        if rows:
            yield rest(rows)
        if ready:
            yield done(ready)

    schema = "conv string, turn long, role string, text string, n long, code int, blank boolean, open boolean, at long, "
    return run, schema + RESULT.replace("blank long", "blanks long", 1)


def dealt_out(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, n) in order over partitions, equal ones counted, with what each needs to be judged (FIELDS)."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    conv = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    gone = F.col("n") == 0
    d = rows.select(
        conv.alias("conv"),
        F.when(~gone, F.col("turn")).cast("long").alias("turn"),
        F.when(gone, " ").otherwise(F.when(F.col("role") == "", " ").otherwise(space("role"))).alias("role"),
        F.when(gone, " ").otherwise(space("text")).alias("text"),
        F.col("n").cast("long").alias("n"),
    )
    d = d.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    code = F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1
    d = d.withColumn("code", F.when(code < 0, 3).otherwise(code).cast("int"))
    d = d.withColumn("blank", ~F.col("text").rlike(f"[^{GAP}]")).withColumn("open", ~F.col("blank") & ~F.col("text").rlike(rf"[.!?][{GAP}]*\z"))
    by = ["conv", "turn", "role"]
    d = d.repartitionByRange(*by, F.substring("text", 1, 64)).sortWithinPartitions(*by, "text")
    return d.withColumn("at", F.monotonically_increasing_id()).select(*FIELDS)


def numbers(col) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False) if isinstance(col, pa.Array) else col.to_numpy()


def leaf_kinds(t: pa.Table) -> tuple[np.ndarray, ...]:
    """(place of the row, kind, blank, duplicate, truncated, code) of every turn of a segment."""
    n, blank, open_ = numbers(t["n"]), numbers(t["blank"]).astype(bool), numbers(t["open"]).astype(bool)
    take = np.repeat(np.arange(len(n)), n)
    copy = np.arange(len(take)) - np.repeat(np.cumsum(n) - n, n)
    blank, again = blank[take], ~numbers(t["first"]).astype(bool)[take] | (copy > 0)
    again &= ~blank
    code = numbers(t["code"]).astype(np.int64)[take]
    return take, kinds(code, blank | again, open_[take]), blank, again, open_[take] & ~blank & ~again, code


ELEMENT = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("at", pa.int64()), *((x, pa.int64()) for x in SUMS), ("begins", pa.int32()), ("ends", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("cost", pa.list_(pa.int64())), ("rank", pa.list_(pa.int64())), ("segments", pa.list_(pa.int64())), ("ways", pa.list_(pa.binary()))])
ELEMENT_SQL = "conv string, part long, at long, blank long, duplicate long, truncated long, illegal long, begins int, ends int, low long, high long, turns long, cost array<long>, rank array<long>, segments array<long>, ways array<binary>"


def element(**x) -> pa.Table:
    return pa.table({f.name: pa.array([x[f.name]], f.type) for f in ELEMENT}, ELEMENT)


def segment(t: pa.Table) -> pa.Table:
    """A segment's turns as one element: what is counted, its product, and the state it ends in."""
    t = t.sort_by("at")
    _, kind, blank, again, cut, code = leaf_kinds(t)
    tree = Tree(COST[kind], RANK[kind], np.array([len(kind)]))
    turns = [x for x in t["turn"].to_pylist() if x is not None]
    return element(
        conv=t["conv"][0].as_py(), part=t["at"][0].as_py() >> 33, at=t["at"][0].as_py(), blank=int(blank.sum()), duplicate=int(again.sum()), truncated=int(cut.sum()), illegal=int(illegal(code).sum()),
        begins=int(code[0]), ends=int(code[-1]), low=turns[0] if turns else None, high=turns[-1] if turns else None, turns=len(set(turns)),
        cost=tree.cost[0].ravel().tolist(), rank=tree.rank[0].ravel().tolist(), segments=[t["seg"][0].as_py()], ways=[bytes([j]) for _ in range(4) for j in range(4)],
    )


def folded(t: pa.Table) -> pa.Table:
    """Elements of one conversation that follow each other, as one."""
    t = t.sort_by("at")
    m = t.num_rows
    cost, rank = (np.array(t[c].to_pylist(), np.int64).reshape(m, 4, 4) for c in ("cost", "rank"))
    tree = Tree(cost, rank, np.array([m]))
    start = np.repeat(np.arange(4), 4)[None]
    i, j = tree.ways(start, np.tile(np.arange(4), 4)[None])
    ways = t["ways"].to_pylist()
    begins, ends = numbers(t["begins"]), numbers(t["ends"])
    low, high, turns, distinct = None, None, t["turns"].to_pylist(), 0
    for a, b, n in zip(t["low"].to_pylist(), t["high"].to_pylist(), turns, strict=True):
        if n:
            distinct += n - (high is not None and a == high)
            low, high = a if low is None else low, b
    return element(
        conv=t["conv"][0].as_py(), part=t["part"][0].as_py(), at=t["at"][0].as_py(), blank=sum(t["blank"].to_pylist()), duplicate=sum(t["duplicate"].to_pylist()), truncated=sum(t["truncated"].to_pylist()),
        illegal=sum(t["illegal"].to_pylist()) + sum((int(a), int(b)) not in LEGAL for a, b in zip(ends[:-1], begins[1:], strict=True)),
        begins=int(begins[0]), ends=int(ends[-1]), low=low, high=high, turns=distinct, cost=tree.cost[0].ravel().tolist(), rank=tree.rank[0].ravel().tolist(),
        segments=[s for x in t["segments"].to_pylist() for s in x], ways=[b"".join(ways[k][i[k, w] * 4 + j[k, w]] for k in range(m)) for w in range(16)],
    )


def finished(batches):
    """Elements of whole conversations to (conv, sums, cost, end, what became of each segment)."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            tree = Tree(np.array(r["cost"]).reshape(1, 4, 4), np.array(r["rank"]).reshape(1, 4, 4), np.array([1]))
            price, end = (int(x[0]) for x in tree.exits())
            way = r["ways"][end]
            n = r["high"] - r["low"] + 1 - r["turns"] if r["turns"] else 0
            states = [{"seg": s, "entry": a, "leave": z} for s, a, z in zip(r["segments"], b"\0" + way[:-1], way, strict=True)]
            out.append({"conv": r["conv"], "gaps": n if n < 1 << 63 else None, **{x: r[x] for x in SUMS}, "cost": price, "end": end, "states": states})
        kind = pa.schema([("conv", pa.string()), ("gaps", pa.int64()), *((x, pa.int64()) for x in SUMS), ("cost", pa.int64()), ("end", pa.int32()), ("states", pa.list_(pa.struct([("seg", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32())])))])
        yield pa.RecordBatch.from_pylist(out, kind)


FINISHED = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, end int, states array<struct<seg: long, entry: int, leave: int>>"


def piece(t: pa.Table) -> pa.Table:
    """A segment whose states are known to (conv, seg, audit, lines)."""
    t = t.sort_by("at")
    take, kind, *_ = leaf_kinds(t)
    tree = Tree(COST[kind], RANK[kind], np.array([len(kind)]))
    i, j = tree.ways(numbers(t["entry"])[:1].astype(np.int64), numbers(t["leave"])[:1].astype(np.int64))
    role, text = t["role"].to_pylist(), t["text"].to_pylist()
    audit, lines = [], []
    for k, r in enumerate(take.tolist()):
        e, more = edited(int(kind[k]), int(i[k]), int(j[k]), role[r], text[r])
        audit.append(e)
        lines += [{"role": x, "text": y} for x, y in more]
    return pa.table({"conv": t["conv"][:1], "seg": t["seg"][:1], "audit": pa.array(["".join(audit)]), "lines": pa.array([lines], LINES)})


def strung(keep: bool):
    """Pieces in order to one row for each conversation: its audit, and its digest taken piece by piece."""

    def run(batches):
        now, audit, digest, lines, any_ = None, [], None, [], False

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array(["".join(audit)]), pa.array([digest.hexdigest()]), pa.array([lines if keep else None], LINES)], ["conv", "audit", "repaired_sha256", "turns"])

        for b in batches:
            for conv, more, part in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if conv != now:
                    if now is not None:
                        yield out()
                    now, audit, digest, lines, any_ = conv, [], hashlib.sha256(), [], False
                audit.append(more)
                if part:
                    digest.update((b"\n" if any_ else b"") + shown((x["role"], x["text"]) for x in part))
                    any_ = True
                    if keep:
                        lines += part
        if now is not None:
            yield out()

    return run, "conv string, audit string, repaired_sha256 string, turns array<struct<role: string, text: string>>"


COLUMNS = ["gaps", *SUMS, "cost", "audit", "repaired_sha256", "turns"]


def over_borders(rows: DataFrame, keep: bool) -> DataFrame:
    """rows (FIELDS) of conversations that several partitions may share to (conv, COLUMNS), but for those without a row."""
    rows = rows.filter("n > 0").withColumn("seg", F.shiftright("at", SEGMENT_BITS))
    # Where a role and text stand first: keys of the rows' own numbers, so that a frequent text is no hot key.
    first = rows.groupBy("conv", "role", F.sha2("text", 256)).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    rows = rows.join(first, "at", "left").withColumn("first", F.coalesce("first", F.lit(False)))
    slim = rows.select("conv", "seg", "at", "turn", "n", "code", "blank", "open", "first")
    segments = slim.groupBy("conv", "seg").applyInArrow(segment, ELEMENT_SQL)
    parts = segments.groupBy("conv", "part").applyInArrow(folded, ELEMENT_SQL)
    total = written(parts.groupBy("conv").applyInArrow(folded, ELEMENT_SQL).mapInArrow(finished, FINISHED), "conversations")
    states = total.select("conv", F.explode("states").alias("s")).select("conv", "s.*")
    known = rows.join(states, ["conv", "seg"])
    pieces = known.groupBy("conv", "seg").applyInArrow(piece, "conv string, seg long, audit string, lines array<struct<role: string, text: string>>")
    tails = F.array(*[F.array(*[F.struct(F.lit(r).alias("role"), F.lit(t).alias("text")) for r, t in ending(s)]).cast("array<struct<role: string, text: string>>") for s in range(4)])
    last = total.filter(F.size("states") > 0).select("conv", F.lit((1 << 63) - 1).alias("seg"), F.array(*map(F.lit, TAIL))[F.col("end")].alias("audit"), tails[F.col("end")].alias("lines"))
    run, schema = strung(keep)
    whole_ = pieces.union(last).repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(run, schema)
    return total.drop("states", "end").join(whole_, "conv").select("conv", *COLUMNS)


def repair(rows: DataFrame, keep: bool = False) -> DataFrame:
    """rows (conv_id, turn, role, text, n: copies, 0 for none) to (conv_id, COLUMNS), turns null unless they are to be kept: the repaired (role, text) in order."""
    kind = rows.schema["conv_id"].dataType
    run, schema = by_partition(keep)
    table = written(dealt_out(rows).mapInArrow(run, schema), "turns")
    done = table.filter("at is null").select("conv", "gaps", F.col("blanks").alias("blank"), *COLUMNS[2:])
    shared = table.filter("at is not null").select(*FIELDS)
    found = over_borders(shared, keep)
    # Conversations of which no row is left have no element.
    rest = shared.groupBy("conv").agg(F.sum("n").alias("n")).filter("n = 0").select("conv", F.lit(0).cast("long").alias("gaps"), *(F.lit(0).cast("long").alias(x) for x in [*SUMS, "cost"]), F.lit("").alias("audit"), F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256"), (F.array() if keep else F.lit(None)).cast("array<struct<role: string, text: string>>").alias("turns"))
    out = done.union(found).union(rest)
    return out.select(F.when(F.col("conv") == "", None).otherwise(F.substr("conv", F.lit(2))).cast(kind).alias("conv_id"), *COLUMNS)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """rows as for repair() to the repaired conversations: (conv_id, turn counted from 0, role, text)."""
    return repair(rows, keep=True).select("conv_id", F.posexplode("turns").alias("turn", "t")).select("conv_id", "turn", "t.role", "t.text")


def conversations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).drop("turns")
