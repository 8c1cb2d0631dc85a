"""Conversation repair against a search over all edits, turn by turn, with the audits written out."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quillstream.llm import turns


def brute(rows):
    """Result of one conversation's rows (turn, role, text), in order, after damage."""
    best = {0: (0, "", [])}
    seen, blank, dup, cut, last = set(), 0, 0, 0, None
    bad = 0

    def inserted(best):
        out = dict(best)
        for _ in range(4):
            for s, (c, a, t) in list(out.items()):
                x = "a" if s == 2 else "u"
                n = turns.NEXT[s, x]
                new = (c + 3, a + "I", [*t, (turns.ROLES[x], "")])
                if n not in out or new[:2] < out[n][:2]:
                    out[n] = new
        return out

    for _, role, text in rows:
        must = open_ = False
        body = text.rstrip(" \t\n\v\f\r")
        if not re.search(r"[^\x20\x09-\x0D]", text):
            must, blank = True, blank + 1
        elif (role, text) in seen:
            must, dup = True, dup + 1
        elif body[-1] not in ".!?":
            open_, cut = True, cut + 1
        seen.add((role, text))
        if last is not None and last + role[0] not in ("su", "ua", "au"):
            bad += 1
        last = role[0]
        new = {}
        for s, (c, a, t) in inserted(best).items():
            ways = [(s, c + 4, a + "D", t)]
            if not must:
                if (s, role[0]) in turns.NEXT:
                    ways.append((turns.NEXT[s, role[0]], c + 3 * open_, a + "K", [*t, (role, text)]))
                for x in "ua":
                    if (s, x) in turns.NEXT:
                        ways.append((turns.NEXT[s, x], c + 3 + 3 * open_, a + "R", [*t, (turns.ROLES[x], text)]))
            for n, *w in ways:
                if n not in new or tuple(w[:2]) < new[n][:2]:
                    new[n] = tuple(w)
        best = new
    best = inserted(best)
    c, a, t = min((best[s] for s in (0, 3) if s in best), key=lambda x: x[:2])
    known = {x[0] for x in rows if x[0] is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    return gaps, blank, dup, cut, bad, c, a, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in t).encode()).hexdigest()


def damage(rows):
    """Conversations (by id) after damage, in order."""
    out = {}
    show = lambda x: " " if x is None else str(x)
    for conv, turn, role, text, *_ in rows:
        h = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        mine = out.setdefault(conv, [])
        role, text = role or " ", show(text)
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            mine += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def made(n, longest, seed):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["a.", "b!", "yes", "b c d.  ", "Straße?\n", "", None, " \t", f"{rnd.random()}.", f"{rnd.random()}."])
            rows.append((conv if conv else None, turn * rnd.choice([1, 1, 1, 2]) if rnd.random() > 0.1 else None, role, text, "x"))
    return rows


@pytest.mark.parametrize("held", [2048, 5])
def test_repair(spark, monkeypatch, held):
    monkeypatch.setattr(turns, "HELD", held)
    monkeypatch.setattr(turns, "SEGMENT_BITS", 8 if held > 5 else 3)
    monkeypatch.setattr(turns, "TOGETHER", 40)
    rows = made(150, 14, held) + [(500, t, r, "same.", "x") for t in range(300) for r in ("user", "assistant")] + [(501, i, "user" if i % 2 else "assistant", f"{i}.", "x") for i in range(700)]
    rows += [(502, 0, "user", "once more.", "x")] * 40
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string").repartition(4)
    got = turns.repair(turns.damaged(d)).drop("turns")
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((c, *brute(r))) for c, r in damage(rows).items())


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "hi.", 1), (1, 1, "user", "ok", 1), (2, 5, "system", "be kind.", 1), (2, 6, "tool", "42.", 1), (2, 7, "user", " ", 1), (3, 0, "user", "gone.", 0)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int")
    got = [tuple(r) for r in turns.repaired_turns(d).orderBy("conv_id", "turn").collect()]
    assert [g for g in got if g[0] == 1] == [(1, 0, "user", ""), (1, 1, "assistant", "hi.")]
    sums = {r["conv_id"]: (r["cost"], r["audit"]) for r in turns.repair(d).collect()}
    assert sums[3] == (0, "") and sums[2] == (brute([(5, "system", "be kind."), (6, "tool", "42."), (7, "user", " ")])[5:7])
    assert turns.repair(d.limit(0)).count() == 0


def test_products_are_associative():
    rnd = np.random.default_rng(1)
    kind = rnd.integers(0, 16, (200, 3))
    a, b, c = ((turns.COST[kind[:, i]], turns.RANK[kind[:, i]]) for i in range(3))
    left = turns.product(turns.product(a, b)[:2], c)
    right = turns.product(a, turns.product(b, c)[:2])
    can = left[0] < turns.FAR
    assert (left[0] == right[0]).all() and (left[1][can] == right[1][can]).all() and can.any()


def test_given_tables(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = turns.conversations_query(spark, d).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((c, *brute(r))) for c, r in damage(rows).items())
