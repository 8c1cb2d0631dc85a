"""Cross-tokenizer alignment against whole texts encoded and cut by their byte offsets."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstream.llm import align

A, B = f"{align.FOLDER}/{align.FILE_A}", f"{align.FOLDER}/{align.FILE_B}"


@pytest.fixture(scope="module")
def tokens():
    return align.Tokens(A, B)


def groups(t, text):
    """Pairs of lists of ids, cut where tokens of both end; none where the bytes aren't the text's."""
    if not text:
        return []
    a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    want = (" " + text).encode()
    if b"".join(t.bytes_a[i] for i in a) != want or b"".join(t.bytes_b[i] for i in b) != want:
        return []
    ends = [{0}, {0}]
    for k, (ids, names) in enumerate(((a, t.bytes_a), (b, t.bytes_b))):
        at = 0
        for i in ids:
            at += len(names[i])
            ends[k].add(at)
    cuts = sorted(ends[0] & ends[1])
    out = [([], []) for _ in cuts[1:]]
    for k, (ids, names) in enumerate(((a, t.bytes_a), (b, t.bytes_b))):
        at = g = 0
        for i in ids:
            at += len(names[i])
            out[g][k].append(i)
            g += at == cuts[g + 1]
    return out


def brute(t, texts):
    all_ = [groups(t, x) for x in texts]
    links = [Counter((a, b) for g in gs for a in g[0] for b in g[1]) for gs in all_]
    count = Counter(p for x in links for p in x)
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for gs, x in zip(all_, links, strict=True):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        out.append((sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), sum(x.values()), sum(n for p, n in x.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in x.items()), hashlib.sha256(shown.encode()).hexdigest() if gs else ""))
    return out


PIECES = ["the", "thing", "étion", "ß", "naïve", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "日本語のテキスト", "한국어", "مرحبا", "🙂👍🏽", "é", "▁", "a▁b", " ", " ", "\t", "\n", "\r\n", "  ", " ", "'s", "we'll", "123456", "x" * 300, "%%%", "ﬁ", "Ⅻ", "\x00", "\x1c", "​", "don't!", "ΑΒΓ", "﻿", "\U000e0001"]


def odd_texts(n, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) + rnd.choice(["", " ", " ", "  "]) for _ in range(rnd.randint(1, 12))) for _ in range(n)]


ODD = [None, "", " ", "  ", "\n", " a", "a ", "a  b", "▁", "a ▁ b", "<|endoftext|> a", *PIECES]


def test_whole_texts(spark, tokens, monkeypatch):
    rnd = random.Random(1)
    texts = ODD + odd_texts(250) + [" ".join(rnd.choice(["ba", "ko", "mital", "ture", "Salen,", "dor."]) for _ in range(k)) for k in (5, 60, 4000)] + ["the thing"] * 5
    rows = [(i if i % 7 else None, x, "?") for i, x in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, pairs string").repartition(5)
    want = sorted(map(str, [(r[0], *b) for r, b in zip(rows, brute(tokens, texts), strict=True)]))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for slices, remembered in ((align.SLICE, align.REMEMBERED), (40, 50)):
        monkeypatch.setattr(align, "SLICE", slices)
        monkeypatch.setattr(align, "REMEMBERED", remembered)
        got = align.align(d, A, B)
        assert got.columns == names
        assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert align.align(d).collect() == []
    one = align.align(spark.createDataFrame([(1, None), (1, "")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in one] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_stretches_are_encoded_as_in_the_whole(tokens):
    for x in odd_texts(400, 9):
        cut = tokens.stretches(x)
        assert tokens.a.encode(" " + x, add_special_tokens=False).ids == [i for s in tokens.encode_a(cut) for i in s]
        whole = tokens.b.encode(x)
        if b"".join(tokens.bytes_b[i] for i in whole) == (" " + x).encode():
            assert whole == [i for s in tokens.encode_b(cut) for i in s]


def test_counts_of_a_table(spark):
    d = "/root/testdata/sf0.001"
    r = align.documents_query(spark, d).agg(F.count("*").alias("n"), F.min(F.col("n_links") - F.greatest("n_a", "n_b")).alias("least"), F.max(F.col("n_best") - F.col("n_links")).alias("over")).first()
    assert r["n"] == spark.read.parquet(f"{d}/documents.parquet").count() and r["least"] >= 0 and r["over"] <= 0
