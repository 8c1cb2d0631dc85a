"""The training-data operators against brute force, round trips and held-out accuracy, with odd rows."""

import gzip
import hashlib
import io
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import decontam, langid, lattice, minhash, mixing, quality, suffixes, toxicity, urls, warc
from quillstream.llm.shared import components
from quillstream.llm.textcore import words

rnd = random.Random(7)


@pytest.fixture(autouse=True)
def seeded(request):
    """Texts of a test don't depend on which tests ran before."""
    rnd.seed(request.node.name)


SYLLABLES = ["ba", "ko", "mi", "tu", "re", "sal", "en", "dor", "vi", "pa"]


def word():
    return "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4)))


def prose(n):
    return " ".join(word() for _ in range(n))


def docs(spark, texts, extra=None, first=0):
    rows = [(first + i, t, (extra or {}).get(i)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


ODD = [None, "", " ", "...", "x", "é" * 150, "a" * 5000]


# --- 1 ------------------------------------------------------------------------------------------------------------


def brute_repeats(texts, length):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        n = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), n, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "WINDOWS", 500)
    monkeypatch.setattr(suffixes, "PIECE", 900)
    a, b = prose(120), prose(60)
    texts = [a, b, prose(80), a, a[50:400] + prose(40), prose(20) + b[:300] + "é" + b[300:], *ODD, "ab" * 200, a[:99], a[:100], (b + " ") * 3]
    texts += [f"{word()} {word()} {b[10:150]} {word()} {word()}" for _ in range(12)]
    d = suffixes.dedup(docs(spark, texts)).select("doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (s, x) -> s + x.end - x.start)"), F.size("spans"), F.sha2("kept", 256))
    got = [tuple(r)[1:] for r in d.orderBy("doc_id").collect()]
    assert got == brute_repeats(texts, 100)


def test_suffix_dedup_odd_ids_and_columns(spark):
    a = prose(60)
    d = spark.createDataFrame([(None, a, 1), (5, a, 2), (5, a, 3), (7, a, 4)], "doc_id long, text string, kept int")
    got = {(r["doc_id"], r["n_bytes"]): len(r["kept"]) for r in suffixes.dedup(d).collect()}
    assert got == {(None, len(a)): len(a), (5, len(a)): 0, (7, len(a)): 0}
    assert suffixes.dedup(d.limit(0)).count() == 0
    twice = suffixes.dedup(d.filter("doc_id = 5"))
    assert [len(r["kept"]) for r in twice.collect()] == [len(a), len(a)]


def test_suffix_dedup_of_rows_that_share_ids(spark):
    """Thousands of rows without an id and of one id, with passages that they share, against brute force in the documented order."""
    a = [prose(30) for _ in range(40)]
    rows = [(None if i % 3 else 5, f"{word()} {rnd.choice(a)} {word()} {rnd.choice(a)[:105]}") for i in range(6000)] + [(None, None), (None, ""), (5, a[0]), (5, a[0]), (9, a[1])]
    order = sorted({(-(2**63) if d is None else d, hashlib.sha256((t or "").encode()).hexdigest(), t or "") for d, t in rows})
    want = dict(zip([(d, t) for d, _, t in order], brute_repeats([t for _, _, t in order], 100), strict=True))
    d = suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("was", F.col("text")).repartition(5))
    got = d.select("doc_id", "was", "n_bytes", F.expr("aggregate(spans, 0L, (s, x) -> s + x.end - x.start)"), F.size("spans"), F.sha2("kept", 256)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[2:] == want[-(2**63) if r[0] is None else r[0], r[1] or ""]


def test_suffix_order():
    data = np.frombuffer(("abracadabra" * 30 + prose(50)).encode() + b"\0" * 40, np.uint8)
    at = np.arange(len(data) - 40)
    s = suffixes.Suffixes(data, 40)
    o = s.order(at)
    raw = data.tobytes()
    assert [raw[i : i + 40] for i in at[o]] == sorted(raw[i : i + 40] for i in at)
    cls = s.classes(at)
    assert len(set(cls)) == len({raw[i : i + 40] for i in at})


# --- 2 ------------------------------------------------------------------------------------------------------------


def changed(t, share):
    return " ".join(word() + "x" if rnd.random() < share else w for w in t.split())


def test_near_duplicates(spark, monkeypatch):
    base = prose(300)
    texts = [base, prose(200), changed(base, 0.01), base.upper(), base + " " + prose(3), *[changed(base, 0.01) for _ in range(25)], changed(base, 0.3), prose(3), *ODD]
    ws = [minhash.hashed((t or "").encode()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or ((texts[i] or "") == (texts[j] or "")) or minhash.similar(ws[i], ws[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    for small in (8, 2):
        monkeypatch.setattr(minhash, "SMALL", small)
        got = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs(spark, texts)).collect()}
        assert got == {i: find(i) for i in range(len(texts))}
    assert find(2) == 0 and find(3) == 0 and find(1) == 1 and find(30) == 30


@pytest.mark.parametrize("block", [256, 9])
def test_near_duplicates_of_one_base(spark, monkeypatch, block):
    """Copies of a base, edited in different places and not alike enough for a link, some of them edited once more."""
    monkeypatch.setattr(minhash, "BLOCK", block, raising=False)
    base = prose(200).split()

    def edited(w, n):
        at = rnd.randrange(len(w) - n)
        return [*w[:at], *(prose(n).split()), *w[at + n :]]

    copies = [edited(base, 36) for _ in range(60)]
    texts = [" ".join(w) for w in copies + [edited(w, 20) for w in copies[:30]]]
    ws = [minhash.hashed(t.encode()) for t in texts]
    sk = [set(enumerate(minhash.sketches(minhash.labelled(w)).tolist())) for w in ws]
    root = np.arange(len(texts))
    for i in range(len(texts)):
        for j in range(i):
            if sk[i] & sk[j] and root[i] != root[j] and minhash.similar(ws[i], ws[j]):
                root[np.isin(root, [root[i], root[j]])] = min(root[i], root[j])
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs(spark, texts)).collect()}
    assert got == dict(enumerate(root.tolist())) and 2 < len(set(root.tolist())) < 80


def test_near_duplicates_odd(spark):
    t = prose(100)
    d = spark.createDataFrame([(None, t), (3, t), (3, t), (4, prose(100))], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"], r["kept"]) for r in minhash.classes(d).collect()), key=str)
    assert got == sorted([(None, 3, False), (3, 3, True), (3, 3, True), (4, 4, True)], key=str)
    alone = minhash.classes(spark.createDataFrame([(None, t), (None, t), (None, None)], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["class_id"], r["kept"]) for r in alone] == [(None, None, True)] * 3 and len({r["key"] for r in alone}) == 2
    assert minhash.classes(d.limit(0)).count() == 0


def test_alignment_distance():
    for _ in range(60):
        a = np.array([rnd.randint(0, 4) for _ in range(rnd.randint(0, 25))], np.uint64)
        b = np.array([rnd.randint(0, 4) for _ in range(rnd.randint(0, 25))], np.uint64)
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        d = len(a) + len(b) - 2 * t[-1][-1]
        assert minhash.distance_within(a, b, d) == d and (d == 0 or minhash.distance_within(a, b, d - 1) is None)


def test_alignment_of_long_texts(spark):
    """Texts of some 25,000 words, far beyond what is kept of a text: the distance is exact, and links follow it."""
    a = np.array([rnd.randint(0, 5000) for _ in range(25_000)], np.uint64)
    for share, linked in ((0.15, True), (0.19, True), (0.21, False)):
        b = a.copy()
        at = rnd.sample(range(len(a)), int(share * len(a)))
        b[at] = np.arange(10_000, 10_000 + len(at))
        assert minhash.similar(a, b) is linked
        assert minhash.distance_within(a, b, 2 * len(at)) == 2 * len(at) and minhash.distance_within(a, b, 2 * len(at) - 1) is None
    shifted = np.concatenate([a[19_000:], a[:19_000]])
    assert not minhash.similar(a, shifted) and minhash.distance_within(a, shifted, 12_000) == 12_000


def test_ids_of_any_size(spark):
    t, u = prose(100), prose(100)
    big = [(1 << 62) + 5, (1 << 63) - 1, -(1 << 63), 1 << 62, None, 7]
    d = spark.createDataFrame([(big[0], t), (big[1], t + " x"), (big[2], u), (big[3], u), (big[4], t), (big[5], prose(90)), (None, prose(80))], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"], r["kept"]) for r in minhash.classes(d).collect()), key=str)
    assert got == sorted([(big[0], big[0], True), (big[1], big[0], False), (big[2], big[2], True), (big[3], big[2], False), (None, big[0], False), (7, 7, True), (None, None, True)], key=str)



@pytest.mark.parametrize("share, least", [(0.02, 0.99), (0.05, 0.97), (0.1, 0.9), (0.15, 0.75)])
def test_recall_by_edit_rate(share, least):
    """Of pairs that align, how many share a sketch and link, at several shares of changed words."""
    found = linked = 0
    for _ in range(60):
        a = prose(rnd.choice([60, 150, 400]))
        x, y = minhash.hashed(a.encode()), minhash.hashed(changed(a, share).encode())
        linked += minhash.similar(x, y)
        found += minhash.similar(x, y) and bool((minhash.sketches(minhash.labelled(x)) == minhash.sketches(minhash.labelled(y))).any())
    assert linked >= 55 and found >= least * linked


def test_long_copies_align_in_time():
    a = minhash.hashed(prose(200_000).encode())
    b = np.delete(a, [rnd.randrange(200_000) for _ in range(4000)])
    b[[rnd.randrange(len(b)) for _ in range(4000)]] = 7
    assert minhash.similar(a, b) and not minhash.similar(a, a[::-1].copy())


def test_order_matters():
    x = minhash.labelled(minhash.hashed(prose(400).encode()))
    assert (minhash.sketches(x) == minhash.sketches(x.copy())).all()
    assert (minhash.sketches(x) != minhash.sketches(x[::-1].copy())).sum() > 10


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (105, 101), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), "t").collect())
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 105: 100}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


# --- 3 ------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", "", None, "WARC/1.1\r\n\r\n\r\n\r\nx", "é\n" * 5000, "<p>a</p>"]
    pages = spark.createDataFrame([(i, None if i == 3 else f"http://h/{i} x", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    for version in (1, 2):
        path = f"file://{tmp_path}/w{version}"
        warc.write_warc(warc.convert(warc.arc_records(pages, version)), path)
        got = {r["key"]: r for r in warc.read_warc(spark, path).collect()}
        assert len(got) == len(html)
        for i, h in enumerate(html):
            raw = (h or "").encode()
            top = max(j for j, x in enumerate(html) if (x or "") == (h or ""))
            assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == warc.sha1_base32(raw)
            assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if i == top else ("revisit", top))
            assert got[i]["payload"] == (raw if i == top else b"")
        packed = f"file://{tmp_path}/p{version}"
        warc.write_warc(warc.convert(warc.arc_records(pages.coalesce(1), version), 3000), packed)
        assert sorted(map(tuple, warc.read_warc(spark, packed).collect())) == sorted(map(tuple, got.values()))
        assert len(list((tmp_path / f"p{version}").glob("part-*"))) > 1
    empty = f"file://{tmp_path}/none"
    warc.write_warc(warc.convert(warc.arc_records(pages.limit(0))), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_warc_without_ids(spark, tmp_path):
    pages = spark.createDataFrame([(None, "u", "a"), (4, "u", "a"), (4, "u", "a"), (None, "u", "b"), (None, None, None)], "page_id long, url string, html string")
    pages = pages.withColumn("key", F.lit("x")).withColumn("warc", F.lit("y"))
    warc.write_warc(warc.convert(warc.arc_records(pages), warc.PACK), f"file://{tmp_path}/w")
    got = sorted(((r["key"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()), key=str)
    assert got == sorted([(None, "revisit", 4, 1), (4, "response", None, 1), (4, "response", None, 1), (None, "response", None, 1), (None, "response", None, 0)], key=str)


def test_arc_files(spark, tmp_path):
    bodies = [b"x\ny", b"", b"filedesc://no 1\n" * 50, "é\r\n\r\n".encode()]
    for version in (1, 2):
        raw = warc.arc_block(version, "a.arc") + b"\n".join(warc.arc_record(f"http://a b/{i}", x, "1999", version=version) for i, x in enumerate(bodies))
        got = list(warc.read_arc(io.BytesIO(raw)))
        assert [(r["version"], r["URL"], r["payload"], r["length"]) for r in got] == [(version, f"http://a%20b/{i}", x, len(x)) for i, x in enumerate(bodies)]
        head = warc.to_warc(got[0], 1, None)
        assert b"WARC-Date: 1999-00-00T" not in head and b"WARC-Date: 1999-01-01T00:00:00Z" in head
        (tmp_path / f"v{version}.arc").write_bytes(raw)
        (tmp_path / f"v{version}.arc.gz").write_bytes(gzip.compress(raw))
    arcs = warc.read_arcs(spark, f"file://{tmp_path}/*.arc*")
    assert arcs.count() == 4 * len(bodies) and arcs.select("key").distinct().count() == 4 * len(bodies)
    warc.write_warc(warc.convert(arcs, warc.PACK), f"file://{tmp_path}/out")
    back = warc.read_warc(spark, f"file://{tmp_path}/out").collect()
    assert sorted(r["payload"] for r in back if r["record_type"] == "response") == sorted(bodies) and len(back) == 16
    many = warc.convert(spark.createDataFrame([(7, bytearray(raw))], "key long, arc binary"))
    assert sorted(bytes(r[0]).partition(b"\r\n\r\n")[2] for r in many.collect()) == sorted(bodies)
    block = warc.arc_block(1)
    bad = [b"http://x 1 2\nabc", block + b"http://x 1 2\nab", block + b"http://x 0.0.0.0 2000 text/html 9\nabc", block.replace(b"\n1 0", b"\n3 0"), block + b"x y\n"]
    for x in bad:
        with pytest.raises(ValueError):
            list(warc.read_arc(io.BytesIO(x)))
    with pytest.raises(ValueError):
        list(warc.parse_warc(io.BytesIO(b"HTTP/1.1\r\n")))


# --- 4 ------------------------------------------------------------------------------------------------------------

TONGUES = {"aa": ["ba", "ko", "mi", "tu"], "bb": ["schr", "ung", "eit", "lich"], "cc": ["ção", "nh", "lho", "ões"]}


def said(lang, n):
    return " ".join("".join(rnd.choice(TONGUES[lang]) for _ in range(3)) for _ in range(n))


def test_language(spark):
    rows = [(i, said(x, rnd.randint(5, 40)), x) for i, x in enumerate(rnd.choice("abc") * 2 for _ in range(150))]
    rows += [(900 + i, t, "aa") for i, t in enumerate([None, "", "123 !!"])] + [(None, said("bb", 20), None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(d, langid.fitted(d)).collect()
    assert all(r["lang_pred"] == ("und" if not re.search(r"[^\W\d_]", r["text"] or "") else r["lang"] or "bb") for r in got)
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == len(rows)
    blank = langid.identify(d, langid.fitted(d.limit(0))).collect()
    assert {r["lang_pred"] for r in blank} == {"und"} and langid.identify(d.limit(0), langid.fitted(d)).count() == 0


def test_language_parts(spark, monkeypatch):
    """Trees in parts give the code lengths of whole ones, rows and columns as they are."""
    rows = [(i, said(x, rnd.randint(5, 40)), x, i) for i, x in enumerate(rnd.choice("abc") * 2 for _ in range(60))] + [(99, None, None, 5), (None, "é" * 3000, "aa", 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    whole = sorted(map(tuple, langid.identify(d, langid.fitted(d)).collect()), key=str)
    monkeypatch.setattr(langid, "MOST", 400)
    fit = langid.fitted(d)
    assert len(fit.parts) > 2
    parts = sorted(map(tuple, langid.identify(d, fit).collect()), key=str)
    assert [r[:4] for r in parts] == [r[:4] for r in whole] and np.allclose([r[4] for r in parts], [r[4] for r in whole], atol=1e-6)


def test_language_held_out(spark):
    """Held-out accuracy of the given tables."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    got = langid.identify(d, langid.fitted(d)).filter("lang is not null and lang_pred <> 'und'").filter(toxicity.held_out(F.col("doc_id"), 4, 2))
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).head()[0] >= 0.98


def test_language_costs():
    """Code lengths against the definition, worked out gram by gram."""
    text, other = said("aa", 30), said("aa", 4) + " zq"
    data = lambda s: (np.frombuffer(s.encode(), np.uint8), np.array([0, len(s.encode())]))
    code, _ = langid.codes(*data(text))
    g, n = np.unique(code, return_counts=True)
    t = langid.Trees(["aa"], [g], [n.astype(float)])

    def cost(gram, o):
        if o < 0:
            return 8.0
        key = gram & ((1 << 8 * (o + 1)) - 1)
        seen = {}
        for x, k in zip(g.tolist(), n.tolist(), strict=True):
            x &= (1 << 8 * (o + 1)) - 1
            if x >> 8 == key >> 8:
                seen[x] = seen.get(x, 0) + k
        if not seen:
            return cost(gram, o - 1)
        total = sum(seen.values()) + len(seen)
        return -math.log2(seen[key] / total) if key in seen else -math.log2(len(seen) / total) + cost(gram, o - 1)

    mine, first = langid.codes(*data(other))
    assert abs(t.totals(mine, first)[0, 0] - sum(cost(x, langid.ORDER) for x in mine.tolist())) < 1e-3


# --- 5 ------------------------------------------------------------------------------------------------------------


def brute_url(u):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(r, v) for r, v in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_urls(spark):
    us = ["https://A.Example.com/en/7x?q", "http://x.com/en/1#f", "http://com/en/", "x://net/de/1", "ftp://example.net/de/8", "http://notexample.net/de/8", "http://b.org/es/", "http://b.org/EN", "no", None, "", "://", "http://É.com/é?://", "http://h"]
    us += [f"http://{word()}.com/en/{i}" for i in range(30)] + [f"http://{word()}.net/de/{i}" for i in range(30)] + [f"http://{word()}.io/de/{i}" for i in range(5)]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(list(enumerate(us)), "page_id long, url string")).collect()}
    for i, u in enumerate(us):
        host, path, (rule, v) = brute_url(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (v or got[i]["verdict"]) and got[i]["verdict"] in ("allow", "block")
    assert [got[i]["verdict"] for i in range(len(us)) if us[i] and ".io/de" in us[i]] == ["allow"] * 5
    none = urls.judge(spark.createDataFrame([(1, "http://x.io/a"), (2, None)], "page_id long, url string")).collect()
    assert [r["verdict"] for r in none] == ["allow", "allow"]
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_scores(spark):
    """Scores against the definition of the interpolated models."""
    us = [f"http://{word()}.com/en/{word()}" for _ in range(12)] + [f"http://{word()}.net/de/{word()}" for _ in range(9)] + ["http://x.io/q"]
    got = {r["page_id"]: r["score"] for r in urls.judge(spark.createDataFrame(list(enumerate(us)), "page_id long, url string")).collect()}
    n = {"block": {}, "allow": {}}
    grams = lambda t: [("\2" * 3 + t + "\3")[i : i + 4] for i in range(len(t) + 1)]
    parts = [brute_url(u) for u in us]
    for h, p, (_, v) in parts:
        if v:
            for g in grams(h + p):
                for o in range(4):
                    n[v][g[3 - o :]] = n[v].get(g[3 - o :], 0) + 1

    def prob(v, g):
        p = 1 / 256
        for o in range(4):
            s = g[3 - o :]
            ends = [k for x, k in n[v].items() if len(x) == o + 1 and x[:o] == s[:o]]
            if ends:
                p = (n[v].get(s, 0) + len(ends) * p) / (sum(ends) + len(ends))
        return p

    for i, (h, p, _) in enumerate(parts):
        want = np.mean([math.log(prob("block", g) / prob("allow", g)) for g in grams(h + p)])
        assert abs(got[i] - want) < 1e-6


# --- 6 and 9 ------------------------------------------------------------------------------------------------------


def test_quality(spark):
    rows, marks = [], []
    for i in range(240):
        bad = i % 4 == 0
        t = prose(rnd.randint(20, 80))
        rows.append((i, " ".join(w + "***" for w in t.split()) if bad else t))
        if i % 3:
            marks.append((i, int(not bad), 0))
    rows += [(1000 + i, t) for i, t in enumerate(ODD)]
    d, m = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score(d, m).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([got[i]["predicted"] == (i % 4 != 0) for i in range(240)]) > 0.95
    assert {r["score"] for r in quality.score(d, m.limit(0)).collect()} == {0.5}
    assert quality.score(d.limit(0), m).count() == 0


def test_quality_held_out(spark):
    """Held-out accuracy of the given tables, and a prior near the share of good labels, of which it sees only the good."""
    base = "/root/testdata/sf0.1"
    d, m = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = quality.score(d, m).filter("held_out").join(m, "doc_id").groupBy("quality").agg(F.avg("predicted").alias("share")).collect()
    assert {r["quality"]: r["share"] >= 0.97 if r["quality"] else r["share"] <= 0.1 for r in got} == {0: True, 1: True}


def test_quality_prior():
    rng = np.random.default_rng(3)
    for p in (0.2, 0.5, 0.9):
        good, bad = np.histogram(rng.normal(4, 1, 4000), 300, (-8, 8))[0], np.histogram(rng.normal(-4, 1, 20_000), 300, (-8, 8))[0]
        every = np.histogram(np.concatenate([rng.normal(4, 1, int(20_000 * p)), rng.normal(-4, 1, int(20_000 * (1 - p)))]), 300, (-8, 8))[0]
        assert abs(quality.estimated_prior(every, good) - p) < 0.04 and bad.sum()
    # A third of the scores are equal and lie where the prior points: the cut is beside them.
    every = np.zeros(60 * quality.STEPS + 1)
    every[[1000, 1500, 2000]] = 300, 400, 300
    assert quality.decision(every, 0.5) in ((1000 + 1500) / 2 / quality.STEPS - 30, (1500 + 2000) / 2 / quality.STEPS - 30)


def test_quality_odd(spark):
    rows = [(None if i % 7 == 0 else i, " ".join(prose(10).capitalize() + "." for _ in range(4)) if i % 3 else "a a a a !!! ### " * 5, "x") for i in range(90)] + [(200, "word " * 200_000, "x"), (3, "twice", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("f", F.lit(1)).withColumn("good", F.lit(True))
    m = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)] + [(1, None), (None, 1)], "doc_id long, quality int")
    got = quality.score(d, m).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got) and sum(r["doc_id"] is None for r in got) == 13


def toxic_rows():
    """Three vocabularies: insults as whole words, as stems with many endings, and stems that clean texts also hold now and then."""
    insults = {0: ["wretchedfool", "gruntpig", "oaf"], 1: ["lumqu", "dworx"], 2: ["bréeux", "skowlich"]}
    ends = ["", "ba", "komi", "reen", "sal", "tudor", "vi", "pako", "enmi", "ré"]
    rows, marks = [], []
    for i in range(900):
        kind, bad = i % 3, (i // 3) % 5 == 2
        w = prose(rnd.randint(20, 80)).split()
        say = lambda: rnd.choice(insults[kind]) + ("" if kind == 0 else rnd.choice(ends))  # noqa: B023,E731
        for _ in range(rnd.randint(3, 5) if bad else int(kind == 2 and rnd.random() < 0.07)):
            w.insert(rnd.randint(0, len(w)), say())
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(bad)))
    return rows, marks


def test_toxicity(spark):
    rows, marks = toxic_rows()
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "gruntpig"), (2000, rows[6][1] + " " + prose(30_000)), (2001, prose(30_000))]
    d, m = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(d, m).collect()}
    assert len(got) == len(rows) and all(got[1000 + i]["predicted"] == 0 for i in range(len(ODD))) and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[2000]["predicted"] == 1 and got[2001]["predicted"] == 0
    held = [i for i in range(900) if got[i]["held_out"]]
    assert 100 < len(held) < 300
    for kind in range(3):
        bad, good = [[got[i]["predicted"] for i in held if i % 3 == kind and bool(marks[i][2]) == y] for y in (True, False)]
        assert np.mean(bad) >= 0.9 and np.mean(good) <= 0.03, kind
    assert {r["score"] for r in toxicity.score(d, m.limit(0)).collect()} == {0.0}
    assert toxicity.score(d.limit(0), m).count() == 0


def test_toxicity_by_language(spark):
    """Held-out recall and false alarms of the given tables, by language."""
    base = "/root/testdata/sf0.1"
    d, m = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = toxicity.score(d, m).filter("held_out").join(m, "doc_id").join(d.select("doc_id", "lang"), "doc_id").groupBy("lang", "toxic").agg(F.avg("predicted").alias("share")).collect()
    assert len(got) == 8
    for r in got:
        assert r["share"] >= 0.9 if r["toxic"] else r["share"] <= 0.02, r


def test_toxic_dictionaries_are_trained(spark):
    rows, marks = toxic_rows()
    d, m = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.labelled_sample(d, m, "toxic", 5, 0))
    model.start()
    assert model.best("gruntpig") > 3 and model.best("lumquzzz") > 3 and model.best("bakomi") < 1
    assert toxicity.labelled_sample(d, m, "toxic", 5, 0, 200).count() < 300


# --- 7 ------------------------------------------------------------------------------------------------------------


def brute_links(rows):
    ok = [v is not None and len(v) > 0 and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.float32(rows[i][1]).astype(float), np.float32(rows[j][1]).astype(float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= lattice.LEAST:
                    n[i] += 1
                    n[j] += 1
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return {r[0]: (n[i], rows[find(i)][0]) for i, r in enumerate(rows)}


@pytest.mark.parametrize("block", [2048, 7])
def test_lattice(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    g = np.random.default_rng(3)
    base = g.standard_normal((40, 64))
    rows = [(i, (base[i % 40] + g.standard_normal(64) * g.choice([0.0, 0.05, 0.25, 0.4])).tolist(), i % 2) for i in range(200)]
    rows += [(200 + i, (base[0] + g.standard_normal(64) * 0.02).tolist(), 0) for i in range(40)]
    rows += [(300, None, 0), (301, [0.0] * 64, 0), (302, [float("nan")] * 64, 0), (303, base[0].tolist(), None), (304, [None] * 64, 0), (305, [], 0), (306, [1.0, 2.0], 0), (307, [2.0, 4.0], 0), (308, [float("inf")] * 64, 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    want = brute_links(rows)
    assert len(got) == len(rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(v[0] for v in got.values()) >= 0.97 * sum(v[0] for v in want.values())
    assert all(got[i] == want[i] for i in range(300, 309))


def test_lattice_chains(spark):
    """Components against all pairs that meet in a cell, where linked vectors of cells of FEW and more are no cliques."""
    g = np.random.default_rng(1)
    x = np.float32(g.standard_normal((1, 64)) + 0.3 * g.standard_normal((60, 64))).astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    home, probe = lattice.cells(u)
    link = u @ u.T >= lattice.LEAST
    at = (home[:, None, :, None] == probe[None]).any((2, 3))
    link &= (home[:, None] == home[None]).any(2) | at | at.T
    np.fill_diagonal(link, False)
    assert max(np.unique(home[:, t], return_counts=True)[1].max() for t in range(lattice.TABLES)) >= lattice.FEW
    root = np.arange(60)
    for _ in range(60):
        root = np.minimum(root, np.where(link, root[None], 60).min(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.links(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).collect()}
    assert got == {i: (int(link[i].sum()), int(root[i]), bool(root[i] == i)) for i in range(60)}


def test_lattice_points():
    x = np.random.default_rng(1).standard_normal((300, 8)) * 2
    near, next_ = lattice.e8(x)
    for p in (near, next_):
        half = (p % 2 != 0).any(1)
        assert ((p % 2 != 0).all(1) == half).all() and ((p.sum(1) // 2) % 2 == 0).all()
    d = lambda p: ((p / 2 - x) ** 2).sum(1)
    assert (d(near) <= 1 + 1e-9).all() and (d(near) <= d(next_) + 1e-9).all()


def test_lattice_empty(spark):
    d = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert lattice.links(d).count() == 0


# --- 8 ------------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    full, total = {}, float(sum(sizes.values()))
    while True:
        rest = {s: (total - sum(full.values())) * w[s] / sum(w[x] for x in names if x not in full) for s in names if s not in full}
        over = [s for s in rest if rest[s] > 3 * sizes[s]]
        if not over:
            return full | rest
        full |= {s: 3.0 * sizes[s] for s in over}


def test_mix(spark):
    rows = [(i, prose(rnd.randint(0, 30)) or None, rnd.choice(["b", "B", "é", None, "a", "tiny"] if i % 40 == 0 else ["b", "B", "a"])) for i in range(400)]
    rows += [(500, " \t\n ", "z"), (501, "one\x0btwo\u00a0three", "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(d.repartition(7)).collect()), key=str)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sizes = {}
    for i, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    parts = {r[0]: r[1] for r in mixing.mixture(d).groupBy("doc_id").agg(F.sum(F.col("last_word") - F.col("first_word"))).collect()}
    assert parts == {r["doc_id"]: r["taken"] for r in got if r["taken"]}


def test_schedule(spark, monkeypatch):
    """Every source has its blocks, each rank once, and at any time about its share of the slots so far."""
    monkeypatch.setattr(mixing, "BLOCK", 4)
    d = spark.createDataFrame([(i, prose(8), "ab"[i % 2] if i % 50 else "tiny") for i in range(300)], "doc_id long, text string, source string")
    placed, src = mixing.plan(d)
    got = mixing.slots_of(spark, src).orderBy("slot").collect()
    need = {r["source"]: r["blocks"] for r in src.collect()}
    ranks = {s: [r["rank"] for r in got if r["source"] == s] for s in need}
    assert ranks == {s: list(range(n)) for s, n in need.items()} and need["tiny"] < 60
    for k in range(50, sum(need.values()) * 9 // 10, 50):
        for s in need:
            assert abs(sum(r["source"] == s for r in got[:k]) - k * need[s] / sum(need.values())) < 6


def test_mix_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(d).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, None, None), (1, "", "a")], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in blank] == [(0, 0.0, 0)] * 2


# --- 10 -----------------------------------------------------------------------------------------------------------


def brute_align(a, b):
    t, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = max(0, t[i][j] + (2 if a[i] == b[j] else -1), t[i][j + 1] - 1, t[i + 1][j] - 1)
            best = max(best, t[i + 1][j + 1])
    return best


def test_align():
    for _ in range(80):
        a, b = (np.array([rnd.randint(0, 5) for _ in range(rnd.randint(1, 15))], np.uint64) for _ in range(2))
        assert decontam.align(a, b) == brute_align(a, b)


@pytest.mark.parametrize("most", [2_000_000, 60])
def test_decontamination(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "MOST_SEEDS", most)
    items = [prose(30) for _ in range(6)] + ["solo wordy", None, ""]
    t = [prose(200) for _ in range(20)]
    t += [prose(50) + " " + items[0] + " " + prose(40), prose(30) + " " + changed(items[1], 0.2) + " " + prose(9), items[2].upper().replace(" ", ", "), prose(60) + " " + " ".join(items[3].split()[:5]) + " " + prose(60), "a SOLO wordy b", *ODD]
    t += [prose(5) + " " + items[4] for _ in range(40)]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.check(docs(spark, t), b).collect()}
    hit = {20: 0, 21: 1, 22: 2, 24: 6, **{i: 4 for i in range(25 + len(ODD), 65 + len(ODD))}}
    assert {i: r["item_id"] for i, r in got.items() if r["contaminated"]} == hit
    assert not any(r["contaminated"] for r in decontam.check(docs(spark, t), b.limit(0)).collect())
    assert decontam.check(docs(spark, t).limit(0), b).count() == 0


@pytest.mark.parametrize("copies", [10, 11, 40])
def test_decontamination_of_many_copies(copies):
    """Half an item or an edited one in many documents, beside a stray rare seed, against an alignment of whole texts."""
    half, edited = prose(60), prose(60).split()
    edited[::5] = ["other"] * 12
    items = decontam.Items([0, 1, 2], [half, " ".join(w if i % 5 else word() for i, w in enumerate(edited)), prose(40)])
    text = [prose(40) + " " + " ".join(half.split()[:30]) + " " + prose(9) for _ in range(copies)] + [prose(20) + " " + " ".join(edited) + " " + prose(9) for _ in range(copies)]
    text += [" ".join(half.split()[:30]) + " " + prose(200) + " " + " ".join(half.split()[50:55]), prose(50) + " " + " ".join(half.split()[:5]), prose(80)]
    raw = [t.encode() for t in text]
    w, _, _, first = words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    seed, at = items.hits(w, first)
    doc = np.searchsorted(first, at, "right") - 1
    items.keep_rare(np.bincount(np.unique(np.column_stack([doc, seed]), axis=0)[:, 1], minlength=len(items.first)))
    score, which = decontam.best_matches(items, w, first)
    for i in range(len(text)):
        best = max((brute_align(x, w[first[i] : first[i + 1]]) / (2 * len(x)), -k) for k, x in enumerate(items.words))
        assert (score[i] >= decontam.SCORE) == (best[0] >= decontam.SCORE)
        assert best[0] < decontam.SCORE or (score[i], which[i]) == (best[0], -best[1])
    assert (score >= decontam.SCORE).sum() == 2 * copies + 1


def test_rare_seeds():
    """The limit of each item by one sort, against the definition item by item."""
    items = decontam.Items(list(range(30)), [prose(rnd.randint(1, 30)) for _ in range(30)])
    for top in (0, 3, 60):
        n = np.array([rnd.randint(0, top) for _ in items.first])
        items.keep_rare(n)
        for k in range(len(items.words)):
            mine = n[items.number][items.item == k]
            found = mine[mine > 0]
            most = max(decontam.LEAST_DOCS, decontam.TYPICAL * np.median(found) if len(found) else 0)
            assert (items.rare[items.item == k] == (mine <= most)).all()


def test_repeated_partial_copies():
    """A text that holds parts of an item again and again, aligned window by window, against an alignment of the whole text."""
    item = prose(50)
    w = item.split()
    text = [" ".join(x for _ in range(4) for x in [*w[a : a + 15], *prose(rnd.randint(0, 60)).split()]) for a in (0, 10, 30)] + [" ".join(w[:18] + w[:18] + w[18:40])]
    items = decontam.Items([0], [item])
    raw = [t.encode() for t in text]
    x, _, _, first = words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    items.keep_rare(np.ones(len(items.first), np.int64))
    score, _ = decontam.best_matches(items, x, first)
    for i in range(len(text)):
        best = brute_align(items.words[0], x[first[i] : first[i + 1]]) / (2 * len(w))
        assert score[i] <= best and (score[i] >= decontam.SCORE) == (best >= decontam.SCORE)


# --- words and the pipeline ---------------------------------------------------------------------------------------


def test_words():
    t = ["Ab cd-ÉÈ x9", "", "\u2014q\u00a0r", "zz"]
    raw = [x.encode() for x in t]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    w, s, e, first = words(data, off)
    assert [data[a:b].tobytes().decode() for a, b in zip(s, e, strict=True)] == ["Ab", "cd", "ÉÈ", "x9", "q", "r", "zz"]
    assert first.tolist() == [0, 4, 4, 6, 7]
    alone = words(np.frombuffer("éè".encode(), np.uint8), np.array([0, 4]))[0]
    assert w[2] == alone[0]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    a, b = said("aa", 80), said("bb", 90)
    item = said("cc", 30)
    rows = [(i, said(x, 60), x, f"s{i % 3}") for i, x in enumerate(["aa", "bb", "cc"] * 12)]
    rows += [(100, a, "aa", "s0"), (101, changed(a, 0.005), "aa", "s1"), (102, said("bb", 50) + " " + b[:600], "bb", "s1"), (103, b, "bb", None), (104, said("cc", 40) + " " + item, "cc", "s2"), (105, "12 34 !!", "aa", "s0"), (106, None, None, None), (100, a, "aa", "s0")]
    d = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in cp.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(36), 100, 102, 103}
    assert 0 < out[103]["size"] < 90 and all(r["taken"] <= 3 * r["size"] for r in out.values())
