"""Runs against trying all places and periods; agreement of places against going word by word."""

import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlog.llm import periodic
from cinderlog.llm.queries import QUERIES
from cinderlog.llm.recompression import Grammar

SF = "/root/testdata/sf0.001"


def plain_runs(w):
    """Runs by start, then period."""
    found = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(w):
    gone = {i for s, n, p in plain_runs(w) for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def plain_tail(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def made(draw, size):
    w = [draw.randrange(draw.choice((1, 2, 3, 9))) for _ in range(draw.randrange(size))]
    if len(w) > 8 and draw.random() < 0.6:
        x, p = draw.randrange(len(w)), draw.randrange(1, 9)
        w = w[:x] + [w[min(x + i % p, len(w) - 1)] for i in range(len(w) - x)]
        if draw.random() < 0.5:
            w[draw.randrange(len(w))] = 9
    return w


def test_agreement():
    draw = np.random.default_rng(0)
    for names in (2, 3, 50):
        for shape in (draw.integers(0, names, 300), np.repeat(draw.integers(0, names, 40), draw.integers(1, 20, 40)), np.tile(draw.integers(0, names, 11), 30), np.zeros(200, int)):
            w = np.concatenate([[98], shape, [99]])
            x = draw.integers(1, len(w) - 2, 400)
            y = draw.integers(1, len(w) - 1, 400)
            x, y = np.minimum(x, y), np.maximum(x, y)
            x, y = x[x < y], y[x < y]
            grammar = Grammar(w)
            ahead, behind = grammar.agree(x, y), grammar.agree(x, y, -1)
            for a, b, f, k in zip(x.tolist(), y.tolist(), ahead.tolist(), behind.tolist()):
                n = next(i for i in range(len(w)) if w[a + i] != w[b + i])
                m = next(i for i in range(len(w)) if w[a - i] != w[b - i])
                assert (f, k) == (n, m)


@pytest.mark.parametrize("places", [periodic.PLACES, 7])
def test_all_runs(monkeypatch, places):
    monkeypatch.setattr(periodic.grid, "__defaults__", (places,))
    draw = random.Random(places)
    for _ in range(300):
        docs = [made(draw, 70) for _ in range(draw.randrange(1, 6))]
        got = periodic.runs(np.array(sum(docs, []), np.int64), np.array([len(d) for d in docs]))
        for k, d in enumerate(docs):
            assert [r[1:] for r in zip(*(c.tolist() for c in got)) if r[0] == k] == plain_runs(d)


def test_long_runs():
    for w in (np.zeros(30000, int), np.arange(30000) % 7, np.r_[np.arange(9), np.arange(30000) % 5, [3]]):
        found = [c.tolist() for c in periodic.runs(w, np.array([len(w)]))]
        s, n, p = found[1][0], found[2][0], found[3][0]
        assert len(found[0]) == 1 and n >= 29990 and (w[s : s + n - p] == w[s + p : s + n]).all()


def test_rows(spark):
    words = ["a b\x0ba\tb a  b\r\na b é é é é é é x", "é é " * 9, "  a a a a a ", "a a a a a a"]
    texts = [None, "", " \n ", *words, words[0], "one two three " * 60_000]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, runs int")
    for r in periodic.collapse_runs(docs).collect():
        w = (texts[r.doc_id] or "").encode().split()
        assert r.n_words == len(w) and r.text == texts[r.doc_id]
        if len(w) < 1000:
            assert [tuple(x) for x in r.runs] == plain_runs(w) and r.collapsed == plain_collapse([x.decode() for x in w])
        else:
            assert [tuple(x) for x in r.runs] == [(0, 180_000, 3)] and r.collapsed == "one two three"
    assert periodic.collapse_runs(docs.limit(0)).count() == 0


def test_tail_and_most_repeated(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0] + [1, 2]
    draw = random.Random(3)
    texts = [" ".join(draw.choices("abcdefghij", k=draw.randrange(0, 60))) + draw.choice(("", "\t", " x\n")) for _ in ids]
    docs = spark.createDataFrame([*zip(ids, texts), (None, "a b"), (ids[0], None)], "doc_id long, text string")
    for r in docs.select("*", periodic.tail_repeated(F.col("doc_id"), F.col("text")).alias("t")).where("doc_id is not null").collect():
        assert (r.t or "").split() == plain_tail(r.doc_id, r.text)
    runs = [[(5, 12, 3), (1, 8, 2), (2, 8, 2)], [], [(0, 9, 2), (3, 9, 2)], [(0, 10**6 + 1, 10**5), (1, 10**6, 10**5), (2, 10**6 + 1, 10**5)]]
    frame = spark.createDataFrame([(r,) for r in runs], "runs array<struct<start:long,length:long,period:long>>")
    got = [r.m and tuple(r.m) for r in frame.select(periodic.most_repeated(F.col("runs")).alias("m")).collect()]
    assert got == [(5, 12, 3), None, (0, 9, 2), (0, 10**6 + 1, 10**5)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_query(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words = plain_tail(doc_id, text)
        runs = plain_runs(words) if len(words) < 3000 else None
        if runs is None:
            continue
        most = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        r = got[doc_id]
        assert (r.n_runs, r.runs_sha256) == (len(runs), sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)))
        assert (r.start, r.length, r.period) == (most or (None,) * 3) and r.exponent_milli == (most and 1000 * most[1] // most[2])
        assert r.collapsed_sha256 == sha(plain_collapse(words))
