"""Near words, forms and roots against comparing all words with all."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cinderlog.llm import spelling
from cinderlog.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def near(a, b):
    """Whether one changed letter turns one word into the other."""
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain_counts(docs, least=7, every=31):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if every and h % every == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            if len(word) >= least:
                counts[word] += 1
    return counts


def plain_variants(counts, times=10):
    """Near words by the words with a letter left out, checked one by one."""
    holes, out = defaultdict(set), {}
    for w in counts:
        for k in range(len(w)):
            holes[w[:k] + w[k + 1 :]].add(w)
    for w, n in counts.items():
        some = {v for k in range(len(w)) for v in holes.get(w[:k] + w[k + 1 :], ())} | holes.get(w, set())
        some |= {w[:k] + w[k + 1 :] for k in range(len(w))} & counts.keys()
        some = [v for v in some if near(w, v)]
        best = min(some, key=lambda v: (-counts[v], v), default=None)
        out[w] = (best if best and counts[best] >= times * n else None, n, len(some))
    roots = {}
    for w in counts:
        end = w
        while out[end][0]:
            end = out[end][0]
        roots[w] = end
    return {(w, f, roots[w], n, k, counts[f] if f else None) for w, (f, n, k) in out.items()}


def made_words(draw, size):
    stems = ["".join(draw.choices("abcdé", k=draw.randrange(1, 12))) for _ in range(size)]
    out = Counter()
    for s in stems + ["aaaaaaa", "aaaaaaaa", "a", "b", "ab", "ba"]:
        out[s] += draw.choice((1, 3, 40, 500))
        for _ in range(3):
            k = draw.randrange(len(s) + 1)
            out[draw.choice((s[:k] + draw.choice("abcüz") + s[k:], s[:k] + s[k + 1 :], s[:k] + "x" + s[k + 1 :]))] += draw.choice((1, 2, 30))
    return {w: n for w, n in out.items() if w}


@pytest.mark.parametrize("group, letters", [(spelling.GROUP, spelling.LETTERS), (3, 1 << 20), (4, 9)])
def test_all_near_words(spark, group, letters):
    counts = made_words(random.Random(group), 150)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = [(r.word, r.near, r.n) for r in spelling.near_words(words, group, letters).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b, counts[b]) for a in counts for b in counts if near(a, b)}
    got = spelling.variants(words, group=group, letters=letters).collect()
    assert {tuple(r) for r in got} == plain_variants(counts) and len(got) == len(counts)


def test_groups_over_batches(spark, monkeypatch):
    counts = made_words(random.Random(9), 400)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {tuple(r) for r in spelling.variants(words).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain_variants(counts)


def test_many_words_that_share_almost_all(spark):
    """One start shared by all words: the first half separates nothing."""
    counts = {"prefixes" + a + b + c: 1 + ord(a) for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvw"}
    counts |= {w[:-1]: 5000 for w in list(counts)[::50]}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r) for r in spelling.variants(words, group=16).collect()} == plain_variants(counts)


def test_odd_rows(spark):
    rows = [("abcdefg", 3), ("abcdefg", 4), (None, 9), ("", 9), ("x" * 5000, 2), ("x" * 4999 + "y", 20), ("x" * 4999, 200)]
    words = spark.createDataFrame([(*r, 1) for r in rows], "word string, n long, form int")
    got = {r.word[-3:] + str(len(r.word)): r for r in spelling.variants(words).collect()}
    assert len(got) == 4 and got["efg7"].n == 7 and got["efg7"].root == "abcdefg" and got["efg7"].n_near == 0
    assert got["xxx5000"].form_n == 200 and got["xxy5000"].form == "x" * 4999 and got["xxx4999"].n_near == 2
    assert spelling.variants(words.limit(0)).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(words, times=1)


def test_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 64)
    monkeypatch.setattr(spelling, "COUNTED", 20)
    draw = random.Random(2)
    words = ["".join(draw.choices("abCDé×Éā中-", k=draw.randrange(1, 20))) for _ in range(400)]
    docs = [(i, " ".join(draw.choices(words, k=draw.randrange(0, 90)))) for i in range(60)] + [(7, None), (8, ""), (3, "abcdefg " * 5000), (3, "Straßenbahnen " * 99)]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, word int")
    for every in (0, 3, 31):
        got = {r.word: r.n for r in spelling.word_counts(frame, 7, every).where("n > 0").collect()}
        assert got == plain_counts(docs, 7, every)
    assert spelling.word_counts(frame.limit(0)).count() == 0
    bare = spelling.word_counts(spark.createDataFrame([(None, "wordwords")], "doc_id long, text string"), every=1)
    assert [len(r.word) for r in bare.collect()] == [8]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    counts = {w: n for w, n in plain_counts(docs).items() if n >= 2}
    got = QUERIES["op13_spelling_variants"](spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(counts) and {tuple(r) for r in got} == plain_variants(counts)
