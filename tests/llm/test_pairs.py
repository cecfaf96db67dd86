"""Joins and searches against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlog.llm import ngram_join
from cinderlog.llm.components import components
from cinderlog.llm.neighbours import block_top, nearest
from cinderlog.llm.shingles import shingle_sets, word_hashes
from cinderlog.llm.vector_join import block_links, links, unit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(texts, words):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    found = [WORD.findall((t or "").translate(lower)) for t in texts]
    return [{tuple(x[i : i + words]) for i in range(len(x) - words + 1)} if len(x) >= words else {tuple(x)} - {()} for x in found]


def grouped(n, pairs, ids):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    low = {}
    for i in range(n):
        r = find(i)
        low[r] = min(low.get(r, ids[i]), ids[i])
    return [low[find(i)] for i in range(n)]


def copies(seed, groups=12, size=14):
    """Groups of copies with a few changed words, many of them near the limit, and a passage that all groups share."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = draw.choices(vocabulary, k=30)
    texts = []
    for _ in range(groups):
        base = draw.choices(vocabulary, k=draw.choice((12, 60, 110))) + (passage if draw.random() < 0.5 else [])
        for _ in range(size):
            own = list(base)
            for _ in range(draw.choice((0, 0, 1, 1, 2, 2, 3, 4, 6))):
                own[draw.randrange(len(own))] = f"x{draw.randrange(40)}"
            if draw.random() < 0.3:
                del own[draw.randrange(len(own))]
            texts.append(" ".join(own))
    return texts + ["", None, " \t\n", "one", "ONE", "one two three", "One  two\tthree", "a b c d", "a b c d e"]


@pytest.mark.parametrize(("words", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (4, 85, 3), (1, 60, 4)])
def test_jaccard_join_is_exact(spark, words, percent, seed):
    texts = copies(seed)
    ids = random.Random(seed).sample(range(10_000), len(texts))
    own = sets(texts, words)
    pairs = [(i, j) for i in range(len(own)) for j in range(i) if own[i] and own[j] and 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j])]
    want = {i: (len(s), c) for i, s, c in zip(ids, own, grouped(len(own), pairs, ids))}
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3, "doc_id").cache()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs, words, percent).collect()}
    assert got == want


def test_differences_from_the_middle_of_a_group(spark):
    # The hub of group 1 has changes of its own (90 to 93), which are in the difference of all others. Group 2 has no middle.
    rows = [(1, 1, 50, []), *[(1, i, 50, [i * 10, 90, 91, 92, 93]) for i in range(2, 7)], (2, 7, 9, []), (2, 8, 9, [4])]
    members = spark.createDataFrame(rows, "hub long, node long, n long, difference array<long>")
    got = {r.node: (r.hub, r.n, r.difference) for r in ngram_join._centred(members).collect()}
    assert got == {1: (1, 50, [90, 91, 92, 93]), **{i: (1, 50, [i * 10]) for i in range(2, 7)}, 7: (2, 9, []), 8: (2, 9, [4])}
    before = {r[1]: set(r[3]) for r in rows if r[0] == 1}
    assert all(before[i] ^ before[j] == set(got[i][2]) ^ set(got[j][2]) for i in before for j in before)


def test_sets_are_sent_once_and_only_close_ones_kept(spark, monkeypatch):
    """Texts that share a frequent passage are one group, but far from its hub: their differences are not written."""
    shared = " ".join(f"p{i}" for i in range(20))
    texts = [f"{shared} " + " ".join(f"t{k}w{i}" for i in range(60 if k < 8 else 600)) for k in range(10)]
    texts += [f"{texts[k]} more" for k in range(10)]
    columns, held = {}, {}

    def seen(df, label, keep=ngram_join.written):
        out = keep(df, label)
        columns[label], held[label] = out.columns, out.count()
        return out

    monkeypatch.setattr(ngram_join, "written", seen)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).cache()
    got = {r.doc_id: r.component_id for r in ngram_join.link(docs, 4, 85).collect()}
    assert got == {i: i % 10 for i in range(20)}
    assert "hub-sets-pairs" not in held and columns["hub-sets"] == ["node", "hub", "s"]
    assert held["close-pairs"] < held["hub-sets"]


def test_only_differences_from_hubs_are_written(spark, monkeypatch):
    """A set is held against its hub where their texts meet; large groups are dealt over several tasks, each with the hub's text."""
    draw = random.Random(6)
    base = [f"b{i}" for i in range(300)]
    texts = []
    for k in range(40):
        own = list(base)
        own[draw.randrange(300)] = f"x{k}"
        texts += [" ".join(own)] * (1 + k % 2)
    held = {}

    def seen(df, label, keep=ngram_join.written):
        out = keep(df, label)
        if label == "hub-sets":
            held["rows"], held["shingles"] = out.agg(F.count("*"), F.sum(F.size("s"))).first()
        return out

    monkeypatch.setattr(ngram_join, "written", seen)
    monkeypatch.setattr(ngram_join, "MEMBERS", 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()
    assert {r.component_id for r in ngram_join.link(docs, 4, 85).collect()} == {0}
    assert held["rows"] == 39 and held["shingles"] <= 39 * 16


def test_batches_are_cut_into_pieces():
    import pyarrow as pa

    parts = [pa.RecordBatch.from_arrays([pa.array(range(n))], names=["a"]) for n in (0, 3, 2 * ngram_join.ROWS + 1)]
    found = list(ngram_join._pieces(iter(parts)))
    assert max(p.num_rows for p in found) == ngram_join.ROWS
    assert [x for p in found for x in p.column(0).to_pylist()] == [x for p in parts for x in p.column(0).to_pylist()]


def test_jaccard_join_of_odd_tables(spark):
    assert ngram_join.link(spark.createDataFrame([], "doc_id long, text string, row int")).count() == 0
    rows = [(None, "a b c d e f", 1), (5, "a b c d e f", 1), (5, "a b c d e f", 1), (7, None, 2), (None, "", 3)]
    got = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string, node int")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(
        [(None, 2, 5), (5, 2, 5), (5, 2, 5), (7, 0, 7), (None, 0, None)], key=str
    )


def test_words_and_shingles_of_long_texts():
    text = "A  b\tÉ\x0bc\x85d " + "z" * 200_000 + " " + "ab " * 1_200_000 + "z" * 200_000
    hashes, row = word_hashes(["", text, "x"])
    words = WORD.findall(text)
    assert len(hashes) == len(words) + 1 and row[-1] == 2
    assert len(set(hashes.tolist())) == len({w.lower() for w in words} | {"x"})
    assert hashes[5 - 1] == hashes[len(words) - 1]
    assert [len(s) for s in shingle_sets(["a b", "A B c d e", "a b"], 4)] == [1, 2, 1]


def test_components(spark):
    draw = random.Random(5)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = grouped(400, pairs, range(400))
    assert [got.get(i, i) for i in range(400)] == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def odd_vectors():
    draw = np.random.default_rng(3)
    base = draw.normal(size=(12, 8))
    near = base[draw.integers(0, 12, 150)] + draw.normal(size=(150, 8)) * draw.choice([0.02, 0.15, 0.3], size=(150, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(near)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, [2 * x for x in rows[3][1]])]
    rows += [(300, None), (301, [0.0] * 8), (302, [None] + [1.0] * 7), (303, [float("nan")] * 8), (304, [float("inf")] + [0.0] * 7), (305, []), (306, [1.0, 2.0])]
    return rows


def test_nearest_is_exact(spark):
    rows = odd_vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(table, F.col("vec_id") % 20 == 0, 5).collect()
    good = [(i, np.array(v)) for i, v in rows if i < 300]
    want = []
    for i, v in good:
        if i % 20 == 0:
            best = sorted((-(v * w).sum(), j) for j, w in good if j != i)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(w[:3] for w in want)
    assert np.allclose(sorted(r.score for r in got), sorted(w[3] for w in want), rtol=0, atol=1e-12)
    assert nearest(table.limit(0), F.lit(True)).count() == 0


def test_block_bounds_keep_the_best():
    draw = np.random.default_rng(1)
    q, c = draw.normal(size=(30, 16)) * draw.lognormal(size=(30, 1)), draw.normal(size=(2500, 16))
    got = block_top(q, np.arange(30), c, np.arange(1000, 3500), 7)
    exact = (q @ c.T).argsort(axis=1)[:, ::-1][:, :7] + 1000
    assert sorted((n, i) for n, _, i in got) == sorted((n, i) for n in range(30) for i in exact[n].tolist())


def test_metric_join_is_exact(spark, monkeypatch):
    from cinderlog.llm import vector_join

    monkeypatch.setattr(vector_join, "CELL", 25)
    rows = odd_vectors()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    good = [(i, np.array(v)) for i, v in rows if i < 300]
    x = unit(np.array([v for _, v in good]))
    near = (x @ x.T >= 0.9) & ~np.eye(len(good), dtype=bool)
    component = grouped(len(good), zip(*np.nonzero(near)), [i for i, _ in good])
    want = {i: (int(n), c, c == i) for (i, _), n, c in zip(good, near.sum(axis=1), component)}
    want |= {i: (0, i, True) for i, _ in rows if i >= 300 and i != 306} | {306: (0, 306, True)}
    assert got == want


def test_links_of_blocks():
    draw = np.random.default_rng(2)
    x = unit(np.repeat(draw.normal(size=(40, 6)), 20, axis=0) + draw.normal(size=(800, 6)) * 0.2)
    ones = np.ones(800, int)
    near = (x @ x.T >= 0.9) & ~np.eye(800, dtype=bool)
    assert (block_links(x, None, ones, None, 0.9)[0] == near.sum(axis=1)).all()
    counts, label = block_links(x[:300], x[300:], ones[:300], ones[300:] * 2, 0.9)
    assert (counts[:300] == 2 * near[:300, 300:].sum(axis=1)).all() and (counts[300:] == near[:300, 300:].sum(axis=0)).all()
    both = near.copy()
    both[:300, :300] = both[300:, 300:] = False
    assert label.tolist() == grouped(800, zip(*np.nonzero(both)), list(range(800)))


def near_and_scattered(rng, n, d):
    """Half of the vectors scattered, half in groups of near copies of various widths."""
    base = rng.normal(size=(n // 10, d))
    near = base[rng.integers(0, len(base), n // 2)] + rng.normal(size=(n // 2, d)) * rng.choice([0.05, 0.3, 0.34], size=(n // 2, 1))
    return np.concatenate([near, rng.normal(size=(n - n // 2, d))])


def test_metric_join_deals_vectors_a_bounded_number_of_times(spark, monkeypatch):
    """Whole vectors went to every cell that they could matter to, all cells if vectors are scattered, and a batch of them at once."""
    from cinderlog.llm import vector_join

    held, written = {}, vector_join.written

    def seen(df, label):
        back = written(df, label)
        held[label] = back.count()
        return back

    monkeypatch.setattr(vector_join, "written", seen)
    monkeypatch.setattr(vector_join, "CELL", 25)
    x = np.random.default_rng(4).normal(size=(1500, 64))
    got = links(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)).collect()
    assert len(got) == 1500 and all(r.kept and r.n_links == 0 for r in got)
    assert max(held.values()) <= 1500


def test_metric_join_of_many_groups_is_exact(spark, monkeypatch):
    from cinderlog.llm import vector_join

    monkeypatch.setattr(vector_join, "CELL", 20)
    monkeypatch.setattr(vector_join, "STRETCH", 32)
    monkeypatch.setattr(vector_join, "SHORT", 8)
    monkeypatch.setattr(vector_join, "STRIP", 8)
    monkeypatch.setattr(vector_join, "SPARSE", 20)
    monkeypatch.setattr(vector_join, "GATHERED", 4000)
    monkeypatch.setattr(vector_join, "COMPONENTS", 600)
    rng = np.random.default_rng(6)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(near_and_scattered(rng, 500, 12))]
    rows += [(1000 + i, v.astype(np.float32).tolist()) for i, v in enumerate(near_and_scattered(rng, 60, 3))]
    rows += [(2000, rows[3][1]), (2001, rows[3][1]), (None, rows[3][1]), (7, rows[8][1])]
    rows += [(2002, [0.0, 1.0, 2.0]), (2003, [-0.0, 1.0, 2.0]), (None, [9.0, 9.0, -5.0, 1.0]), (2004, None)]
    got = links(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)).collect()
    pairs = []
    for d in {len(v) for _, v in rows if v}:
        at = [k for k, (_, v) in enumerate(rows) if v and len(v) == d]
        x = unit(np.array([rows[k][1] for k in at], float))
        pairs += [(at[i], at[j]) for i, j in zip(*np.nonzero(x @ x.T >= 0.9)) if i != j]
    least = {}
    for k, root in enumerate(grouped(len(rows), pairs, range(len(rows)))):
        least.setdefault(root, []).append((k, rows[k][0]))
    n_links = [0] * len(rows)
    for i, _ in pairs:
        n_links[i] += 1
    want = []
    for members in least.values():
        name = min((i for _, i in members if i is not None), default=None)
        want += [(i, n_links[k], name, i == name) for k, i in members]
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("d", [2, 24, 64, 300])
def test_first_look_misses_nothing(d):
    from cinderlog.llm import vector_join

    rng = np.random.default_rng(d)
    x = unit(near_and_scattered(rng, 1400, d))
    basis, head = vector_join.axes(x[:300], 0.9)
    z, cell = x @ basis, (x @ x[rng.integers(0, 1400, 12)].T).argmax(axis=1)
    near = (x @ x.T >= 0.9) & ~np.eye(1400, dtype=bool)
    some, others = (vector_join.Codes(vector_join.coded(z[p], np.arange(1400)[p], cell[p]), head) for p in (slice(0, 500), slice(500, 1400)))
    vector_join.look(some, others, 0.9)
    for side, linked in ((some, near[:500, 500:].any(axis=1)), (others, near[:500, 500:].any(axis=0))):
        hit = set(side.node[side.hit].tolist())
        assert {int(i) for i in np.flatnonzero(linked) + side.node.min()} <= hit
        close = (x @ x.T >= 0.85)[:500, 500:].any(axis=1 if side is some else 0)
        assert hit <= {int(i) for i in np.flatnonzero(close) + side.node.min()}
    whole = vector_join.Codes(vector_join.coded(z, np.arange(1400), cell), head)
    vector_join.look(whole, whole, 0.9)
    assert set(np.flatnonzero(near.any(axis=1)).tolist()) <= set(whole.node[whole.hit].tolist())


def test_links_of_dense_blocks():
    """Most of a block's pairs are links: they are counted and joined, not listed."""
    draw = np.random.default_rng(8)
    x = unit(np.repeat(draw.normal(size=(2, 16)), 350, axis=0) + draw.normal(size=(700, 16)) * 0.25)
    weight, near = draw.integers(1, 4, 700), (x @ x.T >= 0.9) & ~np.eye(700, dtype=bool)
    counts, label = block_links(x, None, weight, None, 0.9)
    assert near.mean() > 0.2 and (counts == near @ weight).all()
    assert label.tolist() == grouped(700, zip(*np.nonzero(near)), list(range(700)))
    counts, label = block_links(x[:300], x[300:], weight[:300], weight[300:], 0.9)
    assert (counts == np.concatenate([near[:300, 300:] @ weight[300:], weight[:300] @ near[:300, 300:]])).all()
    near[:300, :300] = near[300:, 300:] = False
    assert label.tolist() == grouped(700, zip(*np.nonzero(near)), list(range(700)))
