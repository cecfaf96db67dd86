"""The registered queries over whole small tables, against brute force and the libraries."""

import os
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from cinderlog.llm.queries import QUERIES
from tests.llm.test_pairs import grouped, sets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    column = next(c for c, v in rows[0].asDict().items() if isinstance(v, list))
    return np.array([r.vec_id for r in rows]), np.array([r[column] for r in rows], float)


def library(name):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_op1(spark, documents):
    ids, own = list(documents), sets([r.text for r in documents.values()], 4)
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if own[i] and own[j] and 100 * len(own[i] & own[j]) >= 85 * len(own[i] | own[j])]
    want = {i: (len(s), c) for i, s, c in zip(ids, own, grouped(len(ids), pairs, ids))}
    got = QUERIES["op1_ngram_jaccard_join"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(ids)


def test_op2(spark, vectors):
    ids, x = vectors
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in QUERIES["op2_nearest_neighbours"](spark, SF).collect()}
    queries = [i for i, v in enumerate(ids.tolist()) if v % 20 == 0]
    assert len(got) == 20 * len(queries)
    for i in queries:
        score = x @ x[i]
        score[i] = -np.inf
        for rank, j in enumerate(np.lexsort((ids, -score))[:20], 1):
            assert got[ids[i], rank] == (ids[j], pytest.approx(score[j], abs=1e-12))


def test_op3(spark, documents):
    tokenizer = library("word_bpe_49k.json")
    ids = {i: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for i, r in documents.items()}
    got, held, pieces = QUERIES["op3_best_fit_packing"](spark, SF).collect(), defaultdict(list), defaultdict(int)
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32
        held[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id] += r.length
    assert pieces == {i: len(v) for i, v in ids.items()}
    for places in held.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(held) <= 1.02 * sum(map(len, ids.values())) / 2048 + 1


def test_op4_and_op8(spark, documents):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    known = {r.doc_id: r for r in QUERIES["op4_language_id"](spark, SF).collect()}
    assert {i: r.held_out for i, r in known.items()} == {i: held(i) for i in documents}
    right = [known[i].lang_pred == r.lang for i, r in documents.items() if held(i) and r.lang and re.search(r"[^\W\d_]", r.text or "")]
    assert len(right) > 20 and np.mean(right) > 0.95 and all(0 <= r.score <= 1 for r in known.values())
    scored = {r.doc_id: r for r in QUERIES["op8_quality_classifier"](spark, SF).collect()}
    assert {i: r.held_out for i, r in scored.items()} == {i: held(i) for i in documents}
    assert all(r.predicted == (r.score >= 0.7) for r in scored.values())
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in scored}
    assert np.mean([scored[i].predicted == q for i, q in marks.items()]) > 0.9


def test_op6(spark, documents):
    sizes, source, got = {}, defaultdict(int), QUERIES["op6_source_mixing"](spark, SF).collect()
    for i, r in documents.items():
        sizes[i] = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        source[r.source] += sizes[i]
    names = sorted(s for s in source if s is not None) + [None] * (None in source)
    weight, capped, whole = {s: 1 + k % 3 for k, s in enumerate(names)}, set(), sum(source.values())
    while True:
        level = (whole - sum(3 * source[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if weight[s] * level > 3 * source[s]} - capped
        if not more:
            break
        capped |= more
    taken = defaultdict(int)
    for r in got:
        s = documents[r.doc_id].source
        assert r.size == sizes[r.doc_id] and r.source_size == source[s]
        assert r.target == pytest.approx(3 * source[s] if s in capped else weight[s] * level)
        assert r.taken in {k * r.size for k in range(4)}
        taken[s] += r.taken
    for s in names:
        target = 3 * source[s] if s in capped else weight[s] * level
        own = [n for i, n in sizes.items() if documents[i].source == s]
        assert abs(taken[s] - target) <= max(own) / 2


def test_op9(spark, documents):
    tokenizer = library("byte_bpe_50k.json")
    for r in QUERIES["op9_token_counts"](spark, SF).collect():
        text = documents[r.doc_id].text or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)


def test_op10(spark, vectors):
    ids, x = vectors
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    component = grouped(len(x), zip(*np.nonzero(near)), ids.tolist())
    want = {i: (int(n), c, c == i) for i, n, c in zip(ids.tolist(), near.sum(axis=1), component)}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op10_embedding_near_dedup"](spark, SF).collect()} == want
