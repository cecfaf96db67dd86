"""Ids and decoded texts agree with the library, text by text."""

import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from cinderlog.llm import piece_bpe
from cinderlog.llm.queries import QUERIES

MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
CODER, FORGETFUL = piece_bpe.PieceBpe(MODEL), piece_bpe.PieceBpe(MODEL)
SF = "/root/testdata/sf0.001"
TEXTS = [
    "", " ", "  ", "a", " a", "a ", "\n", " \n ", "▁", "a▁b ▁", "\x00", "a\x00b", "�", "<s>", "</s> x<unk>", "<0x0A>", "é́ naïve Größe",
    "中文字符 🙂🙂👍🏽", "a" * 999, "ab" * 500, "=-" * 300, " " * 400, "\t\t\t", "word and " * 300, "İıſß", "don't it's 12,345.67",
]


@pytest.mark.parametrize("coder", [CODER, FORGETFUL])
def test_fixed_texts(coder, monkeypatch):
    if coder is FORGETFUL:
        monkeypatch.setattr(piece_bpe, "REMEMBERED", 3)
        monkeypatch.setattr(piece_bpe, "PAIRS", 3)
    for text in TEXTS:
        assert coder.encode(text) == LIBRARY.encode(text), text
        assert coder.decode(coder.encode(text)) == LIBRARY.decode(LIBRARY.encode(text))
    values, counts = coder.encode_many(TEXTS)
    assert counts.tolist() == [len(LIBRARY.encode(t)) for t in TEXTS] and values.tolist() == sum(map(LIBRARY.encode, TEXTS), [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(st.sampled_from("aeinrst TH.,\n▁é中🙂="), max_size=60), st.text(max_size=20)), max_size=5))
def test_any_text(texts):
    values, counts = CODER.encode_many(texts)
    assert values.tolist() == sum(map(LIBRARY.encode, texts), []) and len(counts) == len(texts)


def test_joined_pieces():
    draw = random.Random(5)
    for _ in range(3000):
        text = "".join(draw.choices(CODER.pieces[259:], k=draw.randrange(1, 9)))
        assert CODER.encode(text) == LIBRARY.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([0, 1, 2, 13, 259, 264, 28705]), st.integers(3, 258), st.integers(0, 31999)), max_size=8))
def test_any_ids(ids):
    assert CODER.decode(ids) == LIBRARY.decode(ids)
    rows = [ids, [], ids[:3], [264], ids[1:]]
    got = CODER.decode_many(np.array(sum(rows, []), np.int64), np.array([len(r) for r in rows]))
    assert got.to_pylist() == [LIBRARY.decode(r) for r in rows]


def test_neighbours_fit_exactly_when_merging_keeps_them():
    draw = random.Random(7)
    ids = list(CODER.ids.values())
    for _ in range(4000):
        a, b = draw.choices(ids, k=2)
        symbols = [CODER.ids[c] for c in CODER.pieces[a] + CODER.pieces[b]]
        for _ in CODER.merge(symbols):
            pass
        assert CODER.fits(a, b) == (symbols == [a, b])


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(piece_bpe, "SLICE", 50)
    text = ("word and, 中" * 40 + "x" * 300 + " ") * 3
    assert CODER.encode_many(["", text, "", "a"])[1].tolist()[:3:2] == [0, 0]
    assert CODER.encode(text) == LIBRARY.encode(text)


def test_rows(spark):
    long = "Lines of words, 42 of them.\n" * 60_000
    rows = [(1, None, 5), (2, "", 5), (3, "two words", None), (3, "two words", None), (4, long, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").withColumnRenamed("ids", "decoded")
    got = piece_bpe.decode_ids(piece_bpe.encode_texts(docs, MODEL), MODEL).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in got) == sorted((r[0], len(LIBRARY.encode(r[1] or ""))) for r in rows)
    assert all(r.ids == LIBRARY.encode(r.text or "") and r.decoded == (r.text or "") for r in got)
    both = piece_bpe.encode_and_decode(docs, MODEL).collect()
    assert sorted((r.doc_id, r.ids, r.decoded) for r in both) == sorted((r.doc_id, r.ids, r.decoded) for r in got)
    assert piece_bpe.encode_texts(docs.limit(0), MODEL).count() == 0
    bare = spark.createDataFrame([(None,), ([],), ([72, 101],), ([259, 264],)], "ids array<int>")
    assert [r.decoded for r in piece_bpe.decode_ids(bare, MODEL).collect()] == ["", "", LIBRARY.decode([72, 101]), LIBRARY.decode([259, 264])]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_query(spark):
    got = {r.doc_id: r for r in QUERIES["op12_sentencepiece_coding"](spark, SF).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = LIBRARY.encode(text or "")
        r = got[doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)))
