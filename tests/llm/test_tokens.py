"""Counts agree with the library, text by text, whatever the chunks."""

import os

import pytest
from hypothesis import given, settings, strategies as st

os.environ["TOKENIZERS_PARALLELISM"] = "false"

import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from cinderlog.llm.tokens import TokenCounter, count_tokens  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY = open(PATH, encoding="utf-8").read()
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = TokenCounter(VOCABULARY)
TINY = TokenCounter(VOCABULARY, transitions=64, chunk=5)
TEXTS = [
    "", " ", "  ", "\n", " \n ", "a", "it's we'll 'twas I'd've don''t '' 's \n's", "x  y\n\n  z \t\tq ", "12 345½ ²", "<|endoftext|>",
    "a<|endoftext|><|endoftext|> b", "Größe naïve ñandú 你好 世界 🙂🙂", "a b  c\u0085d\x1c e\x1f", "'s", "'S 'LL", "!!!'s ?'re", "́a é",
    "antidisestablishmentarianism " * 3, "a" * 300, "ab" * 200, "." * 100, "word​join﻿", "x'sy'lly", "'l", "'", "a'", "a 'r", "\r\n\r\n x",
]


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(list(texts), add_special_tokens=False)]


@pytest.mark.parametrize("counter", [COUNTER, TINY])
def test_fixed_texts(counter):
    assert counter.counts(TEXTS).tolist() == library(TEXTS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abstrelvmd 'ST\n\t.!19é中🙂<|> "), max_size=40), min_size=1, max_size=8))
def test_any_text(texts):
    assert COUNTER.counts(texts).tolist() == library(texts)
    assert TINY.counts(texts).tolist() == library(texts)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_character(text):
    assert COUNTER.counts([text]).tolist() == library([text])


def test_rows(spark):
    long = "Lines of words, 42 of them.\n" * 9000
    rows = [(1, None, 5), (2, "", 5), (3, "two words", None), (3, "two words", None), (4, long, 1)]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), VOCABULARY).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == [
        (1, 0, 0, False), (2, 0, 0, False), (3, 9, 2, False), (3, 9, 2, False), (4, len(long), library([long])[0], True),
    ]
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0
