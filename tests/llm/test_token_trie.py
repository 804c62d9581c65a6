"""Very long pre-tokens: the same counts, in linear time and without new nodes."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm import queries, token_counts

SCORES = {bytes([b]): -5.0 for b in range(256)} | {b"ab": -6.0, b"abc": -6.5, b"bca": -6.5, b" a": -4.0, b"aaaa": -7.0, "é".encode(): -3.0}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcé", max_size=60), st.integers(1, 20))
def test_the_ring_equals_the_trie(word, long):
    trie = token_counts.CountTrie(SCORES)
    old, token_counts.LONG = token_counts.LONG, long
    try:
        assert trie.insert(word.encode()) == token_counts.brute_count(word, SCORES)[1]
    finally:
        token_counts.LONG = old


@pytest.mark.parametrize("sign", ["x", "qz", "é", "ab", "-=", " "])
def test_one_long_token(sign):
    counter = token_counts.Counter(token_counts.load_scores(queries.vocabulary("byte_bpe_50k.tiktoken")))
    began = time.time()
    n_pre, n = counter.count(sign * (400_000 // len(sign)))
    assert n_pre and n and time.time() - began < 20
    assert len(counter.trie.best) < 3_000
