"""The interval join of credential parts against a plain model."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm import secrets

PIECES = [
    "user = bob1", "client_id: 'app-17'", "login=" + "n" * 90, "https://api.example.com:8080", "host = db.example.com", "server: " + "a." * 150 + "org", "custom+scheme+of+length://h.org",
    "Ab3dEf6hIj9lMn2pQr5t", "zb3d" * 12, 'token = "abcdefgh"', "0123456789abcdef01234567", "AKIA" + "Z" * 20, "password=https://x.org", "user = 0123456789abcdef01234567", "words", " " * 30, "\n", "é😀",
]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14), st.integers(0, 120))
def test_the_sweep_equals_all_pairs(pieces, scope):
    text = " ".join(pieces)
    base, parts = secrets.base_spans(text), secrets.weak_parts(text)
    assert secrets.link(base, parts, scope) == secrets.brute_link(base, parts, scope)
    assert secrets.scan(text, scope) == (base, secrets.brute_link(base, parts, scope))


@pytest.mark.parametrize("long", ["user = " + "n" * 900, "host = " + "a." * 400 + "org", "user" + " " * 600 + "= bob1"])
def test_parts_have_no_greatest_length(long):
    text = f"{long} Ab3dEf6hIj9lMn2pQr5t https://h.org user = bob1 end"
    assert long in [text[a:b] for a, b, _ in secrets.scan(text)[1]]


@pytest.mark.parametrize("run", ["a+", "user", "host=", "user =", "https://", "a://", "Ab3", "AKIA", "token="])
def test_awkward_runs_take_linear_time(run):
    began = time.time()
    secrets.scan("user = bob1 https://h.org Ab3dEf6hIj9lMn2pQr5t " + run * 60_000)
    assert time.time() - began < 5
