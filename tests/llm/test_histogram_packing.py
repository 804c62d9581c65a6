"""The histogram algorithm against one that packs document by document, and what the plan leaves of it."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm import packing

COUNTS = st.dictionaries(st.integers(1, 63), st.integers(1, 40), max_size=25)


def one_by_one(counts, size):
    """Longest first, each into the pack with the smallest total that has room."""
    packs = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fits = [p for p in packs if sum(p) + n <= size]
            if fits:
                min(fits, key=sum).append(n)
            else:
                packs.append([n])
    return Counter(tuple(sorted(p)) for p in packs)


@settings(max_examples=150, deadline=None)
@given(COUNTS)
def test_totals_equal_those_of_single_documents(counts):
    got = Counter()
    for pattern, n in packing.pack_histogram(counts, 64):
        got[tuple(sorted(pattern))] += n
    want = one_by_one(counts, 64)
    # packs of equal totals are equally short: which of them takes a document is free, their totals are not
    assert sorted(sum(p) for p in got.elements()) == sorted(sum(p) for p in want.elements())
    held = Counter()
    for p, n in got.items():
        for length in p:
            held[length] += n
    assert held == Counter(counts)


@settings(max_examples=150, deadline=None)
@given(COUNTS, st.sampled_from([0.0, 0.05]))
def test_uncut_documents_stay_where_the_algorithm_put_them(counts, gap):
    plan = packing.Plan(counts, 64, gap)
    held = defaultdict(list)
    cut = 0
    for n, c in counts.items():
        for rank in range(c):
            parts = plan.place(n, rank)
            uncut = n not in plan.cuts or rank < plan.cuts[n][0][0]
            cut += not uncut
            if uncut:
                assert len(parts) == 1
                held[parts[0][2]].append(n)
    patterns = Counter()
    for p, n in packing.pack_histogram(counts, 64):
        patterns[tuple(sorted(p))] += n
    packs = Counter(tuple(sorted(p)) for p in held.values())
    assert all(n <= patterns[p] for p, n in packs.items())
    assert plan.cut_share == pytest.approx(cut / sum(counts.values())) if counts else plan.cut_share == 0


def test_few_documents_are_cut():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 1024, 5_000), np.minimum(1023, rng.geometric(1 / 300, 5_000)), rng.integers(350, 500, 5_000)):
        counts = dict(Counter(lengths.tolist()))
        plan = packing.Plan(counts, 1024, 0.01)
        gaps = sum((1024 - sum(p)) * n for p, n in packing.pack_histogram(counts, 1024))
        assert plan.cut_share <= 1.6 * gaps / lengths.sum() + 0.04
    many = packing.Plan({n: c * 10**9 for n, c in counts.items()}, 1024, 0.01)
    assert many.cut_share < 0.4  # and it ends: groups are handled at once
