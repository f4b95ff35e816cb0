"""Coordinates that signatures must share, from the threshold."""

import math

import pytest

from quillspark.llm import minhash_dedup


@pytest.mark.parametrize("percent", [40, 60, 80, 85, 90, 99])
def test_a_pair_at_the_threshold_is_lost_below_one_in_a_million(percent):
    n, p, least = minhash_dedup.COORDS, percent / 100, minhash_dedup.least_matches(percent)
    below = lambda k: sum(math.comb(n, m) * p**m * (1 - p) ** (n - m) for m in range(k))
    assert below(least) < 1e-6 <= below(least + 1)


def test_known_thresholds():
    assert minhash_dedup.least_matches(85) == 16 and minhash_dedup.least_matches(80) <= 13
    assert minhash_dedup.least_matches(100) == minhash_dedup.COORDS and minhash_dedup.least_matches(10) == 1
