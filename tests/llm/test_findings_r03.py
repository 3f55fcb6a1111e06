"""Findings of round 3 on the text operators."""

from __future__ import annotations

import numpy as np
import pandas as pd

from larkspur.llm import jaccard_join


def test_two_families_name_few_pairs_between_them():
    """Every pair of 200 texts of two components is near enough; four forests over two components are four pairs."""
    grams = np.arange(1, 101, dtype=np.uint64)
    sketch = jaccard_join.fold(grams, 1024).tobytes()
    nodes = list(range(1, 201))
    lists = pd.DataFrame({"nodes": [np.array(nodes)], "others": [np.array([], np.int64)]})
    seen = pd.DataFrame({"node": nodes, "component": [n % 2 for n in nodes], "n": 100, "sketch": [sketch] * 200})
    found = jaccard_join._candidates(4, 75)(lists, seen)
    assert len(found) == 4 and found["more"].all()
    found = jaccard_join._candidates(20_000, 75)(lists, seen)
    assert len(found) == 100 * 100 and not found["more"].any()


def test_few_sketches_of_unlinked_sets_pass():
    """Sets that share 7 of 10 shingles: the folded sketch may pass them, the finer one does not."""
    draw = np.random.default_rng(3)
    passed = {1: 0, jaccard_join.FINE: 0}
    for _ in range(200):
        grams = draw.integers(1, 1 << 62, 365).astype(np.uint64)
        a, b = grams[:310], grams[55:]  # 255 of 365 shared
        for bits in passed:
            apart = np.unpackbits(jaccard_join.fold(np.sort(a), 512 * bits) ^ jaccard_join.fold(np.sort(b), 512 * bits)).sum()
            passed[bits] += apart <= jaccard_join.most_different(310, 310)
    assert passed[1] > 50 and passed[jaccard_join.FINE] < 5
