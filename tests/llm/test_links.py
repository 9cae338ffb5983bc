"""Numbers of links against every pair of documents."""

import random

import brute
import numpy as np
import pytest
from data import documents

from gridwise.llm import jaccard_join


def counted(docs):
    sets = [brute.shingles(t) for _, t in docs]
    linked = lambda s, t: s and t and 100 * len(s & t) >= 75 * len(s | t)
    return sorted((d, sum(bool(linked(sets[i], sets[j])) for j in range(len(docs)) if j != i)) for i, (d, _) in enumerate(docs))


@pytest.mark.parametrize("seed", [7, 11])
def test_link_counts(spark, seed):
    docs = documents(seed, 140) + [(5, "one two three four"), (900, "ONE two three four")]
    want = counted(docs)
    got = sorted(tuple(r) for r in jaccard_join.link_counts(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect())
    assert got == want and max(n for _, n in want) >= 10 and len({n for _, n in want}) > 3
    assert jaccard_join.link_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("size", [1, 2, 6, 15, 16, 40, 63, 100, 250, 256, 700, 1023])
def test_close_sets_share_signatures(size):
    """Sets that differ in k elements share at least as many signatures as each of them claims."""
    rng = random.Random(size)
    for _ in range(40):
        a = {rng.randrange(1 << 62) for _ in range(size)}
        b = set(a)
        for _ in range(rng.randrange(0, max(1, size // 3) + 1)):
            b.discard(rng.choice(sorted(b))) if b and rng.random() < 0.5 else b.add(rng.randrange(1 << 62))
        sizes = np.array([len(a), len(b)])
        band, wide = jaccard_join.bands(sizes)
        both = max(band)
        if not b or any(band[i] != both and not (wide[i] and band[i] + 1 == both) for i in (0, 1)):
            continue
        sigs = []
        for x in (a, b):
            grams = np.array(sorted(x), np.uint64)
            _, sig, least = jaccard_join._signatures(np.zeros(len(grams), np.int64), grams, np.array([both]), np.array([len(a ^ b)]))
            assert len(set(sig.tolist())) == len(sig)
            sigs.append((set(sig.tolist()), int(least[0])))
        assert len(sigs[0][0] & sigs[1][0]) >= max(sigs[0][1], sigs[1][1])
    k0, k1 = jaccard_join.differences(np.array([size]), jaccard_join.bands(np.array([size]))[0])
    assert 0 <= k0[0] <= k1[0]
    for other in range(max(1, size * 3 // 4 - 1), size * 4 // 3 + 2):
        if min(size, other) * 100 >= 75 * max(size, other):
            most = max(size + other - 2 * i for i in range(min(size, other) + 1) if 100 * i >= 75 * (size + other - i))
            assert most <= (k0 if max(jaccard_join.bands(np.array([size, other]))[0]) == jaccard_join.bands(np.array([size]))[0][0] else k1)[0]
