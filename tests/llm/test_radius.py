"""How far fingerprints of similar windows differ, what the search finds of them, and items in several blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwise.llm import decontaminate

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("n", [7, 8, 13, 14, 30, 100, 400])
def test_radius_holds_the_threshold(n):
    rng = np.random.default_rng(n)
    d = n // 7  # of n shingles of a window, so many are others in the item: similarity (n - d) / (n + d)
    assert (n - d) / (n + d) >= decontaminate.SIMILARITY > (n - d - 1) / (n + d + 1)
    grams = lambda k: rng.integers(0, 1 << 63, k, dtype=np.int64).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, k).astype(np.uint64)
    missed = 0
    for _ in range(1000):
        common = grams(n - d)
        a, b = (decontaminate._fingerprints(decontaminate._bits(np.concatenate((common, grams(d)))).sum(0, keepdims=True))[0] for _ in range(2))
        missed += np.bitwise_count(a ^ b) > decontaminate.radius(n, n)
    assert missed <= 2  # at most one in 10,000 is expected


@pytest.mark.parametrize("words", [24, 34, 104])
def test_unrelated_items_are_not_verified(words):
    """Of windows of 20 shingles and more, fewer than 5 % of unrelated items are within the radius."""
    index = decontaminate.Index([(i, " ".join(f"w{i}_{k}" for k in range(words))) for i in range(500)])
    prints = np.random.default_rng(words).integers(0, 1 << 63, 300, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    found = [len(index.near(words, p, words - 4, True)) for p in prints]
    assert sum(found) < 0.05 * 500 * len(found)
    own = {k: index.items[k][2] for k in range(500)}
    assert all(k in index.near(words, own[k], words - 4, True) for k in range(500))


def test_equal_windows_are_looked_up():
    assert [decontaminate.radius(n, n) for n in range(1, 7)] == [0] * 6
    assert all(15 <= decontaminate.radius(n, n) <= 24 for n in range(7, 300))


def test_blocks_find_all_within_the_radius():
    index = decontaminate.Index([(i, " ".join(f"w{i}_{k}" for k in range(34))) for i in range(300)])
    r = decontaminate.radius(30, 30)
    for p in np.random.default_rng(3).integers(0, 1 << 63, 200, dtype=np.int64).astype(np.uint64):
        want = {k for k in range(300) if np.bitwise_count(index.items[k][2] ^ p) <= r}
        assert set(index.near(34, p, 30, True)) == want


def test_repeated_shingles_keep_the_widest_radius(spark):
    """Items and windows with heavy shingles, similar enough: found whatever their signs."""
    rng, docs, bench = random.Random(4), [], []
    for i in range(60):
        words = [f"a{i}_{k}" for k in range(26)] + [f"rep{i}"] * 8
        bench.append((i, " ".join(words)))
        other = words[:26] + [f"other{i}"] * rng.choice([0, 1]) + [f"rep{i}"] * 8
        docs.append((i, " ".join(other)))
    df, items = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(bench, "item_id long, text string")
    want = set()
    grams = lambda t: decontaminate.Counter(zip(*(t.split()[k:] for k in range(5)), strict=False))
    for d, text in docs:
        size = len(bench[d][1].split())
        w = text.split()
        if any(decontaminate.similarity(grams(" ".join(w[i : i + size])), grams(bench[d][1])) >= 0.75 for i in range(max(1, len(w) - size + 1))):
            want.add((d, d))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, items).collect()} == want and len(want) > 20


def test_fingerprints_by_pieces(monkeypatch):
    grams = np.random.default_rng(2).integers(0, 1 << 63, 500, dtype=np.int64).astype(np.uint64)
    starts = np.array([0, 1, 5, 90, 91, 300, 470])
    want = [decontaminate._fingerprints(decontaminate._bits(grams[i : i + 30]).sum(0, keepdims=True))[0] for i in starts]
    for piece in (1, 7, 100, 10_000):
        monkeypatch.setattr(decontaminate, "PIECE", piece)
        assert decontaminate._prints(grams, starts, 30).tolist() == want


def test_recall_of_planted_windows(spark):
    """Windows edited down to the threshold, each in a document of its own: all of them are found."""
    rng = random.Random(8)
    items = [(i, [f"q{i}_{k}" for k in range(rng.choice([12, 30, 70]))]) for i in range(40)]
    docs = []
    for d in range(400):
        item, words = rng.choice(items)
        words, n = list(words), len(words) - 4
        for k in range(max(0, n // 7 // 5)):  # a replaced word inside costs five shingles
            words[6 + 10 * k] = f"new{d}_{k}"
        docs.append((d, " ".join([f"p{d}_{k}" for k in range(20)] + words + [f"r{d}_{k}" for k in range(20)]), item))
    df = spark.createDataFrame([x[:2] for x in docs], SCHEMA).repartition(4)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench).collect()}
    assert found == {(d, i) for d, _, i in docs}


def test_items_in_blocks(spark, monkeypatch):
    rows = [(i, f"one two three four five six seven item{i}" if i % 2 else f"short {i % 4}") for i in range(9)] + [(4, "short 0")]
    docs = spark.createDataFrame([(1, "x " + rows[3][1] + " y", 1), (2, "nothing here", 2), (3, "a short 0 and short 2 or short 0", 3), (3, None, 3)], SCHEMA + ", item_id int")
    bench = spark.createDataFrame(rows, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    assert [(r[0], r[1], r[5]) for r in whole if r[0] == 3] == [(3, 0, 2), (3, 2, 1), (3, 4, 2), (3, 4, 2), (3, 6, 1), (3, 8, 2)]
    kept = sorted(map(str, decontaminate.without_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 3)
    assert sorted(map(tuple, decontaminate.leaks(docs, bench).collect())) == whole
    assert sorted(map(str, decontaminate.without_leaks(docs, bench).collect())) == kept and len(kept) == 2
    long = docs.select("doc_id", F.concat(F.repeat(F.lit("word "), 300_000), "text").alias("text"))
    assert len(decontaminate.leaks(long, bench).collect()) == len(whole)
