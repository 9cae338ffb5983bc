"""Importance resampling against plain Python, with awkward rows, many runs and merges of merges."""

import heapq
import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from data import documents

from gridwise.llm import importance as imp

TARGET = ["w1 w2 w3 w1 Ärger 3.14", None, "", "w7 w8 " * 30, "don't"]


def words(text):
    return re.findall(imp.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text, most):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, percent=10, most=1, buckets=imp.BUCKETS, seed=2024, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, most))
    t = Counter(bucket(f) for x in target for f in features(x, most))
    S, T = float(s.total()), float(t.total())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets))))
    rows = []
    for i, text in docs:
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        f = features(text, most)
        weight = sum(gain(bucket(x)) for x in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= least])
    order = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(order[: len(order) * percent // 100]):
        r[4] = rank + 1
    return sorted(map(str, (tuple(r[:5]) for r in rows)))


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


AWKWARD = documents() + [(None, "w1 w2 " * 40)] * 9 + [(3, "w9 " * 50)] * 5 + [(5000 + i, "w1 w2 w3 " * 20) for i in range(60)] + [(-7, "x" * 700 + " " + "y" * 256 + " z" * 25), (9001, "Ab\x00cD\x7fe-f " * 30)]


@pytest.mark.parametrize("percent,most,range_rows", [(10, 1, 10_000), (60, 2, 7), (100, 3, 20), (0, 1, 5)])
def test_equals_plain(spark, monkeypatch, percent, most, range_rows):
    monkeypatch.setattr(imp, "RUN_ROWS", 20)
    monkeypatch.setattr(imp, "FAN_IN", 4)
    rows = AWKWARD if most == 1 else AWKWARD[:14] + AWKWARD[15:]
    docs = spark.createDataFrame([(i, t, 1, "r", 9) for i, t in rows], "doc_id long, text string, row int, bucket string, score int").repartition(11)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert got(imp.resample(docs, target, percent=percent, most=most, range_rows=range_rows)) == plain(rows, TARGET, percent, most)


def test_empty(spark):
    docs, target = spark.createDataFrame(AWKWARD[:40], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert got(imp.resample(docs, target)) == plain(AWKWARD[:40], [])
    assert imp.resample(docs.limit(0), target).collect() == []


def test_reruns_agree(spark):
    docs, target = spark.createDataFrame(AWKWARD, "doc_id long, text string"), spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert got(imp.resample(docs.repartition(3), target, 40, range_rows=9)) == got(imp.resample(docs.repartition(8, "text"), target, 40, range_rows=30))


def test_crc32():
    rng = random.Random(1)
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in (1, 2, 3, 7, 255, 256, 257, 900)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    end = np.cumsum([len(p) for p in parts])
    assert imp.crc32_of(data, end - [len(p) for p in parts], end).tolist() == [zlib.crc32(p) for p in parts]


def test_merge_reads_no_more_than_it_owes():
    """Blocks of a run past the last owed row stay unread; each run has one block in memory at a time."""
    rng = random.Random(2)
    runs = [sorted((rng.randrange(50), 0, rng.randrange(9), 0, r * 1000 + i) for i in range(200)) for r in range(7)]
    blocks = sorted((k[lo], r, lo) for r, k in enumerate(runs) for lo in range(0, 200, 10))
    read = []

    def stream():
        for first, r, lo in blocks:
            read.append(r)
            yield r, first, imp.packed_block(np.array(runs[r][lo : lo + 10]), np.arange(10))

    want = list(heapq.merge(*runs))
    for owed in (0, 1, 30, 137, 1400, 5000):
        read.clear()
        out = [k for keys, _ in imp.merged(stream(), 7, owed) for k in keys]
        assert out == want[:owed]
        assert owed > 137 or len(read) <= owed // 10 + 2 * 7


@pytest.mark.parametrize("slots", [1, 2, 3, 8, 13])
def test_tournament(slots):
    rng, tree, keys = random.Random(slots), imp.Tournament(slots), {}
    for _ in range(300):
        slot, key = rng.randrange(slots), rng.choice([None, (rng.randrange(100), 0, 0, 0, rng.randrange(10**6))])
        tree.put(slot, key)
        keys[slot] = key
        held = sorted((k, s) for s, k in keys.items() if k is not None)
        assert (tree.key[tree.winner()], tree.next_best()) == (held[0][0] if held else None, held[1][0] if len(held) > 1 else None)
