import random
from collections import Counter

import brute
from data import documents
from pyspark.sql import functions as F

from gridwise.llm import decontaminate, quality_classifier
from gridwise.llm.common import components

SCHEMA = "doc_id long, text string"


def leaks(docs, items, least=0.75, n=5):
    out = []
    grams = lambda w: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (Counter([tuple(w)]) if w else Counter())
    for doc, text in docs:
        w = brute.words(brute.lower(text))
        for item, other in items:
            v = brute.words(brute.lower(other))
            b, best, count, size = grams(v), (0, 0), 0, min(len(v), len(w))
            for i in range(len(w) - size + 1) if size else ():
                a = grams(w[i : i + size])
                s = sum((a & b).values()) / sum((a | b).values())
                if s >= least:
                    count += 1
                    best = max(best, (s, -i))
            if count:
                out.append((doc, item, round(best[0], 9), -best[1], size, count))
    return sorted(out)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: f"v{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 8, 20, 33, 33, 60])))) for i in range(30)] + [(98, None), (99, "  ")]
    docs = []
    for d in range(80):
        w = [word() for _ in range(rng.choice([3, 30, 200]))]
        if d % 2:
            leak = rng.choice(items)[1]
            leak = (leak or "").upper().split()
            for _ in range(rng.randrange(0, 3)):
                if leak:
                    leak[rng.choice([0, -1, rng.randrange(len(leak))])] = word()
            at = rng.randrange(len(w))
            w[at:at] = leak * rng.choice([1, 1, 2])
        docs.append((d, " \n".join(w)))
    docs += [(500, None), (501, ""), (502, " ".join(items[4][1].split()[:-1]))]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r[0], r[1], round(r[2], 9), *r[3:]) for r in map(tuple, decontaminate.leaks(df, bench).collect()))
    assert got == leaks(docs, items)
    clean = {r["doc_id"] for r in decontaminate.without_leaks(df, bench).collect()}
    assert clean == {d for d, _ in docs} - {g[0] for g in got}
    assert decontaminate.leaks(df, bench.limit(0)).collect() == [] == decontaminate.leaks(df.limit(0), bench).collect()


def test_classifier_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_classifier.classify(docs, labels)
    assert out.count() == docs.count()
    rows = out.filter("held_out").join(labels, "doc_id").select("quality", "predicted", "score").collect()
    assert len(rows) > 50 and sum(r["quality"] == r["predicted"] for r in rows) / len(rows) > 0.9
    held = {r["doc_id"]: r["held_out"] for r in out.collect()}
    import zlib

    assert all(v == (zlib.crc32(str(k).encode()) % 3 == 1) for k, v in held.items())


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "some text"), (4, "more " * 50)], SCHEMA)
    labels = spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int")
    assert {(r["score"], r["predicted"]) for r in quality_classifier.classify(docs, labels).collect()} == {(0.5, 1)}
    assert quality_classifier.classify(docs.limit(0), labels.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long").withColumn("a", F.col("a"))).collect() == []
