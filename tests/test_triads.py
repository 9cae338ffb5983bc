"""Best triads against every triple, with ties; the third join only sees the best partners."""

import random

from gridwise.plans import aggregates


def test_partners_hold_every_best_triple(spark):
    rng = random.Random(5)
    cut = lambda: round(rng.random(), 1)  # noqa: E731  ties
    b = [(w, k, cut(), cut()) for w in range(12) for k in range(60)]
    c = [(w, k, cut(), cut()) for w in range(12) for k in range(60)]
    some = lambda rows: [tuple(r) for r in aggregates._partners(spark.createDataFrame(rows, "w long, k long, u double, v double").repartition(3), "w", "k", "u", "v").select("w", "k", "u", "v").collect()]
    few_b, few_c = some(b), some(c)
    assert len(few_b) < len(b) / 5 and len(few_c) < len(c) / 5

    def best(bs, cs, w):
        return min((-round(0.46 * u + 0.24 * v * z + 0.3 * x, 9), i, j) for ww, i, u, v in bs if ww == w for w3, j, x, z in cs if w3 == w)

    assert all(best(b, c, w) == best(few_b, few_c, w) for w in range(12))


def test_a_frame_of_many_samples_finishes(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, 0, [rng.gauss(0, 1) for _ in range(9)]) for k in range(2_000)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(8).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert len(aggregates.agg27(spark, str(tmp_path)).collect()) == 800  # 288 million triples


def test_few_pairs_leave_their_block(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "BLOCK", 40)
    rng = random.Random(7)
    cut = lambda: round(rng.uniform(-1, 1), 1)  # noqa: E731  ties
    make = lambda n, at: [(k % 2, at + k, cut(), cut(), cut(), abs(cut())) for k in range(n)]
    a, b = make(90, 0), make(400, 1_000)
    b += [(f, 5_000 + i, *rest) for f, i, *rest in b]  # copies
    schema = "frame int, id long, nx double, ny double, nz double, red double"
    for turned in (False, True):
        got = aggregates._likely(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), turned).collect()
        assert 0 < len(got) < len(a) * len(b) / 2 / 10
        found = {(r["wall"], r["other"]) for r in got}
        for frame, i, *n, _ in a:
            u = {q[1]: (lambda d: 1 - abs(d) if turned else abs(d))(sum(x * y for x, y in zip(n, q[2:5], strict=True))) for q in b if q[0] == frame}
            v = {q[1]: q[5] for q in b if q[0] == frame}
            front = {j for j in u if not any(u[k] > u[j] + 1e-7 and v[k] >= v[j] for k in u)}
            assert all(any((i, k) in found for k in front if abs(u[k] - u[j]) < 1e-12 and v[k] == v[j]) for j in front)
