"""The whole-table queries against plain Python on small tables of their own; every row reaches the operator."""

import random
from collections import Counter, defaultdict

from gridwise import plans


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_cells_of_all_orders(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["1-URGENT", "5-LOW"]), rng.randrange(1, 500), float(rng.randrange(0, 400_000))) for _ in range(160)]
    spark.createDataFrame(rows, "o_orderpriority string, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    cells = {(int(t // 4000), c % 40) for _, c, t in rows}
    ids = {c: c[0] * 1000 + c[1] for c in cells}
    label = components(ids.values(), [(ids[a], ids[b]) for a in cells for b in cells if a != b and abs(a[0] - b[0]) <= 3 and abs(a[1] - b[1]) <= 3])
    got = {r["component"]: r["cells"] for r in plans.QUERIES["grp4_cell_components_whole"](spark, str(tmp_path)).collect()}
    assert got == dict(Counter(label.values())) and sum(got.values()) == len(cells)


def test_graph_of_all_lines(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, 1, rng.randrange(200), rng.randrange(90), 1.0, 0.07, 0.01, "A") for k in range(120)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = [(s * 2, p * 2 + 1) for _, _, p, s, *_ in rows]
    want = components({n for e in edges for n in e}, edges)
    got = {r["id"]: r["component"] for r in plans.QUERIES["grp9_structural_graph_whole"](spark, str(tmp_path)).collect()}
    assert got == want and len(set(want.values())) > 1


def test_colour_of_all_samples(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, k % 3, [rng.random() for _ in range(9)]) for k in range(61)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = defaultdict(list)
    for _, frame, e in rows:
        want[frame].append(min(1.0, abs(e[6]) * 4))
    got = {r["frame"]: r["red"] for r in plans.QUERIES["agg21_mean_colour_whole"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[f] - sum(v) / len(v)) < 1e-5 for f, v in want.items())
