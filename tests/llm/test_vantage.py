"""Exact clustering by a vantage-point tree."""

import hashlib

import numpy as np
import pytest

from cindergrid.llm import vantage
from cindergrid.llm.queries import QUERIES, SQL

VECTORS = "vec_id bigint, embedding array<float>, cluster string, v int, h string, place int"


def naive(rows, k=8, rounds=10, dimensions=64):
    """vec_id, cluster, distance, cluster_inertia, inertia and digest of (vec_id, vector) rows, with Python integers."""
    kept = []
    for key, vector in rows:
        if vector is not None and len(vector) == dimensions and all(x is not None and np.isfinite(x) for x in vector):
            kept.append((key, [int(np.floor(1024 * float(x))) for x in vector]))
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [list(v) for _, v in start[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for i in range(len(centres)):
            held = [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == i]
            if held:
                centres[i] = [sum(column) // len(held) for column in zip(*held, strict=True)]
    own = assign()
    total = {i: sum(d for d, c in own if c == i) for i in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(key, c, d, total[c], sum(total.values()), digest[c]) for (key, _), (d, c) in zip(kept, own, strict=True)]


def whole(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize(("seed", "k", "width", "spread"), [(0, 1, 3, 4), (1, 2, 2, 3), (2, 9, 1, 5), (3, 40, 2, 6), (4, 200, 5, 1000), (5, 30, 2, 2**40)])
def test_tree_finds_the_nearest_and_the_smaller_of_equals(seed, k, width, spread):
    draw = np.random.default_rng(seed)
    centres = draw.integers(-spread, spread, (k, width))
    centres[k // 2 :: 3] = centres[0]  # repeated centroids
    data = np.concatenate([draw.integers(-spread, spread, (400, width)), centres])
    which, far = vantage.VantageTree(centres).nearest(data)
    for row, c, d in zip(data.tolist(), which.tolist(), far.tolist(), strict=True):
        assert (d, c) == min((sum((a - b) ** 2 for a, b in zip(row, centre, strict=True)), i) for i, centre in enumerate(centres.tolist()))


def test_tree_opens_few_nodes_of_clustered_centroids(monkeypatch):
    draw = np.random.default_rng(1)
    centres = np.concatenate([draw.integers(-20, 20, (16, 3)) + 10_000 * i for i in range(64)])
    seen = 0

    def counted(data, point, real=vantage.squared):
        nonlocal seen
        seen += len(data)
        return real(data, point)

    tree = vantage.VantageTree(centres)
    monkeypatch.setattr(vantage, "squared", counted)
    tree.nearest(centres)
    assert seen < len(centres) ** 2 / 20


def test_odd_vectors(spark):
    good = lambda seed: [float(x) for x in np.random.default_rng(seed).normal(size=64)]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [1e30] * 64]
    rows = [(i, good(i)) for i in range(40)] + [(i, good(i)) for i in range(5)] + [(7, good(99)), (None, good(98)), (None, [0.0] * 64)]
    rows += [(1000 + i, [0.0] * 64) for i in range(30)] + [(2000, [-1e9] * 64), (2001, [3e6] + [0.0] * 63)]
    table = [(key, v, "x", 1, None, i) for i, (key, v) in enumerate(rows + [(500 + i, b) for i, b in enumerate(bad)])]
    made = spark.createDataFrame(table, VECTORS).repartition(5)
    narrow = [(key, [float(np.float32(x)) for x in v]) for key, v in rows]
    expected = [tuple(None if isinstance(x, int) and x > vantage.LARGEST else x for x in r) for r in naive(narrow)]
    assert whole(vantage.vantage_clusters(made).collect()) == whole(expected)
    few = made.where("vec_id in (1, 1000, 503)")
    assert whole(vantage.vantage_clusters(few).collect()) == whole(naive([r for r in narrow if r[0] in (1, 1000)]))
    assert vantage.vantage_clusters(made.where("false")).collect() == []
    assert vantage.vantage_clusters(made.where("vec_id = 502")).collect() == []


def test_equal_vectors_stay_in_the_first_cluster(spark):
    made = spark.createDataFrame([(i, [1.5] * 64, "", 0, "", 0) for i in range(100)], VECTORS)
    rows = vantage.vantage_clusters(made).collect()
    assert len(rows) == 100 and {(r.cluster, r.distance, r.inertia) for r in rows} == {(0, 0, 0)}


def test_query_is_the_naive_one_and_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    got = whole(QUERIES["op11_vantage_clusters"](spark, sf).collect())
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got == whole(naive(rows))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert got == whole(con.execute(SQL["op11_vantage_clusters"]).fetchall())
