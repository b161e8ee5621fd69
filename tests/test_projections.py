"""Search by sign random projections: recall, share of rows scored, special vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.operators import projections as P


def clustered(rng, n, dim, centres):
    c = rng.normal(size=(centres, dim))
    return c[rng.integers(0, centres, n)] + 0.5 * rng.normal(size=(n, dim))


def test_recall_and_share_of_rows(spark):
    rng = np.random.default_rng(3)
    v = clustered(rng, 8000, 64, 400)
    v[100:140] = v[100]
    rows = [(i, [float(x) for x in v[i]]) for i in range(8000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = df.where("vec_id % 80 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    index = P.build(df, "vec_id", "embedding", 64)
    got = {}
    for r in P.search(index, asked, 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        s = np.round(u @ u[q], 6)
        want = np.lexsort((np.arange(8000), -s))[:10]
        hits += len({i for _, i, _ in found} & set(want.tolist()))
        assert [r for r, _, _ in sorted(found)] == list(range(1, len(found) + 1)) and all(abs(s[i] - c) < 2e-6 for _, i, c in found)
        assert sorted(found) == sorted(found, key=lambda x: (-x[2], x[1]))
    scored = P.candidates(index, asked).count() / (100 * 8000)
    assert hits / 1000 >= 0.9 and scored < 0.1, (hits / 1000, scored)


def test_special_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0]), *[(100 + i, [0.0, 1.0]) for i in range(50)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = P.build(df, "vec_id", "embedding", 2, most=5)
    asked = df.where("vec_id < 101").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in P.search(index, asked, 5).collect() if r.score > 0.9)
    assert got == [(1, 1, 1), *[(100, i + 1, 100 + i) for i in range(5)]]
    assert index.table(spark, "buckets").count() == 2 * P.TABLES  # fifty equal vectors are one class
    with pytest.raises(ValueError):
        P.search(index, asked, 6)
    assert P.search(P.build(df.limit(0), "vec_id", "embedding", 2), asked, 3).count() == 0


def test_probes_are_the_nearest_planes():
    planes = P.Planes(8, 3, 6)
    units = np.random.default_rng(1).normal(size=(20, 8))
    sides, codes = planes.sides(units), planes.buckets(units, 4)
    for v in range(20):
        for t in range(3):
            own = sum(1 << i for i in range(6) if sides[v, t, i] > 0)
            cost = lambda c: sum(sides[v, t, i] ** 2 for i in range(6) if (c ^ own) >> i & 1)  # noqa: E731, B023
            near = sorted((cost(c), c) for c in range(64) if 1 <= bin(c ^ own).count("1") <= 2)[:4]
            assert codes[v, t, 0] == own and sorted(codes[v, t, 1:]) == sorted(c for _, c in near)
