from __future__ import annotations

import hashlib
import math
import random

import pytest

from siltstone.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster int, x int, distance string"


def brute(rows, dim, clusters, rounds, scale=1024, seed=3):
    most = centroids.limit(dim)
    kept = [(i, [math.floor(max(-most, min(most, v * scale))) for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centres = [x for _, x in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:clusters]]
    if not centres:
        return []
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda x: min(range(len(centres)), key=lambda k: (far(x, centres[k]), k))
    for _ in range(rounds):
        own = [near(x) for _, x in kept]
        for k in range(len(centres)):
            mine = [x for (_, x), j in zip(kept, own, strict=True) if j == k]
            if mine:
                centres[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    final = [(i, near(x), far(x, centres[near(x)])) for i, x in kept]
    whole = sum(d for *_, d in final)
    return [(i, k, d, sum(e for _, j, e in final if j == k), whole, hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()) for i, k, d in final]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize(("dim", "clusters", "rounds"), [(4, 3, 5), (64, 8, 10), (2, 40, 2)])
def test_against_brute_force(spark, dim, clusters, rounds):
    r = random.Random(dim)
    point = lambda: [r.randrange(-400, 400) / 64 + r.choice([0, 0, 9]) for _ in range(dim)]
    rows = [(i, point()) for i in range(60)] + [(None, point()), (None, point()), (5, point())] + [(100 + i, [0.5] * dim) for i in range(30)]
    rows += [(200, None), (201, []), (202, [0.0] * (dim + 1)), (203, [math.nan] + [0.0] * (dim - 1)), (204, [None] + [0.0] * (dim - 1)), (205, [math.inf] * dim)]
    vectors = spark.createDataFrame([(i, x, 0, 0, "") for i, x in rows], SCHEMA)
    want = brute(rows, dim, clusters, rounds)
    same(centroids.clusters_of(vectors, dim=dim, clusters=clusters, rounds=rounds).collect(), want)
    same(centroids.clusters_of(vectors.repartition(7), dim=dim, clusters=clusters, rounds=rounds).collect(), want)


def test_few_equal_and_large(spark):
    rows = [(i, [1.0, 2.0]) for i in range(5)]
    same(centroids.clusters_of(spark.createDataFrame([(i, x, 0, 0, "") for i, x in rows], SCHEMA), dim=2, clusters=8, rounds=3).collect(), brute(rows, 2, 8, 3))
    rows = [(1, [3e38, -3e38]), (2, [0.0, 0.0]), (2**60 + 1, [-3e38, 3e38])]
    got = centroids.clusters_of(spark.createDataFrame([(i, x, 0, 0, "") for i, x in rows], SCHEMA), dim=2, clusters=1, rounds=1).collect()
    assert {x.vec_id for x in got} == {1, 2, 2**60 + 1} and all(x.distance >= 0 and x.inertia > 0 for x in got)
    none = centroids.clusters_of(spark.createDataFrame([(1, None, 0, 0, "")], SCHEMA))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
