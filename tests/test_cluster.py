import math
import random

import pytest

from lodestone.functions import vectors
from lodestone.operators import cluster


def test_summaries(spark):
    points = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0])], "label int, features array<double>")
    rows = vectors.summaries(points, "label")
    r = rows.select("n", "sum", "sumsq", vectors.centroid().alias("c"), vectors.deviation().alias("sd")).first()
    assert (r.n, list(r["sum"]), list(r.sumsq), list(r.c), list(r.sd)) == (2, [4, 6], [10, 20], [2, 3], [1, 1])
    twice = vectors.merged(rows.unionByName(rows), "label").first()
    assert (twice.n, list(twice["sum"])) == (4, [8, 12])


def test_assign(spark):
    points = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 5.0]), (3, [100.0, 0.0])], "id long, features array<double>")
    clusters = {0: (2, [0.0, 0.0], [2.0, 2.0]), 1: (2, [2.0, 10.0], [4.0, 52.0])}  # sd (1, 1) around (0, 0) and (1, 1) around (1, 5)
    got = {r.id: (r.cluster, r.distance) for r in cluster.assign(points, clusters).collect()}
    assert got[1] == (0, 0.0) and got[2] == (1, 0.0) and got[3] == (-1, None)
    flat = {0: (1, [0.0, 0.0], [0.0, 0.0])}  # no spread: only equal points are near
    assert {r.id: r.cluster for r in cluster.assign(points, flat).collect()} == {1: 0, 2: -1, 3: -1}
    assert {r.cluster for r in cluster.assign(points, {}).collect()} == {-1}


def test_apart():
    a, b = (2, [0.0], [2.0]), (2, [6.0], [20.0])
    assert cluster.apart(a, b) == pytest.approx(3.0)
    assert cluster.merge(a, b) == (4, [6.0], [22.0])
    assert math.isinf(cluster.apart((1, [0.0], [0.0]), (1, [1.0], [1.0])))


def test_bfr_keeps_every_point(spark, scratch):
    rng = random.Random(1)
    points = [(i, [rng.gauss(10 * (i % 3), 1), rng.gauss(-10 * (i % 3), 1)]) for i in range(300)] + [(1000 + i, [500.0 + 50 * i, -900.0]) for i in range(5)]
    report, out = cluster.bfr(spark.createDataFrame(points, "id long, features array<double>"), 3, scratch)
    got = {r.id: r.cluster for r in out.collect()}
    assert set(got) == {i for i, _ in points} and out.count() == len(points)
    for i, n in enumerate([r[1] + r[3] + r[4] for r in report]):
        assert n <= len(points) and report[i][0] == i + 1
    last = report[-1]
    assert last[1] + last[3] + last[4] == len(points)
    assert sum(c >= 0 for c in got.values()) == last[1]
    assert sum(got[i] >= 0 for i in range(300)) > 250


def test_blocks_of_clusters_give_the_same_pairs(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, i % 30, [rng.gauss(i % 30, 2), rng.gauss(0, 1)]) for i in range(600)]
    summaries = vectors.summaries(spark.createDataFrame(rows, "id long, label long, features array<double>"), "label")
    whole = sorted(map(tuple, cluster.merge_candidates(summaries).collect()))
    monkeypatch.setattr(cluster, "FEW", 7)
    assert whole and sorted(map(tuple, cluster.merge_candidates(summaries).collect())) == whole
