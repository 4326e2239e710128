"""Offsets without loops, Douglas-Peucker by rounds and starting centers of clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotab.operators import lines, orient

LINES = "uid long, seq long, x double, y double, z double"


def line_table(spark, *lists):
    return spark.createDataFrame([(u, i, float(x), float(y), 0.0) for u, c in enumerate(lists) for i, (x, y) in enumerate(c)], LINES)


def off(p, line):
    """Distance of a point from a line."""
    a, b = np.array(line[:-1], float), np.array(line[1:], float)
    d = b - a
    t = np.clip(((p - a) * d).sum(1) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
    return np.linalg.norm(p - a - t[:, None] * d, axis=1).min()


def test_lines_that_cross_themselves_are_refused(spark):
    ls = line_table(spark, [(0, 0), (4, 4), (4, 0), (0, 4)], [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(0, 0), (4, 0), (2, 0.5), (2, -1)], [(0, 0), (1, 0), (1, 0), (1, 5)])
    assert sorted(r.uid for r in lines.self_crossing(ls, 1.0).collect()) == [0, 2]
    assert sorted({r.uid for r in lines.offset_lines(ls, 0.1).collect()}) == [1, 3]


@pytest.mark.parametrize("join", ["mitre", "round"])
def test_offsets_have_no_loops(spark, join):
    rng = np.random.default_rng(0)
    wavy = [(x, 3 * np.sin(x) + rng.normal(0, 0.05)) for x in np.linspace(0, 20, 120)]
    turn = [(0, 0), (10, 0), (10, 3), (0, 3)]
    for d in (1.2, -0.8):
        got = lines.offset_lines(line_table(spark, wavy, turn), d, join).toPandas().sort_values(["uid", "seq"])
        for u, base in ((0, wavy), (1, turn)):
            g = got[got.uid == u]
            p = g[["x", "y"]].to_numpy()
            middle = (p[1:] + p[:-1]) / 2
            assert len(p) > 2 and min(off(q, base) for q in middle) > abs(d) * 0.98
            again = lines.self_crossing(line_table(spark, p.tolist()), 1.0)
            assert again.isEmpty()


def test_a_turn_too_narrow_leaves_nothing(spark):
    assert lines.offset_lines(line_table(spark, [(0, 0), (10, 0), (10, 3), (0, 3)], [(0, 9), (5, 9)]), 2.0).select("uid").distinct().collect() == [(1,)]


def peucker(p, tol):
    keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            d = p[b] - p[a]
            t = np.clip((p[a + 1 : b] - p[a]) @ d / max(d @ d, 1e-300), 0, 1)
            o = np.linalg.norm(p[a + 1 : b] - p[a] - t[:, None] * d, axis=1)
            k = int(o.argmax())
            if o[k] > tol:
                keep.add(a + 1 + k)
                todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return sorted(keep)


def test_simplifying_by_rounds_equals_the_plain_way(spark):
    rng = np.random.default_rng(1)
    c = [np.cumsum(rng.normal(0, 1, (n, 2)), axis=0) for n in (2, 3, 40, 500)] + [np.array([(0, 0), (1, 1), (0, 0)])]
    ls = line_table(spark, *c)
    for short in (8, 5000):
        got = lines.simplify_lines(ls, 2.0, short).toPandas()
        for u, p in enumerate(c):
            assert sorted(got[got.uid == u].seq) == peucker(p, 2.0)


def test_starting_centers_are_good_and_repeat(spark):
    rng = np.random.default_rng(2)
    mid = rng.normal(0, 5, (6, 3))
    x = np.concatenate([m + rng.normal(0, 0.4, (int(n), 3)) for m, n in zip(mid, (400, 200, 100, 50, 20, 10))])
    v = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "point_id long, x double, y double, z double")

    def cost(labels):
        return sum(((x[labels == c] - x[labels == c].mean(0)) ** 2).sum() for c in np.unique(labels))

    got = orient.kmeans(v, k=6).toPandas().sort_values("point_id").cluster.to_numpy()
    best = np.inf
    for _ in range(20):
        m = x[rng.choice(len(x), 6, replace=False)]
        for _ in range(50):
            near = ((x[:, None] - m) ** 2).sum(2).argmin(1)
            m = np.array([x[near == k].mean(0) if (near == k).any() else m[k] for k in range(6)])
        best = min(best, cost(near))
    assert cost(got) <= 1.1 * best
    assert orient.kmeans_start(v.repartition(5), 6) == orient.kmeans_start(v.orderBy(F.desc("x")), 6)
    with pytest.raises(ValueError, match="different"):
        orient.kmeans_start(v.where("point_id < 3"), 6)
