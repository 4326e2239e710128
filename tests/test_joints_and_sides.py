"""Signed sides of surfaces, joints of lines, sections against blocks and crowded clouds, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotab.operators import cells, lines, mesh, points, sections

POINTS = "uid int, point_id long, x double, y double, z double"
CELLS = "uid int, cell_id long, p0 long, p1 long, p2 long"
LINES = "uid long, seq long, x double, y double, z double"


def surface(spark, xyz, tri, uid=0):
    p = spark.createDataFrame([(uid, i, *map(float, c)) for i, c in enumerate(xyz)], POINTS)
    return p, spark.createDataFrame([(uid, i, *map(int, t)) for i, t in enumerate(tri)], CELLS)


def sides(spark, xyz, tri, asked, cell=0.7):
    p = spark.createDataFrame([(9, i, *map(float, c)) for i, c in enumerate(asked)], POINTS)
    got = {r.point_id: r.distance for r in mesh.nearest_distance(p, *surface(spark, xyz, tri), cell).collect()}
    return np.array([got[i] for i in range(len(asked))])


def test_roof_has_one_side_above_its_ridge(spark):
    xyz = [(0, -10, 0), (0, 10, 0), (-2, -10, -10), (-2, 10, -10), (2, -10, -10), (2, 10, -10)]
    tri = [(0, 1, 2), (1, 3, 2), (1, 0, 4), (1, 4, 5)]
    d = sides(spark, xyz, tri, [(0.5, 0, 1), (-0.5, 0, 1), (0, 0, 2), (0, 0, -1), (0.1, 3, -2), (0, 0, 0)])
    assert np.allclose(d[:3], [np.hypot(0.5, 1), np.hypot(0.5, 1), 2]) and (d[3:5] < 0).all() and d[5] == 0


def box():
    xyz = [(x, y, z) for x in (0, 2) for y in (0, 2) for z in (0, 2)]
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    return xyz, [t for a, b, c, d in quads for t in ((a, b, c), (a, c, d))]


def test_box_is_negative_inside_only(spark):
    rng = np.random.default_rng(0)
    asked = rng.uniform(-2, 4, (400, 3))
    asked[:40] = np.where(asked[:40] > 1, 2.5, -0.5)  # off the corners
    d = sides(spark, *box(), asked)
    off = np.maximum(np.maximum(-asked, asked - 2), 0)
    inside = (off == 0).all(1)
    want = np.where(inside, -np.minimum(asked, 2 - asked).min(1), np.linalg.norm(off, axis=1))
    assert np.allclose(d, want) and inside.any()


def test_rough_surface_has_the_sides_of_its_heights(spark):
    rng = np.random.default_rng(1)
    n = 9
    h = rng.uniform(0, 6, (n, n))
    xyz = [(i, j, h[i, j]) for i in range(n) for j in range(n)]
    tri = [t for i in range(n - 1) for j in range(n - 1) for t in ((i * n + j, (i + 1) * n + j, (i + 1) * n + j + 1), (i * n + j, (i + 1) * n + j + 1, i * n + j + 1))]
    asked = np.column_stack((rng.uniform(2, 6, (300, 2)), rng.uniform(1, 5, 300)))
    i, j = asked[:, 0].astype(int), asked[:, 1].astype(int)
    u, v = asked[:, 0] - i, asked[:, 1] - j
    at = np.where(u >= v, h[i, j] * (1 - u) + h[i + 1, j] * (u - v) + h[i + 1, j + 1] * v, h[i, j] * (1 - v) + h[i, j + 1] * (v - u) + h[i + 1, j + 1] * u)
    d = sides(spark, xyz, tri, asked, 1.5)
    assert ((d > 0) == (asked[:, 2] > at)).all()
    # vertices given twice, in triangles of their own, make no difference
    again = [xyz[k] for t in tri for k in t]
    assert np.allclose(sides(spark, again, [(3 * k, 3 * k + 1, 3 * k + 2) for k in range(len(tri))], asked, 1.5), d)


def test_each_point_is_measured_to_the_surface_it_names(spark):
    up, side = [(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(5, 0, 0), (5, 1, 0), (5, 0, 1)]
    p = spark.createDataFrame([(7, 0, 0.1, 0.1, 3.0, 0), (7, 1, 0.1, 0.1, 3.0, 1), (7, 2, 0.1, 0.1, 3.0, 2), (7, 3, None, 0.0, 0.0, 0)], POINTS + ", ref int")
    a, b = surface(spark, up, [(0, 1, 2)], 0), surface(spark, side, [(0, 1, 2)], 1)
    got = {r.point_id: r.distance for r in mesh.nearest_distance(p, a[0].union(b[0]), a[1].union(b[1]), 1.0).collect()}
    assert abs(got[0] - 3) < 1e-9 and abs(got[1]) > 4.9 and got[2] is None and got[3] is None


# ---------------------------------------------------------------- joints


def line_table(spark, *lists):
    return spark.createDataFrame([(u, i, float(x), float(y), float(i)) for u, c in enumerate(lists) for i, (x, y) in enumerate(c)], LINES)


def test_a_line_that_ends_short_of_another_cuts_it(spark):
    ls = line_table(spark, [(0, 0), (4, 0), (10, 0)], [(5, -3), (5, -0.01)], [(7, 5), (7, 1), (7.5, 0.5)], [(2, -1), (2, 1)], [(20, 3), (21, 9)])
    got = lines.split_lines(ls.where("uid = 0"), ls.where("uid <> 0"), 1.0).toPandas()
    cuts = got[got.cut == 1].drop_duplicates("at").sort_values("at")
    # uid 4 points past the line, by less than its hundredfold length: its downward ray meets y = 0 beyond x = 10
    assert np.allclose(cuts.x, [2, 5, 8]) and np.allclose(cuts.y, 0, atol=1e-9)
    assert np.allclose(cuts.z, [0.5, 1 + 1 / 6, 1 + 4 / 6]) and got.part.max() == 3


def test_crossings_match_brute_force_at_any_cell_size(spark):
    rng = np.random.default_rng(5)
    c = [rng.uniform(-20, 20, (int(rng.integers(2, 9)), 2)) for _ in range(25)]
    c += [[(-30, 0), (30, 0)], [(0, -30), (0, 30)], [(-5, -5), (5, 5)], [(0, 0), (0, 0), (3, 1)]]
    ls = line_table(spark, *c)
    want = set()
    for a in range(len(c)):
        for b in range(a + 1, len(c)):
            for p, q in zip(c[a], c[a][1:]):
                for s, t in zip(c[b], c[b][1:]):
                    p_, q_, s_, t_ = map(np.asarray, (p, q, s, t))
                    m = np.array([q_ - p_, s_ - t_], float).T
                    if abs(np.linalg.det(m)) > 1e-12:
                        k = np.linalg.solve(m, s_ - p_)
                        if ((k >= -1e-8) & (k <= 1 + 1e-8)).all():
                            want.add((a, b, *np.round(p_ + k[0] * (q_ - p_), 4) + 0.0))
    for cell in (0.9, 7.0, 100.0):
        got = lines.segment_intersections(ls, cell).collect()
        assert len(got) == len(want)
        assert np.allclose(sorted((r.a, r.b, r.x, r.y) for r in got), sorted(want), atol=1e-4)


def test_snapping_trims_branches_extends_ends_and_adds_nodes(spark):
    ls = line_table(spark, [(0, 0), (10, 0)], [(3, -4), (3, 0.1), (3, 0.3)], [(6, 4), (6, 0.4)], [(8, 3), (8, 2)], [(9, -1), (9, 1)])
    got = lines.snap_lines(ls, 0.5, 1.0).toPandas().sort_values(["uid", "at"])
    rows = {u: [(int(s), round(x, 9) + 0.0, round(y, 9) + 0.0) for s, x, y in zip(g.seq, g.x, g.y)] for u, g in got.groupby("uid")}
    assert rows[0] == [(0, 0, 0), (2, 3, 0), (3, 6, 0), (1, 10, 0)]
    assert rows[1] == [(0, 3, -4), (1, 3, 0)] and rows[2] == [(0, 6, 4), (1, 6, 0)]
    assert rows[3] == [(0, 8, 3), (1, 8, 2)] and rows[4] == [(0, 9, -1), (1, 9, 1)]
    assert not got[(got.uid == 3) | (got.uid == 4)].snapped.any()


# ---------------------------------------------------------------- sections and crowds


def test_planes_meet_all_rows_they_should_and_no_others(spark, monkeypatch):
    monkeypatch.setattr(sections, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.normal(0, 1, (400, 3)), rng.uniform(-50, 50, (600, 3))))
    p = spark.createDataFrame([(0, i, *map(float, v)) for i, v in enumerate(x)] + [(0, 5000, None, 1.0, 1.0)], POINTS)
    s = spark.createDataFrame([(k, f"s{k}", float(37 * k % 360), float(90 - 10 * (k % 5)), float(k - 4), 2.0, 0.0, 10.0, 10.0) for k in range(8)], "uid long, name string, strike double, dip double, origin_x double, origin_y double, origin_z double, length double, height double")
    near = sections.project(p, s, max_dist=3.0)
    every = p.crossJoin(sections._named(s))
    d = F.abs(sum(((F.col(c) - F.col("origin_" + c)) * F.col("w" + c) for c in "xyz"), F.lit(0.0)))
    want = {(r.point_id, r.section) for r in sections.project(p, s).where("distance <= 3").collect()}
    assert {(r.point_id, r.section) for r in near.collect()} == want and len(want) > 500
    met = sections.beside_planes(p, [("x", "y", "z")], sections._named(s), 0.5)
    assert every.where(d <= 0.5).count() == met.where(d <= 0.5).count()
    even = p.where("point_id >= 400")
    assert sections.beside_planes(even, [("x", "y", "z")], sections._named(s), 0.5).count() < 8 * 600 / 2
    cut = sections.cut_lines(lines.segments(p.select("uid", F.col("point_id").alias("seq"), "x", "y", "z")), s)
    assert "Cross" not in cut._jdf.queryExecution().optimizedPlan().toString()


def crowded(spark):
    """Half of the points in one spot of many, some coinciding."""
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(0, 1e-3, (300, 3)), np.zeros((150, 3)), rng.uniform(-9, 9, (400, 3)), [[100.0, 0, 0]]))
    return spark.createDataFrame([(0, i, *map(float, v)) for i, v in enumerate(x)] + [(1, 0, 1.0, 1.0, 1.0), (1, 1, 2.0, 1.0, 1.0)], POINTS), x


@pytest.mark.parametrize("leaf", [16, 1000])
def test_nearest_of_a_crowd(spark, leaf):
    p, x = crowded(spark)
    got = points.knn(p, 4, leaf).toPandas()
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :4]
    mine = got[got.uid == 0].sort_values(["a", "rank"])
    assert np.allclose(mine.distance.to_numpy().reshape(-1, 4), np.take_along_axis(d, order, 1))
    assert (mine.b.to_numpy().reshape(-1, 4) == order).mean() > 0.99  # but for rounding among near ties
    assert got[got.uid == 1][["a", "b", "distance", "rank"]].values.tolist() == [[0, 1, 1, 1], [1, 0, 1, 1]]


def test_cells_hold_about_equal_shares():
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(0, 1e-4, (5000, 3)), rng.uniform(-9, 9, (5000, 3))))
    s = cells.Splits(x[::4], 50)
    n = np.bincount(s.leaf(x), minlength=s.leaves)
    assert s.leaves == 50 and n.max() < 4 * n.mean()
    # a ball's leaves hold all of its points
    for i, found in enumerate(s.near(x[:20], np.full(20, 0.5))):
        assert set(s.leaf(x[np.linalg.norm(x - x[i], axis=1) <= 0.5])) <= set(found.tolist())


@pytest.mark.parametrize("r", [0.01, 0.7, 2.0])
def test_clusters_of_a_crowd(spark, r):
    p, x = crowded(spark)
    got = points.radius_clusters(p, r).where("uid = 0").toPandas().sort_values("point_id")
    root = np.arange(len(x))
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= r
    while True:
        new = np.array([root[k].min() for k in near])
        if (new == root).all():
            break
        root = new
    names = {low: k for k, low in enumerate(sorted(set(root)))}
    assert got.cluster_id.tolist() == [names[k] for k in root]


def test_pairs_of_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(points, "CROWD", 32)
    p, x = crowded(spark)
    got = {(r.a, r.b) for r in points.radius_neighbors(p.where("uid = 0"), 0.5).collect()}
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.5
    assert got == {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}
