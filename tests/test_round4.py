"""Findings of the third round: medoids that go round, nearest nodes, sections in one plane, counts within a radius."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from geotab import registry
from geotab.operators import graph, grids, orient, points, sections

Q, TWINS = registry.queries(), registry.oracle_sql()


def test_medoids_that_go_round_end_as_after_the_last_round(spark, monkeypatch):
    v = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(4)], "point_id long, x double, y double, z double")
    a, b, c = [(0.0, 0.0, 0.0)], [(1.0, 0.0, 0.0)], [(2.0, 0.0, 0.0)]
    after = {a[0]: b, b[0]: c, c[0]: b}  # 0, then 1, 2, 1, 2, ...
    calls, seen = [], {}
    monkeypatch.setattr(orient, "_medoids", lambda data, block: calls.append(1) or {0: after[seen["now"]][0]})
    assign = orient.assign

    def spy(data, centers):
        seen["now"] = tuple(centers[0])
        return assign(data, centers)

    monkeypatch.setattr(orient, "assign", spy)
    for rounds, last in ((1, b), (2, c), (99, b), (100, c)):
        calls.clear()
        orient.kmedoids(v, a, rounds=rounds)
        assert seen["now"] == last[0] and len(calls) <= 3


def test_nearest_nodes_of_far_points_come_from_few_of_them(spark, monkeypatch):
    rng = np.random.default_rng(7)
    xy = rng.integers(0, 40, (3000, 2)).astype(float)  # many ties and doubled places
    at = np.vstack((rng.integers(-10, 60, (400, 2)), rng.normal(size=(50, 2)) * 5000, [[1e6, -1e6]])).astype(float)
    nodes = spark.createDataFrame([(i, *map(float, p), float(i)) for i, p in enumerate(xy)], "node long, x double, y double, z double")
    p = spark.createDataFrame([(i % 3, i, *map(float, q)) for i, q in enumerate(at)] + [(0, 9999, None, 1.0)], "uid long, point_id long, x double, y double")
    d = np.sqrt(((at[:, None] - xy[None]) ** 2).sum(2))
    want = dict(enumerate(d.argmin(1).astype(float)))
    asked = []
    near = grids.cells.leaves_near
    monkeypatch.setattr(grids.cells, "leaves_near", lambda df, splits, r: asked.append(max(s.leaves for s in splits.values())) or near(df, splits, r))
    got = {r.point_id: r.z for r in grids.drape_irregular(p, nodes, leaf=32).collect()}
    assert got == want and asked[0] > 20
    assert {r.z for r in grids.drape_irregular(p, nodes.limit(0)).collect()} == {None}


def test_sections_in_one_plane_are_cut_once(spark, tmp_path, monkeypatch):
    d = duckdb.connect()
    small = "/root/testdata/sf0.001"
    d.execute(f"copy (select * from '{small}/part.parquet') to '{tmp_path}/part.parquet' (format parquet)")
    # 360 keys later a section lies in the same plane; the one without a key has none
    d.execute(f"copy (select (k + 360 * i)::BIGINT as s_suppkey from range(3) a(k), range(4) b(i) union all select null) to '{tmp_path}/supplier.parquet' (format parquet)")
    for f in os.listdir(tmp_path):
        d.execute(f"create view {f[:-8]} as select * from '{tmp_path}/{f}'")
    met = []
    beside = sections.beside_planes
    monkeypatch.setattr(sections, "beside_planes", lambda data, corners, planes, reach=0.0: met.append(planes.count()) or beside(data, corners, planes, reach))
    for name in ("j15_plane_cut_surfaces", "j16_plane_cut_dem", "j15_surface_cut_parts"):
        got = Q[name](spark, str(tmp_path))
        rows = sorted(map(tuple, got.collect()))
        if name in TWINS:
            assert rows == sorted(d.execute(f"select {', '.join(got.columns)} from ({TWINS[name]}) q").fetchall())
        else:
            per = {}
            for uid, *rest in rows:
                surface, section = map(int, uid.split("_int_"))
                per.setdefault((surface, section % 360), set()).add(tuple(rest))
            assert all(len(v) == 1 for v in per.values()) and len(rows) == 4 * len(per)
        assert rows
    assert met == [3, 3, 3]


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_small_groups_are_connected_where_they_meet(spark, monkeypatch, most):
    rng = np.random.default_rng(3)
    rows = [(f"g{g}", int(a), int(b)) for g in range(30) for a, b in rng.integers(-40, 40, (25, 2))]
    rows += [("long", i, i + 1) for i in range(300)] + [("loop", 5, 5), (None, 1, 2)]
    root = {(u, v): v for u, a, b in rows if u and a != b for v in (a, b)}
    while True:
        new = dict(root)
        for u, a, b in rows:
            if u and a != b:
                new[u, a] = new[u, b] = min(new[u, a], new[u, b])
        if new == root:
            break
        root = new
    rounds = []
    monkeypatch.setattr(graph, "components", lambda e, f=graph.components: rounds.append(1) or f(e))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        e = spark.createDataFrame(rows, "uid string, a long, b long")
        got = {(r.uid, r.node): r.component for r in graph.components_by(e, most).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == root and bool(rounds) == (most == 40)


@pytest.mark.parametrize("lattice", [True, False])
def test_neighbours_are_counted_without_pairs(spark, monkeypatch, lattice):
    rng = np.random.default_rng(5)
    x = np.vstack((rng.integers(-12, 12, (1500, 3)), rng.normal(size=(100, 3)) * 40)).astype(float) if lattice else rng.normal(size=(1500, 3)) * 9
    r = 5.0  # distances of exactly 5 are common on the lattice
    monkeypatch.setattr(points, "radius_neighbors", None)
    monkeypatch.setattr(points, "OWN", 100)
    monkeypatch.setattr(points, "GIVEN", 300)
    e = x[:, None] - x[None]
    n = (np.sqrt((e[..., 0] * e[..., 0] + e[..., 1] * e[..., 1]) + e[..., 2] * e[..., 2]) <= r).sum(1) - 1
    assert (points._count_within(x, x, r) - 1 == n).all()
    p = spark.createDataFrame([(1, i, *map(float, v)) for i, v in enumerate(x)] + [(2, 5000, 0.0, 0.0, 0.0), (2, 5001, None, 0.0, 0.0)], "uid int, point_id long, x double, y double, z double")
    got = {q.point_id: q.neighbors for q in points.remove_radius_outliers(p, r, 0).collect()}
    assert got == dict(enumerate(n.tolist())) | {5000: 0, 5001: 0}


@pytest.mark.parametrize("name", ["a13_mesh_area", "m12_triangle_normals"])
def test_meshes_are_not_broadcast(spark, name):
    plan = Q[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
