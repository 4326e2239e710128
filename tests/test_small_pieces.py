"""Rings by pointer doubling, hulls in streams, logs of sheets, rows of files, refusals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotab.operators import catalog, grids, lines, mesh, points, wells
from geotab.sources import text


def rings_of(spark, tri, **how):
    t = spark.createDataFrame([(0, i, *map(int, c)) for i, c in enumerate(tri)], "uid int, cell_id long, p0 long, p1 long, p2 long")
    got = mesh.boundary_loops(t, **how).toPandas().sort_values(["ring", "number"])
    return {int(r): g.point_id.tolist() for r, g in got.groupby("ring")}


def test_rings_start_at_the_smallest_vertex_towards_its_smaller_neighbour(spark):
    n = 9  # a grid with a hole in it
    cells = [(i, j) for i in range(n - 1) for j in range(n - 1) if not (3 <= i < 5 and 2 <= j < 6)]
    tri = [t for i, j in cells for t in ((i * n + j, (i + 1) * n + j, (i + 1) * n + j + 1), (i * n + j, (i + 1) * n + j + 1, i * n + j + 1))]
    got = rings_of(spark, tri)
    outer = [*range(n), *range(2 * n - 1, n * n, n), *range(n * n - 2, n * n - n - 1, -1), *range(n * n - 2 * n, 0, -n)]
    assert sorted(got) == [0, 3 * n + 2] and got[0] == outer and len(got[3 * n + 2]) == 12
    assert got[3 * n + 2][:3] == [3 * n + 2, 3 * n + 3, 3 * n + 4]


def test_two_triangles_at_a_vertex_and_a_closed_surface(spark):
    got = rings_of(spark, [(0, 1, 2), (2, 3, 4)])
    assert sorted(len(r) for r in got.values()) in ([3, 3], [6])
    assert rings_of(spark, [(0, 1, 2), (0, 2, 3), (0, 3, 1), (1, 3, 2)]) == {}


@pytest.mark.parametrize("held", [5, 10**6])
def test_streamed_hulls(spark, monkeypatch, held):
    monkeypatch.setattr(points, "HELD", held)
    rng = np.random.default_rng(0)
    x = {"a": rng.normal(0, 1, (3000, 2)), "b": rng.uniform(0, 1, (500, 2)), "c": np.array([[1.0, 2.0]] * 4), None: np.array([[0.0, 0], [1, 0], [2, 0]])}
    df = spark.createDataFrame([(k, float(u), float(v)) for k, p in x.items() for u, v in p] + [("a", None, 1.0)], "k string, u double, v double").repartition(7)
    got = points.hulls(df, "k").toPandas()
    for k, p in x.items():
        g = got[got.k.isna()] if k is None else got[got.k == k]
        assert np.allclose(g.sort_values("number")[["u", "v"]], points.hull(p))


def test_thinning_carries_the_last_vertex_over_batches(spark):
    rng = np.random.default_rng(4)
    c = [np.cumsum(rng.normal(0, 0.2, (n, 3)), axis=0) for n in (1, 2, 700, 300)]
    df = spark.createDataFrame([(u, i, *map(float, p)) for u, line in enumerate(c) for i, p in enumerate(line)], "uid long, seq long, x double, y double, z double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    got = lines.dedupe_consecutive(df, 0.5).toPandas()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for u, line in enumerate(c):
        kept = [0]
        for i in range(1, len(line)):
            if np.linalg.norm(line[i] - line[kept[-1]]) > 0.5:
                kept.append(i)
        assert sorted(got[got.uid == u].seq) == kept


def test_logs_of_each_kind(spark):
    trace = wells.trace_depth(spark.createDataFrame([("w", i, 0.0, 0.0, -10.0 * i) for i in range(5)], "well string, seq long, x double, y double, z double"))
    units = wells.well_logs(spark.createDataFrame([("w", 0, 0.0, 12.0, "clay"), ("w", 1, 12.0, 40.0, None)], "well string, row_no long, START double, `end` double, UNIT string"), "GEOLOGY")
    assert [(r.kind, r.name, r.start_md, r.end_md, r.value) for r in units.orderBy("row_no").collect()] == [("interval", "UNIT", 0.0, 12.0, "clay"), ("interval", "UNIT", 12.0, 40.0, None)]
    picks = wells.well_logs(spark.createDataFrame([("w", 0, 14.0, "x", 3), ("w", 1, None, "y", 4), ("v", 2, 1.0, "z", 5)], "well string, row_no long, MD_point double, name_ string, q int"), "PICKS")
    curve = wells.well_logs(spark.createDataFrame([("w", 0, 31.0, 1.5), ("w", 1, 36.0, None)], "well string, row_no long, MD double, gr double"), "GR")
    at = wells.place_logs(picks.union(curve).union(units), trace)
    assert sorted((r.log, r.name, r.value, r.seq, r.z) for r in at.collect()) == [("GR", "gr", "1.5", 3, -30.0), ("PICKS", "name_", "x", 1, -10.0), ("PICKS", "q", "3", 1, -10.0)]
    with pytest.raises(ValueError, match="MD"):
        wells.well_logs(trace.select("well", F.lit(0).alias("row_no"), "x"), "none")


def test_rows_of_files_by_number(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("x y z\n1 of 3\n" + "".join(f"{i} {i + 1} {ord(name)}\n" for i in range(50)))
    whole = text.read_points_text(spark, str(tmp_path), ["x", "y", "z"], " ", header=2)
    assert whole.count() == 100 and whole.where("x is null").isEmpty()
    some = text.read_points_text(spark, str(tmp_path), ["x", "y", "z"], " ", header=2, rows=(10, 12))
    assert sorted((r.z, r.x) for r in some.collect()) == [(97.0, 10.0), (97.0, 11.0), (97.0, 12.0), (98.0, 10.0), (98.0, 11.0), (98.0, 12.0)]


def test_images_of_five_bands_are_refused(spark):
    raster = spark.createDataFrame([("i", 0, 0, [1.0] * 5)], "uid string, r int, c int, bands array<double>")
    with pytest.raises(Exception, match="four bands"):
        grids.map_pixels(raster, (0, 1, 0, 1), 1, 1).collect()


def test_merging_nothing_and_removing_nothing(spark):
    p = spark.createDataFrame([("a", 0, 1.0)], "uid string, point_id long, x double")
    e = spark.createDataFrame([("a", "VertexSet", "s")], "uid string, topology string, parent_uid string")
    assert catalog.merge_entities(p, e, ["a"], "m", "VertexSet", "t").isEmpty()
    assert catalog.without_merged(p, p, e, ["a"], "VertexSet", "t").count() == 1 and catalog.without_merged(p, p, e, ["a"], "VertexSet", "s").isEmpty()
