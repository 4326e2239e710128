"""Invariants, brute-force twins and guards of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotab.functions import orientation as O
from geotab.operators import catalog, graph, grids, lines, mesh, orient, points, sections, wells
from geotab.sources import text


@pytest.fixture(scope="module")
def blobs(spark):
    """Three clouds of 200 points, far apart, with known dips."""
    n = spark.range(600)
    jitter = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 200.0
    g = F.floor(F.col("id") / 200)
    p = n.select(F.lit("a").alias("uid"), F.col("id").alias("point_id"), (jitter(1) + F.when(g == 1, 100).otherwise(0)).alias("x"), (jitter(2) + F.when(g == 2, 100).otherwise(0)).alias("y"), jitter(3).alias("z"), g.alias("blob"))
    d = p.withColumns({"dip": F.element_at(F.array(F.lit(10.0), F.lit(45.0), F.lit(70.0)), (F.col("blob") + 1).cast("int")), "dip_dir": F.element_at(F.array(F.lit(10.0), F.lit(90.0), F.lit(270.0)), (F.col("blob") + 1).cast("int"))})
    return d.cache()


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    rows = [("a", i, *map(float, rng.uniform(0, 50, 3))) for i in range(400)]
    return spark.createDataFrame(rows, "uid string, point_id long, x double, y double, z double").cache(), np.array([r[2:] for r in rows])


def test_three_clusters(blobs):
    c = points.radius_clusters(blobs, 2.0).toPandas()
    assert c.cluster_id.nunique() == 3
    assert (c.groupby("blob").cluster_id.nunique() == 1).all()


def test_segment_window_and_size(blobs):
    s = points.segment(blobs, 0, 100, 0, 60, 2.0, 5).toPandas()
    assert set(s.blob) == {0, 1} and s.dip.between(0, 60).all()


def test_threshold_keeps_400(blobs):
    assert points.threshold(blobs, "dip_dir", 0, 150).count() == 400


def test_radius_pairs_match_brute_force(cloud):
    p, x = cloud
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] <= 5}
    got = [(r.a, r.b) for r in points.radius_neighbors(p, 5.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_radius_zero_links_only_copies(spark):
    p = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0), ("a", 2, 0.0, 0.0, 0.0), ("a", 3, 1e-6, 0.0, 0.0)], "uid string, point_id long, x double, y double, z double")
    assert [(r.a, r.b) for r in points.radius_neighbors(p, 0).collect()] == [(1, 2)]
    assert points.radius_clusters(p, 0).select("cluster_id").distinct().count() == 2


def test_knn_matches_brute_force(cloud):
    p, x = cloud
    got = points.knn(p, 4).toPandas()
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, 1)[:, :4]
    have = got.sort_values(["a", "rank"]).distance.to_numpy().reshape(-1, 4)
    assert np.allclose(have, want)


def test_normals_are_unit_and_down(cloud):
    n = points.pca_normals(cloud[0], 8).toPandas()
    assert np.allclose(n.nx**2 + n.ny**2 + n.nz**2, 1) and (n.nz <= 0).all() and len(n) == 400


def test_plane_and_facets(spark):
    rows = [("a", i, float(i % 10), float(i // 10), 0.5 * (i % 10)) for i in range(100)]
    p = spark.createDataFrame(rows, "uid string, point_id long, x double, y double, z double")
    f = points.best_fit_plane(p, "uid").first()
    assert abs(f.dip - np.degrees(np.arctan(0.5))) < 1e-9 and abs(f.dip_dir - 270) < 1e-9
    a = points.facets(p, "uid").first()
    assert abs(a.area - 81 * np.sqrt(1.25)) < 1e-6 and abs(a.width - 9) < 1e-6 and abs(a.length - 9 * np.sqrt(1.25)) < 1e-6


def test_facets_reference_scale_is_smaller(spark):
    rows = [("a", i, float(i % 10), float(i // 10), 0.5 * (i % 10)) for i in range(100)]
    p = spark.createDataFrame(rows, "uid string, point_id long, x double, y double, z double")
    assert points.facets(p, "uid", reference_scale=True).first().width < points.facets(p, "uid").first().width


def test_obb_of_a_turned_rectangle(spark):
    t = np.radians(30)
    q = np.array([(u, v) for u in np.linspace(0, 10, 6) for v in np.linspace(0, 4, 5)]) @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])
    p = spark.createDataFrame([(float(a), float(b), 0.0) for a, b in q], "x double, y double, z double")
    b = points.oriented_bbox(p, 0.0).first()
    sides = sorted([np.hypot(b.x2 - b.x1, b.y2 - b.y1), np.hypot(b.x3 - b.x2, b.y3 - b.y2)])
    assert np.allclose(sides, [4, 10])


def test_decimate_guards_and_size(blobs):
    assert points.decimate(blobs, 0.333).count() == 199
    with pytest.raises(ValueError):
        points.decimate(blobs, 1.5)


def test_vectors_round_trip(spark):
    p = spark.createDataFrame([(float(d), float(a)) for d in (1, 30, 60, 89) for a in (0, 45, 200, 359)], "d double, a double")
    n = O.normal("d", "a")
    q = p.select("d", "a", O.dip(n[2]).alias("d2"), O.dip_direction(n[0], n[1]).alias("a2")).toPandas()
    assert np.allclose(q.d, q.d2) and np.allclose((q.a - q.a2 + 180) % 360, 180)


def test_fisher_of_nothing_is_null(spark):
    v = spark.createDataFrame([("n", 0, 1.0, 0.0, 0.0), ("n", 1, -1.0, 0.0, 0.0)], "kind string, point_id long, x double, y double, z double")
    f = orient.fisher(v).first()
    assert f.n == 2 and f.kappa is None and f.mx is None


def test_kmedoids_are_exact_in_large_clusters(spark):
    rng = np.random.default_rng(4)
    x = np.vstack((rng.normal(size=(700, 3)) * 0.1, rng.normal(size=(300, 3)) * 0.1 + [0, 0, 3], rng.normal(size=(400, 3)) * 1.5 + [4, 0, 0]))
    v = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "point_id long, x double, y double, z double")
    seeds = [(0.0, 0.0, 0.0), (4.0, 0.0, 0.0)]
    medoids = np.array(seeds)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    while True:
        label = np.linalg.norm(x[:, None] - medoids[None], axis=2).argmin(1)
        member = [np.flatnonzero(label == c) for c in range(2)]
        new = np.array([x[m[d[np.ix_(m, m)].sum(1).argmin()]] for m in member])
        if np.allclose(new, medoids):
            break
        medoids = new
    assert orient.kmedoids(v, seeds).orderBy("point_id").toPandas().cluster.tolist() == label.tolist()
    # the mean of the first cluster is far from its medoid
    a = orient.settle(orient.assign(v, medoids).withColumns({"n": F.lit(1).cast("long"), "original": F.lit(True)}))
    got = orient._medoids(a, 16)
    assert np.allclose([got[0], got[1]], medoids)


def test_kmeans_and_kmedoids_find_two_groups(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k, base in enumerate(([0, 0, -1], [1, 0, 0])):
        v = rng.normal(base, 0.05, (40, 3))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        rows += [(k, 40 * k + i, *map(float, r)) for i, r in enumerate(v)]
    v = spark.createDataFrame(rows, "truth int, point_id long, x double, y double, z double")
    seeds = [(0.1, 0.0, -0.9), (0.9, 0.1, 0.0)]
    for f in (orient.kmeans, orient.kmedoids):
        got = f(v, seeds).toPandas()
        assert (got.truth == got.cluster).all()


def test_components_match_union_find(spark):
    rng = np.random.default_rng(2)
    e = rng.integers(0, 200, (150, 2)).tolist()
    root = list(range(200))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in e:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = dict(map(tuple, graph.components(spark.createDataFrame(e, "a long, b long")).collect()))
    assert all(got.get(i, i) == find(i) for i in range(200))


def test_crossings_and_split(spark):
    rows = [(1, 1, 0.0, 0.0), (1, 2, 10.0, 0.0), (2, 1, 5.0, -5.0), (2, 2, 5.0, 5.0), (3, 1, 20.0, 0.0), (3, 2, 21.0, 1.0)]
    ls = spark.createDataFrame([(*r, 0.0) for r in rows], "uid long, seq long, x double, y double, z double")
    x = lines.segment_intersections(ls, 3.0).collect()
    assert [(r.a, r.b, r.x, r.y) for r in x] == [(1, 2, 5.0, 0.0)]
    parts = lines.split_lines(ls.where("uid <> 2"), ls.where("uid = 2"), 3.0).toPandas()
    assert parts[parts.uid == 1].groupby("part").size().tolist() == [2, 2] and parts[parts.uid == 3].part.max() == 0


def test_snap_trims_and_extends(spark):
    rows = [(1, 1, 0.0, 0.0), (1, 2, 10.0, 0.0), (2, 1, 5.0, -5.0), (2, 2, 5.0, 0.4), (3, 1, 7.0, 5.0), (3, 2, 7.0, 0.4)]
    ls = spark.createDataFrame([(*r, 0.0) for r in rows], "uid long, seq long, x double, y double, z double")
    s = lines.snap_lines(ls, 0.5, 3.0).toPandas().set_index(["uid", "seq"])
    assert s.loc[(2, 2), "y"] == 0 and s.loc[(3, 2), "y"] == 0 and s.loc[(1, 1), "x"] == 0


def test_resample_and_simplify(spark):
    ls = spark.createDataFrame([(1, i, float(i), 0.0, 0.0) for i in range(11)], "uid long, seq long, x double, y double, z double")
    assert lines.resample_count(ls, 6).orderBy("seq").toPandas().x.tolist() == [0, 2, 4, 6, 8, 10]
    assert lines.resample_distance(ls, 4.0).orderBy("seq").toPandas().x.tolist() == [0, 4, 8, 10]
    assert lines.resample_distance(ls, 100.0).orderBy("seq").toPandas().x.tolist()[:2] == [0, 6.25]
    assert lines.simplify_lines(ls, 0.1).count() == 2


def test_offset_of_a_corner(spark):
    ls = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (1, 2, 10.0, 0.0, 0.0), (1, 3, 10.0, 10.0, 0.0)], "uid long, seq long, x double, y double, z double")
    m = lines.offset_lines(ls, 1.0).orderBy("seq").toPandas()
    assert np.allclose(m[["x", "y"]], [(0, 1), (9, 1), (9, 10)])
    assert lines.offset_lines(ls, -1.0, "round").count() > 3


def test_merge_lines_flips(spark):
    ls = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0), ("a", 2, 1.0, 0.0, 0.0), ("b", 1, 3.0, 0.0, 0.0), ("b", 2, 1.1, 0.0, 0.0)], "uid string, seq long, x double, y double, z double")
    assert lines.merge_lines(ls, ["a", "b"], "m").orderBy("seq").toPandas().x.tolist() == [0, 1, 1.1, 3]


def _square(spark):
    p = spark.createDataFrame([("a", i, float(i % 3), float(i // 3), 0.0) for i in range(9)], "uid string, point_id long, x double, y double, z double")
    t = [(2 * (i + 2 * j) + h, *((b, b + 1, b + 4) if h == 0 else (b, b + 4, b + 3))) for j in range(2) for i in range(2) for h in (0, 1) for b in [j * 3 + i]]
    return p, spark.createDataFrame([("a", *r) for r in t], "uid string, cell_id long, p0 long, p1 long, p2 long")


def test_boundary_loop_dilate_subdivide(spark):
    p, t = _square(spark)
    ring = mesh.boundary_loops(t).orderBy("number").toPandas()
    assert len(ring) == 8 and ring.point_id[0] == 0
    d = mesh.dilate_boundary(p, t, 1.0).toPandas().set_index("point_id")
    assert np.allclose(d.loc[0, ["x", "y"]].astype(float), [-np.sqrt(0.5)] * 2) and d.loc[4, "x"] == 1
    q, u = mesh.subdivide(p, t)
    assert u.count() == 32 and q.count() == 25 and abs(mesh.mesh_area(q, u).first().area - 4) < 1e-9


def test_clip_keeps_area(spark):
    p, t = _square(spark)
    c = mesh.clip(p.withColumn("s", F.col("x") - 0.7), t, "s").toPandas()
    total = 0
    for _, g in c.groupby(["cell_id", "piece"]):
        (x0, y0), (x1, y1), (x2, y2) = g.sort_values("corner")[["x", "y"]].to_numpy()
        total += abs((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)) / 2
        assert ((g.x >= 0.7 - 1e-9).all()) == (g.side.iloc[0] == 1) or ((g.x <= 0.7 + 1e-9).all() and g.side.iloc[0] == 0)
    assert abs(total - 4) < 1e-9


def test_iso_surface_of_a_ball_is_closed(spark):
    n = 7
    v = spark.createDataFrame([(i, j, k, float((i - 3) ** 2 + (j - 3) ** 2 + (k - 3) ** 2)) for i in range(n) for j in range(n) for k in range(n)], "i int, j int, k int, value double")
    t = grids.iso_triangles(v, 4.5).toPandas()
    edges = {}
    for _, g in t.groupby(["i", "j", "k", "tet", "tri"]):
        e = g.sort_values("corner").edge.tolist()
        for a, b in zip(e, e[1:] + e[:1]):
            key = tuple(sorted((a, b)))
            edges[key] = edges.get(key, 0) + 1
    assert len(t) and set(edges.values()) == {2}


def test_triangle_distance():
    a, b, c = (np.array([v], float) for v in ((0, 0, 0), (1, 0, 0), (0, 1, 0)))
    for p, want in (((0.2, 0.2, 2), 2), ((0.2, 0.2, -1), -1), ((2, 0, 0), 1)):
        assert abs(mesh.triangle_distance(np.array([p], float), a, b, c)[0] - want) < 1e-12


def test_section_round_trip(spark):
    s = spark.createDataFrame([(1, "x", 37.0, 60.0, 5.0, 6.0, 7.0, 10.0, 10.0)], "uid long, name string, strike double, dip double, origin_x double, origin_y double, origin_z double, length double, height double")
    p = spark.createDataFrame([("a", 1, 1.0, 2.0, 3.0)], "uid string, point_id long, x double, y double, z double")
    q = sections.plane_to_world(sections.world_to_plane(p, s).drop("x", "y", "z"), s).first()
    assert np.allclose((q.x, q.y, q.z), (1, 2, 3))
    assert sections.project(p, s, trend=40.0, plunge=0.0).count() == 0  # axis within 10 degrees of the strike


def test_nearest_md_ties_to_the_lower(spark):
    t = spark.createDataFrame([("w", 1, 0.0, 0.0, 0.0, 0.0), ("w", 2, 0.0, 0.0, 0.0, 10.0), ("w", 3, 0.0, 0.0, 0.0, 10.0)], "well string, seq long, x double, y double, z double, md double")
    m = spark.createDataFrame([("w", 1, 5.0), ("w", 2, 6.0), ("w", 3, 99.0)], "well string, key long, md double")
    assert {r.key: r.seq for r in wells.nearest_md(m, t).collect()} == {1: 1, 2: 2, 3: 2}


def test_unique_names_families(spark):
    new = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a_(1)")], "id long, name string")
    old = spark.createDataFrame([("a",)], "name string")
    got = {r.id: r["name"] for r in catalog.unique_names(new, old).collect()}
    assert got[1] == "a_(1)" and got[3] == "b" and len(set(got.values())) == 4 and "a" not in got.values()


def test_role_guard_and_columns(spark):
    e = spark.createDataFrame([("geol", "1", "top")], "collection string, uid string, role string")
    with pytest.raises(ValueError):
        catalog.set_attribute(e, e, "role", "nonsense")
    assert catalog.match_coordinate_columns(["UTM_E", "north", "foo"]) == ({"UTM_E": "X", "north": "Y"}, ["Z"])
    assert catalog.match_feature_attributes(["Dir", "dip_dir"], ["dir", "dip_dir"]) == {"dir": "Dir"}


def test_empty_tables(spark):
    p = spark.createDataFrame([], "uid string, point_id long, x double, y double, z double, seq long")
    for df in (points.radius_clusters(p, 1.0), points.knn(p, 3), points.best_fit_plane(p, "uid"), lines.resample_distance(p, 1.0), lines.segments(p), points.decimate(p, 0.5)):
        assert df.count() == 0


def test_tm_known_point(spark):
    p = spark.createDataFrame([(9.0, 45.0)], "lon double, lat double")
    x, y = grids.geographic_to_tm(F.col("lon"), F.col("lat"), 32632)
    r = p.select(x.alias("x"), y.alias("y")).first()
    assert abs(r.x - 500000) < 1e-6 and abs(r.y - 4982950.400) < 0.01


def test_sniff_and_read(spark, tmp_path):
    f = tmp_path / "p.txt"
    f.write_text("1;2;3\n4;5;x\n")
    assert text.sniff_separator("1;2;3") == ";"
    got = text.read_points_text(spark, str(f), ["x", "y", "z"]).toPandas()
    assert got.x.tolist() == [1, 4] and np.isnan(got.z[1])


def test_slices_of_a_ramp(spark):
    v = spark.createDataFrame([(i, 0, 0, float(i)) for i in range(5)], "i int, j int, k int, value double")
    assert grids.extract_slices(v, "i", 3, 5).orderBy("slice").toPandas().value.tolist() == [0, 2, 4]


def test_ply_rows_go_by_each_files_own_header(spark, tmp_path):
    a = ["ply", "format ascii 1.0", "comment made by hand", "element vertex 3", "property float x", "property float y", "property float z", "property uchar red", "element face 1", "property list uchar int vertex_indices", "end_header"]
    (tmp_path / "a.ply").write_text("\n".join([*a, "0 0 0 9", "1 0 0 8", "0 1 0 7", "3 0 1 2"]) + "\n")
    b = ["ply", "format ascii 1.0", "element face 1", "property list uchar int vertex_indices", "element vertex 2", "property double z", "property double x", "property double y", "end_header"]
    (tmp_path / "b.ply").write_text("\n".join([*b, "3 0 1 1", "5 6 7", "nan - 2"]) + "\n")
    got = text.read_points_ply_ascii(spark, str(tmp_path))
    assert got.columns == ["x", "y", "z", "red"]
    rows = sorted([tuple(r) for r in got.collect()], key=str)
    assert rows[:3] == [(0.0, 0.0, 0.0, 9.0), (0.0, 1.0, 0.0, 7.0), (1.0, 0.0, 0.0, 8.0)] and rows[3] == (6.0, 7.0, 5.0, None)
    assert rows[4][:2] == (None, 2.0)
    (tmp_path / "c.ply").write_text("x y z\n")
    with pytest.raises(Exception, match="PLY"):
        text.read_points_ply_ascii(spark, str(tmp_path / "c.ply")).collect()


def test_no_triangle_is_lost_far_from_the_other_surface(spark):
    p = spark.createDataFrame([(0, i, *c) for i, c in enumerate([(0.0, 0.0, 1.0), (1.0, 0.0, 1.0), (0.0, 1.0, -1.0), (0.0, 0.0, 15.0), (1.0, 0.0, 15.0), (0.0, 1.0, -27.0)])], "uid int, point_id long, x double, y double, z double")
    t = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 3, 4, 5)], "uid int, cell_id int, p0 long, p1 long, p2 long")
    ref_p = spark.createDataFrame([(0, i, x, y, 0.0) for i, (x, y) in enumerate([(-5.0, -5.0), (9.0, -5.0), (-5.0, 9.0)])], "uid int, point_id long, x double, y double, z double")
    ref_t = spark.createDataFrame([(0, 0, 0, 1, 2)], "uid int, cell_id int, p0 long, p1 long, p2 long")
    got = mesh.split_by_surface(p, t, ref_p, ref_t, 1.0).groupBy("cell_id").agg(F.countDistinct("piece").alias("n")).collect()
    assert {r.cell_id: r.n for r in got} == {0: 3, 1: 3}
    d = {r.point_id: r.distance for r in mesh.nearest_distance(p, ref_p, ref_t, 1.0).collect()}
    assert abs(d[3] - 15) < 1e-9 and abs(d[5] + 27) < 1e-9 and abs(d[2] + 1) < 1e-9
    assert mesh.split_by_surface(p, t, ref_p, ref_t.limit(0), 1.0).count() == 0
