"""Closed lines, pixels on every section, sizes that grow with the tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from geotab import registry

SMALL = "/root/testdata/sf0.001"
Q, TWINS = registry.queries(), registry.oracle_sql()


def both(spark, folder, name):
    """Rows of a query and of its twin over the tables of a folder."""
    d = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            d.execute(f"create view {f[:-8]} as select * from '{folder}/{f}'")
    got = Q[name](spark, str(folder))
    want = d.execute(f"select {', '.join(got.columns)} from ({TWINS[name]}) q").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


def test_left_right_keeps_closed_lines(spark, tmp_path):
    # a line that ends at the y it starts from, one that falls, one that rises, a single vertex
    ys = {1: [3.0, 8.0, 3.0], 2: [9.0, 1.0], 3: [1.0, 2.0, 5.0], 4: [7.0]}
    rows = ", ".join(f"({10 * u + i}, TIMESTAMP '2024-01-01 00:00:0{i}', {u}, {y}::DOUBLE)" for u, v in ys.items() for i, y in enumerate(v))
    duckdb.sql(f"copy (select * from (values {rows}) t(event_id, ts, user_id, value)) to '{tmp_path}/events.parquet' (format parquet)")
    got, want = both(spark, tmp_path, "w4_orient_left_right")
    assert got == want == [(1, 1, 3.0), (1, 2, 8.0), (1, 3, 3.0), (2, 1, 1.0), (2, 2, 9.0), (3, 1, 1.0), (3, 2, 2.0), (3, 3, 5.0)]


def test_pixels_lie_on_every_section(spark):
    n = {t: spark.read.parquet(f"{SMALL}/{t}.parquet").count() for t in ("part", "supplier")}
    assert Q["s13_section_pixels"](spark, SMALL).count() == n["part"] * n["supplier"]


def test_exploded_and_large_settled_tables_are_not_broadcast(spark, monkeypatch):
    from geotab.operators import graph, lines

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    line = spark.createDataFrame([(u, k, float(k), float(u * k % 5), 0.0) for u in range(4) for k in range(9)], "uid int, seq long, x double, y double, z double")
    s = lines.segments(line)
    assert "Broadcast" not in plan(lines.crossings(s, s, 2.0))
    assert "Broadcast" not in plan(lines._touching(line.select("uid", "seq", "x", "y").withColumnRenamed("seq", "k"), s, 0.5))
    n = spark.range(50)
    assert "Broadcast" in plan(graph.settle(n).join(n, "id"))
    monkeypatch.setattr(graph, "FEW", 10)
    big = graph.settle(n)
    assert "Broadcast" not in plan(big.join(n.where("id < 3"), "id")) and "Broadcast" in plan(big.join(graph.small(n), "id"))


def test_unique_names_equal_one_by_one_and_large_families_end(spark):
    import random

    from geotab.operators import catalog

    random.seed(5)
    name = lambda: random.choice("ab") + "_(1)" * random.choice((0, 0, 1, 2, 5))
    for _ in range(3):
        old, new = [(name(),) for _ in range(6)], [(i, name()) for i in range(30)] + [(30, None)]
        taken, want = {n for n, in old}, {30: None}
        for i, n in new[:-1]:
            while n in taken:
                n += "_(1)"
            taken.add(n)
            want[i] = n
        got = catalog.unique_names(spark.createDataFrame(new, "id long, name string"), spark.createDataFrame(old, "name string"))
        assert dict(map(tuple, got.collect())) == want
    many = spark.range(60_000).select("id", F.lit("a").alias("name"))  # arrays of a family took time with the square of its names
    assert catalog.unique_names(many, many.limit(1)).where("length(name) <> 1 + 4 * (id + 1)").count() == 0


def test_vertices_of_a_surface_and_side_are_one_file(spark, tmp_path):
    from geotab.sources import text

    p = spark.range(400).select((F.col("id") % 4).alias("uid"), F.col("id").alias("point_id"), *[F.col("id").cast("double").alias(c) for c in "xyz"]).repartition(8)
    t = spark.range(4).select(F.col("id").alias("uid"), F.col("id").alias("cell_id"), *[(F.col("id") + 4 * k).alias(f"p{k}") for k in range(3)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = text.export_surface_vertices(p, t, str(tmp_path / "v"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got.collect())) == [(u, 100, 3) for u in range(4)]
    assert len(list((tmp_path / "v").glob("uid=*/border=*/*.csv"))) == 8
    assert spark.read.option("header", True).csv(str(tmp_path / "v")).count() == 400


def test_clipped_area_and_pieces_join_corners_once_and_regroup_nothing(spark):
    for name in ("m11_clip_area", "m11_clip_triangles"):
        plan = Q[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        joins = plan.count("Join ")  # four of the view, three of the corners
        assert joins == 7 and "pivotfirst" not in plan.lower(), (name, joins)
