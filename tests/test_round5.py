"""Cases of the findings of round 3."""

from pyspark.sql import functions as F


def _nodes(df, name):
    return df._jdf.queryExecution().executedPlan().toString().count(name)


def test_shingles_are_made_once(spark):
    from geotab.llm import ngram_join

    text = "one two three four five six seven"
    want = spark.createDataFrame([(1, text)], "doc_id long, text string").select(F.arrow_udf(ngram_join._task_features, "cls binary, sig binary")("text").alias("f")).first().f.cls
    t = spark.createDataFrame([(1, 2, 1, text, want), (1, 2, 1, "another text", want)], "grp long, members long, n long, text string, want binary")
    made = ngram_join._shingled(t)
    assert _nodes(made, "ArrowEvalPython") == 1
    assert [bytes(r.cls) for r in made.collect()] == [bytes(want)]


def _mesh(spark, tmp_path):
    """Tables as files, which Spark takes for small."""
    spark.createDataFrame([(1, i, float(i % 2), float(i // 2), 0.0) for i in range(4)], "uid long, point_id long, x double, y double, z double").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([(1, 0, 0, 1, 3), (1, 1, 0, 3, 2)], "uid long, cell_id long, p0 long, p1 long, p2 long").write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "p")), spark.read.parquet(str(tmp_path / "t"))


def test_obj_faces_and_merged_corners_are_not_broadcast(spark, tmp_path):
    from geotab.operators import mesh
    from geotab.sources import text

    p, t = _mesh(spark, tmp_path)
    faces = text.obj_lines(p, t).where("part = 1").select("uid", "value")
    assert not _nodes(faces, "BroadcastHashJoin")
    assert sorted(r.value for r in faces.collect()) == ["f 1 2 4", "f 1 4 3"]
    merged = mesh.clean_topology(p, t)[1].select("cell_id", "p0", "p1", "p2")
    assert _nodes(merged, "SortMergeJoin") >= 3
    assert sorted(map(tuple, merged.collect())) == [(0, 0, 1, 3), (1, 0, 3, 2)]


def test_picks_keep_their_partitions_and_equal_brute_force(spark):
    import numpy as np

    from geotab.operators import points

    at = np.random.default_rng(5).integers(-40, 40, (600, 3)) * 0.5
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(at)], "point_id long, x double, y double, z double")
    seeds = p.where("point_id % 20 = 0").select(F.col("point_id").alias("seed"), F.lit("m").alias("measure"), "x", "y", "z")
    got = points.pick_attitudes(p, seeds, 7.5)
    assert _nodes(got, "REPARTITION_BY_NUM") == 2
    want = {i: (np.sqrt(((at - at[i]) ** 2).sum(1)) <= 7.5).sum() for i in range(0, 600, 20)}
    assert {r.seed: r.n for r in got.collect()} == {k: n for k, n in want.items() if n > 2}
