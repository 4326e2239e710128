"""Input views over the given tables, as DataFrames and as SQL for the twins.

Each view derives from whole tables, so every query grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (tables or views it needs, Spark SQL, DuckDB SQL)
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, needs: str, spark: str, duck: str | None = None) -> None:
    _VIEWS[name] = (tuple(needs.split()), spark, duck or spark)


_view(
    "fx_vectors", "embeddings",
    "SELECT uid, point_id, a / n AS x, b / n AS y, c / n AS z FROM (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM (SELECT label AS uid, vec_id AS point_id, "
    "CAST(embedding[0] AS DOUBLE) AS a, CAST(embedding[1] AS DOUBLE) AS b, CAST(embedding[2] AS DOUBLE) AS c FROM embeddings) e) f",
    "SELECT uid, point_id, a / n AS x, b / n AS y, c / n AS z FROM (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM (SELECT label AS uid, vec_id AS point_id, "
    "CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings) e) f",
)
_view(
    "fx_points", "orders",
    "SELECT o_custkey % 10 AS uid, o_orderkey AS point_id, CAST(o_totalprice AS DOUBLE) / 1000 AS x, CAST((o_orderkey * 37) % 500 AS DOUBLE) AS y, CAST((o_orderkey * 91) % 200 AS DOUBLE) AS z FROM orders",
)
_view("fx_oriented", "fx_points", "SELECT *, CAST(point_id % 91 AS DOUBLE) AS dip, CAST((point_id * 7) % 360 AS DOUBLE) AS dip_dir FROM fx_points")
_view(
    "fx_lines", "events",
    "SELECT uid, seq, CAST(seq AS DOUBLE) AS x, v AS y, 0.0E0 AS z FROM (SELECT user_id AS uid, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, CAST(value AS DOUBLE) AS v FROM events) e",
)
_view(  # lines that reach a few neighbours only, however many there are
    "fx_traces", "fx_lines",
    "SELECT uid, seq, x * 0.5E0 + CAST((uid * 7) % 50 AS DOUBLE) AS x, y * 0.05E0 + CAST(uid AS DOUBLE) AS y, CAST(seq % 9 AS DOUBLE) AS z FROM fx_lines",
)
_view(
    "fx_sections", "supplier",
    "SELECT s_suppkey AS uid, concat('xs', CAST(s_suppkey AS VARCHAR(20))) AS name, CAST((s_suppkey * 37) % 360 AS DOUBLE) AS strike, CAST(90 - 15 * (s_suppkey % 4) AS DOUBLE) AS dip, "
    "CAST(s_suppkey * 10 AS DOUBLE) AS origin_x, 100.0E0 AS origin_y, 50.0E0 AS origin_z, 200.0E0 AS length, 100.0E0 AS height FROM supplier",
)
_view(
    "fx_grid", "part",
    "SELECT CAST(p_partkey % 10 AS INT) AS i, CAST(floor(p_partkey / 10.0E0) % 10 AS INT) AS j, CAST(floor(p_partkey / 100.0E0) AS INT) AS k, CAST(p_size AS DOUBLE) AS value FROM part",
)
_view("fx_dem", "fx_grid", "SELECT k AS uid, j AS r, i AS c, 10.0E0 * i AS x, 10.0E0 * j AS y, value AS z FROM fx_grid")
_view(
    "fx_mesh_points", "fx_dem", "SELECT uid, CAST(r * 10 + c AS BIGINT) AS point_id, x, y, z FROM fx_dem",
)
_view(
    "fx_triangles", "fx_dem",
    "SELECT uid, 2 * (r * 10 + c) + h AS cell_id, CAST(r * 10 + c AS BIGINT) AS p0, CAST(CASE WHEN h = 0 THEN r * 10 + c + 1 ELSE (r + 1) * 10 + c + 1 END AS BIGINT) AS p1, "
    "CAST(CASE WHEN h = 0 THEN (r + 1) * 10 + c + 1 ELSE (r + 1) * 10 + c END AS BIGINT) AS p2 "
    "FROM (SELECT a.uid, a.r, a.c FROM fx_dem a JOIN fx_dem b ON a.uid = b.uid AND b.r = a.r AND b.c = a.c + 1 JOIN fx_dem d ON a.uid = d.uid AND d.r = a.r + 1 AND d.c = a.c "
    "JOIN fx_dem e ON a.uid = e.uid AND e.r = a.r + 1 AND e.c = a.c + 1) q CROSS JOIN (SELECT 0 AS h UNION ALL SELECT 1 AS h) t",
)
_view(
    "fx_entities", "part",
    "SELECT CASE WHEN p_partkey % 7 = 0 THEN 'fluid' ELSE 'geol' END AS collection, CAST(p_partkey AS VARCHAR(20)) AS uid, p_name AS name, split_part(p_name, ' ', 1) AS scenario, "
    "CAST(p_partkey % 5 AS VARCHAR(20)) AS parent_uid, CASE p_partkey % 4 WHEN 0 THEN 'PolyLine' WHEN 1 THEN 'TriSurf' WHEN 2 THEN 'VertexSet' ELSE 'XsPolyLine' END AS topology, "
    "p_type AS role, p_brand AS feature, p_size AS size_no FROM part",
)
_view(
    "fx_legend", "fx_entities",
    "SELECT role, feature, scenario, CAST(count(*) AS DOUBLE) AS time, 'seq_0' AS sequence, 255 AS color_R FROM fx_entities WHERE CAST(uid AS BIGINT) % 3 <> 0 GROUP BY role, feature, scenario "
    "UNION ALL SELECT 'none', 'none', 'none', -999999.0E0, 'seq_0', 255",
)
_view(
    "fx_wells", "orders",
    "SELECT o_custkey AS well, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS seq, o_orderkey, CAST(o_orderkey % 7 AS DOUBLE) AS dx, CAST(o_orderkey % 5 AS DOUBLE) AS dy, "
    "CAST(o_orderkey % 11 + 1 AS DOUBLE) AS dz, CAST(o_totalprice AS DOUBLE) AS v FROM orders",
)
_view(
    "fx_trace", "fx_wells",
    "SELECT well, seq, x, y, z FROM (SELECT well, seq, sum(dx) OVER w AS x, sum(dy) OVER w AS y, -sum(dz) OVER w AS z FROM fx_wells WINDOW w AS (PARTITION BY well ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) t",
)
_view(
    "fx_logs", "fx_wells",
    "SELECT well, 'GEOLOGY' AS log, seq AS row_no, CAST((seq - 1) * 9 AS DOUBLE) + 0.25E0 AS start_md, CAST(seq * 9 AS DOUBLE) + 0.25E0 AS end_md, concat('unit', CAST(o_orderkey % 6 AS VARCHAR(20))) AS value FROM fx_wells",
)


def sql(name: str, seen: dict[str, str] | None = None) -> dict[str, str]:
    """SQL of a view and of the views it needs, in order."""
    seen = {} if seen is None else seen
    if name in _VIEWS and name not in seen:
        needs, _, duck = _VIEWS[name]
        for n in needs:
            sql(n, seen)
        seen[name] = duck
    return seen


def twin(query: str, *names: str) -> str:
    """query with the views it uses in front."""
    seen: dict[str, str] = {}
    for n in names:
        sql(n, seen)
    head = ", ".join(f"{n} AS ({v})" for n, v in seen.items())
    if query.lstrip().upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {query.lstrip()[15:]}"
    if query.lstrip().upper().startswith("WITH "):
        return f"WITH {head}, {query.lstrip()[5:]}" if head else query
    return f"WITH {head} {query}" if head else query


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables of sf_dir."""
    if name not in _VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, text, _ = _VIEWS[name]
    # views that join big tables: a compressed file's size would have them broadcast
    return spark.sql(_braced(text, needs), **{n: view(spark, sf_dir, n).hint("merge") if " JOIN " in text else view(spark, sf_dir, n) for n in needs})


def _braced(text: str, needs: tuple[str, ...]) -> str:
    """Table names as parameters of the statement."""
    import re

    for n in needs:
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return text
