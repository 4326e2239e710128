"""Boreholes: traces (well, seq, x, y, z, md) and logs along them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def well_geometry(info: DataFrame, offsets: DataFrame) -> DataFrame:
    """Vertices of wells: head coordinates (easting, northing, elev) less the offsets dx, dy, dz."""
    g = offsets.join(info.select("well", "easting", "northing", "elev"), "well")
    return g.select("well", "seq", *[(F.col(h) - F.col(d)).alias(c) for h, d, c in (("easting", "dx", "x"), ("northing", "dy", "y"), ("elev", "dz", "z"))])


def trace_depth(trace: DataFrame) -> DataFrame:
    """Traces with the length md from the head."""
    from .lines import measured_depth

    t = trace.withColumnRenamed("well", "uid")
    return measured_depth(t).withColumnRenamed("uid", "well")


def nearest_md(marks: DataFrame, trace: DataFrame) -> DataFrame:
    """marks (well, key, md) with the vertex seq of the nearest md on the well's trace; ties to the lower.

    Both tables are put in one order of depth; the vertices before and after each mark are carried to it.
    """
    nothing = F.lit(None)
    v = trace.select("well", "md", F.lit(0).alias("kind"), nothing.cast(marks.schema["key"].dataType).alias("key"), F.struct("md", "seq").alias("v"))
    m = marks.select("well", "md", F.lit(1).alias("kind"), "key", nothing.cast(v.schema["v"].dataType).alias("v"))
    w = Window.partitionBy("well").orderBy("md", "kind", "key")
    # of equal depths the lowest vertex counts: the first of a run is carried forward
    first = F.min(F.col("v.seq")).over(Window.partitionBy("well", "md"))
    u = v.union(m).withColumn("v", F.when(F.col("kind") == 0, F.struct(F.col("md").alias("md"), first.alias("seq"))))
    below = F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first("v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    u = u.withColumns({"_a": below, "_b": above}).where("kind = 1")
    da, db = F.abs(F.col("md") - F.col("_a.md")), F.abs(F.col("_b.md") - F.col("md"))
    take = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull(), F.col("_b")).when(da <= db, F.col("_a")).otherwise(F.col("_b"))
    return u.select("well", "key", "md", take["seq"].alias("seq"), take["md"].alias("trace_md"))


def _snapped(intervals: DataFrame, trace: DataFrame) -> DataFrame:
    k = F.struct("row_no", F.lit(0).alias("end"))
    marks = intervals.select("well", k.alias("key"), F.col("start_md").alias("md")).union(intervals.select("well", F.struct("row_no", F.lit(1).alias("end")).alias("key"), F.col("end_md").alias("md")))
    s = nearest_md(marks, trace)
    return s.groupBy("well", F.col("key.row_no").alias("row_no")).agg(F.max(F.when(F.col("key.end") == 0, F.col("seq"))).alias("a"), F.max(F.when(F.col("key.end") == 1, F.col("seq"))).alias("b"))


def paint_intervals(intervals: DataFrame, trace: DataFrame, default=None) -> DataFrame:
    """Value of each vertex: that of the last interval (by row_no) that covers it, from its snapped start up to its end.

    An interval is opened into the vertices it covers, so the join is on the vertex.
    """
    s = _snapped(intervals, trace).where("a < b").join(intervals.select("well", "row_no", "value"), ["well", "row_no"])
    s = s.withColumn("seq", F.explode(F.sequence("a", F.col("b") - 1))).groupBy("well", "seq").agg(F.max_by("value", "row_no").alias("value"))
    out = trace.join(s, ["well", "seq"], "left")
    return out if default is None else out.withColumn("value", F.coalesce("value", F.lit(default)))


def interval_tops(intervals: DataFrame, trace: DataFrame) -> DataFrame:
    """Marker points at the starts of intervals: role top, feature the value, parent the well."""
    k = F.struct("row_no", F.lit(0).alias("end"))
    s = nearest_md(intervals.select("well", k.alias("key"), F.col("start_md").alias("md")), trace)
    s = s.select("well", F.col("key.row_no").alias("row_no"), "seq").join(intervals.select("well", "row_no", "value"), ["well", "row_no"])
    return s.join(trace.select("well", "seq", "x", "y", "z"), ["well", "seq"]).select(F.col("well").alias("parent_uid"), "row_no", F.lit("top").alias("role"), F.col("value").alias("feature"), "x", "y", "z")


def well_logs(sheet: DataFrame, log: str) -> DataFrame:
    """Rows of one log sheet (well, row_no and its own columns) in long form: well, log, kind, name, row_no, start_md, end_md, value.

    Its columns say what it holds: START and END intervals, MD_point values at points, MD a curve along the trace, whose empty values go. Every other
    column is a log of its own; values are texts. Names of columns count whatever their case.
    """
    by = {c.lower(): c for c in sheet.columns}
    number = lambda c: F.col(f"`{by[c]}`").cast("double")
    if {"start", "end"} <= set(by):
        kind, depth, ends = "interval", ("start", "end"), (number("start"), number("end"))
    elif "md_point" in by or "md" in by:
        kind = "point" if "md_point" in by else "curve"
        depth = ("md_point",) if kind == "point" else ("md",)
        ends = (number(depth[0]), number(depth[0]))
    else:
        raise ValueError("a log needs START and END, MD_point or MD")
    names = [c for c in sheet.columns if c.lower() not in ("well", "row_no", *depth)]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in names]))
    rows = sheet.select("well", F.lit(log).alias("log"), F.lit(kind).alias("kind"), F.col("row_no").cast("long").alias("row_no"), ends[0].alias("start_md"), ends[1].alias("end_md"), each.alias("_v"))
    rows = rows.select("well", "log", "kind", "_v.name", "row_no", "start_md", "end_md", "_v.value")
    return rows.where("value is not null") if kind == "curve" else rows


def place_logs(logs: DataFrame, trace: DataFrame) -> DataFrame:
    """Point and curve logs with the trace vertex nearest in depth: seq, x, y, z; rows without a depth or a trace go."""
    k = F.struct("log", "name", "row_no")
    marks = logs.where("kind in ('point', 'curve') and start_md is not null").select("well", k.alias("key"), F.col("start_md").alias("md"))
    near = nearest_md(marks, trace).select("well", *[F.col(f"key.{c}").alias(c) for c in ("log", "name", "row_no")], "seq")
    at = near.join(trace.select("well", "seq", "x", "y", "z"), ["well", "seq"])
    return logs.join(at, ["well", "log", "name", "row_no"])


def log_names(logs: DataFrame, column: str = "log") -> DataFrame:
    """Sorted names of each well's logs or markers."""
    return logs.groupBy("well").agg(F.array_sort(F.collect_set(column)).alias("names"))
