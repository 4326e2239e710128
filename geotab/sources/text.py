"""Delimited point files, ASCII PLY, entity tables, and text exports of points and surfaces."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import orientation as O
from ..operators.catalog import _small
from ..operators.graph import settle, shuffled
from ..operators.mesh import boundary_edges
from ..operators.sections import corners

XYZ = ("x", "y", "z")


def sniff_separator(line: str) -> str:
    """Separator of a line: the most frequent of comma, semicolon, tab; else white space."""
    best = max(",;\t", key=line.count)
    return best if line.count(best) else " "


def _first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).first()
    return row[0] if row else ""


def _numbers(lines: DataFrame, columns: list[str], separator: str) -> DataFrame:
    pattern = r"\s+" if separator == " " else r"\s*" + re.escape(separator) + r"\s*"
    cells = F.split(F.trim("value"), pattern)
    return lines.select(*[F.expr(f"try_cast(get(_c, {i}) AS double)").alias(c) for i, c in enumerate(columns)]) if "_c" in lines.columns else lines.withColumn("_c", cells).select(
        *[c for c in lines.columns if c != "value"], *[F.expr(f"try_cast(get(_c, {i}) AS double)").alias(c) for i, c in enumerate(columns)]
    )


def read_points_text(spark: SparkSession, path: str, columns: list[str], separator: str | None = None, header: int = 0, rows: tuple[int, int] | None = None) -> DataFrame:
    """Points of delimited files: columns by position as numbers, values that are none are null; empty lines go.

    The separator is taken from the first line. The first header lines of each file go; rows (first, last) keeps only these rows
    of each file, counted from 0 behind the header, empty lines included.
    """
    sep = separator or sniff_separator(_first_line(spark, path))
    if header or rows:
        lines = numbered_lines(spark, path).where(F.col("line") >= header)
        if rows:
            lines = lines.where(F.col("line").between(header + rows[0], header + rows[1]))
    else:
        lines = spark.read.text(path)
    return _numbers(lines.where(F.length(F.trim("value")) > 0).select("value"), columns, sep)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files (value, file) with their number in the file, from 0, whatever blocks the files are read in."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "_block", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_move"))
    return lines.join(_small(blocks), ["file", "_block"]).select("value", "file", (F.col("_id") + F.col("_move")).alias("line"))


def ply_header(head: list[str]) -> tuple[int, int, list[str]]:
    """First line and number of vertex rows, and their properties, of an ASCII PLY header."""
    head = [h.strip() for h in head]
    if not head or head[0] != "ply" or not any(h.startswith("format ascii") for h in head) or "end_header" not in head:
        raise ValueError("not an ASCII PLY file")
    columns, elements = [], []
    for h in head:
        word = h.split()
        if word[:1] == ["element"]:
            elements.append((word[1], int(word[2])))
        elif word[:1] == ["property"] and elements and elements[-1][0] == "vertex":
            columns.append(word[-1])
    start = len(head)
    for name, count in elements:
        if name == "vertex":
            return start, count, columns
        start += count
    return start, 0, columns


def read_points_ply_ascii(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of ASCII PLY files as numbers; each file's own header says which lines hold them and names the columns.

    A property that a file lacks is null in its rows. Lines of the header start with a letter or are empty.
    """
    lines = numbered_lines(spark, path)
    heads = lines.where(F.col("value").rlike(r"^\s*([A-Za-z]|$)")).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("head"))

    def parse(batches):
        for pdf in batches:
            rows = [(f, *ply_header(_until_end(h))) for f, h in zip(pdf["file"], pdf["head"])]
            yield pd.DataFrame(rows, columns=["file", "start", "count", "columns"])

    heads = settle(heads.mapInPandas(parse, "file string, start long, count long, columns array<string>"), "ply")
    names = [r[0] for r in heads.select(F.explode("columns").alias("c")).groupBy("c").count().orderBy("c").collect()]
    names = [c for c in XYZ if c in names] + [c for c in names if c not in XYZ]
    if not names:
        raise ValueError("no PLY header")
    v = lines.join(_small(heads), "file").where((F.col("line") >= F.col("start")) & (F.col("line") < F.col("start") + F.col("count")))
    cells = v.select("columns", F.split(F.trim("value"), r"\s+").alias("_c"))
    at = lambda c: F.get("_c", F.array_position("columns", c).cast("int") - 1)
    return cells.select(*[F.when(F.array_contains("columns", c), at(c).try_cast("double")).alias(c) for c in names])


def _until_end(head) -> list[str]:
    """Lines of a header up to its end, by number; what follows are other lines that start with a letter."""
    out: list[str] = []
    for row in head:
        if row["value"].strip():
            out.append(row["value"])
        if row["value"].strip() == "end_header":
            return out + [""] * (row["line"] + 1 - len(out))
    return out


def write_points_ply(points: DataFrame, path: str) -> None:
    """Points (uid, point_id, x, y, z) as ASCII PLY, one file for each uid."""
    count = points.groupBy("uid").agg(F.count(F.lit(1)).cast("string").alias("n"))
    head = ["ply", "format ascii 1.0", "", "property double x", "property double y", "property double z", "end_header"]
    h = count.select("uid", F.posexplode(F.array(*[F.lit(v) if v else F.concat(F.lit("element vertex "), F.col("n")) for v in head])).alias("_k", "value"))
    body = points.select("uid", F.lit(len(head)).alias("_k"), F.concat_ws(" ", *[F.col(c).cast("string") for c in XYZ]).alias("value"), "point_id")
    rows = h.withColumn("point_id", F.lit(None).cast("long")).unionByName(body)
    rows.repartition("uid").sortWithinPartitions("uid", "_k", "point_id").select("uid", "value").write.partitionBy("uid").text(path)


def preview(df: DataFrame, n: int = 50, order: str | None = None) -> DataFrame:
    """The first n rows of a source, in the order of a column if one is given."""
    df = df.orderBy(order) if order else df
    return df.limit(n)


def row_range(df: DataFrame, start: int, stop: int, index: str = "row_no") -> DataFrame:
    """Rows start to stop, these included, by an index column."""
    return df.where(F.col(index).between(start, stop))


def write_entity_tables(tables: dict[str, DataFrame], path: str, fmt: str = "json") -> None:
    """Each table in a folder of its own."""
    for name, df in tables.items():
        df.write.mode("errorifexists").format(fmt).save(f"{path}/{name}")


def read_entity_tables(spark: SparkSession, path: str, schemas: dict[str, str], fmt: str = "json") -> dict[str, DataFrame]:
    return {name: spark.read.format(fmt).schema(ddl).load(f"{path}/{name}") for name, ddl in schemas.items()}


def save_revision(tables: dict[str, DataFrame], path: str, revision: str, fmt: str = "json") -> None:
    """A complete backup: tables in the folder rev_<revision> of path; a table of revisions beside it is written last, so it names whole ones only."""
    write_entity_tables(tables, f"{path}/rev_{revision}", fmt)
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(revision,)], "value string").coalesce(1).write.mode("append").text(f"{path}/revisions")


def open_revision(spark: SparkSession, path: str, schemas: dict[str, str], revision: str | None = None, fmt: str = "json") -> dict[str, DataFrame]:
    """Tables of a revision, by default of the one with the greatest name, which for dates is the last."""
    known = spark.read.text(f"{path}/revisions")
    found = known.agg(F.max("value")).first()[0] if revision is None else known.where(F.col("value") == revision).agg(F.max("value")).first()[0]
    if found is None:
        raise ValueError(f"no revision {revision or ''} in {path}")
    return read_entity_tables(spark, f"{path}/rev_{found}", schemas, fmt)


def flat_points(points: DataFrame) -> DataFrame:
    """Points with list columns split to _0, _1, ... (three), and dip and its direction when normals exist."""
    lists = [c for c, t in points.dtypes if t.startswith("array")]
    out = points
    for c in lists:
        out = out.withColumns({f"{c}_{i}": F.get(c, F.lit(i)) for i in range(3)})
    if "Normals" in lists:
        n = [F.get("Normals", F.lit(i)) for i in range(3)]
        out = out.withColumns({"dip dir": O.dip_direction(n[0], n[1]), "dip": O.dip(n[2])})
    return out.drop(*lists)


def export_points_csv(points: DataFrame, path: str) -> None:
    """One folder of CSV for each uid."""
    flat_points(points).write.partitionBy("uid").option("header", True).csv(path)


def surface_vertices(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """Vertices of surfaces, marked when they lie on a border."""
    rim = boundary_edges(triangles).select("uid", F.explode(F.array("a", "b")).alias("point_id")).distinct().withColumn("border", F.lit(True))
    return points.join(rim, ["uid", "point_id"], "left").withColumn("border", F.coalesce("border", F.lit(False)))


FILE_ROWS = 500_000  # wanted rows of a file of vertices


def export_surface_vertices(points: DataFrame, triangles: DataFrame, path: str) -> DataFrame:
    """CSV of vertices by uid and border, each in one file, or in several by its rows; returns the list of what was written."""
    v = settle(surface_vertices(points, triangles), "vertices")
    files = v.groupBy("uid", "border").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias("_files"))
    dealt = v.join(files, ["uid", "border"]).repartition("uid", "border", F.pmod(F.xxhash64("point_id"), F.col("_files"))).drop("_files")
    dealt.write.partitionBy("uid", "border").option("header", True).csv(path)
    return v.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.count_if("border").alias("n_border"))


def _decimal(c: Column) -> Column:
    return c.cast("string")


def landxml_lines(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """Text lines of LandXML surfaces: distinct vertices numbered from 1 in each, faces by these numbers.

    Lines carry (uid, part, ord) for their order: a surface's opening, points, faces, closing.
    """
    ids = points.select("uid", *XYZ).distinct().withColumn("n", F.dense_rank().over(Window.partitionBy("uid").orderBy(*XYZ)))
    numbered = points.join(ids, ["uid", *XYZ])
    t = triangles
    for k in "012":
        t = t.join(numbered.select("uid", F.col("point_id").alias("p" + k), F.col("n").alias("n" + k)), ["uid", "p" + k])
    line = lambda df, part, order, text: df.select("uid", F.lit(part).alias("part"), F.col(order).cast("long").alias("ord"), text.alias("value"))
    heads = points.select("uid").distinct().withColumn("zero", F.lit(0))
    return (
        line(heads, 0, "zero", F.concat(F.lit('<Surface name="'), F.col("uid").cast("string"), F.lit('"><Definition surfType="TIN"><Pnts>')))
        .union(line(ids, 1, "n", F.concat(F.lit('<P id="'), F.col("n").cast("string"), F.lit('">'), F.concat_ws(" ", _decimal(F.col("y")), _decimal(F.col("x")), _decimal(F.col("z"))), F.lit("</P>"))))
        .union(line(heads, 2, "zero", F.lit("</Pnts><Faces>")))
        .union(line(t, 3, "cell_id", F.concat(F.lit("<F>"), F.concat_ws(" ", *[F.col("n" + k).cast("string") for k in "012"]), F.lit("</F>"))))
        .union(line(heads, 4, "zero", F.lit("</Faces></Definition></Surface>")))
    )


def stl_lines(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """Text lines of ASCII STL, a solid for each uid."""
    t = corners(points, triangles)
    e = [tuple(F.col(c + k) - F.col(c + "0") for c in XYZ) for k in "12"]
    n = O.cross(*e)
    size = O.norm(n)
    unit = [F.coalesce(F.try_divide(v, size), F.lit(0.0)).cast("string") for v in n]
    facet = F.concat(
        F.lit("facet normal "), F.concat_ws(" ", *unit), F.lit("\nouter loop\n"),
        *[F.concat(F.lit("vertex "), F.concat_ws(" ", *[F.col(c + k).cast("string") for c in XYZ]), F.lit("\n")) for k in "012"], F.lit("endloop\nendfacet"),
    )
    heads = points.select("uid").distinct()
    ends = lambda part, word: heads.select("uid", F.lit(part).alias("part"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit(word + " "), F.col("uid").cast("string")).alias("value"))
    return ends(0, "solid").union(t.select("uid", F.lit(1), F.col("cell_id").cast("long"), facet)).union(ends(2, "endsolid"))


def obj_lines(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """Text lines of Wavefront OBJ: v lines in order of point, f lines by their 1-based numbers, for each uid."""
    v = points.withColumn("n", F.row_number().over(Window.partitionBy("uid").orderBy("point_id")))
    t = triangles
    for k in "012":
        t = t.join(shuffled(v).select("uid", F.col("point_id").alias("p" + k), F.col("n").alias("n" + k)), ["uid", "p" + k])
    a = v.select("uid", F.lit(0).alias("part"), F.col("n").cast("long").alias("ord"), F.concat_ws(" ", F.lit("v"), *[F.col(c).cast("string") for c in XYZ]).alias("value"))
    b = t.select("uid", F.lit(1).alias("part"), F.col("cell_id").cast("long").alias("ord"), F.concat_ws(" ", F.lit("f"), *[F.col("n" + k).cast("string") for k in "012"]).alias("value"))
    return a.union(b)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines (uid, part, ord, value) as text, a folder for each uid, in order of part and ord."""
    lines.repartition("uid").sortWithinPartitions("uid", "part", "ord").select("uid", "value").write.partitionBy("uid").text(path)


def vector_features(features: DataFrame) -> DataFrame:
    """Vertices of line features (feature_id, coords array of (x, y[, z]) arrays); a missing z is 0.

    coords of a multi-part line is an array of such arrays; its vertices have their part as well, and seq goes on from part to part.
    """
    parts = dict(features.dtypes)["coords"].count("array<") == 3
    p = features
    if parts:
        before = lambda k: F.aggregate(F.slice("coords", 1, k), F.lit(0), lambda n, c: n + F.greatest(F.size(c), F.lit(0)))
        p = p.select("feature_id", "coords", F.posexplode("coords").alias("part", "_line")).select("feature_id", "part", before(F.col("part")).alias("_before"), F.posexplode("_line").alias("_k", "_p"))
        p = p.withColumn("seq", F.col("_before") + F.col("_k"))
    else:
        p = p.select("feature_id", F.posexplode("coords").alias("seq", "_p"))
    return p.select("feature_id", *(["part"] if parts else []), "seq", *[F.get("_p", F.lit(i)).alias(c) for i, c in enumerate("xy")], F.coalesce(F.get("_p", F.lit(2)), F.lit(0.0)).alias("z"))
