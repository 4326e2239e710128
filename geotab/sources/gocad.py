"""Keyword-line exchange files of geomodels: points, lines and surfaces with properties.

A file holds objects between GOCAD and END. Reading takes one file at a time through a line parser in
a task; writing builds all lines as columns and sorts them within each entity.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import role_from_type, type_from_role

RECORDS = "file string, object long, kind string, id long, a long, b long, c long, x double, y double, z double, name string, type string, feature string, props array<double>, prop_names array<string>"

#: Object kinds and the topology of each.
TOPOLOGY = {"VSet": "VertexSet", "PLine": "PolyLine", "TSurf": "TriSurf"}


def _records(path: str, text: str):
    """One row for each object, vertex, segment and triangle of a file."""
    number, kind, head, props = -1, None, {}, []
    vertices: list[tuple] = []
    cells: list[tuple] = []
    header = False
    for raw in text.splitlines():
        word = raw.split()
        if not word:
            continue
        key = word[0].upper()
        if key == "GOCAD":
            number, kind, head, props, vertices, cells = number + 1, word[1] if len(word) > 1 else "", {}, [], [], []
        elif kind is None:
            continue
        elif key == "HEADER":
            header = "{" in raw and "}" not in raw
        elif key == "}":
            header = False
        elif raw.lower().startswith("name:") or (header and raw.strip().lower().startswith("name:")):
            head["name"] = raw.split(":", 1)[1].strip()
        elif key == "GEOLOGICAL_TYPE":
            head["type"] = "_".join(word[1:])
        elif key == "GEOLOGICAL_FEATURE":
            head["feature"] = "_".join(word[1:])
        elif key == "PROPERTIES":
            props = word[1:]
        elif key in ("VRTX", "PVRTX"):
            vertices.append((int(word[1]), *map(float, word[2:5]), [float(v) for v in word[5:]]))
        elif key in ("ATOM", "PATOM"):
            by = {v[0]: v for v in vertices}
            vertices.append((int(word[1]), *by[int(word[2])][1:4], [float(v) for v in word[3:]]))
        elif key == "SEG":
            cells.append(("segment", int(word[1]), int(word[2]), None))
        elif key == "TRGL":
            cells.append(("triangle", int(word[1]), int(word[2]), int(word[3])))
        elif key == "END":
            if vertices:  # empty objects are skipped
                place = {v[0]: i for i, v in enumerate(vertices)}
                yield (path, number, "object", len(vertices), None, None, None, None, None, None, head.get("name"), head.get("type"), head.get("feature"), None, props)
                for i, v in enumerate(vertices):
                    yield (path, number, "point", i, None, None, None, *v[1:4], None, None, None, v[4], props)
                for i, (what, a, b, c) in enumerate(cells):
                    yield (path, number, what, i, place[a], place[b], None if c is None else place[c], None, None, None, None, None, None, None, None)
            kind = None


def read_gocad(spark: SparkSession, path: str, parent_uid: str | None = None) -> dict[str, DataFrame]:
    """Tables entities, points, segments and triangles of exchange files; ids count from 0 in each object.

    parent_uid: section that the entities belong to, if any.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def parse(batches):
        for pdf in batches:
            for p, text in zip(pdf["path"], pdf["value"]):
                rows = list(_records(p, text))
                for at in range(0, len(rows), 50_000):
                    part = pd.DataFrame(rows[at : at + 50_000], columns=[c.split()[0] for c in RECORDS.split(", ")])
                    for c in ("id", "a", "b", "c"):
                        part[c] = part[c].astype("Int64")
                    yield part

    r = files.mapInPandas(parse, RECORDS)
    folders = F.split("file", "/")  # names alone may repeat in other folders
    uid = F.concat_ws("#", F.array_join(F.slice(folders, -2, 2), "/"), F.col("object").cast("string")).alias("uid")
    e = r.where("kind = 'object'")
    entities = e.select(uid, "name", role_from_type(F.coalesce("type", F.lit("undef"))).alias("role"), F.coalesce("feature", F.lit("undef")).alias("feature"), F.lit(parent_uid).alias("parent_uid"), F.col("prop_names").alias("properties_names"), F.col("id").alias("n_points"))
    points = r.where("kind = 'point'").select(uid, F.col("id").alias("point_id"), "x", "y", "z", "props")
    segments = r.where("kind = 'segment'").select(uid, F.col("id").alias("cell_id"), F.col("a").alias("p0"), F.col("b").alias("p1"))
    triangles = r.where("kind = 'triangle'").select(uid, F.col("id").alias("cell_id"), F.col("a").alias("p0"), F.col("b").alias("p1"), F.col("c").alias("p2"))
    return {"entities": entities, "points": points, "segments": segments, "triangles": triangles}


def gocad_lines(entities: DataFrame, points: DataFrame, triangles: DataFrame | None = None, segments: DataFrame | None = None) -> DataFrame:
    """Text lines (uid, part, ord, value) of entities (uid, role, feature, topology, time); ids are written from 1."""
    word = F.when(F.col("topology") == "TriSurf", "TSurf").when(F.col("topology") == "VertexSet", "VSet").otherwise("PLine")
    e = entities.withColumn("_t", type_from_role(F.col("role")))
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("GOCAD "), word, F.lit(" 1")),
        F.concat(F.lit("HEADER {\nname:"), F.col("uid").cast("string"), F.lit("\n}")),
        F.concat(F.lit("GEOLOGICAL_TYPE "), F.col("_t")),
        F.concat(F.lit("GEOLOGICAL_FEATURE "), F.col("feature")),
        F.concat(F.lit("STRATIGRAPHIC_POSITION "), F.col("time").cast("string")),
        F.when(F.col("topology") == "TriSurf", "TFACE").when(F.col("topology") != "VertexSet", "ILINE"),
    )
    zero = F.lit(0).cast("long")
    out = e.select("uid", F.lit(0).alias("part"), zero.alias("ord"), head.alias("value"))
    p = points.select("uid", F.lit(1), F.col("point_id").cast("long"), F.concat_ws(" ", F.lit("VRTX"), (F.col("point_id") + 1).cast("string"), *[F.col(c).cast("string") for c in "xyz"]))
    out = out.union(p.join(e.select("uid"), "uid", "left_semi"))
    for name, ids, cells in (("TRGL", "012", triangles), ("SEG", "01", segments)):
        if cells is not None:
            c = cells.join(e.select("uid"), "uid", "left_semi")
            out = out.union(c.select("uid", F.lit(2), F.col("cell_id").cast("long"), F.concat_ws(" ", F.lit(name), *[(F.col("p" + k) + 1).cast("string") for k in ids])))
    return out.union(e.select("uid", F.lit(3), zero, F.lit("END")))


def write_gocad(entities: DataFrame, points: DataFrame, path: str, triangles: DataFrame | None = None, segments: DataFrame | None = None) -> None:
    """A folder for each entity."""
    from .text import write_lines

    write_lines(gocad_lines(entities, points, triangles, segments), path)
