"""Regular grids, elevation models, images and seismic volumes as tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cells
from .graph import settle, shuffled

XYZ = ("x", "y", "z")


def dem_from_raster(raster: DataFrame, nodata: str = "max") -> DataFrame:
    """Nodes x, y, z of rasters (uid, r, c, value, x0, y0, dx, dy); the largest or smallest value is no data."""
    if nodata not in ("max", "min", "none"):
        raise ValueError("nodata must be max, min or none")
    out = raster
    if nodata != "none":
        mark = raster.groupBy("uid").agg((F.max if nodata == "max" else F.min)("value").alias("_mark"))
        out = raster.join(mark, "uid").withColumn("value", F.when(F.col("value") != F.col("_mark"), F.col("value"))).drop("_mark")
    return out.select("uid", "r", "c", (F.col("x0") + F.col("c") * F.col("dx")).alias("x"), (F.col("y0") - F.col("r") * F.col("dy")).alias("y"), F.col("value").alias("z"))


def map_pixels(raster: DataFrame, extent: tuple[float, float, float, float], rows: int, cols: int, literal: bool = False) -> DataFrame:
    """Pixels (r, c, bands) at map coordinates of an extent (x0, x1, y0, y1), with one or three bands; more than four are refused when the rows are read.

    literal: spacing by rows + 1 and columns + 1 instead of rows and columns.
    """
    x0, x1, y0, y1 = map(float, extent)
    extra = 1 if literal else 0
    n = F.size("bands")
    refused = F.raise_error(F.concat(F.lit("an image has four bands at most, not "), n.cast("string"))).cast("array<double>")
    kept = F.when(n <= 2, F.slice("bands", 1, 1)).when(n <= 4, F.slice("bands", 1, 3)).when(n > 4, refused)
    return raster.select("uid", "r", "c", (x0 + F.col("c") * ((x1 - x0) / (cols + extra))).alias("x"), (y1 - F.col("r") * ((y1 - y0) / (rows + extra))).alias("y"), kept.alias("bands"))


def section_pixels(raster: DataFrame, sections: DataFrame, u0: float, v0: float, length: float, height: float, rows: int, cols: int) -> DataFrame:
    """Pixels of images in space, on the section that their column section names, or on every section without one: columns along strike from u0, rows down dip from v0."""
    from .sections import _named, _spread

    p = raster.join(_named(sections), "section") if "section" in raster.columns else _spread(raster).crossJoin(_named(sections))
    u, v = u0 + F.col("c") * (length / cols), v0 + F.col("r") * (height / rows)
    keys = [c for c in raster.columns if c not in ("r", "c", "value", "section", *XYZ)]
    return p.select(*keys, "r", "c", "section", *[(F.col("origin_" + k) + u * F.col("u" + k) + v * F.col("v" + k)).alias(k) for k in XYZ], "value")


def seismic_volume(traces: DataFrame, interval: float) -> DataFrame:
    """Samples of traces as nodes: depth slices from the bottom up, z from -depth / 8 to 0."""
    n = F.size("samples")
    s = traces.select("uid", "inline", "xline", "cdp_x", "cdp_y", n.alias("n"), F.posexplode(F.reverse("samples")).alias("k", "value"))
    z = (-(F.col("n") * interval) + F.col("k") * F.try_divide(F.col("n") * interval, F.col("n") - 1)) / 8
    return s.select("uid", "inline", "xline", "k", "cdp_x", "cdp_y", z.alias("z"), "value")


def regularize_trace_headers(traces: DataFrame) -> DataFrame:
    """Inline, crossline and positions of traces (uid, trace_no) on a square grid; what exceeds it is dropped.

    trace_no is the dense order of the file from 0, so no ranking is needed.
    """
    n = traces.groupBy("uid").agg(F.floor(F.sqrt(F.count(F.lit(1)))).alias("side"))
    t = traces.join(n, "uid").where(F.col("trace_no") < F.col("side") * F.col("side"))
    t = t.withColumns({"inline": F.floor(F.col("trace_no") / F.col("side")) + 1, "xline": F.pmod(F.col("trace_no"), F.col("side")) + 1})
    return t.withColumns({"cdp_x": F.col("inline") * 100.0, "cdp_y": F.col("xline") * 100.0}).drop("side")


def grid_nodes(grids: DataFrame) -> DataFrame:
    """Cell centers of grids (origin, spacing, dims, row-major 3x3 direction)."""
    g = grids.withColumn("k", F.explode(F.sequence(F.lit(0), F.get("dims", F.lit(2)) - 1)))
    g = g.withColumn("j", F.explode(F.sequence(F.lit(0), F.get("dims", F.lit(1)) - 1))).withColumn("i", F.explode(F.sequence(F.lit(0), F.get("dims", F.lit(0)) - 1)))
    step = [(F.col(n) + 0.5) * F.get("spacing", F.lit(a)) for a, n in enumerate("ijk")]
    at = {c: F.get("origin", F.lit(r)) + sum((F.get("direction", F.lit(3 * r + a)) * step[a] for a in range(3)), F.lit(0.0)) for r, c in enumerate(XYZ)}
    return g.select("uid", "i", "j", "k", *[v.alias(c) for c, v in at.items()])


def voxet_box(grids: DataFrame) -> DataFrame:
    """The eight corners of grids."""
    ends = F.explode(F.array(*[F.struct(F.lit(n).alias("corner"), *[F.lit(float(n >> a & 1)).alias(d) for a, d in enumerate("ijk")]) for n in range(8)])).alias("e")
    g = grids.select("*", ends)
    step = [F.col(f"e.{n}") * F.get("spacing", F.lit(a)) * F.get("dims", F.lit(a)) for a, n in enumerate("ijk")]
    at = {c: F.get("origin", F.lit(r)) + sum((F.get("direction", F.lit(3 * r + a)) * step[a] for a in range(3)), F.lit(0.0)) for r, c in enumerate(XYZ)}
    return g.select("uid", "e.corner", *[v.alias(c) for c, v in at.items()])


def extract_slices(values: DataFrame, axis: str, n: int, size: int, start: float = 0.0, end: float = 1.0) -> DataFrame:
    """n evenly spaced slices along an axis (i, j or k), values interpolated between the two layers next to each."""
    if axis not in "ijk":
        raise ValueError("axis must be i, j or k")
    spots = [start + (end - start) * s / max(1, n - 1) for s in range(n)]
    at = [min(max(p, 0.0), 1.0) * (size - 1) for p in spots]
    plan = [(s, min(int(p), max(0, size - 2)), p - min(int(p), max(0, size - 2))) for s, p in enumerate(at)]
    slices = F.array(*[F.struct(F.lit(s).alias("slice"), F.lit(k).alias("k0"), F.lit(float(f)).alias("f")) for s, k, f in plan])
    rest = [c for c in "ijk" if c != axis]
    v = values.withColumn("_s", F.explode(F.filter(slices, lambda s: (s["k0"] == F.col(axis)) | (s["k0"] + 1 == F.col(axis)))))
    weight = F.when(F.col("_s.k0") == F.col(axis), 1 - F.col("_s.f")).otherwise(F.col("_s.f"))
    v = v.withColumn("_w", weight).where("_w > 0")
    return v.groupBy(F.col("_s.slice").alias("slice"), *rest).agg((F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("value"))


def iso_crossings(values: DataFrame, iso: float) -> DataFrame:
    """Points on grid edges in which a value is crossed, in index coordinates, with the edge's axis."""
    parts = []
    for axis in "ijk":
        to = values.select(*[(F.col(c) - (1 if c == axis else 0)).cast("int").alias(c) for c in "ijk"], F.col("value").alias("next"))
        e = values.join(to, ["i", "j", "k"])
        cut = (F.col("value") < iso) != (F.col("next") < iso)
        t = (iso - F.col("value")) / (F.col("next") - F.col("value"))
        parts.append(e.where(cut).select(F.lit(axis).alias("axis"), "i", "j", "k", *[(F.col(c) + (t if c == axis else 0)).cast("double").alias(x) for c, x in zip("ijk", XYZ)]))
    return parts[0].union(parts[1]).union(parts[2])


#: The six tetrahedra of a cube around its diagonal 0-7; bit 0, 1, 2 of a corner is its i, j, k.
_TETS = [(0, 1, 3, 7), (0, 3, 2, 7), (0, 2, 6, 7), (0, 6, 4, 7), (0, 4, 5, 7), (0, 5, 1, 7)]


def _cut_table() -> list[list[tuple]]:
    """Triangles of a tetrahedron by the mask of its vertices below the value; corners are edges (a, b) of it."""
    table: list[list[tuple]] = []
    for mask in range(16):
        low = [v for v in range(4) if mask >> v & 1]
        high = [v for v in range(4) if v not in low]
        if len(low) == 2:
            (a, b), (p, q) = low, high
            quad = [(a, p), (a, q), (b, q), (b, p)]
            table.append([tuple(quad[:3]), (quad[0], quad[2], quad[3])])
        elif len(low) in (1, 3):
            lone, rest = (low, high) if len(low) == 1 else (high, low)
            table.append([tuple((lone[0], v) for v in rest)])
        else:
            table.append([])
    return table


def iso_triangles(values: DataFrame, iso: float) -> DataFrame:
    """Triangles of an iso-surface by marching tetrahedra: tet, tri, corner, and a key of the grid edge each corner lies on.

    Each node goes to the eight cells it is a corner of; cells gather their corners in one grouping. Cells with a corner missing or null have no triangles.
    """
    corner = [F.struct(*[(F.col(a) - (n >> s & 1)).cast("int").alias(a) for s, a in enumerate("ijk")], F.lit(n).alias("n")) for n in range(8)]
    c = values.where("value is not null").select("value", F.explode(F.array(*corner)).alias("_c")).select("value", "_c.*")
    c = c.groupBy("i", "j", "k").agg(*[F.max(F.when(F.col("n") == n, F.col("value"))).alias(f"v{n}") for n in range(8)])
    names = [f"v{n}" for n in range(8)]
    whole = sum((F.col(v).isNull().cast("int") for v in names), F.lit(0)) == 0
    c = c.where(whole & (F.least(*names) < iso) & (F.greatest(*names) >= iso)).select("i", "j", "k", F.array(*names).alias("v"))
    ints = lambda xs: F.array(*[F.lit(x) for x in xs])
    t = c.select("*", F.posexplode(F.array(*[ints(x) for x in _TETS])).alias("tet", "w"))
    mask = sum((F.when(F.get("v", F.get("w", F.lit(n))) < iso, 1 << n).otherwise(0) for n in range(4)), F.lit(0))
    none = F.array().cast("array<array<array<int>>>")
    cases = F.array(*[F.array(*[F.array(*[ints(e) for e in tri]) for tri in tris]) if tris else none for tris in _cut_table()])
    t = t.select("i", "j", "k", "v", "w", "tet", F.posexplode(F.get(cases, mask)).alias("tri", "edges"))
    t = t.select("i", "j", "k", "v", "w", "tet", "tri", F.posexplode("edges").alias("corner", "e"))
    ends = [F.get("w", F.get("e", F.lit(n))) for n in (0, 1)]
    t = t.withColumns({"a": F.least(*ends), "b": F.greatest(*ends)})
    at = lambda n, s: F.shiftright(F.col(n), s).bitwiseAND(F.lit(1))
    share = (iso - F.get("v", F.col("a"))) / (F.get("v", F.col("b")) - F.get("v", F.col("a")))
    t = t.withColumn("t", share)
    key = F.concat_ws("/", *[(F.col(d) + at(n, s)).cast("string") for n in "ab" for s, d in enumerate("ijk")])
    xyz = [(F.col(d) + at("a", s) + F.col("t") * (at("b", s) - at("a", s))).alias(x) for s, (d, x) in enumerate(zip("ijk", XYZ))]
    return t.select("i", "j", "k", "tet", "tri", "corner", key.alias("edge"), *xyz)


def grid_to_section(values: DataFrame, sections: DataFrame, spacing: float, rows: int, cols: int, origin=(0.0, 0.0, 0.0), step=(1.0, 1.0, 1.0)) -> DataFrame:
    """A regular U-Z raster of vertical sections with the value of the nearest grid node; null outside."""
    s = sections.select(F.col("uid").alias("section"), "strike", *["origin_" + c for c in XYZ])
    s = s.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    a = F.radians("strike")
    at = {"i": F.col("origin_x") + F.col("col") * spacing * F.sin(a), "j": F.col("origin_y") + F.col("col") * spacing * F.cos(a), "k": F.col("origin_z") - F.col("row") * spacing}
    s = s.withColumns({n: F.bround((v - o) / d, 0).cast("int") for (n, v), o, d in zip(at.items(), origin, step)})
    return s.join(values, ["i", "j", "k"], "left").select("section", "row", "col", "i", "j", "k", "value")


def drape_regular(points: DataFrame, dem: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """z of points from the nearest node of a regular DEM (r, c at y0 + r dy, x0 + c dx); null off the DEM."""
    p = points.withColumns({"c": F.bround((F.col("x") - x0) / dx, 0).cast("int"), "r": F.bround((F.col("y") - y0) / dy, 0).cast("int")})
    return p.join(dem.select("r", "c", F.col("z").alias("_z")), ["r", "c"], "left").withColumn("z", F.col("_z")).drop("_z", "r", "c")


LEAF = 256  # wanted nodes of a cell
PART = 16_384  # points that ask a cell at a time


def drape_irregular(points: DataFrame, nodes: DataFrame, cell: float | None = None, leaf: int = LEAF) -> DataFrame:
    """z of points from the nearest node in XY, ties to the smaller node id. Points with null coordinates go, unless there are no nodes.

    Nodes lie in k-d cells of about leaf nodes. Each point asks the cell it lies in, then the other cells that the circle through the nearest node
    so far meets; a cell's askers are dealt out in parts. cell isn't needed any more.
    """
    places = nodes.where("x is not null and y is not null").groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    places = places.agg(F.min(F.struct("node", "z")).alias("n")).select(F.lit(0).alias("uid"), F.col("n.node").alias("point_id"), "x", "y", F.lit(0.0).alias("z"), F.col("n.z").alias("nz"))
    places = settle(places, "nodes")
    if places.isEmpty():
        return points.withColumn("z", F.lit(None).cast("double"))
    splits = cells.splits_of(places.drop("nz"), leaf)
    places = settle(places.withColumn("leaf", cells.leaf_of(places, splits)), "nodes")
    asked = points.where("x is not null and y is not null").select(F.lit(0).alias("uid"), *[F.col(c).cast("double").alias(c) for c in "xy"], F.lit(0.0).alias("z")).distinct()
    asked = settle(asked.withColumn("leaf", cells.leaf_of(asked, splits)), "asked")
    kind = {k: dict(places.dtypes)[k] for k in ("point_id", "nz")}

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("point_id")
        own, other = left[["x", "y"]].to_numpy(), right[["x", "y"]].to_numpy()
        pick, best = np.zeros(len(own), np.int64), np.zeros(len(own))
        step = max(1, (1 << 20) // max(1, len(other)))
        for at in range(0, len(own), step) if len(other) else ():
            d = np.sqrt((own[at : at + step, 0, None] - other[None, :, 0]) ** 2 + (own[at : at + step, 1, None] - other[None, :, 1]) ** 2)
            pick[at : at + step] = d.argmin(1)  # the first one, so the smaller id
            best[at : at + step] = d.min(1)
        if not len(other):
            best, ids, z = np.full(len(own), np.inf), [None] * len(own), [None] * len(own)
        else:
            ids, z = right["point_id"].to_numpy()[pick], right["nz"].to_numpy()[pick]
        return pd.DataFrame({"x": left["x"], "y": left["y"], "home": left["leaf"], "d": best, "node": ids, "nz": z})

    def visit(asking: DataFrame) -> DataFrame:
        """Nearest node of the leaf that each of asking visits."""
        parts = asking.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / PART).cast("long").alias("_of"))
        left = shuffled(asking).join(parts, "leaf").select("leaf", F.pmod(F.xxhash64("x", "y"), F.col("_of")).alias("part"), "x", "y")
        right = shuffled(places).join(parts, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1)))
        right = right.select(*[F.col(c).alias(c) for c in ("leaf", "part", "point_id", "x", "y", "nz")])
        shape = f"x double, y double, home long, d double, node {kind['point_id']}, nz {kind['nz']}"
        return left.groupBy("leaf", "part").cogroup(right.groupBy("leaf", "part")).applyInPandas(nearest, shape)

    found = settle(visit(asked), "nearest")
    best = F.min(F.struct("d", "node", "nz")).alias("m")
    if splits:
        more = found.select(F.lit(0).alias("uid"), "x", "y", F.lit(0.0).alias("z"), "home", (F.col("d") * (1 + 1e-9) + 1e-9).alias("d"))
        more = more.withColumn("leaf", F.explode(cells.leaves_near(more, splits, "d"))).where("leaf <> home")
        found = found.drop("home").unionByName(visit(more).drop("home"))
    found = found.where("node is not null").groupBy("x", "y").agg(best).select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("m.nz").alias("z"))
    p = points.drop("z")
    got = shuffled(p).join(found, (p["x"].cast("double") == F.col("_x")) & (p["y"].cast("double") == F.col("_y")))
    return got.select(*points.columns, *(["z"] if "z" not in points.columns else []))


#: Zones of the supported Transverse Mercator codes (WGS84 and RDN2008 share an ellipsoid here).
TM_CODES = {32632: (9.0, 5e5), 32633: (15.0, 5e5), 32634: (21.0, 5e5), 6707: (9.0, 5e5), 6708: (15.0, 5e5), 6709: (21.0, 5e5), 7791: (9.0, 5e5), 7792: (15.0, 5e5), 7793: (21.0, 5e5), 6875: (12.0, 7e6), 6876: (12.0, 3e6)}
_SCALE = {6875: 0.9985000001, 6876: 1.0}


def _kruger():
    """Fourth-order coefficients of the published series in the third flattening."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    )
    delta = (
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    )
    return n, a, alpha, beta, delta


def tm_to_geographic(x: Column, y: Column, code: int) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of Transverse Mercator coordinates (fourth-order series)."""
    lon0, east = TM_CODES[code]
    n, a, _, beta, delta = _kruger()
    k = _SCALE.get(code, 0.9996) * a
    xi, eta = y / k, (x - east) / k
    xi1 = xi - sum((F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(beta, 1)), F.lit(0.0))
    eta1 = eta - sum((F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(beta, 1)), F.lit(0.0))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi + sum((F.lit(d) * F.sin(2 * j * chi) for j, d in enumerate(delta, 1)), F.lit(0.0))
    return lon0 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(lat)


def geographic_to_tm(lon: Column, lat: Column, code: int) -> tuple[Column, Column]:
    lon0, east = TM_CODES[code]
    n, a, alpha, _, _ = _kruger()
    k = _SCALE.get(code, 0.9996) * a
    c = 2 * n**0.5 / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - c * F.atanh(c * s))
    d = F.radians(lon - lon0)
    xi = F.atan2(t, F.cos(d))
    eta = F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x = eta + sum((F.lit(v) * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, v in enumerate(alpha, 1)), F.lit(0.0))
    y = xi + sum((F.lit(v) * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, v in enumerate(alpha, 1)), F.lit(0.0))
    return east + k * x, k * y


def reproject_tm(points: DataFrame, source: int, target: int) -> DataFrame:
    """x, y between Transverse Mercator codes of one datum."""
    lon, lat = tm_to_geographic(F.col("x"), F.col("y"), source)
    p = points.withColumns({"_lon": lon, "_lat": lat})
    x, y = geographic_to_tm(F.col("_lon"), F.col("_lat"), target)
    return p.withColumns({"x": x, "y": y}).drop("_lon", "_lat")


def boundary_box(corners: DataFrame, top: float, bottom: float, volume: bool = False) -> DataFrame:
    """Boundary entities from four corners (uid, x1..y4): a closed rectangle at z = 0, or the eight vertices of a box."""
    at = [(F.col(f"x{i}"), F.col(f"y{i}")) for i in (1, 2, 3, 4)]
    levels = [(top, at), (bottom, at)] if volume else [(0.0, [*at, at[0]])]
    rows = [F.struct(F.lit(n).cast("long").alias("point_id"), x.alias("x"), y.alias("y"), F.lit(float(z)).alias("z")) for n, (z, x, y) in enumerate((z, x, y) for z, ring in levels for x, y in ring)]
    return corners.select("uid", F.explode(F.array(*rows)).alias("p")).select("uid", "p.*")


def box_triangles(corners: DataFrame) -> DataFrame:
    """The twelve triangles of a boundary box's vertices."""
    t = [(0, 1, 2), (0, 2, 3), (4, 6, 5), (4, 7, 6)] + [x for i in range(4) for x in ((i, i + 4, (i + 1) % 4), ((i + 1) % 4, i + 4, (i + 1) % 4 + 4))]
    rows = [F.struct(F.lit(n).cast("long").alias("cell_id"), *[F.lit(v).cast("long").alias(f"p{k}") for k, v in enumerate(x)]) for n, x in enumerate(t)]
    return corners.select("uid", F.explode(F.array(*rows)).alias("t")).select("uid", "t.*")


def three_point_box(points: DataFrame) -> DataFrame:
    """Rectangles of three points (uid, x1..y3): the third is moved square to the first side; the angle is that side's."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    size = F.sqrt(dx * dx + dy * dy)
    nx, ny = F.try_divide(-dy, size), F.try_divide(dx, size)
    h = (F.col("x3") - F.col("x2")) * nx + (F.col("y3") - F.col("y2")) * ny
    return points.withColumns({"_h": h, "_nx": nx, "_ny": ny}).select(
        "uid", "x1", "y1", "x2", "y2", (F.col("x2") + F.col("_h") * F.col("_nx")).alias("x3"), (F.col("y2") + F.col("_h") * F.col("_ny")).alias("y3"),
        (F.col("x1") + F.col("_h") * F.col("_nx")).alias("x4"), (F.col("y1") + F.col("_h") * F.col("_ny")).alias("y4"), F.degrees(F.atan2(dy, dx)).alias("angle"),
    )


