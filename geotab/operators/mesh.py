"""Triangulated surfaces: points (uid, point_id, x, y, z) and triangles (uid, cell_id, p0, p1, p2)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import orientation as O
from .graph import components, settle, shuffled
from .sections import corners

XYZ = ("x", "y", "z")


def _edges(triangles: DataFrame, *keep: str) -> DataFrame:
    pairs = [F.struct(F.least("p" + a, "p" + b).alias("a"), F.greatest("p" + a, "p" + b).alias("b"), F.lit(i).alias("side")) for i, (a, b) in enumerate(("01", "12", "20"))]
    return triangles.select("uid", "cell_id", *keep, F.explode(F.array(*pairs)).alias("e")).select("uid", "cell_id", *keep, "e.*")


def boundary_edges(triangles: DataFrame) -> DataFrame:
    """Edges (a < b) that exactly one triangle has."""
    return _edges(triangles).groupBy("uid", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("cell_id").alias("cell_id")).where("n = 1").drop("n")


def connected_parts(cells: DataFrame) -> DataFrame:
    """region_id of every point of cells (uid, array ids): parts of connectivity, numbered from 0 by smallest point."""
    e = cells.select("uid", F.explode(F.slice("ids", F.lit(2), F.size("ids"))).alias("b"), F.get("ids", F.lit(0)).alias("a"))
    key = lambda c: F.struct("uid", F.col(c).alias("id"))
    g = components(e.select(key("a").alias("a"), key("b").alias("b")))
    g = g.select("node.uid", F.col("node.id").alias("point_id"), F.col("component.id").alias("low"))
    ids = g.select("uid", "low").distinct().withColumn("region_id", F.row_number().over(Window.partitionBy("uid").orderBy("low")) - 1)
    return g.join(ids, ["uid", "low"]).select("uid", "point_id", "region_id")


def boundary_loops(triangles: DataFrame, rounds: int = 40) -> DataFrame:
    """Boundary edges chained into closed rings: uid, ring (smallest vertex), number, point_id, from the smallest vertex on towards its smaller neighbour; short rings go.

    At a vertex where several rings meet, neighbours in ascending order go together by twos. Half-edges point to the next one of their
    ring; pointers are doubled round by round, first to find each ring's least half-edge, then to count the steps to it, so no task holds a ring.
    """
    e = boundary_edges(triangles).select("uid", "a", "b")
    both = e.union(e.select("uid", "b", "a"))
    place = F.row_number().over(Window.partitionBy("uid", "a").orderBy("b")) - 1
    spoke = settle(both.withColumn("_pair", F.floor(place / 2)), "spokes")
    # from a over b, the next vertex is the other one of b's pair
    turn = spoke.select("uid", F.col("a").alias("b"), F.col("b").alias("a"), "_pair").join(spoke.select("uid", F.col("a").alias("b"), F.col("b").alias("c"), "_pair"), ["uid", "b", "_pair"])
    edge = lambda p, q: F.struct(F.col(p).alias("a"), F.col(q).alias("b"))
    start = settle(turn.where("a <> c").select("uid", edge("a", "b").alias("at"), edge("b", "c").alias("to")), "turns")

    at = start.withColumn("low", F.col("at"))
    for _ in range(rounds):
        far = at.select("uid", F.col("at").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        new = at.join(far, ["uid", "to"]).select("uid", "at", F.col("_to").alias("to"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("_new"))
        new = settle(new, "lows")
        at = new.drop("_new")
        if new.where("_new").isEmpty():
            break
    # each ring is met in both directions; the one with the smaller first half-edge stays, as it begins at the smallest vertex
    low = at.select("uid", "at", "low")
    back = low.select("uid", F.struct(F.col("at.b").alias("a"), F.col("at.a").alias("b")).alias("at"), F.col("low").alias("_other"))
    ring = low.join(back, ["uid", "at"]).where(F.col("low") < F.col("_other")).select("uid", "at", "low")
    # steps to the last half-edge, which has no next one
    rank = start.join(ring, ["uid", "at"]).withColumn("to", F.when(F.col("to") != F.col("low"), F.col("to"))).withColumn("n", F.when(F.col("to").isNull(), 0).otherwise(1))
    rank = settle(rank, "ranks")
    for _ in range(rounds):
        if rank.where("to is not null").isEmpty():
            break
        far = rank.select("uid", F.col("at").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"))
        rank = settle(rank.join(far, ["uid", "to"], "left").select("uid", "at", "low", F.col("_to").alias("to"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n")), "ranks")
    size = rank.groupBy("uid", "low").agg(F.max("n").alias("_last"))
    out = rank.join(size, ["uid", "low"]).where("_last >= 2")
    return out.select("uid", F.col("low.a").alias("ring"), (F.col("_last") - F.col("n")).cast("long").alias("number"), F.col("at.a").alias("point_id"))


def clean_topology(points: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points merged where they coincide exactly, and triangles on the merged ids; collapsed ones go."""
    low = points.groupBy("uid", *XYZ).agg(F.min("point_id").alias("low"))
    ids = shuffled(points.join(low, ["uid", *XYZ]).select("uid", "point_id", "low"))
    t = triangles
    for k in "012":
        t = t.join(ids.select("uid", F.col("point_id").alias("p" + k), F.col("low").alias("q" + k)), ["uid", "p" + k])
    t = t.select("uid", "cell_id", *[F.col("q" + k).alias("p" + k) for k in "012"]).where("p0 <> p1 and p1 <> p2 and p0 <> p2")
    return low.select("uid", F.col("low").alias("point_id"), *XYZ), t


def _normal():
    e = [tuple(F.col(c + k) - F.col(c + "0") for c in XYZ) for k in "12"]
    return O.cross(*e)


def triangle_normals(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """Unit normal and area of each triangle; a degenerate one has null normal."""
    n = _normal()
    t = corners(points, triangles).withColumns({f"_n{c}": v for c, v in zip(XYZ, n)})
    size = O.norm(("_nx", "_ny", "_nz"))
    t = t.withColumn("_s", size)
    return t.select("uid", "cell_id", "p0", "p1", "p2", *[F.try_divide(F.col("_n" + c), F.col("_s")).alias("n" + c) for c in XYZ], (F.col("_s") / 2).alias("area"))


def mesh_area(points: DataFrame, triangles: DataFrame) -> DataFrame:
    return triangle_normals(points, triangles).groupBy("uid").agg(F.sum("area").alias("area"))


def vertex_normals(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """Unit sum of the unit normals of each vertex's triangles."""
    t = triangle_normals(points, triangles).select("uid", F.explode(F.array("p0", "p1", "p2")).alias("point_id"), "nx", "ny", "nz")
    s = t.groupBy("uid", "point_id").agg(*[F.sum("n" + c).alias("s" + c) for c in XYZ])
    size = O.norm(("sx", "sy", "sz"))
    return s.select("uid", "point_id", *[F.try_divide(F.col("s" + c), size).alias("n" + c) for c in XYZ])


def dilate_boundary(points: DataFrame, triangles: DataFrame, tol: float) -> DataFrame:
    """Boundary vertices moved outwards by tol, in the planes of their boundary triangles."""
    n = triangle_normals(points, triangles)
    e = _edges(n, "nx", "ny", "nz", "p0", "p1", "p2").join(boundary_edges(triangles).select("uid", "a", "b"), ["uid", "a", "b"])
    # the edge in the triangle's own winding, so that normal x edge points inwards
    tail = F.when(F.col("side") == 0, F.col("p0")).when(F.col("side") == 1, F.col("p1")).otherwise(F.col("p2"))
    head = F.when(F.col("side") == 0, F.col("p1")).when(F.col("side") == 1, F.col("p2")).otherwise(F.col("p0"))
    e = e.withColumns({"tail": tail, "head": head})
    for k in ("tail", "head"):
        e = e.join(shuffled(points).select("uid", F.col("point_id").alias(k), *[F.col(c).alias(k + c) for c in XYZ]), ["uid", k])
    out = O.cross(tuple(F.col("head" + c) - F.col("tail" + c) for c in XYZ), ("nx", "ny", "nz"))
    e = e.withColumns({f"o{c}": v for c, v in zip(XYZ, out)}).withColumn("_s", O.norm(("ox", "oy", "oz"))).where("_s > 0")
    v = e.select("uid", F.explode(F.array("tail", "head")).alias("point_id"), *[(F.col("o" + c) / F.col("_s")).alias("o" + c) for c in XYZ])
    v = v.groupBy("uid", "point_id").agg(*[F.sum("o" + c).alias("o" + c) for c in XYZ]).withColumn("_s", O.norm(("ox", "oy", "oz")))
    p = points.join(v, ["uid", "point_id"], "left")
    return p.select("uid", "point_id", *[(F.col(c) + F.coalesce(F.try_divide(F.col("o" + c), F.col("_s")) * tol, F.lit(0.0))).alias(c) for c in XYZ])


def subdivide(points: DataFrame, triangles: DataFrame, n: int = 1) -> tuple[DataFrame, DataFrame]:
    """Each triangle as four, n times; new mid-edge vertices are shared and get ids after the old ones."""
    for _ in range(n):
        e = _edges(triangles).select("uid", "a", "b").distinct()
        last = points.groupBy("uid").agg(F.max("point_id").alias("last"))
        e = e.withColumn("k", F.row_number().over(Window.partitionBy("uid").orderBy("a", "b"))).join(last, "uid").select("uid", "a", "b", (F.col("last") + F.col("k")).alias("m"))
        mid = e
        for k in "ab":
            mid = mid.join(points.select("uid", F.col("point_id").alias(k), *[F.col(c).alias(c + k) for c in XYZ]), ["uid", k])
        mid = mid.select("uid", F.col("m").alias("point_id"), *[((F.col(c + "a") + F.col(c + "b")) / 2).alias(c) for c in XYZ])
        t = triangles
        for i, (a, b) in enumerate(("01", "12", "20")):
            t = t.withColumns({"a": F.least("p" + a, "p" + b), "b": F.greatest("p" + a, "p" + b)}).join(e.withColumnRenamed("m", f"m{i}"), ["uid", "a", "b"]).drop("a", "b")
        four = [("p0", "m0", "m2"), ("m0", "p1", "m1"), ("m2", "m1", "p2"), ("m0", "m1", "m2")]
        t = t.select("uid", F.explode(F.array(*[F.struct((F.col("cell_id") * 4 + i).alias("cell_id"), *[F.col(v).alias(f"p{k}") for k, v in enumerate(vs)]) for i, vs in enumerate(four)])).alias("t"))
        points, triangles = points.select("uid", "point_id", *XYZ).unionByName(mid), t.select("uid", "t.*")
    return points, triangles


def smooth(points: DataFrame, triangles: DataFrame, iterations: int = 20, factor: float = 0.1, boundary: bool = False, tolerance: float = 0.0) -> DataFrame:
    """Vertices moved towards the mean of their neighbours; boundary ones only if asked; ends early when nothing moves more than tolerance."""
    e = _edges(triangles).select("uid", "a", "b").distinct()
    e = settle(e.union(e.select("uid", "b", "a")), "neighbours")
    p = points.select("uid", "point_id", *XYZ)
    if boundary:
        p = p.withColumn("fixed", F.lit(False))
    else:
        rim = boundary_edges(triangles).select("uid", F.explode(F.array("a", "b")).alias("point_id")).distinct().withColumn("fixed", F.lit(True))
        p = p.join(rim, ["uid", "point_id"], "left").withColumn("fixed", F.coalesce("fixed", F.lit(False)))
    for k in range(iterations):
        near = e.join(p.select("uid", F.col("point_id").alias("b"), *XYZ), ["uid", "b"]).groupBy("uid", "a").agg(*[F.avg(c).alias("m" + c) for c in XYZ])
        q = p.join(near.withColumnRenamed("a", "point_id"), ["uid", "point_id"], "left")
        moved = {c: F.when(F.col("fixed") | F.col("m" + c).isNull(), F.col(c)).otherwise(F.col(c) + factor * (F.col("m" + c) - F.col(c))) for c in XYZ}
        step = O.norm(tuple(moved[c] - F.col(c) for c in XYZ))
        q = q.select("uid", "point_id", *[v.alias(c) for c, v in moved.items()], "fixed", step.alias("_step"))
        if tolerance > 0 or k % 4 == 3:
            q = settle(q, "smooth")
            if (q.agg(F.max("_step")).first()[0] or 0) <= tolerance:
                return q.drop("fixed", "_step")
        p = q.drop("_step")
    return p.drop("fixed")


def clip_pieces(points: DataFrame, triangles: DataFrame, scalar: str) -> DataFrame:
    """Triangles cut where a vertex attribute is 0: pieces with their side (1 where it is 0 or more) and an array of their three corners.

    A triangle is turned so that its odd vertex comes first; the cut then makes one piece there and two on the other side.
    """
    t = corners(points.withColumn("s", F.col(scalar)), triangles, "s")
    pos = [F.col("s" + k) >= 0 for k in "012"]
    n = sum((p.cast("int") for p in pos), F.lit(0))
    odd = F.when(n == 1, F.when(pos[0], 0).when(pos[1], 1).otherwise(2)).when(n == 2, F.when(~pos[0], 0).when(~pos[1], 1).otherwise(2)).otherwise(0)
    v = F.array(*[F.struct(F.col("s" + k).alias("s"), *[F.col(c + k).alias(c) for c in XYZ]) for k in "012"])
    t = t.withColumns({"_odd": odd, "_n": n, "_v": v})
    for i in range(3):
        t = t.withColumn(f"_c{i}", F.get("_v", F.pmod(F.col("_odd") + i, F.lit(3))))
    cut = lambda a, b: F.struct(F.lit(0.0).alias("s"), *[(F.col(f"{a}.{c}") + F.try_divide(F.col(f"{a}.s"), F.col(f"{a}.s") - F.col(f"{b}.s")) * (F.col(f"{b}.{c}") - F.col(f"{a}.{c}"))).alias(c) for c in XYZ])
    t = t.withColumns({"_m1": cut("_c0", "_c1"), "_m2": cut("_c0", "_c2")})
    side = (F.col("_c0.s") >= 0).cast("int")
    piece = lambda s, *c: F.struct(s.alias("side"), F.array(*map(F.col, c)).alias("corners"))
    straddling = F.array(piece(side, "_c0", "_m1", "_m2"), piece(1 - side, "_m1", "_c1", "_c2"), piece(1 - side, "_m1", "_c2", "_m2"))
    whole = F.array(piece(side, "_c0", "_c1", "_c2"))
    out = t.select("uid", "cell_id", F.posexplode(F.when((F.col("_n") > 0) & (F.col("_n") < 3), straddling).otherwise(whole)).alias("piece", "_p"))
    return out.select("uid", "cell_id", "piece", "_p.side", "_p.corners")


def clip(points: DataFrame, triangles: DataFrame, scalar: str) -> DataFrame:
    """Corners of the pieces of clip_pieces, a row each."""
    c = clip_pieces(points, triangles, scalar).select("uid", "cell_id", "piece", "side", F.posexplode("corners").alias("corner", "_q"))
    return c.select("uid", "cell_id", "piece", "side", "corner", *[F.col(f"_q.{c}") for c in XYZ])


_EDGE_ENDS = ("01", "12", "20")
FACE, EDGES, VERTICES = 0, (1, 2, 3), (4, 5, 6)  # parts of a triangle: its face, edges 01, 12, 20, corners 0, 1, 2


def closest_feature(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance of points to triangles (row by row), and the part of the triangle that is nearest."""
    dots = lambda u, v: (u * v).sum(1)
    best, part = np.full(len(p), np.inf), np.zeros(len(p), np.int64)
    for k, (u, v) in enumerate(((a, b), (b, c), (c, a))):
        d = v - u
        t = dots(p - u, d) / np.maximum(dots(d, d), 1e-300)
        off = np.linalg.norm(p - u - np.clip(t, 0, 1)[:, None] * d, axis=1)
        here = np.where(t <= 0, VERTICES[k], np.where(t >= 1, VERTICES[(k + 1) % 3], EDGES[k]))
        part, best = np.where(off < best, here, part), np.minimum(off, best)
    n = np.cross(b - a, c - a)
    size, q = np.maximum(dots(n, n), 1e-300), p - a
    v, w = dots(np.cross(q, c - a), n) / size, dots(np.cross(b - a, q), n) / size
    inside = (v > 0) & (w > 0) & (v + w < 1) & (dots(n, n) > 0)
    return np.where(inside, np.abs(dots(q, n)) / np.sqrt(size), best), np.where(inside, FACE, part)


def triangle_distance(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distance of points to triangles (row by row), signed by the side of the triangle's own plane."""
    near, _ = closest_feature(p, a, b, c)
    return np.where(((p - a) * np.cross(b - a, c - a)).sum(1) < 0, -near, near)


def pseudo_normals(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """A place on each part of each triangle and the part's normal: uid, cell_id, part, x, y, z, nx, ny, nz.

    An edge has the sum of the unit normals of its triangles, a vertex their sum weighted by the angles there. With these the side
    of a point is that of the normal of its nearest part, whichever triangle of that part is looked at. Triangles without area add nothing.
    """
    n = triangle_normals(points, triangles).select("uid", "cell_id", *[F.coalesce("n" + c, F.lit(0.0)).alias("n" + c) for c in XYZ])
    t = corners(points, triangles).join(n, ["uid", "cell_id"])
    normal = ["n" + c for c in XYZ]
    at = lambda k: [F.col(c + k).alias(c) for c in XYZ]
    face = t.select("uid", "cell_id", F.lit(FACE).alias("part"), *at("0"), *normal)

    ends = [F.struct(F.lit(EDGES[k]).alias("part"), F.least("p" + u, "p" + v).alias("a"), F.greatest("p" + u, "p" + v).alias("b"), *at(u)) for k, (u, v) in enumerate(_EDGE_ENDS)]
    edge = t.select("uid", "cell_id", *normal, F.explode(F.array(*ends)).alias("_e")).select("uid", "cell_id", *normal, "_e.*")
    sums = edge.groupBy("uid", "a", "b").agg(*[F.sum(c).alias(c) for c in normal])
    edge = edge.drop(*normal).join(sums, ["uid", "a", "b"]).select("uid", "cell_id", "part", *XYZ, *normal)

    def angle(k: str, u: str, v: str):
        e, f = (tuple(F.col(c + m) - F.col(c + k) for c in XYZ) for m in (u, v))
        return F.atan2(O.norm(O.cross(e, f)), O.dot(e, f))

    spots = [F.struct(F.lit(VERTICES[k]).alias("part"), F.col(f"p{k}").alias("point_id"), angle(*w).alias("angle"), *at(str(k))) for k, w in enumerate(("012", "120", "201"))]
    spot = t.select("uid", "cell_id", *normal, F.explode(F.array(*spots)).alias("_v")).select("uid", "cell_id", *normal, "_v.*")
    sums = spot.groupBy("uid", "point_id").agg(*[F.sum(F.col(c) * F.col("angle")).alias(c) for c in normal])
    spot = spot.drop(*normal).join(sums, ["uid", "point_id"]).select("uid", "cell_id", "part", *XYZ, *normal)
    return face.union(edge).union(spot)


def _nearest(points: DataFrame, t: DataFrame, cell: float, reach: int) -> DataFrame:
    """Nearest triangle of t and its part for points that have one within reach cells; points of a column ref look at the surface ref only."""
    from .points import _cells

    span = lambda c: F.sequence(F.floor(F.least(*[c + k for k in "012"]) / cell).cast("long") - reach, F.floor(F.greatest(*[c + k for k in "012"]) / cell).cast("long") + reach)
    for c in XYZ:
        t = t.withColumn("_c" + c, F.explode(span(c)))
    # of the cells around its box, a slanting triangle keeps those near its plane: a point is within sqrt(3)/2 of the middle of its cell
    n = _normal()
    off = F.abs(sum(((F.col("_c" + c) + 0.5) * cell - F.col(c + "0")) * v for c, v in zip(XYZ, n)))
    t = t.where(off <= (reach + 0.8661) * cell * O.norm(n) + 1e-9)
    same = ["_cx", "_cy", "_cz", *(["ref"] if "ref" in points.columns else [])]
    near = _cells(points, cell).join(t.withColumnsRenamed({"uid": "ref"}) if "ref" in same else t.drop("uid"), same)

    @F.pandas_udf("d double, part long")
    def measured(*v: pd.Series) -> pd.DataFrame:
        m = np.stack([np.asarray(s, float) for s in v], 1)
        d, part = closest_feature(m[:, :3], m[:, 3:6], m[:, 6:9], m[:, 9:])
        return pd.DataFrame({"d": d, "part": part})

    near = near.withColumn("_m", measured(*map(F.col, XYZ), *[F.col(c + k) for k in "012" for c in XYZ]))
    return near.groupBy("uid", "point_id").agg(F.min(F.struct("_m.d", "_ref", "cell_id", "_m.part")).alias("_b")).select("uid", "point_id", "_b.*")


def nearest_distance(points: DataFrame, ref_points: DataFrame, ref_triangles: DataFrame, cell: float) -> DataFrame:
    """Distance of all points to the nearest triangle, positive on the side to which the surface's normals point; null only for null coordinates or without triangles.

    The side comes from the nearest face, edge or vertex and its pseudo-normal, so it holds at ridges, hollows and saddles as well. Points less than
    1e-9 off are on the surface. Coinciding vertices of a surface are merged first. If points has a column ref, each point is measured to the surface with this uid.
    Each round finds all distances up to the edge of its cells; other points go on to a round with cells twice as large.
    """
    ref_points, ref_triangles = clean_topology(ref_points, ref_triangles)
    t = settle(corners(ref_points, ref_triangles).withColumn("_ref", F.col("uid")), "corners").drop("p0", "p1", "p2")
    box = lambda df, *names: df.agg(*[f(c) for c in names for f in (F.min, F.max)]).first()
    todo = points.where(" and ".join(f"{c} is not null and not isnan({c})" for c in XYZ))
    if "ref" in points.columns:
        todo = todo.join(t.select(F.col("uid").alias("ref")).distinct(), "ref", "left_semi")
    a, b = box(todo, *XYZ), box(t, *[c + k for c in XYZ for k in "012"])
    if a[0] is None or b[0] is None:
        return points.withColumn("distance", F.lit(None).cast("double"))
    extent = max(max(a[i + 1], *b[3 * i : 3 * i + 6]) - min(a[i], *b[3 * i : 3 * i + 6]) for i in (0, 2, 4))
    done, reach = None, 1
    while True:
        last = reach * cell > 2 * extent
        near = settle(_nearest(todo, t, cell, reach), "distance")
        found = near if last else near.where(f"d <= {reach * cell!r}")
        done = found if done is None else done.union(found)
        todo = settle(todo.join(found, ["uid", "point_id"], "left_anti"), "far")
        if last or todo.isEmpty():
            break
        cell *= 2
    part = pseudo_normals(ref_points, ref_triangles)
    part = part.select(F.col("uid").alias("_ref"), "cell_id", "part", *[F.col(c).alias("_o" + c) for c in XYZ], "nx", "ny", "nz")
    p = points.join(done, ["uid", "point_id"], "left").join(part, ["_ref", "cell_id", "part"], "left")
    side = O.dot(tuple(F.col(c) - F.col("_o" + c) for c in XYZ), ("nx", "ny", "nz"))
    signed = F.when(F.col("d") < 1e-9, 0.0).otherwise(F.when(side < 0, -F.col("d")).otherwise(F.col("d")))
    return p.select(*points.columns, signed.alias("distance"))


def split_by_surface(points: DataFrame, triangles: DataFrame, ref_points: DataFrame, ref_triangles: DataFrame, cell: float) -> DataFrame:
    """All triangles of a surface, cut where they cross another, with the side of each piece; none if the other has no triangles."""
    return clip(nearest_distance(points, ref_points, ref_triangles, cell).where("distance is not null"), triangles, "distance")
