"""Polylines: points (uid, seq, x, y, z) in order of seq, and their segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import orientation as O
from .graph import settle, shuffled, small
from .points import _bands

XYZ = ("x", "y", "z")


def _w(*keys: str):
    return Window.partitionBy(*keys).orderBy("seq")


def _last() -> Column:
    return F.max("seq").over(Window.partitionBy("uid"))


def segments(lines: DataFrame) -> DataFrame:
    """Segments between consecutive vertices, numbered from 0, with both ends."""
    w = _w("uid")
    s = lines.withColumns({"seq2": F.lead("seq").over(w), **{c + "2": F.lead(c).over(w) for c in XYZ}}).where("seq2 is not null")
    return s.select("uid", F.col("seq").alias("p0"), F.col("seq2").alias("p1"), *[F.col(c).alias(c + "1") for c in XYZ], *[c + "2" for c in XYZ]).withColumn(
        "cell_id", F.row_number().over(Window.partitionBy("uid").orderBy("p0")) - 1
    )


def _step() -> Column:
    w = _w("uid")
    return F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in XYZ), F.lit(0.0)))


def measured_depth(lines: DataFrame, name: str = "md") -> DataFrame:
    """Length along the line from its first vertex."""
    return lines.withColumn("_d", F.coalesce(_step(), F.lit(0.0))).withColumn(name, F.sum("_d").over(_w("uid").rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def _thinned(batches, eps: float):
    """Vertices farther than eps from the last kept one of their line; rows come line by line in order, and only that vertex is carried on."""
    line = last = None
    for pdf in batches:
        p, uid = pdf[list(XYZ)].to_numpy(float), pdf["uid"].to_numpy()
        keep, i = np.zeros(len(p), bool), 0
        while i < len(p):
            if last is None or uid[i] != line:
                keep[i], line, last = True, uid[i], p[i]
                i += 1
                continue
            step = 64  # the next vertex to keep, or the next line, is looked for in steps that double
            while i < len(p):
                part = slice(i, i + step)
                stop = np.flatnonzero((np.linalg.norm(p[part] - last, axis=1) > eps) | (uid[part] != line))
                if len(stop):
                    i += int(stop[0])
                    if uid[i] == line:
                        keep[i], last = True, p[i]
                        i += 1
                    break
                i, step = min(i + step, len(p)), step * 2
        yield pdf[keep]


def dedupe_consecutive(lines: DataFrame, eps: float = 0.0) -> DataFrame:
    """Lines without vertices that lie within eps of the last kept one."""
    if eps <= 0:
        return lines.withColumn("_d", _step()).where("_d is null or _d > 0").drop("_d")
    return lines.repartition("uid").sortWithinPartitions("uid", "seq").mapInPandas(lambda it: _thinned(it, eps), lines.schema)


def reverse(lines: DataFrame, chosen: Column) -> DataFrame:
    """Lines with the order of vertices turned where chosen (constant in a line) holds."""
    w = Window.partitionBy("uid")
    back = F.row_number().over(w.orderBy(F.desc("seq")))
    fore = F.row_number().over(w.orderBy("seq"))
    return lines.withColumn("seq", F.when(chosen, back).otherwise(fore).cast("long"))


def orient_left_right(lines: DataFrame, u: str = "x", v: str = "y") -> DataFrame:
    """Lines that run from smaller to larger u, by v if both ends have the same u."""
    whole = _w("uid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    u0, u1, v0, v1 = F.first(u).over(whole), F.last(u).over(whole), F.first(v).over(whole), F.last(v).over(whole)
    marked = lines.withColumn("_turn", (u0 > u1) | ((u0 == u1) & (v0 > v1)))
    return reverse(marked, F.col("_turn")).drop("_turn")


def _at(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """Points of lines at lengths (uid, k, at) along them."""
    d = measured_depth(lines)
    w = _w("uid")
    s = d.withColumns({"md2": F.lead("md").over(w), **{c + "2": F.lead(c).over(w) for c in XYZ}})
    # marks and vertices in one order: each mark takes the last vertex at or before it
    v = s.select("uid", F.col("md").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("k"), F.struct("md", "md2", *XYZ, *[c + "2" for c in XYZ]).alias("s")).where("s.md2 > s.md")
    m = marks.select("uid", "at", F.lit(1).alias("kind"), F.col("k").cast("long").alias("k"), F.lit(None).cast(v.schema["s"].dataType).alias("s"))
    last = F.last("s", ignorenulls=True).over(Window.partitionBy("uid").orderBy("at", "kind", "k").rowsBetween(Window.unboundedPreceding, 0))
    p = v.union(m).withColumn("s", last).where("kind = 1 and s is not null")
    t = F.least(F.lit(1.0), (F.col("at") - F.col("s.md")) / (F.col("s.md2") - F.col("s.md")))
    return p.select("uid", F.col("k").alias("seq"), *[(F.col(f"s.{c}") + t * (F.col(f"s.{c}2") - F.col(f"s.{c}"))).alias(c) for c in XYZ])


def line_lengths(lines: DataFrame) -> DataFrame:
    return measured_depth(lines).groupBy("uid").agg(F.max("md").alias("total"), F.count(F.lit(1)).alias("n"))


def resample_distance(lines: DataFrame, d: float) -> DataFrame:
    """Points every d along each line, and its last vertex; d is halved, line by line, until it is shorter than the line."""
    if d <= 0:
        raise ValueError("the distance must be positive")
    n = line_lengths(lines).where("total > 0")
    halvings = F.greatest(F.lit(0.0), F.ceil(F.log2(F.lit(float(d)) / F.col("total"))))
    step = F.lit(float(d)) / F.pow(F.lit(2.0), halvings)
    step = F.when(step < F.col("total"), step).otherwise(step / 2)
    n = n.withColumn("step", step)
    m = n.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("total") / F.col("step") - 1e-9).cast("long")))).withColumn("at", F.col("k") * F.col("step"))
    ends = n.select("uid", (F.floor(F.col("total") / F.col("step") - 1e-9).cast("long") + 1).alias("k"), F.col("total").alias("at"))
    return _at(lines, m.select("uid", "k", "at").union(ends))


def resample_count(lines: DataFrame, n: int) -> DataFrame:
    """Exactly n evenly spaced points on each line, both ends included."""
    if n < 2:
        raise ValueError("a line has two points at least")
    t = line_lengths(lines).where("total > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return _at(lines, t.select("uid", "k", (F.col("total") * F.col("k") / (n - 1)).alias("at")))


def split_at_vertex(lines: DataFrame, points: DataFrame) -> DataFrame:
    """Lines cut in two at the vertex nearest to a point (uid, px, py, pz), unless that is an end; both parts have the vertex."""
    d = sum(((F.col(c) - F.col("p" + c)) ** 2 for c in XYZ), F.lit(0.0))
    cut = lines.join(points, "uid").groupBy("uid").agg(F.min(F.struct(d.alias("d"), "seq"))["seq"].alias("_cut"), F.min("seq").alias("_a"), F.max("seq").alias("_b"))
    cut = cut.withColumn("_cut", F.when((F.col("_cut") > F.col("_a")) & (F.col("_cut") < F.col("_b")), F.col("_cut"))).select("uid", "_cut")
    p = lines.join(cut, "uid", "left")
    part = F.when(F.col("_cut").isNull() | (F.col("seq") < F.col("_cut")), F.array(F.lit(0))).when(F.col("seq") > F.col("_cut"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    return p.withColumn("part", F.explode(part)).drop("_cut")


def line_normals(lines: DataFrame, nx: float, ny: float, nz: float) -> DataFrame:
    """Normal of each vertex within a section of this normal: mean of the unit normals of its segments."""
    s = segments(lines)
    n = O.cross(tuple(F.col(c + "2") - F.col(c + "1") for c in XYZ), (F.lit(nx), F.lit(ny), F.lit(nz)))
    size = O.norm(n)
    s = s.select("uid", F.explode(F.array("p0", "p1")).alias("seq"), *[F.try_divide(v, size).alias("n" + c) for c, v in zip(XYZ, n)])
    return s.groupBy("uid", "seq").agg(*[F.avg("n" + c).alias("n" + c) for c in XYZ])


def sort_line_nodes(cells: DataFrame) -> DataFrame:
    """Vertices of a line from the order of its cells (uid, cell_id, p0, p1): first nodes, then the last node."""
    w = Window.partitionBy("uid").orderBy("cell_id")
    last = F.lead("cell_id").over(w).isNull()
    nodes = cells.withColumn("_n", F.when(last, F.array("p0", "p1")).otherwise(F.array("p0")))
    p = nodes.select("uid", "cell_id", F.posexplode("_n").alias("_k", "point_id"))
    return p.withColumn("seq", F.row_number().over(Window.partitionBy("uid").orderBy("cell_id", "_k"))).select("uid", "seq", "point_id")


def longest_part(parts: DataFrame) -> DataFrame:
    """The longest part (uid, part) of each line."""
    d = parts.withColumnsRenamed({"uid": "_u"}).withColumn("uid", F.concat_ws("|", F.col("_u").cast("string"), F.col("part").cast("string")))
    n = line_lengths(d).join(d.select("uid", "_u", "part").distinct(), "uid")
    return n.groupBy(F.col("_u").alias("uid")).agg(F.max_by("part", F.struct("total", -F.col("part"))).alias("part"), F.max("total").alias("total"))


def translate(points: DataFrame, dx: float, dy: float, dz: float = 0.0) -> DataFrame:
    """All points shifted."""
    return points.withColumns({c: F.col(c) + d for c, d in zip(XYZ, (dx, dy, dz))})


def copy_similar(lines: DataFrame, entities: DataFrame, dx: float, dy: float, dz: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Shifted copies of lines as new entities: uid and name get the length of the shift, the name as `<name>_simi_<length>`; the copies run from left to right."""
    size = round(float(np.sqrt(dx * dx + dy * dy + dz * dz)), 2)
    new = lambda c: F.concat(F.col(c).cast("string"), F.lit(f"_simi_{size}"))
    moved = orient_left_right(translate(lines, dx, dy, dz))
    return moved.withColumn("uid", new("uid")), entities.withColumns({"uid": new("uid"), "name": new("name")})


def rotate_lines(lines: DataFrame, angle: float) -> DataFrame:
    """Lines turned anticlockwise in XY about their length-weighted centroids."""
    s = segments(lines).withColumn("_l", F.sqrt(sum(((F.col(c + "2") - F.col(c + "1")) ** 2 for c in XYZ), F.lit(0.0))))
    c = s.groupBy("uid").agg(*[F.try_divide(F.sum((F.col(k + "1") + F.col(k + "2")) / 2 * F.col("_l")), F.sum("_l")).alias("_c" + k) for k in "xy"])
    t = F.radians(F.lit(float(angle)))
    dx, dy = F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy")
    turned = {"x": F.col("_cx") + dx * F.cos(t) - dy * F.sin(t), "y": F.col("_cy") + dx * F.sin(t) + dy * F.cos(t)}
    return lines.join(c, "uid").withColumns(turned).drop("_cx", "_cy")


def _filed(s: DataFrame, cell: float, eps: float, more: float = 0.0) -> DataFrame:
    """Segments with each cell (cx, cy) of a grid that they pass (or come within more of), column by column; a slanting one has as many as its length needs, not its box."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    pad = 2 * eps * F.sqrt(dx * dx + dy * dy) + 1e-9 * cell + more
    s = s.withColumn("_pad", pad)
    span = lambda a, b: F.sequence(F.floor(a / cell).cast("long"), F.floor(b / cell).cast("long"))
    s = s.withColumn("cx", F.explode(span(F.least("x1", "x2") - F.col("_pad"), F.greatest("x1", "x2") + F.col("_pad"))))
    # where the segment enters and leaves the column
    t = [F.try_divide(F.greatest(F.least(edge, F.greatest("x1", "x2")), F.least("x1", "x2")) - F.col("x1"), dx) for edge in (F.col("cx") * cell - F.col("_pad"), (F.col("cx") + 1) * cell + F.col("_pad"))]
    y = [F.col("y1") + k * dy for k in t]
    upright = F.abs(dx) <= F.col("_pad")
    low, high = (F.when(upright, f("y1", "y2")).otherwise(f(*y)) for f in (F.least, F.greatest))
    return s.withColumn("cy", F.explode(span(low - F.col("_pad"), high + F.col("_pad")))).drop("_pad")


OTHERS, ONCE, OWN = "a_uid <> b_uid", "a_uid < b_uid", "a_uid = b_uid and a_cell_id + 1 < b_cell_id"


def crossings(a: DataFrame, b: DataFrame, cell: float, eps: float = 1e-8, pairs: str = OTHERS) -> DataFrame:
    """Where segments of a and b (uid, cell_id, x1, y1, x2, y2) cross in XY: a, a_cell, t, b, b_cell, u, x, y.

    t and u run from 0 to 1 along the segments, eps beyond. Segments meet in the cells they pass, and the cell that holds the crossing tells it, so
    each pair of segments is told once. Parallel segments have no crossing. pairs: those of different lines (ONCE: a < b), or a line's OWN that aren't neighbours.
    """
    f = [_filed(s.select("uid", "cell_id", "x1", "y1", "x2", "y2"), cell, eps) for s in (a, b)]
    f = [s.select("cx", "cy", *[F.col(c).alias(f"{n}_{c}") for c in ("uid", "cell_id", "x1", "y1", "x2", "y2")]) for n, s in zip("ab", f)]
    p = shuffled(f[0]).join(f[1], ["cx", "cy"]).where(pairs)
    rx, ry = F.col("a_x2") - F.col("a_x1"), F.col("a_y2") - F.col("a_y1")
    qx, qy = F.col("b_x2") - F.col("b_x1"), F.col("b_y2") - F.col("b_y1")
    wx, wy = F.col("b_x1") - F.col("a_x1"), F.col("b_y1") - F.col("a_y1")
    det = rx * qy - ry * qx
    p = p.withColumns({"t": F.try_divide(wx * qy - wy * qx, det), "u": F.try_divide(wx * ry - wy * rx, det), "_det": det})
    p = p.where((F.abs("_det") > 1e-12) & F.col("t").between(-eps, 1 + eps) & F.col("u").between(-eps, 1 + eps))
    p = p.withColumns({"x": F.col("a_x1") + F.col("t") * rx, "y": F.col("a_y1") + F.col("t") * ry})
    p = p.where((F.floor(F.col("x") / cell) == F.col("cx")) & (F.floor(F.col("y") / cell) == F.col("cy")))
    return p.select(F.col("a_uid").alias("a"), F.col("a_cell_id").alias("a_cell"), "t", F.col("b_uid").alias("b"), F.col("b_cell_id").alias("b_cell"), "u", "x", "y")


TILE = 16  # cells of a tile's edge
LEAST, MOST, FAIR = 8192, 200_000, 16  # segments of a part, and parts of a tile that most is not needed for
CHUNK = 4096  # segments of the lines whose crossings are told at a time


def segment_intersections(lines: DataFrame, cell: float, eps: float = 1e-8) -> DataFrame:
    """Points in which two different lines cross in XY, each once: a < b, x, y, rounded to six decimals.

    Segments meet in tiles of TILE cells, and the lines of a full tile in pairs of parts. Two lines meet in one pair of parts, and a point is
    told in the tile that holds it, so points told twice (at a vertex) are found there, without a shuffle.
    """
    tile = TILE * cell
    s = segments(lines).select("uid", *[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]).dropna()
    s = _filed(s.where(" and ".join(f"abs({c}) < double('inf')" for c in ("x1", "y1", "x2", "y2"))), tile, eps, 1e-6)
    at = ["cx", "cy"]
    full = s.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
    full = full.select(*at, F.greatest(F.ceil(F.col("_n") / MOST), F.least(F.lit(FAIR), F.ceil(F.col("_n") / LEAST))).cast("int").alias("_parts"))
    parts = small(settle(full.where("_parts > 1"), "tiles"))
    s = shuffled(s).join(parts, at, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).withColumn("_p", F.pmod(F.xxhash64("uid"), F.col("_parts")).cast("int"))
    own = s.withColumns({"_i": F.col("_p"), "_j": F.explode(F.sequence("_p", F.col("_parts") - 1)), "own": F.lit(True)})
    given = s.withColumns({"_j": F.col("_p"), "_i": F.explode(F.sequence(F.lit(0), F.col("_p"))), "own": F.lit(False)})
    keys = [*at, "_i", "_j"]
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number, as tiles are much work for their size
    both = own.unionByName(given).select(*keys, "uid", "x1", "y1", "x2", "y2", "own").repartition(n, *keys)
    kind = dict(lines.dtypes)["uid"]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        here = [t.column(c)[0].as_py() for c in at]
        names = pc.unique(t.column("uid"))
        names = names.take(pc.sort_indices(names))
        rank = pc.index_in(t.column("uid"), names).to_numpy()
        xy = np.stack([t.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")], 1)
        mine = t.column("own").to_numpy()
        once = t.column("_i")[0].as_py() == t.column("_j")[0].as_py()
        for a, b, x, y in _crossed(rank[mine], xy[mine], rank[~mine], xy[~mine], eps, once):
            inside = (np.floor(x / tile) == here[0]) & (np.floor(y / tile) == here[1])
            yield from pa.table({"a": names.take(pa.array(a[inside])), "b": names.take(pa.array(b[inside])), "x": x[inside], "y": y[inside]}).to_batches()

    return both.groupBy(*keys).applyInArrow(met, f"a {kind}, b {kind}, x double, y double")


def _crossed(own_rank: np.ndarray, own: np.ndarray, rank: np.ndarray, given: np.ndarray, eps: float, once: bool, most: int = 1 << 17):
    """Lesser and greater rank, x and y of the different points in which lines of own and given cross; all points of a line of own come at a time.

    once: own and given are the same lines, and a pair is told by its lesser one.
    given is held in classes of like width, each sorted by x; own looks into the stretches that its segments' boxes reach, so many pairs at a time.
    """
    if not len(own) or not len(given):
        return

    def box(p):
        pad = 2 * eps * np.hypot(p[:, 2] - p[:, 0], p[:, 3] - p[:, 1]) + 1e-9 * (1 + np.abs(p).max(1))
        return np.minimum(p[:, 0], p[:, 2]) - pad, np.maximum(p[:, 0], p[:, 2]) + pad, np.minimum(p[:, 1], p[:, 3]) - pad, np.maximum(p[:, 1], p[:, 3]) + pad

    left, right, low, high = box(given)
    size = np.ceil(np.log2(right - left))
    classes = []
    for c in np.unique(size):
        k = np.flatnonzero(size == c)
        k = k[np.argsort(left[k], kind="stable")]
        way = given[k, 2:] - given[k, :2]
        classes.append((left[k], (right - left)[k].max(), low[k], high[k], right[k], rank[k], *given[k, :2].T.copy(), *way.T.copy()))
    order = np.argsort(own_rank, kind="stable")
    own_rank, own = own_rank[order], own[order]
    starts = np.flatnonzero(np.r_[True, np.diff(own_rank) != 0])
    begin = 0
    while begin < len(own):
        later = starts[starts >= begin + CHUNK]
        end = int(later[0]) if len(later) else len(own)
        r, p = own_rank[begin:end], own[begin:end]
        begin = end
        l, g, d, u = box(p)
        x0, y0, dx, dy = (c.copy() for c in (p[:, 0], p[:, 1], p[:, 2] - p[:, 0], p[:, 3] - p[:, 1]))
        found = []
        for first_x, wide, k_low, k_high, k_right, k_rank, gx, gy, qx, qy in classes:
            for i, j in _bands(np.searchsorted(first_x, l - wide, side="left"), np.searchsorted(first_x, g, side="right"), most):
                some = np.flatnonzero((k_low[j] <= u[i]) & (k_high[j] >= d[i]))
                i, j = i[some], j[some]
                some = np.flatnonzero((k_right[j] >= l[i]) & ((r[i] < k_rank[j]) if once else (r[i] != k_rank[j])))
                i, j = i[some], j[some]
                wx, wy, rx, ry, ex, ey = gx[j] - x0[i], gy[j] - y0[i], dx[i], dy[i], qx[j], qy[j]
                det = rx * ey - ry * ex
                with np.errstate(divide="ignore", invalid="ignore"):
                    t, v = (wx * ey - wy * ex) / det, (wx * ry - wy * rx) / det
                hit = np.flatnonzero((t >= -eps) & (t <= 1 + eps) & (v >= -eps) & (v <= 1 + eps) & (np.abs(det) > 1e-12))
                i, j, t, v = i[hit], j[hit], t[hit], v[hit]
                # the point is told along the lesser line; both parameters are the same from either side
                m, o = r[i], k_rank[j]
                mine = m < o
                x = np.where(mine, x0[i] + t * dx[i], gx[j] + v * qx[j])
                y = np.where(mine, y0[i] + t * dy[i], gy[j] + v * qy[j])
                found.append((np.minimum(m, o), np.maximum(m, o), _six(x), _six(y)))
        if not found:
            continue
        a, b, x, y = (np.concatenate(c) for c in zip(*found))
        by = np.lexsort((y, x, a * (int(b.max(initial=0)) + 1) + b))
        a, b, x, y = a[by], b[by], x[by], y[by]
        new = np.ones(len(a), bool)
        new[1:] = (np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)
        yield a[new], b[new], x[new], y[new]


def _six(v: np.ndarray) -> np.ndarray:
    """v rounded to six decimals, halves away from zero, without negative zero."""
    size = np.abs(v) * 1e6
    n = np.floor(size)
    n += size - n >= 0.5
    return np.where(size < 2.0**52, np.copysign(n, v) / 1e6, v) + 0.0


def _placed(lines: DataFrame) -> DataFrame:
    """Vertices with their place along the line, counted from 0, and the last place."""
    return lines.withColumns({"at": (F.row_number().over(_w("uid")) - 1).cast("double"), "_last": (F.count(F.lit(1)).over(Window.partitionBy("uid")) - 1).cast("double")})


def _place(cell: str, t: str) -> Column:
    """Place of a crossing along its line, to nine decimals."""
    return F.round(F.col(cell) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(t))), 9)


def _on(places: DataFrame, s: DataFrame) -> DataFrame:
    """z of places (uid, _cell, _t) on segments s, between the ends of the segment."""
    z = s.select("uid", F.col("cell_id").alias("_cell"), "z1", "z2")
    return places.join(z, ["uid", "_cell"]).withColumn("z", F.col("z1") + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_t"))) * (F.col("z2") - F.col("z1"))).drop("z1", "z2")


def _end_rays(s: DataFrame, length: Column) -> DataFrame:
    """Rays from both ends of lines, along their end segments: uid, cell_id (0 first end, 1 last end), x1 ... y2; length by _s, that of the segment."""
    end = F.lead("cell_id").over(Window.partitionBy("uid").orderBy("cell_id")).isNull()
    e = s.withColumn("_ends", F.filter(F.array(F.when(F.col("cell_id") == 0, F.lit(0)), F.when(end, F.lit(1))), lambda k: k.isNotNull()))
    e = e.withColumn("_e", F.explode("_ends")).withColumn("_s", F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)).where("_s > 0")
    start = {c: F.when(F.col("_e") == 1, F.col(c + "2")).otherwise(F.col(c + "1")) for c in "xy"}
    way = {c: F.when(F.col("_e") == 1, F.col(c + "2") - F.col(c + "1")).otherwise(F.col(c + "1") - F.col(c + "2")) / F.col("_s") for c in "xy"}
    return e.select("uid", F.col("_e").cast("long").alias("cell_id"), *[v.alias(c + "1") for c, v in start.items()], *[(start[c] + way[c] * length).alias(c + "2") for c in "xy"])


def split_lines(paper: DataFrame, scissors: DataFrame, cell: float, factor: float = 100.0) -> DataFrame:
    """Lines cut where others cross them: vertices and cuts along each by place, with the number of its part.

    Scissors that don't meet a line cut it where their end segments, prolonged to factor times their length, do, so joints that end
    short of a line count. Uids of paper and scissors share one namespace; a line isn't cut by itself. Both parts hold the cut.
    """
    s, by = segments(paper), segments(scissors)
    met = crossings(s, by, cell)
    rays = crossings(s, _end_rays(by, (factor - 1) * F.col("_s")), cell)
    far = rays.join(met.select("a", "b").distinct(), ["a", "b"], "left_anti")
    cuts = met.select("a", "a_cell", "t", "x", "y").union(far.select("a", "a_cell", "t", "x", "y"))
    cuts = cuts.withColumn("at", _place("a_cell", "t")).groupBy(F.col("a").alias("uid"), "at").agg(F.min(F.struct(F.col("a_cell").alias("_cell"), F.col("t").alias("_t"), "x", "y")).alias("_c"))
    cuts = _on(cuts.select("uid", "at", "_c.*"), s)
    v = _placed(paper)
    ends = v.where("at = 0").select("uid", "_last")
    cuts = cuts.join(ends, "uid").where("at > 1e-9 and at < _last - 1e-9").select("uid", "at", *XYZ, F.lit(1).alias("cut"))
    v = v.select("uid", "at", *XYZ, F.lit(0).alias("cut")).join(cuts.select("uid", "at"), ["uid", "at"], "left_anti")
    w = Window.partitionBy("uid").orderBy("at")
    p = v.unionByName(cuts).withColumn("part", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both_parts = F.when(F.col("cut") == 1, F.array(F.col("part") - 1, F.col("part"))).otherwise(F.array("part"))
    return p.withColumn("part", F.explode(both_parts)).select("uid", "part", "at", *XYZ, "cut")


def snap_lines(lines: DataFrame, tol: float, cell: float, eps: float = 1e-8) -> DataFrame:
    """Lines joined where their ends nearly meet: uid, seq, at (order along the line), x, y, z and snapped (vertices that are new or moved).

    Vertices keep their numbers; new nodes have numbers behind the line's last.

    All from the input state, so that no order of lines matters: (1) a line is trimmed at its crossings within tol of an end, up to
    the one farthest along; both lines get a node at each crossing that is within tol of an end of either. (2) An end that no crossing is within
    tol of goes on along its segment to the nearest line within tol, which gets a node there. A line that would be trimmed away stays.
    """
    s = segments(lines)
    v = _placed(lines)
    ends = v.groupBy("uid").agg(*[F.min_by(c, "at").alias(f"_{c}0") for c in "xy"], *[F.max_by(c, "at").alias(f"_{c}1") for c in "xy"])
    hit = crossings(s, s, cell, eps)
    far = lambda k: F.sqrt((F.col("x") - F.col(f"_x{k}")) ** 2 + (F.col("y") - F.col(f"_y{k}")) ** 2)
    hit = hit.withColumnRenamed("a", "uid").join(ends, "uid").withColumns({"_d0": far(0), "_d1": far(1)}).drop("_x0", "_y0", "_x1", "_y1")
    hit = hit.withColumns({"_near": F.least("_d0", "_d1") <= tol + eps, "at": _place("a_cell", "t"), "_b_at": _place("b_cell", "u")})
    low, high = F.col("_near") & (F.col("_d0") <= F.col("_d1")), F.col("_near") & (F.col("_d0") > F.col("_d1"))
    trim = hit.groupBy("uid").agg(F.max(F.when(low, F.col("at"))).alias("_low"), F.min(F.when(high, F.col("at"))).alias("_high"))
    trim = trim.withColumn("_gone", F.coalesce(F.col("_low") >= F.col("_high"), F.lit(False)))
    near = hit.where("_near")
    mine = near.select("uid", "at", F.col("a_cell").alias("_cell"), F.col("t").alias("_t"), "x", "y")
    others = near.select(F.col("b").alias("uid"), F.col("_b_at").alias("at"), F.col("b_cell").alias("_cell"), F.col("u").alias("_t"), "x", "y")

    ray = crossings(_end_rays(s, F.lit(float(tol))), s, cell, eps).withColumnsRenamed({"a": "uid", "a_cell": "_e"})
    joined = trim.select("uid", F.explode(F.array(F.when(F.col("_low").isNotNull(), F.lit(0)), F.when(F.col("_high").isNotNull(), F.lit(1)))).alias("_e")).where("_e is not null")
    ray = ray.where(F.col("t") * tol > eps).join(joined, ["uid", "_e"], "left_anti")
    first = ray.groupBy("uid", "_e").agg(F.min(F.struct(F.round("t", 9).alias("t"), "b", "b_cell", "u", "x", "y")).alias("_m")).select("uid", "_e", "_m.*")
    nodes = mine.union(others).union(first.select(F.col("b").alias("uid"), _place("b_cell", "u"), "b_cell", "u", "x", "y"))
    nodes = _on(nodes.groupBy("uid", "at").agg(F.min(F.struct("_cell", "_t", "x", "y")).alias("_n")).select("uid", "at", "_n.*"), s)

    moved = first.groupBy("uid").agg(*[F.max(F.when(F.col("_e") == k, F.struct("x", "y"))).alias(f"_m{k}") for k in (0, 1)])
    keep = trim.select("uid", *[F.when(~F.col("_gone"), F.col(c)).alias(c) for c in ("_low", "_high")])
    inside = F.col("at").between(F.coalesce("_low", F.col("at")), F.coalesce("_high", F.col("at")))
    v = v.join(keep, "uid", "left").join(moved, "uid", "left")
    to = F.when(F.col("at") == 0, F.col("_m0")).when(F.col("at") == F.col("_last"), F.col("_m1"))
    old = v.where(inside).select("uid", "seq", "at", F.coalesce(to["x"], "x").alias("x"), F.coalesce(to["y"], "y").alias("y"), "z", to.isNotNull().alias("snapped"))
    # a new end takes the number of the vertex next to it that goes
    numbers = v.select("uid", F.col("seq").alias("_seq"), F.col("at").alias("_at"), "_low", "_high")
    nodes = nodes.join(keep, "uid", "left").where(inside).join(v.select("uid", "at"), ["uid", "at"], "left_anti")
    at_end = F.when(F.col("at") == F.col("_low"), F.floor("at")).when(F.col("at") == F.col("_high"), F.ceil("at")).cast("double")
    nodes = nodes.withColumn("_at", at_end).join(numbers.select("uid", "_at", "_seq"), ["uid", "_at"], "left")
    top = lines.groupBy("uid").agg(F.max("seq").alias("_top"))
    nth = F.count(F.when(F.col("_seq").isNull(), 1)).over(Window.partitionBy("uid").orderBy("at"))
    nodes = nodes.join(top, "uid").withColumn("seq", F.coalesce("_seq", F.col("_top") + nth))
    return old.union(nodes.select("uid", "seq", "at", *XYZ, F.lit(True)))


def extrude_lines(lines: DataFrame, trend: float, plunge: float, top: float, bottom: float) -> DataFrame:
    """Segments swept along an axis: two triangles each, with their corners.

    The sweep is top + |bottom| long and starts at bottom.
    """
    axis = O.vector(F.lit(float(plunge)), F.lit(float(trend)))
    total, start = top + abs(bottom), bottom
    s = segments(lines)
    corner = lambda end, k: F.struct(*[(F.col(c + end) + v * (start + k * total)).alias(c) for c, v in zip(XYZ, axis)])
    tri = [F.array(corner("1", 0), corner("2", 0), corner("2", 1)), F.array(corner("1", 0), corner("2", 1), corner("1", 1))]
    return s.select("uid", "cell_id", F.posexplode(F.array(*tri)).alias("half", "_t")).select("uid", "cell_id", "half", F.posexplode("_t").alias("corner", "_p")).select("uid", "cell_id", "half", "corner", "_p.*")


SHORT = 4096  # vertices of a stretch that one task simplifies


def _off_chord() -> Column:
    """Distance in XY of a vertex from the chord between (ax, ay) and (bx, by)."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    qx, qy = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(qx * dx + qy * dy, dx * dx + dy * dy), F.lit(0.0))))
    return F.sqrt((qx - t * dx) ** 2 + (qy - t * dy) ** 2)


def _simplified(pdf: pd.DataFrame, tol: float) -> pd.DataFrame:
    """Vertices of one stretch to keep, by Douglas-Peucker; its ends are columns."""
    pdf = pdf.sort_values("seq")
    ends = pdf[["ax", "ay", "bx", "by"]].iloc[0].to_numpy(float)
    p = np.vstack((ends[:2], pdf[["x", "y"]].to_numpy(float), ends[2:]))
    kept, todo = np.zeros(len(p), bool), [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        q, d = p[a + 1 : b] - p[a], p[b] - p[a]
        t = np.clip(q @ d / max(d @ d, 1e-300), 0, 1)
        off = np.sqrt(((q - t[:, None] * d) ** 2).sum(1))
        k = int(off.argmax())
        if off[k] > tol:
            kept[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return pdf.loc[kept[1:-1], ["uid", "seq"]]


def simplify_lines(lines: DataFrame, tol: float, short: int = SHORT) -> DataFrame:
    """Douglas-Peucker simplification in XY; a tolerance of 0 or less means 0.1.

    Stretches of more than short vertices are halved by rounds over all of them: the vertex farthest from the chord (grouped maxima, which combine
    before the shuffle) stays and parts its stretch, or the stretch is done. Shorter stretches are each finished in one task.
    """
    tol = tol if tol > 0 else 0.1
    xy = lambda n: [F.col(f"{n}.{c}").alias(n + c) for c in "xy"]
    ends = lines.groupBy("uid").agg(F.min(F.struct("seq", "x", "y")).alias("a"), F.max(F.struct("seq", "x", "y")).alias("b"))
    kept = ends.select("uid", F.explode(F.array("a.seq", "b.seq")).alias("seq"))
    spans = ends.select("uid", F.col("a.seq").alias("from"), *xy("a"), *xy("b"))
    limits = ends.select("uid", F.col("a.seq").alias("from"), F.col("b.seq").alias("_to"))
    open_ = lines.select("uid", "seq", "x", "y").join(limits, "uid").where("seq > from and seq < _to").drop("_to")
    while True:
        size = open_.groupBy("uid", "from").agg(F.count(F.lit(1)).alias("_n"))
        big = settle(size.where(F.col("_n") > short).drop("_n"), "big")
        if big.isEmpty():
            break
        wide = open_.join(big, ["uid", "from"]).join(spans, ["uid", "from"]).withColumn("_d", _off_chord())
        far = wide.groupBy("uid", "from").agg(F.max(F.struct("_d", (-F.col("seq")).alias("_k"), "x", "y")).alias("_m"))
        far = settle(far.select("uid", "from", F.when(F.col("_m._d") > tol, -F.col("_m._k")).alias("_at"), F.col("_m.x").alias("_x"), F.col("_m.y").alias("_y")), "far")
        kept = kept.union(far.where("_at is not null").select("uid", "_at"))
        # both halves of a parted stretch; a stretch whose farthest vertex is near enough is done
        parted = spans.join(far.where("_at is not null"), ["uid", "from"])
        halves = parted.select("uid", "from", "ax", "ay", F.col("_x").alias("bx"), F.col("_y").alias("by")).union(parted.select("uid", F.col("_at"), "_x", "_y", "bx", "by"))
        spans = settle(spans.join(far.select("uid", "from"), ["uid", "from"], "left_anti").union(halves), "spans")
        rest = open_.join(far.select("uid", "from", "_at", F.lit(True).alias("_was")), ["uid", "from"], "left").where("_was is null or (_at is not null and seq <> _at)")
        open_ = settle(rest.select("uid", "seq", "x", "y", F.when(F.col("seq") > F.col("_at"), F.col("_at")).otherwise(F.col("from")).alias("from")), "open")
    kinds = dict(lines.dtypes)
    inner = open_.join(spans, ["uid", "from"]).groupBy("uid", "from").applyInPandas(lambda pdf: _simplified(pdf, tol), f"uid {kinds['uid']}, seq {kinds['seq']}")
    return lines.join(kept.union(inner).distinct(), ["uid", "seq"], "left_semi")


def _offset_curve(lines: DataFrame, d: float, join: str, limit: float) -> DataFrame:
    """Each vertex moved by d to the left in XY, with the loops that this makes."""
    if join not in ("mitre", "round"):
        raise ValueError("join must be mitre or round")
    w = _w("uid")
    p = dedupe_consecutive(lines)
    back = {c: F.col(c) - F.lag(c).over(w) for c in "xy"}
    fore = {c: F.lead(c).over(w) - F.col(c) for c in "xy"}
    p = p.withColumns({f"_b{c}": v for c, v in back.items()} | {f"_f{c}": v for c, v in fore.items()})
    unit = lambda a: {c: F.try_divide(F.col(f"_{a}{c}"), F.sqrt(F.col(f"_{a}x") ** 2 + F.col(f"_{a}y") ** 2)) for c in "xy"}
    b, f = unit("b"), unit("f")
    bx, by = F.coalesce(b["x"], f["x"]), F.coalesce(b["y"], f["y"])
    fx, fy = F.coalesce(f["x"], b["x"]), F.coalesce(f["y"], b["y"])
    p = p.withColumns({"_n1x": -by, "_n1y": bx, "_n2x": -fy, "_n2y": fx, "_dot": bx * fx + by * fy, "_turn": bx * fy - by * fx})
    half = F.greatest(1 + F.col("_dot"), F.lit(2.0 / limit**2))
    mitre = F.struct(*[((F.col(f"_n1{c}") + F.col(f"_n2{c}")) / half).alias(c) for c in "xy"])
    if join == "mitre":
        steps = F.array(mitre)
    else:
        angle = F.atan2(F.col("_turn"), F.col("_dot"))
        n = F.greatest(F.lit(1), F.ceil(F.abs(angle) / (np.pi / 32)).cast("int"))
        arc = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(*[v.alias(c) for c, v in zip("xy", _turned(F.col("_n1x"), F.col("_n1y"), angle * k / n))]))
        outer = (F.col("_turn") * d < 0) & (F.abs("_turn") > 1e-12)
        steps = F.when(outer, arc).otherwise(F.array(mitre))
    out = p.select("uid", "seq", "x", "y", "z", F.posexplode(steps).alias("_k", "_o"))
    out = out.withColumns({"x": F.col("x") + d * F.col("_o.x"), "y": F.col("y") + d * F.col("_o.y")})
    return out.withColumn("seq", F.row_number().over(Window.partitionBy("uid").orderBy("seq", "_k")).cast("long")).select("uid", "seq", *XYZ)


def self_crossing(lines: DataFrame, cell: float) -> DataFrame:
    """uid of lines that cross or touch themselves, other than where a closed one ends."""
    s = segments(dedupe_consecutive(lines))
    x = crossings(s, s, cell, 1e-9, OWN)
    last = s.groupBy("uid").agg(F.max("cell_id").alias("_last"))
    x = x.join(last.withColumnRenamed("uid", "a"), "a")
    closing = (F.col("a_cell") == 0) & (F.col("t") < 1e-6) & (F.col("b_cell") == F.col("_last")) & (F.col("u") > 1 - 1e-6)
    return x.where(~closing).select(F.col("a").alias("uid")).distinct()


def _touching(points: DataFrame, s: DataFrame, reach: float) -> DataFrame:
    """Points (uid, k, x, y) nearer than reach to a segment of their own line: uid, k."""
    cell = 2 * reach
    low = lambda a, b: F.floor((F.least(a, b) - reach) / cell).cast("long")
    high = lambda a, b: F.floor((F.greatest(a, b) + reach) / cell).cast("long")
    f = s.select("uid", *[F.col(c + e).alias(n + c) for n, e in (("a", "1"), ("b", "2")) for c in "xy"])
    f = f.withColumn("cx", F.explode(F.sequence(low("ax", "bx"), high("ax", "bx")))).withColumn("cy", F.explode(F.sequence(low("ay", "by"), high("ay", "by"))))
    # of the cells around its box, a slanting segment keeps those near it
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    off = F.abs(((F.col("cx") + 0.5) * cell - F.col("ax")) * dy - ((F.col("cy") + 0.5) * cell - F.col("ay")) * dx)
    f = f.where(off <= (reach + 0.7072 * cell) * F.sqrt(dx * dx + dy * dy) + 1e-9)
    p = points.withColumns({"c" + c: F.floor(F.col(c) / cell).cast("long") for c in "xy"})
    return p.join(shuffled(f), ["uid", "cx", "cy"]).where(_off_chord() < reach).select("uid", "k").distinct()


def offset_lines(lines: DataFrame, d: float, join: str = "mitre", limit: float = 10.0, cell: float | None = None) -> DataFrame:
    """Lines moved by d to the left in XY; joins are mitred up to limit times d, or round (16 steps a quarter).

    Lines that cross themselves are refused: they aren't in the result. The moved curve is cut where it crosses itself; pieces nearer than |d| to the line
    go, neighbouring pieces that are left are joined, and of several parts the longest stays (ties: the first). cell: edge of the cells in
    which segments meet, 4 |d| by default.
    """
    cell = cell or max(4 * abs(d), 1e-6)
    lines = lines.join(self_crossing(lines, cell), "uid", "left_anti")
    if d == 0:
        return lines.select("uid", "seq", *XYZ)
    curve = settle(dedupe_consecutive(_offset_curve(lines, d, join, limit)), "curve")
    s = segments(curve)
    x = crossings(s, s, cell, 0.0, OWN)
    cuts = x.select(F.col("a").alias("uid"), F.col("a_cell").alias("_cell"), F.col("t").alias("_t"), "x", "y").union(x.select("b", "b_cell", "u", "x", "y"))
    cuts = cuts.withColumn("at", _place("_cell", "_t")).groupBy("uid", "at").agg(F.min(F.struct("_cell", "_t", "x", "y")).alias("_c"))
    cuts = _on(cuts.select("uid", "at", "_c.*"), s).select("uid", "at", *XYZ, F.lit(1).alias("cut"))
    v = _placed(curve).select("uid", "at", *XYZ, F.lit(0).alias("cut"))
    v = v.join(cuts.select("uid", "at"), ["uid", "at"], "left_anti").unionByName(cuts)
    w = Window.partitionBy("uid").orderBy("at")
    v = settle(v.withColumn("k", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0))), "cuts")
    # each piece is judged by the middle of its longest segment
    e = v.withColumns({"_x2": F.lead("x").over(w), "_y2": F.lead("y").over(w)}).where("_x2 is not null")
    e = e.withColumn("_s", F.sqrt((F.col("_x2") - F.col("x")) ** 2 + (F.col("_y2") - F.col("y")) ** 2))
    size = e.groupBy("uid", "k").agg(F.sum("_s").alias("_s"), F.max(F.struct("_s", ((F.col("x") + F.col("_x2")) / 2).alias("x"), ((F.col("y") + F.col("_y2")) / 2).alias("y"))).alias("_m"))
    bad = _touching(size.select("uid", "k", "_m.x", "_m.y"), segments(lines), abs(d) * (1 - 1e-6))
    good = size.select("uid", "k", "_s").join(bad, ["uid", "k"], "left_anti")
    begin = v.where("cut = 1").select("uid", "k", F.col("x").alias("_bx"), F.col("y").alias("_by"))
    end = v.where("cut = 1").select("uid", (F.col("k") - 1).alias("k"), F.col("x").alias("_ex"), F.col("y").alias("_ey"))
    good = good.join(begin, ["uid", "k"], "left").join(end, ["uid", "k"], "left")
    # a piece goes on with the one before if it begins where that ends
    o = Window.partitionBy("uid").orderBy("k")
    apart = F.greatest(F.abs(F.col("_bx") - F.lag("_ex").over(o)), F.abs(F.col("_by") - F.lag("_ey").over(o)))
    good = good.withColumn("_new", F.coalesce(apart > 1e-6 * cell, F.lit(True)).cast("int")).withColumn("_part", F.sum("_new").over(o))
    total = good.groupBy("uid", "_part").agg(F.round(F.sum("_s"), 6).alias("_s")).groupBy("uid").agg(F.max(F.struct("_s", (-F.col("_part")).alias("_p"))).alias("_b"))
    total = total.where("_b._s > 0")
    kept = good.join(total.select("uid", (-F.col("_b._p")).alias("_part")), ["uid", "_part"]).select("uid", "k", "_part")
    # a cut begins its own piece and ends the one before
    both = v.withColumn("k", F.explode(F.when(F.col("cut") == 1, F.array(F.col("k") - 1, F.col("k"))).otherwise(F.array("k"))))
    out = both.join(kept, ["uid", "k"]).select("uid", "at", "k", *XYZ)
    # the first row of a piece that goes on is the last one of the piece before
    row = Window.partitionBy("uid").orderBy("k", "at")
    out = out.withColumn("_twice", F.coalesce(F.col("k") > F.lag("k").over(row), F.lit(False))).where("not _twice")
    return out.select("uid", F.row_number().over(Window.partitionBy("uid").orderBy("k", "at")).cast("long").alias("seq"), *XYZ)


def _turned(x: Column, y: Column, a: Column):
    return x * F.cos(a) - y * F.sin(a), x * F.sin(a) + y * F.cos(a)


def merge_lines(lines: DataFrame, uids: list, new_uid: str) -> DataFrame:
    """Lines of these uids joined end to end in this order; each is turned to the end that is nearer.

    The ends of the few lines are compared on the driver, the turns are a join.
    """
    whole = lines.where(F.col("uid").isin(*uids)).groupBy("uid").agg(
        *[f(F.struct("seq", *XYZ)).alias(n) for n, f in (("a", F.min), ("b", F.max))], F.count(F.lit(1)).alias("n")
    )
    ends = {r["uid"]: (np.array(r["a"][1:], float), np.array(r["b"][1:], float), r["n"]) for r in whole.collect()}
    order = [u for u in uids if u in ends]
    rows, start, tail = [], 0, None
    for k, u in enumerate(order):
        a, b, n = ends[u]
        turn = False
        if tail is None:
            if len(order) > 1:
                c, e, _ = ends[order[1]]
                turn = min(np.linalg.norm(a - c), np.linalg.norm(a - e)) < min(np.linalg.norm(b - c), np.linalg.norm(b - e))
        else:
            turn = np.linalg.norm(b - tail) < np.linalg.norm(a - tail)
        tail = a if turn else b
        rows.append((u, bool(turn), start))
        start += n
    if not rows:
        return lines.where(F.lit(False))
    kind = dict(lines.dtypes)["uid"]
    plan = lines.sparkSession.createDataFrame(rows, f"uid {kind}, _turn boolean, _start long")
    p = lines.join(F.broadcast(plan), "uid")
    p = reverse(p, F.col("_turn")).withColumn("seq", F.col("seq") + F.col("_start"))
    return p.select(F.lit(new_uid).alias("uid"), "seq", *XYZ)
