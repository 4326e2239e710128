"""Directional statistics and clustering of unit vectors (x, y, z)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import orientation as O
from . import cells
from .graph import settle, small


def flip_down(vectors: DataFrame) -> DataFrame:
    """Vectors turned so that z is not positive; nulls stay."""
    x, y, z = O.down("x", "y", "z")
    return vectors.withColumns({"x": x, "y": y, "z": z})


def double_axial(vectors: DataFrame) -> DataFrame:
    """Each vector and its opposite, marked by original."""
    return vectors.withColumn("original", F.lit(True)).unionByName(
        vectors.withColumns({c: -F.col(c) for c in ("x", "y", "z")}).withColumn("original", F.lit(False))
    )


def _sums() -> list[Column]:
    return [F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum("z").alias("sz"), F.count("x").alias("n")]


def srf(vectors: DataFrame, *keys: str) -> DataFrame:
    """Length of the mean vector by group: the spherical regularity of directions."""
    s = vectors.groupBy(*keys).agg(*_sums())
    return s.select(*keys, "n", F.try_divide(F.sqrt(F.col("sx") ** 2 + F.col("sy") ** 2 + F.col("sz") ** 2), F.col("n")).alias("srf"))


def fisher(vectors: DataFrame, *keys: str, axial: bool = False) -> DataFrame:
    """Mean direction, mean resultant length and kappa by group; a zero resultant gives nulls."""
    s = (flip_down(vectors) if axial else vectors).groupBy(*keys).agg(*_sums())
    s = s.withColumn("r", F.sqrt(F.col("sx") ** 2 + F.col("sy") ** 2 + F.col("sz") ** 2))
    m = O.down(*[F.try_divide(F.col(c), F.col("r")) for c in ("sx", "sy", "sz")])
    s = s.withColumn("rbar", F.col("r") / F.col("n"))
    b = F.col("rbar")
    kappa = F.when(b < 0.9, F.try_divide(3 * b - b**3, 1 - b**2)).otherwise(F.try_divide(F.lit(1.0), b**3 - 4 * b**2 + 3 * b))
    out = s.withColumns({"mx": m[0], "my": m[1], "mz": m[2]})
    out = out.withColumn("trend", O.wrap360(O.trend("mx", "my"))).withColumn("plunge", O.plunge("mz"))
    return out.withColumn("kappa", F.when(F.col("r") > 0, kappa)).select(*keys, "n", "mx", "my", "mz", "trend", "plunge", "rbar", "kappa")


def orientation_tensor(vectors: DataFrame, *keys: str) -> DataFrame:
    """The six distinct cells of the mean of v v' by group."""
    cells = {a + b: F.avg(F.col(a) * F.col(b)) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}
    return vectors.groupBy(*keys).agg(F.count("x").alias("n"), *[c.alias(f"t{k}") for k, c in cells.items()])


_EIGEN = "struct<e:array<double>,v:array<double>>"


def eigen3(xx, xy, xz, yy, yz, zz) -> Column:
    """Eigenvalues, descending, and eigenvectors (v1 v2 v3 in a row) of symmetric 3x3 matrices; one batch at a time."""

    def solve(*c: pd.Series) -> pd.DataFrame:
        m = np.stack([np.asarray(s, float) for s in c], 1)
        ok = np.isfinite(m).all(1)
        full = np.zeros((len(m), 3, 3))
        for k, (i, j) in enumerate([(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]):
            full[:, i, j] = full[:, j, i] = np.where(ok, m[:, k], 0)
        value, vector = np.linalg.eigh(full)
        value, vector = value[:, ::-1], vector[:, :, ::-1]
        return pd.DataFrame({"e": [v.tolist() if k else None for v, k in zip(value, ok)], "v": [v.T.ravel().tolist() if k else None for v, k in zip(vector, ok)]})

    udf = F.pandas_udf(solve, _EIGEN)
    return udf(*[F.col(c) if isinstance(c, str) else c for c in (xx, xy, xz, yy, yz, zz)])


def bingham(vectors: DataFrame, *keys: str) -> DataFrame:
    """Eigenvalues e1 >= e2 >= e3 and axes of the orientation tensor by group; axes point down."""
    t = orientation_tensor(vectors, *keys).withColumn("_e", eigen3("txx", "txy", "txz", "tyy", "tyz", "tzz"))
    out = t.select(*keys, "n", *[F.get("_e.e", F.lit(i)).alias(f"e{i + 1}") for i in range(3)], "_e.v")
    for i in range(3):
        axis = O.down(*[F.get("v", F.lit(3 * i + j)) for j in range(3)])
        out = out.withColumn(f"trend{i + 1}", O.wrap360(O.trend(axis[0], axis[1]))).withColumn(f"plunge{i + 1}", O.plunge(axis[2]))
    return out.drop("v")


def fabric(values: DataFrame, reference_labels: bool = False) -> DataFrame:
    """Fabric of eigenvalues (e1, e2, e3): cluster if e1 stands out, girdle if e3 does.

    reference_labels swaps both names, as an older convention has them.
    """
    r13, r23 = F.try_divide("e1", "e3"), F.try_divide("e2", "e3")
    high, low = F.col("e1") - F.col("e2"), F.col("e2") - F.col("e3")
    big, small = ("girdle", "cluster") if reference_labels else ("cluster", "girdle")
    kind = F.when((r13 > 5) & (high > low), big).when((r13 > 5) & (high < low), small).otherwise("intermediate")
    return values.withColumn("ratio13", r13).withColumn("ratio23", r23).withColumn("fabric", kind)


def orientation_summary(vectors: DataFrame, *keys: str) -> DataFrame:
    """Fisher and Bingham statistics with the fabric, by kind and group: normals are axial, lineations polar.

    Vectors with a column cluster also give clusters, the vectors of each cluster as `0:12,1:30`; those without a cluster aren't among them.
    """
    keys = ("kind", *keys)
    parts = [fisher(vectors.where(F.col("kind") == k), *keys, axial=k == "normals") for k in ("normals", "lineations")]
    out = parts[0].unionByName(parts[1]).join(fabric(bingham(vectors, *keys)).drop("n"), list(keys))
    if "cluster" not in vectors.columns:
        return out
    size = vectors.where("cluster is not null").groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("n"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "n"))), lambda s: F.concat_ws(":", s["cluster"].cast("string"), s["n"].cast("string"))), ",")
    return out.join(size.groupBy(*keys).agg(told.alias("clusters")), list(keys), "left")


def hemisphere_grid(spark, n: int = 11) -> DataFrame:
    """Directions of the lower hemisphere on an n x n grid of the equal-area disc."""
    steps = spark.range(n * n).select((F.pmod("id", F.lit(n)) * 2.0 / (n - 1) - 1).alias("gx"), (F.floor(F.col("id") / n) * 2.0 / (n - 1) - 1).alias("gy"), F.col("id").alias("node"))
    r2 = F.col("gx") ** 2 + F.col("gy") ** 2
    steps = steps.where(r2 <= 1)
    k = F.sqrt(2 - r2)
    return steps.select("node", "gx", "gy", (F.col("gx") * k).alias("x"), (F.col("gy") * k).alias("y"), (r2 - 1).alias("z"))


def pole_density(vectors: DataFrame, grid: DataFrame, kappa: float) -> DataFrame:
    """Exponentially smoothed count of poles at each grid direction; the grid is small and broadcast."""
    g = small(grid.select("node", F.col("x").alias("hx"), F.col("y").alias("hy"), F.col("z").alias("hz")))
    c = F.abs(F.col("x") * F.col("hx") + F.col("y") * F.col("hy") + F.col("z") * F.col("hz"))
    return vectors.crossJoin(g).groupBy("node").agg(F.sum(F.exp(kappa * (c - 1))).alias("density"))


def nearest_pick(vectors: DataFrame, seeds: DataFrame) -> DataFrame:
    """The actual vector nearest to each seed (seed, x, y, z); few seeds are broadcast."""
    s = small(seeds.select("seed", *[F.col(c).alias("s" + c) for c in "xyz"]))
    d = sum(((F.col(c) - F.col("s" + c)) ** 2 for c in "xyz"), F.lit(0.0))
    best = F.min(F.struct(d.alias("d"), "point_id", "x", "y", "z")).alias("b")
    return vectors.crossJoin(s).groupBy("seed").agg(best).select("seed", "b.point_id", "b.x", "b.y", "b.z")


def assign(vectors: DataFrame, centers: list[tuple]) -> DataFrame:
    """cluster: number of the nearest center (Euclidean); ties go to the smaller number."""
    d = [F.struct((sum(((F.col(c) - float(v)) ** 2 for c, v in zip("xyz", m)), F.lit(0.0))).alias("d"), F.lit(i).alias("i")) for i, m in enumerate(centers)]
    return vectors.withColumn("cluster", F.array_min(F.array(*d))["i"])


def _cost_to(p: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) to centers (columns)."""
    return ((p[:, None] - centers[None]) ** 2).sum(2)


def kmeans_start(data: DataFrame, k: int, rounds: int = 5) -> list[tuple]:
    """k starting centers for data (x, y, z), spread out: k-means|| with sampling by hashed keys, so that reruns agree.

    A round draws 2 k positions at once, each with a chance in proportion to its squared distance from the candidates so far (the smallest
    -ln(hash) / weight). The candidates, weighted by the vectors nearest to them, are reduced to k on the driver: each time the one is
    taken that lowers their cost most. 10 k + 1 candidates at most.
    """
    at = settle(data.groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("n")), "positions")
    found: list[tuple] = []
    for step in range(rounds + 1):
        u = (F.pmod(F.xxhash64("x", "y", "z", F.lit(step)), F.lit(1 << 52)) + 0.5) / (1 << 52)
        far = F.lit(1.0)
        if found:
            far = F.array_min(F.array(*[sum(((F.col(c) - v) ** 2 for c, v in zip("xyz", m)), F.lit(0.0)) for m in found]))
        drawn = at.withColumn("_w", F.col("n") * far).where("_w > 0").withColumn("_key", -F.log(u) / F.col("_w"))
        got = drawn.orderBy("_key", "x", "y", "z").limit(2 * k if found else 1).select("x", "y", "z").collect()
        if not got:
            break
        found += [tuple(r) for r in got]
    if len(found) < k:
        raise ValueError(f"{k} clusters need {k} different vectors at least; there are {len(found)}")
    weight = {r["cluster"]: r["n"] for r in assign(at, found).groupBy("cluster").agg(F.sum("n").alias("n")).collect()}
    p, w = np.array(found, float), np.array([weight.get(i, 0) for i in range(len(found))], float)
    apart = _cost_to(p, p)
    near, chosen = np.full(len(p), np.inf), []
    for _ in range(k):
        best = int((np.minimum(near[:, None], apart) * w[:, None]).sum(0).argmin())
        chosen.append(best)
        near = np.minimum(near, apart[best])
    return [found[i] for i in chosen]


def kmeans(vectors: DataFrame, seeds: list[tuple] | None = None, axial: bool = False, rounds: int = 100, tolerance: float = 1e-9, k: int | None = None) -> DataFrame:
    """Lloyd's clusters from given seeds, or k clusters from kmeans_start; each round is one grouped average, the centers go to the tasks as literals."""
    data = settle((double_axial(vectors) if axial else vectors).select(*[F.col(c).cast("double").alias(c) for c in "xyz"]), "vectors")
    if seeds is None:
        if not k or k < 1:
            raise ValueError("k must be at least 1")
        seeds = kmeans_start(data.dropna(), k)
    centers = [tuple(map(float, s)) for s in seeds]
    for _ in range(rounds):
        got = {r["cluster"]: (r["x"], r["y"], r["z"]) for r in assign(data, centers).groupBy("cluster").agg(*[F.avg(c).alias(c) for c in "xyz"]).collect()}
        new = [got.get(i, c) for i, c in enumerate(centers)]
        moved = max(abs(a - b) for p, q in zip(new, centers) for a, b in zip(p, q))
        centers = new
        if moved <= tolerance:
            break
    return assign(vectors, centers)


def _nearest_bound(batches, state: dict, limit: int):
    """Of the positions whose total distance may be the least of their cluster, those with the smallest bounds.

    state: by cluster its cells (members, mean), planes below the total distance, the least total so far, positions done.
    """
    held: dict[int, pd.DataFrame] = {}
    for batch in batches:
        for cluster, part in batch.groupby("cluster"):
            near, planes, best, done = state[cluster]
            at = part[["x", "y", "z"]].to_numpy()
            bound = np.concatenate([np.sqrt(((at[low : low + 1024, None] - near[None, :, 1:]) ** 2).sum(2)) @ near[:, 0] for low in range(0, len(at), 1024)])
            if len(planes):
                bound = np.maximum(bound, (at @ planes[:, :3].T + planes[:, 3]).max(1))
            part = part.assign(bound=bound)[bound <= best + 2e-9 + 1e-12 * abs(best)]
            part = part[np.array([p not in done for p in zip(part["x"], part["y"], part["z"])], bool)]
            held[cluster] = pd.concat([held[cluster], part] if cluster in held else [part]).nsmallest(limit, ["bound", "point_id"])
    for part in held.values():
        yield part[["cluster", "x", "y", "z", "bound", "point_id", "original"]]


def _totals(batches, candidates: dict):
    """Total distance of the batches' positions to each candidate of their cluster, and its slope there."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for cluster, part in batch.groupby("cluster"):
            if cluster not in candidates:
                continue
            at, n, c = part[["x", "y", "z"]].to_numpy(), part["n"].to_numpy(float), candidates[cluster]
            out = sums.setdefault(cluster, np.zeros((len(c), 4)))
            size = max(64, (1 << 18) // len(c))
            for low in range(0, len(at), size):
                step = c[:, None, :] - at[None, low : low + size]
                d = np.sqrt((step * step).sum(2))
                w = n[low : low + size]
                out[:, 0] += d @ w
                out[:, 1:] += (step * (w / np.where(d > 0, d, 1))[:, :, None]).sum(1)
    for cluster, out in sums.items():
        yield pd.DataFrame({"cluster": cluster, "k": np.arange(len(out)), "cost": out[:, 0], "gx": out[:, 1], "gy": out[:, 2], "gz": out[:, 3]})


CELLS = 1024  # cells whose means bound the total distances


def _in_cells(data: DataFrame) -> DataFrame:
    """data with the leaf of its k-d cells, about CELLS in all."""
    p = data.withColumn("uid", F.lit(0))
    splits = cells.splits_of(p.select("uid", "point_id", *"xyz"), max(1, -(-data.count() // CELLS)))
    return settle(p.withColumn("leaf", cells.leaf_of(p, splits)).drop("uid"), "positions")


def _medoids(a: DataFrame, block: int) -> dict[int, tuple]:
    """By cluster of a (cluster, leaf, x, y, z, n, point_id, original) the position with the least total distance to all members; ties go to the smaller id.

    Blocks of candidates are costed, smallest bound first, while a bound is not above the least total. Bounds are the sum of n |mean - c| over
    the members' cells and, as the total is a convex function of the position, its tangent planes at the positions costed so far.
    """
    from pyspark.sql import Window

    weigh = [F.sum("n").alias("n"), *[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in "xyz"]]
    a = a if "leaf" in a.columns else a.withColumn("leaf", F.lit(0))
    means = a.groupBy("cluster", "leaf").agg(*weigh).toPandas()
    state = {c: (g[["n", "x", "y", "z"]].to_numpy(float), np.zeros((0, 4)), np.inf, set()) for c, g in means.groupby("cluster")}
    found: dict[int, tuple] = {}
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("bound", "point_id", "original"))
    while state:
        near = a.where(F.col("cluster").isin(list(state))).mapInPandas(lambda it, s=state: _nearest_bound(it, s, block), "cluster int, x double, y double, z double, bound double, point_id long, original boolean")
        got = near.withColumn("k", rank).where(F.col("k") <= block).toPandas()
        state = {c: v for c, v in state.items() if c in set(got["cluster"])}
        if not state:
            break
        rows = {c: part.reset_index(drop=True) for c, part in got.groupby("cluster")}
        at = {c: part[["x", "y", "z"]].to_numpy() for c, part in rows.items()}
        totals = a.where(F.col("cluster").isin(list(state))).mapInPandas(lambda it, at=at: _totals(it, at), "cluster int, k long, cost double, gx double, gy double, gz double")
        totals = totals.groupBy("cluster", "k").agg(*[F.sum(c).alias(c) for c in ("cost", "gx", "gy", "gz")]).toPandas()
        for c, part in totals.groupby("cluster"):
            part, (near, planes, best, done) = part.sort_values("k"), state[c]
            cost, slope = part["cost"].to_numpy(), part[["gx", "gy", "gz"]].to_numpy()
            new = np.column_stack((slope, cost - (slope * at[c]).sum(1)))
            state[c] = (near, np.vstack((planes, new)), min(best, cost.min()), done | set(map(tuple, at[c].tolist())))
            ids = zip(cost.round(9).tolist(), rows[c]["point_id"].tolist(), rows[c]["original"].tolist(), map(tuple, at[c].tolist()))
            found[c] = min([*ids, *([found[c]] if c in found else [])])
        block = min(4 * block, 1024)
    return {c: v[3] for c, v in found.items()}


def kmedoids(vectors: DataFrame, seeds: list[tuple], axial: bool = False, rounds: int = 300, candidates: int = 64) -> DataFrame:
    """Clusters around actual vectors.

    A round assigns all vectors to the nearest medoid; then each cluster's next medoid is the member with the least
    total distance to all members. `candidates` members are costed at first, then four times as many up to 1024, until no other can be better.
    Medoids that come back in an earlier state go round for ever, so the state after the last round is told from the cycle.
    """
    data = (double_axial(vectors) if axial else vectors.withColumn("original", F.lit(True))).select("point_id", "original", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    data = data.where(" and ".join(f"{c} is not null and not isnan({c})" for c in "xyz"))
    least = F.min(F.struct(F.col("point_id").cast("long").alias("point_id"), "original")).alias("b")
    data = settle(data.groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("n"), least).select("x", "y", "z", "n", "b.point_id", "b.original"), "positions")
    data = _in_cells(data)
    medoids = [tuple(map(float, s)) for s in seeds]
    states: list[list[tuple]] = []
    for _ in range(rounds):
        if medoids in states:  # rounds repeat from here on: the last one's state is known
            first = states.index(medoids)
            medoids = states[first + (rounds - first) % (len(states) - first)]
            break
        states.append(medoids)
        got = _medoids(assign(data, medoids), candidates)
        new = [got.get(i, m) for i, m in enumerate(medoids)]
        if axial:  # a medoid and its opposite are one axis
            new = [tuple(-v for v in m) if m[2] > 0 else m for m in new]
            for i, m in enumerate(new):
                if any(np.allclose(m, o, atol=1e-9) for o in new[:i]):
                    new[i] = medoids[i]
        if all(np.allclose(p, q, atol=1e-12) for p, q in zip(new, medoids)):
            break
        medoids = new
    return assign(vectors, medoids)


def save_clusters(points: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """points with labels (uid, point_id, cluster) as attribute name; points without a label have null."""
    return points.join(labels.select("uid", "point_id", F.col("cluster").alias(name)), ["uid", "point_id"], "left")
