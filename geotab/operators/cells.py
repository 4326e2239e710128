"""Equi-depth cells for clouds of any density: k-d splits at the quantiles of a bounded sample."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")
SAMPLE = 200_000  # rows that come to the driver
PER_LEAF = 8  # sampled rows of a leaf at least


class Splits:
    """Split planes of one group's cells: node i halves along axis[i] at value[i]; children are nodes, or leaves as ~leaf."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.axis, self.value, self.child = [], [], []
        self.leaves = 0
        self.root = self._halve(sample, max(1, min(leaves, len(sample) // PER_LEAF)))
        self.child = np.array(self.child, np.int64).reshape(-1, 2)

    def _halve(self, p: np.ndarray, leaves: int) -> int:
        extent = np.ptp(p, axis=0) if len(p) else np.zeros(3)
        k = int(extent.argmax())
        if leaves < 2 or not extent[k] > 0:
            self.leaves += 1
            return ~(self.leaves - 1)
        v = float(np.quantile(p[:, k], (leaves // 2) / leaves, method="higher"))
        low = p[:, k] < v
        if not low.any():  # the lower part is one value
            v = float(np.nextafter(v, np.inf))
            low = p[:, k] < v
        node = len(self.axis)
        self.axis.append(k)
        self.value.append(v)
        self.child.append((0, 0))
        self.child[node] = (self._halve(p[low], leaves // 2), self._halve(p[~low], leaves - leaves // 2))
        return node

    def leaf(self, p: np.ndarray) -> np.ndarray:
        """Leaf of each point."""
        axis, value = np.array(self.axis, np.int64), np.array(self.value, float)
        at = np.full(len(p), self.root)
        some = np.flatnonzero(at >= 0)
        while len(some):
            node = at[some]
            at[some] = self.child[node, (p[some, axis[node]] >= value[node]).astype(int)]
            some = some[at[some] >= 0]
        return ~at

    def near(self, p: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
        """Leaves that the ball of each point may meet."""
        rows, leaves = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        todo = [(self.root, np.arange(len(p)))]
        while todo:
            node, some = todo.pop()
            if not len(some):
                continue
            if node < 0:
                rows.append(some)
                leaves.append(np.full(len(some), ~node))
                continue
            x, v = p[some, self.axis[node]], self.value[node]
            low, high = self.child[node]
            todo += [(low, some[x - r[some] < v]), (high, some[x + r[some] >= v])]
        row = np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        return np.split(np.concatenate(leaves)[order], np.searchsorted(row[order], np.arange(1, len(p)))) if len(p) else []


def splits_of(points: DataFrame, leaf_rows: int) -> dict:
    """Splits of the groups (uid) that have more than leaf_rows rows, by the text of their uid, from at most about SAMPLE sampled rows."""
    size = points.groupBy(F.col("uid").cast("string").alias("uid")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf_rows)
    total = size.agg(F.sum("n")).first()[0]
    if not total:
        return {}
    part = min(1.0, SAMPLE / total)
    kept = F.pmod(F.xxhash64("uid", "point_id", *XYZ), F.lit(1 << 30)) < int(part * (1 << 30))
    some = points.where(kept).withColumn("uid", F.col("uid").cast("string")).join(size, "uid").select("uid", "n", *XYZ).dropna().toPandas()
    return {u: Splits(g[list(XYZ)].to_numpy(float), -(-int(g.n.iloc[0]) // leaf_rows)) for u, g in some.groupby("uid")}


def leaf_of(points: DataFrame, splits: dict) -> Column:
    """Leaf of each row by its uid's splits; 0 for groups without."""
    if not splits:
        return F.lit(0).cast("long")
    known = points.sparkSession.sparkContext.broadcast(splits)

    @F.pandas_udf("long")
    def leaf(uid: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        p, out = np.stack([x, y, z], 1).astype(float), np.zeros(len(x), np.int64)
        for u, rows in uid.groupby(uid).indices.items():
            if u in known.value:
                out[rows] = known.value[u].leaf(p[rows])
        return pd.Series(out)

    return leaf(F.col("uid").cast("string"), *XYZ)


def leaves_near(points: DataFrame, splits: dict, radius: str) -> Column:
    """Leaves of the row's uid within radius of the row."""
    if not splits:
        return F.array(F.lit(0).cast("long"))
    known = points.sparkSession.sparkContext.broadcast(splits)

    @F.pandas_udf("array<long>")
    def leaves(uid: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series, r: pd.Series) -> pd.Series:
        p, out = np.stack([x, y, z], 1).astype(float), [np.zeros(1, np.int64)] * len(x)
        for u, rows in uid.groupby(uid).indices.items():
            if u in known.value:
                for i, found in zip(rows, known.value[u].near(p[rows], r.to_numpy(float)[rows])):
                    out[i] = found
        return pd.Series(out)

    return leaves(F.col("uid").cast("string"), *XYZ, radius)
