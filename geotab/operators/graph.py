"""Connected components of edge tables."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """Shared folder of spark.checkpoint.dir; a temporary one where that is unset, as in tests."""
    return spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="spark-"))


FEW = 100_000  # rows of a table that Spark may broadcast by its size on disk


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs nothing. It goes when the driver's JVM ends.

    Tables of more than FEW rows are joined by shuffles: their size on disk says little about what they would take on the driver.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    back = spark.read.schema(df.schema).parquet(path)
    return back if back.count() <= FEW else shuffled(back)


def shuffled(df: DataFrame) -> DataFrame:
    """df, never broadcast by Spark's own estimate, which takes exploded rows for as many as there were before."""
    return df.hint("merge")


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df, broadcast if it has no more than most rows; larger tables are left to Spark."""
    return F.broadcast(df) if len(df.select(F.lit(1)).take(most + 1)) <= most else df


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of n nodes is connected with by edges a, b."""
    root = np.arange(n)
    while True:
        u, v = root[a], root[b]
        if (u == v).all():
            return root
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]


HELD = 1 << 20  # edges of one group that a task holds


def _stars(batches, most: int):
    """Edges as stars around the least node of what they connect; rows come group by group. whole: all edges of the group were seen at once."""
    held, cut = None, False

    def star(pdf: pd.DataFrame, whole: bool, but_first: bool = False) -> pd.DataFrame:
        group, uids = pd.factorize(pdf["uid"])
        u, ids = np.concatenate((group, group)), np.concatenate((pdf["a"].to_numpy(), pdf["b"].to_numpy()))
        order = np.lexsort((ids, u))
        first = np.ones(len(order), bool)
        first[1:] = (np.diff(u[order]) != 0) | (np.diff(ids[order]) != 0)
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(first) - 1
        u, ids = u[order][first], ids[order][first]
        root = _roots(at[: len(pdf)], at[len(pdf) :], len(ids))
        return pd.DataFrame({"uid": np.asarray(uids)[u], "a": ids, "b": ids[root], "whole": whole & (u != group[0]) if but_first else np.full(len(u), whole)})

    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(held):
            continue
        last = held["uid"].iloc[-1]
        more = held["uid"] != last
        if more.any():
            yield star(held[more], True, cut)
            held, cut = held[~more], False
        if len(held) > most:
            held = star(held, False)[["uid", "a", "b"]]
            if len(held) > most // 2:  # as many nodes: the group goes on in parts
                yield held.assign(whole=False)
                held, cut = None, True
    if held is not None and len(held):
        yield star(held, not cut)


def components_by(edges: DataFrame, most: int = HELD) -> DataFrame:
    """(uid, node, component) of the nodes of edges (uid, a, b), connected within their uid; nodes are long.

    Groups of up to about most nodes are settled where they meet, in a stream; of larger ones, parts are drawn together before the rounds of components.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(edges.dtypes)["uid"]
    e = edges.select("uid", "a", "b").dropna().where("a <> b").repartition(n, "uid").sortWithinPartitions("uid")
    e = settle(e.mapInPandas(lambda it: _stars(it, most), f"uid {kind}, a long, b long, whole boolean"), "stars")
    done = e.where("whole").select("uid", F.col("a").alias("node"), F.col("b").alias("component"))
    rest = e.where("not whole")
    if rest.isEmpty():
        return done
    key = lambda c: F.struct("uid", F.col(c).alias("id"))
    g = components(rest.select(key("a").alias("a"), key("b").alias("b")))
    alone = rest.select("uid", F.col("a").alias("node")).distinct()
    g = alone.join(g.select("node.uid", F.col("node.id").alias("node"), F.col("component.id").alias("component")), ["uid", "node"], "left")
    return done.unionByName(g.withColumn("component", F.coalesce("component", "node")))


HUB, PARTS = 1000, 32


def _lookup(edges: DataFrame, low: DataFrame, key: str, rows: int) -> DataFrame:
    """edges (of so many rows) with the least neighbour m that low has for key, or null.

    Nodes with more than HUB edges, and more than a 10 000th of all, so 10 000 at most, are spread over PARTS parts, each with a copy of low's row.
    """
    hubs = F.broadcast(edges.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(HUB, rows // 10_000)).select(key, F.lit(True).alias("_hub")))
    zero = F.lit(0).cast("long")
    left = edges.join(hubs, key, "left").withColumn("_part", F.when(F.col("_hub"), F.pmod(F.xxhash64("a", "b"), F.lit(PARTS))).otherwise(zero)).drop("_hub")
    every = F.when(F.col("_hub"), F.sequence(zero, F.lit(PARTS - 1).cast("long"))).otherwise(F.array(zero))
    right = low.join(hubs, key, "left").withColumn("_part", F.explode(every)).drop("_hub")
    return left.join(right, [key, "_part"], "left").drop("_part")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes of edges (a, b); component is the smallest node reachable.

    Each round moves the larger neighbours of every node to its smallest neighbour, then the smaller ones as well, until all edges
    lead to the smallest node of their component. Smallest neighbours are grouped minima, which combine before the shuffle; edges of hubs are spread.
    """
    e = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    e = settle(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = state(e)
    for _ in range(rounds):
        if not now[0]:
            break
        low = e.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = _lookup(e, low, "b", now[0]).select("a", F.coalesce("m", "b").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        less = _lookup(large, low, "a", now[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = settle(less.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, now = now, state(e)
        if now == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
