"""Approximate nearest neighbours with a permutation index.

A bounded sample of PIVOTS distinct vectors, by a hash of the id, serves as pivots. Every vector is represented by
its DEPTH nearest pivots in order and posted, with its position, in the inverted file of each. A query walks the
files of its own pivots, which gives Spearman's footrule distance, induced with a penalty for pivots that only one
side has, to all rows of a shard; the SHARE of the shard with the smallest distance is ranked again by the true
inner product. Shards hold rows by a hash of the id; each meets the queries in blocks, so a task holds one
shard and one block of queries, and a query's best rows of all shards are merged at the end.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, neither as queries nor as candidates; a query with fewer than k candidates gets all; equal
scores are ordered by the smaller id; rows that repeat the query's own id are no candidates; a null id is
neither query nor candidate; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import own, starts_of, whole_groups
from .near_vectors import dense, valid, vector_kind

PIVOTS = 256
DEPTH = 64
SHARE = 0.25
SHARD_ROWS, LEAST_SHARDS, SMALL_SHARD = 16_384, 32, 256
QUERY_BLOCK = 1024
EVERY = 20
K = 20

_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def permutations(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The depth nearest pivots of each vector, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :depth]


class Postings:
    """Inverted files of a shard: for each pivot its rows and their positions."""

    def __init__(self, order: np.ndarray, pivots: int):
        self.rows_of, self.at_of = [], []
        self.count, self.depth = order.shape
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        cuts = np.searchsorted(flat[by], np.arange(pivots + 1))
        for p in range(pivots):
            part = by[cuts[p] : cuts[p + 1]]
            self.rows_of.append(part // self.depth)
            self.at_of.append((part % self.depth).astype(np.int32))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Induced footrule distance of one query's pivots to every row; absent pivots count as position depth."""
        out = np.full(self.count, self.depth * (self.depth + 1), np.int32)
        for at, p in enumerate(order):
            theirs = self.at_of[p]
            out[self.rows_of[p]] += np.abs(theirs - at) - (self.depth - at) - (self.depth - theirs)
        return out


def _search(batches, pivots: np.ndarray, depth: int, share: float, k: int):
    dim = pivots.shape[1]
    for table in whole_groups(batches, ["shard", "block"], 1, 1):
        bounds = np.append(starts_of(table, ["shard", "block"]), table.num_rows)
        for low, high in zip(bounds[:-1], bounds[1:]):
            part = table.slice(low, high - low)
            query = part.column("query").to_numpy(zero_copy_only=False)
            ids = part.column("vec_id").to_numpy()
            x = dense(part.column("embedding"), dim)
            q_ids, q, v_ids, v = ids[query], x[query], ids[~query], x[~query]
            if not len(q) or not len(v):
                continue
            by = np.argsort(v_ids, kind="stable")
            v_ids, v = v_ids[by], v[by]
            files = Postings(permutations(v, pivots, depth), len(pivots))
            take = min(len(v), max(k + 1, int(np.ceil(share * len(v)))))
            out: list[list] = [[], [], []]
            for one, mine, order in zip(q_ids, q, permutations(q, pivots, depth)):
                far = files.footrule(order)
                far[v_ids == one] = np.iinfo(np.int32).max
                limit = np.partition(far, take - 1)[take - 1]
                near = np.flatnonzero(far < limit)
                near = np.concatenate((near, np.flatnonzero(far == limit)[: take - len(near)]))
                near = near[v_ids[near] != one]
                if len(near) > k:
                    rough = v[near] @ mine
                    least = np.partition(rough, len(near) - k)[len(near) - k]
                    near = near[rough >= least - 1e-9 * max(1.0, abs(least))]
                score = (v[near] * mine).sum(1)  # one order of addition for all rows, so copies tie
                best = np.lexsort((v_ids[near], -score))[:k]
                out[0].append(np.full(len(best), one))
                out[1].append(v_ids[near][best])
                out[2].append(score[best])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], schema=_SCHEMA)


def search(vectors: DataFrame, k: int = K, every: int = EVERY, share: float = SHARE) -> DataFrame:
    """The k nearest of all other vectors (vec_id, embedding) for each whose id is divisible by every:
    query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    v = own(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long"), F.col("embedding").cast(vector_kind(vectors)))
    v = v.where(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    dims = v.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"))
    most = dims.orderBy(F.desc("n"), "dim").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = v.where(F.size("embedding") == most["dim"])
    # copies would be useless as pivots, so more are drawn than are used
    chance = F.pmod(F.xxhash64("vec_id", F.lit("chance")), F.lit(1_000_000)) / 1e6
    likely = v.where(chance < max(1e-6, min(1.0, 32 * PIVOTS / most["n"])))
    drawn = likely.orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id").limit(8 * PIVOTS).toPandas()
    pivots = np.array(list(dict.fromkeys(tuple(x) for x in drawn["embedding"]))[:PIVOTS], np.float64)
    depth = min(DEPTH, len(pivots))
    shards = max(-(-most["n"] // SHARD_ROWS), min(LEAST_SHARDS, -(-most["n"] // SMALL_SHARD)))
    blocks = max(1, -(-most["q"] // QUERY_BLOCK))
    place = lambda seed, n: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    rows = v.select(place("shard", shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("query"), "vec_id", "embedding")
    asked = v.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), place("block", blocks).alias("block"), F.lit(True).alias("query"), "vec_id", "embedding")
    met = rows.union(asked).repartition("shard", "block").sortWithinPartitions("shard", "block")
    found = met.mapInArrow(lambda it: _search(it, pivots, depth, share, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
