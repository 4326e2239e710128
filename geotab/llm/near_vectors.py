"""Embedding near-dedup by sorted projection passes.

Vectors of one label are compared. Copies of a vector are represented by one. In each pass the vectors are
ordered by label and by 64 random hyperplane bits, and each is compared, by cosine in double precision,
with its WINDOW next neighbours in that order. A vector meets all that share so many leading bits with it
that their run fits into the window on both sides; how many bits that takes is read off the order itself, so
each vector has its own bound on the probability that a partner at the threshold was missed by all passes, however
unevenly the codes spread. A vector is open until its bound is at most MISS. A pair is settled once one of
its vectors is, so further rounds of passes order the open ones only, and when these are few or no longer get
fewer (near copies, stars and other crowds of more vectors than a window holds), all pairs of open
vectors are compared, block against block. Verified pairs are united within each
stretch of the order and then across passes (connected components). Within a component all
pairs are then counted exactly, block against block, so the number of links doesn't depend on the window.

Defined cases: null vectors, zero vectors, those that hold null or non-finite components, and those with a null label
link with nothing, and are kept; vectors of unlike length do not link; repeated rows link as copies do; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, local_roots, own, salted_join, spread, starts_of, whole_groups

THRESHOLD = 0.98
WINDOW = 32
MISS = 1e-6
BITS = 64
LEAST_PASSES, MOST_PASSES = 8, 96
FEW = 2048


def valid(vector: Column) -> Column:
    """Not null, not zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_kind(vectors: DataFrame) -> str:
    """Type in which embeddings are carried: double if they come so, else float."""
    return "array<double>" if dict(vectors.dtypes).get("embedding") == "array<double>" else "array<float>"


def passes_for(largest: int, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes of a round: as many as leave a pair at the threshold unmet with probability miss where codes spread evenly."""
    same = 1 - acos(threshold) / pi
    p = same ** max(1.0, log2(max(2, largest) / window))
    n = ceil(log(miss) / log(1 - p)) if p < 1 else 1
    return max(LEAST_PASSES, min(MOST_PASSES, n))


def planes(dim: int, number: int) -> np.ndarray:
    return np.random.default_rng([dim, number]).standard_normal((dim, BITS))


def dense(column, dim: int) -> np.ndarray:
    """A list column, without nulls, whose lists have dim components, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def scaled(column, dim: int) -> np.ndarray:
    """dense, with each vector times the power of two that brings its largest component near 1: squares neither over- nor underflow, cosines stay exactly the same."""
    x = dense(column, dim)
    _, exponent = np.frexp(np.abs(x).max(1))
    return np.ldexp(x, -exponent[:, None])


_ORDER = ["pass", "label", "dim", "code", "node"]
_STRETCH = ["pass", "label", "dim"]


def _coded(batches, first: int, passes: int):
    for batch in batches:
        kind = batch.schema.field("vector").type
        schema = pa.schema([("pass", pa.int32()), ("label", pa.string()), ("dim", pa.int32()), ("code", pa.int64()), ("node", pa.int64()), ("vector", kind)])
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            x = scaled(part.column("vector"), int(dim))
            for k in range(first, first + passes):
                bits = x @ planes(int(dim), k) > 0
                code = np.packbits(bits, axis=1).view(">i8")[:, 0].astype(np.int64)
                columns = [pa.array(np.full(len(x), k, np.int32)), part.column("label"), part.column("dim"), pa.array(code), part.column("node"), part.column("vector")]
                yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, schema)], schema=schema)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading bits that codes have in common."""
    x = (a ^ b).view(np.uint64)
    for k in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(k))
    return BITS - np.bitwise_count(x).astype(np.int64)


def _cover(table: pa.Table, bounds: np.ndarray, low: int, high: int, last: bool, threshold: float, window: int) -> np.ndarray:
    """-log of the probability that rows low to high of a partition miss a partner at the threshold in their pass.

    A row whose run may go on in another partition counts as one that misses.
    """
    at = np.arange(low, high)
    stretch = np.searchsorted(bounds, at, "right")
    begin, end = bounds[stretch - 1], bounds[stretch]
    code = table.column("code").to_numpy()
    bits = np.zeros(len(at), np.int64)
    for beyond, other in ((at - window < begin, at - window), (at + window >= end, at + window)):
        i = np.flatnonzero(~beyond)
        bits[i] = np.maximum(bits[i], _shared(code[at[i]], code[other[i]]) + 1)
    same = 1 - acos(threshold) / pi
    met = np.where(bits > BITS, 0.0, same**bits)
    # low is above window but at a partition's start, whose first stretch may have begun before
    met[(begin == 0) & (at < window)] = 0
    if last:
        met[(end == table.num_rows) & (at + window >= end)] = 0
    with np.errstate(divide="ignore"):
        return -np.log1p(-met)


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cover", pa.float64())])


def _neighbours(batches, threshold: float, window: int):
    """Links of a sorted partition, each node to the smallest of its stretch it is connected with; and the cover of each node."""
    table, done = None, 0
    for batch in _and_end(batches):
        last = batch is None
        if not last:
            new = pa.Table.from_batches([batch])
            table = (new if table is None else pa.concat_tables([table, new])).combine_chunks()
        if table is None or not table.num_rows:
            continue
        bounds = np.append(starts_of(table, _STRETCH), table.num_rows)
        node = table.column("node").to_numpy()
        high = table.num_rows if last else max(done, table.num_rows - window)
        cover = _cover(table, bounds, done, high, last, threshold, window)
        some = np.flatnonzero(cover > 0)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(node[done:high][some]), pa.nulls(len(some), pa.int64()), pa.array(cover[some])], schema=_FOUND)
        if last:
            continue
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo < 2:
                continue
            part = table.slice(lo, hi - lo)
            x = scaled(part.column("vector"), part.column("dim")[0].as_py())
            norm = np.sqrt((x * x).sum(1))
            a, b = [], []
            for d in range(1, min(window, len(x) - 1) + 1):
                i = np.flatnonzero((x[:-d] * x[d:]).sum(1) / (norm[:-d] * norm[d:]) >= threshold)
                a.append(i)
                b.append(i + d)
            yield from _linked(part, np.concatenate(a), np.concatenate(b))
        start = max(0, high - window)
        table, done = table.slice(start), high - start


def _and_end(batches):
    yield from batches
    yield None


def _linked(part: pa.Table, a: np.ndarray, b: np.ndarray):
    """Links a-b of rows, each node to the smallest it is connected with."""
    root = local_roots(a, b, part.num_rows)
    linked = np.flatnonzero(root != np.arange(len(root)))
    node = part.column("node").to_numpy()
    if len(linked):
        yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]]), pa.nulls(len(linked), pa.float64())], schema=_FOUND)


_PAIR = ["label", "dim", "_i", "_j"]


def _compared(batches, threshold: float):
    """Links between two blocks of open vectors, or within a block."""
    for table in whole_groups(batches, _PAIR, 8000):
        bounds = np.append(starts_of(table, _PAIR), table.num_rows)
        for low, high in zip(bounds[:-1], bounds[1:]):
            part = table.slice(low, high - low).combine_chunks()
            x = scaled(part.column("vector"), part.column("dim")[0].as_py())
            norm = np.sqrt((x * x).sum(1))
            own_, i, j = part.column("_own").to_numpy(), part.column("_i")[0].as_py(), part.column("_j")[0].as_py()
            left, right = np.flatnonzero(own_ == i), np.flatnonzero(own_ == j)
            root = np.arange(len(x))
            for at in range(0, len(left), 256):
                rows = left[at : at + 256]
                a, b = np.nonzero((x[rows] @ x[right].T) / (norm[rows, None] * norm[right]) >= threshold)
                # links so far are kept as one link a row
                mine = np.flatnonzero(root != np.arange(len(root)))
                root = local_roots(np.concatenate((mine, rows[a])), np.concatenate((root[mine], right[b])), len(x))
            mine = np.flatnonzero(root != np.arange(len(root)))
            yield from _linked(part, mine, root[mine])


def _open_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """Links among all pairs of a label."""
    sizes = vectors.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("members"))
    pairs = spread(vectors.join(sizes, ["label", "dim"]), "members", "node").select(*_PAIR, "_own", "node", "vector")
    pairs = pairs.repartition(*_PAIR).sortWithinPartitions(*_PAIR, "node")
    return pairs.mapInArrow(lambda it: _compared(it, threshold), "a long, b long, cover double").select("a", "b")


def links(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS, few: int = FEW) -> DataFrame:
    """Links (a, b) that connect what is connected among vectors (label, dim, node, vector)."""
    kind = dict(vectors.dtypes)["vector"]
    size = lambda df: df.groupBy("label", "dim").count().agg(F.sum("count"), F.max("count")).first()
    left = vectors.select("label", "dim", "node", "vector", F.lit(0.0).alias("cover"))
    total, largest = size(left)
    first = rounds = 0
    edges = None
    while total:
        # a run has to fit in on both sides, which takes about two bits more than in the mean
        passes = passes_for(4 * largest, threshold, window, miss)
        coded = left.select("label", "dim", "node", "vector").mapInArrow(
            lambda it, first=first, passes=passes: _coded(it, first, passes), f"pass int, label string, dim int, code long, node long, vector {kind}"
        )
        tasks = max(vectors.sparkSession.sparkContext.defaultParallelism, total * passes // 20_000)
        order = coded.repartitionByRange(tasks, *_ORDER).sortWithinPartitions(*_ORDER)
        found = cut(order.mapInArrow(lambda it: _neighbours(it, threshold, window), "a long, b long, cover double"), "passes")
        new = found.where("b is not null").select("a", "b")
        edges = new if edges is None else edges.union(new)
        gained = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("cover").alias("gained"))
        left = left.join(gained, "node", "left").withColumn("cover", F.col("cover") + F.coalesce("gained", F.lit(0.0)))
        left = cut(left.where(F.col("cover") < -log(miss)).select("label", "dim", "node", "vector", "cover"), "open")
        before, first, rounds = total, first + passes, rounds + 1
        total, largest = size(left)
        if total and (largest <= few or rounds > 1 and 2 * total > before):
            return edges.union(_open_pairs(left, threshold))
    return vectors.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0) if edges is None else edges


_GROUP = ["component", "_i", "_j"]


def _counted(batches, threshold: float):
    """Links of each node with the nodes of the other block, or of its own block."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64())])
    for table in whole_groups(batches, _GROUP, 8000):
        bounds = np.append(starts_of(table, _GROUP), table.num_rows)
        for low, high in zip(bounds[:-1], bounds[1:]):
            part = table.slice(low, high - low)
            x = scaled(part.column("vector"), part.column("dim")[0].as_py())
            norm = np.sqrt((x * x).sum(1))
            node, weight, own_ = (part.column(c).to_numpy() for c in ("node", "n", "_own"))
            i, j = part.column("_i")[0].as_py(), part.column("_j")[0].as_py()
            links = np.zeros(len(x), np.int64)
            left, right = np.flatnonzero(own_ == i), np.flatnonzero(own_ == j)
            for at in range(0, len(left), 1024):
                rows = left[at : at + 1024]
                near = (x[rows] @ x[right].T) / (norm[rows, None] * norm[right]) >= threshold
                if i == j:
                    near[rows[:, None] == right] = False
                links[rows] += near @ weight[right]
                if i != j:
                    links[right] += weight[rows] @ near
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links)], schema=schema)


def dedup(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id, kept for each of vectors (vec_id, embedding, label)."""
    v = own(vectors, "vec_id", "embedding", "label")
    kind = vector_kind(vectors)
    v = v.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind), F.col("label").cast("string"))
    ok = valid(F.col("embedding")) & F.col("label").isNotNull()
    v = v.withColumn("k1", F.when(ok, F.xxhash64("embedding"))).withColumn("k2", F.when(ok, F.xxhash64(F.lit(7), "embedding")))
    copies = v.where("k1 is not null").groupBy("label", "k1", "k2").agg(
        F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("vector")
    )
    copies = cut(copies.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "vectors")
    group = cut(components(links(copies, threshold, window)), "groups")

    sizes = group.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    inside = group.join(sizes, "component").join(copies.select("node", "n", "dim", "vector"), "node")
    inside = spread(inside, "members", "node").repartition(*_GROUP).sortWithinPartitions(*_GROUP, "node")
    counts = inside.select(*_GROUP, "_own", "node", "n", "dim", "vector").mapInArrow(lambda it: _counted(it, threshold), "node long, links long")
    counts = counts.groupBy("node").agg(F.sum("links").alias("links"))
    named = copies.select("label", "k1", "k2", "n", "least_id", "node").join(group, "node", "left").join(counts, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    low = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(low, "component").select("label", "k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    # rows of one vector may be many: keys are joined as one column, nulls for vectors that take no part
    key = F.when(F.col("k1").isNotNull(), F.struct("label", "k1", "k2")).alias("key")
    out = salted_join(v.select(key, "vec_id"), named.select(key, "n_links", "component_id"), "key", v.count())
    alone = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), alone.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: SQL twin over all pairs of a label.
ORACLE = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS n, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
o AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.n AS a, b.n AS b FROM o a JOIN o b ON a.label = b.label AND a.n <> b.n AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
c(n, m) AS (SELECT n, n FROM v UNION SELECT c.n, p.b FROM c JOIN p ON p.a = c.m),
g AS (SELECT c.n, min(v.vec_id) AS component_id FROM c JOIN v ON v.n = c.m GROUP BY c.n),
l AS (SELECT a AS n, count(*) AS k FROM p GROUP BY a)
SELECT v.vec_id, coalesce(l.k, 0) AS n_links, g.component_id, v.vec_id IS NOT DISTINCT FROM g.component_id AS kept FROM v JOIN g ON g.n = v.n LEFT JOIN l ON l.n = v.n
"""
