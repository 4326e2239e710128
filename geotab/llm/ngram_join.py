"""N-gram Jaccard join of documents with Bayesian pruning of candidates.

1. Each text becomes its set of 5-word shingles (words are runs outside [\\x20\\x09-\\x0D], lower-cased)
   and HASHES MinHash values. Texts with the same bag of shingles form a class; a class stands for
   all its copies from here on, so copies are never expanded into pairs.
2. Classes that agree on the ROWS values of one of BANDS bands meet in a bucket. A bucket with many
   members is split into blocks, and each pair of blocks is a unit of work of its own, so no task
   gets a whole bucket. In a block, MinHash values are compared CHUNK at a time; a pair is dropped
   once the posterior probability (uniform prior) that its similarity reaches the threshold is
   below TOLERANCE. What survives is reported as links to the smallest member, not as pairs.
3. Connected groups of survivors are verified exactly: pairs of blocks of a group compare sets,
   after the same pruning, and report the number of links of each class and its smallest partner.
4. Connected components of the exact links are the groups of the result.

A pair at the threshold is missed with probability (1 - 0.8**4)**20 = 2.6e-5 by the bands and about
TOLERANCE times the number of comparisons by the pruning; more similar pairs much less often.

Defined cases: null, empty or blank text links with nothing and is a group of its own; a text
of fewer than five words has one shingle, all its words; rows that repeat an id and a text link like
other copies; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, components, cut, give_back, local_roots, matrix, mix64, own, salted_join, shingles, spread, starts_of, whole_groups

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
HASHES = BANDS * ROWS
CHUNK = 16
TOLERANCE = 1e-4

_rng = np.random.default_rng(20240501)
_A = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest of n equal MinHash values that leave the threshold a posterior probability of tolerance."""
    below = 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n


def minhashes(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have shingles, and their HASHES values."""
    start = np.flatnonzero(np.diff(row, prepend=-1))
    out = np.empty((len(start), HASHES), np.uint32)
    at = 0
    while at < len(start):  # pieces that stay in the cache
        to = max(at + 1, int(np.searchsorted(start, start[at] + 60_000)))
        low, high = start[at], start[to] if to < len(start) else len(hashes)
        part, cuts = hashes[low:high], start[at:to] - low
        for k in range(HASHES):
            out[at:to, k] = np.minimum.reduceat(part * _A[k] + _B[k], cuts) >> np.uint64(32)
        at = to
    return row[start], out


def _class_ids(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.diff(row, prepend=-1))
    sums = [np.add.reduceat(mix64(hashes ^ np.uint64(s)), start) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return row[start], np.stack(sums, 1)


def _features(texts: pa.Array) -> pa.Array:
    cls: list = [None] * len(texts)
    sig: list = [None] * len(texts)
    for first, data, off in chunks(pc.utf8_lower(texts)):
        row, hashes = shingles(data, off, WORDS)
        if len(row):
            rows, values = minhashes(row, hashes)
            _, ids = _class_ids(row, hashes)
            for r, c, s in zip((rows + first).tolist(), ids, values):
                cls[r], sig[r] = c.tobytes(), s.tobytes()
    return pa.StructArray.from_arrays([pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], names=["cls", "sig"])


def _sets(texts: pa.Array, wanted: pa.Array) -> pa.Array:
    """Class, signature and distinct shingles of texts that are of the wanted class; nulls for others.

    The wanted class is an argument so that the sets are made after the join that picks the texts.
    """
    out: list[list] = [[None] * len(texts) for _ in range(3)]
    for first, data, off in chunks(pc.utf8_lower(texts)):
        row, hashes = shingles(data, off, WORDS)
        if len(row):
            rows, values = minhashes(row, hashes)
            _, ids = _class_ids(row, hashes)
            ends = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
            for i, r in enumerate((rows + first).tolist()):
                out[0][r], out[1][r] = ids[i].tobytes(), values[i].tobytes()
                out[2][r] = np.unique(hashes[ends[i] : ends[i + 1]]).tobytes()
    for i, want in enumerate(wanted.to_pylist()):
        if out[0][i] != want:
            out[0][i] = out[1][i] = out[2][i] = None
    return pa.StructArray.from_arrays([pa.array(x, pa.binary()) for x in out], names=["cls", "sig", "shingles"])


def _task_features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield _features(texts)
    give_back()


def _task_sets(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, wanted in batches:
        yield _sets(texts, wanted)
    give_back()


def _shingled(texts: DataFrame) -> DataFrame:
    """texts (grp, members, n, text, want) of the wanted class, with its signature and shingles in place of the text.

    Said to be nondeterministic, as Spark would work out a plain function twice, by a worker for the filter and another one for the columns.
    """
    made = F.arrow_udf(_task_sets, "cls binary, sig binary, shingles binary").asNondeterministic()
    return texts.withColumn("_f", made("text", "want")).select("grp", "members", "n", "_f.cls", "_f.sig", "_f.shingles").where("cls is not null")


def surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, need: list[int]) -> np.ndarray:
    """Which pairs (a[i], b[i]) are not dropped by the incremental comparison."""
    left = np.arange(len(a))
    same = np.zeros(len(a), np.int32)
    for k, least in enumerate(need):
        part = slice(k * CHUNK, (k + 1) * CHUNK)
        same = same + (sig[a[left], part] == sig[b[left], part]).sum(1)
        keep = same >= least
        left, same = left[keep], same[keep]
        if not len(left):
            break
    return left


def pairs_of(start: np.ndarray, n: int, own_: np.ndarray, cross: np.ndarray):
    """Pairs of rows of the same group, one distance at a time; of two blocks only pairs across."""
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
    left = np.arange(n)
    d = 0
    while len(left):
        d += 1
        left = left[left + d < n]
        left = left[group[left] == group[left + d]]
        ok = left[~cross[left] | (own_[left] != own_[left + d])]
        if len(ok):
            yield ok, ok + d


_BUCKET = ["band", "key", "_i", "_j"]
_GROUP = ["grp", "_i", "_j"]


#: Pairs, and sets on a side, that are held at once.
PAIRS, TILE = 1 << 20, 1024


def _survivors(start: np.ndarray, sig: np.ndarray, own_: np.ndarray, cross: np.ndarray, need: list[int]):
    """Pairs that the incremental comparison leaves, about PAIRS at a time."""
    held, count = [], 0
    for a, b in pairs_of(start, len(sig), own_, cross):
        for at in range(0, len(a), PAIRS):
            k = surviving(sig, a[at : at + PAIRS], b[at : at + PAIRS], need)
            if len(k):
                held.append((a[at + k], b[at + k]))
                count += len(k)
            if count >= PAIRS:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, count = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _candidates(batches, need: list[int]):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    for table in whole_groups(batches, _BUCKET, 20_000):
        start = starts_of(table, _BUCKET)
        sig = matrix(table.column("sig"), np.uint32, HASHES)
        own_ = table.column("_own").to_numpy()
        cross = table.column("_i").to_numpy() != table.column("_j").to_numpy()
        root = np.arange(len(sig))
        for a, b in _survivors(start, sig, own_, cross, need):
            mine = np.flatnonzero(root != np.arange(len(root)))
            root = local_roots(np.concatenate((mine, a)), np.concatenate((root[mine], b)), len(sig))
        if (root != np.arange(len(root))).any():
            linked = np.flatnonzero(root != np.arange(len(root)))
            cls = table.column("cls")
            pairs = pa.table([cls.take(pa.array(linked)), cls.take(pa.array(root[linked]))], names=["a", "b"])
            yield from pairs.group_by(["a", "b"]).aggregate([]).cast(schema).combine_chunks().to_batches()
    give_back()


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets, by products of slices of their incidence matrix."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    width = max(256, (1 << 22) // len(sets))
    at = 0
    while at < len(code):
        base = code[at]
        to = int(np.searchsorted(code, base + width))
        m = np.zeros((len(sets), code[to - 1] - base + 1), np.float32)
        m[row[at:to], code[at:to] - base] = 1
        out += m @ m.T
        at = to
    return out


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, a tile of sets on either side at a time."""
    if len(a) < 4:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)])
    out = np.zeros(len(a), np.float32)
    tile = (a // TILE) * (len(sets) // TILE + 1) + b // TILE
    order = np.argsort(tile, kind="stable")
    for pairs in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
        some = np.unique(np.concatenate((a[pairs], b[pairs])))
        both = _overlaps([sets[i] for i in some])
        out[pairs] = both[np.searchsorted(some, a[pairs]), np.searchsorted(some, b[pairs])]
    return out


def _verify(batches, need: list[int], threshold: float):
    schema = pa.schema([("cls", pa.binary()), ("root", pa.binary()), ("links", pa.int64())])
    for table in whole_groups(batches, _GROUP):
        bounds = np.append(starts_of(table, _GROUP), table.num_rows)
        out: list[list] = [[], [], []]
        for low, high in zip(bounds[:-1], bounds[1:]):
            part = table.slice(low, high - low)
            cls = part.column("cls").to_pylist()
            first = [i for i in range(len(cls)) if not i or cls[i] != cls[i - 1]]  # sorted by class as well
            if len(first) < 2:
                continue
            if len(first) < len(cls):
                part = part.take(pa.array(first))
                cls = [cls[i] for i in first]
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("shingles").combine_chunks()]
            sig = matrix(part.column("sig"), np.uint32, HASHES)
            own_, weight = part.column("_own").to_numpy(), part.column("n").to_numpy()
            n = len(cls)
            cross = np.full(n, part.column("_i")[0].as_py() != part.column("_j")[0].as_py())
            size = np.array([len(s) for s in sets])
            links, root = np.zeros(n, np.int64), np.arange(n)
            for a, b in _survivors(np.array([0]), sig, own_, cross, need):
                ok = _common(sets, a, b) * (1 + threshold) >= threshold * (size[a] + size[b]) - 1e-9
                a, b = a[ok], b[ok]
                links += (np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)).astype(np.int64)
                mine = np.flatnonzero(root != np.arange(n))
                root = local_roots(np.concatenate((mine, a)), np.concatenate((root[mine], b)), n)
            for i in np.flatnonzero(links):
                out[0].append(cls[i])
                out[1].append(cls[root[i]])
                out[2].append(int(links[i]))
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(out, schema)], schema=schema)
    give_back()


def _need(threshold: float, tolerance: float) -> list[int]:
    return [least_matches(n, threshold, tolerance) for n in range(CHUNK, HASHES + 1, CHUNK)]


def join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashed: bool = False) -> DataFrame:
    """One row for each of docs (doc_id, text): doc_id, n_links (other documents at least threshold
    similar), component_id (smallest doc_id reachable by links), kept (doc_id = component_id).

    hashed: also the hash of the text, a key of the group, and the number of copies in its class (null for blank texts)."""
    need = _need(threshold, tolerance)
    bounded_batches(docs)
    docs = own(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rep = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("h"))
    rows = cut(docs.withColumn("_f", F.arrow_udf(_task_features, "cls binary, sig binary")("text")).select("doc_id", rep.alias("rep"), F.xxhash64("text").alias("hash"), "_f.cls", "_f.sig"), "minhash")
    classes = rows.where("cls is not null").groupBy("cls").agg(
        F.min("rep").alias("rep"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig")
    )
    classes = cut(classes, "classes")

    bands = classes.select("cls", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "sig")
    bands = bands.select("cls", "band", F.expr(f"substring(sig, band * {4 * ROWS} + 1, {4 * ROWS})").alias("key"))
    many = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = bands.join(many, ["band", "key"]).join(classes.select("cls", "sig"), "cls")
    buckets = spread(buckets, "members", "cls").repartition(*_BUCKET).sortWithinPartitions(*_BUCKET, "cls")
    edges = buckets.select(*_BUCKET, "_own", "cls", "sig").mapInArrow(lambda it: _candidates(it, need), "a binary, b binary")

    group = cut(components(edges).withColumnRenamed("node", "cls"), "groups")
    sizes = group.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    wanted = group.join(sizes, "component").join(classes.select("cls", "rep", "n"), "cls")
    wanted = wanted.select(F.col("cls").alias("want"), F.col("component").alias("grp"), "members", "n", F.col("rep.id").alias("id"), F.col("rep.h").alias("h"))
    texts = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("h"), "text")
    sets = spread(_shingled(texts.join(wanted, ["id", "h"])), "members", "cls").repartition(*_GROUP).sortWithinPartitions(*_GROUP, "cls")
    checked = cut(
        sets.select(*_GROUP, "_own", "n", "cls", "sig", "shingles").mapInArrow(lambda it: _verify(it, need, threshold), "cls binary, root binary, links long"),
        "links",
    )
    linked = checked.groupBy("cls").agg(F.sum("links").alias("links"))
    final = components(checked.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    named = classes.select("cls", "least_id", "n").join(linked, "cls", "left").join(final.withColumnRenamed("node", "cls"), "cls", "left")
    named = named.withColumn("component", F.coalesce("component", "cls"))
    low = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(low, "component").select("cls", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.col("n").alias("n_class"), F.xxhash64("component").alias("group"))
    out = salted_join(rows.select("cls", "doc_id", "hash"), named, "cls", rows.count())
    own_group = F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    more = ["hash", "group", "n_class"] if hashed else []
    return out.select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own_group.alias("component_id"), *more).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One document of each group: of the texts with the group's smallest id, the one with the smallest hash; blank documents one for each id and text."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    d = docs.select(whole, F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_h"))
    kept = join(docs.select("doc_id", "text"), **how, hashed=True).where("kept")
    # a group may hold its smallest id with several texts
    one = kept.where("n_class is not null").groupBy("component_id", "group").agg(F.min("hash").alias("_h"))
    one = one.select(F.col("component_id").alias("_id"), "_h").union(kept.where("n_class is null").select(F.col("component_id").alias("_id"), F.col("hash").alias("_h"))).distinct()
    same = d["_id"].eqNullSafe(one["_id"]) & d["_h"].eqNullSafe(one["_h"])
    return d.join(one, same, "left_semi").dropDuplicates(["_id", "_h"]).select("_doc.*")


#: SQL twin over all pairs with a common shingle.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS n, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT n, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS h FROM d),
z AS (SELECT n, count(*) AS c FROM s GROUP BY n),
p AS (SELECT a.n AS a, b.n AS b FROM s a JOIN s b ON a.h = b.h AND a.n <> b.n JOIN z x ON x.n = a.n JOIN z y ON y.n = b.n GROUP BY a.n, b.n, x.c, y.c HAVING count(*) * 1.8 >= 0.8 * (x.c + y.c) - 1e-9),
c(n, m) AS (SELECT n, n FROM d UNION SELECT c.n, p.b FROM c JOIN p ON p.a = c.m),
g AS (SELECT c.n, min(d.doc_id) AS component_id FROM c JOIN d ON d.n = c.m GROUP BY c.n),
l AS (SELECT a AS n, count(*) AS k FROM p GROUP BY a)
SELECT d.doc_id, coalesce(l.k, 0) AS n_links, g.component_id, d.doc_id IS NOT DISTINCT FROM g.component_id AS kept FROM d JOIN g ON g.n = d.n LEFT JOIN l ON l.n = d.n
"""
