"""Helpers shared by the llm operators: shared storage, word hashing, column names, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="spark-"))
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it back: stable rows, no lineage.

    The table is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Remove a folder when the driver's JVM ends."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def drop_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its garbage: shuffles that no plan refers to any more leave the executors' disks then."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(df: DataFrame) -> None:
    """Arrow batches of few megabytes in df's session, whatever the length of its texts."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def give_back() -> None:
    """Return the memory a worker has freed to the machine; workers are reused by later stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own ways
        pass


def held_out(col: str, mod: int, value: int):
    """crc32 of the id as text, modulo mod, is value; a null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % mod == value, F.lit(False))


def own(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, nulls where a column is missing, so that extra columns cannot clash."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


#: Table of crc32 by its rule, in DuckDB SQL, for SQL twins; x runs over 0 to 255.
CRC_TABLE = "list(list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY x)"


def crc_of(text: str) -> str:
    """crc32 of an ASCII text in DuckDB, with the table in the column tbl."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, z: xor(c // 256, tbl[xor(c % 256, z) + 1])), 4294967295::BIGINT)"


# ---------------------------------------------------------------- words

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x + _M3
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x100000001B3
_CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """Powers of the hash base and of its inverse, grown when a longer chunk comes."""

    up = _powers(_P, 16)
    down = _powers(pow(_P, -1, 1 << 64), 16)

    @classmethod
    def need(cls, n: int) -> None:
        if len(cls.up) <= n:
            cls.up, cls.down = _powers(_P, n + 1), _powers(pow(_P, -1, 1 << 64), n + 1)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every run of bytes outside [\\x20\\x09-\\x0D]."""
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def spaced(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes with a space after each, so that words of neighbours stay apart, and their new offsets."""
    n = len(off) - 1
    out = np.full(len(data) + n, 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(off))] = data
    return out, off + np.arange(n + 1)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start byte and 64-bit hash of every run of bytes outside [\\x20\\x09-\\x0D]."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    _Tables.need(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _Tables.up[: len(data)], out=total[1:])
    return start, mix64((total[end] - total[start]) * _Tables.down[start])


def chunks(texts: pa.Array):
    """(first row, byte array, byte offsets) of runs of rows of about a megabyte; null is empty."""
    texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(off, off[row] + _CHUNK, "right")) - 1)
        yield row, data[off[row] : off[to]], off[row : to + 1] - off[row]
        row = to


def shingles(data: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of k words within a row, in order of rows, with repeats.

    A row with fewer than k words, but at least one, has all its words as its single shingle.
    Rows must not share words: a row that follows another without white space is still cut at its start.
    """
    n = len(off) - 1
    # a space between rows keeps words of neighbours apart
    gap = np.arange(n, dtype=np.int64)
    spaced = np.full(len(data) + n, 32, np.uint8)
    length = np.diff(off)
    row_of_byte = np.repeat(gap, length)
    spaced[np.arange(len(data)) + row_of_byte] = data
    start, words = word_hashes(spaced)
    row = np.searchsorted(off[1:] + gap, start, "right")
    base = np.uint64(0x9E3779B97F4A7C55)
    if len(words) >= k:
        h = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            h = h * base + words[j : len(words) - k + 1 + j]
        same = row[: len(h)] == row[k - 1 :]
        rows, hashes = row[: len(h)][same], mix64(h[same])
    else:
        rows, hashes = np.empty(0, np.int64), np.empty(0, np.uint64)
    count = np.bincount(row, minlength=n)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.cumsum(count) - count
        extra = []
        for r in short:
            x = np.uint64(count[r])
            with np.errstate(over="ignore"):
                for w in words[first[r] : first[r] + count[r]]:
                    x = x * base + w
            extra.append(x)
        rows = np.concatenate((rows, short))
        hashes = np.concatenate((hashes, mix64(np.array(extra, np.uint64))))
        order = np.argsort(rows, kind="stable")
        rows, hashes = rows[order], hashes[order]
    return rows, hashes


# ---------------------------------------------------------------- components


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n indices over links a[i]-b[i]."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, root):
            break
        root = new
    return root


HOT, MOST_HOT, SALTS = 1000, 10_000, 64


def salted_join(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """left (of so many rows) with the one row that right has for key, or nulls.

    Keys of more than HOT rows of left, and more than rows / MOST_HOT, so MOST_HOT keys at most (which bounds the broadcast), are spread over
    SALTS parts, each with a copy of right's row; null keys are spread as well.
    """
    hot = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(HOT, rows // MOST_HOT)).select(key, F.lit(True).alias("_hot"))
    part = F.pmod(F.xxhash64(*[c for c in left.columns if c != key]), F.lit(SALTS))
    le = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot") | F.col(key).isNull(), part).otherwise(F.lit(0).cast("long"))).drop("_hot")
    all_parts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    ri = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), all_parts).otherwise(F.array(F.lit(0).cast("long"))))).drop("_hot")
    return le.join(ri, [key, "_salt"], "left").drop("_salt")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b) as (node, component), component the smallest node.

    Alternates large-star and small-star steps: a node's larger neighbours move to its smallest neighbour, then
    its smaller ones do. Smallest neighbours are grouped minima, which combine before the shuffle, and joins back to the edges spread hubs over parts.
    Rounds are written to the shared folder; a round ends the loop when it changes nothing.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")

    def state(x: DataFrame):
        r = x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    before = state(e)
    for _ in range(rounds):
        if not before[0]:
            break
        # a node without smaller neighbours is its own smallest, so only the others need to be looked up
        low = e.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = salted_join(e, low, "b", before[0]).select("a", F.coalesce("m", "b").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, low, "a", before[0]).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


# ---------------------------------------------------------------- groups in blocks

BLOCK = 256
MOST_BLOCKS, LARGEST_BLOCK = 64, 8192


def _blocks(members: Column) -> Column:
    """Number of blocks for a group of so many members."""
    small = F.least(F.ceil(members / BLOCK), F.lit(MOST_BLOCKS))
    return F.greatest(small, F.ceil(members / LARGEST_BLOCK)).cast("int")


def spread(df: DataFrame, members: str, key: str) -> DataFrame:
    """A row of a group for each pair of blocks it belongs to: _i <= _j, and its own block _own."""
    df = df.withColumn("_nb", _blocks(F.col(members))).withColumn("_own", F.pmod(F.xxhash64(key, F.lit("block")), F.col("_nb")).cast("int"))
    df = df.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return df.withColumn("_i", F.least("_own", "_o")).withColumn("_j", F.greatest("_own", "_o")).drop("_o", "_nb")


def whole_groups(batches, keys: list[str], rows: int = 4000, size: int = 1 << 25):
    """Tables that hold whole groups of a partition sorted by keys."""
    held: list[pa.RecordBatch] = []
    count = bytes_ = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        bytes_ += batch.nbytes
        if count < rows and bytes_ < size:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        first = starts_of(table, keys)[-1]
        if first:
            yield table.slice(0, first)
        tail = table.slice(first).combine_chunks()
        held, count, bytes_ = tail.to_batches(), 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def starts_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a new group begins."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        c = table.column(k).combine_chunks()
        new[1:] |= ~pc.equal(c[1:], c[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def matrix(column: pa.ChunkedArray, kind, width: int) -> np.ndarray:
    """Binary values of equal length as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)
