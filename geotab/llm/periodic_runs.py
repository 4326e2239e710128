"""Periodic runs of words: stretches that repeat with a period four times or more, found by minimizers at several scales.

A run of smallest period q is found by one of two ways:

* q up to SHORT: the text is compared with itself at lag q, stretch by stretch.
* q in (k/2, k] for k = 16, 32, ...: inside the run all k-grams of one period differ, as k >= q, and the least of
  them returns every q words. Windows of k/2 k-grams lie inside the run around it, so both occurrences are window minima,
  and no equal k-gram is between them. Pairs of neighbouring equal minima at a distance in (k/2, k] are therefore seeds of all runs of
  that scale; each is extended to both sides by comparing words, which also rejects chance pairs.

Words are compared by 64-bit hashes. A text costs time in proportion to its length at each scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CRC_TABLE, bounded_batches, chunks, crc_of, give_back, mix64, spaced, word_hashes, word_spans

LEAST, TIMES = 6, 4  # a run has LEAST words and TIMES periods at least
SHORT = 8  # periods of direct scans; the first scale starts behind
_STEP = np.uint64(0x9E3779B97F4A7C55)

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _stretches(true: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], true, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def _sliding(best, x: np.ndarray, width: int) -> np.ndarray:
    """best (minimum or maximum) of each window of width, a power of two."""
    step = 1
    while step < width:
        x = best(x[:-step], x[step:])
        step *= 2
    return x


def _minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """Places whose gram is the least of some window of so many grams."""
    low = _sliding(np.minimum, grams, width)
    # the greatest of the minima of the windows around a place is its own value if it is one of them
    pad = np.concatenate((np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)))
    return np.flatnonzero(_sliding(np.maximum, pad, width) == grams)


def _extent(w: np.ndarray, p: int, q: int) -> tuple[int, int]:
    """The stretch around p on which w[i] = w[i + q]; steps double, so a run costs few comparisons."""
    low = high = p
    step = 32
    while high < len(w) - q:
        to = min(high + step, len(w) - q)
        off = np.flatnonzero(w[high:to] != w[high + q : to + q])
        if len(off):
            high += int(off[0])
            break
        high, step = to, step * 2
    step = 32
    while low > 0:
        to = max(low - step, 0)
        off = np.flatnonzero(w[to:low] != w[to + q : low + q])
        if len(off):
            low = to + int(off[-1]) + 1
            break
        low, step = to, step * 2
    return low, high


def find_runs(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Runs (first word, length, period) within documents, sorted by first word, then period.

    words: hashes of the words of some documents, doc: the document of each, ascending.
    """
    w = mix64(words ^ mix64(doc.astype(np.uint64) ^ _STEP))  # words of different documents are never equal
    found = [np.empty((0, 3), np.int64)]
    for q in range(1, SHORT + 1):
        if len(w) > q:
            a, b = _stretches(w[:-q] == w[q:])
            keep = b - a + q >= max(LEAST, TIMES * q)
            found.append(np.stack((a[keep], b[keep] - a[keep] + q, np.full(keep.sum(), q)), 1))
    size = np.bincount(doc) if len(doc) else np.zeros(0, int)
    grams, at, k = w, np.arange(len(w)), 1  # grams of k words that start at the words numbered at
    while True:
        k *= 2
        if k > SHORT:  # only documents that can hold a period above k / 2
            long_enough = size[doc[at]] >= TIMES * (k // 2 + 1)
            if not long_enough.all():
                grams, at = grams[long_enough], at[long_enough]
        if len(grams) < k:
            break
        grams = mix64(grams[: -(k // 2)] * _STEP + grams[k // 2 :])
        at = at[: len(grams)]
        if k <= SHORT:
            continue
        place = _minimizers(grams, k // 2)
        order = np.argsort(grams[place], kind="stable")
        place = place[order]
        lag = np.diff(place)
        pair = np.flatnonzero((grams[place[1:]] == grams[place[:-1]]) & (lag > k // 2) & (lag <= k))
        seeds = np.stack((lag[pair], at[place[pair]]), 1)
        seeds = seeds[np.lexsort((seeds[:, 1], seeds[:, 0]))]
        of, low, high, runs = 0, 0, 0, []
        for q, p in seeds.tolist():
            if q == of and low <= p < high:
                continue
            of, (low, high) = q, _extent(w, p, q)
            if high - low + q >= TIMES * q:
                runs.append((low, high - low + q, q))
        found.append(np.array(runs, np.int64).reshape(-1, 3))
    runs = np.concatenate(found)
    # a stretch found at multiples of its smallest period counts at that one alone
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Words that some run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words, each followed by a space, and the end of each word's share."""
    size = end - start + 1
    to = np.cumsum(size)
    where = np.arange(to[-1] if len(to) else 0) + np.repeat(start - (to - size), size)
    out = data[np.minimum(where, len(data) - 1)]
    out[to - 1] = 32
    return out, to


def _texts_runs(texts: pa.Array) -> pa.Array:
    runs_out: list = []
    collapsed: list = []
    for _, data, off in chunks(texts):
        data, off = spaced(data, off)
        n = len(off) - 1
        start, words = word_hashes(data)
        end = word_spans(data)[1]
        doc = np.searchsorted(off, start, "right") - 1
        first = np.searchsorted(doc, np.arange(n + 1))
        runs = find_runs(words, doc)
        by_doc = np.searchsorted(doc[runs[:, 0]], np.arange(n + 1)) if len(runs) else np.zeros(n + 1, int)
        keep = ~_dropped(runs, len(words))
        bytes_, to = _joined(data, start[keep], end[keep])
        left = np.concatenate(([0], np.cumsum(keep)))[first]
        to = np.concatenate(([0], to))[left]
        raw = bytes_.tobytes()
        for d in range(n):
            collapsed.append(raw[to[d] : max(to[d], to[d + 1] - 1)].decode("utf-8"))
            a, b = by_doc[d], by_doc[d + 1]
            runs_out.append([{"start": s - int(first[d]), "length": m, "period": q} for s, m, q in runs[a:b].tolist()] if b > a else [])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return pa.StructArray.from_arrays([pa.array(runs_out, kind), pa.array(collapsed, pa.string())], names=["runs", "collapsed"])


def _task(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield _texts_runs(texts)
    give_back()


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with runs (start, length, period; start counts words from 0, by start, then period) and collapsed, the text's
    words joined by one space without those that repeat an earlier period of a run.

    Words are runs of characters outside [\\x20\\x09-\\x0D]. A run keeps its smallest period, has max(6, 4 periods) words
    at least and cannot be extended. Null, empty and blank texts have no runs and collapse to the empty text; a very long text
    is worked on whole, in one task. Repeated rows get equal results, an empty table gives an empty one; columns of docs named
    runs or collapsed are replaced, all others stay.
    """
    bounded_batches(docs)
    f = F.arrow_udf(_task, f"runs {RUNS}, collapsed string")(F.col(f"`{text}`").cast("string"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("runs", "collapsed")]
    return docs.withColumn("_periodic", f).select(*kept, "_periodic.runs", "_periodic.collapsed")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, in which a tenth of all documents (by crc32 of the id) repeat a stretch from some word on; null ids plant nothing."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    w = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")

    n = F.size(w)
    a = F.try_mod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), 1, n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(w, 1, a), tail), " ")).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """Counts and hashes of detect's output, and the run with greatest length (ties: smallest start, then period)."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    d = found.withColumn("_b", best)
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_b.start")).alias("start"), F.col("_b.length").alias("length"), (-F.col("_b.period")).alias("period"),
        F.floor(1000 * F.col("_b.length") / -F.col("_b.period")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: SQL twin: every lag up to a quarter of the words is scanned.
ORACLE = rf"""
WITH crc AS (SELECT {CRC_TABLE} AS tbl FROM range(256) t_(x)),
hashed AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc_of("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crc),
cut AS (SELECT doc_id, w, h, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS parts FROM hashed),
docs AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(w, lambda x, i: CASE WHEN i - 1 < a THEN x ELSE w[a + (i - 1 - a) % (1 + (n - a) // parts) + 1] END) END AS w FROM cut),
words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM docs),
same AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
isles AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM same) s GROUP BY doc_id, q, isle),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM isles WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id),
told AS (SELECT doc_id, count(*) AS n_runs, max({{'length': length, 'start': -start, 'period': -period}}) AS best,
 string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, -best.start AS start, best.length AS length, -best.period AS period, CAST(1000 * best.length // -best.period AS BIGINT) AS exponent_milli,
 sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM docs d LEFT JOIN told t ON t.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
