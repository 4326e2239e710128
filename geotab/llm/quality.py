"""Quality of documents by co-training on two views.

The content view describes the text: shares of kinds of characters, length and repetition of words and lines, and
hashed word frequencies. The metadata view knows only source, language and length, hashed. Each view has a logistic
classifier. In every round each is fitted to the labelled documents and to the documents the other view
is sure of (probability beyond SURE), at reduced weight; both start from the labels alone. A document's
pseudo-label is worked out from the other view's weights wherever it is needed, over all documents, so
nothing is capped or gathered: a fitting step is one pass over the compact feature table that sums
gradient and curvature per task and then by cell. Last, the two views' log odds are calibrated together on labelled
documents that neither was fitted to, and all documents are scored.

Defined cases: null or empty text has zero content features; null metadata is a value of its own; labels of
ids without documents, or other than 0 and 1, are ignored, conflicting labels of an id count as 0; without labels of
both classes every score is the share of good labels, or 0.5; repeated rows are scored each; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, cut, held_out, mix64, own, word_hashes

ROUNDS = 3
STEPS = 5
SURE = 0.95
PSEUDO_WEIGHT = 0.3
RIDGE = 1e-3
HASHED = 32
#: Calibration and held-out folds of crc32 of the id modulo 5.
FOLDS, CALIBRATE, HELD = 5, 1, 0

_KIND = np.full(256, 9, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[32], _KIND[10], _KIND[128:] = 0, 1, 2, 3, 4, 0
_KIND[[44, 46, 59, 58, 63]], _KIND[33], _KIND[124], _KIND[[35, 36, 37, 38, 42, 64, 94, 126]] = 5, 6, 7, 8
KINDS = 10
CONTENT = KINDS + 6 + HASHED
META = 4 + 2 * HASHED


def content(texts: pa.Array) -> np.ndarray:
    """Content features, a row for each text."""
    out = np.zeros((len(texts), CONTENT), np.float32)
    for first, data, off in chunks(texts):
        n = len(off) - 1
        size = np.diff(off)
        row = np.repeat(np.arange(n), size)
        share = np.bincount(row * KINDS + _KIND[data], minlength=n * KINDS).reshape(n, KINDS) / np.maximum(size, 1)[:, None]
        spaced = np.full(len(data) + n, 32, np.uint8)
        spaced[np.arange(len(data)) + row] = data
        start, words = word_hashes(spaced)
        owner = np.searchsorted(off[1:] + np.arange(n), start, "right")
        count = np.bincount(owner, minlength=n)
        some = np.maximum(count, 1)
        # a word seen again in its text: its mixed value is not new
        key = mix64(words ^ mix64(owner.astype(np.uint64))) if len(words) else words
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        # lines as words of a text whose other white space is not
        lines = np.where(spaced == 32, 95, spaced).astype(np.uint8)
        edge = off[1:] + np.arange(n)
        lines[edge] = 10
        lines[np.isin(lines, (9, 11, 12, 13))] = 95
        l_start, l_hash = word_hashes(lines)
        l_owner = np.searchsorted(edge, l_start, "right")
        l_key = mix64(l_hash ^ mix64(l_owner.astype(np.uint64))) if len(l_hash) else l_hash
        l_order = np.argsort(l_key, kind="stable")
        l_again = np.zeros(len(l_key), bool)
        l_again[l_order[1:]] = l_key[l_order[1:]] == l_key[l_order[:-1]]
        l_count = np.maximum(np.bincount(l_owner, minlength=n), 1)
        bag = np.bincount(owner * HASHED + (words % np.uint64(HASHED)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED) / some[:, None]
        out[first : first + n] = np.hstack(
            (
                share,
                np.stack(
                    (
                        np.log1p(count) / 5,
                        size / some / 10,
                        np.bincount(owner, again, n) / some,
                        np.bincount(l_owner, l_again, n) / l_count,
                        np.log1p(l_count) / 5,
                        np.log1p(some / l_count) / 5,
                    ),
                    1,
                ),
                bag,
            )
        )
    return out


def metadata(source: pa.Array, lang: pa.Array, length: pa.Array) -> np.ndarray:
    """Metadata features, a row for each document."""
    import zlib

    n = len(source)
    out = np.zeros((n, META), np.float32)
    size = np.log1p(np.maximum(0, length.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False))) / 10
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = size, size**2, size**3, length.is_null().to_numpy(zero_copy_only=False)
    for k, column in enumerate((source, lang)):
        coded = pc.dictionary_encode(column.fill_null("\0"))
        place = np.array([zlib.crc32(v.encode()) % HASHED for v in coded.dictionary.to_pylist()], np.int64)
        out[np.arange(n), 4 + k * HASHED + place[coded.indices.to_numpy(zero_copy_only=False)]] = 1
    return out


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _p(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _sums(batches, mine: str, widths: dict, w: dict, weight: tuple[float, float], sure: float, pseudo: float):
    """Gradient and curvature sums of view mine as cells (k, value)."""
    other = "meta" if mine == "content" else "content"
    d = widths[mine] + 1
    total = np.zeros(d * d + d)
    for batch in batches:
        x = _lists(batch.column(mine), widths[mine])
        y = batch.column("y").fill_null(-1).to_numpy(zero_copy_only=False).astype(float)
        fold = batch.column("fold").to_numpy(zero_copy_only=False)
        known = (y >= 0) & (fold != CALIBRATE) & (fold != HELD)
        strength = np.where(y > 0.5, weight[1], weight[0]) * known
        if w[other] is not None:
            p = _p(_odds(_lists(batch.column(other), widths[other]), w[other]))
            free = (y < 0) & ((p >= sure) | (p <= 1 - sure))
            y = np.where(free, p > 0.5, y)
            strength = np.where(free, pseudo * np.where(p > 0.5, weight[1], weight[0]), strength)
        use = strength > 0
        x, y, strength = np.hstack((x[use], np.ones((use.sum(), 1)))), y[use], strength[use]
        p = _p(np.clip(x @ w[mine], -30, 30))
        total[: d * d] += (x.T @ (x * (strength * p * (1 - p))[:, None])).ravel()
        total[d * d :] += x.T @ (strength * (p - y))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "value"])


def _step(features: DataFrame, mine: str, widths: dict, w: dict, weight, sure, pseudo) -> np.ndarray:
    start = dict(w)
    cells = features.mapInArrow(lambda it: _sums(it, mine, widths, start, weight, sure, pseudo), "k long, value double")
    got = cells.groupBy("k").agg(F.sum("value").alias("value")).toPandas().sort_values("k")["value"].to_numpy()
    d = widths[mine] + 1
    if not len(got):
        return w[mine]
    h, g = got[: d * d].reshape(d, d), got[d * d :]
    ridge = RIDGE * max(1.0, weight[0] + weight[1])
    scale = max(1.0, np.trace(h) / d)
    h = h + np.eye(d) * ridge * scale
    step = np.linalg.solve(h, g + ridge * scale * np.append(w[mine][:-1], 0))
    return w[mine] - step * min(1, 8 / max(1e-9, np.abs(step).max()))


def features_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, y (1, 0 or null), fold, content, meta of all docs."""
    bounded_batches(docs)
    d = own(docs, "doc_id", "text", "source", "lang", "n_chars").select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")
    )

    def view(text: pa.Array, source: pa.Array, lang: pa.Array, length: pa.Array) -> pa.Array:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32())) for x in (content(text), metadata(source, lang, length))]
        return pa.StructArray.from_arrays(lists, names=["content", "meta"])

    kind = "content array<float>, meta array<float>"
    made = d.withColumn("_v", F.arrow_udf(view, kind)("text", "source", "lang", "n_chars"))
    made = made.select("doc_id", F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)), F.lit(FOLDS)).cast("int").alias("fold"), "_v.content", "_v.meta")
    known = own(labels, "doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    return made.join(known, "doc_id", "left")


def _linear(view: Column, w: np.ndarray) -> Column:
    """Log odds of a view in DataFrame functions."""
    weights = F.array(*[F.lit(float(x)) for x in w[:-1]])
    products = F.zip_with(view, weights, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x) + F.lit(float(w[-1]))


def train_and_score(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, score, content_odds, meta_odds, keep for each of docs."""
    features = cut(features_of(docs, labels), "views")
    used = ~F.col("fold").isin(CALIBRATE, HELD)
    n = features.where(F.col("y").isNotNull()).agg(F.count_if((F.col("y") == 0) & used), F.count_if((F.col("y") == 1) & used), F.avg("y")).first()
    held = held_out("doc_id", FOLDS, HELD)
    if not n[0] or not n[1]:
        flat = F.lit(float(n[2]) if n[2] is not None else 0.5)
        out = features.select("doc_id", held.alias("held_out"), flat.alias("score"), F.lit(0.0).alias("content_odds"), F.lit(0.0).alias("meta_odds"))
        return out.withColumn("keep", (F.col("score") >= 0.5).cast("int"))
    weight = ((n[0] + n[1]) / 2 / n[0], (n[0] + n[1]) / 2 / n[1])
    widths = {"content": CONTENT, "meta": META}
    trained: dict = {"content": None, "meta": None}
    for _ in range(rounds):
        before = dict(trained)
        for view in widths:
            w = {view: np.zeros(widths[view] + 1) if before[view] is None else before[view]}
            w |= {o: before[o] for o in widths if o != view}
            for _ in range(STEPS):
                w[view] = _step(features, view, widths, w, weight, SURE, PSEUDO_WEIGHT)
            trained[view] = w[view]
    odds = features.select("doc_id", "y", "fold", _linear(F.col("content"), trained["content"]).alias("content_odds"), _linear(F.col("meta"), trained["meta"]).alias("meta_odds"))
    a, b, c = _calibrate(odds)
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * F.col("content_odds") + b * F.col("meta_odds") + c))
    out = odds.select("doc_id", held.alias("held_out"), (1 / (1 + F.exp(-z))).alias("score"), "content_odds", "meta_odds")
    return out.withColumn("keep", (F.col("score") >= 0.5).cast("int"))


def _calibrate(odds: DataFrame) -> tuple[float, float, float]:
    """Weights of both views' log odds and a shift, by Newton steps of grouped sums over the calibration fold."""
    d = odds.where((F.col("fold") == CALIBRATE) & F.col("y").isNotNull())
    x = [F.col("content_odds"), F.col("meta_odds"), F.lit(1.0)]
    w = np.array([1.0, 0.0, 0.0])
    for _ in range(8):
        z = sum((xi * float(wi) for xi, wi in zip(x, w)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
        cells = [F.sum((p - F.col("y")) * xi) for xi in x] + [F.sum(p * (1 - p) * xi * xj) for xi in x for xj in x]
        got = d.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).first()
        if got[0] is None:
            break
        g, h = np.array(got[:3], float), np.array(got[3:], float).reshape(3, 3)
        prior = 1.0 * np.eye(3)
        step = np.linalg.solve(h + prior, g + prior @ (w - np.array([1.0, 0.0, 0.0])))
        w = w - step * min(1, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1]), float(w[2])
