"""Language identification with bit-sliced Bloom filters over byte n-grams.

Training counts, over a bounded sample of labelled documents (BOUND for each language, by a hash of
the id), in how many documents of each language a 4-byte gram of the lower-cased text occurs.
A language keeps the grams that are frequent in it and not much more frequent elsewhere, at most TOP. All
languages share one table: its cell h holds one bit for each language, so that the AND of the
cells of a gram's K hashes is the bit mask of all languages that may contain it.

A text's evidence for a language is the share of its grams whose mask has the language's bit,
corrected for the share that false positives alone would give. The largest evidence decides,
ties go to the first language name; the evidence is the score.

Defined cases: null text, or one without a letter, is `und` with score 0; a text with letters but
without known grams gets the most frequent language with score 0; without any labelled document all texts
are `und`; repeated rows and very long texts are judged row by row, over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, give_back, held_out, mix64, own

BOUND = 3000
LANGUAGES = 1024
TOP = 20_000
CELLS = 1 << 18
K = 3
GRAM = 4
#: Evidence below which a document is rejected as being in no known language.
LEAST = 0.2

_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and value of each gram of a chunk, and which rows have an ASCII letter."""
    n = len(off) - 1
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(off) + 2)
    text = np.full(len(row), 32, np.uint8)
    inner = np.ones(len(row), bool)
    edge = off[:-1] + 2 * np.arange(n)
    inner[edge] = False
    inner[off[1:] + 2 * np.arange(n) + 1] = False
    text[inner] = _CLEAN[data]
    space = text == 32
    keep = np.ones(len(text), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[edge] = True
    text, row = text[keep], row[keep]
    letters = np.bincount(row, weights=_LETTER[text], minlength=n) > 0
    if len(text) < GRAM:
        return np.empty(0, np.int32), np.empty(0, np.uint64), letters
    value = np.zeros(len(text) - GRAM + 1, np.uint32)
    for j in range(GRAM):
        value |= text[j : len(value) + j].astype(np.uint32) << np.uint32(8 * j)
    same = row[: len(value)] == row[GRAM - 1 :]
    return row[: len(value)][same], value[same].astype(np.uint64), letters


def _count(batches):
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("docs", pa.int64())])
    for batch in batches:
        lang = np.array(batch.column("lang").to_pylist(), object)
        names, code = np.unique(lang, return_inverse=True) if len(lang) else (lang, np.empty(0, int))
        found = []
        for first, data, off in chunks(pc.utf8_lower(batch.column("text"))):
            row, value, _ = grams(data, off)
            pair = np.unique((row.astype(np.uint64) << np.uint64(32)) | value)
            found.append((code[first + (pair >> np.uint64(32)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (pair & np.uint64(0xFFFFFFFF)))
        if not found:
            continue
        pair, n = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[(pair >> np.uint64(32)).astype(np.int64)], pa.string()), pa.array((pair & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))],
            schema=schema,
        )
    give_back()


class Model:
    """languages by name, the table of masks (CELLS x words of 64 languages), false positive rates."""

    def __init__(self, languages: list[str], usual: int, keys: dict[int, np.ndarray]):
        self.languages, self.usual = languages, usual
        self.table = np.zeros((-(-max(1, len(languages)) // 64), CELLS), np.uint64)
        fill = np.zeros(len(languages))
        for l, values in keys.items():
            cells = np.concatenate([self.cells(values, k) for k in range(K)])
            self.table[l // 64, cells] |= np.uint64(1 << (l % 64))
            fill[l] = len(np.unique(cells)) / CELLS
        self.false = fill**K

    @staticmethod
    def cells(values: np.ndarray, k: int) -> np.ndarray:
        if k == 0:
            return (values * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)
        return (mix64(values + np.uint64(k << 40)) >> np.uint64(46)).astype(np.int64)

    def evidence(self, row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """Corrected share of each row's grams known to each language."""
        total = np.maximum(np.bincount(row, minlength=n), 1)
        out = np.zeros((n, len(self.languages)))
        cells = [self.cells(values, k) for k in range(K)]
        for w, plane in enumerate(self.table):
            mask = plane[cells[0]]
            for c in cells[1:]:
                mask &= plane[c]
            for l in range(64 * w, min(64 * w + 64, len(self.languages))):
                hit = (mask >> np.uint64(l % 64)) & np.uint64(1)
                share = np.bincount(row, weights=hit.astype(np.float32), minlength=n) / total
                out[:, l] = np.maximum(0, share - self.false[l]) / (1 - self.false[l])
        return np.minimum(out, 1)

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        for first, data, off in chunks(pc.utf8_lower(texts)):
            row, values, letters = grams(data, off)
            n = len(off) - 1
            best, score = np.full(n, self.usual), np.zeros(n)
            if self.languages:
                e = self.evidence(row, values, n)
                top = e.argmax(1)
                score = e[np.arange(n), top]
                best = np.where(score > 0, top, self.usual)
            for i in range(n):
                known = letters[i] or any(c.isalpha() for c in texts[first + i].as_py() or "")
                if not known or not self.languages:
                    score[i] = 0
                names.append(self.languages[best[i]] if known and self.languages else "und")
            scores[first : first + n] = score
        return names, scores


def train(docs: DataFrame, bound: int = BOUND, mod: int = 4, out: int = 2) -> Model:
    """A model of docs (doc_id, text, lang) without the held-out ids."""
    bounded_batches(docs)
    d = own(docs, "doc_id", "text", "lang").where(~held_out("doc_id", mod, out) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in d.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], 0, {})
    chance = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_000)) / 1e6
    share = F.element_at(F.create_map(*[F.lit(x) for l in languages for x in (l, min(1.0, bound / counts[l]))]), F.col("lang"))
    taken = {l: counts[l] * min(1.0, bound / counts[l]) for l in languages}
    docs_of = F.element_at(F.create_map(*[F.lit(x) for l in languages for x in (l, float(taken[l]))]), F.col("lang"))
    n = d.where(chance < share).select("lang", "text").mapInArrow(_count, "lang string, gram long, docs long")
    n = n.groupBy("lang", "gram").agg(F.sum("docs").alias("docs")).withColumn("share", F.col("docs") / docs_of)
    n = n.where(F.col("share") >= 0.01).withColumn("most", F.max("share").over(Window.partitionBy("gram")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("share"), "gram"))
    kept = n.where("share >= 0.25 * most").withColumn("rank", rank).where(F.col("rank") <= TOP).select("lang", "gram").toPandas()
    at = {l: i for i, l in enumerate(languages)}
    keys = {at[l]: g.gram.to_numpy().astype(np.uint64) for l, g in kept.groupby("lang")}
    usual = at[max(languages, key=lambda l: (counts[l], [-ord(c) for c in l]))]
    return Model(languages, usual, keys)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and lang_score of the whole text."""
    bounded_batches(docs)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang_pred string, score double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            names, scores = model.judge(text)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], fields=list(kind))
        give_back()

    found = docs.withColumn("_lang", judge(F.col("text").cast("string")))
    return found.withColumn("lang_pred", F.col("_lang.lang_pred")).withColumn("lang_score", F.col("_lang.score")).drop("_lang")
