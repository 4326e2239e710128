"""Toxicity with a support vector machine over a gap-weighted subsequence string kernel.

The kernel of two words counts the subsequences of four letters (a word's edges count as letters) that they share, each weighted
DECAY for every letter it spans, spans of at most SPAN letters; so `idxiot` stays close to `idiot`. Letters and digits
only count: punctuation inside a word is skipped, runs of single letters are read as one word, and words of more than
LONGEST letters are read in overlapping parts. The kernel of two sentences sums that of their words, so several words
together can make a sentence toxic. A sentence ends with a word that ends in . ! or ? and after PIECE words at the latest.

Training (bounded samples of labelled documents by a hash of the id): a sentence has the label of its document. Of a document its most toxic sentence counts (at first the one with the words most tied to toxic sentences), and one other, of a
toxic document further ones above the margin; copies of a sentence count once; every second also counts with a letter inserted into its words. Landmarks are words of these sentences
with the most weight in either class, apart from each other; Nystroem features of the kernel, summed over a
sentence, feed a squared-hinge machine. With its values the sentences and landmarks are chosen anew, ROUNDS times
over; toxic documents without a sentence near the margin count little then, as they may be mislabelled. As the
kernel has an explicit feature for each subsequence, the landmarks' expansion folds into one weight
table, and a word costs one look-up for each subsequence. A document scores as its
most toxic sentence; a logistic curve turns this into the score, one half where fewest training documents err.

Defined cases: null, empty or wordless text has the value of a sentence without words; without labelled
documents of both classes every score is 0; repeated rows and very long texts are scored row by row,
whole; conflicting labels of one id count as toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, give_back, held_out, own

BOUND = {1: 3000, 0: 6000}
DECAY = 0.6
SPAN = 6
LANDMARKS = 160
PIECE = 16
ROUNDS = 2
#: Sentences above the margin that a toxic document of the sample gives beside its most toxic one, at most.
TOLD = 4
LONGEST = 64
#: Words whose values a task keeps at most.
CACHE = 200_000

_DIM = 1 << 20
_EDGE = 31
_GAPS = [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]


def plain(word: str) -> str:
    """Lower-cased letters and digits of a word."""
    return word if word.isalnum() else "".join(filter(str.isalnum, word))


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word number and code (0 to 31) of each letter of all words, each word between two edges."""
    size = np.array([len(w) + 2 for w in words], np.int64)
    code = np.frombuffer("".join([f" {w} " for w in words]).encode("utf-32-le"), np.uint32)
    low = (code >= 97) & (code <= 122)
    out = np.where(low, code - 96, 27 + code % 4)
    end = np.cumsum(size)
    out[end - 1] = out[end - size] = _EDGE
    return np.repeat(np.arange(len(words)), size), out.astype(np.int32)


def subsequences(words: list[str]):
    """(word, feature, weight) of each subsequence, one choice of gaps at a time."""
    word, c = letters(words)
    for x, y, z in _GAPS:
        i = np.flatnonzero(word[: len(c) - z] == word[z:]) if len(c) > z else np.empty(0, np.int64)
        yield word[i], (c[i] << 15) | (c[i + x] << 10) | (c[i + y] << 5) | c[i + z], DECAY ** (z + 1)


def vectors(words: list[str]):
    """Feature vectors as (word, feature, value), features of a word distinct; a word's scale is set by all its subsequences."""
    parts = list(subsequences(words))
    key = np.concatenate([w.astype(np.int64) * _DIM + f for w, f, _ in parts])
    value = np.concatenate([np.full(len(w), v) for w, _, v in parts])
    norm = np.sqrt(np.bincount(key // _DIM, value**2, len(words)))
    key, at = np.unique(key, return_inverse=True)
    value = np.bincount(at, value, len(key)) if len(key) else value
    word = key // _DIM
    return word, key % _DIM, value / norm[word]


def gram(words: list[str], others: list[str]) -> np.ndarray:
    """Normalised kernel of words with others."""
    out = np.zeros((len(words), len(others)))
    ow, of, ov = vectors(others)
    known = np.zeros(_DIM, bool)
    known[of] = True
    w, f, v = vectors(words)
    some = known[f]
    w, f, v = w[some], f[some], v[some]
    dense = np.zeros(_DIM)
    for j in range(len(others)):
        part = ow == j
        dense[of[part]] = ov[part]
        out[:, j] = np.bincount(w, v * dense[f], len(words))
        dense[of[part]] = 0
    return out


def apart(words: list[str], count: int, near: float = 0.7) -> list[str]:
    """The first count of words of two letters or more that are not near to one before."""
    words = [w for w in words if len(w) > 1]
    k = gram(words, words)
    chosen: list[int] = []
    for i in range(len(words)):
        if len(chosen) < count and (not chosen or k[i, chosen].max() < near):
            chosen.append(i)
    return [words[i] for i in chosen]


def fit_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a linear squared-hinge machine (last: the offset), by Newton steps."""
    w = np.zeros(x.shape[1] + 1)
    penalty = np.full(len(w), ridge * weight.sum())
    penalty[-1] = 1e-9
    for _ in range(50):
        hessian, toward = np.diag(penalty), np.zeros(len(w))
        for at in range(0, len(x), 8192):
            part = np.hstack((x[at : at + 8192], np.ones((len(x[at : at + 8192]), 1)))).astype(float)
            active = y[at : at + 8192] * (part @ w) < 1
            weighted = part[active] * weight[at : at + 8192][active, None]
            hessian += weighted.T @ part[active]
            toward += weighted.T @ y[at : at + 8192][active]
        new = np.linalg.solve(hessian, toward)
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def inserted(words: list[str], rng: np.random.Generator) -> list[str]:
    """Words with a letter put into each of more than three letters."""
    abc = "abcdefghijklmnopqrstuvwxyz"
    out = []
    for w in words:
        k = int(rng.integers(1, max(2, len(w))))
        out.append(w[:k] + abc[rng.integers(26)] + w[k:] if len(w) > 3 else w)
    return out


def fold(sentences: list[list[str]], y: np.ndarray, weight: np.ndarray, marks: list[str]) -> tuple[np.ndarray, float]:
    """Weight of each subsequence, and the offset, of the machine over Nystroem features of sentences."""
    value, vector = np.linalg.eigh(gram(marks, marks))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    x = np.zeros((len(sentences), root.shape[1]), np.float32)
    for low in range(0, len(sentences), 1000):
        some = [list(dict.fromkeys(s)) for s in sentences[low : low + 1000]]
        at = {w: i for i, w in enumerate(dict.fromkeys(w for s in some for w in s))}
        if at:
            z = gram(list(at), marks) @ root
            size = np.array([len(s) for s in some])
            x[low : low + 1000][size > 0] = np.add.reduceat(z[[at[w] for s in some for w in s]], (np.cumsum(size) - size)[size > 0])
    w = fit_machine(x, y, weight)
    beta = root @ w[:-1]
    table = np.zeros(_DIM)
    k, f, v = vectors(marks)
    np.add.at(table, f, v * beta[k])
    return table.astype(np.float32), float(w[-1])


class Model:
    """Values of words are their summands in the value of a sentence; start gives those of some words before there is a machine."""

    def __init__(self, table: np.ndarray | None, offset: float = 0.0, slope: float = 0.0, shift: float = 0.0, start: dict[str, float] | None = None):
        self.table, self.offset, self.slope, self.shift, self.start = table, offset, slope, shift, start
        self._clear()

    def __getstate__(self):
        return self.table, self.offset, self.slope, self.shift, self.start

    def __setstate__(self, state):
        self.__init__(*state)

    @property
    def trained(self) -> bool:
        return self.table is not None

    def _clear(self):
        self.seen, self.values = {}, np.empty(1 << 14, np.float32)
        self.single, self.ends = np.empty(1 << 14, bool), np.empty(1 << 14, bool)

    def word_values(self, words: list[str]) -> np.ndarray:
        words = [plain(w) for w in words]
        if self.start is not None:
            return np.array([self.start.get(w, 0.0) for w in words])
        up, square = np.zeros(len(words)), np.zeros(len(words))
        for w, f, v in subsequences(words):
            up += np.bincount(w, self.table[f], len(words)) * v
            square += np.bincount(w, minlength=len(words)) * v**2
        return np.where(square > 0, up / np.sqrt(np.maximum(square, 1e-12)), 0)

    def _learn(self, new: list[str]):
        first, end = len(self.seen), len(self.seen) + len(new)
        while end > len(self.values):
            self.values, self.single, self.ends = (np.concatenate((x, np.empty_like(x))) for x in (self.values, self.single, self.ends))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            here = slice(first + at, first + at + len(part))
            self.values[here] = self.word_values(part)
            self.single[here] = [len(w) == 1 and w.isalnum() for w in part]
            self.ends[here] = [w[-1] in ".!?" for w in part]
        self.seen.update(zip(new, range(first, end)))

    @staticmethod
    def _words(text: str | None) -> list[str]:
        words = text.lower().split() if text else []
        if words and max(map(len, words)) > LONGEST:
            step = LONGEST // 2
            words = [w[k : k + LONGEST] for w in words for k in range(0, max(1, len(w) - step), step)]
        return words

    def sentences(self, text: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words, where each sentence begins, and the value of each sentence."""
        words = self._words(text)
        if not words:
            return words, np.empty(0, np.int64), np.empty(0)
        if len(self.seen) > CACHE:
            self._clear()
        new = [w for w in dict.fromkeys(words) if w not in self.seen]
        if new:
            self._learn(new)
        n = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
        value = self.values[n].astype(float)
        single = self.single[n]
        if len(n) > 2 and (single[:-2] & single[1:-1] & single[2:]).any():
            edge = np.flatnonzero(np.diff(np.concatenate(([False], single, [False])).view(np.int8)))
            runs = [(a, b) for a, b in zip(edge[::2], edge[1::2]) if b - a > 2]
            parts = [(a, "".join(words[a:b])[k : k + LONGEST]) for a, b in runs for k in range(0, max(1, b - a - LONGEST // 2), LONGEST // 2)]
            np.add.at(value, [a for a, _ in parts], self.word_values([w for _, w in parts]))
        ends = self.ends[n]
        at = np.arange(len(n))
        begin = np.maximum.accumulate(np.where(np.concatenate(([True], ends[:-1])), at, 0))
        new = (at - begin) % PIECE == 0
        first = np.flatnonzero(new)
        # a word repeated within a sentence counts once
        pair = np.cumsum(new) << 32 | n
        _, once = np.unique(pair, return_index=True)
        kept = np.zeros(len(n))
        kept[once] = value[once]
        return words, first, np.add.reduceat(kept, first) + self.offset

    def highest(self, text: str | None) -> float:
        _, _, value = self.sentences(text)
        return float(value.max()) if len(value) else self.offset

    def telling(self, text: str | None, seed: int, toxic: bool) -> tuple[float, str, list[str]]:
        """Value of the most toxic sentence, that sentence, and others as plain words: of a clean document one at random, of a toxic one TOLD of those above the margin."""
        words, first, value = self.sentences(text)
        if not len(value):
            return self.offset, "", []
        said = lambda k: " ".join(w for w in map(plain, words[first[k] : first[k + 1] if k + 1 < len(first) else len(words)]) if w)
        best = int(value.argmax())
        others = np.flatnonzero(value > 0) if toxic else np.arange(len(value))
        others = np.roll(others[others != best], seed)[: TOLD if toxic else 1]
        return float(value.max()), said(best), [said(int(k)) for k in others]

    def score(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * values + self.shift, -30, 30)))


def _highest(docs: DataFrame, model: Model) -> DataFrame:
    bounded_batches(docs)

    @F.arrow_udf("double")
    def value(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            yield pa.array([model.highest(t.as_py()) for t in text], pa.float64())
        model._clear()
        give_back()

    return docs.withColumn("_value", value(F.col("text").cast("string")))


def _telling(sample: DataFrame, model: Model):
    """The telling sentences of the sampled documents (a row each, so bounded) on the driver."""

    @F.arrow_udf("value double, best string, other array<string>")
    def pick(text: pa.Array, row: pa.Array, toxic: pa.Array) -> pa.Array:
        found = [model.telling(t.as_py(), r.as_py() * 0x9E3779B1 % 1_000_003, y.as_py() == 1) for t, r, y in zip(text, row, toxic)]
        kinds = (("value", pa.float64()), ("best", pa.string()), ("other", pa.list_(pa.string())))
        return pa.StructArray.from_arrays([pa.array([x[i] for x in found], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    return sample.select("toxic", "row", pick("text", "row", "toxic").alias("p")).select("row", "toxic", "p.*").toPandas().sort_values("row")


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic slope, by damped Newton steps with slightly softened labels, and the shift that puts one half where fewest documents err."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    m = np.stack((x, np.ones_like(x)), 1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        grad = m.T @ (p - t) + 1e-3 * w
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + 1e-3 * np.eye(2), grad)
        w -= step * min(1, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    slope = max(float(w[0]), 1e-3)
    order = np.argsort(x, kind="stable")
    cuts = np.concatenate(([x[order[0]] - 1], (x[order][1:] + x[order][:-1]) / 2, [x[order[-1]] + 1]))
    errors = np.concatenate(([0], np.cumsum(y[order] > 0))) + (y <= 0).sum() - np.concatenate(([0], np.cumsum(y[order] <= 0)))
    errors[1:-1][np.diff(x[order]) == 0] = len(y) + 1  # no cut between equal values
    best = np.flatnonzero(errors == errors.min())
    return slope, -slope * float(np.median(cuts[best]))


def train(docs: DataFrame, labels: DataFrame, bound: dict[int, int] | None = None, mod: int = 5, out: int = 0) -> Model:
    """A model of the labelled docs (doc_id, text) without the held-out ids; labels (doc_id, toxic)."""
    bound = bound or BOUND
    known = own(labels, "doc_id", "toxic").where(~held_out("doc_id", mod, out) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if len(count) < 2:
        return Model(None)
    share = F.when(F.col("toxic") == 1, min(1.0, bound[1] / count[1])).otherwise(min(1.0, bound[0] / count[0]))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1_000_000)) / 1e6 < share)
    # the sample has about sum(bound) ids whatever the input's size, so it may be broadcast
    sample = cut(own(docs, "doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id").select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("row"), "text", "toxic"), "labelled")
    total = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return Model(None)
    # copies of a document share sentences, which count once
    said = sample.select("toxic", F.explode(F.split(F.lower("text"), r"(?<=[.!?])\s+")).alias("sentence")).distinct()
    raw = F.explode(F.array_distinct(F.transform(F.split("sentence", r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))))
    words = said.select("toxic", raw.alias("word")).where(F.length("word") > 2)
    words = words.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("n"))
    size = said.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    nt, nn = float(size[0]), float(size[1])
    e = (F.col("t") + F.col("n")) * (nt / (nt + nn))
    g = 2 * (F.col("t") * F.log(F.greatest("t", F.lit(1e-9)) / e) + F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") / (F.col("t") + F.col("n") - e))).otherwise(0))
    words = words.withColumn("tie", F.when(F.col("t") > e, F.sqrt(F.greatest(g, F.lit(0.0)))).otherwise(0.0))
    strong = (F.col("tie") > 3.5) & (F.col("t") >= 3) & (F.col("t") / nt > 8 * F.col("n") / nn)
    likely = words.where(strong).orderBy(F.desc("tie"), "word").limit(4 * LANDMARKS).toPandas()
    if likely.empty:
        likely = words.where("tie > 0").orderBy(F.desc("tie"), "word").limit(8).toPandas()
    if likely.empty:
        return Model(None)
    model = Model(None, start=dict(zip(likely.word, likely.tie.astype(float))))
    rng = np.random.default_rng(7)
    for _ in range(ROUNDS):
        model = _machine(_telling(sample, model), model, rng)
    fitted = _highest(sample, model).select("_value", "toxic").toPandas()
    slope, shift = _curve(fitted["_value"].to_numpy(), fitted["toxic"].to_numpy().astype(float))
    return Model(model.table, model.offset, slope, shift)


def _machine(told, model: Model, rng: np.random.Generator) -> Model:
    """The machine over telling sentences (value, toxic, best, other), with values of words and landmarks by the model before."""
    yes, no = {}, {}  # a sentence counts once, however many copies say it
    for best, other, value, toxic in zip(told.best, told.other, told.value, told.toxic):
        if toxic:
            yes[best] = 1.0 if model.start is not None or value > -0.5 else 0.1
        else:
            no[best] = 1.0
        for sentence in other:
            (yes if toxic else no)[sentence] = 1.0
    yes, no = ([(s.split(), k) for s, k in rows.items()] for rows in (yes, no))
    marks = []
    for rows in (yes, no):
        told_by: dict[str, float] = {}
        words = list(dict.fromkeys(w for s, _ in rows for w in s))
        value = {w: v for at in range(0, len(words), 20_000) for w, v in zip(words[at : at + 20_000], model.word_values(words[at : at + 20_000]))}
        for s, k in rows:
            for w in s:
                told_by[w] = told_by.get(w, 0.0) + k * max(value[w], 1e-3)
        ranked = sorted(told_by, key=lambda w: (-told_by[w], w))
        marks += [w for w in apart(ranked[: 2 * LANDMARKS], LANDMARKS // 2) if w not in marks]
    rows = [(s, 1.0, k) for s, k in yes] + [(s, -1.0, k) for s, k in no]
    size = {c: sum(k for _, y, k in rows if y == c) for c in (1.0, -1.0)}
    share = {1.0: 1.0, -1.0: 2.0}
    weight = np.array([share[y] * k / size[y] for _, y, k in rows])
    sentences = [s for s, _, _ in rows] + [inserted(s, rng) for s, _, _ in rows[::2]]
    y = np.array([y for _, y, _ in rows])
    table, offset = fold(sentences, np.concatenate((y, y[::2])), np.concatenate((weight, weight[::2])) * len(rows), marks)
    return Model(table, offset)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with toxic_score and toxic_predicted (1 from 0.5)."""
    if not model.trained:
        return docs.withColumn("toxic_score", F.lit(0.0)).withColumn("toxic_predicted", F.lit(0))
    d = _highest(docs, model)
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(model.slope) * F.col("_value") + F.lit(model.shift)))
    d = d.withColumn("toxic_score", 1 / (1 + F.exp(-z)))
    return d.withColumn("toxic_predicted", (F.col("toxic_score") >= 0.5).cast("int")).drop("_value")
