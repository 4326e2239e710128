"""Log-probabilities of texts by an n-gram model as a weighted backoff automaton.

Model. Words get p(w) = (c + 1/2) / (N + (V + 1) / 2) from their counts; longer contexts h are interpolated,
p(w | h) = L c(hw) / c(h) + (1 - L) p(w | h'), h' being h without its first word and L a weight of h's length and of the
order of magnitude of c(h), chosen by the likelihood of all training words, each left out of the counts that predict it.

Automaton. The root and every n-gram h with a count (LEAST_CONTEXT from two words on) are states. A state has an arc for each word
seen after it, with log10 p(w | h), to the longest state that ends the text; other words take its failure arc, with log10(1 - L), to h'.
A traversal from left to right carries the state and adds up the arcs' weights; many texts are walked abreast.

No task holds the model. Texts are cut into blocks of whole documents, kept as word numbers; each block asks for the counts of its own
distinct n-grams, by hash, of those that can occur in the model: an n-gram of three words or more only if its context is a state.
A bucket of hashes adds up what the blocks have of each n-gram in training documents, and answers every block with the totals in the
order of its question. So each block gets the part of the automaton that its texts can reach.
"""

from __future__ import annotations

import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, chunks, delete_on_exit, drop_shuffles, give_back, mix64, own, shared_dir, spaced, starts_of, whole_groups, word_hashes

ORDER = 3
LEAST_CONTEXT = 2
BLOCK_TOKENS = 1 << 19  # a longer document is a block of its own
BUCKET_TOKENS = 1 << 19
STRETCH = 256  # tokens that one walker goes through
WEIGHTS = np.array([0, 0.001, 0.003, 0.01, 0.03, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])
CLASSES = 64  # orders of magnitude (powers of two) of c(h)

_END = np.uint64(0x6A09E667F3BCC909)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = "block long, learn binary, words binary, tokens binary, n long, trained long"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---------------------------------------------------------------- blocks of documents


def _planes(x: np.ndarray) -> bytes:
    """Integers as planes of bytes, low bytes first, which compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _to_blocks(batches, key: pa.DataType):
    """Rows (doc_id, text, learn) as blocks: ids, words by frequency, and the documents' tokens as word numbers, each ended by number 0."""
    from pyspark import TaskContext

    schema = pa.schema([("ids", pa.list_(key)), ("block", pa.int64()), *[(c, pa.binary()) for c in ("learn", "words", "tokens")], ("n", pa.int64()), ("trained", pa.int64())])
    block = TaskContext.get().partitionId() << 32
    rows: list = []
    learn: list[np.ndarray] = []
    tokens: list[np.ndarray] = []
    held = 0

    def made():
        t = np.concatenate(tokens)
        words, which, count = np.unique(t, return_inverse=True, return_counts=True)
        rank = np.empty(len(words), np.int64)
        count[words == _END] = len(t) + 1  # the end is number 0
        rank[np.argsort(-count, kind="stable")] = np.arange(len(words))
        by_rank = np.empty_like(words)
        by_rank[rank] = words
        ends = np.diff(np.concatenate(([0], np.flatnonzero(t == _END) + 1)))
        known = np.concatenate(learn)
        trained = int(ends[known].sum())
        return pa.RecordBatch.from_pylist(
            [{"ids": rows, "block": block, "learn": known.tobytes(), "words": by_rank.tobytes(), "tokens": _planes(rank[which].astype(np.uint32)), "n": len(t), "trained": trained}], schema=schema
        )

    for b in batches:
        ids, flags = b.column(0).to_pylist(), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for first, data, off in chunks(b.column(1)):
            data, off = spaced(_LOWER[data], off)
            n = len(off) - 1
            start, words = word_hashes(data)
            doc = np.searchsorted(off, start, "right") - 1
            words = np.insert(np.where(words == _END, ~words, words), np.searchsorted(doc, np.arange(n), "right"), _END)
            rows += ids[first : first + n]
            learn.append(flags[first : first + n])
            tokens.append(words)
            held += len(words)
            if held >= BLOCK_TOKENS:
                yield made()
                block += 1
                rows, learn, tokens, held = [], [], [], 0
    if held:
        yield made()
    give_back()


class _Grams:
    """The distinct n-grams of a block's documents, level by level, and which of them each token ends."""

    def __init__(self, words: bytes, tokens: bytes, learn: bytes):
        self.words = np.frombuffer(words, np.uint64)
        self.tokens = _numbers(tokens, np.uint32).astype(np.int64)
        n = len(self.tokens)
        end = self.tokens == 0
        self.doc = np.concatenate(([0], np.cumsum(end)[:-1]))
        self.place = np.arange(n) - np.concatenate(([0], np.flatnonzero(end) + 1))[self.doc]  # in its document
        self.learn = np.frombuffer(learn, bool)[self.doc]
        self.hash = [self.words[self.tokens]]  # of the n-gram that ends at each token
        order = np.argsort(self.words)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.keys = [self.words[order]]  # distinct hashes by level
        self.at = [number[self.tokens]]  # number of a token's n-gram among keys, -1 for none
        self.total: list[np.ndarray] = []  # answered counts of keys

    def _distinct(self, asked: np.ndarray) -> None:
        keys, which = np.unique(self.hash[-1][asked], return_inverse=True)
        at = np.full(len(asked), -1)
        at[asked] = which
        self.keys.append(keys)
        self.at.append(at)

    def deeper(self) -> None:
        """The next level: n-grams whose context is, or may be, a state; with the totals known so far only states count."""
        level = len(self.keys)
        h = np.zeros(len(self.tokens), np.uint64)
        h[1:] = mix64(self.hash[-1][:-1] * _MUL + self.hash[0][1:])
        self.hash.append(h)
        asked = self.place >= level
        if not len(self.keys[-1]):
            asked[:] = False
        elif len(self.total) == level and level > 1:
            before = np.concatenate(([-1], self.at[-1][:-1]))
            asked &= (before >= 0) & (self.total[-1][before] >= LEAST_CONTEXT)
        self._distinct(asked)

    def first(self, level: int) -> np.ndarray:
        """A token that ends each n-gram."""
        at = self.at[level]
        there = np.flatnonzero(at >= 0)
        f = np.empty(len(self.keys[level]), np.int64)
        f[at[there]] = there
        return f

    def learned(self, level: int) -> np.ndarray:
        """Counts of keys in training documents."""
        at = self.at[level][self.learn]
        return np.bincount(at[at >= 0], minlength=len(self.keys[level]))

    def answer(self, answers) -> None:
        """Totals by level from (level, bucket, totals), each in order of its keys."""
        for level in sorted({a["level"] for a in answers}):
            while len(self.keys) <= level:
                self.deeper()
            mine = sorted((a for a in answers if a["level"] == level), key=lambda a: a["bucket"])
            self.total.append(np.concatenate([_numbers(a["totals"], np.int64) for a in mine]))


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among ascending keys, and their number: buckets are equal ranges of hashes."""
    bounds = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))


# ---------------------------------------------------------------- counts: blocks ask, buckets answer

_ASK = pa.schema([("bucket", pa.int64()), ("level", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("bucket", pa.int64()), ("totals", pa.binary()), ("distinct", pa.int64())])


def _ask(batches, buckets: int, levels: tuple[int, ...]):
    for b in batches:
        for r in b.to_pylist():
            g = _Grams(r["words"], r["tokens"], r["learn"])
            if r.get("answers"):
                g.answer(r["answers"])
            for level in levels:
                while len(g.keys) <= level:
                    g.deeper()
                counts = g.learned(level).astype(np.uint32)
                cuts = _cuts(g.keys[level], buckets)
                some = np.flatnonzero(np.diff(cuts))
                for part in np.array_split(some, len(some) // 500 + 1):
                    rows = [(int(k), slice(cuts[k], cuts[k + 1])) for k in part]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k for k, _ in rows], pa.int64()), pa.array([level] * len(rows), pa.int32()), pa.array([r["block"]] * len(rows), pa.int64()),
                            pa.array([_spread(g.keys[level][o]) for _, o in rows], pa.binary()), pa.array([_packed(counts[o]) for _, o in rows], pa.binary()),
                        ],
                        schema=_ASK,
                    )
            del g
    give_back()


def _packed(counts: np.ndarray) -> bytes:
    """Counts by their bytes' frequencies; most are 1."""
    return pa.compress(_planes(counts), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return _numbers(pa.decompress(raw, 4 * n, codec="zstd", asbytes=True), np.uint32)


def _spread(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences, whose high bytes are mostly zero."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _total(batches):
    """Sums of each bucket and level over its blocks, for each block in the order of its keys; distinct: keys with a count, told once."""
    for table in whole_groups(batches, ["bucket", "level"]):
        bounds = np.append(starts_of(table, ["bucket", "level"]), table.num_rows)
        for low, high in zip(bounds[:-1], bounds[1:]):
            part = table.slice(low, high - low)
            keys = [np.cumsum(_numbers(x, np.uint64), dtype=np.uint64) for x in part.column("keys").to_pylist()]
            counts = [_unpacked(x, len(k)) for x, k in zip(part.column("counts").to_pylist(), keys)]
            _, which = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(which, np.concatenate(counts)).astype(np.int64)
            cuts = np.cumsum([len(k) for k in keys])[:-1]
            answers = [_planes(x) for x in np.split(total[which], cuts)]
            distinct = [int((total > 0).sum())] + [0] * (len(keys) - 1)
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c).combine_chunks() for c in ("block", "level", "bucket")], pa.array(answers, pa.binary()), pa.array(distinct, pa.int64())], schema=_ANSWER
            )
    give_back()


def _totals(blocks: DataFrame, buckets: int, levels: tuple[int, ...]) -> DataFrame:
    """Answers to each block, and how many distinct words its rows told of."""
    asked = blocks.mapInArrow(partial(_ask, buckets=buckets, levels=levels), "bucket long, level int, block long, keys binary, counts binary")
    dealt = asked.repartition("bucket").sortWithinPartitions("bucket", "level", "block")
    told = dealt.mapInArrow(_total, "block long, level int, bucket long, totals binary, distinct long")
    answers = F.collect_list(F.struct("level", "bucket", "totals")).alias("answers")
    return _bucketed(told.groupBy("block").agg(answers, F.sum(F.when(F.col("level") == 0, F.col("distinct"))).alias("distinct")), "answers")


def _bucketed(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, in buckets by block, so that joins on it shuffle nothing."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option("path", path).option("compression", "zstd").saveAsTable(name)
    delete_on_exit(spark, path)
    return spark.table(name)


def _with_answers(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Blocks and what was answered to them."""
    for k, a in enumerate(answers):
        blocks = blocks.join(a.select("block", F.col("answers").alias(f"_{k}")), "block", "left")
    none = F.array().cast(answers[0].schema["answers"].dataType)
    names = [f"_{k}" for k in range(len(answers))]
    return blocks.withColumn("answers", F.concat(*[F.coalesce(k, none) for k in names])).drop(*names)


# ---------------------------------------------------------------- weights of contexts


def _magnitude(count: np.ndarray) -> np.ndarray:
    """Whole binary logarithm of counts, 0 for none."""
    return np.frexp(np.maximum(count, 1).astype(float))[1] - 1


def _log10(x: np.ndarray) -> np.ndarray:
    return np.log(x) * (1 / np.log(10))  # the natural logarithm is worked out several at a time


def _base(count: np.ndarray, n: int, v: int) -> np.ndarray:
    return (count + 0.5) / (n + 0.5 * (v + 1))


def _likelihoods(batches, n: int, v: int):
    """Sums of log p of training tokens, each left out of the counts, by level, magnitude of the context's count and weight.

    The level below is taken with equal weights.
    """
    schema = pa.schema([("level", pa.int32()), ("magnitude", pa.int32()), ("sums", pa.list_(pa.float64()))])
    sums: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for r in b.to_pylist():
            g = _Grams(r["words"], r["tokens"], r["learn"])
            g.answer(r["answers"])
            low = _base(g.total[0] - 1, n - 1, v)  # of each n-gram
            for level in range(1, len(g.total)):
                f = g.first(level)
                state, own_, times = g.total[level - 1][g.at[level - 1][f - 1]] - 1, g.total[level] - 1, g.learned(level)
                low = low[g.at[level - 1][f]]
                ml = np.maximum(own_, 0) / np.maximum(state, 1)
                there = np.flatnonzero((times > 0) & (state > 0))
                size = _magnitude(state[there]).astype(np.int8)
                order = np.argsort(size, kind="stable")
                sizes, cuts = np.unique(size[order], return_index=True)
                order = there[order]
                for m, pick in zip(sizes.tolist(), np.split(order, cuts[1:])):
                    seen = ml[pick] > 0  # others have the level below alone
                    one, rest = pick[seen], pick[~seen]
                    t, a, b = times[one].astype(float), ml[one], low[one]
                    p = np.array([t @ np.log(w * a + (1 - w) * b) for w in WEIGHTS])
                    p += (times[rest] * np.log(low[rest])).sum() + times[rest].sum() * np.log(1 - WEIGHTS)
                    sums[level, m] = sums.get((level, m), 0) + p
                low = np.where(own_ > 0, 0.5 * ml + 0.5 * low, low)
    rows = [{"level": k, "magnitude": m, "sums": x.tolist()} for (k, m), x in sums.items()]
    yield pa.RecordBatch.from_pylist(rows, schema=schema)
    give_back()


def _weights(asked: DataFrame, n: int, v: int, order: int) -> np.ndarray:
    """The best weight for each level and magnitude (order x CLASSES numbers come to the driver)."""
    found = asked.mapInArrow(partial(_likelihoods, n=n, v=v), "level int, magnitude int, sums array<double>")
    sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(len(WEIGHTS))]
    out = np.zeros((order, CLASSES))
    for r in found.groupBy("level", "magnitude").agg(*sums).collect():
        # sums are compared to nine digits, so that their order of addition can't decide
        out[r["level"], r["magnitude"]] = WEIGHTS[int(np.argmax([float(f"{r[f's{i}']:.9g}") for i in range(len(WEIGHTS))]))]
    return out


# ---------------------------------------------------------------- the automaton


class Automaton:
    """States and arcs that a block's texts can reach.

    State 0 is the root; states of longer contexts have higher numbers. The arc of a context of n words on a token is that of the n-gram of n + 1 words
    which the token ends, so a token has one arc number for each length of context; number 0 is no arc.
    """

    def __init__(self, g: _Grams, weights: np.ndarray, n: int, v: int):
        p = _base(g.total[0], n, v)
        end = np.searchsorted(g.keys[0], g.words[0])  # nothing follows it
        fail, fall, level_of = [np.zeros(1, np.int64)], [np.zeros(1)], [np.zeros(1, np.int64)]
        has, log, to = [np.zeros(1, bool)], [np.zeros(1)], [np.zeros(1, np.int64)]
        self.arc = np.zeros((len(g.total), len(g.tokens)), np.int64)
        states = arcs = 1
        for level, total in enumerate(g.total):
            f = g.first(level)
            if level:
                context, shorter = g.at[level - 1][f - 1], g.at[level - 1][f]
                count = g.total[level - 1][context]
                w = np.where(count > 0, weights[level][_magnitude(count)], 0)
                p = w * total / np.maximum(count, 1) + (1 - w) * p[shorter]
                has.append((total > 0) & (state[context] >= 0))
                suffix, down = lead[shorter], np.maximum(state[shorter], 0)
            else:
                has.append(np.ones(len(total), bool))  # the root has an arc for every word
                suffix = down = np.zeros(len(total), np.int64)
            state = np.full(len(total), -1)  # of each n-gram, -1 for none
            if level < len(g.total) - 1:
                some = (total >= (LEAST_CONTEXT if level else 1)) & (g.at[0][f] != end)
                state[some] = states + np.arange(some.sum())
                states += int(some.sum())
                fail.append(down[some])
                fall.append(_log10(1 - weights[level + 1][_magnitude(total[some])]))
                level_of.append(np.full(int(some.sum()), level + 1))
            lead = np.where(state >= 0, state, suffix)  # the longest state that ends the n-gram
            log.append(_log10(p))
            to.append(lead)
            self.arc[level] = np.where(g.at[level] >= 0, arcs + g.at[level], 0)
            arcs += len(total)
        self.fail, self.fall, self.level = np.concatenate(fail), np.concatenate(fall), np.concatenate(level_of)
        self.has, self.log, self.to = np.concatenate(has), np.concatenate(log), np.concatenate(to)

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of reading a token in each state, along failure arcs until one has an arc for it, and the states after it."""
        log, out = np.zeros(len(state)), np.empty(len(state), np.int64)
        left, s = np.arange(len(state)), state
        while len(left):
            k = self.arc[self.level[s], token[left]]
            hit = self.has[k]
            there, k = left[hit], k[hit]
            log[there] += self.log[k]
            out[there] = self.to[k]
            left, s = left[~hit], s[~hit]
            log[left] += self.fall[s]
            s = self.fail[s]
        return log, out

    def traverse(self, doc: np.ndarray, place: np.ndarray, docs: int, memory: int) -> np.ndarray:
        """Sum of weights over each document, read from left to right.

        Documents are read in stretches abreast; a walker starts so many words before its stretch as a state can remember, without counting them.
        """
        start = np.flatnonzero(place % STRETCH == 0)
        length = np.diff(np.append(start, len(place)))
        back = np.minimum(place[start], memory)
        order = np.argsort(-(length + back), kind="stable")
        start, length, back = start[order], length[order], back[order]
        state, score, reach = np.zeros(len(start), np.int64), np.zeros(len(start)), length + back
        for t in range(int(reach[0]) if len(reach) else 0):
            n = int(np.searchsorted(-reach, -t, "left"))  # walkers not at their end
            log, state[:n] = self.step(state[:n], start[:n] - back[:n] + t)
            score[:n] += log if t >= memory else np.where(t >= back[:n], log, 0)
        return np.bincount(doc[start], score, docs)


def _score(batches, key: pa.DataType, weights: np.ndarray, n: int, v: int):
    schema = pa.schema([("doc_id", key), ("learned", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    for b in batches:
        for r in b.to_pylist():
            g = _Grams(r["words"], r["tokens"], r["learn"])
            g.answer(r["answers"])
            rows = r["ids"]
            count = g.total[0][g.at[0]]
            a = Automaton(g, weights, n, v)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, key), pa.array(np.frombuffer(r["learn"], bool)), pa.array(np.bincount(g.doc, minlength=len(rows))), pa.array(np.bincount(g.doc, count > 0, len(rows)).astype(np.int64)),
                    pa.array(np.bincount(g.doc, _log10(_base(g.total[0], n, v))[g.at[0]], len(rows))), pa.array(a.traverse(g.doc, g.place, len(rows), len(g.total) - 1)),
                ],
                schema=schema,
            )
            del g, a
    give_back()


def score(docs: DataFrame, learn: Column, order: int = ORDER) -> DataFrame:
    """A row for each of docs (doc_id, text): doc_id, learned, n_tokens, n_known, train_tokens, base_score and score.

    The model is learned from the documents for which learn (of doc_id and text; null is false) holds, and scores all. Words are runs of characters
    outside [\\x20\\x09-\\x0D], A-Z lower-cased; each text ends with one end token, so null, empty and blank texts have just that one. Repeated rows
    are counted and scored each; an empty table gives an empty one; with nothing to learn from all words are unknown. Other columns of docs are
    not looked at. A document is held whole by one task, about 150 bytes a token, however long. Words and n-grams are told apart by 64-bit hashes.
    """
    if order < 2:
        raise ValueError("the automaton needs an order of two at least")
    bounded_batches(docs)
    d = own(docs, "doc_id", "text").withColumn("_learn", F.coalesce(learn, F.lit(False)))
    kind = docs.schema["doc_id"].dataType
    key = to_arrow_type(kind)
    told = d.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "_learn")
    blocks = _bucketed(told.mapInArrow(partial(_to_blocks, key=key), f"ids array<{kind.simpleString()}>, {_BLOCK}"), "blocks")
    size = blocks.agg(F.sum("n"), F.sum("trained")).first()
    n = int(size[1] or 0)
    buckets = max(1, -(-(size[0] or 0) // BUCKET_TOKENS))
    answers = [_totals(blocks, buckets, (0, 1))]
    drop_shuffles(docs.sparkSession)  # a round's questions are as large as its documents
    for level in range(2, order):
        answers.append(_totals(_with_answers(blocks, *answers), buckets, (level,)))
        drop_shuffles(docs.sparkSession)
    v = int(answers[0].agg(F.sum("distinct")).first()[0] or 0)
    asked = _with_answers(blocks, *answers)
    weights = _weights(asked, n, v, order)
    shape = f"doc_id {kind.simpleString()}, learned boolean, n_tokens long, n_known long, base_score double, score double"
    scored = asked.mapInArrow(partial(_score, key=key, weights=weights, n=n, v=v), shape)
    return scored.select("doc_id", "learned", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
