"""Language-model scores, conversation repair and periodic runs against brute force, and their edge cases."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotab.llm import conversation_repair as repair
from geotab.llm import lm_score, periodic_runs
from geotab.llm import queries as q

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# ---------------------------------------------------------------- 11: language-model scores


def brute_model(texts, learn, order):
    """The documents' tokens, and every probability from dictionaries of counts."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [WORD.findall((t or "").translate(low)) + [None] for t in texts]
    count = [Counter() for _ in range(order)]
    for d, use in zip(docs, learn):
        for n in range(order if use else 0):
            count[n].update(tuple(d[i - n : i + 1]) for i in range(n, len(d)))
    total, kinds = sum(count[0].values()), len(count[0])

    def base(c, n):
        return (c + 0.5) / (n + 0.5 * (kinds + 1))

    # weights: leave-one-out likelihood by level and magnitude of the context's count
    sums: dict = {}
    for d, use in zip(docs, learn):
        for i in range(len(d) if use else 0):
            p = base(count[0][(d[i],)] - 1, total - 1)
            for n in range(1, order):
                if i < n or n > 1 and count[n - 1][tuple(d[i - n : i])] < lm_score.LEAST_CONTEXT:
                    break
                c, h = count[n][tuple(d[i - n : i + 1])] - 1, count[n - 1][tuple(d[i - n : i])] - 1
                if h > 0:
                    s = sums.setdefault((n, h.bit_length() - 1), np.zeros(len(lm_score.WEIGHTS)))
                    s += np.log10(lm_score.WEIGHTS * c / h + (1 - lm_score.WEIGHTS) * p)
                    p = 0.5 * c / h + 0.5 * p if c > 0 else p
    weight = {k: lm_score.WEIGHTS[int(np.argmax([float(f"{x:.9g}") for x in s]))] for k, s in sums.items()}

    def prob(d, i, n):
        if n == 0:
            return base(count[0][(d[i],)], total)
        h, shorter = tuple(d[i - n : i]), prob(d, i, n - 1)
        if count[n - 1][h] < (1 if n == 1 else lm_score.LEAST_CONTEXT):
            return shorter
        w = weight.get((n, count[n - 1][h].bit_length() - 1), 0)
        return w * count[n][tuple(d[i - n : i + 1])] / count[n - 1][h] + (1 - w) * shorter

    return docs, count, total, base, prob


def brute_scores(texts, learn, order):
    docs, count, total, base, prob = brute_model(texts, learn, order)
    out = []
    for d in docs:
        known = sum(count[0][(w,)] > 0 for w in d)
        plain = sum(math.log10(base(count[0][(w,)], total)) for w in d)
        out.append((len(d), known, total, plain, sum(math.log10(prob(d, i, min(i, order - 1))) for i in range(len(d)))))
    return out


def test_probabilities_sum_to_one():
    """Over all known words, the end and one unknown word, after any context."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 9, int(rng.integers(1, 40)))) for _ in range(40)]
    docs, count, total, base, prob = brute_model(texts, [True] * len(texts), 3)
    known = [w for (w,) in count[0]]
    for d in docs[:9]:
        for i in range(len(d)):
            some = [*d[max(0, i - 2) : i]]
            assert sum(prob([*some, w], len(some), min(len(some), 2)) for w in [*known, "unknown"]) == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_match_brute_force(spark, monkeypatch, order):
    rng = np.random.default_rng(order)
    monkeypatch.setattr(lm_score, "BUCKET_TOKENS", 700)  # several buckets
    line = " ".join(f"w{k}" for k in rng.zipf(1.5, 700) % 60)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.4, int(rng.integers(1, 80))) % 90) for _ in range(80)]
    texts += [line, line.upper(), line, "", None, "  \t\n", "ein É é x É", texts[0], texts[0], "never seen these"]
    learn = [i % 5 != 1 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, i * 7) for i, t in enumerate(texts)], "doc_id long, text string, score long").repartition(3)
    got = {r["doc_id"]: r for r in lm_score.score(df, F.col("doc_id") % 5 != 1, order).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, (n, known, total, plain, full) in enumerate(brute_scores(texts, learn, order)):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["learned"]) == (n, known, total, learn[i])
        assert r["base_score"] == pytest.approx(plain, abs=1e-8) and r["score"] == pytest.approx(full, abs=1e-7)


def test_scores_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.score(df, F.lit(True)).collect() == []
    df = spark.createDataFrame([(1, "a b"), (None, "a"), (1, "a b")], "doc_id long, text string")
    got = lm_score.score(df, F.lit(False)).collect()
    assert [r["n_known"] for r in got] == [0, 0, 0] and {r["train_tokens"] for r in got} == {0}
    assert [r["score"] for r in got] == [r["base_score"] for r in got]


def test_held_out_scores_beat_the_base(spark):
    got = q.op11_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


# ---------------------------------------------------------------- 12: conversation structure repair


def brute_repair(rows):
    """All cheapest edit sequences by plain recursion over turns; the least of them."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()[:16], r[2].encode()))
    seen, turns, counts = set(), [], [0, 0, 0]
    for t, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
        if fault is not None:
            counts[fault] += 1
        seen.add((role, text))
        turns.append((role, text, fault))
    best = {}

    def go(i, state):
        if (i, state) in best:
            return best[i, state]
        ways = [(0, "", [])] if i == len(turns) and state in ("", "a") else []
        after = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[after]
        if i < len(turns):
            role, text, fault = turns[i]
            c, e, t = go(i + 1, state)
            ways.append((c + 3, "D" + e, t))
            if fault not in (0, 1):
                more = int(fault == 2)
                if role[:1] == after or role[:1] == "s" and state == "":
                    c, e, t = go(i + 1, role[:1])
                    ways.append((c + more, "K" + e, [f"{role}:{text}", *t]))
                c, e, t = go(i + 1, after)
                ways.append((c + 2 + more, "R" + e, [f"{name}:{text}", *t]))
        # at most two insertions in a row can be of use
        for k, chain in enumerate((after, after + ("u" if after == "a" else "a")), 1):
            if (i, state, k) not in best:
                best[i, state, k] = None
                c, e, t = plain(i, chain[-1])
                ways.append((c + 2 * k, "I" * k + e, [{"u": "user:", "a": "assistant:"}[x] for x in chain] + t))
        best[i, state] = min(ways, key=lambda w: w[:2])
        return best[i, state]

    def plain(i, state):
        """Without a first insertion."""
        ways = [(0, "", [])] if i == len(turns) and state in ("", "a") else [(1 << 40, "", [])]
        after = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[after]
        if i < len(turns):
            role, text, fault = turns[i]
            c, e, t = go(i + 1, state)
            ways.append((c + 3, "D" + e, t))
            if fault not in (0, 1):
                more = int(fault == 2)
                if role[:1] == after or role[:1] == "s" and state == "":
                    c, e, t = go(i + 1, role[:1])
                    ways.append((c + more, "K" + e, [f"{role}:{text}", *t]))
                c, e, t = go(i + 1, after)
                ways.append((c + 2 + more, "R" + e, [f"{name}:{text}", *t]))
        return min(ways, key=lambda w: w[:2])

    cost, audit, lines = go(0, "")
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed, many=120, longest=14):
    rng = np.random.default_rng(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["hello.", "well", "", None, " \t", "so?", "é!", "yes. "]
    out = []
    for c in range(many):
        for _ in range(int(rng.integers(1, longest))):
            turn = None if rng.random() < 0.05 else int(rng.integers(0, 20))
            role = roles[int(rng.choice(6, p=[0.4, 0.3, 0.1, 0.1, 0.05, 0.05]))]
            text = texts[int(rng.integers(0, 8))] if rng.random() < 0.4 else f"text {rng.integers(0, 99)}" + "." * int(rng.integers(0, 2))
            out.append((None if c == 7 else c, turn, role, text))
    return out


@pytest.mark.parametrize("rows_a_block", [1024, 3])
def test_repair_matches_brute_force(spark, monkeypatch, rows_a_block):
    rows = conversations(rows_a_block) + [(1000, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(300)]
    rows += [(1001, 5, "user", "same.")] * 50
    # workers import the module anew, so the size of blocks goes with the function
    work = repair._to_blocks

    def small(batches, key):
        repair.BLOCK_ROWS = rows_a_block
        return work(batches, key)

    monkeypatch.setattr(repair, "_to_blocks", small)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.summarise(df).collect()}
    by: dict = {}
    for c, *r in rows:
        by.setdefault(c, []).append(tuple(r))
    assert set(got) == set(by)
    for c, some in by.items():
        assert got[c] == brute_repair(some), c


def test_repaired_rows_are_legal_and_hash_to_the_digest(spark):
    df = spark.createDataFrame(conversations(5), "conv_id long, turn long, role string, text string")
    told = {r["conv_id"]: r for r in repair.summarise(df).collect()}
    lines: dict = {}
    for r in repair.repaired(df).where("edit <> 'D'").collect():
        lines.setdefault(r["conv_id"], []).append((r["number"], r["role"], r["text"]))
    for c, r in told.items():
        turns = sorted(lines.get(c, []))
        assert [t[0] for t in turns] == list(range(len(turns)))
        assert re.fullmatch("(s?(ua)+)?", "".join(t[1][:1] for t in turns))
        assert hashlib.sha256("\n".join(f"{a}:{b}" for _, a, b in turns).encode()).hexdigest() == r["repaired_sha256"]


def test_checkpoints_give_the_paths_of_full_vectors():
    rng = np.random.default_rng(0)
    for _ in range(60):
        codes = bytes(int(x) for x in rng.choice(16, int(rng.integers(1, 200))))
        v = [repair.END]
        for c in reversed(codes):
            v.append(repair.before(c, v[-1]))
        assert repair.through(repair.matrix(codes), repair.END) == v[-1]
        cost = state = 0
        for edit, i, to in repair.edits(codes, repair.END, 0, True):
            cost += {"D": 3, "I": 2, "K": 0, "R": 2}[edit] + (edit in "KR" and bool(codes[i] & 4))
            state = to
        assert cost == v[-1][0] and state in (0, 3)


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.summarise(df).collect() == [] and repair.damage_and_repair(df).collect() == []
    # a conversation whose only row is dropped stays, with zeros
    drop = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    df = spark.createDataFrame([(drop, 1, "user", "a.")], "conv_id long, turn long, role string, text string")
    assert tuple(repair.damage_and_repair(df).first()) == (drop, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# ---------------------------------------------------------------- 13: periodic runs


def brute_runs(w):
    out = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(6, 4 * p):
                out.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


def periodic_texts(seed, many):
    rng = np.random.default_rng(seed)
    for _ in range(many):
        w = []
        for _ in range(int(rng.integers(0, 6))):
            kinds = int(rng.choice([2, 3, 40]))
            if rng.random() < 0.4:
                w += list(rng.integers(0, kinds, int(rng.integers(0, 60))))
            else:
                p = list(rng.integers(0, kinds, int(rng.integers(1, rng.choice([4, 20, 90])))))
                x = p * int(rng.integers(1, 7))
                w += x[: max(1, len(x) - int(rng.integers(0, len(p))))]
        yield [("a", "É", "b c", "D")[k] if k < 4 else f"w{k}" for k in w]


def test_runs_match_brute_force(spark):
    lists = list(periodic_texts(1, 250)) + [["x"] * 5, ["x"] * 6, ["x", "y"] * 20_000 + ["z"]]
    gaps = [" ", "\n\t", "  "]
    texts = ["".join(w + gaps[i % 3] for i, w in enumerate(ws)) for ws in lists] + [None, "", " \n", None]
    lists += [[]] * 4
    df = spark.createDataFrame([(i, t, "kept", 1) for i, t in enumerate(texts)], "doc_id long, text string, runs string, n_runs int").repartition(3)
    for r in periodic_runs.detect(df).collect():
        w = lists[r["doc_id"]]
        want = [(0, 40_000, 2)] if len(w) > 9000 else brute_runs(w)
        assert [tuple(x) for x in r["runs"]] == want and r["n_runs"] == 1
        gone = {i for s, n, p in want for i in range(s + p, s + n)}
        assert r["collapsed"] == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_long_periods_are_found():
    rng = np.random.default_rng(2)
    for p in (16, 17, 32, 33, 500, 1024, 2049):
        base = rng.integers(0, 50, p)
        w = np.concatenate((rng.integers(0, 50, 777), np.tile(base, 4), rng.integers(60, 99, 300))).astype(np.uint64)
        found = periodic_runs.find_runs(periodic_runs.mix64(w), np.zeros(len(w), int))
        assert any(q_ == p and n >= 4 * p for _, n, q_ in found.tolist())


def test_planted_repeats(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in df.withColumn("new", periodic_runs.planted(F.col("doc_id"), F.col("text"))).collect():
        h, w = zlib.crc32(str(r["doc_id"]).encode()), r["text"].split()
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        assert r["new"].split() == w


def test_runs_of_nothing(spark):
    assert periodic_runs.digests(periodic_runs.detect(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
    df = spark.createDataFrame([(None, "a a a a a a")] * 2, "doc_id long, text string")
    got = periodic_runs.digests(periodic_runs.detect(df.select("doc_id", periodic_runs.planted(F.col("doc_id"), F.col("text")).alias("text")))).collect()
    assert [tuple(r)[1:6] for r in got] == [(1, 0, 6, 1, 6000)] * 2 and got[0]["collapsed_sha256"] == hashlib.sha256(b"a").hexdigest()


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_periodic_runs"])
def test_twin(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = c.execute(q.oracle_sql()[name])
    names = [d[0] for d in want.description]
    want = sorted(want.fetchall(), key=str)
    got = sorted((tuple(r) for r in q.queries()[name](spark, DATA).select(*names).collect()), key=str)
    assert got == want and len(got) >= 20
