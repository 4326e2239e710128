"""Repair of conversations: the cheapest edits that turn a sequence of turns into `(s?(ua)+)?`, by a checkpointed dynamic programme.

Costs to finish from each of four states (nothing yet, after system, after user, after assistant) are worked out from the last
turn to the first. Only the vectors at every sqrt(n)-th turn of a block are kept; the walk forward recomputes the vectors of one
stretch at a time and writes, at each place, the edit with the least letter among those that lie on a cheapest path.

Rows are dealt out by ranges of (conversation, turn, ...), so a conversation of any length is spread over tasks, and cut into blocks of at
most BLOCK_ROWS turns. A conversation in one block is done there. Of others each block yields its cost matrix (4 x 4, minimum and plus);
the matrices are folded from the last block to the first, which gives the vector behind each block, the outer checkpoints;
then blocks pass through one stream in order that carries state, counts and digest, with one block in memory. SHA-256 takes
a conversation's text in order, so that stream can't be split.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CRC_TABLE, bounded_batches, crc_of, cut, give_back, own

BLOCK_ROWS, BLOCK_BYTES = 1024, 4 << 20
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
BLANKS = " \t\n\x0b\x0c\r"

START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)  # after an inserted or reroled turn
_TAKES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_FAR = 1 << 60

# a turn as one number: initial (0 s, 1 u, 2 a, 3 other), 4 truncated, 8 must go
_INITIAL = {"s": 0, "u": 1, "a": 2}
_KEEP = tuple(tuple(_TAKES[s].get(r) for s in range(4)) for r in ("s", "u", "a", "other"))

Vector = tuple[int, int, int, int]


def _relax(v: list[int]) -> Vector:
    """v with turns inserted before it; two in a row bring a state back to itself."""
    u, a = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return min(v[START], INSERT + u), min(v[SYSTEM], INSERT + u), u, a


END = _relax([0, _FAR, _FAR, 0])


@lru_cache(1 << 16)
def _step(code: int, v: Vector) -> Vector:
    out = [DELETE + x for x in v]
    if not code & 8:
        more = TRUNCATED if code & 4 else 0
        for s in range(4):
            keep = _KEEP[code & 3][s]
            if keep is not None:
                out[s] = min(out[s], more + v[keep])
            out[s] = min(out[s], REROLE + more + v[_NEXT[s]])
    return _relax(out)


def before(code: int, v: Vector) -> Vector:
    """Costs before a turn from those behind it."""
    low = min(v)
    return tuple(x + low for x in _step(code, tuple(x - low for x in v)))


def matrix(codes: bytes) -> list[int]:
    """Costs through a block, from each state before it (rows) to each behind it (columns)."""
    columns = []
    for end in range(4):
        v = tuple(0 if s == end else _FAR for s in range(4))
        for c in reversed(codes):
            v = before(c, v)
        columns.append(v)
    return [columns[e][s] for s in range(4) for e in range(4)]


def through(m: list[int], v: Vector) -> Vector:
    return tuple(min(m[4 * s + e] + v[e] for e in range(4)) for s in range(4))


def edits(codes: bytes, behind: Vector, state: int, last: bool):
    """(edit, number of the turn or -1, state after it) along the ASCII-least cheapest path from state; the last block may close with insertions."""
    n = len(codes)
    size = isqrt(n) + 1
    marks, v = {}, behind
    for i in range(n, 0, -1):
        if i % size == 0 or i == n:
            marks[i] = v
        v = before(codes[i - 1], v)
    here = v
    for low in range(0, n, size):
        high = min(low + size, n)
        part = [marks[high]]
        for i in range(high, low, -1):
            part.append(before(codes[i - 1], part[-1]))
        part.reverse()
        for i in range(low, high):
            here, after, code = part[i - low], part[i - low + 1], codes[i]
            while here[state] != DELETE + after[state] and here[state] == INSERT + here[_NEXT[state]]:
                state = _NEXT[state]
                yield "I", -1, state
            if here[state] == DELETE + after[state]:
                yield "D", i, state
                continue
            keep, more = _KEEP[code & 3][state], TRUNCATED if code & 4 else 0
            if keep is not None and here[state] == more + after[keep]:
                state = keep
                yield "K", i, state
            else:
                state = _NEXT[state]
                yield "R", i, state
    while last and behind[state]:
        state = _NEXT[state]
        yield "I", -1, state


_ROLE = {USER: "user", ASSISTANT: "assistant"}

# ---------------------------------------------------------------- blocks


def sorted_rows(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) dealt out and sorted by conversation, turn, role and text; nulls in role and text are one space."""
    rows = own(rows, "conv_id", "turn", "role", "text")
    r = rows.select("conv_id", F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    r = r.withColumn("_t", F.substring(F.md5(F.col("text").cast("binary")), 1, 16))
    # equal rows are interchangeable, so a number of its own for each lets ranges part them
    order = ["conv_id", "turn", "role", "_t"]
    return r.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(*order, "_n").sortWithinPartitions(*order, "text").drop("_n", "_t")


def _to_blocks(batches, key: pa.DataType):
    """Consecutive rows of a conversation as one row; whole: the conversation has no other."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() << 32
    schema = pa.schema([("conv_id", key), ("ord", pa.int64()), ("whole", pa.bool_()), ("turns", pa.list_(pa.int64())), ("role", pa.list_(pa.string())), ("text", pa.list_(pa.string()))])
    ready: list[dict] = []
    held = 0  # bytes in ready
    block: dict | None = None
    first = True  # no other conversation before in this partition
    size = 0

    def batch():
        return pa.RecordBatch.from_pylist(ready, schema=schema)

    for b in batches:
        for conv, turn, role, text in zip(*[b.column(k).to_pylist() for k in range(4)]):
            same = block is not None and block["conv_id"] == conv
            if block is not None and (not same or len(block["turns"]) >= BLOCK_ROWS or size >= BLOCK_BYTES):
                if not same:
                    block["whole"] = block["whole"] and not first
                    first = False
                else:
                    block["whole"] = False
                ready.append(block)
                held += size
                if len(ready) >= 500 or held >= BLOCK_BYTES:
                    yield batch()
                    ready, held = [], 0
                part += 1
                block = {"conv_id": conv, "ord": part, "whole": not same, "turns": [], "role": [], "text": []}
                size = 0
            if block is None:
                block = {"conv_id": conv, "ord": part, "whole": True, "turns": [], "role": [], "text": []}
            block["turns"].append(turn)
            block["role"].append(role)
            block["text"].append(text)
            size += len(role) + len(text)
    if block is not None:  # the next partition may go on with it
        block["whole"] = False
        ready.append(block)
        yield batch()
    give_back()


def codes_of(roles: list[str], texts: list[str], firsts: set[int] | None = None) -> tuple[bytes, list[int]]:
    """Numbers of turns and [blank, duplicate, truncated]; firsts: turns whose role and text come first there, if that isn't decided by these turns alone."""
    seen: set = set()
    out, count = bytearray(len(roles)), [0, 0, 0]
    for i, (role, text) in enumerate(zip(roles, texts)):
        again = (role, text) in seen if firsts is None else i not in firsts
        if firsts is None:
            seen.add((role, text))
        body = text.rstrip(BLANKS)
        code = _INITIAL.get(role[:1], 3)
        if not body:
            count[0] += 1
            code |= 8
        elif again:
            count[1] += 1
            code |= 8
        elif body[-1] not in ".!?":
            count[2] += 1
            code |= 4
        out[i] = code
    return bytes(out), count


class _Walk:
    """What a stream carries through one conversation."""

    def __init__(self, conv):
        self.conv, self.counts, self.audit, self.sha = conv, [0, 0, 0], [], hashlib.sha256()
        self.state, self.cost, self.lines, self.initial, self.illegal, self.n = START, None, 0, None, 0, 0
        self.first_turn = self.last_turn = None
        self.distinct = 0

    def block(self, turns, roles, texts, codes: bytes, counts, behind: Vector, last: bool, rows: list | None = None) -> None:
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        self.n += len(turns)
        for t in turns:
            if t is not None and t != self.last_turn:
                self.first_turn = t if self.first_turn is None else self.first_turn
                self.last_turn = t
                self.distinct += 1
        for r in roles:
            if self.initial is not None and self.initial + r[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = r[:1]
        if self.cost is None:
            v = behind
            for c in reversed(codes):
                v = before(c, v)
            self.cost = v[START]
        for edit, i, state in edits(codes, behind, self.state, last):
            self.state = state
            self.audit.append(edit)
            role, text = (None, None) if edit == "D" else (_ROLE[state], "") if edit == "I" else (_ROLE[state], texts[i]) if edit == "R" else (roles[i], texts[i])
            if role is not None:
                if self.lines:
                    self.sha.update(b"\n")
                self.sha.update(f"{role}:{text}".encode())
                self.lines += 1
            if rows is not None:
                rows.append({"conv_id": self.conv, "number": self.lines - 1 if role is not None else None, "edit": edit, "turn": turns[i] if i >= 0 else None, "role": role, "text": text})

    def gaps(self) -> int:
        return self.last_turn - self.first_turn + 1 - self.distinct if self.distinct else 0

    def row(self) -> dict:
        blank, duplicate, truncated = self.counts
        return {
            "conv_id": self.conv, "gaps": self.gaps(), "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": self.illegal,
            "cost": self.cost or 0, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest(),
        }


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "number long, edit string, turn long, role string, text string"


def _schema(key: pa.DataType, rows: bool) -> pa.Schema:
    text = ("audit", "repaired_sha256", "edit", "role", "text")
    names = [x.split() for x in (ROWS if rows else SUMMARY).split(", ")]
    return pa.schema([("conv_id", key)] + [(n, pa.string() if n in text else pa.int64()) for n, _ in names])


def _walk(batches, key: pa.DataType, rows: bool):
    """Blocks in order, each with its codes and the vector behind it if it isn't the only one of its conversation."""
    schema = _schema(key, rows)
    walk: _Walk | None = None
    out: list[dict] = []
    held = 0
    aux = None
    for b in batches:
        for r in b.to_pylist():
            if r["codes"] is not None:  # comes just before its block
                aux = r
                continue
            if walk is not None and (walk.conv != r["conv_id"] or r["whole"]):
                if not rows:
                    out.append(walk.row())
                walk = None
            if walk is None:
                walk = _Walk(r["conv_id"])
            if r["whole"]:
                codes, counts = codes_of(r["role"], r["text"])
                behind, last = END, True
            else:
                codes, counts, behind, last = aux["codes"], aux["counts"], tuple(aux["behind"]), aux["last"]
            walk.block(r["turns"], r["role"], r["text"], codes, counts, behind, last, out if rows else None)
            held += sum(map(len, r["text"]))
            if len(out) >= 2000 or rows and held >= BLOCK_BYTES:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out, held = [], 0
    if walk is not None and not rows:
        out.append(walk.row())
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    give_back()


def _fold(batches, key: pa.DataType):
    """Matrices of a conversation's blocks, last first: the vector behind each."""
    schema = pa.schema([("conv_id", key), ("ord", pa.int64()), ("codes", pa.binary()), ("counts", pa.list_(pa.int64())), ("behind", pa.list_(pa.int64())), ("last", pa.bool_())])
    began, conv, v = False, None, END
    for b in batches:
        out = []
        for r in b.to_pylist():
            last = not began or r["conv_id"] != conv
            if last:
                began, conv, v = True, r["conv_id"], END
            out.append({"conv_id": conv, "ord": r["ord"], "codes": r["codes"], "counts": r["counts"], "behind": list(v), "last": last})
            v = through(r["matrix"], v)
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _coded(role: pa.Array, text: pa.Array, firsts: pa.Array) -> pa.Array:
    made = []
    for r, t, f in zip(role.to_pylist(), text.to_pylist(), firsts.to_pylist()):
        codes, counts = codes_of(r, t, set(f or []))
        made.append({"codes": codes, "counts": counts, "matrix": matrix(codes)})
    return pa.array(made, pa.struct([("codes", pa.binary()), ("counts", pa.list_(pa.int64())), ("matrix", pa.list_(pa.int64()))]))


def _first_turns(blocks: DataFrame) -> DataFrame:
    """(ord, firsts): numbers of a block's turns whose role and text no earlier turn of the conversation has."""
    turn = blocks.select("conv_id", "ord", F.posexplode(F.arrays_zip("role", "text")).alias("i", "_r"))
    key = F.md5(F.concat(F.length("_r.role").cast("string"), F.lit(":"), F.col("_r.role"), F.col("_r.text")).cast("binary"))
    low = turn.groupBy("conv_id", key.alias("k")).agg(F.min(F.struct("ord", "i")).alias("f"))
    return low.groupBy("f.ord").agg(F.collect_list("f.i").alias("firsts"))


def _walked(rows: DataFrame, each_row: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(rows)
    kind = rows.schema["conv_id"].dataType
    key, name = to_arrow_type(kind), kind.simpleString()
    blocks = cut(sorted_rows(rows).mapInArrow(lambda it: _to_blocks(it, key), f"conv_id {name}, ord long, whole boolean, turns array<long>, role array<string>, text array<string>"), "blocks")
    parts = blocks.where("not whole")
    coded = F.arrow_udf(_coded, "codes binary, counts array<long>, matrix array<long>")
    coded = parts.join(_first_turns(parts), "ord", "left").withColumn("_c", coded("role", "text", "firsts")).select("conv_id", "ord", "_c.*")
    folded = coded.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("ord")).mapInArrow(
        lambda it: _fold(it, key), f"conv_id {name}, ord long, codes binary, counts array<long>, behind array<long>, last boolean"
    )
    folded = cut(folded, "folded")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    body = ["turns array<long>", "role array<string>", "text array<string>"]
    side = ["codes binary", "counts array<long>", "behind array<long>", "last boolean"]
    with_side = lambda df: df.select("conv_id", "ord", F.lit(1).alias("kind"), "whole", "turns", "role", "text", *[none(*c.split()) for c in side])
    vectors = folded.select("conv_id", "ord", F.lit(0).alias("kind"), F.lit(False).alias("whole"), *[none(*c.split()) for c in body], "codes", "counts", "behind", "last")
    stream = with_side(parts).union(vectors).repartition("conv_id").sortWithinPartitions("conv_id", "ord", "kind")
    shape = f"conv_id {name}, {ROWS if each_row else SUMMARY}"
    go = lambda it: _walk(it, key, each_row)
    return with_side(blocks.where("whole")).mapInArrow(go, shape).union(stream.mapInArrow(go, shape))


def summarise(rows: DataFrame) -> DataFrame:
    """One row for each conversation of rows (conv_id, turn, role, text): gaps, faults, cost, edits and the digest of the repaired text.

    Turns go by turn (nulls first), then role and text. A turn's first fault counts: blank, duplicate (role and text seen
    earlier), truncated. Null roles and texts are one space, so such texts are blank; a null conv_id is a conversation of its own. gaps ignores
    null turns. Repeated rows are duplicates. An empty table gives an empty one; other columns of rows are not looked at.
    """
    return _walked(rows, False)


def repaired(rows: DataFrame) -> DataFrame:
    """Every edit in order of conversation: number of the repaired turn (null for deleted ones), edit, original turn, role and text."""
    return _walked(rows, True)


# ---------------------------------------------------------------- the query's damage and its twin


def damaged(rows: DataFrame) -> DataFrame:
    """rows with faults, by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties it, 2 takes its full stops, 3 repeats it, 4 makes it the user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    d = own(rows, "conv_id", "turn", "role", "text").withColumn("_h", h).where("_h <> 0")
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    times = F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.select("conv_id", "turn", F.when(F.col("_h") == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.explode(times)).drop("col")


def damage_and_repair(rows: DataFrame) -> DataFrame:
    """summarise over the damaged rows, with every conversation of rows."""
    done = summarise(damaged(rows)).withColumnRenamed("conv_id", "_c")
    all_ = own(rows, "conv_id").distinct()
    out = all_.join(done, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    nothing = hashlib.sha256(b"").hexdigest()
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def _cell(cost: str, edit: str, line: str, of: str) -> str:
    """A way to finish: cost, edits, repaired lines, from the way `of` behind it."""
    lines = f"{of}.t" if line == "NULL" else f"list_prepend({line}, {of}.t)"
    return f"{{'c': {of}.c + {cost}, 'e': '{edit}' || {of}.e, 't': {lines}}}"


def _twin() -> str:
    """The plain dynamic programme from the last turn to the first, each state's whole best way as a value; ways compare by cost, then edits."""
    insert = lambda role, v: _cell("2", "I", f"'{role}:'", v)
    x = {}
    for s, takes, role in (("n", {"s": "s", "u": "u"}, "user"), ("s", {"u": "u"}, "user"), ("u", {"a": "a"}, "assistant"), ("a", {"u": "u"}, "user")):
        ways = [_cell("3", "D", "NULL", f"w.{s}")]
        ways += [f"CASE WHEN NOT gone AND i0 = '{r}' THEN {_cell('cutoff', 'K', 'line', 'w.' + to)} END" for r, to in takes.items()]
        to = "a" if role == "assistant" else "u"
        ways.append(f"CASE WHEN NOT gone THEN {_cell('2 + cutoff', 'R', chr(39) + role + ':' + chr(39) + ' || text', 'w.' + to)} END")
        x[s] = f"least({', '.join(ways)})"
    u, a, begin = f"least(x.u, {insert('assistant', 'x.a')})", f"least(x.a, {insert('user', 'x.u')})", insert("user", "y.u")
    return rf"""
WITH RECURSIVE crc AS (SELECT {CRC_TABLE} AS tbl FROM range(256) t_(x)),
said AS (SELECT *, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t, {crc_of("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS h FROM conversations, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE r END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS k FROM said WHERE h <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(md5(text), 16), text) AS i FROM hurt),
turns AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, left(role, 1) AS i0, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM placed),
told AS (SELECT *, body = '' AS blank, body <> '' AND nth > 1 AS duplicate, body <> '' AND nth = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS truncated, concat(role, ':', text) AS line,
 lag(i0) OVER (PARTITION BY conv_id ORDER BY i) AS i1 FROM turns),
ways AS (SELECT conv_id, n AS i, {{'n': {{'c': 0, 'e': '', 't': CAST([] AS VARCHAR[])}}, 's': {{'c': 4, 'e': 'II', 't': ['user:', 'assistant:']}}, 'u': {{'c': 2, 'e': 'I', 't': ['assistant:']}}, 'a': {{'c': 0, 'e': '', 't': CAST([] AS VARCHAR[])}}}} AS w
 FROM told WHERE i = n
 UNION ALL SELECT conv_id, i, {{'n': least(x.n, {begin}), 's': least(x.s, {begin}), 'u': y.u, 'a': y.a}} FROM
 (SELECT conv_id, i, x, {{'u': {u}, 'a': {a}}} AS y FROM (SELECT t.conv_id, t.i - 1 AS i, {{'n': {x['n']}, 's': {x['s']}, 'u': {x['u']}, 'a': {x['a']}}} AS x
 FROM ways JOIN (SELECT conv_id, i, role, text, line, i0, blank OR duplicate AS gone, CAST(truncated AS INTEGER) AS cutoff FROM told) t ON t.conv_id IS NOT DISTINCT FROM ways.conv_id AND t.i = ways.i) q) p),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
 count(*) FILTER (i > 1 AND concat(i1, i0) NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id)
SELECT a.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal,
 CAST(coalesce(w.w.n.c, 0) AS BIGINT) AS cost, coalesce(w.w.n.e, '') AS audit, sha256(coalesce(array_to_string(w.w.n.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN (SELECT * FROM ways WHERE i = 0) w ON w.conv_id IS NOT DISTINCT FROM a.conv_id
"""


ORACLE = _twin()
