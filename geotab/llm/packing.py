"""Hierarchical multi-length packing of tokenised documents.

Every document becomes token ids plus an end id. It is routed by length: each full window of the
longest tier is a sequence of its own; the rest goes to the smallest tier that holds it. Tiers are
packed from the longest to the shortest: each rest opens a window of its tier, the gap is filled with
the largest rests of shorter tiers that fit, and what then stays open is closed by cutting a rest
to the size of the gap. Windows are powers of two, so no window needs padding; the last open window
of a shard is split into windows of powers of two. Sequences of a tier are then dealt to step
groups so that the groups hold equally many sequences and about equally many pieces.

Rests are packed in shards of about SHARD documents by a hash of the row, so memory is bounded by
SHARD times the longest tier whatever the number, length, or source of the documents.

Defined cases: null or empty text is a document of the end id alone; repeated rows are packed as
often as they occur; an empty table gives no pieces; further columns are ignored. Strings of
special tokens in a text become those tokens, as in the tokenizer's plain call.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, give_back, mix64, own

TIERS = (2048, 1024, 512, 256)
SHARD = 2048
STEP = 64
END = 1
#: Words cached at most within a task (some 200 bytes a word); its end gives the memory back to later stages.
CACHE = 200_000
#: Pieces of words cached at most within a task; words with other marks around them share theirs, and they outlive the words.
PARTS = 250_000
#: Bytes of text, or else a single document, that are tokenised at once.
TEXTS = 1 << 20

# Fixed value: how the word tokenizer splits normalised text.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same pattern, and the space between words, for lower-cased words of _PLAIN characters.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ ]+| ")
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"


class Known:
    """Strings with their ids, held in a row."""

    def __init__(self, kind: np.dtype):
        self.number, self.flat, self.used = {}, np.empty(1 << 16, kind), 0
        self.start, self.size = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32)

    def find(self, strings: list[str], most: int) -> tuple[np.ndarray, list[str]]:
        """Number of each of these distinct strings, and those that are new and are to be added next; of more than most, all but these are forgotten."""
        if len(self.number) + len(strings) > most:
            self.__init__(self.flat.dtype)
        n = np.fromiter(map(self.number.get, strings, repeat(-1)), np.int64, len(strings))
        new = np.flatnonzero(n < 0)
        n[new] = len(self.number) + np.arange(len(new))
        return n, [strings[i] for i in new.tolist()]

    def add(self, strings: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.number)
        self.number.update(zip(strings, range(first, first + len(strings))))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while first + len(sizes) > len(self.start):
            self.start, self.size = (np.concatenate((x, np.empty_like(x))) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[first : first + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + len(sizes)] = sizes
        self.used += len(ids)

    def ids(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the strings of these numbers in a row, and where those of each end."""
        return gather(self.flat, self.start, self.size, chosen)


class Tokens:
    """Ids of texts by the tokenizer of a file.

    Where the file splits text by _SPLIT, spaces and line feeds end words, and each distinct word of a batch is
    looked up once in a cache. Words without ids yet are split into pieces, and each distinct piece that isn't cached
    goes through the file's BPE alone, as normalising and splitting is done by then; words of other letters
    than _PLAIN, or with special tokens, go through the whole tokenizer. For other files all texts do.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.bpe = Tokenizer(self.tok.model)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2") if max(vocab.values()) < 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.by_word = self._splits(json.loads(self.tok.to_str()))
        self.bpe.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.clear()

    @staticmethod
    def _splits(file: dict) -> bool:
        """Whether the file lower-cases, splits by _SPLIT into bytes and marks the ends of words."""
        steps = (file["pre_tokenizer"] or {}).get("pretokenizers", [])
        kinds = [s["type"] for s in (file["normalizer"] or {}).get("normalizers", [])]
        same = [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": _SPLIT} and steps[0]["invert"]
        return bool(same and kinds == ["NFC", "Replace", "Lowercase"] and file["model"].get("end_of_word_suffix") == "</w>")

    def clear(self):
        self.words, self.pieces = Known(self.kind), Known(self.kind)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row and their number in each, by the plain call."""
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), self.kind), np.array([len(x) for x in ids], np.int32)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in a row and their number in each."""
        runs = [" ".join(pieces[at : at + 1000]) for at in range(0, len(pieces), 1000)]
        ids = [np.array(e.ids, self.kind) for e in self.bpe.encode_batch_fast(runs, add_special_tokens=False)]
        ids = np.concatenate(ids) if ids else np.empty(0, self.kind)
        sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1).astype(np.int32)
        if len(sizes) != len(pieces) or sizes.sum() != len(ids):
            raise ValueError("the tokenizer does not mark the ends of words")
        return ids, sizes

    def _plain(self, words: pa.Array) -> np.ndarray:
        """Which words have only _PLAIN characters and no special token."""
        plain = pc.match_substring_regex(words, _PLAIN)
        for token in self.special:
            plain = pc.and_not(plain, pc.match_substring(words, token))
        return plain.to_numpy(zero_copy_only=False)

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 100_000):
            part = new[at : at + 100_000]
            words = pa.array(part, pa.string())
            plain = self._plain(words)
            found = _PIECE.findall(" ".join(words.filter(pa.array(plain)).to_numpy(zero_copy_only=False)).lower())
            coded = pa.array(found, pa.string()).dictionary_encode()
            pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            piece = coded.indices.to_numpy()
            space = pieces.index(" ") if " " in pieces else -1
            # each word's first and last piece, spaces aside
            gap = np.flatnonzero(piece == space)
            piece = piece[piece != space]
            edge = np.concatenate(([0], gap - np.arange(len(gap)), [len(piece)] if plain.any() else []))
            if space >= 0:
                del pieces[space]
                piece = piece - (piece > space)
            n, more = self.pieces.find(pieces, PARTS)
            self.pieces.add(more, *self._pieces(more))
            ids, to = self.pieces.ids(n[piece])
            ends = np.concatenate(([0], to))[edge.astype(np.int64)]
            odd_ids, odd_sizes = self._whole(words.filter(pa.array(~plain)).to_numpy(zero_copy_only=False).tolist())
            sizes, begin = np.empty(len(part), np.int32), np.empty(len(part), np.int64)
            sizes[plain], sizes[~plain] = np.diff(ends), odd_sizes
            begin[plain], begin[~plain] = ends[:-1], len(ids) + np.cumsum(odd_sizes) - odd_sizes
            ids, _ = gather(np.concatenate((ids, odd_ids)), begin, sizes, np.arange(len(part)))
            self.words.add(part, ids, sizes)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where those of each text begin, with the end of the last."""
        texts = texts.cast(pa.string()).fill_null("")
        if not self.by_word:
            ids, sizes = self._whole(texts.to_pylist())
            return ids, np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        n, new = self.words.find(distinct, CACHE)
        self._learn(new)
        ids, to = self.words.ids(n[coded.indices.to_numpy()])
        return ids, np.concatenate(([0], to))[words.offsets.to_numpy() - words.offsets[0].as_py()]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[start : start + size] of the chosen in a row, and where each ends."""
    size, start = size[chosen], start[chosen]
    to = np.cumsum(size, dtype=np.int64)
    at = np.repeat(start - to + size, size)
    at += np.arange(len(at))
    return flat[at], to


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_ROUTED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, tier int, step_group long, shard long, ids binary"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _route(batches, path: str, top: int, shards: int):
    """Full windows as finished pieces, the rest of each document with its shard and ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the threads of a pool would each hold memory
    tok, task, made, row = tokens(path), TaskContext.get().partitionId(), 0, 0
    give_back()  # what reading the file took
    for batch in batches:
        docs, texts = batch.column("doc_id"), batch.column("text")
        length = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(length, (length[at - 1] if at else 0) + TEXTS, "right")))
            doc = docs.slice(at, to - at)
            ids, begin = tok.encode_all(texts.slice(at, to - at))
            ids = np.insert(ids, begin[1:], tok.kind.type(END)).astype("<u4")
            begin = begin + np.arange(len(begin))
            total = np.diff(begin)
            full, rest = total // top, total % top
            of = np.repeat(np.arange(len(doc)), full)
            start = top * (np.arange(len(of)) - np.repeat(np.cumsum(full) - full, full))
            crc = [zlib.crc32(ids[p : p + top]) for p in (begin[of] + start).tolist()]
            sequence = np.arange(made, made + len(of))
            group = (task << 30) + sequence // STEP
            made += len(of)
            if len(of):
                yield _some(doc_id=doc.take(pa.array(of)), start=start, length=np.full(len(of), top), ids_crc32=crc, doc_tokens=total[of], sequence_id=(task << 36) + sequence, tier=np.full(len(of), top), step_group=group)
            of = np.flatnonzero(rest)
            kept, ends = gather(ids.astype(tok.kind), begin[:-1] + full * top, rest, of)
            ends = np.concatenate(([0], ends * tok.kind.itemsize)).astype(np.int32)
            held = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
            where = (mix64((row + of).astype(np.uint64) + np.uint64(task << 36)) % np.uint64(shards)).astype(np.int64)
            yield _some(doc_id=doc.take(pa.array(of)), start=(full * top)[of], length=rest[of], doc_tokens=total[of], shard=where, ids=held)
            row += len(doc)
            at = to
    tok.clear()
    give_back()


def _some(**columns) -> pa.RecordBatch:
    """A batch of routed rows, nulls in the columns not given."""
    schema = _routed()
    rows = len(columns["doc_id"])
    return pa.RecordBatch.from_arrays([pa.array(columns[t.name], t.type) if t.name in columns else pa.nulls(rows, t.type) for t in schema], schema=schema)


def _routed() -> pa.Schema:
    i = pa.int64()
    return pa.schema([("doc_id", i), ("start", i), ("length", i), ("ids_crc32", i), ("doc_tokens", i), ("sequence_id", i), ("tier", pa.int32()), ("step_group", i), ("shard", i), ("ids", pa.binary())])


def _pieces() -> pa.Schema:
    i = pa.int64()
    return pa.schema([("doc_id", i), ("start", i), ("length", i), ("ids_crc32", i), ("doc_tokens", i), ("sequence_id", i), ("offset", i), ("tier", pa.int32()), ("step_group", i)])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def plan(lengths: list[int], tiers=TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (tier, [(document, start, length)]) that hold documents of these lengths exactly.

    lengths: at most the longest tier each. A document may be cut; its parts tile it.
    """
    pool = sorted((n, i, 0) for i, n in enumerate(lengths) if n)  # (length, document, start)
    windows = []
    tiers = sorted(tiers, reverse=True)
    for tier, below in zip(tiers, [*tiers[1:], 0]):
        while pool:
            if pool[-1][0] <= below:
                break
            n, i, s = pool.pop()
            window, gap = [(i, s, n)], tier - n
            while gap and pool:
                at = bisect.bisect_right(pool, (gap, len(lengths), 0)) - 1
                if at >= 0:
                    n, i, s = pool.pop(at)
                else:  # cut the smallest to the size of the gap
                    n, i, s = pool.pop(0)
                    bisect.insort(pool, (n - gap, i, s + gap))
                    n = gap
                window.append((i, s, n))
                gap -= n
            if gap:
                windows += _halves(window, tier - gap)
            else:
                windows.append((tier, window))
    return windows


def _halves(window, total):
    """The last, open window as windows of powers of two."""
    out, left = [], list(window)
    bit = 1 << (total.bit_length() - 1)
    while bit:
        if total & bit:
            part, room = [], bit
            while room:
                i, s, n = left.pop(0)
                if n > room:
                    left.insert(0, (i, s + room, n - room))
                    n = room
                part.append((i, s, n))
                room -= n
            out.append((bit, part))
        bit >>= 1
    return out


def _pack(table: pa.Table, kind: str, tiers) -> pa.Table:
    table = table.sort_by([("doc_id", "ascending"), ("doc_tokens", "ascending"), ("start", "ascending"), ("ids", "ascending")])
    ids = [np.frombuffer(x.as_buffer(), kind) for x in table.column("ids").combine_chunks()]
    doc, start, total = (table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
    shard = table.column("shard")[0].as_py()
    windows = plan([len(x) for x in ids], tiers)
    # groups of a tier take turns, first forwards, then backwards, over windows with most pieces first
    group: dict[int, tuple[int, int]] = {}
    by_tier: dict[int, list[int]] = {}
    for w, (tier, _) in enumerate(windows):
        by_tier.setdefault(tier, []).append(w)
    for tier, ws in by_tier.items():
        ws.sort(key=lambda w: (-len(windows[w][1]), w))
        groups = max(1, -(-len(ws) // STEP))
        for k, w in enumerate(ws):
            turn = k % (2 * groups)
            group[w] = (1 << 62) + (shard << 24) + (tier.bit_length() << 16) + min(turn, 2 * groups - 1 - turn)
    rows = []
    for w, (tier, window) in enumerate(windows):
        offset = 0
        for i, s, n in window:
            rows.append((doc[i], start[i] + s, n, _crc(ids[i][s : s + n]), total[i], (1 << 62) + (shard << 24) + w, offset, tier, group[w]))
            offset += n
    return pa.Table.from_batches([_batch(rows, _pieces())])


def pack(docs: DataFrame, tokenizer: str, tiers=TIERS, shard_docs: int = SHARD) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    tier (tokens of the sequence's window), step_group.

    tokenizer is the path of a tokenizers file whose vocabulary marks word ends with </w>.
    """
    tiers = tuple(sorted(tiers, reverse=True))
    if any(t & (t - 1) or t < 2 for t in tiers):
        raise ValueError("tiers must be powers of two")
    docs = own(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bounded_batches(docs)
    shards = max(1, -(-docs.count() // shard_docs))
    kind = "<u2" if tokens(tokenizer).kind.itemsize == 2 else "<u4"
    tokens.cache_clear()
    top = tiers[0]
    routed = cut(docs.mapInArrow(lambda it: _route(it, tokenizer, top, shards), _ROUTED), "routed")
    full = routed.where("sequence_id is not null").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), "tier", "step_group"
    )
    rest = routed.where("sequence_id is null").select("doc_id", "start", "doc_tokens", "shard", "ids")
    packed = rest.groupBy("shard").applyInArrow(lambda t: _pack(t, kind, tiers), PIECES)
    return full.unionByName(packed)
