"""A case of op5 in the findings of round 3."""

import pyarrow as pa
import pytest

from geotab.llm import packing, queries

pytest.importorskip("public_tokenizers")


def test_a_piece_is_encoded_once_whatever_words_hold_it(monkeypatch):
    asked = []
    plain = packing.Tokens._pieces
    monkeypatch.setattr(packing.Tokens, "_pieces", lambda self, pieces: (asked.extend(pieces), plain(self, pieces))[1])
    t = packing.Tokens(queries.tokenizer())
    texts = ["deep water", "deep, water!", "(deep) WATER; deep-water"]
    got = [t.encode_all(pa.array([s]))[0].tolist() for s in texts]
    assert asked.count("deep") == asked.count("water") == 1
    assert got == [t.tok.encode(s, add_special_tokens=False).ids for s in texts]


def test_full_caches_start_anew(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 3)
    monkeypatch.setattr(packing, "PARTS", 3)
    t = packing.Tokens(queries.tokenizer())
    for s in ["one two", "two, three one", "four five! six seven one", "one"]:
        assert t.encode(s).tolist() == t.tok.encode(s, add_special_tokens=False).ids
