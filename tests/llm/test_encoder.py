"""Ids of whole texts, also where pieces share a hash and for files that look across white space."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from data import documents
from tokenizers import Tokenizer

from gridwise.llm import token_output
from gridwise.llm.common import Words, passes, strings

TEXTS = [t or "" for _, t in documents(4, 40)] + ["café ﬁ ΑΣ a\x1cb \u00a0x don't 12ab FOO<|endoftext|>. ʼN", "", "e\u0301 \u0301a"]


def ids_of(encoder, texts):
    out = []
    for _, _, data, off in passes(strings(pa.array(texts)), 1 << 12):
        ids, counts = encoder.encode(data, off, 1)
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


@pytest.mark.parametrize("name,pieces", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_ids_are_those_of_whole_texts(name, pieces):
    path = public_tokenizers.path(name)
    encoder = token_output.Encoder(path)
    assert encoder.by_pieces == pieces
    plain = Tokenizer.from_file(path)
    assert ids_of(encoder, TEXTS) == [plain.encode(t, add_special_tokens=False).ids + [1] for t in TEXTS]


@pytest.mark.parametrize("bits", [0, 3, 6])
def test_pieces_of_one_hash_are_told_apart(monkeypatch, bits):
    path = public_tokenizers.path("word_bpe_49k.json")
    hashes = Words.hashes
    monkeypatch.setattr(Words, "hashes", lambda self, lower=False: hashes(self, lower) & np.uint64((1 << bits) - 1))
    plain = Tokenizer.from_file(path)
    assert ids_of(token_output.Encoder(path), TEXTS) == [plain.encode(t, add_special_tokens=False).ids + [1] for t in TEXTS]
