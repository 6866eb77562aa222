"""Ids by remembered chunks are those of the tokenizer itself."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from watchkeep.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    "word", "Word,", "WORD.", "it's", "'S", "don't,", "a.b", "1,234", ",", ".", "..", "É", "é", "́", "ß", "İ", "Σας", "漢字", "ไทย",
    "🙂", "🙂.", "x" * 3000, "<|", "|>", "<|endoftext|>", "a<|endoftext|>b", "<|ENDOFTEXT|>", "</w>", " ", " ", "　", "K", "\x00", "\x1c"]


def encoded(work, texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)]).astype(np.int64)
    return [np.frombuffer(x, "<u4").tolist() for x in work.ids(np.frombuffer(b"".join(raw), np.uint8), offsets)]


@pytest.mark.parametrize("most", [3, 50, 1 << 12])
def test_ids_equal_the_library(monkeypatch, most):
    monkeypatch.setattr(packing, "REMEMBERED", most)
    work, library, rng = packing.Encoder(PATH), Tokenizer.from_file(PATH), random.Random(most)
    for _ in range(6):
        texts = ["", " ", "\n\t"] + [
            "".join(rng.choice(PARTS) + rng.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", ""]) for _ in range(rng.randint(0, 25)))
            for _ in range(40)]
        assert encoded(work, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert work.known.count <= most
    assert encoded(work, []) == []


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError):
        packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.Encoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer
