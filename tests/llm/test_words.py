"""op 9: words are cut and looked up in arrays, and are those of the tokenizer."""

import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

from glossarium.llm import packing
from glossarium.llm.queries import tokenizer_path

PARTS = ["'s", "'re", "'ll", "'v", "'", "''", "s", "t", "d1", "ve ", "l", "é", "ÀÖ", "ſ", "²", "¼7", "12", " ", "\n", "\t", "\r", ".", "!'s", "-", "_", "¡", "÷", "<", "|", "abcdefghijklmnopqrstuvwxyz", "Ÿ", "ı"]


@pytest.fixture(scope="module")
def definition():
    with open(tokenizer_path(), encoding="utf-8") as f:
        return f.read()


def _texts():
    draw = random.Random(5)
    return ["'", "'s", "'r", "'re", "it's", "it's's 'reé 've'll'", "a’s", "<|", "", "é", "²²"] + ["".join(draw.choice(PARTS) for _ in range(draw.randrange(40))) for _ in range(3000)]


def test_spans_are_the_matches_of_the_pattern(definition):
    kinds = packing.WordEncoder(definition).kinds
    for t in _texts():
        if re.fullmatch(packing.PLAIN, t):
            low = t.lower()
            raw = np.frombuffer(f"\n{low}\n".encode(), np.uint8)
            start, inside = packing.spans(raw, kinds)
            assert inside[start].all()
            got = [bytes(raw[a:b][inside[a:b]]).decode() for a, b in zip(start, np.append(start, len(raw))[1:], strict=True)]
            assert got == re.findall(packing.WORDS, low), t


def test_ids_are_those_of_the_tokenizer(definition):
    own, plain, texts = packing.WordEncoder(definition), Tokenizer.from_str(definition), _texts()
    for some in (texts, texts[:1], texts[100:90:-1], ["", ""]):
        ids, counts = own.encode(some)
        want = [plain.encode(t, add_special_tokens=False).ids for t in some]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_a_word_is_looked_up_once_a_call(definition):
    class Counted(dict):
        n = 0

        def get(self, *a):
            self.n += 1
            return super().get(*a)

        def __getitem__(self, k):
            self.n += 1
            return super().__getitem__(k)

        def __missing__(self, k):  # as the words' numbers were given before
            self[k] = len(self)
            self.new.append(k)
            return self[k]

        new: list = []

    own = packing.WordEncoder(definition)
    own.codes = Counted()
    ids, counts = own.encode(["some words " * 500, "some other words " * 500])
    assert own.codes.n <= 9 and counts.tolist() == [len(Tokenizer.from_str(definition).encode(t, add_special_tokens=False).ids) for t in ("some words " * 500, "some other words " * 500)]
