"""The encoder of token files against the library, and how often it asks the library."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.llm import pieces, token_files

LIBRARY = pieces.load()
ENCODER = token_files.Encoder(pieces.default_path(), 40)  # forgets again and again
SINGLE = token_files.Encoder(pieces.default_path())
SINGLE.mark = None  # as for a vocabulary in which no byte is free

PARTS = [" ", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "᠎", "a", "the", "Straße", "ÿ", "þ", "'s", "'", "12", "***", ".\nDe", "漢", "я", "\0", "<|endoftext|>", "Ġ"]


def same(encoder, texts):
    got = encoder(texts)
    assert all(ids.dtype == np.uint32 for ids in got)
    assert [ids.tolist() for ids in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=6))
def test_encoder_gives_the_ids_of_the_library(texts):
    same(ENCODER, texts)
    same(SINGLE, texts)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\x1c\x85\xa0᠎ 　ab", max_size=8))
def test_runs_of_white_space(text):
    assert pieces.has_runs(text) == bool(re.search(r" [\s᠎]|[\s᠎] ", text))


class Counting:
    def __init__(self, library):
        self.library, self.calls = library, 0

    def encode_batch_fast(self, *args, **options):
        self.calls += 1
        return self.library.encode_batch_fast(*args, **options)


def test_new_chunks_go_to_the_model_together():
    """Texts of chunks never seen before: one call for many of them, not one for each."""
    draw = random.Random(7)
    word = lambda: "".join(draw.choices("etaonö", k=9)) + draw.choice(["", ",", ".\nSo", "***"])
    texts = [" ".join(word() for _ in range(400)) for _ in range(20)]
    encoder = token_files.Encoder(pieces.default_path())
    encoder.bare = Counting(encoder.bare)
    same(encoder, texts)
    assert 0 < encoder.bare.calls < 100
    before = encoder.bare.calls
    same(encoder, texts[::-1])
    assert encoder.bare.calls == before


@pytest.mark.parametrize("size", [1, 10, 1000])
def test_texts_are_taken_together_up_to_a_size(size):
    rows = [(k, "x" * (k % 7)) for k in range(50)] + [(50, "y" * 30), (51, "")]
    got = list(token_files.together(iter(rows), size))
    assert [row for part in got for row in part] == rows
    assert all(part and (len(part) == 1 or sum(len(t) for _, t in part) <= size) for part in got)
