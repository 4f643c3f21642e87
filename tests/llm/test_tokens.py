"""Ids put together from words against the library's ids of whole texts."""

import random

import pyarrow as pa
import public_tokenizers
import pytest

from passbook.llm import arrays, tokens

PIECES = (
    "a B the don't 's 1 12 . !! *** é É ß 日本 Σ ΑΣ İ <|endoftext|> <|startoftext|> — \U0001f600".split()
    + [" ", "  ", "\n", "\n\n", "\t", "\r\n", " \n", " ", " ", "　", "\x85", "\x1c", "́", "\x00", "​"]
)


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_are_the_library_s(name, spaced):
    draw = random.Random(7)
    texts = ["", " ", "word " * 3000]
    for _ in range(1500):
        texts.append("".join(draw.choice(PIECES) + draw.choice(["", "", " "]) for _ in range(draw.randint(0, 25))))
    encoder = tokens.Encoder.of(public_tokenizers.path(name), spaced)
    for _ in range(2):
        ids, bounds = encoder.encode(arrays.texts_of(pa.array(texts)))
        for i, text in enumerate(texts):
            want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
            assert ids[bounds[i] : bounds[i + 1]].tolist() == want, repr(text)
