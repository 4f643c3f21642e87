"""Texts that hold added tokens: ids of a tokenizer that is used as loaded."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from test_edges import table
from tokenizers import Tokenizer

from passbook.llm import arrays, binary, tokens

PARTS = "one two <|endoftext|> <|startoftext|> <|endoftext| |> <|ENDOFTEXT|> 12 é".split() + [" ", "  ", "\n", "\n ", "　"]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_with_markers_are_the_library_s(name, spaced):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    draw = random.Random(3)
    texts = ["one <|endoftext|> two", "", "one two", "<|endoftext", "|>", "", "<|endoftext|>", "a<|endoftext|><|startoftext|>b"]
    for _ in range(600):
        texts.append("".join(draw.choice(PARTS) + draw.choice(["", "", " "]) for _ in range(draw.randint(0, 8))))
    ids, bounds = tokens.Encoder.of(path, spaced).encode(arrays.texts_of(pa.array(texts)))
    assert bounds[0] == 0 and bounds[-1] == len(ids)
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files_with_markers(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["one", "one <|endoftext|> two", "two\n<|startoftext|>", None]
    found = binary.round_trip(table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), path).collect()
    at = 0
    for r in sorted(found, key=lambda r: r.doc_id):
        ids = np.array([*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
