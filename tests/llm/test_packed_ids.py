"""Packed sequences hold the token ids themselves."""

import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa
import public_tokenizers
from test_edges import table
from tokenizers import Tokenizer

from passbook.llm import packing


def test_last_stage_yields_token_sequences(spark, sf_dir):
    texts = {1: "one two three", 2: None, 3: "word " * 5000, 4: "12 <|endoftext|> four"}
    docs = table(spark, [(i, t, "en", "a") for i, t in texts.items()])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sequences, of_doc = {}, {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).orderBy("sequence_id", "offset").collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and len(sequences.setdefault(r.sequence_id, [])) == r.offset
        sequences[r.sequence_id] += ids
        of_doc.setdefault(r.doc_id, {})[r.start] = ids
    assert max(map(len, sequences.values())) <= 2048
    for i, text in texts.items():
        got = [x for _, ids in sorted(of_doc[i].items()) for x in ids]
        assert got == [*library.encode(text or "", add_special_tokens=False).ids, 0]


def test_a_worker_encodes_little_text_at_once():
    """A batch of many texts takes no more memory than some of them, and gives the same ids."""
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [" ".join(f"word{i % 97} and{i % 13} more" for i in range(k, k + 3000)) for k in range(60)]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    cut = packing.cutter(path, 2048)
    one_by_one = [row for i in range(len(texts)) for out in cut(iter([batch.slice(i, 1)])) for row in out.to_pylist()]
    tracemalloc.start()
    n, at = 0, 0
    for out in cut(iter([batch])):
        rows = out.to_pylist()
        assert rows == one_by_one[at : at + len(rows)]
        at += len(rows)
        n += 1
        del rows, out
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == len(one_by_one) and n > 4
    assert peak < 80 << 20, peak
