"""Repeated passages by relative Lempel-Ziv parsing of word sequences.

Documents are the reference: a document is parsed greedily into factors, each the longest
run of words that also stands in an earlier document, and factors of at least a window of
words are duplicate spans. The index of the reference is spread over tasks:

1. Anchors. Every window of 13 words has an anchor, the least hash of the word 5-grams in
   it; equal windows have equal anchors, and a text has one anchor for about five windows.
   Anchors that occur in a single document index nothing and are left out.
2. Index. The windows of the other anchors are looked up: a window is duplicate if a document
   with a smaller id has it, and refers to the first such document and its place there. The
   answers come back as runs of windows with consecutive places in one document.
3. Parse. Runs that continue each other are joined to factors. A factor of k windows covers
   k + 12 words; at its boundary the next factor's windows count on their own, so what
   straddles two factors is covered only if that window repeats as well.

Rows of the index are packed arrays of a block of documents and a bucket of hashes. Within a
block only the document with the smallest id asks for a window; the answers of the others are
known and travel along, so a passage in every document is one entry for each block. Windows
of very frequent anchors are dealt by their own hash. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.llm import arrays
from passbook.session import saved, shared_dir

#: Words of a window, and of the grams that anchors are taken from.
WINDOW, GRAM = 13, 5
#: Buckets of the index for each shuffle partition.
BUCKETS = 4
#: Blocks that an anchor occurs in before its windows are dealt by their own hash.
FREQUENT = 500

ANCHORS = "bucket int, key binary, doc binary, flag binary"
ANSWERS = "doc_id long, known binary"
WINDOWS = "bucket int, key binary, doc binary, ver binary, pos binary, size binary, answers binary"
#: One run of windows: document, its version, first window, number, the earlier document, its first window.
RUN = np.dtype([("doc", "<i8"), ("ver", "<i8"), ("pos", "<i4"), ("size", "<i4"), ("ref", "<i8"), ("at", "<i4")])
RUNS = "doc_id long, ver long, runs binary"


class Windows:
    """Windows of a block: ``key``, ``anchor``, document index ``doc`` and place ``pos`` in it."""

    def __init__(self, words: arrays.Words):
        m = len(words) - WINDOW + 1
        if m <= 0:
            self.key = self.anchor = np.zeros(0, np.uint64)
            self.doc = self.pos = np.zeros(0, np.int64)
            return
        key = _sums(words.hash, WINDOW, 21)
        gram = _sums(words.hash, GRAM, 22)
        anchor = gram[:m].copy()
        for k in range(1, WINDOW - GRAM + 1):
            np.minimum(anchor, gram[k : k + m], out=anchor)
        at = np.flatnonzero(words.doc[:m] == words.doc[WINDOW - 1 :])
        self.key, self.anchor, self.doc = key[at], anchor[at] & ~np.uint64(1), words.doc[at]
        first = np.searchsorted(words.doc, np.arange(int(words.doc[-1]) + 1))
        self.pos = at - first[self.doc]


def _sums(value: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of all runs of n, also those that reach into the next document."""
    m = len(value) - n + 1
    factor = arrays.numbers(n, seed) | np.uint64(1)
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total += value[k : k + m] * factor[k]
    return arrays.mix(total)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its rows, in order."""
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, edge):
        if len(part):
            yield int(bucket[part[0]]), part


def _by_doc(doc: np.ndarray, ver: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort((ver, doc))
    d, v = doc[order], ver[order]
    return [p for p in np.split(order, np.flatnonzero((d[1:] != d[:-1]) | (v[1:] != v[:-1])) + 1) if len(p)]


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _columns(kinds: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in kinds.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.record_batch(
        [pa.array([r[i] for r in rows], types[kind]) for i, (_, kind) in enumerate(fields)],
        names=[name for name, _ in fields],
    )


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("doc_id").cast(pa.int64()))


def anchors_of(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Distinct anchors of each block, packed by bucket: hash, a document that has it, and
    whether another document of the block has it too (then ``doc`` is the first one, and the
    others come along with flag 2)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.blocks(whole):
                ids = _ids(batch)
                found = Windows(arrays.words_of(arrays.texts_of(batch.column("text"))))
                doc = ids[found.doc]
                order = np.lexsort((doc, found.anchor))
                key, doc = found.anchor[order], doc[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                key, doc = key[new], doc[new]
                if not len(key):
                    continue
                first = np.ones(len(key), bool)
                first[1:] = key[1:] != key[:-1]
                more = np.append(~first[1:], False)
                flag = np.where(first, np.where(more, 1, 0), 2).astype(np.uint8)
                bucket = (key >> np.uint64(20)) % np.uint64(n_buckets)
                back = np.lexsort((key, doc))
                rows = [
                    (b, key[back[p]].tobytes(), doc[back[p]].tobytes(), flag[back[p]].tobytes())
                    for b, p in _by_bucket(bucket[back].astype(np.int64))
                ]
                yield _columns(ANCHORS, rows)

    return docs.select("doc_id", "text").mapInArrow(find, ANCHORS)


def shared_anchors(rows: DataFrame) -> DataFrame:
    """(doc_id, known): the anchors of each document that another one has; the lowest bit is
    set on very frequent ones."""

    def resolve(table: pa.Table) -> pa.Table:
        key = _joined(table["key"], np.uint64)
        doc = _joined(table["doc"], np.int64)
        flag = _joined(table["flag"], np.uint8)
        name, which, times = np.unique(key, return_inverse=True, return_counts=True)
        asked = np.bincount(which, flag < 2, minlength=len(name))
        least = np.full(len(name), np.iinfo(np.int64).max)
        most = np.full(len(name), np.iinfo(np.int64).min)
        np.minimum.at(least, which, doc)
        np.maximum.at(most, which, doc)
        there = (least != most)[which]
        value = key | (asked > FREQUENT)[which].astype(np.uint64)
        pick = np.flatnonzero(there)
        parts = _by_doc(doc[pick], doc[pick])
        rows = [(int(doc[pick[p[0]]]), value[pick[p]].tobytes()) for p in parts]
        return pa.Table.from_batches([_columns(ANSWERS, rows)])

    return rows.groupBy("bucket").applyInArrow(resolve, ANSWERS)


def windows_of(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Windows with a known anchor, packed by bucket as runs; ``docs`` has (doc_id, ver, text,
    known). Only the first document of a block asks; the answers of others are added."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.blocks(whole):
                ids, ver = _ids(batch), np.asarray(batch.column("ver"))
                found = Windows(arrays.words_of(arrays.texts_of(batch.column("text"))))
                if not len(found.key):
                    continue
                lists = batch.column("known").to_pylist()
                known = np.concatenate([np.frombuffer(b"".join(x), np.uint64) for x in lists])
                owner = np.repeat(np.arange(len(lists)), [sum(map(len, x)) // 8 for x in lists])
                base = arrays.mix(owner.astype(np.uint64) + np.uint64(1))
                table = np.sort((known & ~np.uint64(1)) ^ base)
                often = np.unique((known & ~np.uint64(1))[(known & np.uint64(1)) == 1])
                asked = found.anchor ^ arrays.mix(found.doc.astype(np.uint64) + np.uint64(1))
                pick = np.flatnonzero(_within(table, asked))
                if not len(pick):
                    continue
                key, anchor, at, pos = found.key[pick], found.anchor[pick], found.doc[pick], found.pos[pick]
                doc, own = ids[at], ver[at]
                by = np.where(_within(often, anchor), key, anchor)
                bucket = ((by >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64)
                # The first document of the block that has a window, and its first place there.
                order = np.lexsort((pos, own, doc, key))
                new = np.ones(len(order), bool)
                new[1:] = key[order[1:]] != key[order[:-1]]
                leader = np.empty(len(order), np.int64)
                leader[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
                asks = doc == doc[leader]
                rest = np.flatnonzero(~asks)
                extra: dict[int, list[bytes]] = {}
                answers = _runs(doc[rest], own[rest], pos[rest], doc[leader[rest]], pos[leader[rest]])
                for p in _by_doc(answers["doc"], answers["ver"]):
                    b = int(arrays.mix(answers["doc"][p[:1]].astype(np.uint64))[0] % np.uint64(n_buckets))
                    extra.setdefault(b, []).append(answers[p].tobytes())
                rows = []
                for b, p in _by_bucket(bucket[asks]):
                    p = np.flatnonzero(asks)[p] if not asks.all() else p
                    start = np.ones(len(p), bool)
                    start[1:] = (at[p[1:]] != at[p[:-1]]) | (pos[p[1:]] != pos[p[:-1]] + 1)
                    head = p[start]
                    size = np.diff(np.append(np.flatnonzero(start), len(p))).astype(np.int32)
                    rows.append(
                        (
                            b,
                            key[p].tobytes(),
                            doc[head].tobytes(),
                            own[head].tobytes(),
                            pos[head].astype(np.int32).tobytes(),
                            size.tobytes(),
                            b"".join(extra.pop(b, ())),
                        )
                    )
                rows.extend((b, b"", b"", b"", b"", b"", b"".join(x)) for b, x in extra.items())
                yield _columns(WINDOWS, rows)

    return docs.mapInArrow(find, WINDOWS)


def _within(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys stand in a sorted array."""
    if not len(table):
        return np.zeros(len(keys), bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


def _runs(doc, ver, pos, ref, at) -> np.ndarray:
    """Runs of windows that go on in both documents; the arguments stand in any order."""
    order = np.lexsort((pos, ver, doc))
    doc, ver, pos, ref, at = (x[order] for x in (doc, ver, pos, ref, at))
    new = np.ones(len(doc), bool)
    new[1:] = (
        (doc[1:] != doc[:-1])
        | (ver[1:] != ver[:-1])
        | (pos[1:] != pos[:-1] + 1)
        | (ref[1:] != ref[:-1])
        | (at[1:] != at[:-1] + 1)
    )
    first = np.flatnonzero(new)
    out = np.zeros(len(first), RUN)
    for name, value in (("doc", doc), ("ver", ver), ("pos", pos), ("ref", ref), ("at", at)):
        out[name] = value[first]
    out["size"] = np.diff(np.append(first, len(doc)))
    return out


def duplicate_runs(rows: DataFrame) -> DataFrame:
    """(doc_id, ver, runs): windows that a document with a smaller id has, as packed RUNs."""

    def resolve(table: pa.Table) -> pa.Table:
        key = _joined(table["key"], np.uint64)
        size = _joined(table["size"], np.int32)
        run_pos = _joined(table["pos"], np.int32).astype(np.int64)
        doc = np.repeat(_joined(table["doc"], np.int64), size)
        ver = np.repeat(_joined(table["ver"], np.int64), size)
        pos = np.repeat(run_pos - (np.cumsum(size) - size), size) + np.arange(len(key))
        order = np.lexsort((pos, ver, doc, key))
        new = np.ones(len(order), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        leader = np.empty(len(order), np.int64)
        leader[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        rest = np.flatnonzero(doc != doc[leader])
        found = _runs(doc[rest], ver[rest], pos[rest], doc[leader[rest]], pos[leader[rest]])
        found = np.concatenate([found, _joined(table["answers"], RUN)])
        rows = [(int(found["doc"][p[0]]), int(found["ver"][p[0]]), found[p].tobytes()) for p in _by_doc(found["doc"], found["ver"])]
        return pa.Table.from_batches([_columns(RUNS, rows)])

    return rows.groupBy("bucket").applyInArrow(resolve, RUNS)


def factors(runs: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Greedy parse: (first word, words, earlier document, its first word) of each factor."""
    runs = runs[np.argsort(runs["pos"], kind="stable")]
    out: list[list[int]] = []
    for pos, size, ref, at in runs[["pos", "size", "ref", "at"]].tolist():
        if out and out[-1][2] == ref and out[-1][0] + out[-1][1] == pos and out[-1][3] + out[-1][1] == at:
            out[-1][1] += size
        else:
            out.append([pos, size, ref, at])
    return [(p, n + WINDOW - 1, ref, at) for p, n, ref, at in out]


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, n_words, n_removed, factors, kept_text).

    Words covered by a window that a document with a smaller doc_id has are removed;
    ``factors`` are the spans, ``kept_text`` the other words joined by one blank. Null, empty
    and short texts have no window; null has no words. Rows that repeat a doc_id do not
    remove each other's words, and each loses what smaller ids have. A null doc_id is smaller
    than none: its words are kept and remove nothing. No rows in, no rows out.
    """
    spark = docs.sparkSession
    n_buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("ver"), "text")
    named = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    known = shared_anchors(anchors_of(named, n_buckets)).groupBy("doc_id").agg(F.collect_list("known").alias("known"))
    known = saved(known, shared_dir(spark, "anchors"))
    asking = named.join(known, "doc_id").select("doc_id", "ver", "text", "known")
    runs = duplicate_runs(windows_of(asking, n_buckets)).groupBy("doc_id", "ver").agg(F.collect_list("runs").alias("runs"))
    runs = saved(runs, shared_dir(spark, "runs"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(
            pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_id", pa.int64()), ("ref_start", pa.int32())])
        )
        for whole in batches:
            for batch in arrays.blocks(whole):
                texts = arrays.texts_of(batch.column("text"))
                words = arrays.words_of(texts)
                count = np.bincount(words.doc, minlength=len(texts))
                first = np.cumsum(count) - count
                gone = np.zeros(len(words) + 1, np.int64)
                spans: list = []
                for i, lists in enumerate(batch.column("runs").to_pylist()):
                    found = factors(np.frombuffer(b"".join(lists), RUN)) if lists else []
                    spans.append([{"start": s, "length": n, "ref_id": r, "ref_start": a} for s, n, r, a in found])
                    for s, n, _, _ in found:
                        gone[first[i] + s] += 1
                        gone[first[i] + s + n] -= 1
                keep = np.cumsum(gone)[:-1] == 0
                kept = []
                for i in range(len(texts)):
                    own = texts.get(i).split()
                    mask = keep[first[i] : first[i] + count[i]]
                    if not mask.all():
                        own = [w for w, k in zip(own, mask.tolist(), strict=True) if k]
                    kept.append(b" ".join(own))
                removed = count - np.bincount(words.doc, keep, minlength=len(texts)).astype(np.int64)
                yield pa.record_batch(
                    [
                        batch.column("doc_id"),
                        pa.array(count.astype(np.int64)),
                        pa.array(removed),
                        pa.array(spans, kind),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "factors", "kept_text"],
                )

    out = (
        "doc_id long, n_words long, n_removed long, "
        "factors array<struct<start: int, length: int, ref_id: long, ref_start: int>>, kept_text string"
    )
    return rows.join(runs, ["doc_id", "ver"], "left").select("doc_id", "text", "runs").mapInArrow(parse, out)
