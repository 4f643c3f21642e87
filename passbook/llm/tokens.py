"""Token ids of texts by a public tokenizer, with words encoded once; runs inside tasks.

The library encodes a text slowly word by word, and most words occur again and again. A text
is cut where no token and no rule of its tokenizer reaches across, each distinct piece is
encoded by the library, and ids are put together by numpy. Pieces stay known to the Python
worker in a table of fixed size. Texts that hold an added token of the file, such as
``<|endoftext|>``, are encoded by the library whole. What comes out is what the library gives
for whole texts; the tests compare them.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np

from passbook.llm import arrays

#: Slots of the table of known pieces (a power of two), and ids that a slot holds.
SLOTS, SLOT_IDS = 1 << 21, 12
#: Pieces that are encoded as one text.
JOINED = 512


class Encoder:
    """A tokenizer file; ``spaced`` if a word's tokens hold the blank before it.

    ``spaced`` tokenizers are byte-level with the usual rules for blanks: a blank belongs to
    the word after it, other white space stands alone. Others drop white space.
    """

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.markers = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))).encode()) if added else None
        self.spaced = spaced
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.key = np.zeros(SLOTS, np.uint64)
        self.count = np.zeros(SLOTS, np.uint8)
        self.ids = np.zeros((SLOTS, SLOT_IDS), np.uint16 if self.vocabulary <= 1 << 16 else np.uint32)

    @staticmethod
    def of(path: str, spaced: bool) -> Encoder:
        """The worker's encoder for a file."""
        held = arrays.worker_cache()
        key = ("encoder", path, spaced)
        if key not in held:
            held[key] = Encoder(path, spaced)
        return held[key]

    def encode(self, texts: arrays.Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the bounds of the texts in it."""
        marked = self._marked(texts)
        if not len(marked):
            return self._by_pieces(texts)
        # Texts with markers go to the library whole, the others stay in their places.
        size = np.diff(texts.bounds)
        keep = np.ones(len(texts), bool)
        keep[marked] = False
        rest = arrays.Texts(texts.data[np.repeat(keep, size)], np.append(0, np.cumsum(np.where(keep, size, 0))))
        ids, bounds = self._by_pieces(rest)
        parts, count, at = [], np.diff(bounds), 0
        for i in marked.tolist():
            whole = self.tokenizer.encode(texts.get(i).decode(), add_special_tokens=False).ids
            parts += [ids[at : bounds[i]], np.array(whole, np.uint32)]
            count[i], at = len(whole), bounds[i]
        return np.concatenate([*parts, ids[at:]]), np.append(0, np.cumsum(count))

    def _marked(self, texts: arrays.Texts) -> np.ndarray:
        """Texts that hold a token which the library takes out before anything else."""
        if self.markers is None:
            return np.zeros(0, np.int64)
        spans = [m.span() for m in self.markers.finditer(texts.data.tobytes())]
        # A match over the end of a text may hide one: both texts are encoded whole.
        at = np.array([[start, end - 1] for start, end in spans], np.int64).ravel()
        return np.unique(np.searchsorted(texts.bounds, at, side="right") - 1)

    def _by_pieces(self, texts: arrays.Texts) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for texts without markers."""
        start, end, plain = self._pieces(texts)
        n = len(start)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        key = arrays.span_hashes(texts.data, start, end) | np.uint64(1)
        slot = (key >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        known = self.key[slot] == key
        count = self.count[slot].astype(np.int64)
        new = np.flatnonzero(~known)
        _, one, which = np.unique(key[new], return_index=True, return_inverse=True)
        pick = new[one]
        fresh = self._library(texts.data, start[pick], end[pick], plain[pick])
        fresh_count = np.fromiter(map(len, fresh), np.int64, len(fresh))
        fresh_at = np.cumsum(fresh_count) - fresh_count
        flat = np.fromiter((i for ids in fresh for i in ids), np.uint32, int(fresh_count.sum()))
        count[new] = fresh_count[which]
        # Where an id stands: in the table, or behind it among the fresh ones.
        table = SLOTS * SLOT_IDS
        at = slot * SLOT_IDS
        at[new] = table + fresh_at[which]
        total = np.concatenate([[0], np.cumsum(count)])
        source = np.repeat(at - total[:-1], count) + np.arange(int(total[-1]))
        out = np.empty(len(source), np.uint32)
        old = source < table
        out[old] = self.ids.ravel()[source[old]]
        out[~old] = flat[source[~old] - table]
        self._keep(key[pick], slot[pick], fresh_count, fresh_at, flat)
        first = np.searchsorted(start, texts.bounds[:-1])
        return out, np.append(total[first], total[-1])

    def _keep(self, key, slot, count, at, flat) -> None:
        """Fresh pieces take their slots, the last one of a slot stays."""
        last = {}
        for i in np.flatnonzero(count <= SLOT_IDS).tolist():
            last[int(slot[i])] = i
        if not last:
            return
        pick = np.fromiter(last.values(), np.int64, len(last))
        slots, count, at = slot[pick], count[pick], at[pick]
        self.key[slots], self.count[slots] = key[pick], count
        for k in range(SLOT_IDS):
            there = count > k
            self.ids[slots[there], k] = flat[at[there] + k]

    def _pieces(self, texts: arrays.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of the pieces, and which ones can be encoded next to others."""
        data, bounds = texts.data, texts.bounds
        if not len(data):
            none = np.zeros(0, np.int64)
            return none, none, none.astype(bool)
        if not self.spaced:
            words = arrays.words_of(texts)
            return words.start, words.end, np.ones(len(words), bool)
        # A byte that starts a character which is surely no white space. The lead bytes
        # C2, E1, E2 and E3 begin, among many others, all white space beyond ASCII.
        solid = (data > 32) & (data < 127) | (data >= 0xC3) & (data != 0xE1) & (data != 0xE2) & (data != 0xE3)
        ascii_solid = (data > 32) & (data < 127)
        cut = np.zeros(len(data) + 1, bool)
        # before a blank that a surely solid character follows ...
        cut[:-2] = (data[:-1] == 32) & solid[1:]
        # ... and behind one line break or tab between a solid byte and a solid character.
        cut[2:-1] |= ((data[1:-1] >= 9) & (data[1:-1] <= 13)) & ascii_solid[:-2] & solid[2:]
        cut[bounds] = True
        cut[len(data)] = False
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        odd = np.concatenate([[0], np.cumsum(~(solid | ((data >= 0x80) & (data < 0xC0))))])
        plain = (data[start] == 32) & (odd[end] - odd[start] == 1)
        return start, end, plain & (end - start > 1)

    def _library(self, data, start, end, plain) -> list:
        """Ids of each piece, by the library."""
        raw = [data[s:e].tobytes().decode() for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        out: list = [None] * len(raw)
        if self.spaced:
            alone = np.flatnonzero(~plain).tolist()
            encoded = self.tokenizer.encode_batch_fast([raw[i] for i in alone], add_special_tokens=False)
            for i, e in zip(alone, encoded, strict=True):
                out[i] = e.ids
        together = np.flatnonzero(plain).tolist()
        gap = 0 if self.spaced else 1
        for k in range(0, len(together), JOINED):
            part = together[k : k + JOINED]
            size = np.array([len(raw[i]) + gap for i in part])
            e = self.tokenizer.encode((" " if gap else "").join([raw[i] for i in part]), add_special_tokens=False)
            ids = e.ids
            if not ids:
                for i in part:
                    out[i] = []
                continue
            where = np.array(e.offsets, np.int64)[:, 1] - 1
            stop = np.searchsorted(where, np.cumsum(size), side="left").tolist()
            begin = 0
            for i, to in zip(part, stop, strict=True):
                out[i] = ids[begin:to]
                begin = to
        return out


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
