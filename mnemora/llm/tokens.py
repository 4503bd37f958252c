"""Batch tokenisation: distinct segments go through the tokenizer, the rest is a gather.

Texts are cut before a blank that follows a solid character, and before ASCII punctuation (but the
apostrophe) that follows an ASCII letter. No pre-token of the supported vocabularies spans such a
place and none looks beyond it, so the ids of a text are the ids of its segments one after the
other. A worker keeps the ids of the segments it has met (bounded).
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np
from tokenizers import Tokenizer

from mnemora.llm.common import ragged, span_hash

MARK = " \x01"
CACHED = 2_000_000
SLICE = 4 << 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[0x21:0x7F] = True
_PUNCTUATION[0x30:0x3A] = _PUNCTUATION[0x27] = False
_PUNCTUATION &= ~_LETTER


class SegmentEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        mark = self._ids([MARK])[0]
        self.mark, self.marks = mark[-1], len(mark)
        self._reset()

    def _reset(self):
        self.keys = np.zeros(0, dtype=np.uint64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        blank = (data == 0x20) | (data == 0x0A)
        before = np.full(len(data), 0x20, dtype=np.uint8)
        before[1:] = data[:-1]
        lead = np.zeros(len(data), dtype=np.uint8)
        lead[2:] = data[:-2]
        # a two-byte character led by C3..DF is never a blank; after other wide ones we don't cut
        solid = ((before > 0x20) & (before < 0x7F)) | ((before >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF))
        cut = (blank & solid) | (_PUNCTUATION[data] & _LETTER[before])
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        return np.flatnonzero(cut)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, one after the other, and the texts' n+1 offsets into them."""
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        starts = self._cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        keys = span_hash(data, starts, ends)
        unique, first, which = np.unique(keys, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        missing = np.flatnonzero(self.keys[at] != unique) if len(self.keys) else np.arange(len(unique))
        if len(missing):
            if len(self.keys) + len(missing) > CACHED:
                self._reset()
                missing = np.arange(len(unique))
            self._learn(data, unique[missing], starts[first[missing]], ends[first[missing]])
            at = np.searchsorted(self.keys, unique)
        slot = at[which]
        lengths = self.lengths[slot]
        ids = self.ids[ragged(self.starts[slot], lengths)]
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        return ids, bounds[np.searchsorted(starts, offsets)]

    def _learn(self, data, keys, starts, ends) -> None:
        raw = data.tobytes()
        pieces = [raw[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
        regular = [p[0] in b" \n" and p[-1] > 0x20 and p[-1] < 0x7F and 1 not in p for p in pieces]
        found: list = [None] * len(pieces)
        plain = [i for i, ok in enumerate(regular) if ok]
        for lo in range(0, len(plain), 4096):
            part = plain[lo : lo + 4096]
            ids = np.array(self._ids(["".join(pieces[i].decode() + MARK for i in part)])[0], dtype=np.uint32)
            stops = np.flatnonzero(ids == self.mark)
            if len(stops) != len(part):
                raise ValueError("segments and marks differ")
            begin = 0
            for i, stop in zip(part, stops.tolist(), strict=True):
                found[i] = ids[begin : stop + 1 - self.marks]
                begin = stop + 1
        odd = [i for i, ok in enumerate(regular) if not ok]
        for i, ids in zip(odd, self._ids([pieces[i].decode() for i in odd]) if odd else [], strict=True):
            found[i] = np.array(ids, dtype=np.uint32)
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        begin = len(self.ids) + np.cumsum(lengths) - lengths
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys, kind="stable")
        self.keys = all_keys[order]
        self.starts = np.concatenate([self.starts, begin])[order]
        self.lengths = np.concatenate([self.lengths, lengths])[order]
        self.ids = np.concatenate([self.ids, *found])


@cache
def encoder(path: str) -> SegmentEncoder:
    """One per worker process."""
    return SegmentEncoder(path)


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends the end id to every text."""
    out = np.full(len(ids) + len(bounds) - 1, end, dtype=np.uint32)
    keep = np.ones(len(out), dtype=bool)
    keep[bounds[1:] + np.arange(len(bounds) - 1)] = False
    out[keep] = ids
    return out, bounds + np.arange(len(bounds))
