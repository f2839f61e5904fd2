"""Token ids of whole documents through a vocabulary of pieces.

The tokenizer drops white space and never joins letters or digits with ASCII
punctuation, so a text's ids are those of its pieces, end to end.  A worker
keeps the ids of the pieces it has met (``CACHE_PIECES`` at most, then it starts
anew) and asks the tokenizer only for new ones.  Texts with ``<|`` go to the
tokenizer whole, because special tokens are matched before anything else.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from . import common

#: Pieces whose ids a worker keeps.
CACHE_PIECES = 1_000_000
#: The vocabulary file by default.
VOCABULARY = "word_bpe_49k.json"

_SPACE = common.byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PUNCT[ord("'")] = False


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Encoder:
    """Ids by a word-wise tokenizer; ids must be below 65,536."""

    _of: dict[tuple, Encoder] = {}

    @classmethod
    def of(cls, path: str | None, plain: bool) -> Encoder:
        """The worker's encoder. plain: strings of special tokens are ordinary text."""
        return cls._of.setdefault((path, plain), cls._of.get((path, plain)) or cls(path, plain))

    def __init__(self, path: str | None, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.tokenizer.encode_special_tokens = plain
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes in order, and the number of each one's piece
        self.number = np.zeros(0, np.int32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.sizes = np.zeros(1 << 12, np.int32)
        self.flat = np.zeros(1 << 14, np.uint16)
        self.used = 0

    def _learn(self, pieces: list[str], hashes: np.ndarray) -> None:
        n, at = len(self.known), self.used
        for k in range(0, len(pieces), 4000):
            part = pieces[k : k + 4000]
            limits = np.cumsum([0] + [len(x) + 1 for x in part])
            got = self.tokenizer.encode_batch([" ".join(part)], add_special_tokens=False)[0]
            ids = np.array(got.ids, np.uint16)
            begins = np.fromiter((a for a, _ in got.offsets), np.int64, len(ids))
            sizes = np.bincount(np.searchsorted(limits, begins, side="right") - 1, minlength=len(part))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while n + len(part) > len(self.starts):
                self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
            self.flat[self.used : self.used + len(ids)] = ids
            self.sizes[n : n + len(part)] = sizes
            self.starts[n : n + len(part)] = at + np.cumsum(sizes) - sizes
            n, self.used = n + len(part), self.used + len(ids)
            at = self.used
        place = np.searchsorted(self.known, hashes)
        self.number = np.insert(self.number, place, np.arange(len(self.known), n, dtype=np.int32))
        self.known = np.insert(self.known, place, hashes)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and row limits (n + 1)."""
        raw, limits = common.text_buffer(column)
        special = self._with_marks(raw, limits)
        starts, ends, rows = self._pieces(raw, limits)
        low = common.LOWER[raw]
        hashes = common.word_hashes(low, starts, ends)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > CACHE_PIECES:
            self._forget()
        found = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = found < len(self.known)
        new[inside] = self.known[found[inside]] != unique[inside]
        if new.any():
            whole = low.tobytes()
            self._learn([whole[starts[k] : ends[k]].decode("utf-8", "replace") for k in first[new]], unique[new])
        at = self.number[np.searchsorted(self.known, unique)][inverse]
        sizes = self.sizes[at].astype(np.int64)
        ids = self.flat[common.ragged(self.starts[at], sizes)]
        totals = np.concatenate([[0], np.cumsum(sizes)])[rows]
        if not len(special):
            return ids, totals
        parts = [ids[totals[k] : totals[k + 1]] for k in range(len(limits) - 1)]
        for k in special:
            parts[k] = np.array(self.tokenizer.encode(column[int(k)].as_py(), add_special_tokens=False).ids, np.uint16)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    @staticmethod
    def _with_marks(raw: np.ndarray, limits: np.ndarray) -> np.ndarray:
        at = np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C))
        return np.unique(np.searchsorted(limits, at, side="right") - 1)

    @staticmethod
    def _pieces(raw: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words between white space, cut where a letter or digit (ASCII, or Latin of two bytes) meets punctuation."""
        n = len(raw)
        inside, alnum, punct = _SPACE[raw], _ALNUM[raw], _PUNCT[raw]
        lead = np.zeros(n, bool)
        lead[:-1] = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        ends_letter = alnum.copy()
        ends_letter[1:] |= lead[:-1]
        begins_letter = alnum | lead
        cut = np.zeros(n, bool)  # a piece may begin here
        cut[1:] = (ends_letter[:-1] & punct[1:]) | (punct[:-1] & begins_letter[1:]) | ~inside[:-1]
        cut[limits[:-1][limits[:-1] < n]] = True
        opens = inside & cut
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | cut[1:]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        return starts, ends, np.searchsorted(starts, limits)
