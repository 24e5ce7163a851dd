"""Hashes of words and of runs of words, for whole batches of texts at once.

A word is a run of characters other than blank, tab, line feed, vertical tab,
form feed and carriage return.  Texts are taken as UTF-8 bytes, joined by line
feeds, so that one pass of NumPy serves a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Upper-case ASCII letters to lower case, all other bytes as they are.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: ASCII signs count as blanks too where only letters and digits matter.
_SIGNS = _BLANK.copy()
_SIGNS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: Bytes hashed in one go.
BLOCK_BYTES = 4 << 20

#: Bytes of a word that the tables of random numbers cover; a longer word goes through BLAKE2b.
TABLE_BYTES = 48
_PLACES = [np.random.default_rng(71 + k).integers(0, 1 << 64, (TABLE_BYTES, 256), dtype=np.uint64) for k in range(2)]
_AFTER = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xA0761D6478BD642F))
_STIR = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of each run of ``a`` with the run of ``b`` beside it; stirred, so that no sum of
    products over a run is left whose terms could cancel out."""
    x = a * _AFTER[which]
    x += b
    x ^= x >> np.uint64(32)
    x *= _STIR
    x ^= x >> np.uint64(29)
    return x


class Words:
    """The words of a batch of texts: hashes, byte ranges, and each text's range of words.

    ``blank`` marks the bytes that part words; a line feed has to be one."""

    def __init__(self, texts: list[str | None], lower: bool = False, signs: bool = False, blank: np.ndarray | None = None):
        parts = [(t or "").encode() for t in texts]
        self.data = b"\n".join(parts) + b"\n"
        raw = np.frombuffer(self.data, dtype=np.uint8)
        if lower:
            raw = _LOWER[raw]
        solid = ~(blank if blank is not None else _SIGNS if signs else _BLANK)[raw]
        edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
        self.starts, self.ends = edge[0::2], edge[1::2]
        ends_of_texts = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
        #: first[i]:first[i + 1] are the words of text i.
        self.first = np.concatenate([[0], np.searchsorted(self.starts, ends_of_texts)])
        self._raw, self._solid = raw, solid

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; two independent ones are on offer.

        Every byte at every place has a random number of its own, and a word
        the mixed sum of them.  Words beyond TABLE_BYTES have their BLAKE2b.
        """
        if not len(self):
            return np.zeros(0, dtype=np.uint64)
        lengths = self.ends - self.starts
        numbers = _PLACES[which].ravel()
        out = np.empty(len(self), dtype=np.uint64)
        # A block of words at a time, so that a very long text needs no more memory than it has words.
        limits = np.searchsorted(self.ends, np.arange(0, len(self._raw) + BLOCK_BYTES, BLOCK_BYTES))
        limits[-1] = len(self)
        for a, b in zip(limits[:-1], limits[1:], strict=True):
            if a == b:
                continue
            lo, hi, n = self.starts[a], self.ends[b - 1], lengths[a:b]
            at = np.flatnonzero(self._solid[lo:hi])
            begins = np.cumsum(n) - n
            place = np.minimum(np.arange(len(at)) - np.repeat(begins, n), TABLE_BYTES - 1)
            value = numbers[place * 256 + self._raw[lo:hi][at]]
            out[a:b] = mix(np.add.reduceat(value, begins) + n.astype(np.uint64))
        for i in np.flatnonzero(lengths > TABLE_BYTES).tolist():
            word = self._raw[self.starts[i] : self.ends[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=bytes([which])).digest(), "little")
        return out

    def line(self, i: int) -> bytes:
        """The words of text i, joined by one blank."""
        a, b = int(self.first[i]), int(self.first[i + 1])
        return b" ".join(self.data[int(self.starts[a]) : int(self.ends[b - 1])].split()) if a < b else b""


def runs(hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A hash of hashes[i : i + k] for every i; runs may cross from one text to the next.

    Runs of twice the length are made of two beside each other, the last of two that overlap."""
    if len(hashes) < k:
        return np.zeros(0, dtype=np.uint64)
    out, have = hashes, 1
    while have < k:
        step = min(have, k - have)
        out = joined(out[: len(out) - step], out[step:], which)
        have += step
    return out


def slices(texts: list[str | None], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a list that hold about so many characters each, at least one text."""
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t or "") > chars:
            yield start, i
            start, held = i, 0
        held += len(t or "")
    if start < len(texts):
        yield start, len(texts)
