"""Words, lines and their 64-bit hashes for whole Arrow batches of texts, by numpy over UTF-8 bytes.

A text is never cut: a block holds whole texts, about BLOCK bytes of them, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa

BLOCK = 512 << 10
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of P and of its inverse modulo 2^64, n of each at least."""
    if not _powers or len(_powers["up"]) < n:
        n = max(n, BLOCK + 1)
        inverse = pow(int(_P), -1, 1 << 64)
        for key, base in (("up", int(_P)), ("down", inverse)):
            out = np.full(n, np.uint64(base))
            out[0] = 1
            _powers[key] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


@dataclass
class Block:
    """Some whole texts: their bytes one after the other, where each begins and ends, and which bytes separate words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    breaks: np.ndarray = field(default_factory=lambda: _SEP)

    def __len__(self) -> int:
        return len(self.start)

    @cached_property
    def _sums(self) -> np.ndarray:
        up, _ = _table(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=out[1:])
        return out

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range [a, b): equal bytes give equal hashes wherever they stand."""
        _, down = _table(len(self.data) + 1)
        return mix((self._sums[b] - self._sums[a]) * down[a] + (b - a).astype(np.uint64))

    @cached_property
    def separators(self) -> np.ndarray:
        return self.breaks[self.data]

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each word."""
        n = len(self.data)
        inside = ~self.separators
        first = np.zeros(n + 1, bool)
        last = np.zeros(n + 1, bool)
        first[:n] = inside
        first[1:n] &= self.separators[: n - 1]
        last[1 : n + 1] = inside
        last[1:n] &= self.separators[1:n]
        full = self.end > self.start
        first[self.start[full]] |= inside[self.start[full]]
        last[self.end[full]] |= inside[self.end[full] - 1]
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        return a, b, np.searchsorted(self.end, a, side="right")

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Start, end and text number of each \n-split line; an empty text has one empty line."""
        breaks = np.flatnonzero(self.data == 10)
        of = np.searchsorted(self.end, breaks, side="right")
        a = np.concatenate([self.start, breaks + 1])
        b = np.concatenate([breaks, self.end])
        which = np.concatenate([np.arange(len(self)), of])
        before = np.concatenate([of, np.arange(len(self))])
        ka, kb = np.lexsort((a, which)), np.lexsort((b, before))
        return a[ka], b[kb], which[ka]

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return total[self.end] - total[self.start]


def repeats(which: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items in order: which of them share text and key with another, and which do so with an earlier one."""
    again = np.zeros(len(keys), bool)
    later = np.zeros(len(keys), bool)
    if len(keys) > 1:
        both = mix(keys ^ mix(which.astype(np.uint64)))
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        later[order[1:][same]] = True
    return again, later


def windows(block: Block, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words within one text, and the text's number; the run's first word is at its own index."""
    _, _, which = block.words
    k = len(hashes) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = hashes[:k].copy()
    for i in range(1, n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + k])
    return out, np.where(which[:k] == which[n - 1 :], which[:k], -1)


def blocks(texts: pa.Array | pa.ChunkedArray, lower: bool = False, breaks: np.ndarray = _SEP) -> Iterator[tuple[int, Block]]:
    """Whole texts in blocks, each with the number of its first text. A null text is empty; ``breaks`` are the bytes that separate words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, side="right")) - 1)
        j = min(j, len(texts))
        piece = raw[at[i] : at[j]]
        yield i, Block(_LOWER[piece] if lower else piece, at[i:j] - at[i], at[i + 1 : j + 1] - at[i], breaks)
        i = j
