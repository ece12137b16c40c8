"""Whole texts to token ids by the tokenizers library, each distinct piece encoded once per worker.

Both vocabularies split a text before merging, and never merge across white space, nor between a
letter or digit and the run of ASCII punctuation that ends a word. A text's ids are therefore the
ids of its pieces, one after the other: pieces are found and hashed by numpy over a whole block of
texts, the library encodes each distinct one, a bounded memo keeps them. Texts for which that rule
may not hold (a special token's string, white space beyond ASCII) are encoded in one go.
"""

from __future__ import annotations

import ctypes
import gc
import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .bytewords import Block, blocks

#: Memoised pieces a worker keeps (about 180 bytes each); further ones are encoded anew in each block.
MEMO_PIECES = 600_000
_ALNUM, _PUNCT, _WS = (np.zeros(256, bool) for _ in range(3))
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_WS[[0x20, *range(0x09, 0x0E)]] = True
_PUNCT[[i for i in range(33, 127) if not _ALNUM[i]]] = True
_kept: dict[str, Encoder] = {}


class Encoder:
    """encode(texts) gives for each block of texts all ids, and each text's first and last place in them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = self.tokenizer.normalizer is None  # byte-level: white space counts
        self.memo: dict[int, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _together(self, words: list[str], spaced: bool) -> list[bytes]:
        """Ids of runs of Latin letters, or each with a space before it, as words of one text."""
        if self.spaced and not spaced:
            text, step = "\n" + "\n".join(words), 2
        else:
            text, step = ("".join(words) if spaced else " ".join(words)), 1
        got = self.tokenizer.encode(text, add_special_tokens=False)
        ids = np.array(got.ids, np.uint32)
        try:
            cut = np.searchsorted(np.array(got.word_ids, np.int64), np.arange(step * len(words) + 1))
        except TypeError:
            return [self.whole(w) for w in words]
        if cut[-1] != len(ids) or (np.diff(cut) < 1).any():
            return [self.whole(w) for w in words]
        raw, cut = ids.tobytes(), (cut * 4).tolist()
        return [raw[cut[i] : cut[i + 1]] for i in range(step - 1, len(cut) - 1, step)]

    def _learn(self, new: dict[int, bytes]) -> dict[int, bytes]:
        out: dict[int, bytes] = {}
        groups: tuple[list, list] = ([], [])
        for key, piece in new.items():
            text = piece.decode()
            spaced = text[:1] == " "
            if text[spaced:].isalpha() and max(text) <= "\u00ff":
                groups[spaced].append((key, text))
            else:
                out[key] = self.whole(text)
        for spaced, found in enumerate(groups):
            for i in range(0, len(found), 4096):
                part = found[i : i + 4096]
                out.update(zip((k for k, _ in part), self._together([w for _, w in part], bool(spaced)), strict=True))
        return out

    def _odd(self, block: Block) -> np.ndarray:
        """Texts that hold a special token's string or white space beyond ASCII."""
        d, n = block.data, len(block.data)
        out = np.zeros(len(block), bool)
        if not n:
            return out
        nxt = np.append(d[1:], 0)
        mark = (d == 0xC2) & ((nxt == 0x85) | (nxt == 0xA0)) | (d == 0xE1) & (nxt == 0x9A) | (d == 0xE2) & ((nxt == 0x80) | (nxt == 0x81)) | (d == 0xE3) & (nxt == 0x80)
        where = list(np.flatnonzero(mark))
        raw = d.tobytes()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                where.append(at)
                at = raw.find(s, at + 1)
        if where:
            out[np.searchsorted(block.end, np.array(where), side="right")] = True
        return out

    def _pieces(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each piece, in order."""
        d = block.data
        a, b, of = block.words
        # a run of punctuation at a word's end stands alone, if a letter or digit is before it
        plain = np.flatnonzero(~_PUNCT[d])
        tail = plain[np.searchsorted(plain, b, side="left") - 1] + 1 if len(plain) else a  # after the word's last other byte
        tail = np.maximum(tail, a)
        before = d[np.maximum(tail - 1, 0)]
        latin = (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (d[np.maximum(tail - 2, 0)] == 0xC3)
        cut = (tail > a) & (tail < b) & (_ALNUM[before] | latin & (tail - 2 >= a))
        if not self.spaced:
            starts = np.concatenate([a, tail[cut]])
            ends = np.concatenate([np.where(cut, tail, b), b[cut]])
            which = np.concatenate([of, of[cut]])
            order = np.argsort(starts, kind="stable")
            return starts[order], ends[order], which[order]
        led = (a > block.start[of]) & (d[np.maximum(a - 1, 0)] == 0x20)
        first = a - led
        # white space: a run's last character goes with the next word if a space, else alone; the rest together
        n = len(d)
        ws = np.zeros(n + 1, bool)
        ws[:n] = _WS[d]
        edge = np.zeros(n + 1, bool)
        edge[block.start] = True
        edge[n] = True
        run_a = np.flatnonzero(ws[:n] & (edge[:n] | ~np.concatenate([[False], ws[: n - 1]])[:n]))
        run_b = np.flatnonzero(ws[:n] & (edge[1:] | ~ws[1:])) + 1
        ended = edge[run_b]
        space = d[run_b - 1] == 0x20
        rest = ended | (run_b - run_a > 1) | ~space
        alone = ~ended & ~space & (run_b - run_a > 1)
        starts = np.sort(np.concatenate([first, tail[cut], run_a[rest], run_b[alone] - 1]))
        which = np.searchsorted(block.end, starts, side="right")
        ends = np.append(starts[1:], 0)
        last = np.append(which[1:] != which[:-1], True)[: len(starts)]
        ends[last] = block.end[which[last]]
        return starts, ends, which

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, all ids of a block of texts, where each text's ids begin and the end)."""
        for i, block in blocks(texts):
            a, b, which = self._pieces(block)
            keys, at, inv = np.unique(block.hashes(a, b), return_index=True, return_inverse=True)
            known, got = self.memo.get, keys.tolist()
            found = [known(k) for k in got]
            odd = self._odd(block)
            if None in found:
                new = {got[j]: block.data[a[at[j]] : b[at[j]]].tobytes() for j, x in enumerate(found) if x is None}
                if odd.any():  # pieces of such texts may be cut at the wrong place, and are not used
                    good = set(keys[np.unique(inv[~odd[which]])].tolist())
                    new = {k: v for k, v in new.items() if k in good}
                learnt = self._learn(new)
                if len(self.memo) + len(learnt) <= MEMO_PIECES:
                    self.memo.update(learnt)
                found = [x if x is not None else learnt.get(k, b"") for k, x in zip(got, found, strict=True)]
            flat = np.frombuffer(b"".join(found), np.uint32)
            size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
            off = np.cumsum(size) - size
            n = size[inv]
            first = np.cumsum(n) - n
            ids = flat[np.repeat(off[inv] - first, n) + np.arange(int(n.sum()))] if len(n) else np.zeros(0, np.uint32)
            total = np.zeros(len(block) + 1, np.int64)
            total[1:] = np.cumsum(np.bincount(which, weights=n, minlength=len(block)).astype(np.int64)) if len(n) else 0
            if odd.any():
                parts = [ids[total[k] : total[k + 1]] for k in range(len(block))]
                for k in np.flatnonzero(odd):
                    parts[k] = np.frombuffer(self.whole(block.data[block.start[k] : block.end[k]].tobytes().decode()), np.uint32)
                ids = np.concatenate(parts)
                total[1:] = np.cumsum([len(x) for x in parts])
            yield i, ids, total


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, made once."""
    if path not in _kept:
        _kept[path] = Encoder(path)
    return _kept[path]


def forget() -> None:
    """Give up a worker's encoders and their memos, as it turns to other work."""
    if _kept:
        _kept.clear()
        release()


def release() -> None:
    """Hand memory that is free in this worker back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc: what is freed stays with the process
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, and then release: an idle worker holds little."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return tidied
