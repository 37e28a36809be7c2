"""Word shingles as sorted arrays of 64-bit hashes, computed over whole batches with numpy."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64
_BYTE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
#: Bytes of text hashed together; a longer document stands alone.  A worker takes some 40 bytes of memory for each.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0x9E3779B97F4A7C15, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of several texts in one buffer: hashes, first bytes and lengths, and where each text's words begin."""

    def __init__(self, texts: list[bytes]):
        self.buffer = joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        self.ends_of_text = np.cumsum([len(t) + 1 for t in texts])
        space = _SPACE[joined]
        before = np.empty_like(space)
        before[0], before[1:] = True, space[:-1]
        self.starts = np.flatnonzero(~space & before)
        self.lengths = np.flatnonzero(space & ~before) - self.starts
        self.begins = np.concatenate([[0], np.searchsorted(self.starts, self.ends_of_text)])
        self.hashes = np.empty(0, np.uint64)
        if len(self.starts):
            first = np.cumsum(self.lengths) - self.lengths
            at = np.flatnonzero(~space)
            place = np.arange(len(at)) - np.repeat(first, self.lengths)
            values = _BYTE[joined[at]] * _powers(int(self.lengths.max()))[place]
            self.hashes = mix(np.add.reduceat(values, first) + self.lengths.astype(np.uint64))


def shingle_sets(texts: list[str | None], n: int):
    """For each text the sorted distinct hashes of its n-word shingles; of fewer words, one of the whole sequence."""
    for chunk in chunks((text or "").encode().lower() for text in texts):
        yield from _sets(chunk, n)


def chunks(texts):
    """Consecutive texts of about CHUNK bytes together."""
    chunk: list[bytes] = []
    size = 0
    for raw in texts:
        if chunk and size + len(raw) > CHUNK:
            yield chunk
            chunk, size = [], 0
        chunk.append(raw)
        size += len(raw)
    if chunk:
        yield chunk


def _sets(texts: list[bytes], n: int):
    found = Words(texts)
    words, begins = found.hashes, found.begins
    runs = words
    for j in range(1, n):
        runs = mix(runs[: max(len(words) - j, 0)] * _U(3) + words[j:])
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(runs[a : b - n + 1])
        elif b > a:
            one = words[a : a + 1] + _U(b - a)
            for j in range(a + 1, b):
                one = mix(one * _U(5) + words[j : j + 1])
            yield one
        else:
            yield np.empty(0, np.uint64)
