"""Distinct word-shingle sets as 64-bit hashes, computed for a block of texts at a time.

Words are runs without space and tab..carriage return, A-Z in lower case.  A set holds the hashes of all
runs of ``width`` words; a shorter text has its whole word sequence as its one member, a text without
words the empty set.  Two members are taken as equal when their 64-bit hashes are: a word's is xxh3 of its bytes,
taken once per different word of a block, a member's is scrambled after every word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
_CLEAN = bytes(32 if b in b"\x20\x09\x0a\x0b\x0c\x0d" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_SEED = 20240501


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Codes:
    """Byte strings given as one body and their lengths: a number for each (equal ones share it), and the different ones."""

    def __init__(self, body: np.ndarray, lengths: np.ndarray):
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.count = len(coded.dictionary)
        _, at, raw = coded.dictionary.buffers()
        self.at = np.frombuffer(at, np.int64)[:self.count + 1].tolist() if self.count else [0]
        self.raw = raw.to_pybytes() if raw is not None else b""

    def __getitem__(self, k: int) -> bytes:
        return self.raw[self.at[k]:self.at[k + 1]]

    def hashes(self, seed: int) -> np.ndarray:
        """xxh3 of every different one."""
        raw, at, digest = self.raw, self.at, xxhash.xxh3_64_intdigest
        return np.array([digest(raw[a:b], seed) for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word of a block of texts, in order."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw).translate(_CLEAN) + b" ", np.uint8)
    first = np.cumsum([0, *(len(r) + 1 for r in raw)])[:-1]  # each text's first byte
    inside = data != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside])))
    start, end = edge[::2], edge[1::2]
    words = Codes(data[inside], end - start)
    return np.searchsorted(first, start, "right") - 1, words.hashes(_SEED)[words.code]


def shingle_sets(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, member hash) of all distinct members, ascending by both."""
    owner, word = word_hashes(texts)
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def fold(lo: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(lo), n, np.uint64)
        for j in range(n):
            h = mix(h * _U(0xD1342543DE82EF95) + word[lo + j])
        return h

    at = np.arange(len(word))
    full = at[:len(word) - width + 1] if len(word) >= width else at[:0]
    full = full[owner[full] == owner[full + width - 1]]
    docs, hashes = [owner[full]], [fold(full, width)]
    begin = np.flatnonzero(np.diff(np.concatenate([[-1], owner])))
    count = np.diff(np.concatenate([begin, [len(word)]]))
    for n in range(1, width):
        lo = begin[count == n]
        docs.append(owner[lo])
        hashes.append(fold(lo, n))
    d, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[new], h[new]


def set_digests(docs: np.ndarray, hashes: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, 64-bit digest) of each text's set, independent of order; equal sets have equal digests."""
    size = np.bincount(docs, minlength=n_docs).astype(np.int64)
    digest = np.zeros(n_docs, np.uint64)
    have = np.flatnonzero(size)
    if len(have):
        lo = np.concatenate([[0], np.cumsum(size[have])[:-1]])
        digest[have] = mix(np.add.reduceat(mix(hashes ^ _U(0xA0761D6478BD642F)), lo) + size[have].astype(np.uint64))
    return size, digest
