"""Texts as one byte array: words, lines and shingles without Python loops.

A block of documents is a ``uint8`` buffer with ``int64`` offsets. Words are
the runs of ``[^\\x20\\x09-\\x0D]``; A-Z are lower-cased where asked.

A string's identity is 128 bits: its length and bytes up to 15 of them, the
BLAKE2b digest of longer ones. Where strings of a block are compared, it is
by identity, hence exactly. Beyond a block a word stands for itself by the
64-bit SipHash-1-3 of its identity, a line by 128 bits. Neither has the linear
structure by which chosen texts of a sum or polynomial would collide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NONSPACE = ~SPACE
BLOCK_BYTES = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)  # the first k bytes of a little-endian word

_rng = np.random.default_rng(20240101)
MULT = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_KEY = (MULT[0], MULT[1])
_AT_ONCE = 16_384  # words whose state stays in a core's cache


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << U(bits)) | (x >> U(64 - bits))


def siphash(parts: tuple[np.ndarray, ...]) -> np.ndarray:
    """SipHash-1-3 of records of as many 64-bit words as there are arrays."""
    if (n := len(parts[0])) > _AT_ONCE:
        return np.concatenate([siphash(tuple(p[i : i + _AT_ONCE] for p in parts)) for i in range(0, n, _AT_ONCE)])
    # the four words are the published initial state
    v = [k ^ U(c) for k, c in zip(_KEY * 2, (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573), strict=True)]
    v = [np.full(len(parts[0]), x, U) for x in v]

    def turn() -> None:
        v[0] += v[1]
        v[2] += v[3]
        v[1], v[3] = _turn(v[1], 13) ^ v[0], _turn(v[3], 16) ^ v[2]
        v[0] = _turn(v[0], 32)
        v[2] += v[1]
        v[0] += v[3]
        v[1], v[3] = _turn(v[1], 17) ^ v[2], _turn(v[3], 21) ^ v[0]
        v[2] = _turn(v[2], 32)

    for m in parts:
        v[3] ^= m
        turn()
        v[0] ^= m
    v[2] ^= U(0xFF)
    for _ in range(3):
        turn()
    return v[0] ^ v[1] ^ v[2] ^ v[3]


class Ids:
    """Identities of strings ``data[starts:ends]``."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        padded = np.concatenate([data, np.zeros(24, np.uint8)])
        at = np.ndarray((len(data) + 16,), "<u8", padded, strides=(1,))
        self.starts, self._hashes = starts, None
        n = ends - starts
        self.lo = at[starts] & _MASK[np.minimum(n, 8)]
        self.hi = (at[starts + 8] & _MASK[np.clip(n - 8, 0, 8)]) | (n.astype(U) << U(56))
        long = np.flatnonzero(n > 15)
        if len(long):
            raw = data.tobytes()
            d = b"".join([hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)])
            self.lo[long], self.hi[long] = np.frombuffer(d, "<u8").reshape(-1, 2).T

    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = siphash((self.lo, self.hi))
        return self._hashes

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Exact code of each string, in order of the hashes, and where one string of each code is."""
        return exact_codes(self.hashes(), self.lo, self.hi)


def exact_codes(h: np.ndarray, *exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes 0, 1, ... of records ``exact`` with hashes ``h``, and one row of each code."""
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    for x in exact:
        if (x[order][1:] != x[order][:-1])[~new[1:]].any():  # unequal records of one hash
            _, one, code = np.unique(np.stack([e.astype(U) for e in exact], 1), axis=0, return_index=True, return_inverse=True)
            return code.ravel(), one
    code = np.empty(len(h), np.int64)
    code[order] = np.cumsum(new) - 1
    return code, order[new]


def pair_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One exact non-negative code for each pair of non-negative codes."""
    if not len(a):
        return a
    high, low = int(a.max()) + 1, int(b.max()) + 1
    if high * low >= 1 << 63:  # then by ranks, which are below the number of pairs
        a, b = np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]
        low = int(b.max()) + 1
    return a * low + b


class Block:
    """Some documents' texts, back to back."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs, self.n = buf, offs, len(offs) - 1
        self.lens = np.diff(offs)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, and for each document the index of its first word (n + 1)."""
        ns = NONSPACE[self.buf]
        if not len(ns):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(self.n + 1, np.int64)
        first, last = ns.copy(), ns.copy()
        first[1:] &= ~ns[:-1]
        last[:-1] &= ~ns[1:]
        full = self.lens > 0
        a, z = self.offs[:-1][full], self.offs[1:][full] - 1
        first[a], last[z] = ns[a], ns[z]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.offs)

    def word_ids(self, lower: bool) -> tuple[Ids, np.ndarray]:
        """Identities of all words, and the documents' first words."""
        starts, ends, first = self.words()
        return Ids(LOWER[self.buf] if lower else self.buf, starts, ends), first

    def word_hashes(self, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hash of each word, and the documents' first words."""
        ids, first = self.word_ids(lower)
        return ids.hashes(), first

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends without the newline, and each document's first line (n + 1).

        An empty document has one empty line.
        """
        cut = np.flatnonzero(self.buf == 10)
        doc = np.searchsorted(self.offs, cut, side="right") - 1
        per = np.bincount(doc, minlength=self.n) + 1
        first = np.concatenate([[0], np.cumsum(per)])
        starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
        starts[first[:-1]], ends[first[1:] - 1] = self.offs[:-1], self.offs[1:]
        inner = np.ones(first[-1], bool)
        inner[first[:-1]] = False
        starts[inner] = cut + 1
        inner = np.ones(first[-1], bool)
        inner[first[1:] - 1] = False
        ends[inner] = cut
        return starts, ends, first

    def count(self, table: np.ndarray) -> np.ndarray:
        """Bytes of each document for which ``table`` holds."""
        return np.diff(np.searchsorted(np.flatnonzero(table[self.buf]), self.offs))


def unique(a: np.ndarray) -> np.ndarray:
    """Distinct values, ascending, by sorting."""
    a = np.sort(a)
    keep = np.ones(len(a), bool)
    keep[1:] = a[1:] != a[:-1]
    return a[keep]


def owner(first: np.ndarray) -> np.ndarray:
    """The document of each word or line, from the documents' first indices."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and each document's first window (n + 1).

    A document with 1 to k-1 words has one window, its whole sequence. Words
    enter one after the other, each through a product and a shift, so that no
    sum of word hashes stands for another.
    """
    per = np.diff(first)
    full = np.maximum(per - (k - 1), 0)
    short = (per > 0) & (per < k)
    begin = np.concatenate([[0], np.cumsum(full + short)])
    at = np.repeat(first[:-1] - begin[:-1], full + short) + np.arange(begin[-1])
    size = np.repeat(np.minimum(per, k), full + short)
    out = size.astype(U) * MULT[63]
    last, some = len(words) - 1, short.any()
    for j in range(k if len(words) else 0):
        h = (out ^ words[np.minimum(at + j, last)]) * MULT[j]
        h ^= h >> U(32)
        out = np.where(j < size, h, out) if some else h
    return mix(out), begin


def windows(code: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact codes of the k-word windows of documents with k words or more, and each window's first word."""
    full = np.maximum(np.diff(first) - (k - 1), 0)
    begin = np.concatenate([[0], np.cumsum(full)])
    at = np.repeat(first[:-1] - begin[:-1], full) + np.arange(begin[-1])
    out = code[at]
    for j in range(1, k):
        out = pair_codes(out, code[at + j])
    return out, at


def distinct(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct keys in ascending order, and their first indices."""
    doc = owner(first)
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    keep = np.ones(len(k), bool)
    keep[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    k, d = k[keep], d[keep]
    return k, np.searchsorted(d, np.arange(len(first)))


def repeated(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: this code occurs more than once in its document; and it occurred before."""
    n = len(code)
    again, before = np.zeros(n, bool), np.zeros(n, bool)
    if n > 1:
        k = pair_codes(code, doc)
        order = np.argsort(k, kind="stable")
        same = k[order][1:] == k[order][:-1]
        before[order[1:][same]] = True
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
    return again, before


def blocks(batch: pa.RecordBatch | pa.Table, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """Cut a batch into runs of rows of about ``limit`` bytes of text; null is empty.

    Yields first row, end row, block. One document is never cut: a run holds
    at least one row, so memory follows the longest text, not the batch.
    """
    col = batch.column(column)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, len(col))
        yield i, j, Block(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j
