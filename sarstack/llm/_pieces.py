"""Encoding by the public ``tokenizers`` library, one distinct piece at a time.

Both tokenizers split a text into pre-tokens before any merge, and a single
space between two other characters is always such a split. So a text may be
cut there, each distinct piece encoded once by the library, and the results
put together again; a text where a cut would not be safe is encoded whole.
Memory is bounded: a cache takes no more once it holds ``limit`` pieces.
"""

from __future__ import annotations

import functools
import hashlib
import os

import numpy as np

from ._bytes import Block, Ids

U = np.uint64
LIMIT = 250_000
ENCODER_LIMIT = 500_000  # about 60 bytes each
_LONG = 64  # longer pieces are not kept
_MAY_LEAD = np.zeros(256, bool)  # bytes that may begin a white-space character of several bytes
_MAY_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file, on whichever machine asks."""
    import public_tokenizers

    return name if os.path.sep in name else public_tokenizers.path(name)


def load(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(name))
    t.no_truncation()
    t.no_padding()
    return t


def version(name: str) -> str:
    """Digest of the tokenizer's file: what a stored count depends on."""
    with open(tokenizer_file(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Encoder:
    """Ids of whole texts for byte-level tokenizers with the usual pre-token pattern.

    The pattern lets a pre-token begin with one space but never hold or end
    with white space, and a newline between other characters is one of its
    own. So a cut before a single space or around a single newline is exact
    where neither neighbour is white space. Where a neighbour may be (any
    control, or a character that Unicode counts as space) no cut is made, and
    the longer piece goes to the library as it is.

    Pieces are found, hashed and looked up for a block of texts at once; only
    distinct pieces that the cache lacks become strings. A row of the cache
    serves a piece if their identities are equal, not their hashes alone.
    """

    def __init__(self, name: str, limit: int = ENCODER_LIMIT):
        self.t, self.limit = load(name), limit
        self.width = "<u2" if self.t.get_vocab_size() <= 1 << 16 else "<u4"
        nl = self._ids("\n")
        self.nl = nl[0] if len(nl) == 1 else None
        self.keys, self.rows = np.empty(0, U), np.empty(0, np.int64)  # sorted hashes and their rows
        self.new_keys, self.new_rows = np.empty(0, U), np.empty(0, np.int64)  # the same, not merged yet
        self.ids = np.empty(1 << 20, self.width)
        self.at, self.n = np.zeros(1 << 18, np.int64), 0  # row r holds ids[at[r]:at[r + 1]]
        self.exact = np.zeros((2, 1 << 18), U)  # each row's piece: its identity

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.t.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.width)

    def _learn(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of distinct pieces: in one go, a newline between them, where that is safe."""
        plain = [i for i, p in enumerate(pieces) if "\n" not in p and not p[-1].isspace() and not p[1:2].isspace()]
        out: list = [None] * len(pieces)
        if self.nl is not None and plain:
            ids = self._ids("\n".join(pieces[i] for i in plain))
            parts = np.split(ids, np.flatnonzero(ids == self.nl))
            if len(parts) == len(plain):
                for k, (i, x) in enumerate(zip(plain, parts, strict=True)):
                    out[i] = x[1:] if k else x
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.t.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, self.width)
        return out

    def _add(self, found: list[np.ndarray], exact: np.ndarray) -> np.ndarray:
        """Append rows; returns their numbers."""
        size = np.array([len(x) for x in found], np.int64)
        end = self.at[self.n] + int(size.sum())
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(end, len(self.ids)), self.width)])
        if self.n + len(found) + 1 > len(self.at):
            more = max(len(found), len(self.at))
            self.at = np.concatenate([self.at, np.zeros(more, np.int64)])
            self.exact = np.concatenate([self.exact, np.zeros((2, more), U)], axis=1)
        self.ids[self.at[self.n] : end] = np.concatenate(found)
        self.at[self.n + 1 : self.n + 1 + len(found)] = self.at[self.n] + np.cumsum(size)
        self.exact[:, self.n : self.n + len(found)] = exact
        self.n += len(found)
        return np.arange(self.n - len(found), self.n)

    @staticmethod
    def _find(keys: np.ndarray, rows: np.ndarray, want: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.full(len(want), -1)
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[at] == want, rows[at], -1)

    def cuts(self, block: Block) -> np.ndarray:
        """Starts of all pieces; the first of each non-empty text is its own start."""
        b = block.buf
        if not len(b):
            return np.empty(0, np.int64)
        hard = b > 0x20  # no control or space
        before, after = np.zeros(len(b), bool), np.zeros(len(b), bool)
        before[1:], after[:-1] = hard[:-1], hard[1:]
        after[:-1] &= ~_MAY_LEAD[b[1:]]
        spots = np.flatnonzero(((b == 32) | (b == 10)) & before & after)
        begins = np.zeros(len(b) + 1, bool)
        begins[block.offs] = True
        spots = spots[~begins[spots] & ~begins[spots + 1]]  # a text's first byte has nothing before it, its last nothing after
        p1, p2, p3 = b[spots - 1], b[np.maximum(spots - 2, 0)], b[np.maximum(spots - 3, 0)]
        spots = spots[~((p1 >= 0x80) & ((p2 == 0xC2) | ((p3 >= 0xE1) & (p3 <= 0xE3))))]
        return np.sort(np.concatenate([block.offs[:-1][block.lens > 0], spots, spots[b[spots] == 10] + 1]))

    def encode_block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's first (n + 1)."""
        starts = self.cuts(block)
        if not len(starts):
            return np.empty(0, self.width), np.zeros(block.n + 1, np.int64)
        ends = np.append(starts[1:], len(block.buf))
        pieces = Ids(block.buf, starts, ends)
        inv, pick = pieces.codes()
        uniq, exact = pieces.hashes()[pick], np.stack([pieces.lo[pick], pieces.hi[pick]])
        row = self._find(self.keys, self.rows, uniq)
        row = np.where(row < 0, self._find(self.new_keys, self.new_rows, uniq), row)
        row[(self.exact[:, row] != exact).any(0)] = -1
        miss = np.flatnonzero(row < 0)
        kept = self.n
        if len(miss):
            raw = block.buf.tobytes()
            row[miss] = self._add(self._learn([raw[starts[i] : ends[i]].decode() for i in pick[miss].tolist()]), exact[:, miss])
        size = (self.at[row + 1] - self.at[row])[inv]
        to = np.concatenate([[0], np.cumsum(size)])
        out = self.ids[np.repeat(self.at[row][inv] - to[:-1], size) + np.arange(to[-1])]
        if len(miss):
            if kept < self.limit:
                keys, rows = np.concatenate([self.new_keys, uniq[miss]]), np.concatenate([self.new_rows, row[miss]])
                order = np.argsort(keys)
                self.new_keys, self.new_rows = keys[order], rows[order]
                if len(keys) > 1 << 16:
                    keys, rows = np.concatenate([self.keys, self.new_keys]), np.concatenate([self.rows, self.new_rows])
                    order = np.argsort(keys, kind="stable")
                    self.keys, self.rows = keys[order], rows[order]
                    self.new_keys, self.new_rows = np.empty(0, U), np.empty(0, np.int64)
            else:
                self.n = kept  # full: what was new serves this block only
        return out, to[np.searchsorted(starts, block.offs)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        raw = [t.encode() for t in texts]
        ids, first = self.encode_block(Block(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)))
        return [ids[a:z].tobytes() for a, z in zip(first[:-1], first[1:], strict=True)]


class _Both(dict):
    """What is new, and the cache behind it."""

    def __init__(self, cache: dict[str, int], new: dict[str, int]):
        super().__init__(new)
        self.cache = cache

    def __missing__(self, p: str) -> int:
        return self.cache[p]


class Counter:
    """Token counts of whole texts for tokenizers that drop white space.

    Every space and newline is a split for such a tokenizer; other white space
    stays inside the pieces, which the library encodes.
    """

    def __init__(self, name: str, limit: int = LIMIT):
        self.t, self.limit = load(name), limit
        self.cache: dict[str, int] = {"": 0}

    def count(self, texts: list[str]) -> list[int]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        miss = [p for p in set().union(*split) if p not in self.cache]
        new = {p: len(e.ids) for p, e in zip(miss, self.t.encode_batch_fast(miss, add_special_tokens=False), strict=True)}
        if len(self.cache) < self.limit:
            self.cache.update((p, n) for p, n in new.items() if len(p) <= _LONG)
        get = _Both(self.cache, new).__getitem__
        return [sum(map(get, s)) for s in split]


class SentencePieceCounter:
    """Token counts by a sentencepiece model; its pieces cross spaces, so texts go whole."""

    def __init__(self, name: str):
        import sentencepiece

        self.p = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(name))

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.p.encode(texts, num_threads=1)]


class WholeCounter:
    """Token counts by the library over whole texts, for any other tokenizer."""

    def __init__(self, name: str):
        self.t = load(name)

    def count(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]


@functools.lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    """This process's encoder: its cache serves all tasks that the process runs."""
    return Encoder(name)


@functools.lru_cache(maxsize=4)
def counter(name: str):
    """This process's counter for a tokenizer file."""
    if name.endswith(".model"):
        return SentencePieceCounter(name)
    import json

    with open(tokenizer_file(name), encoding="utf-8") as f:
        return Counter(name) if splits_at_spaces(json.load(f)) else WholeCounter(name)


#: Patterns of which no match holds white space.
_NO_SPACE_PATTERNS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)
#: Normalizers that act alike on a text and on its parts between spaces and newlines.
_BY_PART = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents", "Nmt"}


def splits_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer's counts are the sums over the parts between spaces and newlines.

    So it is where the first pre-tokenizer keeps only matches and none of them
    holds white space, the normalizer works on each part alone (a replacement
    of white space by a space does), no added token has white space or needs a
    word's edge, and nothing is added after.
    """
    norm = spec.get("normalizer")
    steps = norm["normalizers"] if norm and norm["type"] == "Sequence" else [norm] if norm else []
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    return (
        all(x["type"] in _BY_PART or x == spaces for x in steps)
        and first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and bool(first.get("invert"))
        and first["pattern"].get("Regex") in _NO_SPACE_PATTERNS
        and not any(t["single_word"] or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    )
