"""Vectorised words, lines and word windows over blocks of UTF-8 texts.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.  All of those are
ASCII, so splitting bytes and splitting code points give the same words.

Hashes are 64 bits: a polynomial over random byte codes in the ring of
integers modulo 2**64, taken from prefix sums, then mixed.  The base is odd and
so has an inverse, which makes the hash of a span independent of where the
span stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 5, 0xD6E8FEB86659FD93 | 5
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_CODES = stream(256, 17)
_FOLDED = _CODES.copy()
_FOLDED[65:91] = _CODES[97:123]


class Memo(dict):
    """A cache that stays behind when the functions that use it are sent to workers."""

    def __reduce__(self):
        return Memo, ()


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = Memo()


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 1024)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = (both[0], both[1])
        if size <= 2 * BLOCK_BYTES:
            _powers[base] = have
    return have


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=out[1:])
    return out


class TextBlock:
    """Some whole texts: ``buf`` holds their bytes end to end, ``offs`` where each begins, then the end."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, word_bytes: np.ndarray = _IS_WORD):
        self.buf, self.offs, self.n = buf, offs, len(offs) - 1
        m = word_bytes[buf]
        first, last = m.copy(), m.copy()
        if len(m):
            first[1:] &= ~m[:-1]
            last[:-1] &= ~m[1:]
            full = offs[1:] > offs[:-1]
            a, b = offs[:-1][full], offs[1:][full] - 1
            first[a] |= m[a]
            last[b] |= m[b]
        self.in_word = m
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: words of text d are woff[d]:woff[d + 1]
        self.woff = np.searchsorted(self.starts, offs)
        self._sums: dict[bool, np.ndarray] = {}

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.woff)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
        p, inv = powers(_BASE, len(self.buf) + 1)
        if fold not in self._sums:
            self._sums[fold] = _prefix((_FOLDED if fold else _CODES)[self.buf] * p[: len(self.buf)])
        c = self._sums[fold]
        return mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(U) * U(0xA24BAED4963EE407))

    def word_hashes(self, fold: bool = False) -> np.ndarray:
        return self.span_hash(self.starts, self.ends, fold)

    def windows(self, k: int, words: np.ndarray, offs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words within a text, and the place of each one's first word."""
        at = self.window_starts(k, offs)
        return self.run_hash(words, at, at + k), at

    def window_starts(self, k: int, offs: np.ndarray | None = None) -> np.ndarray:
        offs = self.woff if offs is None else offs
        ok = np.ones(offs[-1], bool)
        for j in range(1, k):
            at = offs[1:] - j
            ok[at[at >= offs[:-1]]] = False
        return np.flatnonzero(ok)

    @staticmethod
    def run_hash(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        p, inv = powers(_WORD_BASE, len(words) + 1)
        c = _prefix(words * p[: len(words)])
        return mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(U))

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the \\n-split lines, and the text of each; an empty text has one empty line."""
        nl = np.flatnonzero(self.buf == 10)
        starts = np.concatenate([self.offs[:-1], nl + 1])
        ends = np.concatenate([nl, self.offs[1:]])
        texts = np.concatenate([np.arange(self.n), np.searchsorted(self.offs[1:], nl, side="right")])
        order = np.lexsort((starts, texts))
        by_end = np.lexsort((ends, np.concatenate([texts[self.n :], np.arange(self.n)])))
        return starts[order], ends[by_end], texts[order]

    def text_bytes(self, d: int) -> bytes:
        return self.buf[self.offs[d] : self.offs[d + 1]].tobytes()


def repeated(keys: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items of texts, which have an equal item in the same text, and which are the first of their kind in it."""
    own = keys ^ mix(texts.astype(U) + U(1))
    order = np.argsort(own, kind="stable")
    s = own[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    dup = ~new
    dup[:-1] |= ~new[1:]
    first, twice = np.empty(len(s), bool), np.empty(len(s), bool)
    first[order], twice[order] = new, dup
    return twice, first


def per_text(offs: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of an Arrow string or binary array; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offs = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES, word_bytes: np.ndarray = _IS_WORD) -> Iterator[tuple[pa.RecordBatch, TextBlock]]:
    """Cut batches into runs of rows whose texts have ``most`` bytes or fewer together; a longer text stands alone."""
    for batch in batches:
        buf, offs = bytes_of(column(batch, text))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
            yield batch.slice(i, j - i), TextBlock(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], word_bytes)
            i = j
