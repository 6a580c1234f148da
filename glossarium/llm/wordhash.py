"""Words of many texts at once, hashed with numpy; used by operators that run in Python workers.

A text's words are runs of bytes other than 0x20 and 0x09-0x0D.  The hash of a word is a polynomial of its bytes modulo 2**64
(prefix sums give every word's value without a loop), mixed afterwards.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together; a longer text is hashed alone.
CHUNK = 1 << 19
#: Rows of a batch that are taken out of it together.
ROWS = 1000
#: Bytes from which on a word has a hash of another kind.
LONG_WORD = 512
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 65536), _BASE if name == "base" else _INVERSE, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= CHUNK + 65536:
            _powers[name] = have
    return have


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NOT_LETTER = np.ones(256, dtype=bool)
_NOT_LETTER[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False
_EXACT = mix(np.arange(1, 257, dtype=np.uint64) * _BASE) | np.uint64(1)
_FOLDED = _EXACT.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _EXACT[ord("a") : ord("z") + 1]


class Words:
    """The words of some texts: `data` bytes, `start` and `end` of each word in them, `hash`, and `first`, each text's first word (one more at the end)."""

    def __init__(self, texts: list[bytes], fold: bool, letters: bool = False) -> None:
        self.data = b" ".join(texts) + b" "
        raw = np.frombuffer(self.data, dtype=np.uint8)
        space = (_NOT_LETTER if letters else _SPACE)[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(raw) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, offsets)
        self.sums = sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((_FOLDED if fold else _EXACT)[raw] * _power("base", len(raw))[: len(raw)], out=sums[1:])
        length = (self.end - self.start).astype(np.uint64)
        self.hash = mix((sums[self.end] - sums[self.start]) * _power("inverse", len(raw))[self.start] + length * np.uint64(0xD6E8FEB86659FD93))
        for k in np.flatnonzero(self.end - self.start >= LONG_WORD):  # a polynomial modulo 2**64 has known collisions among these
            own = self.data[self.start[k] : self.end[k]]
            self.hash[k] = int.from_bytes(hashlib.blake2b(own.lower() if fold else own, digest_size=8).digest(), "little")

    def prefixes(self, n: int) -> np.ndarray:
        """Hash of the first n bytes of each word (of all of it where it is no longer)."""
        length = np.minimum(self.end - self.start, n)
        inverse = _power("inverse", len(self.data))
        return mix((self.sums[self.start + length] - self.sums[self.start]) * inverse[self.start] + np.uint64(n))

    def packed(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words with one space between any two, and each word's start and end in that."""
        raw = np.frombuffer(self.data, dtype=np.uint8)
        keep = ~_SPACE[raw]
        keep[self.end] = True
        out = raw[keep]
        out[_SPACE[out]] = 0x20
        place = np.cumsum(keep)
        return out.tobytes(), place[self.start] - 1, place[self.end - 1]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ROWS, so that a worker holds few texts as objects of their own."""
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield b.slice(k, ROWS)


def texts_of(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    """A text column's values as UTF-8, without a detour by str."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def groups(texts: list[str | bytes | None]) -> Iterator[tuple[int, int, list[bytes]]]:
    """Consecutive texts of about CHUNK bytes together, as UTF-8, with their places [start, stop); a longer text comes alone."""
    at, size, own = 0, 0, []
    for k, t in enumerate(texts):
        b = t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") if t else b""
        if own and size + len(b) > CHUNK:
            yield at, k, own
            at, size, own = k, 0, []
        own.append(b)
        size += len(b) + 1
    if own:
        yield at, len(texts), own


def chunks(ids: list, texts: list[str | bytes | None], fold: bool, letters: bool = False) -> Iterator[tuple[list, Words]]:
    """groups() as words.  letters: words are runs of ASCII letters and digits and bytes beyond ASCII."""
    for start, stop, own in groups(texts):
        yield ids[start:stop], Words(own, fold, letters)


_GAP, _WORD = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[^\x20\x09-\x0D]+")


def pieces(raw: bytes, overlap: int) -> Iterator[tuple[bytes, int]]:
    """A text in pieces of about CHUNK bytes, cut at white space, with the number of each one's first word; a piece begins
    `overlap` words before the end of the one before, so that all runs of overlap + 1 words stand whole in one piece."""
    at, first, size = 0, 0, CHUNK
    while True:
        gap = _GAP.search(raw, at + size) if at + size < len(raw) else None
        if gap is None:
            yield raw[at:], first
            return
        cut, step = gap.start(), 4096
        while True:
            low = max(at, cut - step)
            last = [m.start() for m in _WORD.finditer(raw, low, cut)]
            if len(last) > overlap or low == at:
                break
            step *= 4
        if len(last) <= overlap:  # few, huge words
            size *= 2
            continue
        own = raw[at:cut]
        yield own, first
        first += sum(1 for _ in _WORD.finditer(own)) - overlap
        at, size = last[-overlap] if overlap else cut, CHUNK


class Known:
    """A set of 64-bit values: which entries of an array are in it.  A bitmap of the first 20 bits spares most searches."""

    def __init__(self, values: np.ndarray) -> None:
        self.values, self.table = np.sort(values), np.zeros(1 << 20, dtype=bool)
        self.table[(self.values >> np.uint64(44)).astype(np.int64)] = True

    def has(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=bool)
        if len(self.values):
            maybe = np.flatnonzero(self.table[(x >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.values, x[maybe]), len(self.values) - 1)
            out[maybe[self.values[at] == x[maybe]]] = True
        return out


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes; entry i starts at word i (fewer entries than words by k - 1)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total, factor = np.zeros(n, dtype=np.uint64), 1
    for j in range(k):
        factor = factor * int(_BASE) % (1 << 64)
        total += hashes[j : j + n] * np.uint64(factor)
    return mix(total)


def long_windows(words: Words, k: int) -> np.ndarray:
    """As windows() with other values, by prefix sums: the cost does not follow k."""
    h = words.hash
    n = max(len(h) - k + 1, 0)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * _power("base", len(h))[: len(h)], out=sums[1:])
    return mix((sums[k : k + n] - sums[:n]) * _power("inverse", n)[:n])


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each text, one after another, and where each text's begin (one more at the end).

    A text of 1 to k - 1 words has one shingle, the whole; a text without words has none.
    """
    n = np.diff(words.first)
    of = np.repeat(np.arange(len(n)), n)
    h = windows(words.hash, k)
    ok = of[: len(h)] == of[k - 1 :] if len(h) else np.zeros(0, dtype=bool)
    value, text = h[ok], of[: len(h)][ok]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = []
        for t in short:
            own = words.hash[words.first[t] : words.first[t + 1]]
            whole.append(windows(np.concatenate([own, np.full(k - len(own), len(own), dtype=np.uint64)]), k)[0])
        value, text = np.concatenate([value, np.array(whole, dtype=np.uint64)]), np.concatenate([text, short])
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(len(n) + 1))
