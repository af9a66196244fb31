"""Polynomial hashes modulo 2^64 in numpy, and terms of UTF-8 texts by them."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text whose terms are found at once (more only for one longer term).
WINDOW = 1 << 20

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_TERM = np.array([chr(i).isalnum() or i > 127 for i in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads a hash over all 64 bits (one to one)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """``base ** i`` for i below ``n``, modulo 2^64."""
    out = np.full(max(n, 1), base)
    out[0] = 1
    return np.cumprod(out)[:n]


_TABLES: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > WINDOW:
        return powers(n), powers(n, _INVERSE)
    if not _TABLES:
        _TABLES.extend((powers(WINDOW), powers(WINDOW, _INVERSE)))
    return _TABLES[0][:n], _TABLES[1][:n]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array (null: empty) and its offsets."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0]:at[-1]], at - at[0]


def text_terms(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW):
    """Terms of adjoining texts, in parts: (text number, hash, start, length).

    A term is a maximal run of ASCII letters, digits and bytes from 0x80 on
    (that is, of code points outside ASCII); A-Z count as a-z.  The hash is
    that of :func:`term_hash`.
    """
    end, a = len(data), 0
    while a < end:
        size = window
        while True:
            b = min(end, a + size)
            inside = _TERM[data[a:b]]
            if b == end:
                break
            # cut behind the last byte that is no term's, or where a text ends
            gap = int(np.argmin(inside[::-1]))
            cut = b - gap if not inside[-1 - gap] else a
            edge = int(offsets[np.searchsorted(offsets, b, side="right") - 1])
            cut = max(cut, edge)
            if cut > a:
                b = cut
                inside = inside[:b - a]
                break
            size *= 2
        n = b - a
        edges = offsets[(offsets >= a) & (offsets < b)] - a
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        before = edges[edges > 0] - 1
        last[before] = inside[before]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, back = _tables(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_LOWER[data[a:b]] * power, out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * back[starts])
        yield np.searchsorted(offsets, starts + a, side="right") - 1, hashes, starts + a, ends - starts
        a = b


def term_hash(term: str) -> int:
    data = np.frombuffer(term.encode(), np.uint8)
    return int(mix(np.array([(_LOWER[data] * powers(len(data))).sum(dtype=np.uint64)]))[0])


class TermSet:
    """Terms (lower-cased already) that are looked for in texts."""

    def __init__(self, terms: list[str]):
        self.terms = [t.encode() for t in terms]
        hashes = np.array([term_hash(t) for t in terms], dtype=np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes
        self.sorted = hashes[self.order]
        self.sizes = np.array([len(t) for t in self.terms], dtype=np.int64)
        self.bytes = {}
        self.row = np.zeros(len(terms), dtype=np.int64)
        for size in np.unique(self.sizes).tolist():
            some = np.flatnonzero(self.sizes == size)
            self.row[some] = np.arange(len(some))
            self.bytes[size] = np.frombuffer(b"".join(self.terms[i] for i in some), np.uint8).reshape(len(some), size)
        runs = np.unique(self.sorted, return_counts=True)[1]
        self.most = int(runs.max()) if len(runs) else 0

    def find(self, data: np.ndarray, text: np.ndarray, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """(text number, term number) of the terms that are in the set, each
        confirmed byte by byte."""
        low = np.searchsorted(self.sorted, hashes)
        texts, found = [], []
        for k in range(self.most):
            at = np.minimum(low + k, len(self.sorted) - 1)
            hit = np.flatnonzero((self.sorted[at] == hashes) & (low + k < len(self.sorted)))
            term = self.order[at[hit]]
            same = self.sizes[term] == sizes[hit]
            hit, term = hit[same], term[same]
            good = np.zeros(len(hit), dtype=bool)
            for size in np.unique(sizes[hit]).tolist():
                some = np.flatnonzero(sizes[hit] == size)
                for a in range(0, len(some), max(1, WINDOW // size)):
                    part = some[a:a + max(1, WINDOW // size)]
                    there = _LOWER8[data[starts[hit[part], None] + np.arange(size)]]
                    good[part] = (there == self.bytes[size][self.row[term[part]]]).all(axis=1)
            texts.append(text[hit[good]])
            found.append(term[good])
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(texts), np.concatenate(found)


_LOWER8 = _LOWER.astype(np.uint8)
