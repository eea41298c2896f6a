"""Words of UTF-8 texts as numpy arrays: the fast path under the document operators.

A word is a run of bytes other than 0x20 and 0x09-0x0D. These bytes never occur inside a
multi-byte character, so working on bytes gives the same words as working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Multipliers of the hashes; any odd numbers do.
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03), U(0xAEF17502108EF2D9)
_TABLE = np.random.Generator(np.random.PCG64(20240601)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits."""
    h = h ^ (h >> U(31))
    h = h * U(0x7FB5D329728EA185)
    h = h ^ (h >> U(27))
    h = h * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of some texts: byte span, hash and document of each, in order.

    first[d]:first[d + 1] are the words of text d. `between` marks the bytes that part words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, hashes: bool = True, between: np.ndarray = _SPACE):
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        n = len(texts)
        _, offs, data = texts.buffers()
        off = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        self.off = off - off[0]
        self.raw = raw
        space = between[raw]
        edge = np.ones(len(raw), bool)
        edge[1:] = space[:-1]
        edge[self.off[:-1][self.off[:-1] < len(raw)]] = True  # a text's first byte starts a word
        self.start = np.flatnonzero(edge & ~space)
        last = np.ones(len(raw), bool)
        last[:-1] = space[1:]
        ends = self.off[1:][self.off[1:] > 0] - 1
        last[ends] = True
        self.end = np.flatnonzero(last & ~space) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.count)
        if hashes:
            seen = _LOWER[raw] if lower else raw
            self.hash = self._hash(seen)

    def _hash(self, seen: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        body = seen[self.start[0] :]
        start = self.start - self.start[0]
        size = self.end - self.start
        room = np.diff(np.append(start, len(body)))  # a word and the white space after it
        pos = np.arange(len(body)) - np.repeat(start, room)
        inside = pos < np.repeat(size, room)
        pos[~inside] = 0
        value = _TABLE[body] * powers(_B, int(size.max()))[pos]
        value[~inside] = 0
        return mix(np.add.reduceat(value, start) + size.astype(np.uint64) * _C)


def sub_batches(batch: pa.RecordBatch, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of column text; a longer text is a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < n:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def texts_of(batch: pa.RecordBatch) -> pa.Array:
    """Column text, null as empty."""
    import pyarrow.compute as pc

    return pc.fill_null(batch.column("text"), "")


def grams(w: Words, k: int, salt: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word position in the batch, hash) of every run of k words of one text."""
    n = len(w.hash)
    if n < k:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0, np.uint64)
    at = np.flatnonzero(w.doc[: n - k + 1] == w.doc[k - 1 :])
    h = np.full(len(at), U(salt), np.uint64)
    for j in range(k):
        h = h * _A + w.hash[at + j]
    return w.doc[at], at, mix(h)


def windows(w: Words, size: int) -> np.ndarray:
    """Hash of words i to i + size - 1 for each i, without regard to text borders."""
    n = len(w.hash)
    if n < size:
        return np.zeros(0, np.uint64)
    return spans(w, np.arange(n - size + 1), np.arange(size, n + 1))


def spans(w: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of words a to b - 1, from prefix sums."""
    n = len(w.hash)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(w.hash * powers(_A, n), out=total[1:])
    back = powers(U(pow(int(_A), -1, 2**64)), n + 1)
    return mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64) * _C)


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
