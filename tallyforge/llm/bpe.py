"""Operator 9: byte-level BPE, a segment tree over byte positions for each piece of text.

A tree's leaves are the positions of a piece; a leaf holds the rank of the pair that starts
there (or none), and every inner node the leftmost minimum of its range. The root names the
next merge; a merge changes three leaves, each a logarithmic update. Short pieces of a batch
are merged side by side in numpy, one merge of each a step; long ones one by one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from .words import sub_batches, texts_of

NONE = np.int64(2**62)


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Merger:
    """Encodes pieces by a rank table that holds all 256 single bytes."""

    WIDE = 512

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.bits = max(ranks.values()).bit_length()
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << self.bits | b] = rank
        self.pair_rank = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = (a << self.bits) | b
        at = np.searchsorted(self.keys, k)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == k, self.values[at], NONE)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(pieces)
        sized: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif p:
                sized.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
            else:
                out[i] = b""
        for width, which in sized.items():
            if width >= self.WIDE:
                for i in which:
                    out[i] = self._one(pieces[i])
                continue
            step = max(1, 400_000 // width)
            for k in range(0, len(which), step):
                part = which[k : k + step]
                for i, ids in zip(part, self._many([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _many(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        live = np.arange(width) < size[:, None]
        tok = np.where(live, self.single[raw], 0).ravel()
        nxt = np.tile(np.arange(1, width + 1), (n, 1)).ravel()
        prv = np.tile(np.arange(-1, width - 1), (n, 1)).ravel()
        tree = np.full((n, 2 * width), NONE)
        grid = tok.reshape(n, width)
        lead = self._rank(grid[:, :-1].ravel(), grid[:, 1:].ravel()).reshape(n, width - 1)
        lead[~live[:, 1:]] = NONE
        place = np.arange(width)
        tree[:, width : 2 * width - 1] = np.where(lead == NONE, NONE, lead * width + place[:-1])
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        tree = tree.ravel()
        rows = np.flatnonzero(tree[1 :: 2 * width] < NONE)
        while len(rows):
            at, root = rows * width, rows * 2 * width
            top = tree[root + 1]
            pos = top % width
            right = nxt[at + pos]
            after = nxt[at + right]
            tok[at + pos] = top // width
            nxt[at + pos] = after
            live.ravel()[at + right] = False
            inner = after < size[rows]
            prv[(at + after)[inner]] = pos[inner]
            before = prv[at + pos]
            tree[root + width + right] = NONE
            new = np.full(len(rows), NONE)
            new[inner] = self._rank(tok[at + pos][inner], tok[(at + after)[inner]])
            tree[root + width + pos] = np.where(new == NONE, NONE, new * width + pos)
            has = before >= 0
            left = np.full(len(rows), NONE)
            left[has] = self._rank(tok[(at + before)[has]], tok[(at + pos)[has]])
            some = np.where(has, before, pos)
            tree[(root + width + before)[has]] = np.where(left == NONE, NONE, left * width + before)[has]
            points = np.concatenate([pos, right, some]) + width
            base = np.concatenate([root, root, root])
            while points[0] > 1:
                points >>= 1
                at2 = base + 2 * points
                tree[base + points] = np.minimum(tree[at2], tree[at2 + 1])
            rows = rows[tree[root + 1] < NONE]
        ids = tok[live.ravel()].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _one(self, piece: bytes) -> bytes:
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        none = (1 << 62, 0)
        tok = [int(self.single[b]) for b in piece]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        get, bits = self.pair_rank.get, self.bits
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = get(tok[i] << bits | tok[i + 1])
            if r is not None:
                tree[width + i] = (r, i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, leaf: tuple[int, int]) -> None:
            k = width + i
            tree[k] = leaf
            while k > 1:
                k >>= 1
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low

        while tree[1] != none:
            rank, i = tree[1]
            j = nxt[i]
            k = nxt[j]
            tok[i], nxt[i] = rank, k
            put(j, none)
            r = None
            if k < n:
                prv[k] = i
                r = get(rank << bits | tok[k])
            put(i, none if r is None else (r, i))
            h = prv[i]
            if h >= 0:
                r = get(tok[h] << bits | rank)
                put(h, none if r is None else (r, h))
        out, i = [], 0
        while i < n:
            out.append(tok[i])
            i = nxt[i]
        return np.array(out, "<u4").tobytes()


_MERGERS: dict[int, Merger] = {}


def merger(data: bytes) -> Merger:
    """The worker's merger for a rank file; one stays for the worker's life."""
    if hash(data) not in _MERGERS:
        _MERGERS.clear()
        _MERGERS[hash(data)] = Merger(load_ranks(data))
    return _MERGERS[hash(data)]


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _encoded(batches: Iterator[pa.RecordBatch], m: Merger, pattern: str, known_pieces: int) -> Iterator[pa.RecordBatch]:
    """doc_id, n_tokens, ids of batches with doc_id and text."""
    import regex

    find = regex.compile(pattern).findall
    known: dict[str, bytes] = {}
    for batch in batches:
        for part in sub_batches(batch, 1_500_000):
            found = [find(t) for t in texts_of(part).to_pylist()]
            new = list(set().union(*found).difference(known))
            if len(known) + len(new) > known_pieces:
                known.clear()
                new = list(set().union(*found))
            known.update(zip(new, m.encode([p.encode() for p in new]), strict=True))
            ids = [b"".join(map(known.__getitem__, f)) for f in found]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "n_tokens", "ids"],
            )


def _decoded(batches: Iterator[pa.RecordBatch], m: Merger) -> Iterator[pa.RecordBatch]:
    """The batches with the bytes of their ids."""
    tokens = m.tokens
    for batch in batches:
        step = max(1, int(batch.num_rows * 4e6 / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            out = [
                None if x is None else b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist()))
                for x in part.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])


def encode(docs: DataFrame, ranks_path: str, pattern: str, known_pieces: int = 250_000) -> DataFrame:
    """doc_id, text -> doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit) for every row.

    Each match of pattern is encoded by itself, special tokens are ordinary text; a null
    or empty text has no token. Repeated rows and ids are encoded as they come; other columns
    are ignored. ranks_path is a file of the driver's machine, whose fixed content is sent to
    tasks once. known_pieces bounds a worker's memory of pieces met before; it changes no result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_file(ranks_path))
    return docs.select("doc_id", "text").mapInArrow(lambda b: _encoded(b, merger(sent.value), pattern, known_pieces), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds decoded (binary: the tokens' bytes, joined) to a table with column ids; null ids give null."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_file(ranks_path))
    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])
    return encoded.mapInArrow(lambda b: _decoded(b, merger(sent.value)), schema)


def coded(docs: DataFrame, ranks_path: str, pattern: str, known_pieces: int = 250_000) -> DataFrame:
    """encode() and decode() of its ids by one Python worker a task, in place of two that both hold the ranks."""
    sent = docs.sparkSession.sparkContext.broadcast(read_file(ranks_path))
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(lambda b: _decoded(_encoded(b, merger(sent.value), pattern, known_pieces), merger(sent.value)), "doc_id long, n_tokens long, ids binary, decoded binary")
