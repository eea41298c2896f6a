"""Fields of JSON lines without parsing them: a structural index over the bytes of an Arrow column.

Quotes that no backslash escapes pair up inside a row; brackets, commas and colons outside of strings are its structure. Depth is a running
sum, and a key is a string that a colon follows. A path is found level by level, by the spans of the keys above it; values are
given as they are written. A row is one document: what one row leaves open does not reach the next.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

QUOTE, SLASH, COLON, COMMA = b'"'[0], b"\\"[0], b":"[0], b","[0]
OPEN, CLOSE, SPACE = np.frombuffer(b"{[", np.uint8), np.frombuffer(b"}]", np.uint8), np.frombuffer(b" \t\n\r", np.uint8)


class Structure:
    """Tokens of all rows: place in the bytes, byte, row, depth, and where a string or bracket ends (exclusive; -1 if it does not)."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        n = len(texts)
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        self.raw = raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        self.off = off = off - off[0]
        quotes = self._unescaped(np.flatnonzero(raw == QUOTE))
        row = np.searchsorted(off, quotes, "right") - 1
        # quotes of a row, counted from its first: even ones open, odd ones close
        nth = np.arange(len(quotes)) - np.searchsorted(row, row)
        opens = np.flatnonzero(nth % 2 == 0)
        closed = (opens + 1 < len(quotes)) & (row[np.minimum(opens + 1, len(quotes) - 1)] == row[opens])
        string_end = np.where(closed, quotes[np.minimum(opens + 1, len(quotes) - 1)] + 1, -1)
        marks = np.flatnonzero(np.isin(raw, np.frombuffer(b"{}[],:", np.uint8)))
        m_row = np.searchsorted(off, marks, "right") - 1
        before = np.searchsorted(quotes, marks) - np.searchsorted(row, m_row)
        out = before % 2 == 0
        marks, m_row = marks[out], m_row[out]
        at, end = np.concatenate([quotes[opens], marks]), np.concatenate([string_end, np.full(len(marks), -1)])
        order = np.argsort(at, kind="stable")
        self.at, self.end, self.row = at[order], end[order], np.concatenate([row[opens], m_row])[order]
        self.byte = raw[self.at]
        up, down = np.isin(self.byte, OPEN), np.isin(self.byte, CLOSE)
        total = np.cumsum(up.astype(np.int64) - down)
        first = np.searchsorted(self.row, np.arange(n))
        base = np.concatenate([[0], total])[first]
        self.depth = total - base[self.row] + down if len(self.row) else total
        # a bracket's partner is its neighbour among those of its row and depth
        b = np.flatnonzero(up | down)
        b = b[np.lexsort((self.at[b], self.depth[b], self.row[b]))]
        pair = (np.flatnonzero(up[b[:-1]] & down[b[1:]] & (self.depth[b[:-1]] == self.depth[b[1:]]) & (self.row[b[:-1]] == self.row[b[1:]]))) if len(b) else b
        self.end[b[pair]] = self.at[b[pair + 1]] + 1
        nxt = np.append(self.byte[1:], 0)
        same = np.append(self.row[1:] == self.row[:-1], False)
        self.keys = np.flatnonzero((self.byte == QUOTE) & (nxt == COLON) & same & (self.end > 0))

    def _unescaped(self, quotes: np.ndarray) -> np.ndarray:
        """Quotes behind an even number of backslashes."""
        run, active = np.zeros(len(quotes), np.int64), np.arange(len(quotes))
        floor = self.off[np.searchsorted(self.off, quotes, "right") - 1] if len(quotes) else quotes
        while len(active):
            at = quotes[active] - run[active] - 1
            more = at >= floor[active]
            more[more] = self.raw[at[more]] == SLASH
            active = active[more]
            run[active] += 1
        return quotes[run % 2 == 0]

    def _moved(self, at: np.ndarray, stop: np.ndarray, step: int) -> np.ndarray:
        """Places moved over white space, up to stop."""
        at = at.copy()
        active = np.arange(len(at))
        while len(active):
            look = at[active] if step > 0 else at[active] - 1
            more = look < stop[active] if step > 0 else look >= stop[active]
            more[more] = np.isin(self.raw[look[more]], SPACE)
            active = active[more]
            at[active] += step
        return at

    def values(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the value behind each colon or opening bracket or comma; end is -1 where the value does not end."""
        stop = self.off[self.row[tokens] + 1]
        nxt = np.minimum(tokens + 1, len(self.at) - 1)
        there = (tokens + 1 < len(self.at)) & (self.row[nxt] == self.row[tokens])
        border = np.where(there, self.at[nxt], stop)
        start = self._moved(self.at[tokens] + 1, border, 1)
        whole = there & (start == border) & ((self.byte[nxt] == QUOTE) | np.isin(self.byte[nxt], OPEN))
        return start, np.where(whole, self.end[nxt], self._moved(border, start, -1))

    def named(self, keys: np.ndarray, name: bytes) -> np.ndarray:
        """Those of the keys that are written so."""
        keys = keys[self.end[keys] - self.at[keys] - 2 == len(name)]
        for j, c in enumerate(name):
            keys = keys[self.raw[self.at[keys] + 1 + j] == c]
        return keys

    def found(self, path: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end) of every value at a path of keys, in order; all containers on the way are objects."""
        empty = np.zeros(0, np.int64)
        if not path or not len(self.keys):
            return empty, empty, empty
        starts = ends = None
        for level, name in enumerate(path, 1):
            keys = self.named(self.keys[self.depth[self.keys] == level], name.encode())
            if starts is not None:
                over = np.searchsorted(starts, self.at[keys], "right") - 1
                keys = keys[(over >= 0) & (self.at[keys] < ends[np.maximum(over, 0)])] if len(starts) else keys[:0]
            start, end = self.values(keys + 1)
            if level < len(path):
                inner = (end > start) & (self.raw[np.minimum(start, len(self.raw) - 1)] == OPEN[0])
                starts, ends = start[inner], end[inner]
        fine = end > start
        return self.row[keys[fine]], start[fine], end[fine]

    def text(self, start: int, end: int) -> bytes:
        return self.raw[start:end].tobytes()


def _decoded(raw: bytes) -> str | None:
    try:
        return json.loads(raw)
    except ValueError:
        return None


def raw_values(s: Structure, n: int, path: list[str]) -> list[str | None]:
    """Of each row, the first value at the path, as it is written."""
    out: list[str | None] = [None] * n
    row, start, end = s.found(path)
    for i in np.unique(row, return_index=True)[1]:
        out[row[i]] = s.text(start[i], end[i]).decode("utf-8", "replace")
    return out


def string_values(s: Structure, n: int, path: list[str]) -> list[str | None]:
    """Of each row, the first value at the path that is a string, decoded; null if its escapes are wrong."""
    out: list[str | None] = [None] * n
    row, start, end = s.found(path)
    is_text = s.raw[start] == QUOTE
    row, start, end = row[is_text], start[is_text], end[is_text]
    for i in np.unique(row, return_index=True)[1]:
        out[row[i]] = _decoded(s.text(start[i], end[i]))
    return out


def elements(s: Structure, n: int) -> list[list[str] | None]:
    """Of each row that is an array, its elements as they are written; null for others."""
    out: list[list[str] | None] = [None] * n
    top = np.flatnonzero((s.depth == 1) & (s.byte == OPEN[1]))
    top = top[s.at[top] == s._moved(s.off[:-1][s.row[top]], s.at[top], 1)]
    rows = s.row[top]
    for r in rows:
        out[r] = []
    borders = np.flatnonzero((s.depth == 1) & ((s.byte == COMMA) | (s.byte == OPEN[1])) & np.isin(s.row, rows))
    # only up to the end of the first array of the row
    last = np.zeros(n, np.int64)
    last[rows] = np.where(s.end[top] > 0, s.end[top], s.off[rows + 1])
    start, end = s.values(borders)
    for r, a, b in zip(s.row[borders], start, end):
        if a < b <= last[r]:
            out[r].append(s.text(a, b).decode("utf-8", "replace"))
    return out


def with_fields(rows: DataFrame, column: str, strings: dict[str, list[str]] | None = None, raws: dict[str, list[str]] | None = None, arrays: list[str] | None = None) -> DataFrame:
    """rows with a column for each name: the first string at a path of keys, the first value at a path as it is written, or (arrays: names,
    each of the column itself) the elements of an array. Keys are compared as they are written, repeated ones in order. A null text has no
    value; text that is no JSON gives what can be read of it and never fails."""
    strings, raws, arrays = strings or {}, raws or {}, arrays or []
    schema = StructType([*rows.schema.fields, *[StructField(c, StringType()) for c in (*strings, *raws)], *[StructField(c, ArrayType(StringType())) for c in arrays]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(column).fill_null("")
            s, n = Structure(text), batch.num_rows
            more = [pa.array(string_values(s, n, p), pa.string()) for p in strings.values()] + [pa.array(raw_values(s, n, p), pa.string()) for p in raws.values()]
            more += [pa.array(elements(s, n), pa.list_(pa.string())) for _ in arrays]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [f.name for f in schema.fields])

    return rows.mapInArrow(read, schema)


def first_fields(lines: DataFrame, file: str, pos: str, line: str, names: list[str], longest: int = 16 * 1024) -> DataFrame:
    """(file, names...): of each file the first value of every wanted top-level string field, over its lines in order. Values of more
    than `longest` bytes do not count."""
    found = with_fields(lines.select(file, pos, line), line, strings={f"_{n}": [n] for n in names})
    return found.groupBy(file).agg(*[F.min_by(f"_{n}", F.when(F.octet_length(f"_{n}") <= longest, F.col(pos))).alias(n) for n in names])
