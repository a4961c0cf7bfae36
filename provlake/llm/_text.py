"""Vectorised text helpers used inside Arrow tasks.

Tokens are found and fingerprinted with numpy over the raw UTF-8 buffer of an Arrow
column. Rows are taken some kilobytes of text at a time (batches_of), and within one long
text the arrays of 64-bit values are made segment by segment, so that what a task holds is
a few bytes for each byte of its longest text. A fingerprint is 64 bits wide: two different
tokens share one with a probability of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ASCII white space: space and \t to \r
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: the identity, and A-Z lower-cased
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32

#: text taken at once, and bytes fingerprinted at once
CHUNK_BYTES = 1 << 18
SEGMENT = 1 << 16
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


def _powers(p: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate((np.ones(1, dtype=np.uint64), np.full(SEGMENT, p, dtype=np.uint64))))


#: powers of an odd multiplier and of its inverse, modulo 2**64
_POWER, _INVERSE = _powers(_P), _powers(_PINV)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """One fingerprint for equally long columns of fingerprints, order included."""
    with np.errstate(over="ignore"):
        h = np.full(parts[0].shape, len(parts), dtype=np.uint64)
        for p in parts:
            h = mix(h * np.uint64(_P) + p)
        return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans_of(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of runs of rows with about `limit` bytes of text, one row at least."""
    if not len(column):
        return
    _, offsets = text_buffers(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end
        at = end


def batches_of(batches, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about `limit` bytes of text, one row at least."""
    for batch in batches:
        for at, end in spans_of(batch.column(batch.schema.get_field_index(text)), limit):
            yield batch.slice(at, end - at)


def _long_print(token: np.ndarray) -> np.uint64:
    """The sum over one long token, by segments."""
    total, power = np.zeros(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(token), SEGMENT):
            part = token[at : at + SEGMENT].astype(np.uint64) + np.uint64(1)
            total += power * (part * _POWER[: len(part)]).sum(dtype=np.uint64)
            power *= _POWER[len(part)]
    return total[0]


def fingerprints(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A fingerprint of each token raw[start:end]; tokens are in order and apart."""
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(start):
            low = start[at]
            upto = int(np.searchsorted(end, low + SEGMENT, side="right"))  # tokens within a segment
            if upto == at:
                out[at] = _long_print(raw[low : end[at]])
                upto = at + 1
            else:
                part = raw[low : end[upto - 1]].astype(np.uint64) + np.uint64(1)
                sums = np.zeros(len(part) + 1, dtype=np.uint64)
                np.cumsum(part * _POWER[: len(part)], out=sums[1:])
                a, b = start[at:upto] - low, end[at:upto] - low
                out[at:upto] = (sums[b] - sums[a]) * _INVERSE[a]
            at = upto
        return mix(out + (end - start).astype(np.uint64))


class Tokens:
    """Tokens of a batch of texts: doc (row of each token), start, end (bytes) and h (fingerprint)."""

    def __init__(self, column: pa.Array, fold: np.ndarray = LOWER, separator: np.ndarray = SPACE, apart: tuple[np.ndarray, np.ndarray] | None = None):
        """apart: two classes of bytes between which a token ends as well."""
        raw, offsets = text_buffers(column)
        self.raw, self.offsets, self.docs = fold[raw], offsets, len(offsets) - 1
        word = np.empty(len(raw) + 2, dtype=bool)
        word[0] = word[-1] = False
        word[1:-1] = ~separator[raw]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        cut = np.zeros(len(raw) + 1, dtype=bool)
        cut[inner] = True
        if apart:
            one, other = apart[0][raw], apart[1][raw]
            cut[1:-1] |= (one[:-1] & other[1:]) | (other[:-1] & one[1:])
        cut |= word[1:] != word[:-1]
        self.start = np.flatnonzero(cut & word[1:])
        self.end = np.flatnonzero(cut & word[:-1])
        self.n = np.diff(np.searchsorted(self.start, offsets))  # tokens of each row
        self.first = np.concatenate(([0], np.cumsum(self.n)))
        self.doc = np.repeat(np.arange(self.docs), self.n)
        self.h = fingerprints(self.raw, self.start, self.end)

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, fingerprint) of the first n bytes of each token that is longer."""
        at = np.flatnonzero(self.end - self.start > n)
        start, h = self.start[at], np.full(len(at), n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = h * np.uint64(_P) + self.raw[start + k]
        return self.doc[at], mix(h)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, fingerprint) of each run of n tokens within one text, in order."""
        m = len(self.h) - n + 1
        if m <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        ok = self.doc[:m] == self.doc[n - 1 :]
        return self.doc[:m][ok], joined([self.h[i : i + m] for i in range(n)])[ok]


def windows(raw: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, fingerprint) of each run of n <= 8 bytes within one text, by segments."""
    for low in range(0, max(0, len(raw) - n + 1), SEGMENT):
        part = raw[low : low + SEGMENT + n - 1].astype(np.uint64)
        m = len(part) - n + 1
        value = np.zeros(m, dtype=np.uint64)
        for k in range(n):
            value |= part[k : k + m] << np.uint64(8 * k)
        place = np.arange(low, low + m)
        row = np.searchsorted(offsets, place, side="right") - 1
        inside = place + n <= offsets[row + 1]
        yield row[inside], mix(value[inside])


def distinct_by_row(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, h) pairs, sorted."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]
