"""Words of Arrow text columns as numpy arrays: places and 64-bit hashes, without a Python object a word.

A word's hash is a polynomial over its bytes modulo 2**64 (each byte stands for a
random number), finished by a mixing step.  A sequence of words is hashed the same way
over its word hashes, so every window of a text is found by one running sum.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_CHUNK = 1 << 20
_numbers = np.random.default_rng(7_2026).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_SEQUENCE = _U(0xD1342543DE82EF95)

_blank = np.zeros(256, bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes inside a word, for words between blanks and for words of letters and digits.
BETWEEN_BLANKS = ~_blank
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def byte_values(lower: bool = False) -> np.ndarray:
    out = _numbers.copy()
    if lower:
        out[0x41:0x5B] = out[0x61:0x7B]
    return out


def _inverse(base: int) -> int:
    return pow(int(base), -1, 2**64)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW, _INV = powers(_BASE, _CHUNK), powers(_U(_inverse(_BASE)), _CHUNK)


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing step of a 64-bit hash."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending; `values` is sorted in place.  (np.unique hashes whole numbers from numpy 2.3 on, which takes several times as long as a sort.)"""
    values.sort()
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


class Words:
    """The words of some texts: starts and ends (bytes in `data`), doc (text number), first (word number where each text begins)."""

    def __init__(self, column: pa.Array, inside: np.ndarray = BETWEEN_BLANKS):
        column = pc.fill_null(column, "").cast(pa.large_string())
        _, offsets, data = column.buffers()
        self.offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        base, end = int(self.offsets[0]), int(self.offsets[-1])
        self.data = np.frombuffer(data, np.uint8)[base:end] if end > base else np.zeros(0, np.uint8)
        self.offsets = self.offsets - base
        within = inside[self.data]
        before, after = np.empty_like(within), np.empty_like(within)
        if len(within):
            before[1:], before[0] = within[:-1], False
            after[:-1], after[-1] = within[1:], False
            edges = self.offsets[(self.offsets > 0) & (self.offsets < len(within))]
            before[edges] = False
            after[edges - 1] = False
        self.starts = np.flatnonzero(within & ~before)
        self.ends = np.flatnonzero(within & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, values: np.ndarray) -> np.ndarray:
        """A hash a word; `values` gives each byte's number."""
        out = np.empty(len(self), np.uint64)
        at = 0
        while at < len(self):
            low = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, low + _CHUNK, "right")))
            span = int(self.ends[to - 1] - low)
            up, down = (_POW, _INV) if span <= _CHUNK else (powers(_BASE, span), powers(_U(_inverse(_BASE)), span))
            sums = np.zeros(span + 1, np.uint64)
            np.cumsum(values[self.data[low : low + span]] * up[:span], dtype=np.uint64, out=sums[1:])
            s, e = self.starts[at:to] - low, self.ends[at:to] - low
            out[at:to] = (sums[e] - sums[s]) * down[s]
            at = to
        return mix(out)

    def text(self, n: int) -> bytes:
        return self.data[self.offsets[n] : self.offsets[n + 1]].tobytes()


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive numbers (a rolling polynomial); empty if there are fewer."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_SEQUENCE, len(words)), dtype=np.uint64, out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(_U(_inverse(_SEQUENCE)), len(words))[: len(words) - n + 1])


def pieces(batches: Iterator[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of the batches, cut so that a piece holds about `limit` bytes of text (a longer text is a piece of its own)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, at = np.cumsum(sizes), 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, lowest first: planes of zeros cost next to nothing once compressed, and are left out at the top."""
    values = np.ascontiguousarray(values, np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a plain schema string."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out = []
    for field in ddl.replace("array<struct<start: long, end: long>>", "spans").split(", "):
        name, kind = field.split(" ")
        out.append(pa.field(name, span if kind == "spans" else kinds[kind]))
    return pa.schema(out)
