"""Vector codes: parts of vectors by their nearest codebook entry, found through memoised grid cells."""
from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import stored
from .vectors import exact, slices, whole

_U = np.uint64
#: Cells that a memo holds at most; then it begins anew.
MEMO = 1 << 15
_LONG = 2**63 - 1


class Cells:
    """Nearest entries of one codebook.

    Points are put into coarse grid cells.  The first point of a cell pays for a list of the
    entries that can be nearest somewhere in the cell's box: an entry goes if its least
    distance to the box exceeds another's greatest distance.  The list is kept under the
    cell, and its points are compared with these entries alone, exactly; of equally near
    entries the first one counts.
    """

    def __init__(self, book: np.ndarray):
        self.book = book
        spread = float(np.std(book.astype(float))) if book.size else 0.0
        #: A cell's width: a power of two near the spread of the entries' components.
        self.shift = max(0, int(spread).bit_length())
        self.memo: dict[bytes, int] = {}

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """For each cell, which entries can be nearest (a row of booleans)."""
        low = exact(cells << self.shift, self.book)
        high, book = low + ((1 << self.shift) - 1), self.book.astype(low.dtype)
        under, over = low[:, None] - book, book - high[:, None]
        near = (np.maximum(np.maximum(under, over), 0) ** 2).sum(2)
        far = (np.maximum(np.abs(book - low[:, None]), np.abs(high[:, None] - book)) ** 2).sum(2)
        return near <= far.min(1)[:, None]

    def lists(self, cells: np.ndarray) -> np.ndarray:
        """For each point's cell, which entries can be nearest, as booleans; computed once a cell and kept."""
        if not len(cells):
            return np.zeros((0, len(self.book)), bool)
        base = np.random.default_rng(11).integers(1, 2**63, cells.shape[1], dtype=np.uint64) | _U(1)
        _, first, at = np.unique((cells.view(_U) * base).sum(1, dtype=_U), return_index=True, return_inverse=True)
        if (cells != cells[first][at]).any():  # two cells share a hash: tell them apart in full
            _, first, at = np.unique(cells, axis=0, return_index=True, return_inverse=True)
        heads = np.ascontiguousarray(cells[first])
        keys = [row.tobytes() for row in heads]
        new = [i for i, k in enumerate(keys) if k not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo, new = {}, list(range(len(keys)))
        for i in range(0, len(new), 1024):
            some = new[i : i + 1024]
            self.memo.update(zip([keys[j] for j in some], np.packbits(self.candidates(heads[some]), axis=1), strict=True))
        packed = np.stack([self.memo[k] for k in keys])
        return np.unpackbits(packed, axis=1, count=len(self.book)).astype(bool)[at]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each point's nearest entry, and its squared distance."""
        code, best = np.zeros(len(points), np.int64), np.zeros(len(points), points.dtype)
        open_, found = self.lists(np.ascontiguousarray(points.astype(np.int64)) >> self.shift), np.zeros(len(points), bool)
        for j in range(len(self.book)):
            rows = np.flatnonzero(open_[:, j])
            d = ((points[rows] - self.book[j]) ** 2).sum(1)
            better = ~found[rows] | (d < best[rows])
            rows, d = rows[better], d[better]
            code[rows], best[rows], found[rows] = j, d, True
        return code, best


def _nearest(memos: list[Cells], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances (rows, parts) of whole vectors."""
    x = exact(x, *[m.book for m in memos])
    found = [m.nearest(p) for m, p in zip(memos, np.split(x, len(memos), 1), strict=True)]
    return np.stack([c for c, _ in found], 1), np.stack([d for _, d in found], 1)


def _of_length(column: pa.Array, scale: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    for rows, x in whole(column, scale):
        if x.shape[1] == n:
            return rows, x
    return np.zeros(0, np.int64), np.zeros((0, n), np.int64)


def _first(vectors: DataFrame, parts: int, entries: int, scale: int) -> list[list[int]]:
    """The whole vectors of the smallest vec_ids: each task gives its smallest, and these few are ordered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], dict[int, list[int]]] = {}  # by length, then by vec_id (null: past every long)
        for batch in slices(batches, "embedding"):
            ids = pc.fill_null(batch.column("vec_id"), _LONG).to_numpy()
            none = batch.column("vec_id").is_null().to_numpy(zero_copy_only=False)
            for rows, x in whole(batch.column("embedding"), scale):
                if x.shape[1] % parts or not x.shape[1]:
                    continue
                mine = held.setdefault(x.shape[1], {})
                for key in sorted(set(zip(none[rows].tolist(), ids[rows].tolist(), strict=True)))[:entries]:
                    same = x[(none[rows] == key[0]) & (ids[rows] == key[1])]
                    mine[key] = min([*([mine[key]] if key in mine else []), *same.tolist()])
                for key in sorted(mine)[entries:]:
                    del mine[key]
        got = [(key, v) for mine in held.values() for key, v in mine.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([None if none else i for (none, i), _ in got], pa.int64()), pa.array([v for _, v in got], pa.list_(pa.int64()))], names=["vec_id", "x"]
        )

    few = stored(vectors.mapInArrow(run, "vec_id long, x array<long>").groupBy("vec_id", F.size("x").alias("n")).agg(F.min("x").alias("x")))
    first = few.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(1).collect()
    if not first:
        return []
    return [r.x for r in few.filter(F.col("n") == first[0].n).orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()]


def _input(vectors: DataFrame, *carry: str) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), *carry)


def fit(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> np.ndarray:
    """Codebooks (parts, entries, components of a part) of whole numbers.

    vectors: vec_id, embedding.  Vectors that are null, hold a null or non-finite component,
    or have another length than the first kept vec_id's (which must divide into parts) take no part.
    Each part's codebook starts as that part of the smallest vec_ids (a repeated vec_id
    counts once, with its least vector; null ids come last).  A round gives each part to its nearest entry and
    moves each entry to the floor of the mean of its parts; a task sends one row of sums
    for each entry and place, whatever its rows.  Without vectors: no entries.
    """
    vectors = _input(vectors)
    first = _first(vectors, parts, entries, scale)
    books = np.array(first, np.int64).reshape(len(first), parts, -1).swapaxes(0, 1) if first else np.zeros((parts, 0, 0), np.int64)
    for _ in range(rounds if first else 0):
        moved = books.copy()
        for r in _sums(vectors, books, scale).collect():
            moved[r.part, r.entry] = [int(s) // r.n for s in r.sums]
        books = moved
    return books


def _sums(vectors: DataFrame, books: np.ndarray, scale: int) -> DataFrame:
    """part, entry, n, sums: how many parts each entry is nearest to, and their sums by place."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Cells(b) for b in books]
        count, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), object)
        for batch in slices(batches, "embedding"):
            _, x = _of_length(batch.column("embedding"), scale, parts * width)
            codes, _ = _nearest(memos, x)
            x = exact(x).reshape(len(x), parts, width)
            for p in range(parts):
                for e in range(entries):
                    mine = codes[:, p] == e
                    count[p, e] += mine.sum()
                    sums[p, e] += x[mine, p].sum(0)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array([[Decimal(int(s)) for s in row] for row in sums[p, e]], pa.list_(pa.decimal128(38, 0)))],
            names=["part", "entry", "n", "sums"],
        )

    some = vectors.mapInArrow(run, "part int, entry int, n long, sums array<decimal(38,0)>")
    return some.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))


def encode(vectors: DataFrame, books: np.ndarray, carry: tuple[str, ...] = (), scale: int = 4096) -> DataFrame:
    """vec_id, the carried columns, codes (an entry a part) and error (squared distances summed over the parts, at most the largest long).

    Rows that fit() leaves out give no row; every other row gives one, repeated ones too.
    """
    parts, _, width = books.shape
    vectors = _input(vectors, *carry)
    kept = [vectors.schema["vec_id"], *[vectors.schema[c] for c in carry]]
    schema = T.StructType([*kept, T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Cells(b) for b in books]
        for batch in slices(batches, "embedding"):
            rows, x = _of_length(batch.column("embedding"), scale, parts * width)
            if not len(rows) or not books.size:
                continue
            codes, d = _nearest(memos, x)
            error = np.minimum(d.sum(1), _LONG).astype(np.int64)
            held = [batch.column(f.name).take(pa.array(rows)) for f in kept]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts, dtype=np.int32)), pa.array(codes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*held, lists, pa.array(error)], names=schema.names)

    return vectors.mapInArrow(run, schema)


def decode(coded: DataFrame, books: np.ndarray, scale: int = 4096) -> DataFrame:
    """The coded rows with `embedding`, the vector that the codes stand for."""
    flat = [F.array(*[F.array(*[F.lit(float(v) / scale) for v in entry]) for entry in book]) for book in books]
    return coded.withColumn("embedding", F.concat(*[F.element_at(b, F.col("codes")[p] + 1) for p, b in enumerate(flat)]))

