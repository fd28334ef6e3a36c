"""Ranked lexical search without a document index: an automaton of all items' terms counts them in each document's text."""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import stored
from .tokens import ALPHANUMERIC, Words, arrow_schema, pieces

#: A term: letters, digits and whatever is not ASCII.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Items of a block, and about the bytes of their texts: what an automaton holds and the driver sees at a time.
BLOCK_ITEMS, BLOCK_BYTES = 4096, 4 << 20
#: Cells of documents by items, and pairs of a document's term and an item, that are added up at a time.
_CELLS, _PAIRS = 1 << 20, 1 << 20
#: Merging lists of a block's items are dealt over this many parts first.
_PARTS = 32
_LONG = 2**63 - 1
#: Bytes of a text as the automaton reads them: small letters, and blanks for all that is no term.
_READ = np.where(ALPHANUMERIC, np.arange(256), 0x20).astype(np.uint8)
_READ[0x41:0x5B] += 0x20


def _guarded(term: str) -> str:
    """A term between blanks, a character a byte, as it stands in the text that the automaton reads."""
    return f" {term.encode().decode('latin-1')} "


class Block:
    """The automaton of a block's terms, and what its outputs stand for: term t is held by items held[first[t]:first[t + 1]], so many times."""

    def __init__(self, item: np.ndarray, item_id: list[int | None], term: list[str], n: np.ndarray):
        self.items, where = np.unique(item, return_index=True)
        self.item_ids = [item_id[i] for i in where.tolist()]
        self.terms, number = np.unique(np.array(term, object), return_inverse=True)
        order = np.argsort(number, kind="stable")
        self.first = np.searchsorted(number[order], np.arange(len(self.terms) + 1))
        self.held, self.times = np.searchsorted(self.items, item[order]), n[order]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(self.terms.tolist()):
            self.automaton.add_word(_guarded(t), i)
        self.automaton.make_automaton()

    def count(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """How many terms each text has; and the document, term and count of every item term that a text holds."""
        words = Words(column, ALPHANUMERIC)
        read, docs, terms, tfs = _READ[words.data], [], [], []
        for i in np.flatnonzero(words.count).tolist():
            text = f" {read[words.offsets[i] : words.offsets[i + 1]].tobytes().decode('latin-1')} "
            found, tf = np.unique(np.fromiter((t for _, t in self.automaton.iter(text)), np.int64), return_counts=True)
            docs.append(np.full(len(found), i))
            terms.append(found)
            tfs.append(tf)
        join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        return words.count.astype(np.int64), join(docs), join(terms), join(tfs)

    def scores(self, doc: np.ndarray, many: int, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        """A row for each of `many` documents, a column an item: the values of the item's terms, as often as it repeats them."""
        out = np.zeros(many * len(self.items), np.int64)
        holders = np.diff(self.first)[term]
        upto, at = np.cumsum(holders), 0
        while at < len(term):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PAIRS, "right")))
            n = holders[at:to]
            place = np.repeat(self.first[term[at:to]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            cell = np.repeat(doc[at:to], n) * len(self.items) + self.held[place]
            out += _whole_sums(cell, np.repeat(value[at:to], n) * self.times[place], len(out))
            at = to
        return out.reshape(many, len(self.items))


def _whole_sums(cell: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole values by cell.  bincount adds doubles, which are exact below 2**53: larger sums are made in two halves of the digits."""
    if value.sum(dtype=float) < 2**52:
        return np.bincount(cell, value, size).astype(np.int64)
    high, low = np.bincount(cell, value >> 26, size), np.bincount(cell, value & ((1 << 26) - 1), size)
    return (high.astype(np.int64) << 26) + low.astype(np.int64)


def _merged(lists: list[list[np.ndarray]], k: int) -> list[np.ndarray]:
    """The k best of each item out of some lists of item, score, document; sorted by item and rank."""
    item, score, doc = (np.concatenate(c) for c in zip(*lists, strict=True))
    order = np.lexsort((doc, -score, item))
    item, score, doc = item[order], score[order], doc[order]
    keep = np.arange(len(item)) - np.searchsorted(item, item) < k
    return [item[keep], score[keep], doc[keep]]


def _postings(items: DataFrame, block_items: int, block_bytes: int) -> tuple[DataFrame, int]:
    """block, item (a number of its own), item_id, term and n (how often the item holds it), and the number of blocks."""
    rows = stored(
        items.select(
            F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"),
            F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER).alias("text"),
        )
    )
    many, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("long"))).first()
    blocks = max(1, -(-many // block_items), -(-(size or 0) // block_bytes))
    terms = rows.select(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), "item", "item_id", F.explode(F.regexp_extract_all("text", F.lit(f"({TERM})"), F.lit(1))).alias("term"))
    counted = terms.groupBy("block", "item", "item_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return stored(counted.repartitionByRange("block").sortWithinPartitions("block")), blocks


def _statistics(docs: DataFrame, block) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and the documents that hold each of the block's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        df, n, total = np.zeros(len(b.terms), np.int64), 0, 0
        for part in pieces(batches, 2 << 20):
            size, _, term, _ = b.count(part.column("text"))
            df += np.bincount(term, minlength=len(df))
            n, total = n + int((size > 0).sum()), total + int(size.sum())
        on = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(on, [-1, -2])), pa.array(np.append(df[on], [n, total]))], schema=arrow_schema("term long, n long"))

    got = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    sums = dict(zip(got.column("term").to_pylist(), got.column("n").to_pylist(), strict=True))
    n, total = sums.pop(-1, 0), sums.pop(-2, 0)
    df = np.zeros(len(block.value.terms), np.int64)
    df[list(sums)] = list(sums.values())
    return n, total, df


def _best(docs: DataFrame, block, n: int, total: int, weight: np.ndarray, k: int) -> DataFrame:
    """item, item_id, doc_id, score: the k best documents of each of the block's items in each task."""
    ddl = "item long, item_id long, doc_id long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        many = max(1, _CELLS // len(b.items))
        best = [np.zeros(0, np.int64)] * 3
        kth, last = np.zeros(len(b.items), np.int64), np.full(len(b.items), -1 - _LONG)
        for part in pieces(batches, 2 << 20):
            ids = pc.fill_null(part.column("doc_id"), _LONG).to_numpy()
            size, doc, term, tf = b.count(part.column("text"))
            length = 75 + (25 * size * n) // total
            value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * length[doc]))
            for low in range(0, len(ids), many):
                a, z = np.searchsorted(doc, [low, low + many])
                s = b.scores(doc[a:z] - low, min(many, len(ids) - low), term[a:z], value[a:z])
                d, i = np.nonzero((s > 0) & (s >= kth))
                here, of = s[d, i], ids[low + d]
                new = (here > kth[i]) | (of < last[i])
                if new.any():
                    best = _merged([best, [i[new], here[new], of[new]]], k)
                    end = np.searchsorted(best[0], np.arange(len(b.items)), "right")
                    full = np.flatnonzero(np.diff(end, prepend=0) == k)
                    kth[full], last[full] = best[1][end[full] - 1], best[2][end[full] - 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(b.items[best[0]]), pa.array([b.item_ids[i] for i in best[0].tolist()], pa.int64()), pa.array(best[2], mask=best[2] == _LONG), pa.array(best[1])],
            schema=arrow_schema(ddl),
        )

    return docs.mapInArrow(run, ddl)


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item, best first.

    docs: doc_id, text; items: item_id, text.  Terms are runs of letters, digits and
    non-ASCII characters, A-Z lower-cased.  With N documents that have a term, L their
    terms, n those of a document and df the documents that hold a term, a term weighs
    floor(1000 ln((2N + 2) / (2df + 1))), and a document that holds it tf times adds
    weight * ((10^9 tf) div (1000 tf + 12m)), m = 75 + (25 n N) div L, for each time that the
    item has it.  Documents without a score above 0 are left out.  Of equal scores the
    smaller doc_id comes first, rows without one (or with the largest long) last.  Null texts have no
    terms.  Every row of either table counts as one of its own, also where it repeats
    another or its id.

    Items are dealt to blocks of a bounded size.  A block's automaton is broadcast and reads
    all documents twice, once for df and once for scores; nothing is kept of a
    document, and a task sends k rows an item.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    postings, blocks = _postings(items, block_items, block_bytes)
    found = []
    for number in range(blocks):
        own = postings.filter(F.col("block") == number).select("item", "item_id", "term", "n").toArrow().sort_by([("item", "ascending"), ("term", "ascending")])
        if not own.num_rows:
            continue
        block = docs.sparkSession.sparkContext.broadcast(Block(own.column("item").to_numpy(), own.column("item_id").to_pylist(), own.column("term").to_pylist(), own.column("n").to_numpy()))
        n, total, df = _statistics(given, block)
        if n:
            weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
            order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
            rows = _best(given, block, n, total, weight, k).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(_PARTS)))
            for keys in (["item", "part"], ["item"]):
                rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
            found.append(stored(rows.select("item_id", "rank", "doc_id", "score")))
        block.destroy()
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)
