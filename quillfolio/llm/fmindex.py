"""Benchmark decontamination: an FM-index per shard of documents, searched backward for the benchmark's word windows."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import stored
from .tokens import ALPHANUMERIC, Words, arrow_schema, byte_values, pieces

_U = np.uint64
_FOUND = "n_words long, intervals array<struct<start: long, end: long>>, items array<string>"


class Bits:
    """A bit vector with constant-time counts of the ones before a place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(_U)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (_U(1) << (at & 63).astype(_U)) - _U(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(_U)) & _U(1)


class WaveletMatrix:
    """A sequence of numbers that counts and reads symbols in one step a bit."""

    def __init__(self, symbols: np.ndarray, most: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for b in reversed(range(max(1, most.bit_length()))):
            one = (symbols >> b) & 1 == 1
            symbols = np.concatenate([symbols[~one], symbols[one]])
            self.levels.append((b, Bits(one), len(one) - int(one.sum())))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        begin = np.zeros_like(at)
        for b, bits, zeros in self.levels:
            one = (symbol >> b) & 1 == 1
            r, s = bits.rank(at), bits.rank(begin)
            at, begin = np.where(one, zeros + r, at - r), np.where(one, zeros + s, begin - s)
        return at - begin

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for b, bits, zeros in self.levels:
            one = bits.get(at) == 1
            out |= one.astype(np.int64) << b
            r = bits.rank(at)
            at = np.where(one, zeros + r, at - r)
        return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order, by doubling: each round orders only what the round before left equal."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)

    def ranked(places: np.ndarray, keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Give each group of equal keys its first slot as rank; return the slots still shared."""
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
        rank[places] = slots[first]
        alone = new & np.append(new[1:], True)
        return slots[~alone]

    shared, step = ranked(order, symbols[order], np.arange(n)), 1
    while len(shared):
        places = order[shared]
        then = places + step
        key = rank[places] * (n + 1) + np.where(then < n, rank[np.minimum(then, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[shared] = places[by]
        shared, step = ranked(places[by], key[by], shared), step * 2
    return order


class FmIndex:
    """Counts and finds phrases in a sequence of symbols from 0 to most."""

    SAMPLE = 8

    def __init__(self, symbols: np.ndarray, most: int):
        order = suffix_array(symbols)
        self.n = len(symbols)
        self.tree = WaveletMatrix(symbols[order - 1], most)
        self.smaller = np.zeros(most + 2, np.int64)
        np.cumsum(np.bincount(symbols, minlength=most + 1), out=self.smaller[1:])
        sampled = order % self.SAMPLE == 0
        self.marked, self.places = Bits(sampled), order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that start with each phrase (rows of symbols; -1: a symbol that does not occur)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            on = np.flatnonzero((lengths >= back) & (low < high))
            c = phrases[on, lengths[on] - back]
            high[on[c < 0]] = 0
            on, c = on[c >= 0], c[c >= 0]
            low[on], high[on] = self.smaller[c] + self.tree.rank(c, low[on]), self.smaller[c] + self.tree.rank(c, high[on])
        return low, np.maximum(low, high)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Places of suffixes in the sequence: step back until a sampled one."""
        out, steps = np.empty(len(at), np.int64), np.zeros(len(at), np.int64)
        todo, at = np.arange(len(at)), at.copy()
        while len(todo):
            done = self.marked.get(at) == 1
            out[todo[done]] = self.places[self.marked.rank(at[done])] + steps[todo[done]]
            todo, at = todo[~done], at[~done]
            steps[todo] += 1
            c = self.tree.symbol(at)
            at = self.smaller[c] + self.tree.rank(c, at)
        return out


class Phrases:
    """Distinct windows of the benchmark items, as word hashes, and the items that hold each."""

    def __init__(self, rows: pa.Table, window: int):
        rows = rows.sort_by("key").combine_chunks()
        keys = rows.column("key").to_pylist()
        self.lengths = np.array([len(k) // 8 for k in keys], np.int64)
        self.hashes = np.zeros((len(keys), window), np.uint64)
        for i, k in enumerate(keys):
            self.hashes[i, : len(k) // 8] = np.frombuffer(k, np.uint64)
        self.items = [sorted(x) for x in rows.column("items").to_pylist()]


def _windows(items: DataFrame, window: int) -> DataFrame:
    """key (a window's word hashes, eight bytes each) and items (the ids that hold it): a row for each distinct window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches, 1 << 20):
            words = Words(rows.column("text"), ALPHANUMERIC)
            h, many = words.hashes(byte_values(lower=True)), np.where(words.count > 0, np.maximum(words.count - window, 0) + 1, 0)
            of = np.repeat(np.arange(len(many)), many)
            at = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + words.first[:-1][of]
            size = np.minimum(words.count, window)[of]
            keys = [h[x : x + n].tobytes() for x, n in zip(at.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), rows.column("item_id").take(pa.array(of))], names=["key", "item_id"])

    found = items.mapInArrow(run, "key binary, item_id string")
    return found.groupBy("key").agg(F.collect_set("item_id").alias("items"))


def _shard(rows: pa.RecordBatch, phrases: Phrases, keep: list[str]) -> pa.RecordBatch:
    words = Words(rows.column("text"), ALPHANUMERIC)
    n, docs = len(words), len(words.count)
    vocabulary, ids = np.unique(words.hashes(byte_values(lower=True)), return_inverse=True)
    # Each text ends in a symbol of its own, below all words: no phrase runs on, and no suffix compares past it.
    symbols = np.empty(n + docs, np.int64)
    symbols[np.arange(n) + words.doc] = ids + docs
    ends = words.first[1:] + np.arange(docs)
    symbols[ends] = np.arange(docs)
    gone, items = np.zeros(n + docs + 1, np.int64), [set() for _ in range(docs)]
    if n and len(phrases.lengths):
        found = np.minimum(np.searchsorted(vocabulary, phrases.hashes), len(vocabulary) - 1)
        c = np.where(vocabulary[found] == phrases.hashes, found + docs, -1)
        c[np.arange(c.shape[1]) >= phrases.lengths[:, None]] = 0
        there = np.flatnonzero((c >= 0).all(1))
        if len(there):
            index = FmIndex(symbols, docs + len(vocabulary) - 1)
            low, high = index.search(c[there], phrases.lengths[there])
            hit = np.flatnonzero(low < high)
            count = high[hit] - low[hit]
            which = np.repeat(there[hit], count)
            at = index.locate(np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[hit], count))
            np.add.at(gone, at, 1)
            np.add.at(gone, at + phrases.lengths[which], -1)
            doc = np.searchsorted(ends, at)
            for pair in np.unique(doc * len(phrases.lengths) + which).tolist():
                items[pair // len(phrases.lengths)].update(phrases.items[pair % len(phrases.lengths)])
    cover = np.cumsum(gone[:-1]) > 0
    out = []
    for k in range(docs):
        a = words.first[k] + k
        turn = np.flatnonzero(np.diff(np.concatenate([[0], cover[a : a + words.count[k]].view(np.int8), [0]])))
        out.append({
            "n_words": int(words.count[k]),
            "intervals": [{"start": s, "end": e} for s, e in turn.reshape(-1, 2).tolist()], "items": sorted(items[k]),
        })
    found = pa.RecordBatch.from_pylist(out, arrow_schema(_FOUND))
    return pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], *found.columns], names=[*keep, *found.schema.names])


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 13, shard_bytes: int = 3 << 20, block_windows: int = 1 << 16, carry: Sequence[str] = ()) -> DataFrame:
    """Find the benchmark items' word windows in the documents.

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z
    lower-cased.  An item's windows are its runs of `window` words; an item of fewer words,
    but not none, is one window.  Each partition's documents are cut into shards of about
    `shard_bytes`; a shard gets an FM-index over its words (suffix array, wavelet matrix of
    the Burrows-Wheeler transform, sampled suffix places), all windows are searched
    backward in it and the occurrences located.  Documents are not shuffled.

    The benchmark is the query set: its distinct windows are made and grouped by tasks and written in
    blocks of about `block_windows`.  The driver holds one block at a time and broadcasts it for one pass over the
    documents.  With several blocks a pass writes only the rows that it found something in,
    and these are joined to the documents at the end.

    Returns doc_id, n_words, intervals (of word numbers, end exclusive, merged), n_hit,
    items (ids of the items with an occurring window, as sorted strings), text and the columns to carry.  A null text has no
    words; every row is judged alone, so repeated rows get equal results; items without
    words never occur, items that repeat an id count as one, a null item_id reads as ''.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(F.col("text").alias("text"), *carry).alias("row"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    phrases = stored(_windows(items, window))
    blocks = -(-max(1, phrases.count()) // block_windows)
    phrases = phrases.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    if blocks > 1:
        phrases = stored(phrases.repartitionByRange("block").sortWithinPartitions("block"))
    if blocks == 1:
        found = _searched(docs, phrases, window, shard_bytes, ["doc_id", "row"])
    else:
        docs = stored(docs.withColumn("n", F.monotonically_increasing_id()))
        parts = []
        for b in range(blocks):
            part = _searched(docs, phrases.filter(F.col("block") == b), window, shard_bytes, ["n"])
            # Every row has its number of words from the first block; else only rows with a hit are kept.
            parts.append(stored(part if b == 0 else part.filter(F.size("intervals") > 0)))
        each = parts[0].filter(F.size("intervals") > 0)
        for part in parts[1:]:
            each = each.unionByName(part)
        merged = each.groupBy("n").agg(_merged_intervals(F.flatten(F.collect_list("intervals"))).alias("intervals"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = docs.join(parts[0].select("n", "n_words"), "n").join(merged, "n", "left")
        found = found.withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in (("intervals", "array<struct<start: bigint, end: bigint>>"), ("items", "array<string>"))})
    hit = F.aggregate("intervals", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", "intervals", F.coalesce(hit, F.lit(0)).cast("long").alias("n_hit"), "items", "row.*")


def _searched(docs: DataFrame, block: DataFrame, window: int, shard_bytes: int, keep: list[str]) -> DataFrame:
    """The columns to keep of every document, its words, and where and whose the block's windows are in it."""
    phrases = docs.sparkSession.sparkContext.broadcast(Phrases(block.select("key", "items").toArrow(), window))
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_words", T.LongType()), T.StructField("intervals", spans), T.StructField("items", T.ArrayType(T.StringType()))])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches, shard_bytes):
            yield _shard(rows, phrases.value, keep)

    return docs.select(*keep, "text").mapInArrow(shards, schema)


def _merged_intervals(spans: Column) -> Column:
    """Intervals in order, with those that touch or overlap as one."""
    return F.aggregate(
        F.array_sort(spans), F.array().cast("array<struct<start: bigint, end: bigint>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )


def contaminated(share: int = 20) -> Column:
    """At least one word in `share` is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
