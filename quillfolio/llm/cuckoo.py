"""Line dedup that can take documents back: sharded cuckoo filters in front of exact reference tables."""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import scratch, stored
from .tokens import arrow_schema, mix

_U = np.uint64
_BLANKS = b" \t\n\x0b\x0c\r"
_KEYS = "hi long, lo long, doc long, twin long"
_KEY = ["shard", "hi", "lo"]
#: Stands for a missing doc_id: after all others.
_LAST = 2**63 - 1
#: A key with more than 1/_HOT of all references is frequent; so at most _HOT keys are.
_HOT = 4096


def line_key(line: bytes, least: int) -> bytes | None:
    """128 bits of a line without blanks at its ends and with A-Z lower-cased; None for one under `least` characters."""
    line = line.strip(_BLANKS).lower()
    if len(line) < least or (len(line) < 4 * least and len(line.decode()) < least):
        return None
    return xxhash.xxh3_128_digest(line)


class CuckooFilter:
    """A set of 128-bit keys as 16-bit fingerprints, four to a bucket; each key has two buckets.

    Holds no false negatives; keys that were added can be deleted.  If a table fills up,
    another of twice the size is put behind it.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, tables: list[np.ndarray] | None = None):
        self.tables = tables or []

    @classmethod
    def from_bytes(cls, data: bytes | None) -> CuckooFilter:
        tables, at = [], 0
        while data and at < len(data):
            n = int.from_bytes(data[at : at + 8], "little")
            tables.append(np.frombuffer(data, np.uint16, n * cls.SLOTS, at + 8).reshape(n, cls.SLOTS).copy())
            at += 8 + n * cls.SLOTS * 2
        return cls(tables)

    def to_bytes(self) -> bytes:
        return b"".join(len(t).to_bytes(8, "little") + t.tobytes() for t in self.tables)

    @staticmethod
    def _mark(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        return (lo.view(_U) % _U(65535) + _U(1)).astype(np.uint16)

    @staticmethod
    def _other(bucket: np.ndarray, mark: np.ndarray, n: int) -> np.ndarray:
        return bucket ^ (mix(mark.astype(_U)) & _U(n - 1)).astype(np.int64)

    @staticmethod
    def _home(hi: np.ndarray, n: int) -> np.ndarray:
        return (mix(hi.view(_U)) & _U(n - 1)).astype(np.int64)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        found, mark = np.zeros(len(hi), bool), self._mark(hi, lo)
        for t in self.tables:
            a = self._home(hi, len(t))
            found |= (t[a] == mark[:, None]).any(1) | (t[self._other(a, mark, len(t))] == mark[:, None]).any(1)
        return found

    def add(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Add keys that are not in the set; rounds place all that still find a free slot, the rest push others out."""
        while len(hi):
            if not self.tables or (self.tables[-1] == 0).mean() < 0.08:
                size = max(64, 2 * len(self.tables[-1]) if self.tables else 0, 1 << int(np.ceil(np.log2(len(hi) / self.SLOTS / 0.8 + 1))))
                self.tables.append(np.zeros((size, self.SLOTS), np.uint16))
            t = self.tables[-1]
            mark, at, own = self._mark(hi, lo), self._home(hi, len(t)), np.arange(len(hi))
            before, log = t.copy(), []
            for _ in range(self.KICKS):
                for _ in (0, 1):
                    at, mark, own = self._place(t, at, mark, own)
                    at = self._other(at, mark, len(t))
                if not len(at):
                    break
                # One newcomer a bucket takes the place of a held mark, which moves on to its other bucket.
                bucket, who = np.unique(at, return_index=True)
                slot = (mix(bucket.astype(_U) + _U(len(log))) % _U(self.SLOTS)).astype(np.int64)
                log.append(len(bucket))
                out = t[bucket, slot].copy()
                t[bucket, slot] = mark[who]
                mark = mark.copy()
                mark[who] = out
                at = at.copy()
                at[who] = self._other(bucket, out, len(t))
            if not len(at):
                return
            # Marks that found no place: undo, and put all of these keys into a larger table.
            self.tables[-1] = before
            self.tables.append(np.zeros((max(2 * len(before), 1 << int(np.ceil(np.log2(len(hi) / self.SLOTS / 0.6 + 1)))), self.SLOTS), np.uint16))

    def _place(self, t: np.ndarray, at: np.ndarray, mark: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Put marks into free slots of their buckets; returns those left over."""
        order = np.argsort(at, kind="stable")
        at, mark, own = at[order], mark[order], own[order]
        first = np.searchsorted(at, at)
        nth = np.arange(len(at)) - first
        free = t[at] == 0
        fits = nth < free.sum(1)
        slot = np.argmax(np.cumsum(free, 1) == (nth + 1)[:, None], 1)
        t[at[fits], slot[fits]] = mark[fits]
        return at[~fits], mark[~fits], own[~fits]

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Take out keys that were added, one mark each."""
        mark, todo = self._mark(hi, lo), np.arange(len(hi))
        for t in self.tables:
            home = self._home(hi, len(t))
            for at in (home, self._other(home, mark, len(t))):
                while len(todo):
                    # Of the keys that look into a bucket for one mark, one at a time takes a slot.
                    _, one = np.unique(at[todo] * 65536 + mark[todo], return_index=True)
                    now = todo[one]
                    hit = t[at[now]] == mark[now, None]
                    there = hit.any(1)
                    if not there.any():
                        break
                    t[at[now[there]], hit[there].argmax(1)] = 0
                    todo = np.setdiff1d(todo, now[there])


def _documents(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(F.col("text").alias("text"), *carry).alias("row"),
    ).withColumn("twin", F.xxhash64("text"))


@dataclass(frozen=True)
class LineIndex:
    """Which documents hold which lines: a folder of tables that grows by the batch.

    refs: a row for each (line key, document) with +1 when it comes and -1 when it goes;
    their sum is the exact reference count.  filters: a cuckoo filter for each shard of
    keys, rewritten for the shards that a batch touches, holding the keys with a count above 0.  repeats: the keys
    that a batch found in several documents.  Each key of a batch is looked up in its shard's filter first: one that
    the filter does not know is new for certain, and only the others meet the exact table.  Counts are taken
    of repeated keys alone.

    insert() and delete() return the index after the batch; a version counts once its filters are
    written, so a batch that broke off is simply run again.  open() finds the newest version of a folder;
    compact() nets all versions into one, so that what a batch reads follows the lines that are held.  A document is a row's
    (doc_id, text): rows that repeat both are one document, rows that repeat a doc_id with another
    text, or have none, are documents of their own (ordered by a hash of the text; without
    a doc_id after all others).  Null texts are empty: one empty line.
    """

    spark: SparkSession
    path: str
    version: int = 0
    shards: int = 64
    least: int = 10

    @classmethod
    def new(cls, spark: SparkSession, path: str | None = None, shards: int | None = None, least: int = 10) -> LineIndex:
        """An empty index in `path` (a fresh folder below the checkpoint folder by default).

        A shard's keys and filter are one task's; there are as many shards as shuffle
        partitions, 64 at least, unless their number is given: about one for a million distinct lines.
        """
        shards = shards or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
        index = cls(spark, path or scratch(spark), 0, shards, least)
        spark.createDataFrame([(shards, least)], "shards int, least int").coalesce(1).write.parquet(f"{index.path}/about")
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineIndex:
        """The index in a folder, at its newest whole version."""
        about = spark.read.parquet(f"{path}/about").first()
        index = cls(spark, path, 0, about.shards, about.least)
        names = index._whole()
        n = max([int(x[4:]) for x in names if x.startswith("base")], default=0)
        while f"v{n + 1}" in names:
            n += 1
        return cls(spark, path, n, about.shards, about.least)

    def _folder(self, name: str):
        """A folder of the index, and its file system."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _whole(self) -> set[str]:
        """The versions whose filters, which are written last, are there."""
        at, fs = self._folder(f"{self.path}/filters")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return {x for x in names if fs.exists(self._folder(f"{self.path}/filters/{x}/_SUCCESS")[0])}

    def _tables(self, kind: str) -> list[str]:
        """The folders that hold a kind of table: the newest compacted version's, and those of the batches since."""
        base = max([n for x in self._whole() if x.startswith("base") and (n := int(x[4:])) <= self.version], default=0)
        return [f"{self.path}/{kind}/base{base}"] * (base > 0) + [f"{self.path}/{kind}/v{n}" for n in range(base + 1, self.version + 1)]

    def _read(self, kind: str, schema: str) -> DataFrame:
        folders = self._tables(kind)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _refs(self) -> DataFrame:
        return self._read("refs", f"shard int, {_KEYS}, change int")

    def _filters(self) -> DataFrame:
        """Each shard's newest filter."""
        rows = self._read("filters", "shard int, filter binary, version int")
        newest = rows.groupBy("shard").agg(F.max("version").alias("version"))
        return rows.join(newest, ["shard", "version"]).select("shard", "filter")

    def live(self) -> DataFrame:
        """shard, hi, lo, doc, twin: the references that are held now."""
        rows = self._refs()
        if len(self._tables("refs")) < 2:
            return rows.drop("change")
        return rows.groupBy("shard", "hi", "lo", "doc", "twin").agg(F.sum("change").alias("held")).filter("held > 0").drop("held")

    def keys(self, docs: DataFrame) -> DataFrame:
        """shard, hi, lo, doc, twin: a row for each document and distinct key of its lines."""
        least = self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                digests, count = [], []
                for text in rows.column("text"):
                    held = {line_key(x, least) for x in text.as_py().encode().split(b"\n")} - {None}
                    digests += held
                    count.append(len(held))
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                which = np.repeat(np.arange(rows.num_rows), count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:, 0]), pa.array(both[:, 1]), rows.column("doc").take(pa.array(which)), rows.column("twin").take(pa.array(which))],
                    schema=arrow_schema(_KEYS),
                )

        found = _documents(docs).select("doc", "twin", "text").mapInArrow(run, _KEYS)
        return found.withColumn("shard", F.pmod("hi", F.lit(self.shards)).cast("int")).distinct()

    def probe(self, keys: DataFrame) -> DataFrame:
        """shard, hi, lo, maybe: whether a shard's filter knows each distinct key; False is certain."""

        def run(key: tuple, keys: pa.Table, filters: pa.Table) -> pa.Table:
            held = CuckooFilter.from_bytes(filters.column("filter")[0].as_py() if filters.num_rows else None)
            hi, lo = keys.column("hi").to_numpy(), keys.column("lo").to_numpy()
            return pa.table({"shard": keys.column("shard"), "hi": keys.column("hi"), "lo": keys.column("lo"), "maybe": held.contains(hi, lo)})

        return keys.groupBy("shard").cogroup(self._filters().groupBy("shard")).applyInArrow(run, "shard int, hi long, lo long, maybe boolean")

    def _changed(self, keys: DataFrame, add: bool) -> DataFrame:
        """The filters of the shards that gain or lose keys."""

        def run(key: tuple, keys: pa.Table, filters: pa.Table) -> pa.Table:
            if not keys.num_rows:
                return pa.table({"shard": pa.array([], pa.int32()), "filter": pa.array([], pa.binary())})
            held = CuckooFilter.from_bytes(filters.column("filter")[0].as_py() if filters.num_rows else None)
            hi, lo = keys.column("hi").to_numpy(), keys.column("lo").to_numpy()
            held.add(hi, lo) if add else held.delete(hi, lo)
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([held.to_bytes()], pa.binary())})

        return keys.groupBy("shard").cogroup(self._filters().groupBy("shard")).applyInArrow(run, "shard int, filter binary")

    def _write(self, refs: DataFrame, change: int, keys: DataFrame, repeats: DataFrame, add: bool) -> LineIndex:
        """The next version: references that come or go, repeated keys, and the filters with the keys that come or go."""
        n = self.version + 1
        refs.withColumn("change", F.lit(change)).write.mode("overwrite").parquet(f"{self.path}/refs/v{n}")
        repeats.write.mode("overwrite").parquet(f"{self.path}/repeats/v{n}")
        self._changed(keys, add).withColumn("version", F.lit(n)).write.mode("overwrite").parquet(f"{self.path}/filters/v{n}")
        return LineIndex(self.spark, self.path, n, self.shards, self.least)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Take in the lines of docs; documents that are in already change nothing."""
        came = stored(self.keys(docs))
        each = stored(came.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")))
        several = each.filter("n > 1").select(*_KEY)
        if not self.version:
            return self._write(came, 1, each.select(*_KEY), several, True)
        probed = stored(self.probe(each.select(*_KEY)))
        # What the filter takes for known is looked up; a wrong guess is new as well.
        maybe = probed.filter("maybe").select(*_KEY)
        known = stored(self.live().join(maybe, _KEY, "left_semi"))
        held = stored(known.select(*_KEY).distinct())
        new = probed.filter("not maybe").select(*_KEY).unionByName(maybe.join(held, _KEY, "left_anti"))
        refs = came.join(known, [*_KEY, "doc", "twin"], "left_anti")
        return self._write(refs, 1, new, several.unionByName(held).distinct(), True)

    def insert_batches(self, docs: DataFrame, batches: int = 2) -> LineIndex:
        """Take in docs in some batches, dealt by a hash of the text: each batch meets the filters of those before it."""
        index = self
        for n in range(batches):
            index = index.insert(docs.filter(F.pmod(F.xxhash64("text"), F.lit(batches)) == n))
        return index

    def delete(self, docs: DataFrame) -> LineIndex:
        """Take documents back, by doc_id; keys whose count falls to 0 leave the filters."""
        ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc")).distinct()
        gone = stored(self.live().join(ids, "doc", "left_semi").select("shard", "hi", "lo", "doc", "twin"))
        keys = gone.select(*_KEY).distinct()
        left = self.live().join(keys, _KEY, "left_semi").join(ids, "doc", "left_anti").select(*_KEY).distinct()
        return self._write(gone, -1, keys.join(left, _KEY, "left_anti"), keys.limit(0), False)

    def compact(self) -> LineIndex:
        """Net all versions into one set of tables and remove the folders that it replaces."""
        n, old = self.version, [f for kind in ("refs", "repeats", "filters") for f in self._tables(kind)]
        if not n or self._tables("filters") == [f"{self.path}/filters/base{n}"]:
            return self
        self.live().withColumn("change", F.lit(1)).write.mode("overwrite").parquet(f"{self.path}/refs/base{n}")
        self.counts().filter("n_docs > 1").select(*_KEY).write.mode("overwrite").parquet(f"{self.path}/repeats/base{n}")
        self._filters().withColumn("version", F.lit(n)).write.mode("overwrite").parquet(f"{self.path}/filters/base{n}")
        for folder in old:
            at, fs = self._folder(folder)
            fs.delete(at, True)
        return self

    def counts(self) -> DataFrame:
        """shard, hi, lo, n_docs, first, first_twin: the exact count of each key that was found repeated, and the document that keeps it."""
        repeats = self._read("repeats", "shard int, hi long, lo long").distinct()
        each = self.live().join(repeats, _KEY, "left_semi").groupBy("shard", "hi", "lo", "doc").agg(F.count(F.lit(1)).alias("n"), F.min("twin").alias("t"))
        return each.groupBy("shard", "hi", "lo").agg(F.sum("n").alias("n_docs"), F.min("doc").alias("first"), F.min_by("t", "doc").alias("first_twin"))

    def deduplicated(self, docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept, text and the columns to carry: each row of docs, and its text without the lines that an earlier document of the index keeps.

        Every line of a key that two documents hold goes, but for those in the document
        with the smallest doc_id; other lines stay, joined by newlines.
        """
        refs, many = self.live(), stored(self.counts().filter("n_docs > 1"))
        # The references of a frequent key stay where they are: their keys, at most _HOT, are broadcast.
        frequent = F.col("n_docs") * _HOT > refs.count()
        hot = F.broadcast(many.filter(frequent).drop("n_docs"))
        rare = refs.join(hot, _KEY, "left_anti").join(many.filter(~frequent).drop("n_docs"), _KEY)
        drop = refs.join(hot, _KEY).unionByName(rare).filter("doc <> first or twin <> first_twin")
        lists = drop.groupBy("doc", "twin").agg(F.collect_list(F.struct("hi", "lo")).alias("drop"))
        least = self.least

        joined = _documents(docs, carry).join(lists, ["doc", "twin"], "left").select("doc_id", "row", "drop")
        result = T.StructType([
            T.StructField("doc_id", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType()),
            joined.schema["row"],
        ])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                held, out = rows.column("row"), []
                for text, drop in zip(pc.struct_field(held, [0]), rows.column("drop"), strict=True):
                    lines = (text.as_py() or "").encode().split(b"\n")
                    keys = np.stack([drop.values.field("hi").to_numpy(), drop.values.field("lo").to_numpy()], 1) if drop.is_valid else np.zeros((0, 2), np.int64)
                    gone = {x.tobytes() for x in keys}
                    kept = [x for x in lines if line_key(x, least) not in gone] if gone else lines
                    out.append((len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
                n, dropped, kept = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string()), held], names=["doc_id", "n_lines", "n_dropped", "kept", "row"]
                )

        return joined.mapInArrow(run, result).select("doc_id", "n_lines", "n_dropped", "kept", "row.*")
