"""Substring dedup: rolling hashes of every fixed-length word window, counted over all documents."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import id_groups
from .tokens import Words, arrow_schema, byte_values, pack, unpack, window_hashes

#: Bytes of text for each bucket of window hashes.
BUCKET_BYTES = 16 << 20
_SHIPPED = "bucket int, g int, hashes binary, places binary"
_REMOVED = "g int, places binary"
_RESULT = "doc_id long, n_words long, intervals array<struct<start: long, end: long>>, n_removed long, kept string"


def _ordered(rows: pa.Table) -> pa.Table:
    """A group's rows in the order that decides which window comes first."""
    return rows.take(pc.sort_indices(rows, [("doc_id", "ascending"), ("text", "ascending")], null_placement="at_end")).combine_chunks()


def _column(rows: pa.Table, name: str) -> pa.Array:
    column = rows.column(name)
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _windows(rows: pa.Table, n: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the places (word numbers in the group) at which windows start, their hashes, and the first place of each hash."""
    words = Words(_column(rows, "text"))
    h = window_hashes(words.hashes(byte_values()), n)
    inside = np.flatnonzero(words.doc[: len(h)] == words.doc[n - 1 :]) if len(h) else np.zeros(0, np.int64)
    h = h[inside]
    _, first = np.unique(h, return_index=True)
    return words, inside, h, np.sort(first)


def _same_document(words: Words, ids: pa.Array) -> np.ndarray:
    """For each text, the number of the first text that repeats the same row."""
    same, out = {}, np.arange(len(words.count))
    for k, i in enumerate(ids.to_pylist()):
        if i is not None and k and ids[k - 1].as_py() == i and words.text(k) == words.text(k - 1):
            out[k] = same.get(k - 1, k - 1)
            same[k] = out[k]
    return out


def remove_repeated_windows(docs: DataFrame, window: int = 20, bytes_per_group: int = 6 << 20, rows_per_group: int = 4000, buckets: int | None = None) -> DataFrame:
    """Remove each word that lies in a window of `window` words which also starts earlier.

    Earlier: in a document with a smaller doc_id, or further ahead in the same document.
    Windows are judged on the input texts.  Documents are dealt into ranges of doc_id, in
    doc_id order; a group sends each window hash once, with its first place, to the hash's bucket; the bucket
    sends back the places that are not the first of all, and the group merges all repeated
    windows into maximal intervals of words and cuts them out.  A window that a third of
    all documents hold so reaches its bucket once a group.  There is a bucket for every 16 MB of text, unless
    their number is given.

    Windows are told apart by 64-bit hashes.  Returns doc_id, n_words, intervals (of word
    numbers, end exclusive), n_removed, kept (the words left, joined by one space).

    A null text has no words; rows without a doc_id come after all others; rows that
    repeat doc_id and text are one document and get the same result; rows that repeat
    doc_id with another text come in the order of the texts.  Other columns are not read.
    """
    grouped, size = id_groups(docs, bytes_per_group, rows_per_group)
    buckets = buckets or max(1, -(-size // BUCKET_BYTES))
    grouped = grouped.select("g", "doc_id", "text").repartition("g")

    def ship(key: tuple, rows: pa.Table) -> pa.Table:
        _, places, h, first = _windows(_ordered(rows), window)
        h, places = h[first], places[first]
        at = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(buckets + 1))
        out = []
        for b in np.flatnonzero(np.diff(cuts)):
            part = order[cuts[b] : cuts[b + 1]]
            out.append((int(b), key[0].as_py(), h[part].tobytes(), pack(np.diff(places[part], prepend=0))))
        return pa.Table.from_pylist([dict(zip(("bucket", "g", "hashes", "places"), x, strict=True)) for x in out], arrow_schema(_SHIPPED))

    def judge(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("g")
        groups, hashes = rows.column("g").to_pylist(), [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
        h = np.concatenate(hashes)
        later = np.zeros(len(h), bool)
        order = np.argsort(h, kind="stable")  # equal hashes stay in the order of groups and places
        later[order[1:]] = h[order[1:]] == h[order[:-1]]
        out, at = [], 0
        for g, x, places in zip(groups, hashes, rows.column("places").to_pylist(), strict=True):
            found = np.cumsum(unpack(places).astype(np.int64))[later[at : at + len(x)]]
            at += len(x)
            if len(found):
                out.append({"g": g, "places": pack(np.diff(found, prepend=0))})
        return pa.Table.from_pylist(out, arrow_schema(_REMOVED))

    def cut(rows: pa.Table, removed: pa.Table) -> pa.Table:
        rows = _ordered(rows)
        words, places, _, first = _windows(rows, window)
        repeated = np.ones(len(places), bool)
        repeated[first] = False
        starts = [places[repeated], *[np.cumsum(unpack(x).astype(np.int64)) for x in removed.column("places").to_pylist()]]
        edge = np.zeros(len(words) + 1, np.int64)
        for s in starts:
            np.add.at(edge, s, 1)
            np.add.at(edge, s + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        ids, same = _column(rows, "doc_id"), _same_document(words, _column(rows, "doc_id"))
        out = []
        for k, i in enumerate(ids.to_pylist()):
            f = same[k]  # a repeated row is the document that it repeats
            a, b = words.first[f], words.first[f + 1]
            x = gone[a:b]
            body = words.text(f).split()
            turn = np.flatnonzero(np.diff(np.concatenate([[0], x.view(np.int8), [0]])))
            kept = body if not len(turn) else [w for w, y in zip(body, x.tolist(), strict=True) if not y]
            out.append({
                "doc_id": i, "n_words": int(b - a), "intervals": [{"start": s, "end": e} for s, e in turn.reshape(-1, 2).tolist()],
                "n_removed": int(x.sum()), "kept": b" ".join(kept).decode(),
            })
        return pa.Table.from_pylist(out, arrow_schema(_RESULT))

    shipped = grouped.groupBy("g").applyInArrow(ship, _SHIPPED)
    removed = shipped.groupBy("bucket").applyInArrow(judge, _REMOVED)
    return grouped.groupBy("g").cogroup(removed.groupBy("g")).applyInArrow(cut, _RESULT)
