"""SimHash fingerprints of documents, and near duplicates by exact comparison of tiles of fingerprints."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .tokens import arrow_schema

_U = np.uint64
#: Bits are counted over this many shingles at a time.
_COUNTED = 1 << 14
#: Groups of up to this many fingerprints are compared by shifting the column against itself.
_SMALL = 32
#: Fingerprints in a tile.
TILE = 2048


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text: a bit is set if it is set in over half of the shingles' hashes.

    Shingles are `shingle` consecutive words joined by a blank, repeats included (a text of
    fewer words is one shingle; none: 0); A-Z is lower-cased; hashes are XXH64 with seed 42.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts, ends = [0, *(ends[: n - 1] + 1).tolist()], ends[len(words) - n :].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _COUNTED):
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[at : at + _COUNTED], ends[at : at + _COUNTED], strict=True)], _U)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(_U)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of every row; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in rows.column("text")], _U).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fps)], schema=arrow_schema("doc_id long, fp long"))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _stars(fps: np.ndarray, radius: int, tile: int = TILE) -> np.ndarray:
    """Links of one large group as stars: pairs (fingerprint, least fingerprint that it reaches within the group).

    Fingerprints are ordered by population count and cut into tiles; two tiles are compared
    (exclusive or and bit counts, all against all) unless their population counts lie
    further apart than the radius.
    """
    fps = np.unique(fps)
    pop = np.bitwise_count(fps)
    order = np.argsort(pop, kind="stable")
    fps, pop = fps[order], pop[order].astype(np.int64)
    label = np.arange(len(fps))
    for i in range(0, len(fps), tile):
        for j in range(i, len(fps), tile):
            if pop[j] - pop[min(i + tile, len(fps)) - 1] > radius:
                break
            a, b = np.nonzero(np.bitwise_count(fps[i : i + tile, None] ^ fps[None, j : j + tile]) <= radius)
            a, b = a + i, b + j
            while True:
                x, y = label[a], label[b]
                differ = x != y
                if not differ.any():
                    break
                a, b, x, y = a[differ], b[differ], x[differ], y[differ]
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while (label != (up := label[label])).any():
                    label = up
    linked = label != np.arange(len(fps))
    return np.stack([fps[linked], fps[label[linked]]], 1)


def _links(radius: int):
    """Compare the fingerprints of each cell; rows come sorted by cell."""

    def close(cells: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]).any(1)))
        size = np.diff(np.append(start, len(fps)))
        out = [np.zeros((0, 2), _U)]
        small = np.repeat(size <= _SMALL, size)
        group = np.repeat(np.arange(len(size)), size)
        for d in range(1, min(_SMALL, int(size.max(initial=0)))):
            near = small[:-d] & (group[:-d] == group[d:]) & (np.bitwise_count(fps[:-d] ^ fps[d:]) <= radius)
            out.append(np.stack([fps[:-d][near], fps[d:][near]], 1))
        out += [_stars(fps[s : s + n], radius) for s, n in zip(start[size > _SMALL].tolist(), size[size > _SMALL].tolist(), strict=True)]
        pairs = np.concatenate(out).view(np.int64)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=arrow_schema("u long, v long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for rows in batches:
            held.append(np.stack([rows.column(c).to_numpy() for c in ("block", "part", "a", "b", "fp")], 1))
            if rows.num_rows and not (held[-1][0, :4] == held[-1][-1, :4]).all():
                x = np.concatenate(held)
                last = int(np.flatnonzero((x[:, :4] != x[-1, :4]).any(1))[-1]) + 1  # the last cell may go on
                yield close(x[:last, :4], x[:last, 4].view(_U) if x.flags.f_contiguous else np.ascontiguousarray(x[:last, 4]).view(_U))
                held = [x[last:]]
        if held and len(x := np.concatenate(held)):
            yield close(x[:, :4], np.ascontiguousarray(x[:, 4]).view(_U))

    return run


def near_pairs(fps: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp) that differ in at most `radius` bits; every such pair is joined by links.

    The 64 bits are cut into radius + 2 blocks: fingerprints within the radius agree in two
    of them at least, so only those that share a pair of blocks are compared.  What shares
    one is a cell.  Cells over 2 tiles are cut into tiles by population count (and further
    by hash, if one count fills several); each two tiles whose counts are within the radius are a
    cell of their own.
    """
    n = radius + 2
    edges = [round(i * 64 / n) for i in range(n + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    both = [a | b for a, b in combinations(masks, 2)]
    signed = [m - 2**64 if m >= 2**63 else m for m in both]
    keyed = fps.select("fp").distinct().select(
        "fp", F.bit_count("fp").cast("long").alias("pop"), F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("block", "part"),
    ).withColumn("block", F.col("block").cast("long"))
    counts = stored(keyed.groupBy("block", "part", "pop").agg(F.count(F.lit(1)).alias("n")))
    cells = counts.groupBy("block", "part").agg(F.sum("n").alias("total")).filter("total > 1")
    rows = keyed.join(cells, ["block", "part"])
    light = rows.filter(F.col("total") <= 2 * tile).select("block", "part", F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), "fp")
    tiles = stored(counts.join(cells.filter(F.col("total") > 2 * tile), ["block", "part"]).select("block", "part", "pop", F.ceil(F.col("n") / tile).cast("long").alias("subs")))
    other = tiles.select("block", "part", F.col("pop").alias("pop2"), F.col("subs").alias("subs2"))
    heavy = (
        rows.filter(F.col("total") > 2 * tile).join(tiles, ["block", "part", "pop"])
        .withColumn("own", F.col("pop") * F.lit(1 << 32) + F.pmod(F.xxhash64("fp"), F.col("subs")))
        .withColumn("pop2", F.explode(F.sequence(F.col("pop") - radius, F.col("pop") + radius))).join(other, ["block", "part", "pop2"])
        .withColumn("sub2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs2") - 1)))
        .withColumn("two", F.col("pop2") * F.lit(1 << 32) + F.col("sub2"))
        .select("block", "part", F.least("own", "two").alias("a"), F.greatest("own", "two").alias("b"), "fp")
    )
    cell = ["block", "part", "a", "b"]
    return light.unionByName(heavy).repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_links(radius), "u long, v long").distinct()


def _starred(state: DataFrame) -> bool:
    """Whether every link (u to a smaller v) binds its larger node to a root: no node has two smaller neighbours, or one and a larger one."""
    ends = state.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).filter("ups > 1 or ups = 1 and low = 0").count() == 0


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node that each linked node reaches, by alternating large and small stars.

    Each round points every node's larger neighbours, then its smaller ones, at the least
    node around it; each is one aggregation with partial minima and one join.  Both steps are
    written to the shared folder, so that a plan reads a table three times at most (the driver
    keeps the plans and their metrics); rounds end when all links are stars.
    """
    state = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    while not _starred(state):
        back = F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
        least = state.select(F.inline(F.array(F.struct("u", "v"), back))).groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Links run from larger to smaller nodes: turned back, they lead to a node's larger neighbours.
        large = stored(state.select(back.alias("x")).select("x.*").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # Bind each node's smaller neighbours to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    return state.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id: documents joined by chains of fingerprints that differ in at most `radius` bits.

    component_id is the smallest doc_id of the component, null if none of its rows has one.
    Every row of docs gives a row: repeated rows share fingerprint and component, texts without words
    have the fingerprint 0 and are linked like any others.  Copies meet in their fingerprint, so only distinct fingerprints are compared.
    """
    marked = stored(fingerprints(docs, shingle))
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_pairs(classes, radius))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")
