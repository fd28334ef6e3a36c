"""Exact search for the largest inner products: a ball tree a shard, searched by branch and bound from the best score that earlier shards leave."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import stored
from .vectors import exact, slices, whole

#: Vectors of a tree's leaf.
LEAF = 64
#: Vectors of a shard, and queries of a group that is searched in it: what a task holds.
SHARD_ROWS = 1 << 15
GROUP_ROWS = 1 << 13
#: Shards at least, where a shard keeps this many vectors.
_SHARDS, _LEAST_ROWS = 12, 1024
#: Each wave of shards is this many times all shards before it.
_WAVE = 3
#: Pairs of a query and a leaf that are scored at a time.
_PAIRS = 1 << 10
_LONG = 2**63 - 1
_NONE = 1 - 2**63
#: Pairs of a query and a node whose bounds are computed at a time.
_BOUNDS = 1 << 14
#: Bounds are raised by this share of their terms, for what doubles round off.
_SLACK = 1e-9
_FOUND = "own long, query_id long, row long, vec_id long, score long"


@dataclass
class Tree:
    """A balanced binary tree of balls over whole vectors, in levels: node i of a level has the children 2i and 2i + 1 below."""

    x: np.ndarray  # vectors, leaf by leaf
    ids: np.ndarray  # vec_id, the largest long for none
    rows: np.ndarray
    cuts: list[np.ndarray]  # by level: where each node's vectors begin, and the end
    center: list[np.ndarray]
    radius: list[np.ndarray]
    least: list[np.ndarray]  # smallest id in the node

    @classmethod
    def of(cls, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Tree:
        """Nodes are halved at the median of the direction from the point furthest from the center to the point furthest from that one."""
        depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / leaf))))
        y, order, cuts = x.astype(float), np.arange(len(x)), [np.array([0, len(x)])]
        for _ in range(depth):
            cut = [0]
            for a, b in zip(cuts[-1][:-1].tolist(), cuts[-1][1:].tolist(), strict=True):
                own = order[a:b]
                v = y[own]
                one = v[((v - v.mean(0)) ** 2).sum(1).argmax()] if len(v) else None
                middle = (b - a) // 2
                if middle:
                    other = v[((v - one) ** 2).sum(1).argmax()]
                    order[a:b] = own[np.argpartition(v @ (other - one), middle)]
                cut += [a + middle, b]
            cuts.append(np.array(cut))
        x, y, ids, rows = x[order], y[order], ids[order], rows[order]
        center, radius, least = [], [], []
        for cut in cuts:
            size = np.diff(cut)
            node, full = np.repeat(np.arange(len(size)), size), size > 0
            sums = np.zeros((len(size), x.shape[1]))
            sums[full] = np.add.reduceat(y, cut[:-1][full], 0) if full.any() else 0
            middle = sums / np.maximum(size, 1)[:, None]
            apart, low = np.zeros(len(size)), np.full(len(size), _LONG)
            if full.any():
                apart[full] = np.maximum.reduceat(np.sqrt(((y - middle[node]) ** 2).sum(1)), cut[:-1][full])
                low[full] = np.minimum.reduceat(ids, cut[:-1][full])
            center.append(middle)
            radius.append(np.where(full, apart * (1 + _SLACK), -1.0))
            least.append(low)
        return cls(x, ids, rows, cuts, center, radius, least)

    def bounds(self, level: int, nodes: np.ndarray, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """No vector of the node has a larger inner product with the query (scores are whole, so the bound is, too)."""
        middle, r = (q * self.center[level][nodes]).sum(1), self.radius[level][nodes]
        size = norm * np.sqrt((self.center[level][nodes] ** 2).sum(1))
        return np.where(r < 0, -np.inf, np.floor(middle + norm * r + _SLACK * (size + norm * np.maximum(r, 0)) + 1e-6))


@dataclass
class Best:
    """The k best of each query so far: score and id; row -1 for what is only known from other shards."""

    score: np.ndarray
    ids: np.ndarray
    rows: np.ndarray

    def open(self, at: np.ndarray, bound: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether a node of this bound and smallest id can still hold one of the query's k best."""
        kth = self.score[at, -1].astype(float)
        even = (bound > kth) | ((bound == kth) & (least < self.ids[at, -1]))
        return np.where(np.abs(kth) < 2**52, even, bound + np.abs(bound) * _SLACK + 1 >= kth)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Take further rows (a line each) of candidates for the queries `at`, each query once."""
        k = self.score.shape[1]
        score, ids, rows = np.hstack([self.score[at], score]), np.hstack([self.ids[at], ids]), np.hstack([self.rows[at], rows])
        order = np.lexsort((rows, ids, -score), 1)[:, :k]
        line = np.arange(len(at))[:, None]
        self.score[at], self.ids[at], self.rows[at] = score[line, order], ids[line, order], rows[line, order]


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole inner products of lines of q and of x (lines, leaf, components); beyond a long's range they are held at its ends."""
    a = exact(q, x)
    if a.dtype == np.int64:
        if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**52:  # doubles are exact there, and faster
            return np.matmul(x.astype(float), q.astype(float)[:, :, None])[:, :, 0].astype(np.int64)
        return (x * q[:, None]).sum(2)
    s = (x.astype(object) * a[:, None]).sum(2)
    return np.clip(s, _NONE + 1, _LONG).astype(np.int64)


def search(tree: Tree, q: np.ndarray, own: np.ndarray, best: Best) -> None:
    """Put each query's k best rows of the tree, other than its own row, into `best`.

    Each query first dives into the child of the larger bound, down to a leaf, which gives
    it a kth score.  Then the nodes are opened level by level from the root, where their
    bound may beat the kth score, and the leaves are scored in order of their bounds until
    the next one can't beat the kth score that has been reached.
    """
    if not len(q) or not len(tree.x):
        return
    norm = np.sqrt((q.astype(float) ** 2).sum(1)) * (1 + _SLACK)
    deep, y = len(tree.cuts) - 1, q.astype(float)
    every = np.arange(len(q))

    def score(at: np.ndarray, leaf: np.ndarray) -> None:
        for a in range(0, len(at), _PAIRS):
            line, node = at[a : a + _PAIRS], leaf[a : a + _PAIRS]
            begin, end = tree.cuts[deep][node], tree.cuts[deep][node + 1]
            place = begin[:, None] + np.arange(int((end - begin).max(initial=1)))
            there = (place < end[:, None]) & (tree.rows[np.minimum(place, len(tree.x) - 1)] != own[line, None])
            place = np.minimum(place, len(tree.x) - 1)
            s = np.where(there, _scores(q[line], tree.x[place]), _NONE)
            best.add(line, s, np.where(there, tree.ids[place], _LONG), np.where(there, tree.rows[place], _LONG))

    node = np.zeros(len(q), np.int64)
    for level in range(1, deep + 1):
        left, right = tree.bounds(level, 2 * node, y, norm), tree.bounds(level, 2 * node + 1, y, norm)
        node = 2 * node + (right > left)
    score(every, node)
    dived = node
    at, node, bound = every, np.zeros(len(q), np.int64), tree.bounds(0, np.zeros(len(q), np.int64), y, norm)
    for level in range(1, deep + 1):
        keep = best.open(at, bound, tree.least[level - 1][node])
        at, node, bound = at[keep].repeat(2), (2 * node[keep].repeat(2)), bound[keep].repeat(2)
        node[1::2] += 1
        some = [slice(a, a + _BOUNDS) for a in range(0, len(at), _BOUNDS)]
        bound = np.concatenate([np.minimum(bound[s], tree.bounds(level, node[s], y[at[s]], norm[at[s]])) for s in some] or [bound])
    fresh = node != dived[at]
    at, node, bound = at[fresh], node[fresh], bound[fresh]
    order = np.lexsort((-bound, at))
    at, node, bound = at[order], node[order], bound[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    for r in range(int(rank.max(initial=-1)) + 1):
        keep = best.open(at, bound, tree.least[deep][node]) & (rank >= r)
        at, node, bound, rank = at[keep], node[keep], bound[keep], rank[keep]
        if not len(at):
            break
        now = rank == r
        score(at[now], node[now])


def _cells(vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """One shard searched for one group of queries."""
    out = []
    vecs = dict(_by_length(vectors))
    for n, part in _by_length(queries):
        if n not in vecs:
            continue
        x, got = part.pop("x"), vecs[n]
        tree = Tree.of(got["x"], got["ids"], got["row"])
        for a in range(0, len(x), 512):
            mine = slice(a, a + 512)
            many = len(x[mine])
            best = Best(np.full((many, k), _NONE), np.full((many, k), _LONG), np.full((many, k), -1))
            best.score[:, -1], best.ids[:, -1] = part["floor"][mine], part["floor_id"][mine]
            known = part["floor"][mine] > _NONE
            # A known kth score stands for k rows that are at least as good.
            best.score[known] = best.score[known, -1:]
            best.ids[known] = best.ids[known, -1:]
            search(tree, x[mine], part["row"][mine], best)
            line, place = np.nonzero((best.score > _NONE) & (best.rows >= 0) & (best.rows < _LONG))
            out.append([part["row"][mine][line], part["ids"][mine][line], best.rows[line, place], best.ids[line, place], best.score[line, place]])
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
    own, query_id, row, ids, score = columns
    return pa.table({"own": own, "query_id": query_id, "row": row, "vec_id": pa.array(ids, mask=ids == _LONG), "score": score})


def _by_length(table: pa.Table) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    found: dict[int, list[dict[str, np.ndarray]]] = {}
    for batch in table.to_batches():
        size = pc.list_value_length(batch.column("x")).to_numpy(zero_copy_only=False)
        flat, at = batch.column("x").flatten().to_numpy(), np.cumsum(size) - size
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            part = {"x": flat[at[rows][:, None] + np.arange(n)]}
            for name in ("row", "vec_id", "floor", "floor_id"):
                if name in batch.schema.names:
                    part["ids" if name == "vec_id" else name] = pc.fill_null(batch.column(name), _LONG).to_numpy()[rows]
            found.setdefault(n, []).append(part)
    for n, parts in found.items():
        yield n, {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """row (a number of its own), vec_id and x, the whole components, of every vector that takes part."""
    given = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "embedding"):
            for rows, x in whole(batch.column("embedding"), scale):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(rows)), batch.column("vec_id").take(pa.array(rows)), lists], names=["row", "vec_id", "x"])

    return given.mapInArrow(run, "row long, vec_id long, x array<long>")


def waves(shards: int) -> list[tuple[int, int]]:
    """Ranges of shards: one shard, then each time so many that their number grows by a constant factor."""
    out, at = [], 0
    while at < shards:
        to = min(shards, max(1, at * (1 + _WAVE)))
        out.append((at, to))
        at = to
    return out


def top_inner_products(vectors: DataFrame, queries: str = "vec_id % 100 = 0", k: int = 10, scale: int = 1024, shard_rows: int = SHARD_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k vectors of the largest inner product.

    vectors: vec_id, embedding.  `queries` is an SQL condition over vec_id; a row's own
    vector is not among its results.  Components are floor(scale * x); vectors that are
    null or hold null or non-finite components take no part; vectors of different lengths don't meet.
    Of equal scores the smaller vec_id comes first, rows without vec_id (or with the largest long) last.  Rows that
    repeat a vec_id are rows of their own: each query row gets its own k ranks.  Scores
    beyond a long's range are held at its ends.

    Rows are dealt to shards by hash, queries to groups; a task builds a shard's tree and
    searches it for one group.  Shards come in waves of growing size: after each, the k
    best of every query are merged, and the next wave's trees are searched from
    that kth score on, so a query's rows from all shards are about k a wave.
    """
    given = stored(whole_vectors(vectors, scale))
    asked = stored(given.filter(queries))
    n, m = given.count(), asked.count()
    shards = max(1, -(-n // shard_rows), min(_SHARDS, n // _LEAST_ROWS))
    groups = max(1, -(-m // group_rows))
    number = lambda many, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(many)).cast("int")
    given = given.withColumn("shard", number(shards, 1))
    asked = asked.withColumn("grp", number(groups, 2))
    best = None
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("row")]
    place = F.row_number().over(W.partitionBy("own").orderBy(*order))
    for low, high in waves(shards):
        floor = asked.withColumn("floor", F.lit(_NONE)).withColumn("floor_id", F.lit(_LONG))
        if best is not None:
            kth = best.filter(F.col("rank") == k).select(F.col("own").alias("row"), F.col("score").alias("floor"), F.coalesce("vec_id", F.lit(_LONG)).alias("floor_id"))
            floor = asked.join(kth, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(_NONE))).withColumn("floor_id", F.coalesce("floor_id", F.lit(_LONG)))
        left = given.filter((F.col("shard") >= low) & (F.col("shard") < high)).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        right = floor.withColumn("shard", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        cells = left.groupBy("shard", "grp").cogroup(right.select("shard", "grp", "row", "vec_id", "x", "floor", "floor_id").groupBy("shard", "grp"))
        found = cells.applyInArrow(lambda a, b: _cells(a, b, k), _FOUND)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = stored(found.withColumn("rank", place).filter(F.col("rank") <= k))
    return best.select("query_id", "rank", "vec_id", "score")
