"""Linear text classifiers: n-gram indicators scaled by class log-count ratios, hinge loss by dual coordinate descent."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored
from .tokens import Words, arrow_schema, byte_values, distinct, mix, pack, pieces, unpack

_U = np.uint64
#: Features are hashed to this many numbers.
SPACE = 1 << 18
#: Labelled rows are dealt to this many folds by a hash of doc_id and text.
FOLDS = 4
#: N-grams in fewer texts have no weight.
LEAST = 3
#: A text's words are taken in pieces of about this many bytes of a batch.
_PIECE = 2 << 20

_letters = np.zeros(256, bool)
_letters[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_upper = np.zeros(256, np.int64)
_upper[0x41:0x5B] = 1
_lower = np.zeros(256, np.int64)
_lower[0x61:0x7B] = 1
_marks = np.where(_letters, _U(0), byte_values())
_marks[0x30:0x3A] = _marks[0x30]


def indicators(column: pa.Array, space: int = SPACE, chars: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the n-grams that each text holds, each once: limits (where a text's begin) and numbers.

    N-grams: lower-cased words, pairs of words, and one and two words' shapes (the signs
    and digits around the letters, whether letters are all, partly or not upper case, and
    whether a word comes twice).  With `chars` also the runs of letters, and every `chars`
    bytes in a row within one.
    """
    words = Words(column)
    n, low = len(words), words.hashes(byte_values(lower=True))

    def within(values: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(words.data) + 1, values.dtype)
        np.cumsum(values[words.data], out=sums[1:])
        return sums[words.ends] - sums[words.starts]

    upper, lower = within(_upper), within(_lower)
    case = np.where(upper == 0, 0, np.where((lower == 0) & (upper > 1), 2, 1)).astype(_U)
    shape = mix(within(_marks) + case * _U(0x9E3779B97F4A7C15) + _U(11))
    pair = np.flatnonzero(words.doc[:-1] == words.doc[1:]) if n else np.zeros(0, np.int64)
    join = lambda h: mix(h[pair] * _U(0xD1342543DE82EF95) + h[pair + 1])
    twice = (low[pair] == low[pair + 1]).astype(_U) * _U(0xA24BAED4963EE407) if n else np.zeros(0, _U)
    grams, docs = [low, join(low), shape, join(shape) + twice], [words.doc, words.doc[pair], words.doc, words.doc[pair]]
    if chars:
        runs = Words(column, _letters)
        grams.append(runs.hashes(byte_values(lower=True)) + _U(1))
        docs.append(runs.doc)
        # Windows of bytes, by word of letters: the place of each window's start, then its hash as a sum over its bytes.
        width = np.maximum(runs.ends - runs.starts - chars + 1, 0)
        start = np.repeat(runs.starts - np.cumsum(width) + width, width) + np.arange(width.sum())
        sums = np.zeros(len(start), _U)
        values, step = byte_values(lower=True), _U(0x9E3779B97F4A7C15)
        for k in range(chars):
            sums = sums * step + values[runs.data[start + k]]
        grams.append(mix(sums))
        docs.append(np.repeat(runs.doc, width))
    kind = np.int32 if len(words.count) * space < 2**31 else np.int64
    held = distinct(np.concatenate(docs).astype(kind) * kind(space) + (np.concatenate(grams) % _U(space)).astype(kind))
    return np.searchsorted(held, np.arange(len(words.count) + 1) * space), held % space


def _order() -> Column:
    return F.xxhash64("doc_id", "text")


@dataclass
class Counts:
    """How many texts of class 0 and 1 hold each n-gram, by fold: the n-grams that enough texts hold, and sums over all."""

    feature: np.ndarray  # numbers of the n-grams, ascending
    held: np.ndarray  # (2, folds, n-grams)
    sums: np.ndarray  # (2, folds), rare n-grams too
    space: int

    def ratios(self, without: int | None = None, least: int = LEAST) -> np.ndarray:
        """Log of the ratio of the smoothed shares that an n-gram has in class 1 and in class 0, by its number; 0 for n-grams in fewer than `least` texts.

        `without` leaves a fold's texts out.
        """
        folds = [f for f in range(FOLDS) if f != without]
        held, sums = self.held[:, folds].sum(1), self.sums[:, folds].sum(1) + float(self.space)
        zero, one = held + 1.0
        out = np.zeros(self.space)
        out[self.feature] = np.where(held.sum(0) >= least, np.log(one / sums[1]) - np.log(zero / sums[0]), 0.0)
        return out


def class_counts(rows: DataFrame, classes: list[str], space: int = SPACE, chars: int = 0) -> DataFrame:
    """How many texts of each class and fold hold each n-gram, as a written table for counts_of().

    rows: doc_id, text and 0/1 columns.  A task sums its rows; the sums meet by n-gram, and
    n-grams in fewer than LEAST texts are left out, but for the sums over all n-grams, which stand under -1
    with the number of rows (`texts`).
    """
    names = [f"c{k}_{f}" for k in range(2 * len(classes)) for f in range(FOLDS)]
    ddl = ", ".join(["feature int", "texts long", *[f"{c} long" for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, texts = np.zeros((2 * len(classes), FOLDS * space), np.int32), 0
        for part in pieces(batches, _PIECE):
            texts += part.num_rows
            limits, held = indicators(part.column("text"), space, chars)
            held = held + np.repeat(part.column("fold").to_numpy() * space, np.diff(limits))
            for k, c in enumerate(classes):
                y = np.repeat(part.column(c).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(limits))
                for v in (0, 1):
                    sums[2 * k + v] += np.bincount(held[y == v], minlength=FOLDS * space).astype(np.int32)
        sums = sums.reshape(len(names), space)
        on = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([texts]), *[pa.array([int(s.sum(dtype=np.int64))]) for s in sums]], schema=arrow_schema(ddl))
        for at in range(0, len(on), 1 << 14):
            some = on[at : at + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.zeros(len(some), np.int64)), *[pa.array(s[some].astype(np.int64)) for s in sums]], schema=arrow_schema(ddl))

    cells = rows.select("text", F.pmod(_order(), F.lit(FOLDS)).alias("fold"), *classes).mapInArrow(run, ddl)
    total = sum((F.col(c) for c in names[: 2 * FOLDS]), F.lit(0))
    return stored(cells.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ["texts", *names]]).filter((F.col("feature") < 0) | (total >= LEAST)))


def _columns(k: int) -> list[str]:
    """The k-th class's columns of class_counts()."""
    return [f"c{2 * k + v}_{f}" for v in (0, 1) for f in range(FOLDS)]


def _counts(parts: list[tuple[np.ndarray, np.ndarray]], space: int) -> Counts:
    """Counts from n-grams in any order, with a row of numbers for each column."""
    feature = np.concatenate([np.zeros(0, np.int32), *[f for f, _ in parts]])
    order = np.argsort(feature, kind="stable")
    held = np.concatenate([np.zeros((2 * FOLDS, 0), np.int64), *[h for _, h in parts]], 1)[:, order]
    feature, held = feature[order], held.reshape(2, FOLDS, len(feature))
    first = int(np.searchsorted(feature, 0))
    return Counts(feature[first:], held[:, :, first:], held[:, :, :first].sum(2), space)


def counts_of(table: DataFrame, k: int = 0, space: int = SPACE) -> Counts:
    """The counts of the k-th class, at most `space` rows of a few numbers, brought to the driver."""
    got = table.select("feature", *_columns(k)).toArrow()
    return _counts([(got.column("feature").to_numpy(), np.stack([got.column(c).to_numpy() for c in _columns(k)]))], space)


def sampled(rows: DataFrame, key: Column, most: int, n: int) -> DataFrame:
    """About `most` of n rows by a hash of the key: all rows if there are no more."""
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64(key, F.lit("fit")), F.lit(1 << 30)) < int((1 << 30) * (most / n)))


def _numbered(rows: DataFrame, classes: list[str], features: np.ndarray, space: int, chars: int) -> DataFrame:
    """order, held (the text's n-gram numbers, of the given ones) and the labels of each row."""
    wanted = np.zeros(space, bool)
    wanted[features] = True
    bits = np.packbits(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(bits, count=space).astype(bool)
        for part in pieces(batches, _PIECE):
            limits, held = indicators(part.column("text"), space, chars)
            texts = [held[a:b] for a, b in zip(limits[:-1], limits[1:], strict=True)]
            blobs = [t[wanted[t]].astype(np.int32).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("order"), pa.array(blobs, pa.binary()), *[part.column(c) for c in classes]], schema=arrow_schema(ddl))

    ddl = ", ".join(["order long", "held binary", *[f"{c} int" for c in classes]])
    return rows.select(_order().alias("order"), "text", *[F.col(c).cast("int").alias(c) for c in classes]).mapInArrow(run, ddl)


def _gathered(got: list[pa.RecordBatch], classes: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The n-gram numbers, labels and folds of _numbered()'s rows, in an order that does not depend on partitions."""
    order = np.concatenate([np.zeros(0, np.int64), *[b.column("order").to_numpy() for b in got]])
    place = np.argsort(order, kind="stable")
    labels = np.stack([np.concatenate([np.zeros(0, np.int32), *[b.column(c).to_numpy() for b in got]]) for c in classes], 1)[place]
    # The texts are views of what came; their numbers are not copied.
    texts = [np.frombuffer(x.as_buffer(), np.int32) if x.as_buffer().size else np.zeros(0, np.int32) for b in got for x in b.column("held")]
    return [texts[i] for i in place.tolist()], labels, order[place] % FOLDS


def collected(rows: DataFrame, classes: list[str], features: np.ndarray, space: int = SPACE, chars: int = 0) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The n-gram numbers (of the given ones), labels and folds of a bounded sample, brought to the driver."""
    return _gathered(_numbered(rows, classes, features, space, chars).toArrow().to_batches(), classes)


@dataclass
class LinearModel:
    """Scores texts by weights of n-grams and of further numbers, turned into probabilities by a fitted sigmoid."""

    weights: np.ndarray
    extra: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, limits: np.ndarray, held: np.ndarray, extra: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(held) + 1)
        np.cumsum(self.weights[held], out=sums[1:])
        return sums[limits[1:]] - sums[limits[:-1]] + extra @ self.extra + self.bias

    def probabilities(self, limits: np.ndarray, held: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(limits, held, extra) + self.shift, -35, 35)))


def descend(texts: list[np.ndarray], extra: np.ndarray, y: np.ndarray, ratios: np.ndarray, cost: float = 0.02, passes: int = 12, blend: float = 0.7, seed: int = 3) -> LinearModel:
    """Fit the hinge loss by dual coordinate descent: each text's multiplier is set to its best value in turn.

    Features are n-gram indicators times their log-count ratios, the further numbers, and
    a constant.  Both classes weigh the same in total.  Weights are blended with the mean
    weight (the naive Bayes direction), as suits texts of few words.  The weights are held
    times their ratios, so that a text's margin is a sum over its n-grams and no values are kept beside them.
    """
    n = len(texts)
    u, e, b = np.zeros(len(ratios)), np.zeros(extra.shape[1]), 0.0
    sign, squares = np.where(y == 1, 1.0, -1.0), ratios**2
    top = cost * np.where(y == 1, n / max(1, 2 * (y == 1).sum()), n / max(1, 2 * (y == 0).sum()))
    square = np.array([squares[t].sum() for t in texts]) + (extra**2).sum(1) + 1
    alpha, rng = np.zeros(n), np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(n).tolist():
            t, s = texts[i], sign[i]
            gap = s * (u[t].sum() + extra[i] @ e + b) - 1
            new = min(max(alpha[i] - gap / square[i], 0.0), top[i])
            step = (new - alpha[i]) * s
            if step:
                alpha[i] = new
                u[t] += step * squares[t]
                e += step * extra[i]
                b += step
    used = ratios != 0
    mean = np.abs(u[used] / ratios[used]).mean() if used.any() else 0.0
    return LinearModel(blend * u + (1 - blend) * mean * ratios, e, b)


def calibrate(model: LinearModel, margins: np.ndarray, y: np.ndarray) -> LinearModel:
    """Fit the sigmoid's slope and shift to margins of texts that the margins' model has not seen (Newton steps, shrunk targets)."""
    one, zero = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (one + 1) / (one + 2), 1 / (zero + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + c, -35, 35)))
        d, q = target - p, p * (1 - p) + 1e-9
        h = np.array([[(q * margins**2).sum() + 1e-6, (q * margins).sum()], [(q * margins).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, [(d * margins).sum(), d.sum()])
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, c = max(1e-3, a + step[0]), c + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return LinearModel(model.weights, model.extra, model.bias, a, c)


def fit_folds(texts: list[np.ndarray], extra: np.ndarray, y: np.ndarray, fold: np.ndarray, counts: Counts) -> tuple[LinearModel, np.ndarray]:
    """A calibrated model of all rows, and each row's probability by a model that has not seen it, in its ratios neither."""
    if len(set(y.tolist())) < 2:
        constant = LinearModel(np.zeros(counts.space), np.zeros(extra.shape[1]), 0.0, 0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
        return constant, np.full(len(y), 1 / (1 + np.exp(-constant.shift)))
    margins = np.zeros(len(texts))
    for k in range(FOLDS):
        here = np.flatnonzero(fold == k)
        rest = np.flatnonzero(fold != k)
        part = descend([texts[i] for i in rest], extra[rest], y[rest], counts.ratios(without=k))
        margins[here] = [part.weights[texts[i]].sum() + extra[i] @ part.extra + part.bias for i in here]
    model = calibrate(descend(texts, extra, y, counts.ratios()), margins, y)
    return model, 1 / (1 + np.exp(-np.clip(model.slope * margins + model.shift, -35, 35)))


def _apart(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """The batch cut, without a copy, where rows with a null k begin or end."""
    null = pc.is_null(batch.column("k")).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(null[1:] != null[:-1]) + 1).tolist(), batch.num_rows]
    return [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


#: Makes the models from a function that gives a class's counts by its place, and from what collected() gives.
Fit = Callable[[Callable[[int], Counts], list[np.ndarray], np.ndarray, np.ndarray], list[LinearModel]]


def fitted(rows: DataFrame, classes: list[str], most: int, fit: Fit, space: int = SPACE, chars: int = 0) -> list[LinearModel]:
    """The models that `fit` makes of the counts over all rows and of about `most` rows, by a hash of the doc_id.

    A single task fits, of at most `space` n-grams and about `most` texts; the driver gets the n-grams' numbers and the weights, neither counts nor texts.
    """
    table = class_counts(rows, classes, space, chars)
    n = table.agg(F.sum("texts")).first()[0] or 0
    features = table.filter("feature >= 0").select("feature").toArrow().column("feature").to_numpy()
    sample = _numbered(sampled(rows, F.col("doc_id"), most, n), classes, features, space, chars)
    rest = ", ".join(["k int", "counts binary"])
    ddl = ", ".join(["order long", "held binary", *[f"{c} int" for c in classes], rest])
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (x.split() for x in rest.split(", "))]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            feature = b.column("feature").to_numpy().tobytes()
            counts = [pack(np.concatenate([b.column(c).to_numpy() for c in _columns(k)])) for k in range(len(classes))]
            empty = [pa.nulls(len(classes), f.type) for f in arrow_schema(ddl)]
            empty[1], empty[-2:] = pa.array([feature] * len(classes), pa.binary()), [pa.array(range(len(classes)), pa.int32()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(empty, schema=arrow_schema(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = [run for b in batches for run in _apart(b)]
        texts, labels, fold = _gathered([b for b in runs if b.column("k").null_count], classes)

        def counts(k: int) -> Counts:
            mine = [(h, n) for b in runs if not b.column("k").null_count for c, h, n in zip(b.column("k").to_pylist(), b.column("held"), b.column("counts"), strict=True) if c == k]
            return _counts([(np.frombuffer(h.as_buffer(), np.int32), unpack(n.as_py()).view(np.int64).reshape(2 * FOLDS, -1)) for h, n in mine], space)

        models = fit(counts, texts, labels, fold)
        blobs = [pa.array([f(m) for m in models], pa.binary()) for f in (lambda m: m.weights.tobytes(), lambda m: m.extra.tobytes())]
        numbers = [pa.array([getattr(m, c) for m in models], pa.float64()) for c in ("bias", "slope", "shift")]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(models)), pa.int32()), *blobs, *numbers], schema=arrow_schema(model))
        # The worker goes on to other tasks: what it held for the fit goes back to the system.
        del runs, texts, counts
        pa.default_memory_pool().release_unused()

    model = "k int, weights binary, extra binary, bias double, slope double, shift double"
    cells = table.select("feature", *[c for k in range(len(classes)) for c in _columns(k)]).mapInArrow(packed, ddl)
    one = cells.unionByName(sample.select("*", *nothing)).repartition(1).mapInArrow(run, model).toArrow().sort_by("k").to_pylist()
    if not one:  # Spark runs no task over tables that it knows to be empty
        return fit(lambda k: _counts([], space), [], np.zeros((0, len(classes)), int), np.zeros(0, int))
    return [LinearModel(np.frombuffer(m["weights"]), np.frombuffer(m["extra"]), m["bias"], m["slope"], m["shift"]) for m in one]
