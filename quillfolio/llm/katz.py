"""Katz backoff language model over word pairs: counts in tables cut by hash, Good-Turing discounts, exact backoff weights."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import id_groups
from .tokens import Words, arrow_schema, byte_values, mix, pack, unpack

_U = np.uint64
#: Bytes of text for each bucket of words and pairs.
BUCKET_BYTES = 16 << 20
#: Counts up to this are discounted by Good-Turing; of each larger one LARGE is held back, so that no history is left without a rest.
LOW = 5
LARGE = 0.01
#: Numbers of what is not a word of the training texts, and of a text's beginning.
UNKNOWN, BEGIN = 0, 1
_END = _U(0x5BD1E9955BD1E995)

_MESSAGE = "bucket int, g int, pairs boolean, a binary, b binary, c binary, d binary, e binary, f binary"
_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_UNIGRAM = "bucket int, id long, hash long, n long"
_BIGRAM = "bucket int, history long, id long, n long"
_SUMS = ["tokens", "types", *[f"count_{r}" for r in range(1, LOW + 2)]]
_STATS = ", ".join(f"{c} long" for c in _SUMS)


def discounts(n: np.ndarray) -> np.ndarray:
    """Factors for counts 1 to LOW from n[r - 1], the number of types with count r (r to LOW + 1); half an occurrence is held back where they do not fit."""
    r = np.arange(1, LOW + 1, dtype=float)
    half = (r - 0.5) / r
    if n[0] <= 0 or (n[:LOW] <= 0).any():
        return half
    rest = (LOW + 1) * n[LOW] / n[0]
    if rest >= 1:
        return half
    d = ((r + 1) * n[1:] / n[:LOW] / r - rest) / (1 - rest)
    return np.where((d > 0) & (d < 1), d, half)


def held_back(d: np.ndarray, low: np.ndarray, large: np.ndarray) -> np.ndarray:
    """Occurrences held back: low[..., r - 1] types of count r, and `large` types above LOW."""
    return low @ ((1 - d) * np.arange(1, LOW + 1)) + LARGE * large


def lowered(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts after the discount."""
    counts = counts.astype(float)
    small = np.minimum(counts, LOW).astype(np.int64)
    return np.where(counts > LOW, counts - LARGE, counts * np.concatenate([[0.0], d])[small])


@dataclass
class Unigrams:
    """The words' own distribution: discounted shares, what is held back goes to the unknown word."""

    tokens: int
    types: int
    d: np.ndarray

    def __init__(self, stats: np.ndarray):
        self.tokens, self.types = int(stats[0]), int(stats[1])
        self.d = discounts(stats[2:])
        self.rest = float(held_back(self.d, stats[2 : 2 + LOW].astype(float), np.float64(self.types - stats[2 : 2 + LOW].sum()))) / self.tokens if self.tokens else 1.0

    def shares(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, lowered(self.d, counts) / max(1, self.tokens), self.rest)


def _stats(counts: np.ndarray) -> np.ndarray:
    """Tokens, types, and types of count 1 to LOW + 1."""
    return np.concatenate([[counts.sum(), (counts > 0).sum()], [(counts == r).sum() for r in range(1, LOW + 2)]]).astype(np.int64)


def _summed(parts: DataFrame, of) -> Column:
    """The sums of of(rows) (as _stats gives them) over all buckets of some messages, as one array."""
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.table([pa.array([x]) for x in of(rows).tolist()], schema=arrow_schema(_STATS))

    total = parts.groupBy("bucket").applyInArrow(run, _STATS).agg(*[F.sum(c).alias(c) for c in _SUMS])
    return total.select(F.array(*[F.coalesce(c, F.lit(0).cast("long")) for c in _SUMS])).scalar()


def _attached(rows: pa.Table, name: str) -> np.ndarray:
    """The sums that a column repeats on each row."""
    return np.array(rows.column(name)[0].as_py(), np.int64)


def _column(rows: pa.Table, name: str) -> pa.Array:
    column = rows.column(name)
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


class _Group:
    """The tokens of a group's texts: words and one end each; `word` numbers the distinct words, sorted by hash."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        self.ids, self.held = _column(rows, "doc_id"), _column(rows, "held_out").to_numpy(zero_copy_only=False).astype(bool)
        words = Words(_column(rows, "text"))
        self.docs = len(words.count)
        self.ends = words.first[1:] + np.arange(self.docs)
        h = np.empty(len(words) + self.docs, _U)
        h[np.arange(len(words)) + words.doc] = words.hashes(byte_values(lower=True))
        h[self.ends] = _END
        self.doc = np.repeat(np.arange(self.docs), words.count + 1)
        self.hashes, self.word = np.unique(h, return_inverse=True)
        self.trained = ~self.held[self.doc]
        self.counts = np.bincount(self.word[self.trained], minlength=len(self.hashes))

    def learn(self, answers: pa.Table, stats: np.ndarray, buckets: int) -> None:
        """Take in numbers and counts of the words from the buckets' answers, and the sums over all words."""
        self.number, self.known = np.zeros(len(self.hashes), np.int64), np.zeros(len(self.hashes), np.int64)
        at = (self.hashes % _U(buckets)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(buckets + 1))
        for b, ids, counts in zip(*[answers.column(c).to_pylist() for c in ("bucket", "a", "b")], strict=True):
            mine = order[cuts[b] : cuts[b + 1]]
            self.number[mine], self.known[mine] = unpack(ids).astype(np.int64), unpack(counts).astype(np.int64)
        self.stats, self.unigrams = stats, Unigrams(stats)
        begin = np.concatenate([[0], self.ends[:-1] + 1])
        history = np.empty(len(self.word), np.int64)
        history[1:] = self.number[self.word[:-1]]
        history[begin] = BEGIN
        of_history = np.empty(len(self.word), np.int64)
        of_history[1:] = self.known[self.word[:-1]]
        of_history[begin] = self.known[self.word[self.ends[0]]]  # as often as a training text ends, one begins
        self.history, self.of_history, self.token = history, of_history, self.number[self.word]
        # Distinct pairs of known words, by (history, word).
        self.open = np.flatnonzero((history != UNKNOWN) & (of_history > 0) & (self.token != UNKNOWN))
        key = (history[self.open].astype(_U) << _U(32)) | self.token[self.open].astype(_U)
        if max(history.max(initial=0), self.token.max(initial=0)) >= 2**32:
            raise OverflowError("more than 2**32 distinct words")
        self.pairs, first, self.pair = np.unique(key, return_index=True, return_inverse=True)
        self.pair_n = np.bincount(self.pair[self.trained[self.open]], minlength=len(self.pairs))
        first = self.open[first]
        self.pair_history, self.pair_of = of_history[first], self.known[self.word[first]]
        self.spread = 1 + self.pair_history * buckets // max(1, self.unigrams.tokens)
        v, w = self.pairs >> _U(32), self.pairs & _U(0xFFFFFFFF)
        self.pair_bucket = ((mix(v) % _U(buckets) + mix(w) % self.spread.astype(_U)) % _U(buckets)).astype(np.int64)
        self.pair_order = np.argsort(self.pair_bucket, kind="stable")
        self.pair_cuts = np.searchsorted(self.pair_bucket[self.pair_order], np.arange(buckets + 1))
        # Histories that may back off here: after them comes a pair not trained in this group, or an unknown word.
        backs = np.zeros(len(history), bool)
        backs[self.open] = self.pair_n[self.pair] == 0
        backs |= (history != UNKNOWN) & (of_history > 0) & (self.token == UNKNOWN)
        self.asked, one = np.unique(history[backs], return_index=True)
        self.asked_n = of_history[backs][one]

    def asks(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets over which the asked histories' pairs are dealt: bucket, index of the history."""
        many = 1 + self.asked_n * buckets // max(1, self.unigrams.tokens)
        many = np.minimum(many, buckets)
        which = np.repeat(np.arange(len(self.asked)), many)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        return ((mix(self.asked.astype(_U)) % _U(buckets)).astype(np.int64)[which] + nth) % buckets, which


def _message(**fields) -> dict:
    return {"a": None, "b": None, "c": None, "d": None, "e": None, "f": None} | fields


@dataclass(frozen=True)
class KatzModel:
    """A pair model of the rows of docs that are not held out.

    docs: doc_id, text; held_out: which rows are not learned from (null: learned from).
    Words run between blanks, A-Z lower-cased; a text is its words and one end.  The
    tables are cut into `buckets` by hash: words by word, pairs by history; a history with more than a bucket's
    share of all tokens is dealt over as many buckets as shares, by the second word.  Texts
    are dealt into groups; a group sends each distinct word or pair once, with its count, so a frequent one
    reaches its bucket once a group.  A group writes only to buckets that hold a word or pair of it, and only they
    answer it; sums over all buckets are one row, aggregated on its own.

    A null text is empty (its end is its one token), a null doc_id is kept; repeated rows
    count and score each.  Without training rows each token is unknown, with probability 1.
    """

    docs: DataFrame
    held_out: Column
    buckets: int

    @classmethod
    def of(cls, docs: DataFrame, held_out: Column, buckets: int | None = None) -> KatzModel:
        """Without a number of buckets there is one for every 16 MB of text."""
        if not buckets:
            size = docs.agg(F.sum(F.octet_length("text").cast("double"))).first()[0] or 0
            buckets = max(1, -(-int(size) // BUCKET_BYTES))
        return cls(docs, held_out, buckets)

    def _grouped(self) -> DataFrame:
        grouped, _ = id_groups(self.docs, 6 << 20, 4000)
        return grouped.select("g", "doc_id", "text", F.coalesce(self.held_out, F.lit(False)).alias("held_out")).repartition("g")

    def _words(self, grouped: DataFrame) -> DataFrame:
        """Each group's distinct words with their training counts, by bucket."""
        buckets = self.buckets

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            group = _Group(rows)
            at = (group.hashes % _U(buckets)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[order], np.arange(buckets + 1))
            out = []
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                mine = order[cuts[b] : cuts[b + 1]]
                out.append(_message(bucket=b, g=key[0].as_py(), pairs=False, a=group.hashes[mine].tobytes(), b=pack(group.counts[mine])))
            return pa.Table.from_pylist(out, arrow_schema(_MESSAGE))

        return grouped.groupBy("g").applyInArrow(run, _MESSAGE)

    @staticmethod
    def _counted(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        sent = [np.frombuffer(x, _U) for x in rows.column("a").to_pylist()]
        words, at = np.unique(np.concatenate(sent), return_inverse=True)
        counts = np.zeros(len(words), np.int64)
        np.add.at(counts, at, np.concatenate([unpack(x) for x in rows.column("b").to_pylist()]).astype(np.int64))
        return np.split(at, np.cumsum([len(x) for x in sent])[:-1]), words, counts

    @staticmethod
    def _with_word_sums(grouped: DataFrame, words: DataFrame) -> DataFrame:
        return grouped.withColumn("of_words", _summed(words, lambda rows: _stats(KatzModel._counted(rows)[2])))

    def _word_answers(self, words: DataFrame) -> DataFrame:
        """To each group: the numbers and total counts of the words it sent (0 for untrained ones)."""
        buckets = self.buckets

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            at, _, counts = KatzModel._counted(rows)
            numbers = np.where(counts > 0, (np.cumsum(counts > 0) - 1) * buckets + key[0].as_py() + BEGIN + 1, UNKNOWN)
            out = [_message(bucket=key[0].as_py(), g=g, pairs=False, a=pack(numbers[x]), b=pack(counts[x])) for g, x in zip(rows.column("g").to_pylist(), at, strict=True)]
            return pa.Table.from_pylist(out, arrow_schema(_MESSAGE))

        return words.groupBy("bucket").applyInArrow(run, _MESSAGE)

    def _pairs(self, grouped: DataFrame, answers: DataFrame) -> DataFrame:
        """Each group's distinct pairs with their training counts, by bucket, and the histories whose rest it needs."""
        buckets = self.buckets

        def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return pa.Table.from_pylist([], arrow_schema(_MESSAGE))
            group = _Group(rows)
            group.learn(answers, _attached(rows, "of_words"), buckets)
            to, which = group.asks(buckets)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            out = []
            for b in np.flatnonzero(np.diff(group.pair_cuts) + np.diff(cuts)).tolist():
                mine = group.pair_order[group.pair_cuts[b] : group.pair_cuts[b + 1]]
                v, n = np.unique((group.pairs[mine] >> _U(32)).astype(np.int64), return_counts=True)
                out.append(_message(
                    bucket=b, g=key[0].as_py(), pairs=True, a=pack(np.diff(v, prepend=0)) + pack(n), b=pack(group.pairs[mine] & _U(0xFFFFFFFF)), c=pack(group.pair_of[mine]),
                    d=pack(group.pair_n[mine]), e=pack(np.diff(group.asked[which[order[cuts[b] : cuts[b + 1]]]], prepend=0)), f=len(v).to_bytes(8, "little") + group.stats.tobytes(),
                ))
            return pa.Table.from_pylist(out, arrow_schema(_MESSAGE))

        return grouped.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(run, _MESSAGE)

    @staticmethod
    def _pair_counts(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys as sent, distinct keys, where each sent key is among them, and total counts."""
        keys = []
        for a, w, f in zip(*[rows.column(c).to_pylist() for c in ("a", "b", "f")], strict=True):
            n = int.from_bytes(f[:8], "little")
            cut = 1 + n * a[0] if n else 1
            v = np.cumsum(unpack(a[:cut]))
            keys.append((np.repeat(v, unpack(a[cut:]).astype(np.int64)) << _U(32)) | unpack(w))
        sent = np.concatenate(keys)
        pairs, first, at = np.unique(sent, return_index=True, return_inverse=True)
        totals = np.bincount(at, weights=np.concatenate([unpack(x) for x in rows.column("d").to_pylist()]).astype(float), minlength=len(pairs)).astype(np.int64)
        return pairs, first, np.split(at, np.cumsum([len(k) for k in keys])[:-1]), totals

    def _pair_answers(self, pairs: DataFrame) -> DataFrame:
        """To each group: total counts of its pairs; for asked histories how many of the words after them have each low count, and the words' own shares summed."""

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            pairs, first, at, totals = KatzModel._pair_counts(rows)
            unigrams = Unigrams(np.frombuffer(rows.column("f")[0].as_py(), np.int64, offset=8))
            own = unigrams.shares(np.concatenate([unpack(x) for x in rows.column("c").to_pylist()]).astype(np.int64)[first])
            seen = totals > 0
            v, nth = np.unique((pairs[seen] >> _U(32)).astype(np.int64), return_inverse=True)
            kind = np.minimum(totals[seen], LOW + 1)
            types = [np.append(np.bincount(nth[kind == r], minlength=len(v)), 0) for r in range(1, LOW + 2)]
            shares = np.append(np.bincount(nth, weights=own[seen], minlength=len(v)), 0.0)
            out = []
            for g, x, e in zip(rows.column("g").to_pylist(), at, rows.column("e").to_pylist(), strict=True):
                asked = np.cumsum(unpack(e).astype(np.int64))
                place = np.searchsorted(v, asked)
                place = np.where(np.append(v, -1)[place] == asked, place, len(v))
                out.append(_message(bucket=key[0].as_py(), g=g, pairs=True, a=pack(totals[x]), b=pack(np.concatenate([t[place] for t in types])), d=shares[place].tobytes()))
            return pa.Table.from_pylist(out, arrow_schema(_MESSAGE))

        return pairs.groupBy("bucket").applyInArrow(run, _MESSAGE)

    def scores(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability) of every row.

        A word w after a known history v: its discounted count after v over v's count if the pair was
        trained; else v's backoff weight times w's own share, where the weight is what v's discounts
        hold back over the own shares of all words not trained after v.  After an unknown
        history: w's own share.  An untrained word's own share is what the words' discounts hold back.
        So the probabilities of all words, the end and the unknown word after any history sum to 1.
        """
        buckets = self.buckets
        grouped = self._grouped()
        words = self._words(grouped)
        answers = self._word_answers(words)
        summed = self._with_word_sums(grouped, words)
        pairs = self._pairs(summed, answers)
        both = answers.unionByName(self._pair_answers(pairs))
        summed = summed.withColumn("of_pairs", _summed(pairs, lambda rows: _stats(KatzModel._pair_counts(rows)[3])))

        def run(key: tuple, rows: pa.Table, sent: pa.Table) -> pa.Table:
            group = _Group(rows)
            of_pairs = sent.column("pairs").to_numpy(zero_copy_only=False).astype(bool)
            group.learn(sent.filter(pa.array(~of_pairs)), _attached(rows, "of_words"), buckets)
            uni = group.unigrams
            own = uni.shares(group.known)
            totals = np.zeros(len(group.pairs), np.int64)
            to, which = group.asks(buckets)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            types, shares = np.zeros((len(group.asked), LOW + 1)), np.zeros(len(group.asked))
            back = sent.filter(pa.array(of_pairs))
            for b, a, t, x in zip(*[back.column(c).to_pylist() for c in ("bucket", "a", "b", "d")], strict=True):
                totals[group.pair_order[group.pair_cuts[b] : group.pair_cuts[b + 1]]] = unpack(a).astype(np.int64)
                mine = which[order[cuts[b] : cuts[b + 1]]]
                np.add.at(types, mine, unpack(t).astype(float).reshape(LOW + 1, -1).T)
                np.add.at(shares, mine, np.frombuffer(x))
            d = discounts(_attached(rows, "of_pairs")[2:])
            word = own[group.word]
            p = np.log10(word)  # after an unknown history
            known = (group.history != UNKNOWN) & (group.of_history > 0)
            n = np.zeros(len(word), np.int64)
            n[group.open] = totals[group.pair]
            seen = n > 0
            p[seen] = np.log10(lowered(d, n[seen]) / group.of_history[seen])
            off = np.flatnonzero(known & ~seen)
            if len(off):
                weight = held_back(d, types[:, :LOW], types[:, LOW]) / np.maximum(1, group.asked_n) / np.maximum(1 - shares, 1e-300)
                p[off] += np.log10(weight[np.searchsorted(group.asked, group.history[off])])
            base = np.log10((group.known + 0.5) / (uni.tokens + 0.5 * (uni.types + 1)))[group.word]
            of = lambda x: np.bincount(group.doc, weights=x, minlength=group.docs)
            return pa.table(
                [group.ids, pa.array(group.held), pa.array(np.bincount(group.doc, minlength=group.docs)), pa.array(of(group.known[group.word] > 0).astype(np.int64)),
                 pa.array(np.full(group.docs, uni.tokens)), pa.array(of(base)), pa.array(of(p))], schema=arrow_schema(_SCORE),
            )

        return summed.groupBy("g").cogroup(both.groupBy("g")).applyInArrow(run, _SCORE)

    def tables(self) -> tuple[DataFrame, DataFrame]:
        """The model's tables: words (bucket, id, hash, n) and pairs (bucket, history, id, n); history 1 is a text's beginning."""
        buckets = self.buckets
        grouped = self._grouped()
        words = self._words(grouped)

        def unigrams(key: tuple, rows: pa.Table) -> pa.Table:
            _, hashes, counts = KatzModel._counted(rows)
            on, b = counts > 0, key[0].as_py()
            ids = (np.cumsum(on) - 1) * buckets + b + BEGIN + 1
            return pa.table([pa.array(np.full(on.sum(), b, np.int32)), pa.array(ids[on]), pa.array(hashes[on].view(np.int64)), pa.array(counts[on])], schema=arrow_schema(_UNIGRAM))

        def bigrams(key: tuple, rows: pa.Table) -> pa.Table:
            pairs, _, _, totals = KatzModel._pair_counts(rows)
            pairs, n, b = pairs[totals > 0], totals[totals > 0], key[0].as_py()
            return pa.table(
                [pa.array(np.full(len(n), b, np.int32)), pa.array((pairs >> _U(32)).astype(np.int64)), pa.array((pairs & _U(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], schema=arrow_schema(_BIGRAM)
            )

        return words.groupBy("bucket").applyInArrow(unigrams, _UNIGRAM), self._pairs(self._with_word_sums(grouped, words), self._word_answers(words)).groupBy("bucket").applyInArrow(bigrams, _BIGRAM)

    def store(self, path: str) -> None:
        """Write the model's tables to path/unigrams and path/bigrams, partitioned by bucket."""
        for name, rows in zip(("unigrams", "bigrams"), self.tables(), strict=True):
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
