"""Term scan, grid codes and ball trees against plain loops, through operators and registered queries, and on odd rows."""
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfolio.llm import balltree, gridcodes, termscan
from quillfolio.llm.registry import QUERIES

DOCS = "doc_id long, text string, score long, item_id long, term string, row long, rank int"
VECTORS = "vec_id long, embedding array<float>, label int, x array<long>, shard int, codes int, error string, row long, score long"


# -- term scan ----------------------------------------------------------------------


def terms(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranked(docs, items, k=20):
    """Rows as the contract has them; docs and items are lists of (id, text)."""
    held = [(i, Counter(t), len(t)) for i, t in ((i, terms(x)) for i, x in docs)]
    n, total = sum(c > 0 for _, _, c in held), sum(c for _, _, c in held)
    df = Counter(w for _, t, _ in held for w in t)
    out = []
    for item, text in items:
        scored = []
        for i, tf, size in held:
            m = 75 + (25 * size * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 12 * m)) for w in terms(text) if tf[w])
            scored += [(-s, i is None, i, s)] if s > 0 else []
        out += [(item, r + 1, i, s) for r, (_, _, i, s) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["The", "ÉTÉ", "été", "of,", "x-y", "a_b", "日本", "I\u0085J", "tail."]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(80)]
    docs += [(80, docs[5][1]), (81, docs[5][1]), (82, ""), (83, None), (84, " \n--"), (85, "w1"), (86, "w1w2 w1"), (87, "The THE the"), (88, " ".join(rng.choice(words) for _ in range(30000)))]
    docs += [docs[3], docs[3], (None, docs[7][1]), (None, None)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "nowhere"), (23, "the the THE w1"), (items[4][0], items[4][1]), (None, "w2 w3")]
    return docs, items


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark, corpus):
    docs, items = corpus
    return spark.createDataFrame([(i, t, 1, 2, "t", 3, 4) for i, t in docs], DOCS).repartition(5), spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id long").repartition(2)


def test_term_scan_equals_a_plain_ranking(corpus, tables):
    want = ranked(*corpus)
    assert rows_of(termscan.search(*tables)) == want and len(want) > 100
    # Many blocks, and lists that are cut short.
    assert rows_of(termscan.search(*tables, block_items=7)) == want
    assert rows_of(termscan.search(*tables, k=3, block_bytes=200)) == ranked(*corpus, 3)


def test_term_scan_of_nothing(spark, tables):
    docs, items = tables
    assert termscan.search(docs.limit(0), items).count() == 0 and termscan.search(docs, items.limit(0)).count() == 0
    assert termscan.search(docs.filter("text is null"), items).count() == 0 and termscan.search(docs, items.filter("item_id = 22")).count() == 0


def test_sums_beyond_doubles_stay_whole():
    cell, value = np.array([0, 0, 1]), np.array([2**60 + 1, 2**60 + 3, 5])
    assert termscan._whole_sums(cell, value, 3).tolist() == [2**61 + 4, 5, 0]


# -- vectors ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors():
    """Clustered vectors with copies, ties, odd rows and rows that repeat an id."""
    rng = np.random.default_rng(9)
    heads = rng.normal(size=(6, 16))
    rows = [(int(i), (heads[i % 6] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist(), int(i % 5)) for i in rng.permutation(700)]
    rows += [(1000 + i, rows[9][1], None) for i in range(60)]
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None, 1), (2100, [nan] * 16, 1), (2200, [inf] + [0.0] * 15, 1), (2300, [None] + [0.0] * 15, 2), (2400, [], 3), (2500, [0.5] * 8, 1), (2600, [0.25] * 7, 1), (2700, [-1.0] * 8, 1)]
    rows += [rows[0], (100, rows[1][1], None), (None, rows[2][1], None), (-100, rows[3][1], 4)]
    return rows


@pytest.fixture(scope="module")
def table(spark, vectors):
    return spark.createDataFrame([(i, v, n, [1], 2, 3, "e", 4, 5) for i, v, n in vectors], VECTORS).repartition(4)


def kept(vectors, scale, length=None):
    out = []
    for i, v, n in vectors:
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and (length is None or len(v) == length):
            out.append((i, [math.floor(scale * float(x)) for x in v], n))
    return out


def coded(rows, parts=8, entries=16, rounds=6):
    """Codebooks, and code, distance by row, with Python's integers."""
    first = {}
    for i, v, _ in rows:
        first[i] = min(first.get(i, v), v)
    ids = sorted(first, key=lambda i: (i is None, i or 0))[:entries]
    w = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(first[i], p) for i in ids] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in rows:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else e for j, e in enumerate(books[p])]
    return books, [[near(cut(v, p), books[p]) for p in range(parts)] for _, v, _ in rows]


def test_grid_codes_equal_a_plain_quantizer(table, vectors):
    rows = kept(vectors, 4096, 16)
    books, found = coded(rows, rounds=2)
    got = gridcodes.fit(table, rounds=2)
    assert got.tolist() == books
    want = sorted((str(i), [j for _, j in f], sum(d for d, _ in f)) for (i, _, _), f in zip(rows, found))
    out = gridcodes.encode(table, got, ("label",))
    assert sorted((str(r.vec_id), list(r.codes), r.error) for r in out.collect()) == want
    back = gridcodes.decode(out.filter("vec_id = 7"), got).first()
    assert back.embedding == [x / 4096 for p, c in enumerate(back.codes) for x in books[p][c]]


def test_grid_codes_query(spark, vectors, tmp_path):
    spark.createDataFrame([(i, v, n) for i, v, n in vectors], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = kept(vectors, 4096, 16)
    books, found = coded(rows)
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, n), e in zip(rows, errors):
        by_label[n] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    want = sorted((str(i), "".join(f"{j:02x}" for _, j in f), e, by_label[n], digest) for (i, _, n), f, e in zip(rows, found, errors))
    got = QUERIES["op12_grid_codes"](spark, str(tmp_path)).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == want


def test_grid_cells_never_lose_the_nearest_entry():
    rng = np.random.default_rng(2)
    for spread, shift in ((3, 0), (50, 0), (2000, 7)):
        book = rng.integers(-spread, spread, (16, 4)).astype(np.int64)
        book[5] = book[3]  # ties go to the smaller number
        memo, points = gridcodes.Cells(book), rng.integers(-2 * spread, 2 * spread, (3000, 4)).astype(np.int64)
        memo.shift += shift
        d = ((points[:, None] - book) ** 2).sum(2)
        for _ in range(2):  # the second time from the memo
            code, best = memo.nearest(points)
            assert (code == d.argmin(1)).all() and (best == d.min(1)).all()
        assert len(memo.memo) == len(np.unique(points >> memo.shift, axis=0))


def test_grid_codes_of_few_or_huge_vectors(spark, table):
    assert gridcodes.fit(table.limit(0)).shape == (8, 0, 0) and gridcodes.encode(table.limit(0), gridcodes.fit(table.limit(0))).count() == 0
    big = [(1, [3e30] * 8, 0), (2, [-3e30] * 8, 0), (3, [1.0] * 8, 0), (4, [2.0] * 7 + [1e12], 0)]
    rows = spark.createDataFrame(big, "vec_id long, embedding array<double>, label int")
    books = gridcodes.fit(rows, rounds=2)
    assert books.shape == (8, 4, 1) and books[0, 0, 0] == 2**62
    got = {r.vec_id: (r.codes, r.error) for r in gridcodes.encode(rows, books).collect()}
    assert len(got) == 4 and got[1][1] == 0 and got[3][0] != got[1][0]


def best_products(vectors, k=10):
    rows = kept(vectors, 1024)
    out = []
    for a, (q, x, _) in enumerate(rows):
        if q is None or q % 100:
            continue
        scored = [(-sum(s * t for s, t in zip(x, y)), i is None, i or 0, i) for b, (i, y, _) in enumerate(rows) if b != a and len(y) == len(x)]
        out += [(q, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_ball_trees_equal_a_plain_search(table, vectors):
    want = best_products(vectors)
    asked = {q for q, *_ in want}
    assert {0, 100, 600, 1000, -100, 2500, 2700} <= asked and 2000 not in asked
    key = lambda df: sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()), key=str)
    assert key(balltree.top_inner_products(table)) == want
    # Many shards in waves, and groups of few queries.
    assert key(balltree.top_inner_products(table, shard_rows=150, group_rows=6)) == want
    assert balltree.top_inner_products(table.limit(0)).count() == 0 and balltree.top_inner_products(table.filter("vec_id = 100 and label is null")).count() == 0


def test_ball_tree_opens_few_leaves_and_loses_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.round(1000 * (rng.normal(size=(30, 8))[rng.integers(0, 30, 6000)] + 0.05 * rng.normal(size=(6000, 8)))).astype(np.int64)
    x[:500] = x[0]  # copies: one score, decided by the id
    ids = rng.permutation(6000).astype(np.int64)
    tree, q = balltree.Tree.of(x, ids, ids), x[::97]
    scored, real = [], balltree._scores
    monkeypatch.setattr(balltree, "_scores", lambda a, b: scored.append(b.shape[0] * b.shape[1]) or real(a, b))
    best = balltree.Best(np.full((len(q), 10), balltree._NONE), np.full((len(q), 10), balltree._LONG), np.full((len(q), 10), -1))
    balltree.search(tree, q, ids[::97], best)
    for i, (v, own) in enumerate(zip(q, ids[::97])):
        order = sorted((-int(s), int(j)) for s, j in zip(x @ v, ids) if j != own)[:10]
        assert list(zip((-best.score[i]).tolist(), best.ids[i].tolist())) == order
    assert sum(scored) < 0.4 * len(q) * len(x)
    # A kth score that other shards have already reached closes what can't beat it.
    before, scored[:] = sum(scored), []
    top = balltree.Best(np.repeat(best.score[:, -1:], 10, 1), np.repeat(best.ids[:, -1:], 10, 1), np.full((len(q), 10), -1))
    balltree.search(tree, q, ids[::97], top)
    assert sum(scored) <= before and ((top.rows >= 0).sum(1) <= 10).all() and (top.score[:, 0] == best.score[:, 0]).all()


def test_huge_components_do_not_overflow(spark):
    rows = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0]), (3, [1e9, 5.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = {r["rank"]: (r.vec_id, r.score) for r in balltree.top_inner_products(rows).collect()}
    assert got[1] == (1, 2**63 - 1) and got[2] == (3, 2**63 - 1) and got[3] == (4, 2**20) and got[4][0] == 2 and got[4][1] < -(2**62)


def test_waves_grow():
    assert balltree.waves(1) == [(0, 1)] and balltree.waves(30) == [(0, 1), (1, 4), (4, 16), (16, 30)]


def test_whole_embeddings_table_of_the_smallest_scale(spark):
    """The registered query over the given table, against numpy."""
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    x = np.floor(1024 * np.array([r.embedding for r in rows], float)).astype(np.int64)
    got = QUERIES["op13_ball_tree"](spark, "/root/testdata/sf0.001").filter(F.col("rank") == 1).collect()
    scores = x @ x.T
    np.fill_diagonal(scores, np.iinfo(np.int64).min)
    assert len(got) == len(rows[::100]) and all(scores[r.query_id].max() == r.score and scores[r.query_id].argmax() == r.vec_id for r in got)
