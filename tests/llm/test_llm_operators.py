"""The operators of quillfolio.llm against plain loops, and on nulls, empty texts and tables, repeated rows and extra columns."""
import math
import random
import tracemalloc
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillfolio.llm import bottomk, cuckoo, fmindex, katz, linear, mixing, nearsets, personal, quality, simhash, toxicity, windows
from quillfolio.llm.registry import CATEGORIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, g int, row string, score double"
WORDS = [f"w{i}" for i in range(60)] + ["The", "of,", "ÉTÉ", "x!!"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    shared = sentence(rng, 40)
    out = {i: sentence(rng, rng.randint(1, 120)) + ("\n" + shared if i % 3 == 0 else "") + "\nA line that many hold." * (i % 2) for i in range(1, 60)}
    return out | {60: out[7], 61: "", 62: None, 63: " \n\t", 64: "one", 65: sentence(rng, 4000)}


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, 0, 1, "r", 0.5) for i, t in texts.items()]
    rows += [rows[3], rows[3], (None, texts[5], "en", "s1", 0, 1, "r", 0.5), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mix_reaches_targets(docs, empty):
    rows = mixing.mix(docs, (3.0, 1.0, 2.0)).collect()
    assert len(rows) == docs.count()
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s in size:
        assert target[s] <= 2 * size[s] + 1e-6 and abs(taken[s] - target[s]) <= max(r.size for r in rows if r.source == s) / 2 + 1
    again = mixing.mix(docs.repartition(3), (3.0, 1.0, 2.0)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(empty, (1.0,)).count() == 0


def test_katz_equals_a_plain_model_and_sums_to_one(spark, docs, empty, texts, tmp_path):
    held = F.col("doc_id") % 5 == 1
    model = katz.KatzModel.of(docs, held, buckets=3)
    rows = model.scores().collect()
    assert len(rows) == docs.count() and katz.KatzModel.of(empty, held).scores().count() == 0
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: words((t or "").translate(low)) + ["</s>"]
    every = [(r.doc_id, tokens(r.text)) for r in docs.select("doc_id", "text").collect()]
    train = [t for i, t in every if i is None or i % 5 != 1]
    uni, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["<s>", *t], t))
    n, heads = sum(uni.values()), len(train)
    stats = lambda c: np.array([sum(v == r for v in c.values()) for r in range(1, 7)])
    d1, d2 = katz.discounts(stats(uni)), katz.discounts(stats(pairs))
    cut = lambda d, c: c * d[c - 1] if c <= 5 else c - 0.01
    own = {w: cut(d1, c) / n for w, c in uni.items()}
    rest = 1 - sum(own.values())
    total = {"<s>": heads, **uni}
    after = defaultdict(list)
    for (v, w), c in pairs.items():
        after[v].append((w, c))

    def p(v, w):
        if v not in total:
            return own.get(w, rest)
        if (v, w) in pairs:
            return cut(d2, pairs[v, w]) / total[v]
        weight = (1 - sum(cut(d2, c) for _, c in after[v]) / total[v]) / (1 - sum(own[x] for x, _ in after[v]))
        return weight * own.get(w, rest)

    for v in ("<s>", "the", "w3", "never"):
        assert sum(p(v, w) for w in uni) + p(v, "unknown") == pytest.approx(1)
    want = sorted(round(sum(math.log10(p(v, w)) for v, w in zip(["<s>", *t], t)), 5) for _, t in every)
    assert sorted(round(r.score, 5) for r in rows) == pytest.approx(want, abs=1e-4)
    # More buckets than a group has words for: some get no message.
    many = katz.KatzModel.of(docs, held, buckets=400).scores().collect()
    assert sorted(round(r.score, 5) for r in many) == pytest.approx(want, abs=1e-4)
    model.store(str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/unigrams").agg(F.sum("n")).first()[0] == n
    assert spark.read.parquet(f"{tmp_path}/bigrams").count() == len(pairs)


def test_windows_equal_a_plain_walk(docs, empty, texts):
    got = {(r.doc_id, r.n_words): r for r in windows.remove_repeated_windows(docs, 8, bytes_per_group=3000).collect() if r.doc_id}
    seen = set()
    for i in sorted(texts):
        w = words(texts[i])
        gone = [False] * len(w)
        for k in range(len(w) - 7):
            if tuple(w[k : k + 8]) in seen:
                gone[k : k + 8] = [True] * 8
            seen.add(tuple(w[k : k + 8]))
        r = got[i, len(w)]
        assert r.kept == " ".join(x for x, g in zip(w, gone) if not g) and r.n_removed == sum(gone) == sum(x.end - x.start for x in r.intervals)
    rows = windows.remove_repeated_windows(docs, 8)
    assert rows.count() == docs.count() and windows.remove_repeated_windows(empty).count() == 0


def test_fm_index_finds_what_is_there(spark, docs, empty, texts):
    rng = np.random.default_rng(1)
    s = np.concatenate([rng.integers(3, 9, 500), [0], rng.integers(3, 9, 300), [1], np.full(50, 4), [2]])
    index = fmindex.FmIndex(s, 8)
    for n in (1, 2, 5):
        phrases = np.array([s[k : k + n] for k in (0, 100, 510, 820)])
        low, high = index.search(phrases, np.full(4, n))
        for p, a, b in zip(phrases, low, high):
            assert sorted(index.locate(np.arange(a, b))) == [k for k in range(len(s) - n + 1) if (s[k : k + n] == p).all()]
    t = words(texts[9])
    bench = spark.createDataFrame([(1, " ".join(t[3:30])), (2, "one"), (3, None), (4, "not there at all"), (5, "")], "item_id long, text string")
    one = fmindex.find_benchmark(docs, bench, carry=["lang"])
    rows = {r.doc_id: r for r in one.collect()}
    assert rows[9].n_hit >= 13 and "1" in rows[9]["items"] and rows[64]["items"] == ["2"] and rows[61].n_words == 0 and rows[61].n_hit == 0
    split = fmindex.find_benchmark(docs, bench, block_windows=3)
    key = lambda d: sorted(str((r.doc_id, r.n_words, r.n_hit, r["items"], r.intervals)) for r in d.collect())
    assert key(one) == key(split)
    assert fmindex.find_benchmark(empty, bench).count() == 0 and fmindex.find_benchmark(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_near_fingerprints_link_like_all_pairs(spark, docs, empty):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = list(base)
    for b in base[:3]:  # dense groups, larger than the tiles
        for _ in range(120):
            fps.append(b ^ np.uint64(1 << int(rng.integers(0, 16))) ^ np.uint64(1 << int(rng.integers(0, 16))))
    fps = np.unique(np.array(fps, np.uint64))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    parent = {int(x): int(x) for x in fps.view(np.int64)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    signed = fps.view(np.int64).tolist()
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2):
            a, b = find(signed[i]), find(signed[int(j)])
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in signed if find(x) != x}
    for tile in (16, simhash.TILE):
        got = {r.node: r.root for r in simhash.components(simhash.near_pairs(frame, 2, tile)).collect() if r.node != r.root}
        assert got == want
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert rows[60].component_id == 7 and rows[61].fp == rows[62].fp == rows[63].fp == 0 and rows[62].component_id == 61
    assert simhash.near_duplicates(docs).count() == docs.count() and simhash.near_duplicates(empty).count() == 0


def test_rounds_of_components_are_small_plans_and_end_at_stars(spark, monkeypatch):
    written, write = [], simhash.stored

    def counted(df):
        written.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return write(df)

    monkeypatch.setattr(simhash, "stored", counted)
    # Two chains, a ring, a link of a node with itself, a link twice and one turned round.
    pairs = [(i, i + 1) for i in range(20)] + [(40 - 2 * i, 38 - 2 * i) for i in range(5)] + [(50, 51), (51, 52), (52, 50), (60, 60), (70, 71), (70, 71), (71, 70)]
    links = spark.createDataFrame(pairs, "u long, v long")
    got = sorted((r.node, r.root) for r in simhash.components(links).collect())
    want = {i: 0 for i in range(1, 21)} | {i: 30 for i in range(32, 41, 2)} | {51: 50, 52: 50, 71: 70}
    assert got == sorted(want.items())
    # The driver keeps each plan and its metrics: a step reads the links three times at most.
    assert max(written) <= 3
    written.clear()
    stars = spark.createDataFrame([(0, 5), (0, 6), (7, 8), (None, 9)], "u long, v long")
    assert sorted((r.node, r.root) for r in simhash.components(stars).collect()) == [(5, 0), (6, 0), (8, 7)]
    assert len(written) == 1
    assert simhash.components(links.limit(0)).isEmpty()


def plain_lines(texts):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    held = defaultdict(list)
    for i in sorted(texts):
        for k in {key(x) for x in (texts[i] or "").split("\n")}:
            if len(k) >= 10:
                held[k].append(i)
    return {i: "\n".join(x for x in (t or "").split("\n") if key(x) not in held or held[key(x)][0] == i) for i, t in texts.items()}


def test_lines_go_and_come_back(spark, docs, empty, texts):
    some = docs.filter("doc_id is not null")
    index = cuckoo.LineIndex.new(spark, shards=4).insert(some.filter("doc_id % 2 = 0")).insert(some).insert(some)
    assert {r.doc_id: r.kept for r in index.deduplicated(some).collect()} == plain_lines(texts)
    back = index.delete(some.filter("doc_id < 20"))
    left = some.filter("doc_id >= 20")
    assert {r.doc_id: r.kept for r in back.deduplicated(left).collect()} == plain_lines({i: t for i, t in texts.items() if i >= 20})
    probed = back.probe(back.keys(left).select("shard", "hi", "lo").distinct())
    assert probed.filter("not maybe").count() == 0 and back.probe(back.keys(spark.createDataFrame([(1, "a line of its own kind")], "doc_id long, text string")).select("shard", "hi", "lo")).filter("maybe").count() == 0
    assert cuckoo.LineIndex.new(spark).insert(empty).deduplicated(docs).count() == docs.count()


def test_lines_of_rare_and_frequent_keys_meet(spark, docs, texts, monkeypatch):
    some, plain = docs.filter("doc_id is not null"), plain_lines(texts)
    for most in (4, 20):  # some keys, or few, count as frequent
        monkeypatch.setattr(cuckoo, "_HOT", most)
        assert {r.doc_id: r.kept for r in cuckoo.LineIndex.new(spark).insert(some).deduplicated(some).collect()} == plain


def test_cuckoo_filter_has_no_false_negatives():
    rng = np.random.default_rng(2)
    hi, lo = rng.integers(-(2**63), 2**63, (2, 20_000))
    f = cuckoo.CuckooFilter()
    for a in range(0, 20_000, 5000):
        f.add(hi[a : a + 5000], lo[a : a + 5000])
        f = cuckoo.CuckooFilter.from_bytes(f.to_bytes())
        assert f.contains(hi[: a + 5000], lo[: a + 5000]).all()
    assert f.contains(lo, hi).mean() < 0.01
    f.delete(hi[:500], lo[:500])
    assert f.contains(hi[500:], lo[500:]).all() and f.contains(hi[:500], lo[:500]).mean() < 0.05


def test_personal_data_spans(spark, empty):
    text = "x a.b@c.example.com, 10.0.0.256 10.0.0.25 card 4539578763621486 or 4539578763621487 call +1 (702) 555-0742é mail me: joe at mail dot com"
    rows = spark.createDataFrame([(1, text), (1, text), (2, None), (None, "é +49 30 1234567"), (3, "a" * 3000 + "@" + "9" * 3000)], "doc_id long, text string")
    got = personal.find(rows).collect()
    assert len(got) == 5 and personal.find(empty).count() == 0
    mine = next(r for r in got if r.doc_id == 1)
    base = [(text[s.start : s.end], personal.KINDS[s.kind]) for s in mine.spans if s.base]
    assert base == [("a.b@c.example.com", "email"), ("10.0.0.25", "ip"), ("4539578763621486", "card"), ("+1 (702) 555-0742", "phone")]
    assert [(s.start, s.end) for r in got if r.doc_id is None for s in r.spans] == [(2, 16)]


def test_reliabilities_follow_the_better_labelers():
    votes = [dict(kind=0, size=1, form=f, check=c, gazetteer=c, context=0, edges=1, n=50 if f == 1 else 20) for f, c in ((1, 1), (0, 1), (0, -1))]
    truth = personal.reliabilities(votes)
    assert truth[0] > 0.9 and truth[2] < 0.1


def test_classifiers_on_planted_words(spark, docs, empty):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        bad, junk = i % 4 == 0, i % 3 == 0
        t = sentence(rng, 30) + (" moron scum" if bad else "") + (" %%% ###" * 5 if junk else "")
        rows.append((i, t, 0 if junk else 1, int(bad)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    labels = frame.select("doc_id", "quality", "toxic").unionByName(spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    model = quality.fit(quality.training_rows(frame, labels))
    right = [(r.score >= 0.5) == (r.quality == 1) for r in quality.score(frame, model).join(frame, "doc_id").filter(quality.held_out()).collect()]
    assert np.mean(right) > 0.95 and quality.score(docs, model).count() == docs.count()
    assert quality.judged(frame, model).columns == [*frame.columns, "score"]
    names = list(CATEGORIES)
    models = toxicity.fit(quality.labelled(frame, labels, CATEGORIES), names)
    assert [len(m.extra) for m in models] == [0, 1, 2]
    got = toxicity.score(frame, models, names).join(frame, "doc_id").collect()
    assert np.mean([(r.p_abusive >= 0.5) == (r.toxic == 1) for r in got]) > 0.95
    flat = quality.fit(quality.training_rows(empty, labels))
    assert quality.score(docs, flat).agg(F.min("score") == F.max("score")).first()[0]
    assert linear.indicators(pa.array(["", "a a"]))[0].tolist()[1] == 0


def test_indicators_are_sorted_not_hashed(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(rng.randrange(200))) for _ in range(30)] + ["", None, "one"]
    apart = [linear.indicators(pa.array([t], pa.string()), 1 << 12, 4)[1].tolist() for t in texts]
    assert all(a == sorted(set(a)) for a in apart) and apart[-3] == apart[-2] == []

    def hashed(*_, **__):
        raise AssertionError("np.unique hashes whole numbers: several times the CPU seconds of a sort")

    monkeypatch.setattr(np, "unique", hashed)
    limits, held = linear.indicators(pa.array(texts, pa.string()), 1 << 12, 4)
    assert [held[a:b].tolist() for a, b in zip(limits[:-1], limits[1:], strict=True)] == apart


def test_sketches_estimate_and_merge(docs, empty, texts):
    k = 64
    rows = bottomk.edited_sketches(docs, k, rows_per_group=7).collect()
    assert len(rows) == docs.count() and bottomk.edited_sketches(empty).count() == 0
    ids = sorted(texts)
    for r in rows:
        if r.doc_id in (8, 20, 61, 62, 64) and r.n_chars == len(texts[r.doc_id] or ""):
            t, nxt = texts[r.doc_id] or "", texts[ids[ids.index(r.doc_id) + 1]] or ""
            h = len(t) // 2
            assert r.edited == t[: len(t) - h] + nxt[:h]
    same = {r.doc_id: r.sketch for r in rows}
    assert same[7] == same[60] and same[61] == []
    s = bottomk.sketches(docs, k)
    assert s.filter("doc_id = 65").select(F.col("n_shingles").between(2500, 6000)).first()[0]
    part = bottomk.part_sketches(docs.filter("source is not null"), "source", k, salts=3)
    assert part.count() == 4 and part.filter(f"size(sketch) <> {k}").count() == 0


def test_pipeline_runs_on_odd_rows(spark, docs, tmp_path, texts):
    d = str(tmp_path)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 50)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words(texts[9])[3:30]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, d)
    kept = {r.doc_id for r in rows.collect()}
    assert 9 not in kept and 60 not in kept and 8 in kept


def test_near_sets_equal_all_pairs(spark, texts):
    rng = random.Random(8)
    planted = dict(texts)
    for k in range(6):  # copies of copies, and texts that share half
        base = [f"n{k}x{i}" for i in range(200)]
        for j in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = f"e{rng.random()}"
            planted[1000 + 100 * k + j] = " ".join(copy)
            planted[2000 + 100 * k + j] = " ".join(base[:100] + [f"o{k}x{j}x{i}" for i in range(100)])
    planted |= {3000: "a b c", 3001: "A  b\nc", 3002: "a b", 3003: " ".join(f"q{i}" for i in range(9)), 3004: " ".join(f"q{i}" for i in range(8))}

    def shingles(t):
        w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    ids, sets = list(planted), [shingles(t) for t in planted.values()]
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    want = defaultdict(set)
    for i, x in enumerate(ids):
        want[find(i)].add(x)
    assert max(map(len, want.values())) > 10
    frame = spark.createDataFrame(list(planted.items()), "row long, text string").repartition(5)
    for tile in (700, nearsets.TILE):
        got = defaultdict(set)
        for r in nearsets.near_sets(frame, tile=tile).collect():
            got[r.near].add(r.row)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert nearsets.near_sets(frame.limit(0)).count() == 0


def test_near_sets_tasks_hold_little_beside_their_batch():
    rng = np.random.default_rng(4)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 400))) for _ in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["row", "text"])
    limits, h = nearsets.shingle_sets(pa.array([" ".join(texts[:600]), "", *texts[:3]]), 5)
    kernels = {
        "firsts": lambda: sum(r.num_rows for r in nearsets._first_shingles(5, 0.8, np.zeros(nearsets._SLOTS, np.uint8))(iter([batch]))),
        "marks": lambda: sum(r.num_rows for r in nearsets._marks(5)(iter([batch]))),
        "signatures of a long text": lambda: len(nearsets._signatures(limits, h)),
    }
    for name, kernel in kernels.items():
        tracemalloc.start()
        assert kernel() > 0
        peak = tracemalloc.get_traced_memory()[1] >> 20
        tracemalloc.stop()
        assert peak < 20, (name, peak)
    # Bits are counted in blocks that cut texts: as over the whole set.
    for k, x in enumerate((h, nearsets.mix(h ^ np.uint64(0x9E3779B97F4A7C15)))):
        for d, (a, b) in enumerate(zip(limits[:-1], limits[1:], strict=True)):
            ones = np.unpackbits(x[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=int)
            assert nearsets._signatures(limits, h)[d, k] == np.packbits(2 * ones > b - a, bitorder="little").view(np.uint64)[0]


def test_pipeline_drops_edited_copies(spark, tmp_path):
    rng = random.Random(9)
    text = [f"v{rng.randrange(5000)}" for _ in range(300)]
    edited = lambda places: " ".join(f"new{i}" if i in places else w for i, w in enumerate(text))
    rows = [(1, edited(())), (2, edited((20, 150, 280))), (3, edited((5, 99, 250))), (4, edited(range(0, 300, 10))), (5, " ".join(text[:150]) + " " + " ".join(f"z{i}" for i in range(150)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_near(spark, docs, str(tmp_path)).collect()) == [1, 4, 5]


def test_pipeline_links_fingerprints_and_shingle_sets(spark, tmp_path):
    refrain, tail = ["round", "and", "about"], [[f"{x}{i}" for i in range(30)] for x in "pqrs"]
    text = lambda times, k: " ".join(refrain * times + tail[k])
    # A long refrain makes equal fingerprints of texts that share few shingles; a short one leaves the set of shingles, not the fingerprint.
    rows = [(2, text(200, 0)), (None, text(200, 1)), (4, text(3, 1)), (5, text(3, 2)), (6, text(200, 2)), (7, text(0, 3))]
    prints = {t: simhash.fingerprint(t) for _, t in rows}
    assert prints[rows[0][1]] == prints[rows[1][1]] == prints[rows[4][1]] and (prints[rows[1][1]] ^ prints[rows[2][1]]).bit_count() > 2
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_near(spark, docs.repartition(3), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == [2, 7]


def test_quality_stage_takes_documents_with_a_score(spark, docs, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(i, 1, 0) for i in range(1, 50)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, d)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == docs.count()


def test_held_out_labels_leave_a_fold_alone(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"r{rng.randrange(300)}" for _ in range(12)), int(rng.random() < 0.4)) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    mine = F.pmod(F.xxhash64("doc_id", "text"), F.lit(linear.FOLDS)) == 0

    def order(frame):
        counts = linear.counts_of(linear.class_counts(frame, ["label"]))
        texts, y, fold = linear.collected(frame, ["label"], counts.feature)
        _, unseen = linear.fit_folds(texts, np.zeros((len(texts), 0)), y[:, 0], fold, counts)
        assert (fold == 0).sum() > 20
        return np.argsort(unseen[fold == 0]).tolist()

    assert order(frame) == order(frame.withColumn("label", F.when(mine, 1 - F.col("label")).otherwise(F.col("label"))))


def test_driver_gets_weights_alone_of_a_fit(spark, monkeypatch):
    rows = [(i, f"{'good fine' if i % 3 else 'junk spam'} text {i % 7} of {i % 11}", int(i % 3 > 0), int(i % 5 == 0)) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int, other int").repartition(3)

    def on_driver(classes, fit, **features):
        space = features.get("space", linear.SPACE)
        table = linear.class_counts(frame, classes, **features)
        some = linear.collected(frame, classes, linear.counts_of(table, 0, space).feature, **features)
        return fit(lambda k: linear.counts_of(table, k, space), *some)

    here = on_driver(["label"], quality._fit), on_driver(["label", "other"], toxicity._fit, **toxicity._FEATURES)
    brought, kind = [], type(frame)
    whole = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda self: brought.extend(self.columns) or whole(self))
    there = [quality.fit(frame)], toxicity.fit(frame, ["label", "other"])
    assert set(brought) == {"feature", "k", "weights", "extra", "bias", "slope", "shift"}
    for a, b in zip([*here[0], *here[1]], [*there[0], *there[1]], strict=True):
        assert np.array_equal(a.weights, b.weights) and np.array_equal(a.extra, b.extra) and (a.bias, a.slope, a.shift) == (b.bias, b.slope, b.shift)
    assert quality.fit(frame.limit(0)).shift == 0
