"""Registered queries on small tables of odd rows, against brute force by the rules that they promise."""
import hashlib
import random
import re
import shutil

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quillfolio.llm import cuckoo, quality, toxicity
from quillfolio.llm.common import id_groups
from quillfolio.llm.registry import CATEGORIES, QUERIES

LOW = {c: c + 32 for c in range(65, 91)}
BLANK = r"[^\x20\x09-\x0D]+"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(300)] + ["The", "ÉTÉ", "of,", "x-y"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randint(14, 30))) for i in range(6)] + [(10, "just three words"), (11, None), (12, " .. "), (13, "w1 w2")]
    texts = {i: say(rng.randint(1, 110)) for i in range(40)}
    texts[5] = texts[4]
    texts[6] = texts[4] + " more"
    texts[7] = say(200) + " " + items[0][1]  # a passage of 14 words or more in a long text
    texts[8] = items[1][1].upper() + " " + say(5)
    texts[9] = "so Just, three-WORDS here " + items[2][1][4:]
    texts[10] = say(4000) + " " + items[3][1] + " " + say(4000)
    texts |= {50: None, 51: "", 52: " \n\t", 53: "one", 54: "日本 語 text", 55: "a b"}
    texts[60] = "mail Ann.Lee@mail.example.org, or +44 (20) 7946 0958; card 4111 1111 1111 1111 or 4111111111111112 at 10.0.0.255 and 10.0.0.256, x@y"
    texts[61] = "call +1-202-555-0143, +12 34, 1.2.3.4.5, a_b%c@d-e.f.g, 4012-8888-8888-1881 5500000000000004."
    rows = [(i, t, "en", "s", 0, 9, "q", 0.5) for i, t in texts.items()]
    folder = str(tmp_path_factory.mktemp("world"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int, g string, score double")
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, items


def test_benchmark_windows(spark, world):
    folder, texts, items = world
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[s : s + 13]), set()).add(str(i))
    want = set()
    for i, t in texts.items():
        w, hit, found = words(t), set(), set()
        for window, names in windows.items():
            for s in range(len(w) - len(window) + 1):
                if tuple(w[s : s + len(window)]) == window:
                    hit |= set(range(s, s + len(window)))
                    found |= names
        want.add((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    got = QUERIES["op4_benchmark_windows"](spark, folder).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want and len(got) == len(texts)
    assert sum(r.contaminated for r in got) >= 3 and any(r.n_hit and not r.contaminated for r in got)


def test_fingerprints_and_components(spark, world):
    folder, texts, _ = world

    def fingerprint(text):
        w = re.findall(BLANK, (text or "").translate(LOW))
        shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: fingerprint(t) for i, t in texts.items()}
    group = {i: i for i in prints}
    for _ in prints:  # the least id reaches every document of its component
        for i, a in prints.items():
            group[i] = min(group[j] for j, b in prints.items() if (a ^ b).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash_components"](spark, folder).collect()}
    assert got == {i: (f"{p:016x}", group[i]) for i, p in prints.items()}


def test_sketches_of_texts_and_edited_texts(spark, world):
    folder, texts, _ = world
    ids = sorted(texts)
    text = {i: texts[i] or "" for i in ids}

    def shingles(t):
        w = re.findall(BLANK, t.translate(LOW))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def likeness(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    got = {r.doc_id: r for r in QUERIES["op10_bottom_k"](spark, folder).collect()}
    assert sorted(got) == ids
    for i, after in zip(ids, ids[1:] + ids[:1]):
        r, t, half = got[i], text[i], len(text[i]) // 2
        edited = t[: len(t) - half] + text[after][:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(edited))
        for value, other in ((r.near_edited, edited), (r.near_next, text[after])):
            a, b = shingles(t), shingles(other)
            # The smallest 128 of at most 128 shingles are all of them.
            assert value == pytest.approx(likeness(a, b), abs=1e-9 if len(a | b) <= 128 else 0.2)
        assert r.n_shingles == len(shingles(t)) if len(shingles(t)) < 128 else r.n_shingles == pytest.approx(len(shingles(t)), rel=0.35)
    assert got[4].fingerprint == got[5].fingerprint != got[6].fingerprint


def test_base_spans_of_personal_data(spark, world):
    folder, texts, _ = world

    def luhn(d):
        return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    digits = lambda x: re.sub(r"[^0-9]", "", x)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda x: True),
        "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", lambda x: 14 <= len(digits(x)) <= 19 and luhn(digits(x))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 10 <= len(digits(x)) <= 15),
    }
    for r in QUERIES["op8_personal_data"](spark, folder).collect():
        found = {k: [m.span() for m in re.finditer(p, texts[r.doc_id] or "") if ok(m.group())] for k, (p, ok) in kinds.items()}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(found[k]) for k in kinds)
        listed = [f"{k}:{a}:{b}" for a, _, k, b in sorted((a, n, k, b) for n, k in enumerate(kinds) for a, b in found[k])]
        assert r.base_sha256 == sha(",".join(listed)) and set(listed) <= set(r.spans.split(","))  # the method may add spans, and takes none away
    assert sum(r.n_email + r.n_phone for r in QUERIES["op8_personal_data"](spark, folder).collect()) >= 4


def test_groups_follow_the_ids_and_the_bytes(spark):
    rng = random.Random(5)
    ids = rng.sample(range(10**6), 300) + [10**12 + i for i in range(100)] + [-(10**15), 2**62]
    rows = [(i, "x" * rng.choice([1, 10, 10, 400])) for i in ids] + [(None, f"n{i}" * 50) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grouped, size = id_groups(docs, 600, 1000)
    assert size == sum(len(t) for _, t in rows)
    got = grouped.collect()
    assert len(got) == len(rows)
    with_id = sorted((r.doc_id, r.g) for r in got if r.doc_id is not None)
    assert [g for _, g in with_id] == sorted(g for _, g in with_id)  # the order of the ids
    assert min(r.g for r in got if r.doc_id is None) > with_id[-1][1]
    # One byte a group: as many groups as the ids allow, in a plan of the same size.
    fine, _ = id_groups(docs, 1, 1000)
    plan = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString())
    assert fine.select("g").distinct().count() > 300 and plan(fine) < 1.2 * plan(grouped)
    none, size = id_groups(docs.filter(F.lit(False)), 10, 10)
    assert none.count() == 0 and size == 0 and id_groups(docs.filter("doc_id is null"), 10, 10)[0].count() == 40


def test_line_index_is_reopened_compacted_and_taken_back(spark, tmp_path):
    rng = random.Random(31)
    lines = [f"a line of its own, number {i}" for i in range(60)] + ["short"]
    texts = {i: "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12))) for i in range(50)}
    frame = lambda ids: spark.createDataFrame([(i, texts[i]) for i in ids], "doc_id long, text string")

    def plain(ids):
        holders = {}
        for i in sorted(ids):
            for line in texts[i].split("\n"):
                if len(line) >= 10:
                    holders.setdefault(line, set()).add(i)
        return {i: "\n".join(x for x in texts[i].split("\n") if len(holders.get(x, ())) < 2 or min(holders[x]) == i) for i in ids}

    def kept(index, ids):
        return {r.doc_id: r.kept for r in index.deduplicated(frame(ids)).collect()}

    path = str(tmp_path / "index")
    index = cuckoo.LineIndex.new(spark, path, shards=3).insert(frame(range(0, 20))).insert(frame(range(15, 35)))
    again = cuckoo.LineIndex.open(spark, path)
    assert (again.version, again.shards, again.least) == (2, 3, 10) and kept(again, range(35)) == plain(range(35))
    # A batch that broke off before its filters were whole does not count.
    frame([40]).write.parquet(f"{path}/refs/v3")
    assert cuckoo.LineIndex.open(spark, path).version == 2
    shutil.rmtree(f"{path}/refs/v3")
    before = [r.n for r in again.counts().filter("n_docs > 1").orderBy("hi", "lo").selectExpr("n_docs as n").collect()]
    small = cuckoo.LineIndex.open(spark, path).compact()
    assert [p.name for p in (tmp_path / "index" / "refs").iterdir()] == ["base2"]
    assert [r.n for r in small.counts().filter("n_docs > 1").orderBy("hi", "lo").selectExpr("n_docs as n").collect()] == before
    index = cuckoo.LineIndex.open(spark, path).delete(frame(range(0, 50, 3))).insert(frame(range(30, 50)))
    left = sorted((set(range(35)) - set(range(0, 50, 3))) | set(range(30, 50)))
    assert kept(index, left) == plain(left) and cuckoo.LineIndex.open(spark, path).version == 4
    # A filter knows every key that is held, whatever came and went.
    held = index.live().select("shard", "hi", "lo").distinct()
    assert index.probe(held).filter("not maybe").count() == 0
    gone = index.delete(frame(range(50)))
    assert gone.live().count() == 0 and gone.probe(held).filter("maybe").count() == 0


def odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, near long, taken long"
    line = "A line that many documents hold, word for word"
    rows = [(i, f"{line}\nand one of its own: {i} {'y' * i}", "en", "s" if i % 3 else None, None, 0.1, 1, 2, 3) for i in range(12)]
    rows += [rows[3], (None, "no id", None, None, None, None, None, None, None), (40, None, "en", "s", 0, 0.0, 0, 0, 0), (41, "", "en", "s", 0, 0.0, 0, 0, 0), (42, "z " * 40000, "en", "t", 1, 0.0, 0, 0, 0)]
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_extra_columns_and_empty_tables(spark, tmp_path, empty):
    docs = odd_rows(spark)
    (docs.limit(0) if empty else docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string, doc_id long").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(set(r.asDict()) == {"doc_id", "source", "size", "source_size", "target", "taken"} for r in rows)
    # Without labels nothing is rejected; the copy, and one of the two empty texts, go as near duplicates.
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in rows) == ([] if empty else [-1, *range(12), 40, 42])


def test_classifiers_of_nothing_and_of_nulls(spark):
    docs, names = odd_rows(spark), list(CATEGORIES)
    labels = spark.createDataFrame([(3, 1, 0), (40, 0, 1), (41, 0, 1), (None, 1, 1), (9, None, 1)], "doc_id long, quality int, toxic int")
    for labelled in (labels, labels.limit(0)):
        models = toxicity.fit(quality.labelled(docs, labelled, CATEGORIES), names)
        scored = toxicity.score(docs, models, names)
        assert scored.count() == docs.count() and toxicity.score(docs.limit(0), models, names).count() == 0
        assert scored.filter("doc_id in (40, 41)").select("p_abusive").distinct().count() == 1  # a null text is an empty one
        assert scored.filter("p_abusive < 0 or p_abusive > 1 or isnan(p_abusive)").count() == 0
