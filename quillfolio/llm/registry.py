"""Queries over the test tables that apply this folder's operators, and SQL for their rows where there is some."""
from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import balltree, bottomk, cuckoo, fmindex, gridcodes, katz, mixing, personal, quality, simhash, termscan, toxicity, windows
from .common import join_small, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Weights of the sources in order of name, repeating.
WEIGHTS = (3.0, 1.0, 2.0)


@query("op1_source_mix")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "whole_copies")


ORACLES["op1_source_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || md5('1:' || doc_id)[1:12])::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3::DOUBLE, 1::DOUBLE, 2::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sized GROUP BY source
), levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - 2::DOUBLE * coalesce(sum(source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, source_size / weight AS fill
  FROM sources WINDOW f AS (ORDER BY source_size / weight, source NULLS LAST)
), cut AS (
  SELECT arg_min(level, fill) AS level, min(fill) AS fill FROM levels WHERE level * weight <= source_size * 2::DOUBLE
), targets AS (
  SELECT source, source_size, CASE WHEN l.fill >= cut.fill THEN cut.level * weight ELSE source_size * 2::DOUBLE END AS target FROM levels l, cut
), parts AS (
  SELECT *, floor(target / source_size)::BIGINT AS whole_copies, target / source_size - floor(target / source_size) AS part FROM targets
), ranked AS (
  SELECT s.*, p.source_size, p.target, p.whole_copies, p.target - p.whole_copies * p.source_size AS wanted,
    CASE WHEN part > 0 THEN u / (1 - u) / (part / (1 - part) * (1000::DOUBLE / (1000::DOUBLE + size))) END AS rank
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, source, whole_copies,
  size * (whole_copies + CASE WHEN rank IS NOT NULL AND sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2 <= wanted THEN 1 ELSE 0 END) AS taken
FROM ranked
"""


@query("op10_bottom_k")
def bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = 128
    s = bottomk.edited_sketches(table(spark, sf_dir, "documents"), k)
    return s.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), bottomk.as_text(F.col("sketch")).alias("fingerprint"),
        bottomk.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        bottomk.resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        bottomk.resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        bottomk.containment(F.col("sketch"), F.col("edited_sketch"), k).alias("kept_share"),
        bottomk.distinct_count(F.col("sketch"), k).alias("n_shingles"),
    )


@query("op3_repeated_windows")
def repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = windows.remove_repeated_windows(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("intervals").alias("n_intervals"))


@query("op4_benchmark_windows")
def benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fmindex.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return r.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        fmindex.contaminated().alias("contaminated"),
    )


@query("op5_simhash_components")
def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return r.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    r = cuckoo.LineIndex.new(spark).insert_batches(docs).deduplicated(docs)
    return r.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op6_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents
), keyed AS (
  SELECT doc_id, n, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT a.doc_id, a.n, a.line, s.k IS NOT NULL AND a.doc_id <> s.first AS gone FROM keyed a LEFT JOIN shared s ON a.k = s.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


#: The labels' categories in the order of the chain: a text can be junk, abusive, or abusive junk.
CATEGORIES = {
    "junk": "1 - cast(quality as int)",
    "abusive": "cast(toxic as int)",
    "abusive_junk": "(1 - cast(quality as int)) * cast(toxic as int)",
}


@query("op7_toxicity_chain")
def toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, names = table(spark, sf_dir, "documents"), list(CATEGORIES)
    models = toxicity.fit(quality.labelled(docs, table(spark, sf_dir, "labels"), CATEGORIES), names)
    r = toxicity.score(docs, models, names)
    toxic = F.greatest("p_abusive", "p_abusive_junk")
    return r.select("doc_id", toxic.alias("score"), (toxic >= 0.5).cast("int").alias("toxic"), *[f"p_{c}" for c in names])


@query("op9_quality_nbsvm")
def quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(quality.training_rows(docs, table(spark, sf_dir, "labels")))
    r = quality.score(docs, model)
    return r.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = personal.find(table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda s: s["base"]))
    counts = [personal.count_of(F.col("base"), name).alias(f"n_{name}") for name in personal.KINDS]
    return r.select("doc_id", *counts, F.sha2(personal.listed(F.col("base")), 256).alias("base_sha256"), personal.listed(F.col("spans")).alias("spans"))


@query("op2_katz_scores")
def katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    return katz.KatzModel.of(table(spark, sf_dir, "documents"), held_out).scores()


@query("op11_term_scan")
def term_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termscan.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_term_scan"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), sums AS (
  SELECT count(*) FILTER (len(terms) > 0)::BIGINT AS docs, sum(len(terms))::BIGINT AS total FROM d
), tf AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) GROUP BY doc_id, n, term
), q AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY item_id, term
), w AS (
  SELECT term, floor(1000::DOUBLE * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, sums WHERE term IN (SELECT term FROM q) GROUP BY term, docs
), scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
  FROM tf JOIN w USING (term) JOIN q USING (term), sums GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20
"""


@query("op12_grid_codes")
def grid_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = gridcodes.fit(vectors)
    coded = stored(gridcodes.encode(vectors, books, ("label",)).withColumn("of", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))))
    sums = coded.groupBy("of").agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()
    return join_small(coded, sums, "of", F.col("vec_id")).select(
        "vec_id", F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "").alias("code"), "error", "label_error",
        F.lit(digest).alias("codebooks_sha256"),
    )


def _grid_sql(rounds: int = 6) -> str:
    assign = """SELECT vec_id, label, p.part, x, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 16 + entry) AS found
  FROM p JOIN b{k} b ON p.part = b.part GROUP BY vec_id, label, p.part, x"""
    ctes = [
        "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT vec_id, label, part, list_slice(e, part * (len(e) // 8) + 1, (part + 1) * (len(e) // 8)) AS x FROM v, range(8) r(part))",
        "b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16))",
    ]
    for k in range(rounds):
        ctes += [
            f"a{k} AS MATERIALIZED ({assign.format(k=k)})",
            f"t{k} AS (SELECT part, found % 16 AS entry, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM a{k}, range(1, 1 + (SELECT max(len(x)) FROM p)) r(i) GROUP BY part, found % 16, i)",
            f"m{k} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM t{k} GROUP BY part, entry)",
            f"b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (part, entry))",
        ]
    return f"""WITH {", ".join(ctes)}, last AS MATERIALIZED ({assign.format(k=rounds)}),
digest AS (SELECT sha256(string_agg(c[i]::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM b{rounds}, range(1, 1 + (SELECT max(len(x)) FROM p)) r(i)),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', found % 16), '' ORDER BY part) AS code, sum(found // 16)::BIGINT AS error FROM last GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, digest"""


ORACLES["op12_grid_codes"] = _grid_sql()


@query("op13_ball_tree")
def ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_inner_products(table(spark, sf_dir, "embeddings"))


ORACLES["op13_ball_tree"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 10
"""
