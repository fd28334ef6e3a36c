"""Bottom-k sketches of word shingles: mergeable fingerprints of documents."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import id_groups, join_small, stored

#: The range of an unsigned 64-bit hash.
_RANGE = float(2**64)


def _unsigned(h: Column) -> Column:
    """A signed 64-bit hash as a fraction of the unsigned range (signed order, shifted to start at 0)."""
    return (h.cast("double") + float(2**63)) / _RANGE


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased."""
    return F.filter(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def sketch(text: Column, k: int, shingle: int = 5) -> Column:
    """The k smallest distinct hashes of a text's word shingles, ascending.

    A text of fewer words, but not none, is one shingle; one without words has an empty
    sketch, as has a null.  A sketch with fewer than k hashes holds all of the text's.
    """
    hashed = F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))
    # A one-element array and transform name the hashes once, so that each word is hashed once.
    windows = lambda h: F.when(F.size(h) >= shingle, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(h) - shingle, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(shingle)])
    )).when(F.size(h) > 0, F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))).otherwise(F.array().cast("array<long>"))
    return F.slice(F.sort_array(F.array_distinct(F.element_at(F.transform(F.array(hashed), windows), 1))), 1, k)


def merge(a: Column, b: Column, k: int) -> Column:
    """The sketch of two parts' shingles together, from the parts' sketches."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(s: Column, k: int) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash as a fraction of the range."""
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / _unsigned(F.element_at(s, -1)))


def resemblance(a: Column, b: Column, k: int) -> Column:
    """Estimated share of common shingles among all of both: those in both sketches among the k smallest of the union.

    Two empty sketches resemble each other wholly (1), an empty one and another not at all (0).
    """
    both = merge(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), both)) / F.size(both))


def containment(a: Column, b: Column, k: int) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    both = distinct_count(merge(a, b, k), k) * resemblance(a, b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def as_text(s: Column) -> Column:
    """A sketch as a string of 16 hexadecimal digits a hash, in the order of the sketch."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def sketches(docs: DataFrame, k: int = 128, shingle: int = 5) -> DataFrame:
    """doc_id, sketch, n_shingles (estimated) of every row; null and empty texts have an empty sketch, repeated rows equal ones."""
    s = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sketch(F.col("text").cast("string"), k, shingle).alias("sketch"))
    return s.withColumn("n_shingles", distinct_count(F.col("sketch"), k))


def part_sketches(docs: DataFrame, by: str, k: int = 128, shingle: int = 5, salts: int = 16) -> DataFrame:
    """`by`, sketch: one sketch for each value of a column, merged from its documents' sketches.

    The k smallest hashes of a value are found within salts first, so one value with most
    of the rows meets in one task only as salts * k hashes.
    """
    part = F.col(by).alias("part")
    hashes = docs.select(part, F.explode(sketch(F.col("text").cast("string"), k, shingle)).alias("h")).distinct()
    for key in (["part", F.pmod("h", F.lit(salts)).alias("salt")], ["part"]):
        low = W.partitionBy(*key).orderBy("h")
        hashes = hashes.withColumn("n", F.row_number().over(low)).filter(F.col("n") <= k).drop("n")
    return hashes.groupBy("part").agg(F.sort_array(F.collect_list("h")).alias("sketch")).withColumnRenamed("part", by)


def _before(groups: DataFrame) -> DataFrame:
    """g, before: the group before each one, the last one before the first.  In two steps: within runs of groups, and over the runs, which are few."""
    run = groups.select("g", F.floor(F.col("g") / 4096).alias("run"))
    ends = run.groupBy("run").agg(F.max("g").alias("end"))
    carry = ends.select("run", F.max("end").over(W.orderBy("run").rowsBetween(W.unboundedPreceding, -1)).alias("carry"))
    own = run.withColumn("own", F.lag("g").over(W.partitionBy("run").orderBy("g")))
    return own.join(carry, "run").select("g", F.coalesce("own", "carry", groups.agg(F.max("g")).scalar()).alias("before"))


def edited_sketches(docs: DataFrame, k: int = 128, shingle: int = 5, bytes_per_group: int = 4 << 20, rows_per_group: int = 1500) -> DataFrame:
    """Each text beside its edited form: the last half of its characters replaced by the next document's first ones.

    The next document is the one with the next greater doc_id (after the last: the first);
    rows that repeat a doc_id follow each other by text, rows without one come last by
    text, group by group.  Documents are dealt into ranges of doc_id once; a range also
    gets the first row of the next one, so no order over all rows is needed.

    Returns doc_id, n_chars, edited (text), sketch, edited_sketch, next_sketch.  A null text
    is empty; a single document is its own next one.
    """
    grouped, _ = id_groups(docs, bytes_per_group, rows_per_group)
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc()]
    # The first row of each range, by (doc_id, text); one row a range.
    least = stored(grouped.groupBy("g").agg(F.min("doc_id").alias("least")))
    heads = join_small(grouped, least, "g", F.col("text")).filter("doc_id <=> least").groupBy("g").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    heads = stored(heads.join(_before(least), "g").select(F.col("before").alias("g"), "doc_id", "text", F.lit(1).alias("head")))
    rows = grouped.select("g", "doc_id", "text", F.lit(0).alias("head")).unionByName(heads)
    rows = rows.repartition("g").withColumn("sketch", sketch(F.col("text"), k, shingle))
    at = W.partitionBy("g").orderBy("head", *order)
    rows = rows.withColumn("next_text", F.lead("text").over(at)).withColumn("next_sketch", F.lead("sketch").over(at)).filter("head = 0")
    n_chars = F.char_length("text")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.substring("next_text", F.lit(1), half))
    return rows.select("doc_id", n_chars.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch").withColumn(
        "edited_sketch", sketch(F.col("edited"), k, shingle)
    )
