"""Mixing sources to target weights by Pareto order sampling."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, join_small, stored

#: Ranking odds are dealt into this many steps, so that only one step of a source needs an order of its rows.
STEPS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size, target: `share` of all sizes split by weight.

    sizes: source, source_size.  Weights repeat over the sources in order of name, null
    last.  A target stops at `most` times its source's size; what is over goes to the
    others by weight.  Sources are filled in order of size over weight: once one is not
    filled up, no later one is.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = W.partitionBy()
    fill = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    full = (
        sizes.withColumn("weight", weight)
        .withColumn("rest", F.sum("source_size").over(everything) * share - most * (F.sum("source_size").over(fill.rowsBetween(W.unboundedPreceding, -1)).cast("double")))
        .withColumn("rest", F.coalesce("rest", F.sum("source_size").over(everything) * share))
        .withColumn("weights", F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", F.col("rest") / F.col("weights"))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("source_size") * most)
    )
    # The level at the first source that stays below its limit holds for all from there on.
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(W.unboundedPreceding, 0))
    return full.withColumn("level", level).select(
        "source", "source_size", F.coalesce(F.col("level") * F.col("weight"), F.col("source_size") * most).cast("double").alias("target")
    )


def chance(doc_id: Column, text: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 from a document's id (its text where it has none): the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), text, F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**48)


def mix(docs: DataFrame, weights: Sequence[float], share: float = 1.5, most: float = 2.0, seed: int = 1, tilt: float | None = 1000.0) -> DataFrame:
    """Take documents so that each source gives its target number of words.

    A source whose target is r times its size takes every document floor(r) times for
    certain.  The fraction f that is left is a document's inclusion probability; documents
    are ranked by their random odds u / (1 - u) over their inclusion odds f / (1 - f) (Pareto
    order sampling) and taken once more from the lowest on, until the words wanted are
    reached.  With `tilt`, inclusion odds are multiplied by tilt / (tilt + size), so that one
    very long text seldom fills a source's share; None leaves them equal.

    The document at the limit is taken if half of it fits, so a source misses its target by
    at most half of that document.  Returns a row for each row of docs: doc_id, source, size, source_size,
    target, whole_copies, sampled, taken.  The draw depends on doc_id and seed alone.

    A null text has no words; a null doc_id draws by its text; rows that repeat a doc_id
    draw the same number and are ordered by size; a null source is a source.  An empty
    table gives no rows, a source without words has the target 0.
    """
    sized = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"),
            chance(F.col("doc_id"), F.col("text"), seed).alias("u"),
        )
    )
    plan = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    plan = stored(
        plan.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("whole_copies", F.floor("ratio").cast("long")).withColumn("part", F.col("ratio") - F.col("whole_copies"))
        .withColumn("wanted", F.col("target") - F.col("whole_copies") * F.col("source_size"))
        .withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    ).drop("source")
    odds = F.col("part") / (1 - F.col("part"))
    if tilt is not None:
        odds = odds * (tilt / (tilt + F.col("size")))
    rows = join_small(sized.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), plan, "key", F.col("u"))
    rows = rows.withColumn("rank", F.when(F.col("part") > 0, F.col("u") / (1 - F.col("u")) / odds))
    # rank / (1 + rank) spreads the ranks over 0 to 1; sizes are summed by step, and only the step with the limit is ordered.
    rows = stored(rows.withColumn("step", F.floor(F.col("rank") / (1 + F.col("rank")) * STEPS).cast("int")))
    steps = rows.filter("rank is not null").groupBy("key", "step").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
    upto = W.partitionBy("key").orderBy("step")
    edge = (
        steps.withColumn("upto", F.sum("words").over(upto)).filter(F.col("upto") - F.col("words") < F.col("wanted"))
        .groupBy("key").agg(F.max("step").alias("edge"), (F.max("upto") - F.max_by("words", "step")).alias("before"))
    )
    rows = join_small(rows, edge, "key", F.col("u"), "left")
    inner = W.partitionBy("key").orderBy("rank", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, 0)
    at_edge = rows.filter("step = edge").withColumn("sampled", F.col("before") + F.sum("size").over(inner) - F.col("size") / 2 <= F.col("wanted"))
    others = rows.filter("step is null or edge is null or step <> edge").withColumn("sampled", F.coalesce(F.col("step") < F.col("edge"), F.lit(False)))
    return others.unionByName(at_edge).select(
        "doc_id", "source", "size", "source_size", "target", "whole_copies", "sampled",
        (F.col("size") * (F.col("whole_copies") + F.col("sampled").cast("long"))).alias("taken"),
    )
