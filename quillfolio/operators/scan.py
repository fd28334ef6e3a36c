"""Running totals over long sequences, without one task per key.

A plain window puts every row of a key in one task.  Here a key's rows are cut
into chunks that follow the order of the sequence; each chunk is summed and
windowed on its own, and only the chunk totals are windowed per key.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..sources.scratch import written

# Rows of one key and day above which the day itself is cut into buckets, and rows of a bucket, about.
BUCKET_ROWS = 50_000
# Rows that a task of a wide window holds, about.
TASK_ROWS = 500_000


def ranges(df: DataFrame, order: list[str], rows: int, out: str = "bucket") -> DataFrame:
    """Add a number that does not decrease along ``order``, about ``rows`` rows sharing each.

    The split points come from Spark's own sample of the rows, so values or ids that crowd together
    are cut as finely as others.  The rows are written to a scratch table: a second
    sample would give other points.  Up to BUCKET_ROWS rows share one number.
    """
    if rows <= BUCKET_ROWS:
        return df.withColumn(out, F.lit(0).cast("long"))
    parts = -(-rows // BUCKET_ROWS) * 2
    return written(df.repartitionByRange(parts, *order).withColumn(out, F.spark_partition_id().cast("long")))


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """df of about ``rows`` rows dealt by ``keys``, TASK_ROWS to a task: its shuffle is not merged into fewer, larger tasks."""
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, *keys) if parts > 1 else df


def running_sums(
    df: DataFrame,
    keys: list[str],
    chunk: list[str],
    order: list[str],
    sums: dict[str, str],
) -> DataFrame:
    """Add ``out`` = sum of ``column`` over the key's rows up to this one.

    ``chunk`` columns must not decrease along ``chunk + order``; one (key,
    chunk) group is the largest unit a task sees.  Key and chunk columns must
    not be null.
    """
    cells = keys + chunk
    within = W.partitionBy(*cells).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*keys).orderBy(*chunk).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*cells).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    carry = totals.select(
        *cells, *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0.0)).alias(f"_b_{o}") for o in sums]
    )
    inner = df.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0.0)).alias(f"_w_{o}") for o, c in sums.items()])
    joined = inner.join(carry, cells, "left")
    return joined.select(
        *df.columns,
        *[(F.col(f"_w_{o}") + F.coalesce(F.col(f"_b_{o}"), F.lit(0.0))).alias(o) for o in sums],
    )


def day_buckets(df: DataFrame, keys: list[str], row_id: str, out: str = "bucket") -> DataFrame:
    """Add the bucket a row falls in: 0 where its (key) group is small, ranges of the row id in groups of over BUCKET_ROWS rows."""
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BUCKET_ROWS)
    rows = big.agg(F.sum("_n")).first()[0]
    if not rows:
        return df.withColumn(out, F.lit(0).cast("long"))
    big = written(big)  # groups of this size are few, by their size
    crowded = ranges(df.join(big.select(*keys), keys, "left_semi"), [*keys, row_id], rows, out)
    return df.join(big.select(*keys), keys, "left_anti").withColumn(out, F.lit(0).cast("long")).unionByName(crowded)
