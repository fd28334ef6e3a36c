"""Helpers that the operators of this folder share: stored tables, document groups, small-side joins."""
from __future__ import annotations

import tempfile
import uuid
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: A word: anything but a blank and the ASCII control blanks.
WORD = "[^\\x20\\x09-\\x0D]+"
#: A side of a join is broadcast up to this many rows (of a few numbers or short strings each).
BROADCAST_ROWS = 100_000
#: Cells of doc_ids for a group, about.
_FAN = 8


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the session's checkpoint folder, which all executors share.

    Where a local session names none (as in tests) one is set for it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillfolio-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/quillfolio-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: computed once, and cut from its lineage."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id as a long and text as a string, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def join_small(big: DataFrame, small: DataFrame, on: str, spread: Column, how: str = "inner", rows: int = BROADCAST_ROWS, salts: int = 32) -> DataFrame:
    """Join a table to one with a row for each value of `on`, without one task per value.

    The small side is broadcast if it has at most `rows` rows; beyond that it is
    copied to `salts` salts and the big side's rows are dealt over them by `spread`.
    """
    if small.limit(rows + 1).count() <= rows:
        return big.join(F.broadcast(small), on, how)
    dealt = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(dealt, [on, "__salt"], how).drop("__salt")


def _cell(parent: Column, low: Column, width: Column) -> Column:
    """The key of the cell, among those that a parent's range is cut into, that a doc_id falls in."""
    away = F.col("doc_id").cast("decimal(20,0)") - low
    return F.concat_ws(":", parent, F.floor((away - F.pmod(away, width)) / width).cast("string"))


def _found(docs: DataFrame, levels: list[DataFrame], low: int, width: int) -> DataFrame:
    """docs with the cell that each row's doc_id falls in, looked up level by level: name, least, most, share and `split`, whether it is cut further."""
    whole = "decimal(20,0)"
    rows = docs.withColumn("key", _cell(F.lit("0"), F.lit(Decimal(low)).cast(whole), F.lit(Decimal(width)).cast(whole)))
    for k, level in enumerate(levels):
        mine = level.select("key", *[F.col(c).alias(f"new_{c}") for c in level.columns if c != "key"])
        held = [c for c in level.columns if c != "key"]
        rows = join_small(rows, mine, "key", F.col("text"), "left")
        rows = rows.withColumns({c: F.coalesce(f"new_{c}", c) if k else F.col(f"new_{c}") for c in held}).drop(*[f"new_{c}" for c in held])
        rows = rows.withColumn("key", F.when(F.col("split"), _cell(F.col("name"), F.col("least").cast(whole), F.col("width"))))
    return rows


def id_groups(docs: DataFrame, bytes_per_group: int, rows_per_group: int) -> tuple[DataFrame, int]:
    """doc_id, text and g: contiguous ranges of doc_id, about as many bytes and rows each as asked for, and the bytes of all texts.

    Groups follow the order of doc_id.  The range of the ids is cut into cells, some for each
    group, and a cell's share of a group is counted; where ids crowd, a cell with more than two groups is cut again
    between its own least and largest id.  The shares are added up in the order of the cells, and a
    row's group is the sum before its cell plus its place in the cell, in whole groups.  So the plan
    has the same size however many groups there are, and a range of long texts is cut finer.
    Rows without a doc_id go to further groups by their text; all rows of one doc_id are one group's.
    """
    docs, size = texts(docs), F.octet_length("text").cast("double")
    share = F.greatest(F.coalesce(F.sum(size), F.lit(0.0)) / bytes_per_group, F.count(F.lit(1)) / rows_per_group)
    none = F.col("doc_id").isNull()
    low, high, bytes_, total, loose = docs.agg(
        F.min("doc_id"), F.max("doc_id"), F.coalesce(F.sum(size), F.lit(0.0)), share,
        F.greatest(F.coalesce(F.sum(F.when(none, size)), F.lit(0.0)) / bytes_per_group, F.count_if(none) / rows_per_group),
    ).first()
    low, span, levels = low or 0, (high or 0) - (low or 0) + 1, []
    width = max(1, -(-span // max(1, int(_FAN * total))))
    while True:
        rows = _found(docs.filter(~none), levels, low, width).filter("key is not null")
        cells = rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), share.alias("share"))
        reach = F.col("most").cast("decimal(20,0)") - F.col("least").cast("decimal(20,0)") + 1
        split = (F.col("share") > 2) & (F.col("most") > F.col("least"))
        cells = cells.withColumns({"split": split, "width": F.greatest(F.ceil(reach / F.ceil(F.col("share") * _FAN).cast("decimal(20,0)")), F.lit(1)).cast("decimal(20,0)")})
        levels.append(stored(cells.withColumn("name", F.concat(F.lit(f"{len(levels)}."), F.monotonically_increasing_id().cast("string")))))
        if levels[-1].filter("split").isEmpty():
            break
    leaves = reduce(DataFrame.unionByName, [x.filter("not split").select("name", "least", "share") for x in levels])
    # Sums in two steps: within ranges of cells, and over the ranges' totals, of which there are few.
    leaves = stored(leaves.repartitionByRange("least").withColumn("run", F.spark_partition_id()))
    runs = leaves.groupBy("run").agg(F.sum("share").alias("all"))
    runs = runs.select("run", F.coalesce(F.sum("all").over(W.orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    upto = W.partitionBy("run").orderBy("least").rowsBetween(W.unboundedPreceding, -1)
    starts = leaves.join(runs, "run").select("name", (F.col("before") + F.coalesce(F.sum("share").over(upto), F.lit(0.0))).alias("start"))
    levels = [stored(x.join(starts, "name", "left")) for x in levels]
    placed = _found(docs, levels, low, width)
    decimal = lambda c: F.col(c).cast("decimal(20,0)")
    part = (decimal("doc_id") - decimal("least")).cast("double") / (decimal("most") - decimal("least") + 1).cast("double")
    spread = F.lit(int(total) + 2) + F.pmod(F.xxhash64("text"), F.lit(int(loose) + 1))
    g = F.when(none, spread).otherwise(F.floor(F.col("start") + F.col("share") * part))
    return placed.select("doc_id", "text", g.cast("int").alias("g")), int(bytes_)
