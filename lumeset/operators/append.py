"""Ordered append: lists put one after another, each id where it first stands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from lumeset.session import materialise


def ordinals(df: DataFrame, order: list[str], name: str = "ord", parts: int | None = None) -> DataFrame:
    """Add the place of each row, from 0, in an order over all rows.

    Rows are dealt out by range and sorted in their parts; a row's place is its place in the part and the number of rows of the parts before, so no task
    holds the whole order. Rows are stored in between, so that a lost task does not number them anew.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumns({"_part": F.shiftright("_m", 33), "_i": F.col("_m").bitwiseAND((1 << 33) - 1)}).drop("_m")
    before = F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = placed.groupBy("_part").agg(F.count("*").alias("n")).select("_part", before.alias("_before"))  # a row a part
    return placed.join(F.broadcast(counts), "_part").withColumn(name, F.col("_before") + F.col("_i")).drop("_part", "_i", "_before")


def append(lists: list[DataFrame], key: str, order: list[str], name: str = "ord", parts: int | None = None) -> DataFrame:
    """The rows of all lists in turn, each list in its own order, without those whose key stands in one before: of several the first. Adds ``name``, the place from 0.

    Rows without a key are one key. All lists have the same columns, and ``order`` is a total order of a list's rows.
    """
    whole = reduce(DataFrame.unionByName, (x.withColumn("_list", F.lit(i)) for i, x in enumerate(lists)))
    fields = [c for c in whole.columns if c not in ("_list", *order)]
    first = whole.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct("_list", *order, *fields)).alias("r")).select("r.*")
    return ordinals(first, ["_list", *order], name, parts).select(*lists[0].columns, name)
