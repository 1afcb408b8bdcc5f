"""Ranges of an order that hold about equally many bytes, with exact bounds that are the same in every run."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard

#: Ranges at most; their bounds, 24 bytes each, go to the driver and with every task.
MOST_RANGES = 100_000
_LEAST = -(1 << 63)


def byte_ranges(keys: DataFrame, range_bytes: int) -> tuple[int, Callable[[Column, Column], Column]]:
    """(number of ranges, range of a row by its k and x) for keys (k long, x long, size long), ordered by k, nulls first, then x.

    A range ends where the running sum of sizes passes a multiple of range_bytes. The sum is exact: Spark's own sampled
    ranges only spread the work, and a sum for each of them is all that the driver gets besides the bounds. So the
    bounds follow from the rows alone. Rows with equal k and x are in one range; a hot k is split by x. An empty table
    has one range.
    """
    spark = keys.sparkSession
    spread = cut(keys.repartitionByRange("k", "x").withColumn("p", F.spark_partition_id()), "ordered")
    sums, total = spread.groupBy("p").agg(F.sum("size").alias("size")).orderBy("p").collect(), 0
    begins = []
    for r in sums:
        begins.append((r["p"], total))
        total += r["size"] or 0
    range_bytes = max(range_bytes, -(-total // MOST_RANGES))
    if total <= range_bytes:
        discard(spread)
        return 1, lambda k, x: F.lit(0)
    offsets = spark.createDataFrame(begins, "p int, begin long")
    earlier = Window.partitionBy("p").orderBy("k", "x").rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0))).join(F.broadcast(offsets), "p")
    first = placed.groupBy(F.floor((F.col("before") + F.col("begin")) / range_bytes).alias("r")).agg(F.min(F.struct(F.col("k").isNotNull().alias("there"), "k", "x")).alias("b"))
    bounds = sorted({(_LEAST if r["b"]["k"] is None else r["b"]["k"], r["b"]["x"]) for r in first.collect()})
    discard(spread)

    @F.arrow_udf("int")
    def place(k, x):
        import numpy as np
        import pyarrow as pa

        own, ties = k.fill_null(_LEAST).to_numpy(), x.to_numpy()
        ids = np.array([b[0] for b in bounds], np.int64)
        at = np.searchsorted(ids, own, "right") - 1
        for i in np.flatnonzero(ids[np.maximum(at, 0)] == own).tolist():
            at[i] = bisect_right(bounds, (own[i], ties[i])) - 1
        return pa.array(np.maximum(at, 0).astype(np.int32))

    return len(bounds), place
