"""Integer forms of float vectors, shared by the operators on vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer components stay below this, so that no sum of products or squares leaves 64 bits.
MOST = 1 << 27


def floored(vector: Column) -> Column:
    """floor(256 * x) of every component, computed on doubles; a component of 2 ** 19 or more is an error that names it."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * 256.0))
    large = F.exists(vector, lambda x: F.abs(x.cast("double")) * 256.0 >= MOST)
    return F.when(large, F.raise_error(F.lit("a vector component of 2 ** 19 or more doesn't fit the integer scale")).cast("array<int>")).otherwise(scaled.cast("array<int>"))


def whole_vectors(rows: DataFrame, vector: str, key: str) -> tuple[DataFrame, int]:
    """`rows` with a column `_x` (array<int>) in place of `vector`, and the vectors' length.

    Rows whose vector is null or holds null or non-finite components are left out. The row with the smallest key, ties by
    components, sets the length; rows of another length can't be compared with it and are left out too. An empty table has
    length 0.
    """
    v = F.col(vector)
    infinite = F.lit(float("inf"))
    usable = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == infinite))
    kept = rows.where(F.coalesce(usable, F.lit(False))).withColumn("_x", floored(v)).drop(vector)
    first = kept.select(F.col(key).alias("k"), F.col("_x").alias("x")).orderBy(F.col("k").asc_nulls_last(), "x").select(F.size("x").alias("n")).limit(1).collect()
    length = first[0]["n"] if first else 0
    return kept.where(F.size("_x") == length), length
