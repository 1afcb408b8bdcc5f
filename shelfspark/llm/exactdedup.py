"""Exact dedup: 128-bit content hashes group the rows, bytes settle what a hash alone cannot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, looked_up, small_side, table, text_key, without


def exact_groups(docs: DataFrame, keep: str = "min", hashed: Callable[[Column], Column] = lambda c: F.unhex(F.md5(c))) -> DataFrame:
    """One row per document (doc_id, keep_id, group_size, kept, text_sha256), dropped ones too.

    docs: doc_id, text; other columns are not read. A null text counts as empty. Rows that repeat a doc_id with
    the same text are one document. keep: "min" or "max" doc_id of equal texts stays. Rows without a doc_id are
    grouped like others but kept only if no text of the group has an id. An empty table gives no rows.

    Hashes are shuffled, and of texts only those of groups with two or more members: the hashes of such groups are
    broadcast within a bound, beyond it a bit map of them holds back the other texts. The texts are compared as the
    least and the greatest one of each group (partial aggregates, so a hot group sends one row per task); a group
    whose texts differ shares a hash by accident and is grouped by its bytes instead.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select("doc_id", text.alias("_t"), hashed(text).alias("_h"))
    best = {"min": F.min, "max": F.max}[keep]
    many = keyed.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h")
    mixed = looked_up(keyed, "_h", cut(many, "hashes"), 40).groupBy("_h").agg(F.min("_t").alias("_a"), F.max("_t").alias("_b")).where("_a <> _b").select("_h")
    mixed = cut(mixed, "collisions")
    told = keyed if mixed.isEmpty() else keyed.join(mixed.withColumn("_x", F.lit(True)), "_h", "left")
    bytes_too = F.lit(None).cast("binary") if "_x" not in told.columns else F.when(F.col("_x"), F.col("_t"))
    rows = told.select("doc_id", "_h", bytes_too.alias("_k"), F.sha2("_t", 256).alias("text_sha256")).distinct()
    groups = rows.groupBy("_h", "_k").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    joined = rows.alias("r").join(groups.alias("g"), (F.col("r._h") == F.col("g._h")) & F.col("r._k").eqNullSafe(F.col("g._k")))
    return joined.select("r.doc_id", "keep_id", "group_size", F.col("r.doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, keep: str = "max") -> DataFrame:
    """`docs` without the rows that exact_groups() drops, one row for each document that stays.

    Rows that repeat a doc_id with another text are another document. Of equal texts without any doc_id one row stays,
    and none beside one with an id.
    """
    told = exact_groups(docs, keep)
    gone = cut(told.where("not kept").select("doc_id", F.unhex("text_sha256").alias("_h")).distinct(), "dropped")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))
    text = F.col("l.text")
    named = F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)) == F.col("r._h")
    left = without(docs, gone, same & named, F.xxhash64(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))), F.xxhash64("r._h"), 64)
    repeated = cut(docs.groupBy("doc_id", text_key(F.col("text")).alias("_m")).count().where("count > 1").select("doc_id", "_m"), "repeated")
    if repeated.isEmpty():
        return left
    repeated, twice = small_side(repeated, 40).alias("r"), same & (text_key(text) == F.col("r._m"))
    first = F.first(F.struct(*docs.columns)) if any("map<" in t or t == "variant" for _, t in docs.dtypes) else F.min(F.struct(*docs.columns))
    once = left.alias("l").join(repeated, twice, "left_semi").groupBy(F.col("doc_id").alias("d"), text_key(F.col("text")).alias("m")).agg(first.alias("r")).select("r.*")
    return left.alias("l").join(repeated, twice, "left_anti").unionByName(once)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


SQL = {
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t)"""
}
