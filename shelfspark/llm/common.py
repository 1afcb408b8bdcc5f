"""What the operators of this subpackage share: shared folders, cut lineage, checked broadcasts."""

from __future__ import annotations

import json
import re
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows times their width stay below this.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, with its scheme: spark.checkpoint.dir, which Spark may set only itself in local mode.

    A folder without scheme is resolved by Hadoop's default filesystem, so that Spark and Store mean the same one.
    Unset, it is a folder of this machine in local mode (tests); on a cluster that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file:/tmp/shelfspark-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    where = spark._jvm.org.apache.hadoop.fs.Path(found)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Rows of a few numbers that one file holds where their count is known.
FILE_ROWS = 200_000


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str = "cut", most: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: later plans start there, also after a lost executor.

    most: a bound of the rows, if each is a few numbers; then no more tasks write than fill a file each, but for one
    on every core.
    """
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, label)
    if most is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, most // FILE_ROWS))
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # what was shuffled for a table that is written goes at once
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.cut_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete what cut() wrote, once nothing later reads it."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """`df`, marked for broadcast if its counted size is within the bound; else left to a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


#: Bits of the map that stands for keys too many to broadcast: 16 MiB whatever their number.
MAP_BITS = 27


def _one(bit: Column) -> Column:
    """The 64-bit word in which the last six bits of `bit` name the only set bit."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int"))


def _flagged(df: DataFrame, own: Column, wanted: DataFrame) -> tuple[DataFrame, str]:
    """`df` and the name of a further column: whether a row's 64-bit key `own` may be one of wanted (one bigint column).

    A map of MAP_BITS bits, one row of a fixed size, tells by a hash of the key. It never denies a wanted key; others
    pass by the share of bits that are set.
    """
    size, name = MAP_BITS - 6, f"_map{uuid.uuid4().hex}"
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << MAP_BITS))
    bit = place(F.col(wanted.columns[0]))
    zeros = df.sparkSession.range(1 << size).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("b"))
    words = zeros.union(wanted.select(F.shiftright(bit, 6).alias("w"), _one(bit).alias("b"))).groupBy("w").agg(F.bit_or("b").alias("b"))
    one = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias(name))
    one = F.broadcast(cut(one, "map"))  # 2 ** MAP_BITS bits
    held = F.get(name, F.shiftright(place(own), 6).cast("int")).bitwiseAND(_one(place(own))) != 0
    return df.join(one).select(*[df[c] for c in df.columns], held.alias(f"{name}_")), f"{name}_"


def possible(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of `df` whose key may be one of `wanted` (key); no wanted row is lost."""
    told, flag = _flagged(df, F.xxhash64(df[key]), wanted.select(F.xxhash64(key).alias("h")))
    return told.where(F.col(flag)).drop(flag)


def is_small(side: DataFrame, row_bytes: int) -> bool:
    return side.count() * row_bytes <= BROADCAST_BYTES


def looked_up(df: DataFrame, key: str, side: DataFrame, row_bytes: int, how: str = "inner") -> DataFrame:
    """`df` joined (inner or left_semi) with `side` by `key`: broadcast if its counted size is within the bound; else only
    rows that possible() lets through are shuffled."""
    if is_small(side, row_bytes):
        return df.join(F.broadcast(side), key, how)
    return possible(df, key, side.select(key)).join(side, key, how)


def without(df: DataFrame, side: DataFrame, same: Column, left: Column, right: Column, row_bytes: int) -> DataFrame:
    """Rows of `df` (alias l) that no row of `side` (alias r) is the same as; left and right are 64-bit keys that are equal then.

    A side within the bound is broadcast. Beyond it rows that the map denies stay where they are, and only the others
    are shuffled to be compared.
    """
    if is_small(side, row_bytes):
        return df.alias("l").join(F.broadcast(side).alias("r"), same, "left_anti")
    told, flag = _flagged(df.alias("l"), left, side.alias("r").select(right.alias("h")))
    maybe = told.where(F.col(flag)).drop(flag).alias("l").join(side.alias("r"), same, "left_anti")
    return told.where(~F.col(flag)).drop(flag).unionByName(maybe)


def without_ids(df: DataFrame, side: DataFrame) -> DataFrame:
    """Rows of `df` whose doc_id is not in `side` (doc_id)."""
    return without(df, side, F.col("l.doc_id") == F.col("r.doc_id"), F.xxhash64("l.doc_id"), F.xxhash64("r.doc_id"), 16)


def text_key(text: Column) -> Column:
    """The MD5 of a text, 16 bytes; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def arrow_batches(spark: SparkSession, rows: int = 500) -> None:
    """Texts can be long, so fewer of them go to Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; a null or empty text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: Catalyst copies a column's expression into lambdas that use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Store:
    """Files below one shared folder, by pyarrow's filesystems: executors write under temporary names and rename."""

    def __init__(self, base: str):
        from pyarrow import fs

        parts = urlparse(base)
        self.local = parts.scheme in ("", "file")
        self.fs, self.root = (fs.LocalFileSystem(), parts.path) if self.local else fs.FileSystem.from_uri(base)
        self.fs.create_dir(self.root, recursive=True)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self, name: str):
        return self.fs.open_output_stream(self.path(name), compression=None)

    def open(self, name: str):
        return self.fs.open_input_stream(self.path(name), compression=None)

    def rename(self, old: str, new: str) -> None:
        self.fs.move(self.path(old), self.path(new))

    def write_json(self, name: str, value: object) -> None:
        temporary = f"_{name}.{uuid.uuid4().hex}"
        with self.create(temporary) as out:
            out.write(json.dumps(value).encode())
        self.rename(temporary, name)

    def size(self, name: str) -> int:
        """Bytes of a file that has to be there."""
        info = self.fs.get_file_info(self.path(name))
        if not info.is_file:
            raise FileNotFoundError(self.path(name))
        return info.size

    def read_json(self, name: str):
        with self.open(name) as f:
            return json.loads(f.read())

    def array(self, name: str, dtype):
        """A flat file as an array: mapped where the folder is a local mount, read otherwise."""
        import numpy as np

        if self.size(name) == 0:
            return np.zeros(0, dtype)
        if self.local:
            return np.memmap(self.path(name), dtype, "r")
        with self.open(name) as f:
            return np.frombuffer(f.read(), dtype)
