"""Versioned tables in folders that every executor can reach, and small documents that exactly one writer creates."""

from __future__ import annotations

import atexit
import contextlib
import json
import os
import re
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Folders that this process made for an application and drops when the process ends.
_OWN: list[tuple[SparkSession, str]] = []


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def work_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which a cluster shares; in local mode without it a temporary folder that goes with the process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="shelfspark-")
    atexit.register(shutil.rmtree, made, True)
    spark.conf.set("spark.checkpoint.dir", f"file:{made}")
    return f"file:{made}"


def own_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the work folder that is dropped when the process ends, so that none stays in a shared place."""
    made = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if not _OWN:
        atexit.register(_drop_own)
    _OWN.append((spark, made))
    return made


def _drop_own() -> None:
    for spark, path in _OWN:
        with contextlib.suppress(Exception):  # a stopped session can't be asked any more
            drop(spark, path)
    _OWN.clear()


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers N of the complete versions PATH/v=N in order; a folder that isn't there has none."""
    names = [n for n in listed(spark, path) if re.fullmatch(r"v=\d+", n)]
    fs, _ = _fs(spark, path)
    return [n for n in sorted(int(n[2:]) for n in names) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={n}/_SUCCESS"))]


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; one that isn't there has none."""
    fs, where = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def listed_times(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """(name, seconds since the epoch of its last change) of what is in a folder."""
    fs, where = _fs(spark, path)
    return sorted((s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(where)) if fs.exists(where) else []


def latest(spark: SparkSession, path: str) -> int | None:
    return max(versions(spark, path), default=None)


def drop(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def write_version(df: DataFrame, path: str, number: int) -> None:
    """Write PATH/v=NUMBER; it counts only once Spark has left its mark of success."""
    df.write.mode("overwrite").parquet(f"{path}/v={number}")


def create_once(spark: SparkSession, path: str, document: object) -> bool:
    """Create a JSON document at `path`, whole or not at all; false if it is there already, whoever made it.

    It is written under another name first. On a local mount a hard link gives it its name, which fails if the name is
    taken; elsewhere a rename that may not replace, which HDFS carries out atomically.
    """
    text, temporary = json.dumps(document), f"{path}.{uuid.uuid4().hex}"
    fs, where = _fs(spark, temporary)
    fs.mkdirs(where.getParent())
    out = fs.create(where)
    out.write(bytearray(text.encode()))
    out.close()
    parts = urlparse(fs.makeQualified(where).toString())
    if parts.scheme == "file":
        try:
            os.link(parts.path, urlparse(path).path)
        except FileExistsError:
            return False
        finally:
            fs.delete(where, False)
        return True
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(where, jvm.org.apache.hadoop.fs.Path(path), options)
    except Py4JJavaError as e:
        fs.delete(where, False)
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    return True


def read_document(spark: SparkSession, path: str):
    """The JSON document at `path`."""
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def staged(df: DataFrame, label: str = "staged") -> DataFrame:
    """Write a table that several later steps read, and read it back; it goes with the process or by drop_staged()."""
    path = own_folder(df.sparkSession, label)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.staged_path = path
    return back


def drop_staged(*tables: DataFrame) -> None:
    for df in tables:
        drop(df.sparkSession, df.staged_path)
