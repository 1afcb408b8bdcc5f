"""Incremental upkeep: a stream of partial records merged into a table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.federate import merged_state
from ..sources import store

#: Batches after which the changes are merged into a new base.
COMPACT_EVERY = 16


def warm(stream: DataFrame, key: str, order: str, path: str, checkpoint: str, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Merge each micro-batch column-wise into the table at `path`, which warmed() reads.

    A batch is merged in itself and written as PATH/v=BATCH, so its cost follows the batch; a repeated batch overwrites
    its own version only. Every `compact_every` batches the changes are merged into PATH/base/v=BATCH and go, with the
    older base. Each value keeps its order (_o_NAME), so the result is that of one merge of all rows, also for late ones.
    A version that is missing fails the stream.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        since = _since(spark, path, number - 1)
        store.write_version(merged_state(batch, key, order), path, number)
        if since and (number + 1) % compact_every == 0:
            store.write_version(_whole(spark, path, [*since, number], key, order), f"{path}/base", number)
            for old in since:
                store.drop(spark, f"{path}/v={old}")
            for old in store.versions(spark, f"{path}/base")[:-1]:
                store.drop(spark, f"{path}/base/v={old}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _since(spark: SparkSession, path: str, last: int) -> list[int]:
    """The versions after the base up to `last`, all of which have to be there."""
    base, there = store.latest(spark, f"{path}/base"), set(store.versions(spark, path))
    wanted = list(range(0 if base is None else base + 1, last + 1))
    if lost := [n for n in wanted if n not in there]:
        raise RuntimeError(f"versions {lost} of {path} are missing")
    return wanted


def _whole(spark: SparkSession, path: str, numbers: list[int], key: str, order: str) -> DataFrame:
    base = store.latest(spark, f"{path}/base")
    parts = [f"{path}/v={n}" for n in numbers if base is None or n > base] + ([] if base is None else [f"{path}/base/v={base}"])
    return merged_state(spark.read.parquet(*parts), key, order)


def warmed(spark: SparkSession, path: str, key: str, order: str, fresh_from=None) -> DataFrame:
    """The table that warm() keeps: one row per key, of each column the latest value that is not null.

    fresh_from: records whose last value came before this value of `order` have expired and are left out.
    """
    there = [*store.versions(spark, path), *store.versions(spark, f"{path}/base")]
    if not there:
        raise FileNotFoundError(f"no version of a warmed table in {path}")
    last = max(there)
    whole = _whole(spark, path, _since(spark, path, last), key, order)
    whole = whole if fresh_from is None else whole.where(F.col(order) >= F.lit(fresh_from))
    return whole.select(*[c for c in whole.columns if not c.startswith("_o_")])


def asked_again(requests: DataFrame, key: str, at: str, ttl_seconds: int, late: str = "0 seconds") -> DataFrame:
    """Of a stream of requests (key, at) those that have to be asked: of a record that is not warm, as none of its requests was
    passed on in the `ttl_seconds` before. (key, at)

    State is the time of the last request that was passed on, for each key; it goes once the watermark, `late` behind the latest
    request, is past its expiry, so it holds the warm records alone. Requests in a batch are taken in the order of their
    times; those behind the watermark are dropped. Null keys and times are never asked.
    """
    kinds = dict(requests.dtypes)
    timed = requests.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", late)

    def step(name, parts, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        passed, ttl = [], pd.Timedelta(seconds=ttl_seconds)
        for t in pd.concat([p["at"] for p in parts]).sort_values():
            if last is None or t >= last + ttl:
                passed.append(t)
                last = t
        state.update((last.value // 1000,))
        expiry = int((last + ttl).value // 1_000_000)
        state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [name[0]] * len(passed), "at": passed})

    out = timed.groupBy("key").applyInPandasWithState(step, f"key {kinds[key]}, at timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumnsRenamed({"key": key, "at": at})


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and tumbling window, late events dropped past the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
