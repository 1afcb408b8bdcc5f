"""Token ids as flat binary shards with 64-bit document offsets, written in id order and mapped when read."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, arrow_batches, fresh_dir, table
from .ranges import byte_ranges
from .tokens import END_ID, default_vocabulary, encoder, with_end

_MANIFEST = "shard string, first_id long, documents long, tokens long"


def width(vocabulary: str) -> str:
    """The narrowest little-endian unsigned type that holds every id of a vocabulary and the end id."""
    from tokenizers import Tokenizer

    return "<u2" if max(END_ID, *Tokenizer.from_file(vocabulary).get_vocab().values()) < 1 << 16 else "<u4"


def write_ids(docs: DataFrame, path: str, vocabulary: str, shard_bytes: int = 32 << 20) -> list[dict]:
    """Write the ids of docs (doc_id, text) below `path`; returns the manifest, also left there as manifest.json.

    Documents are dealt by exact ranges of doc_id that hold about `shard_bytes` of text (byte_ranges(); a hot doc_id is
    split by a hash of its texts) and sorted in each. A shard is three flat files: NAME.ids (little-endian ids, unsigned
    16-bit if the vocabulary fits, else 32-bit, 1 after each document), NAME.offsets (signed 64-bit: where each document
    begins, and the end) and NAME.docs (64-bit doc_id). A task writes under a temporary name and renames, so a repeated
    task leaves the same files. The manifest has one row per shard in order with `base`, the ids before the shard, by
    prefix sums. Null texts are empty; rows without doc_id have no place in the order and are not written; rows that
    repeat a doc_id are all written, ordered by a hash of the text; an empty table leaves an empty manifest.
    """
    spark, dtype = docs.sparkSession, width(vocabulary)
    arrow_batches(spark)
    text = F.coalesce("text", F.lit(""))
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("x"), text.alias("text"))
    parts, part_of = byte_ranges(known.select(F.col("doc_id").alias("k"), "x", (F.octet_length("text") + 1).cast("long").alias("size")), shard_bytes)
    known = known.withColumn("part", part_of(F.col("doc_id"), F.col("x"))).repartitionById(parts, "part").sortWithinPartitions("part", "doc_id", "x", "text")

    def write(batches):
        import numpy as np
        import pyarrow as pa

        store, ids_of, at, done = Store(path), encoder(vocabulary), None, []

        def close():
            begun.close()
            for kind, values in (("offsets", offsets), ("docs", kept)):
                with store.create(f"{made}.{kind}") as out:
                    out.write(np.array(values, "<i8").tobytes())
            name = f"part-{at:06d}"
            for kind in ("ids", "offsets", "docs"):
                store.rename(f"{made}.{kind}", f"{name}.{kind}")
            done.append({"shard": name, "first_id": kept[0], "documents": len(kept), "tokens": offsets[-1]})

        for batch in batches:
            docs, texts, places = (c.to_pylist() for c in batch.columns)
            for doc, place, ids in zip(docs, places, ids_of.encode(texts), strict=True):
                if place != at:
                    if at is not None:
                        close()
                    at, made, kept, offsets = place, f"_part-{place:06d}.{uuid.uuid4().hex}", [], [0]
                    begun = store.create(f"{made}.ids")
                begun.write((one := with_end(ids)).astype(dtype).tobytes())
                kept.append(doc)
                offsets.append(offsets[-1] + len(one))
        if at is not None:
            close()
            yield pa.RecordBatch.from_pylist(done)

    rows = known.select("doc_id", "text", "part").mapInArrow(write, _MANIFEST).collect()
    shards, base = sorted((r.asDict() for r in rows), key=lambda r: r["shard"]), 0
    for shard in shards:
        shard |= {"base": base, "dtype": dtype}
        base += shard["tokens"]
    Store(path).write_json("manifest.json", {"dtype": dtype, "documents": sum(s["documents"] for s in shards), "tokens": base, "shards": shards})
    return shards


def read_ids(spark: SparkSession, path: str, shards: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the mapped files."""

    def read(batches):
        import pyarrow as pa

        store = Store(path)
        for batch in batches:
            for shard in batch.to_pylist():
                ids, offsets, docs = (store.array(f"{shard['shard']}.{k}", t) for k, t in (("ids", shard["dtype"]), ("offsets", "<i8"), ("docs", "<i8")))
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs), pa.array(offsets[:-1] + shard["base"]), pa.array(offsets[1:] - offsets[:-1]), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], kinds)
    listed = spark.createDataFrame([(s["shard"], s["base"], s["dtype"]) for s in shards], "shard string, base long, dtype string")
    return listed.repartitionByRange(len(shards), "base").mapInArrow(read, kinds)


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "token-ids")
    return read_ids(spark, path, write_ids(table(spark, sf_dir, "documents"), path, default_vocabulary()))


SQL: dict[str, str] = {}
