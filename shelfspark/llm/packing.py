"""Packing: first-fit decreasing by a tournament tree of free room, in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, cut, table
from .tokens import default_vocabulary, encoder, with_end

#: Ids of a sequence, documents of a group, its ids at most (about), and the sequences of one document that stay together.
CAPACITY, GROUP_DOCS, GROUP_IDS, RUN = 2048, 4000, 4_000_000, 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Room:
    """Bins in a tournament tree: every node has the most free room below it, so the first bin that fits is found from the root."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> tuple[int, int]:
        """(bin, room it had) of the first bin with room for `size`, which is taken."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            node += free[node] < size
        had = free[node]
        free[node] = had - size
        place = node - self.leaves
        while node := node >> 1:
            free[node] = max(free[2 * node], free[2 * node + 1])
        return place, had


def first_fit_decreasing(sizes: Iterable[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size, in their order; the largest are placed first, ties in the order given."""
    sizes = list(sizes)
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    if sizes:
        room = Room(len(sizes), capacity)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            place, had = room.take(sizes[i])
            out[i] = (place, capacity - had)
    return out


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most `capacity` ids of docs (doc_id, text, _p), cut at multiples of it; the last one is the rest."""
    arrow_batches(docs.sparkSession)

    def pieces(batches):
        import pyarrow as pa

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_p"]
        for batch in batches:
            rows = []
            docs, texts, places = (c.to_pylist() for c in batch.columns)
            for doc, place, ids in zip(docs, places, encoder(vocabulary).encode(texts), strict=True):
                ids = with_end(ids)
                rows += [(doc, i, min(capacity, len(ids) - i), zlib.crc32(ids[i : i + capacity].tobytes()), len(ids), place) for i in range(0, len(ids), capacity)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 6, names)

    return docs.select("doc_id", "text", "_p").mapInArrow(pieces, f"{PIECES}, _p long")


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, group_ids: int = GROUP_IDS, seed: int = 11) -> DataFrame:
    """One row per piece of docs (doc_id, text): where it comes from and where it lies (sequence_id, offset).

    Documents get ids and an end id, so a null or empty text is the end id alone; every id lies in exactly one
    piece. Groups are drawn by a hash of a row's place in the table and take about `group_docs` documents at any size
    of it, or `group_ids` ids, if documents are long; of a long one RUN sequences stay together, so it is spread over
    groups too. Sequences are filled inside a group and numbered group * 2**32 + bin. Pieces of a group meet in one task: a group is bounded by its ids, never by a key of
    the data, so a repeated doc_id and equal texts without one are spread as well. Repeated rows are packed like others,
    rows without doc_id too; an empty table gives no rows.
    """
    made = cut(token_pieces(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_p")), vocabulary, capacity), "pieces")
    rows, ids = made.agg(F.count_if(F.col("start") == 0), F.coalesce(F.sum("length"), F.lit(0))).first()
    groups, run = max(1, round(max(rows / group_docs, ids / group_ids))), F.floor(F.col("start") / (capacity * RUN))
    grouped = made.withColumn("_g", F.pmod(F.xxhash64("_p", run, F.lit(seed)), F.lit(groups))).drop("_p")

    def pack(pdf):
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        placed = first_fit_decreasing(pdf["length"].tolist(), capacity)
        first = int(pdf["_g"].iloc[0]) << 32
        return pdf.drop(columns="_g").assign(sequence_id=[first + b for b, _ in placed], offset=[at for _, at in placed])

    return grouped.groupBy("_g").applyInPandas(pack, PACKED)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), default_vocabulary())


SQL: dict[str, str] = {}
