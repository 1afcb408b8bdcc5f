"""The corpus pipeline: five stages over documents, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import decontaminate, exactdedup, ngramjoin, packing, toxicity
from shelfspark.llm.common import cut, discard, table, text_key, without
from shelfspark.llm.tokens import default_vocabulary


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs` without the rows of `gone` (doc_id, text_md5): a repeated doc_id loses only the text that is named, and a
    null doc_id is a value like others. All columns of `docs` stay as they are."""
    gone = cut(gone.select("doc_id", "text_md5").distinct(), "gone")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (text_key(F.col("l.text")) == F.col("r.text_md5"))
    return without(docs, gone, same, F.xxhash64(text_key(F.col("l.text"))), F.xxhash64("r.text_md5"), 48)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; it learns from the labelled rows of `docs`.

    Null and empty texts have the score of the bias alone and stay; repeated rows are judged alike; an empty table stays
    empty.
    """
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return _without(docs, toxicity.toxicity_scores(docs, model, keyed=True).where("predicted = 1"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; a null text counts as empty."""
    return exactdedup.drop_exact(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, the one with the smallest doc_id: five-word shingles, 0.8.

    Texts without words and rows without doc_id are in no component and stay.
    """
    found = ngramjoin.jaccard_components(docs, width=5, percent=80, keyed=True)
    return _without(docs, found.where("doc_id <> component_id"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows without doc_id stay."""
    return _without(docs, decontaminate.contained_items(docs, table(spark, sf_dir, "benchmark"), keyed=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, of null and empty texts the end id alone."""
    return packing.packed(docs, default_vocabulary())


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("near_duplicates", near), ("decontamination", benchmark), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)  # the stage that read it is written
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
