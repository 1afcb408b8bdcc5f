"""Canonical records of the document and order tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a record; sources fill what they have.
COLUMNS = {
    "record_id": "string", "detail_key": "string", "public_no": "string", "title": "string", "title_alt": "string", "author": "string",
    "advisor": "string", "institution": "string", "institute": "string", "department": "string", "branch": "string", "record_type": "string",
    "year": "int", "pages": "int", "language": "string", "subjects": "array<string>", "keywords": "array<string>",
    "keywords_alt": "array<string>", "abstract": "string", "abstract_alt": "string", "access_status": "string", "access_reason": "string",
    "content_key": "string", "approval": "string",
}
#: What an answer shows of a whole record.
RECORD = (
    "record_id", "detail_key", "public_no", "title", "title_alt", "author", "advisor", "institution", "institute", "department", "branch", "record_type",
    "year", "pages", "language", "subjects", "keywords", "keywords_alt", "access_status",
)
#: What a hit shows of a record.
HIT = ("record_id", "detail_key", "public_no", "title", "title_alt", "author", "year", "institution", "record_type")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of texts, dealt to all cores if its files make fewer tasks than that: one small file would keep all others idle.

    A table of many files or row groups has more tasks and stays where it is.
    """
    rows, cores = read(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def canonical(df: DataFrame) -> DataFrame:
    """`df` with every column of a record, missing ones null, in their order."""
    return df.select(*[(F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in COLUMNS.items()])


def records(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """record_id, title, body, institution, language, year, access_status of every document, or the columns asked for.

    The title is the first line, the whole text if it has one line. Labels are read only for access_status.
    """
    texts = columns is None or {"title", "body"} & set(columns)
    d = read_texts(spark, sf_dir) if texts else read(spark, sf_dir, "documents")
    if columns is None or "access_status" in columns:
        d = d.join(read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    else:
        d = d.withColumn("toxic", F.lit(None))
    status = F.when(F.col("toxic") == 1, "restricted").when(F.col("toxic") == 0, "open").otherwise("unknown")
    out = d.select(
        F.col("doc_id").alias("record_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"),
        F.col("source").alias("institution"), F.col("lang").alias("language"), (1990 + F.col("doc_id") % 35).cast("int").alias("year"), status.alias("access_status"))
    return out if columns is None else out.select(*columns)


def bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bibliographic records, with all columns of a record: customers write, nations are institutions."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    place = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))
    code = F.col("o_orderkey").cast("string")
    return canonical(rows.select(
        code.alias("record_id"), F.concat(F.lit("k"), code).alias("detail_key"), code.alias("public_no"),
        F.concat_ws(" ", F.lit("Hâkim"), F.lower("c_mktsegment"), F.lit("of"), F.initcap("n_name")).alias("title"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("On "), F.lower("c_mktsegment"))).alias("title_alt"),
        F.col("c_name").alias("author"), F.concat(F.lit("Prof. Dr. "), F.initcap("n_name"), F.lit(" "), "c_mktsegment").alias("advisor"),
        F.concat(F.col("n_name"), F.lit(" ÜNİVERSİTESİ")).alias("institution"), F.col("c_mktsegment").alias("department"),
        F.element_at(F.split("o_orderpriority", "-"), 2).alias("record_type"), F.when(F.col("o_orderkey") % 50 != 0, F.year("o_orderdate")).alias("year"),
        F.col("o_orderstatus").alias("language"), F.array(F.lower("r_name")).alias("subjects"), F.array(F.lower("c_mktsegment"), F.lower("o_orderpriority")).alias("keywords"),
        F.when(F.col("o_orderstatus") == "F", "open").when(F.col("o_orderstatus") == "O", "restricted").otherwise("unknown").alias("access_status"),
        F.when(F.col("o_orderstatus") == "P", "Hazırlanıyor").otherwise("Onaylandı").alias("approval")))
