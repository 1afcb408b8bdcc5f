"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, is_small, let, looked_up, possible, small_side, table, text_key, words_of

WIDTH, THRESHOLD = 5, 0.8


def _hashes(words: Column, coded: Column, width: int) -> Column:
    """64-bit hashes of the word shingles in their order, over word codes; fewer words than the width are one shingle."""
    at = lambda i: F.xxhash64(*[F.get(coded, i + k) for k in range(width)])
    many = F.transform(F.sequence(F.lit(0), F.size(coded) - width), at)
    return F.when(F.size(coded) == 0, F.array().cast("array<bigint>")).when(F.size(coded) < width, F.array(F.xxhash64(coded))).otherwise(many)


def shingled(rows: DataFrame, key: str, width: int = WIDTH, *also: str) -> DataFrame:
    """(key, the columns also named, _w words, _h hashes in order) of the column text."""
    coded = lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda c: F.struct(w.alias("w"), _hashes(w, c, width).alias("h")))
    return rows.select(key, *also, let(words_of(F.col("text")), coded).alias("_s")).select(key, *also, F.col("_s.w").alias("_w"), F.col("_s.h").alias("_h"))


def _semi(known: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of `known` that are in `held` (doc_id, text_md5)."""
    if is_small(held, 40):
        return known.join(F.broadcast(held), ["doc_id", "text_md5"], "left_semi")
    return possible(known, "text_md5", held.select("text_md5")).join(held, ["doc_id", "text_md5"], "left_semi")


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, keyed: bool = False) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) of every document that holds an item.

    docs: doc_id, text; items: item_id, text; other columns are not read. Words are lower-case runs of letters and
    digits, shingles `width` of them, and an item is held when at least `threshold` of its distinct shingles stand in
    the document. An item of fewer words is one shingle, held where its words follow each other. Null and empty texts
    hold nothing and are held by nothing; rows without an id are not reported; repeated rows are reported once, other
    texts of the same doc_id on their own (keyed: with their text_md5, binary); texts that share an item_id are one item
    with the shingles of all; empty tables give no rows.

    Items fall into classes by the power of two of their size. An item's sketch is the `k` smallest hashes of its
    set (bottom-k MinHash), with k = s - ceil(threshold * s) + 1 for the largest size s of the class: a document
    that holds the item has to hold at least one of these, so nothing is missed. Documents with fewer shingles than
    a class needs are not compared. Sketches are broadcast within a bound; beyond it a bit map of their hashes keeps
    all but the possible shingles from the shuffle. Only documents with a hit are read again; they are compared
    shingle text by shingle text.
    """
    size, said = F.size("_d"), lambda words, i, n: F.array_join(F.slice(words, i + 1, n), " ")
    item = cut(shingled(items.select("item_id", "text").where("item_id is not null").distinct(), "item_id", width).where(F.size("_w") > 0), "item-words")
    known = docs.where("doc_id is not null").select("doc_id", text_key(F.col("text")).alias("text_md5"), "text")
    columns = ["doc_id", "item_id", "item_shingles", "shared", "containment", *(["text_md5"] if keyed else [])]

    long = item.where(F.size("_w") >= width)
    sets = long.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_h")))).alias("_d"))
    sets = sets.withColumn("_top", F.pow(F.lit(2.0), F.floor(F.log2(size.cast("double"))) + 1).cast("int") - 1)
    need = F.lit(1.0 - threshold) * F.col("_top")
    sets = sets.withColumn("_k", F.floor(need + F.lit(1e-9)).cast("int") + 1).withColumn("_least", F.ceil(F.lit(threshold) * F.shiftright(F.col("_top") + 1, 1) - F.lit(1e-9)).cast("int"))
    sketch = cut(sets.select("item_id", "_least", F.explode(F.slice("_d", F.lit(1), F.col("_k"))).alias("_x")), "sketches")
    probe = shingled(known, "doc_id", width, "text_md5").select("doc_id", "text_md5", F.size("_h").alias("_n"), F.explode_outer("_h").alias("_x"))
    hits = looked_up(probe, "_x", sketch, 32).where("_n >= _least").select("doc_id", "text_md5", "item_id").distinct()
    hits = cut(hits, "hits")

    held = cut(hits.select("doc_id", "text_md5").distinct(), "held")
    again = shingled(_semi(known, held), "doc_id", width, "text_md5")
    full = long.select("item_id", "_w", F.posexplode("_h").alias("_i", "_x")).select("item_id", "_x", said(F.col("_w"), F.col("_i"), width).alias("_s")).distinct()
    sizes = full.groupBy("item_id").agg(F.countDistinct("_s").alias("item_shingles"))
    full = small_side(cut(full, "shingles"), 160)
    there = again.select("doc_id", "text_md5", "_w", F.posexplode_outer("_h").alias("_i", "_y"))
    there = there.join(full, (F.col("_y") == F.col("_x")) & (said(F.col("_w"), F.col("_i"), width) == F.col("_s"))).select("doc_id", "text_md5", "item_id", "_s")
    found = there.groupBy("doc_id", "text_md5", "item_id").agg(F.countDistinct("_s").alias("shared"))
    found = found.join(hits, ["doc_id", "text_md5", "item_id"], "left_semi").join(small_side(sizes, 24), "item_id")
    ratio = F.col("shared") / F.col("item_shingles")
    found = found.where(ratio >= threshold).withColumn("containment", ratio).select(columns)

    lengths = sorted(r[0] for r in item.where(F.size("_w") < width).select(F.size("_w")).distinct().collect())  # below the width
    if not lengths:
        return found
    short = item.where(F.size("_w") < width).select("item_id", F.array_join("_w", " ").alias("_x")).join(sets.select("item_id"), "item_id", "left_anti").distinct()
    run = lambda w, n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: said(w, i, n))).otherwise(F.array().cast("array<string>"))
    runs = lambda w: F.flatten(F.array(*[run(w, n) for n in lengths]))
    spoken = known.select("doc_id", "text_md5", F.explode(F.array_distinct(let(words_of(F.col("text")), runs))).alias("_x"))
    both = looked_up(spoken, "_x", cut(short, "short"), 64).groupBy("doc_id", "text_md5", "item_id").agg(F.countDistinct("_x").alias("shared"))
    counts = short.groupBy("item_id").agg(F.count("*").alias("item_shingles"))
    both = both.join(small_side(counts, 24), "item_id").where(ratio >= threshold).withColumn("containment", ratio)
    return found.unionByName(both.select(columns))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_CUT = """SELECT {key}, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS s
    FROM (SELECT {key}, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {table})"""

SQL = {
    "op1_decontaminate": f"""
        WITH d AS (SELECT DISTINCT doc_id, unnest(s) AS s FROM ({_CUT.format(key="doc_id", table="documents")})),
             b AS (SELECT DISTINCT item_id, unnest(s) AS s FROM ({_CUT.format(key="item_id", table="benchmark")})),
             n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id)
        SELECT doc_id, item_id, item_shingles, count(*) AS shared, count(*) / item_shingles AS containment
        FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, item_shingles
        HAVING count(*) / item_shingles >= 0.8"""
}
