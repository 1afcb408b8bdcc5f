"""Dictionaries: code tables, institutions and departments; their reading, search, look-up and writing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import plain, plain_text
from .store import staged

#: The six code tables of the search form.
CODES = {
    "Tur": {1: "Yüksek Lisans", 2: "Doktora", 3: "Tıpta Uzmanlık", 4: "Sanatta Yeterlik", 5: "Diş Hekimliği Uzmanlık", 6: "Tıpta Yan Dal Uzmanlık", 7: "Eczacılıkta Uzmanlık"},
    "izin": {0: "Seçiniz", 1: "İzinli", 2: "İzinsiz"},
    "Durum": {0: "Tümü", 1: "Hazırlanıyor", 3: "Onaylandı"},
    "Dil": {1: "Türkçe", 2: "İngilizce", 3: "Arapça", 4: "Fransızca", 5: "Almanca", 6: "İspanyolca", 7: "İtalyanca", 8: "Rusça", 9: "Japonca", 10: "Çince", 11: "Farsça", 12: "Kürtçe", 13: "Azerbaycanca", 14: "Osmanlıca"},
    "nevi": {1: "Tez Adı", 2: "Yazar", 3: "Danışman", 4: "Konu", 5: "Anahtar Kelime", 6: "Özet", 7: "Tümü"},
    "tip": {1: "exact", 2: "contains"},
}
ITEMS = 200
#: Letters of the runs by which names are found, and codes that a plan holds as a literal at most.
GRAM, MOST_CODES = 3, 1000
#: Runs that are broadcast at most, to leave out the entries' other runs; more are joined by a shuffle.
BROADCAST_GRAMS = 1 << 18


def code_table(spark: SparkSession) -> DataFrame:
    """(kind, code, label) of every code."""
    return spark.createDataFrame([(k, c, x) for k, t in CODES.items() for c, x in t.items()], "kind string, code int, label string")


def departments(pages: DataFrame, html: str = "html") -> DataFrame:
    """(code, name) of each option of department lists, whatever the order of the attributes; other inputs are passed over."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?s)(<label\s+class="option-item">.*?</label>)"""), F.lit(1))
    tag = F.regexp_extract("b", r"(?is)(<input\b[^>]*>)", 1)
    rows = pages.select(F.explode(blocks).alias("b")).select(F.regexp_extract(tag, r'(?i)\bkod="(\d+)"', 1).alias("code"), F.regexp_extract(tag, r'(?i)\bad="([^"]+)"', 1).alias("name"))
    return rows.where("code <> '' and name <> ''")


def institutions(answers: DataFrame, body: str = "body") -> DataFrame:
    """(code, name, second_code) of institution lists, each a JSON array; empty answers have none."""
    rows = F.from_json(F.trim(F.regexp_replace(body, r"^\s+", "")), "array<struct<kod: string, displayName: string, yoksisId: string>>")
    return answers.select(F.inline(rows)).toDF("code", "name", "second_code")


def appended(first: DataFrame, more: DataFrame, key: str = "code") -> DataFrame:
    """`first` and the rows of `more` whose key is new."""
    return first.unionByName(more.join(first.select(key).distinct(), key, "left_anti").select(first.columns))


def found(rows: DataFrame, query: str, name: str = "name") -> DataFrame:
    """Rows whose name holds the query without case and accents; an empty query finds nothing."""
    return rows.where(F.contains(plain(F.col(name)), F.lit(plain_text(query)))) if query else rows.limit(0)


def _grams(c: Column, size: Column) -> Column:
    """The different runs of `size` letters of a text, none of a shorter one."""
    n = F.length(c) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(c, i, size))))


def name_matches(entries: DataFrame, wanted: DataFrame, name: str = "name", label: str = "label", order: Sequence[str] = ("name", "code")) -> DataFrame:
    """The rows of `wanted` with the number of entries whose name holds their label without case and accents (matches), and
    the first of these entries (entry, a struct of all its columns, null if there is none): one that is the label, else by `order`.

    Whatever holds a label holds each run of three letters in it (of as many as it has, if it is shorter). So every label
    meets only the entries with its rarest run, and these are tested; rarest by the number of entries, none where an entry
    lacks it. Equal labels are looked up once. A null or empty label has no match; of repeated entries each one counts.
    The entries' runs are many times the entries, which a plan's estimate doesn't know, so they are never broadcast.
    """
    needles = wanted.select(plain(F.col(label)).alias("_label")).where("_label <> ''").distinct().withColumn("_size", F.least(F.length("_label"), F.lit(GRAM)))
    sizes = [r["_size"] for r in needles.select("_size").distinct().collect()]  # GRAM rows at most
    held = entries.select(F.struct(*entries.columns).alias("_entry"), plain(F.col(name)).alias("_name"))
    every = F.flatten(F.filter(F.array(*[_grams(F.col("_name"), F.lit(n)) for n in sizes or [GRAM]]), lambda x: x.isNotNull()))
    held = held.withColumn("_gram", F.explode(every))
    parts = needles.select("_label", F.explode(_grams(F.col("_label"), F.col("_size"))).alias("_gram"))
    counts = held.groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = parts.join(counts.hint("merge"), "_gram", "left").groupBy("_label").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_r"))
    rarest = staged(rarest.where("_r.n > 0").select("_label", F.col("_r.gram").alias("_gram")), "rarest")
    grams = rarest.select("_gram").distinct()
    held = held.join(F.broadcast(grams) if grams.count() <= BROADCAST_GRAMS else grams.hint("merge"), "_gram", "left_semi")
    found = rarest.join(held.hint("merge"), "_gram").where(F.contains("_name", F.col("_label")))
    first = F.min(F.struct((F.col("_name") != F.col("_label")).alias("other"), *[F.col(f"_entry.{c}").alias(f"o{i}") for i, c in enumerate(order)], F.col("_entry").alias("entry")))
    best = found.groupBy("_label").agg(F.count("*").alias("matches"), first.alias("_f")).select("_label", "matches", F.col("_f.entry").alias("entry"))
    out = wanted.withColumn("_label", plain(F.col(label))).join(best, "_label", "left")
    return out.select(*[wanted[c] for c in wanted.columns], F.coalesce("matches", F.lit(0)).alias("matches"), "entry")


def code_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(label, code) for wanted (label): of codes (code, label) the exact one, else the first that holds the text, else "0".

    A table of up to MOST_CODES codes becomes a literal of the plan, so no row is paired with all codes; a larger one is
    joined by name_matches().
    """
    some = rows.select("code", "label").limit(MOST_CODES + 1).collect()
    if len(some) > MOST_CODES:
        found = name_matches(rows.select("code", F.col("label").alias("name")), wanted.select("label"), order=("code",))
        return found.select("label", F.coalesce(F.col("entry.code").cast("string"), F.lit("0")).alias("code"))
    sought = plain(F.col("label"))
    codes = F.array(*[F.struct(F.lit(str(r["code"])).alias("code"), F.lit(plain_text(r["label"])).alias("label")) for r in sorted(some, key=lambda r: r["code"])])
    exact, holding = F.filter(codes, lambda c: c["label"] == sought), F.filter(codes, lambda c: F.contains(c["label"], sought))
    code = F.coalesce(F.get(exact, F.lit(0))["code"], F.get(holding, F.lit(0))["code"], F.lit("0"))
    return wanted.select("label", F.when(sought == "", F.lit("0")).otherwise(code).alias("code"))


def first_match(rows: DataFrame, query: str, name: str = "name", order: str = "name") -> DataFrame:
    """(matches, and the row's columns) of the first row whose name holds the query; no row if none does."""
    hits = found(rows, query, name)
    return hits.agg(F.count("*").alias("matches"), F.min(F.struct(order, *[c for c in rows.columns if c != order])).alias("_r")).where("matches > 0").select("matches", *[F.col(f"_r.{c}").alias(c) for c in rows.columns])


def listed(rows: DataFrame, query: str | None = None, name: str = "name", most: int = ITEMS) -> tuple[DataFrame, DataFrame]:
    """(the first `most` items by name, a row with the count of all) of a dictionary, searched if there is a query."""
    rows = rows if query is None else found(rows, query, name)
    return rows.orderBy(name, *[c for c in rows.columns if c != name]).limit(most), rows.agg(F.count("*").alias("count"))


def write_dictionary(path: str, codes: DataFrame, institutions: DataFrame, departments: DataFrame, built_at: str) -> None:
    """One JSON document a table below `path`."""
    for kind, rows in (("codes", codes), ("institutions", institutions), ("departments", departments)):
        rows.withColumn("built_at", F.lit(built_at)).coalesce(1).write.mode("overwrite").json(f"{path}/{kind}")


def read_dictionary(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that write_dictionary() left."""
    kinds = {"codes": "kind string, code int, label string", "institutions": "code string, name string, second_code string", "departments": "code string, name string"}
    return {k: spark.read.schema(f"{s}, built_at string").json(f"{path}/{k}") for k, s in kinds.items()}
