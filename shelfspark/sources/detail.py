"""Detail and access answers of a record, and their merge with its card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import after, between, keyword_list, place_part, plain, strip_html, title_tr, unescaped
from .records import canonical

#: Fixed values of the format: fields of the detail object, the record types with the words that name them in a reference,
#: the mark of a record's number in a reference, of the link to its content and of the message in place of one.
FIELDS = ("danisman", "yer", "trOzet", "enOzet", "anahtarKelimeTr", "anahtarKelimeEn", "apa_ref", "ieee_ref", "mla_ref", "chicago_ref", "harvard_ref")
TYPES = ("Yüksek Lisans", "Doktora", "Tıpta Uzmanlık", "Sanatta Yeterlik", "Diş Hekimliği Uzmanlık", "Tıpta Yan Dal Uzmanlık", "Eczacılıkta Uzmanlık")
NUMBER, CONTENT, MESSAGE = "(Tez No.", "TezGoster?key=", "pdf-info-msg"


def _turned(name: Column) -> Column:
    """"SURNAME, X." as "X. SURNAME"."""
    parts = F.split(name, ",", 2)
    return F.nullif(F.trim(F.concat_ws(" ", F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit("")), F.trim(F.get(parts, F.lit(0))))), F.lit(""))


def apa_reference(c: Column) -> Column:
    """struct(author, year, title, public_no, record_type) of an APA reference, each null where its part is missing.

    The year is the first bracket of four digits, the author what precedes it ("SURNAME, X." turned round), the title the
    first part in italics, and after it stand the number and, in the last square bracket, the type up to a comma: a known
    type by its name, whatever its case, another one without its last word and in title case.
    """
    bracket = F.nullif(F.regexp_extract(c, r"\([0-9]{4}\)", 0), F.lit(""))
    title = F.nullif(F.trim(F.regexp_replace(unescaped(between(c, "<i>", "</i>")), r"(?U)\s+", " ")), F.lit(""))
    tail = F.coalesce(after(c, "</i>"), c)
    last = F.when(F.contains(tail, F.lit("[")), F.substring_index(tail, "[", -1))
    named = F.when(F.contains(last, F.lit("]")), F.nullif(F.trim(F.substring_index(F.substring_index(last, "]", 1), ",", 1)), F.lit("")))
    known = F.create_map(*[F.lit(x) for t in TYPES for x in (_plain_type(t), t)])
    other = F.nullif(title_tr(F.trim(F.when(F.endswith(plain(named), F.lit(" tezi")), F.substr(named, F.lit(1), F.length(named) - 5)).otherwise(named))), F.lit(""))
    return F.struct(
        _turned(F.when(bracket.isNotNull(), F.trim(F.split_part(c, bracket, F.lit(1))))).alias("author"), F.substring(bracket, 2, 4).cast("int").alias("year"), title.alias("title"),
        between(tail, NUMBER, ")").alias("public_no"), F.when(named.isNotNull(), F.coalesce(F.try_element_at(known, plain(named)), other)).alias("record_type"))


def _plain_type(label: str) -> str:
    from ..functions.text import plain_text

    return f"{plain_text(label)} tezi"


def labelled(c: Column) -> Column:
    """What follows a bold label, without tags; empty is null."""
    return F.nullif(strip_html(F.regexp_replace(c, r"(?s)<strong[^>]*>.*?</strong>", "")), F.lit(""))


def details(answers: DataFrame, key: str = "record_id", body: str = "body") -> DataFrame:
    """(key, fields of a record, citations) of each detail answer (a JSON object, blank lines before it allowed)."""
    d = F.from_json(F.trim(F.regexp_replace(body, r"^\s+", "")), ", ".join(f"{f} string" for f in FIELDS))
    rows = answers.select(key, d.alias("d")).withColumn("apa", apa_reference(F.col("d.apa_ref")))
    empty = lambda f: F.nullif(F.col(f"d.{f}"), F.lit(""))
    keys = lambda f: keyword_list(F.col(f"d.{f}"))
    return rows.select(
        key, "apa.author", "apa.year", "apa.title", "apa.public_no", "apa.record_type", labelled(F.col("d.danisman")).alias("advisor"),
        *[place_part(F.col("d.yer"), i).alias(c) for i, c in enumerate(("institution", "institute", "department", "branch"))],
        empty("trOzet").alias("abstract"), empty("enOzet").alias("abstract_alt"), keys("anahtarKelimeTr").alias("keywords"), keys("anahtarKelimeEn").alias("keywords_alt"),
        F.struct(*[F.col(f"d.{k}_ref").alias(k) for k in ("apa", "ieee", "mla", "chicago", "harvard")]).alias("citations"))


def access(c: Column) -> Column:
    """struct(status, reason, content_key) of an access fragment: a content link is open, a message restricted, else unknown.

    The key ends with the link's quote, a further parameter or a blank; the message is the element of its class.
    """
    key = F.nullif(F.regexp_extract(after(c, CONTENT), r"""^[^'"&\s]*""", 0), F.lit(""))
    message = after(F.coalesce(after(c, f"'{MESSAGE}'"), after(c, f'"{MESSAGE}"')), ">")
    told = F.when(F.contains(message, F.lit("</span>")), strip_html(F.substring_index(message, "</span>", 1)))
    status = F.when(key.isNotNull(), "open").when(told.isNotNull(), "restricted").otherwise("unknown")
    return F.struct(status.alias("status"), F.when(key.isNull(), told).alias("reason"), key.alias("content_key"))


def merged_records(detail: DataFrame, fragments: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """Full records of details() rows, access fragments (record_id, fragment) and, where there are any, cards.

    A card's value goes before what the citation tells, but the detail's institution before the card's. A record without
    a fragment has unknown access.
    """
    told = fragments.select("record_id", access(F.col("fragment")).alias("_a"))
    out = detail.join(told, "record_id", "left")
    shown = [c for c in ("detail_key", "public_no", "title", "title_alt", "author", "year", "record_type", "institution") if cards is not None and c in cards.columns]
    if cards is not None:
        out = out.join(cards.select("record_id", *[F.col(c).alias(f"_c_{c}") for c in shown]), "record_id", "left")
    first = {c: F.coalesce(*[F.col(x) for x in ((c, f"_c_{c}") if c == "institution" else (f"_c_{c}", c)) if x.startswith("_c_") or x in detail.columns]) for c in shown}
    out = out.withColumns(first | {"access_status": F.coalesce("_a.status", F.lit("unknown")), "access_reason": F.col("_a.reason"), "content_key": F.col("_a.content_key")})
    return canonical(out)
