"""Extraction from pages and JSON properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import spaced_html


def page_records(pages: DataFrame) -> DataFrame:
    """(page_id, title, links, text_chars) of page markup; scripts and styles are not text."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " ")
    title = F.nullif(spaced_html(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)), F.lit(""))
    return pages.select("page_id", title.alias("title"), F.size(F.regexp_extract_all("html", F.lit('(href="[^"]*")'), F.lit(1))).cast("long").alias("links"), F.length(spaced_html(bare)).cast("long").alias("text_chars"))


def page_links(pages: DataFrame) -> DataFrame:
    """One row per link of a page."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))


def json_property(events: DataFrame, key: str = "k") -> DataFrame:
    return events.select("event_id", F.get_json_object("props", f"$.{key}").try_cast("bigint").alias("value"))
