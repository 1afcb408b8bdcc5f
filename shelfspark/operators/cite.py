"""Citations in eight formats as column expressions over author, title, year, type, school, number and url."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TURKISH, ascii_folded, clean

#: Who keeps the collection; a neutral value that callers may replace.
PUBLISHER = "National Thesis Centre"
#: Record types with their labels; all but the first are doctoral.
LABELS = {
    "Yüksek Lisans": "Yüksek lisans tezi", "Doktora": "Doktora tezi", "Tıpta Uzmanlık": "Tıpta uzmanlık tezi", "Sanatta Yeterlik": "Sanatta yeterlik tezi",
    "Diş Hekimliği Uzmanlık": "Diş hekimliği uzmanlık tezi", "Tıpta Yan Dal Uzmanlık": "Tıpta yan dal uzmanlık tezi", "Eczacılıkta Uzmanlık": "Eczacılıkta uzmanlık tezi",
}
DOCTORAL = tuple(LABELS)[1:]
NO_LABEL, LABEL_SUFFIX, NUMBER, NO_DATE = "Tez", " tezi", "Tez No", "n.d."
STYLES = ("apa", "mla", "ieee", "chicago", "harvard")
FORMATS = (*STYLES, "bibtex", "ris", "csl_json")
FIELDS = ("author", "title", "year", "record_type", "institution", "public_no", "url")


def family(author: Column) -> Column:
    """The last word of a name."""
    return F.nullif(F.element_at(F.split(F.trim(author), r"\s+"), -1), F.lit(""))


def given(author: Column) -> Column:
    """What precedes the last word of a name, null if nothing does."""
    words = F.split(F.trim(author), r"\s+")
    return F.nullif(F.array_join(F.slice(words, 1, F.size(words) - 1), " "), F.lit(""))


def initials(author: Column) -> Column:
    """Initials of the given names, of hyphenated ones with their hyphen."""
    word = lambda w: F.array_join(F.transform(F.filter(F.split(w, "-"), lambda p: p != ""), lambda p: F.concat(F.substring(p, 1, 1), F.lit("."))), "-")
    return F.nullif(F.array_join(F.filter(F.transform(F.split(given(author), r"\s+"), word), lambda w: w != ""), " "), F.lit(""))


def label(record_type: Column) -> Column:
    """What a type is called in a citation."""
    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.when(record_type.isNull(), NO_LABEL).otherwise(F.coalesce(F.try_element_at(known, record_type), F.concat(record_type, F.lit(LABEL_SUFFIX))))


def is_doctoral(record_type: Column) -> Column:
    return F.coalesce(record_type.isin(*DOCTORAL), F.lit(False))


def bibtex_key(author: Column, year: Column) -> Column:
    """The author's family name in ASCII letters and the year; what is missing drops out, without both "thesis"."""
    turkish = F.translate(family(author), TURKISH, "iIIsSgGuUoOcC")  # ASCII letters, in their case
    base = F.regexp_replace(F.lower(ascii_folded(turkish)), "[^a-z0-9]", "")
    named = F.coalesce(base, F.lit(""))
    return F.when(author.isNull(), F.when(year.isNull(), "thesis").otherwise(F.concat(F.lit("thesis"), year))).when(named == "", F.coalesce(year, F.lit("thesis"))).otherwise(F.concat(named, F.coalesce(year, F.lit(""))))


def _join(sep: str, *parts: Column) -> Column:
    return F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts])


def formats(author: Column, title: Column, year: Column, record_type: Column, school: Column, number: Column, url: Column, publisher: str = PUBLISHER) -> dict[str, Column]:
    """A column for each format of cleaned fields; missing parts drop out with their punctuation."""
    y, kind, lit = year.cast("string"), label(record_type), F.lit
    bare = F.nullif(F.regexp_replace(title, r"\.+$", ""), lit(""))
    last_first, short = _join(", ", family(author), given(author)), _join(", ", family(author), initials(author))
    there = author.isNotNull()
    then = lambda c, *parts: F.when(c.isNotNull(), F.concat(*[lit(p) if isinstance(p, str) else p for p in parts]))
    end = lambda c: then(F.nullif(c, lit("")), c, ".")
    dated, tail = F.coalesce(y, lit(NO_DATE)), F.concat(_join(", ", kind, school, y), lit("."))
    called = F.when(there, _join(" ", initials(author), family(author)))
    escaped = lambda v: F.replace(F.replace(F.replace(v, lit("\\"), lit("\\textbackslash{}")), lit("{"), lit("\\{")), lit("}"), lit("\\}"))
    brace = lambda k, v: then(v, f"  {k} = {{", escaped(v), "}")
    tag = lambda k, v: then(v, f"{k}  - ", v)
    name = F.when(there, last_first)
    entry = F.when(is_doctoral(record_type), "@phdthesis{").otherwise("@mastersthesis{")

    def csl(issued: Column) -> Column:
        who = F.when(there, F.array(F.struct(given(author).alias("given"), family(author).alias("family"))))
        return F.to_json(F.struct(lit("thesis").alias("type"), title.alias("title"), who.alias("author"), F.when(y.isNotNull(), F.struct(F.array(F.array(issued)).alias("date-parts"))).alias("issued"), record_type.alias("genre"),
                                  lit(publisher).alias("publisher"), school.alias("publisher-place"), lit(publisher).alias("archive"), url.alias("URL")))

    return {
        "apa": _join(" ", then(name, F.regexp_replace(short, r"\.+$", ""), "."), F.concat(lit("("), dated, lit(").")), then(bare, "*", bare, "*"), then(number, f"({NUMBER}. ", number, ")"), F.concat(lit("["), _join(", ", kind, school), lit("].")), lit(f"{publisher}.")),
        "mla": _join(" ", then(name, last_first, "."), then(bare, "*", bare, "*."), end(_join(", ", school, y)), end(kind), lit(f"{publisher}.")),
        "ieee": _join(" ", then(called, called, ","), then(bare, '"', bare, ',"'), tail),
        "chicago": _join(" ", then(name, last_first, "."), then(bare, '"', bare, '."'), tail),
        "harvard": _join(" ", F.when(there, short), F.concat(lit("("), dated, lit(")")), then(bare, "*", bare, "*."), end(kind), end(school), lit(f"{publisher}.")),
        "bibtex": F.concat(entry, bibtex_key(author, y), lit(",\n"), F.concat_ws(",\n", brace("author", name), brace("title", title), brace("school", school), brace("year", y), brace("type", record_type), brace("note", lit(publisher)), brace("url", url)), lit("\n}")),
        "ris": F.concat(F.concat_ws("\n", lit("TY  - THES"), tag("AU", name), tag("T1", title), tag("PY", y), tag("PB", school), then(number, f"U1  - {NUMBER}: ", number), tag("M3", record_type), tag("DB", lit(publisher)), tag("UR", url)), lit("\nER  - \n")),
        "csl_json": F.when(y.try_cast("int").isNotNull(), csl(y.try_cast("int"))).otherwise(csl(y)),
    }


def cited(rows: DataFrame, fields: Mapping[str, Column], styles: tuple[str, ...] = FORMATS, publisher: str = PUBLISHER) -> DataFrame:
    """`rows` with a column for each wanted format; fields: expressions of FIELDS, those left out are missing.

    Fields are cleaned once (entities decoded, blanks squeezed, empty is null) before any format uses them.
    """
    for s in styles:
        if s not in FORMATS:
            raise ValueError(f"unknown style {s}; known: {', '.join(FORMATS)}")
    own = {f"_{f}": clean(fields[f].cast("string")) if f in fields else F.lit(None).cast("string") for f in FIELDS}
    out = rows.withColumns(own)
    made = formats(*[F.col(f"_{f}") for f in FIELDS], publisher=publisher)
    return out.withColumns({s: made[s] for s in styles}).drop(*own)


def citation(rows: DataFrame, fields: Mapping[str, Column], style: str, publisher: str = PUBLISHER) -> DataFrame:
    """`rows` with `citation` in one style, named in any case; an unknown style is an error."""
    name = (style or "").strip().lower()
    if name not in STYLES:
        raise ValueError(f"unknown style {style!r}; known: {', '.join(STYLES)}")
    return cited(rows, fields, (name,), publisher).withColumnRenamed(name, "citation")


def fields_of_record() -> dict[str, Column]:
    """The fields of a canonical record: the main title, else the other one."""
    return {"author": F.col("author"), "title": F.coalesce("title", "title_alt"), "year": F.col("year"), "record_type": F.col("record_type"), "institution": F.col("institution"), "public_no": F.col("public_no"),
            "url": F.when(F.col("content_key").isNotNull(), F.concat(F.lit("TezGoster?key="), "content_key"))}
