"""Page texts: cleaning, reliability, sections, references, windows, markdown and the access gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Letters that a readable text of the covered languages has.
EXPECTED = "a-zA-ZçğıİöşüÇĞÖŞÜàáâäãåèéêëìíîïòóôõùúûñýÿæœøÀÁÂÄÃÅÈÉÊËÌÍÎÏÒÓÔÕÙÚÛÑ"
#: Headings of sections, upper-cased without Turkish letters, and those of references.
HEADINGS = (
    "OZET", "ABSTRACT", "ICINDEKILER", "GIRIS", "INTRODUCTION", "GENEL BILGILER", "LITERATUR OZETI", "LITERATUR TARAMASI", "KAVRAMSAL CERCEVE",
    "KURAMSAL CERCEVE", "LITERATURE REVIEW", "YONTEM", "YONTEMLER", "GEREC VE YONTEM", "MATERYAL VE YONTEM", "ARASTIRMA YONTEMI", "METHOD", "METHODS",
    "METHODOLOGY", "MATERIALS AND METHODS", "MATERIAL AND METHODS", "BULGULAR", "BULGULAR VE TARTISMA", "RESULTS", "FINDINGS", "RESULTS AND DISCUSSION",
    "TARTISMA", "DISCUSSION", "SONUC", "SONUCLAR", "SONUC VE ONERILER", "ONERILER", "CONCLUSION", "CONCLUSIONS", "CONCLUSION AND RECOMMENDATIONS",
    "RECOMMENDATIONS", "KAYNAKCA", "KAYNAKLAR", "REFERANSLAR", "REFERENCES", "BIBLIOGRAPHY", "EKLER", "EK", "APPENDIX", "APPENDICES", "OZGECMIS",
    "CURRICULUM VITAE", "CV", "TESEKKUR", "ACKNOWLEDGEMENT", "ACKNOWLEDGEMENTS", "ACKNOWLEDGMENTS",
)
REFERENCES = ("KAYNAKCA", "KAYNAKLAR", "REFERANSLAR", "REFERENCES", "BIBLIOGRAPHY")
#: Fixed values of the format: the heading of what precedes the first one, of a page, and the text of an empty page.
BEFORE, PAGE, EMPTY_PAGE = "(başlık öncesi)", "## Sayfa ", "_(boş veya görüntü)_"
READABLE, SAMPLE, MOST_BYTES = 0.8, 3000, 80 << 20
_NUMBERING = r"^\s*(?:[0-9]+(?:[.)][0-9]+)*(?:[.)]\s*|\s+)|(?:[IVXLC]+|[A-Da-d])[.)]\s*)"


def cleaned(c: Column) -> Column:
    """Line ends unified, words joined over hyphenated line ends, blank lines squeezed.

    Each step reads only texts that hold what it changes.
    """
    lines = let(c, lambda t: F.when(F.contains(t, F.lit("\r")), F.regexp_replace(t, "\r\n?", "\n")).otherwise(t))
    joined = let(lines, lambda t: F.when(F.contains(t, F.lit("-\n")), F.regexp_replace(t, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")).otherwise(t))
    return F.trim(let(joined, lambda t: F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, "\n{3,}", "\n\n")).otherwise(t)))


def _solid(c: Column) -> Column:
    """Characters that are not blanks."""
    for blank in " \n\t\r\f\v":
        c = F.replace(c, F.lit(blank), F.lit(""))
    return F.length(c)


def readable_ratio(c: Column) -> Column:
    """Share of expected letters in the first 3000 letters; no letters are readable."""
    return _ratio(F.regexp_replace(c, r"\P{L}+", ""))


def _ratio(letters: Column) -> Column:
    """readable_ratio() of a text's letters."""
    good = lambda x: F.when(F.length(x) == 0, 1.0).otherwise(F.length(F.regexp_replace(x, f"[^{EXPECTED}]+", "")) / F.length(x))
    return let(F.substring(letters, 1, SAMPLE), good)


def assessed(c: Column) -> Column:
    """struct(has_text, reliable, note): the note says what is wrong with a text, null if nothing is.

    A text is searched once for blanks and once for letters.
    """

    def measured(t: Column) -> Column:
        return F.struct(_solid(t).alias("solid"), F.regexp_replace(t, r"\P{L}+", "").alias("letters"))

    def judged(m: Column) -> Column:
        some, words = F.coalesce(m["solid"] > 10, F.lit(False)), F.coalesce(F.length(m["letters"]) / F.nullif(m["solid"], F.lit(0)) >= 0.5, F.lit(False))
        return F.struct(some.alias("some"), words.alias("words"), F.coalesce(F.when(some & words, _ratio(m["letters"]) >= READABLE), F.lit(False)).alias("sound"))

    def told(j: Column) -> Column:
        some, words, sound = j["some"], j["words"], j["sound"]
        note = F.when(~some, "no text: probably scanned images").when(~words, "no words: only fragments such as page numbers").when(~sound, "unreliable: the letters are those of a broken font")
        return F.struct((some & words).alias("has_text"), (some & words & sound).alias("reliable"), note.alias("note"))

    return let(let(let(c, measured), judged), told)


def _core(line: Column) -> Column:
    """A line without numbering, upper-cased without Turkish letters."""
    bare = F.trim(F.regexp_replace(line, _NUMBERING, ""))
    return F.upper(F.translate(bare, "ıİşğüöçŞĞÜÖÇ", "iIsguocSGUOC"))


def is_heading(line: Column) -> Column:
    """A line of at most 80 characters that is a known heading, numbered or not ("2.", "1.2", "IV)", "A.")."""
    return F.length(F.trim(line)).between(1, 80) & _core(F.trim(line)).isin(*HEADINGS)


def _sectioned(lines: Column, heading: Callable[[Column], Column]) -> Column:
    """array(struct(i, heading)) of a heading at line i, the lines before the first one as i = -1."""
    marked = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.when(heading(x), F.trim(x)).alias("heading")))
    return F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit(None).cast("string").alias("heading"))), F.filter(marked, lambda m: m["heading"].isNotNull()))


def split_sections(docs: DataFrame, text: str, heading: Callable[[Column], Column] = is_heading) -> DataFrame:
    """`docs` with sections, array(struct(heading, text)): in order, empty ones dropped; no heading, no sections.

    Lines stay inside their row, so a document needs neither a window nor a shuffle, and its lines are joined once.
    """
    out = docs.withColumn("_l", F.split(F.coalesce(F.col(text), F.lit("")), "\n")).withColumn("_h", _sectioned(F.col("_l"), heading))
    end = lambda k: F.coalesce(F.get("_h", k + 1)["i"], F.size("_l"))
    body = lambda h, k: F.array_join(F.slice("_l", h["i"] + 2, end(k) - h["i"] - 1), "\n")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    parts = F.transform("_h", lambda h, k: F.struct(F.coalesce(h["heading"], F.lit(BEFORE)).alias("heading"), strip(body(h, k)).alias("text")))
    return out.withColumn("sections", F.when(F.size("_h") > 1, F.filter(parts, lambda s: s["text"] != "")).otherwise(F.filter(parts, lambda s: F.lit(False)))).drop("_l", "_h")


def sections(docs: DataFrame, key: str, text: str, heading: Callable[[Column], Column] = is_heading) -> DataFrame:
    """(key, section, heading, chars) of a text's sections; section counts the headings so far, heading tests a line.

    What precedes the first heading is section 0, empty sections are dropped. Lines stay inside their row.
    """
    rows = docs.select(key, F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("_l")).withColumn("_h", _sectioned(F.col("_l"), heading))
    rows = rows.select(key, "_l", "_h", F.posexplode("_h").alias("section", "h"))
    end = F.coalesce(F.get("_h", F.col("section") + 1)["i"], F.size("_l"))
    own = F.slice("_l", F.col("h.i") + 2, end - F.col("h.i") - 1)
    chars = F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: a + F.length(F.trim(x)))
    return rows.select(key, F.col("section").cast("bigint").alias("section"), F.col("h.heading").alias("heading"), chars.alias("chars")).where("chars > 0")


def contents(sections: Column) -> Column:
    """array(struct(heading, chars)) of sections."""
    return F.transform(sections, lambda s: F.struct(s["heading"].alias("heading"), F.length(s["text"]).alias("chars")))


def references(sections: Column) -> Column:
    """The text of the first section whose heading, numbered or not, is one of references; else null."""
    return F.get(F.filter(sections, lambda s: _core(s["heading"]).isin(*REFERENCES)), F.lit(0))["text"]


def page_window(pages: Column, start: int, most: int | None) -> Column:
    """struct(pages, start_page, end_page, has_more) of a window from page `start` (1-based), clamped to what is there."""
    start, size = max(1, start), F.size(pages)
    end = size if most is None else F.least(size, F.lit(start - 1 + max(1, most)))
    first = F.least(F.lit(start - 1), size)
    return F.struct(F.slice(pages, start, F.greatest(F.lit(0), end - first)).alias("pages"), (first + 1).alias("start_page"), end.alias("end_page"), (size > end).alias("has_more"))


def markdown(pages: Column, first: Column, url: Column, total: Column, end: Column) -> Column:
    """Pages as markdown blocks under a header that says where they come from; an empty page is marked."""
    blocks = F.transform(pages, lambda p, i: F.concat(F.lit(PAGE), (first + i).cast("string"), F.lit("\n\n"), F.when(p == "", EMPTY_PAGE).otherwise(F.coalesce(p, F.lit(EMPTY_PAGE)))))
    header = F.concat(F.lit("# Full text\n\nSource: "), F.coalesce(url, F.lit("")), F.lit("\nPages: "), first.cast("string"), F.lit("-"), end.cast("string"), F.lit(" / "), total.cast("string"), F.lit("\n\n---\n\n"))
    return F.concat(header, F.array_join(blocks, "\n\n"))


def extracted(docs: DataFrame, pages: str = "pages", url: str | None = None, start: int = 1, most: int | None = None) -> DataFrame:
    """`docs` with page_count, start_page, end_page, has_more, markdown, has_text, reliable, note and sections of their pages.

    Only the pages of the window are cleaned and judged; a window without pages has no text; sections are those of
    reliable texts.
    """
    w = page_window(F.coalesce(F.col(pages), F.array().cast("array<string>")), start, most)
    out = docs.withColumn("_w", w).withColumn("_p", F.transform("_w.pages", lambda p: cleaned(F.coalesce(p, F.lit("")))))
    out = out.withColumn("_t", F.array_join("_p", "\n")).withColumn("_a", assessed(F.col("_t")))
    none, count = F.size("_p") == 0, F.size(F.coalesce(F.col(pages), F.array().cast("array<string>")))
    link = F.lit(None).cast("string") if url is None else F.col(url)
    out = out.withColumns({
        "page_count": count, "start_page": F.col("_w.start_page"), "end_page": F.col("_w.end_page"), "has_more": F.col("_w.has_more"),
        "markdown": markdown(F.col("_p"), F.col("_w.start_page"), link, count, F.col("_w.end_page")), "has_text": F.col("_a.has_text") & ~none,
        "reliable": F.col("_a.reliable") & ~none, "note": F.when(none, "no pages in this window").otherwise(F.col("_a.note")),
    })
    out = out.withColumn("_t", F.when(F.col("reliable"), F.col("_t")))
    return split_sections(out, "_t").drop("_w", "_p", "_t", "_a")


def gated(content: Column, status: Column) -> Column:
    """Content only of open records."""
    return F.when(status == "open", content)


def guarded_files(files: DataFrame, records: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(record_id, path, length, content) of the files (path, length, content; Spark's binaryFile) of open records.

    records: record_id, access_status, content_key (the file's name). Closed records and those without a key are left
    out before anything is joined, and the length, which is known without reading, is tested at the scan; then a file
    has to begin like a PDF.
    """
    wanted = records.where("access_status = 'open' and content_key is not null and content_key <> ''").select("record_id", "content_key")
    small = files.where(F.col("length") <= most_bytes).withColumn("content_key", F.element_at(F.split("path", "/"), -1))
    return small.join(wanted, "content_key").where(F.substring("content", 1, 4) == F.lit(b"%PDF")).select("record_id", "path", "length", "content")
