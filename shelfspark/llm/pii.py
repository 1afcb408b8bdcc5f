"""Personal data: exact forms are found first; the words before them become patterns that find what the forms miss."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, cut, is_small, looked_up, table, text_key

#: Kinds in the order of the output.
KINDS = ("email", "ip", "card", "phone")
#: Forms of identifiers of each kind, exact ones. An optional tail makes every run of letters or digits one match, so that
#: none is read again from its next character; a match without the tail is no find.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
_IP = re.compile(r"[0-9]+((?:\.[0-9]+){3})?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Wider forms, by the kinds they may be. They count only where a trusted pattern precedes them, and outside exact finds.
_NUMBER = re.compile(r"(?<![\w.+-])[+(]{0,2}[0-9](?:[\x20().\-/]{0,3}[0-9])+(?![\w])")
_ADDRESS = re.compile(r"(?<![\w.+%@-])[\w.+%-]{1,64}(?:[\x20]?@[\x20]?|[\x20]?[(\[]at[)\]][\x20]?|[\x20]at[\x20])[\w-]{1,63}(?:(?:\.|[\x20]?[(\[]dot[)\]][\x20]?|[\x20]dot[\x20])[\w-]{1,63})+", re.IGNORECASE)
_SIX = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4})(?![\w:])")
#: Code points before an identifier in which its words are looked for, and the words of the longest pattern.
CONTEXT, WORDS = 120, 3
_WORD = re.compile(r"[^\W_]+")
#: Marks after a word that introduce a value.
INTRODUCES = (":", "=", "#", "(", "[", "<", '"', "'")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def exact_spans(text: str) -> list[Span]:
    """The exact finds of a text, by kind, then start; a match that fails its test is passed over as a whole."""
    out = []
    if "@" in text:
        out += [Span("email", *m.span()) for m in _EMAIL.finditer(text) if m[1]]
    if text.count(".") > 2:
        out += [Span("ip", *m.span()) for m in _IP.finditer(text) if m[1] and all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append(Span("card", *m.span()))
    if "+" in text:
        out += [Span("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def _free(spans: list[Span], start: int, end: int) -> bool:
    """Whether none of `spans`, sorted by start and disjoint, meets [start, end)."""
    from bisect import bisect_left

    i = bisect_left(spans, (end,), key=lambda s: (s.start,))
    return i == 0 or spans[i - 1].end <= start


def candidates(text: str, exact: list[Span]) -> list[tuple[Span, tuple[str, ...]]]:
    """Wider finds outside the exact ones, with the kinds that each may be."""
    cover: list[Span] = []
    for s in sorted(exact, key=lambda s: (s.start, s.end)):  # overlapping ones of several kinds as one
        if cover and s.start < cover[-1].end:
            cover[-1] = Span("", cover[-1].start, max(cover[-1].end, s.end))
        else:
            cover.append(Span("", s.start, s.end))
    out = []
    for m in _NUMBER.finditer(text):
        n, dots = len(_digits(m[0])), m[0].split(".")
        kinds = ("ip",) * (len(dots) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 for p in dots)) or ("phone",) * (7 <= n <= 15) + ("card",) * (12 <= n <= 19)
        if kinds and _free(cover, *m.span()):
            out.append((Span("", *m.span()), kinds))
    if "@" in text or " dot " in (low := text.lower()) or "(dot)" in low or "[dot]" in low or "(at)" in low or "[at]" in low:
        out += [(Span("", *m.span()), ("email",)) for m in _ADDRESS.finditer(text) if _free(cover, *m.span()) and ("@" in m[0] or re.search(r"[(\[]at[)\]]|\bdot\b", m[0], re.I))]
    if text.count(":") > 3:
        out += [(Span("", *m.span()), ("ip",)) for m in _SIX.finditer(text) if _free(cover, *m.span())]
    return out


def contexts(text: str, start: int) -> list[str]:
    """Patterns of a place: the last two and three words before it and the marks after them, without case, digits as 0.

    One word is a pattern if what follows it introduces a value, as in `phone:`.
    """
    before = text[max(0, start - CONTEXT) : start]
    found = list(_WORD.finditer(before))[-WORDS:]
    words = [re.sub(r"[0-9]", "0", m[0].lower()) for m in found]
    if not words:
        return []
    mark = "".join(before[found[-1].end() :].split())[:3]
    return [" ".join(words[-n:]) + "|" + mark for n in range(1 if mark[:1] in INTRODUCES else 2, len(words) + 1)]


def _value(kind: str, text: str) -> str:
    """The identifier itself: digits of numbers, of addresses the letters without case and blanks."""
    return _digits(text) if kind in ("card", "phone") else "".join(text.lower().split())


_SCANNED = "doc_id {}, key binary, base array<struct<kind:string,start:int,end:int>>, mentions array<struct<kind:string,start:int,end:int,value:string,exact:boolean,patterns:array<string>>>"


def _scan(batches: Iterator) -> Iterator:
    import pyarrow as pa

    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    mention = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("exact", pa.bool_()), ("patterns", pa.list_(pa.string()))])
    for b in batches:
        bases, mentions = [], []
        for text in b["text"].to_pylist():
            exact = exact_spans(text)
            bases.append([s._asdict() for s in exact])
            found = [(s, (s.kind,), True) for s in exact] + [(s, kinds, False) for s, kinds in candidates(text, exact)]
            own = []
            for s, kinds, sure in found:
                p = contexts(text, s.start)
                own += [{"kind": k, "start": s.start, "end": s.end, "value": _value(k, text[s.start : s.end]), "exact": sure, "patterns": p} for k in kinds]
            mentions.append(own)
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["key"], pa.array(bases, pa.list_(span)), pa.array(mentions, pa.list_(mention))], names=["doc_id", "key", "base", "mentions"])


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, mentions) of every document, written: its exact finds, and these and the wider ones with their
    values and patterns. key: the MD5 of the text."""
    arrow_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), text.alias("text"))
    return cut(rows.mapInArrow(_scan, _SCANNED.format(dict(docs.dtypes)["doc_id"])), "scanned")


def discovered(mentions: DataFrame, *, rounds: int = 3, least: int = 3, trust: float = 0.6, doubt: float = 1.0) -> DataFrame:
    """(kind, value) of the identifiers that trusted patterns find.

    mentions: kind, value, exact, patterns. The graph links each pattern to the different values that follow it; how
    often a value follows, in one text or in many copies, counts once. In every round a pattern's confidence for a kind is
    the sum of its values' scores by their number and `doubt`: exact finds of the kind score 1, those of another kind 0,
    wider finds what the round before gave them. A pattern without `least` different exact finds of the kind has none. A
    wider find scores by the patterns that agree on it, 1 - product(1 - confidence), and is discovered from `trust` on.
    Scores are rounded to nine digits, so that their order does not matter.
    """
    edges = mentions.select("kind", "value", "exact", F.explode("patterns").alias("pattern"))
    edges = edges.groupBy("kind", "value", "pattern").agg(F.max("exact").alias("exact"))
    edges = cut(edges, "edges")
    # patterns with enough exact finds; all others can't get a confidence in any round
    able = edges.where("exact").groupBy("kind", "pattern").count().where(F.col("count") >= least).select("kind", "pattern")
    able = cut(able, "patterns")
    if able.isEmpty():
        return edges.select("kind", "value").limit(0)
    linked = edges.select(F.col("kind").alias("own"), "value", "exact", "pattern").join(able, "pattern")
    linked = linked.where("kind = own or exact")  # a wider find of another kind is no evidence against this one
    linked = cut(linked, "links")
    scores = None
    for _ in range(rounds):
        sure = F.when(F.col("exact"), F.when(F.col("own") == F.col("kind"), 1.0).otherwise(0.0))
        if scores is None:
            told = linked.withColumn("s", F.coalesce(sure, F.lit(0.0)))
        else:
            told = linked.join(scores, ["kind", "value"], "left").withColumn("s", F.coalesce(sure, F.col("score"), F.lit(0.0)))
        confident = told.groupBy("kind", "pattern").agg(F.round(F.sum("s") / (F.count("*") + doubt), 9).alias("c"))
        wide = linked.where("not exact").select("kind", "value", "pattern").join(confident, ["kind", "pattern"])
        missed = F.exp(F.sum(F.ln(F.greatest(1 - F.col("c"), F.lit(1e-12)))))
        scores = cut(wide.groupBy("kind", "value").agg(F.round(1 - missed, 9).alias("score")), "scores")
    return scores.where(F.col("score") >= trust).select("kind", "value")


def _listed(spans: Column) -> Column:
    """kind:start:end by kind as in KINDS, then start, joined by commas."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, **settings) -> DataFrame:
    """One row per row of docs (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added).

    docs: doc_id, text; other columns are not read. A null text counts as empty and has no spans. The counts and
    base_sha256 are those of the exact finds; `spans` adds the occurrences of identifiers that discovered() trusts, as long
    as they meet no exact find (n_added of them; a number that is trusted as two kinds is listed as both). Offsets are code points, ends exclusive. Repeated rows have the same spans each; an empty table gives no rows.

    A text is read once. What it has of exact and wider finds is written, and the graph is made of these alone.
    """
    found = scanned(docs)
    mentions = found.select("doc_id", "key", F.explode("mentions").alias("m")).select("doc_id", "key", "m.*")
    values = cut(discovered(mentions, **settings), "discovered")
    named = lambda kind, value: F.concat_ws(":", kind, value)
    wide = mentions.where("not exact").select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.struct("kind", "start", "end").alias("s"), named(F.col("kind"), F.col("value")).alias("name"))
    wide = cut(looked_up(wide, "name", values.select(named(F.col("kind"), F.col("value")).alias("name")), 64, "left_semi").select("d", "k", "s"), "added")
    added = wide.groupBy("d", "k").agg(F.collect_set("s").alias("more"))
    added = F.broadcast(added) if is_small(wide, 64) else added
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))
    rows = found.join(added, same, "left").withColumn("more", F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "more")).alias("spans"), F.size("more").cast("long").alias("n_added"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
