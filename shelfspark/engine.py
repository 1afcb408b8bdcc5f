"""One object with the nine calls of the engine: every answer is rows and a one-row table that says how complete they are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import analysed, fenced, person_name
from .operators import cite, federate, fulltext, retrieve
from .operators.index import Index, index_of
from .sources import dictionary, store
from .sources.records import HIT

#: Weights of a term by the column where it stands, and how many rows a second source gives at most in one answer.
WEIGHTS = {
    "title": 5.0, "title_alt": 5.0, "author": 3.0, "advisor": 3.0, "subjects": 3.0, "institution": 2.0, "institute": 2.0, "department": 2.0,
    "record_type": 2.0, "year": 2.0, "keywords": 2.0, "keywords_alt": 2.0, "abstract": 1.0, "abstract_alt": 1.0,
}
CAP = 2000
SORTS, KINDS = ("relevance", "newest"), ("enums", "universities", "abd")
SEED_TERMS = 6
NOTES = {
    "stopwords": "the query has no terms besides stopwords; nothing was searched",
    "capped": "the second source gives no more rows in one answer; filters apply to those alone",
    "noise": " rows of the second source with none of the query's terms in title, author or advisor were left out",
    "nothing": "no match; try fewer or other words, or wider filters",
    "no_name": "the institution is not in the dictionary; only the index was asked",
    "several": "several institutions match; the first one was taken",
    "no_type": "the record type has no code; the second source may not be filtered by it",
    "exhaustive": "the second source was asked slice by slice",
    "incomplete": "some slices are not complete",
    "derived": "the index has nothing related; the rows come from the second source by the record's terms",
    "restricted": "the full text of a record that is not open is never read",
}


@dataclass
class Found:
    """hits and their coverage: one row with source, total_found (null if no second source was asked), coverage_complete, count, notes."""

    hits: DataFrame
    coverage: DataFrame


class Engine:
    """Search over an index of records and, if there is one, a second source (`live`) that answers with at most `cap` rows."""

    def __init__(self, records: DataFrame, live: DataFrame | None = None, index: Index | None = None, institutions: DataFrame | None = None,
                 departments: DataFrame | None = None, pages: DataFrame | None = None, cap: int = CAP, key: str = "record_id"):
        self.records, self.live, self.key, self.cap = records, live, key, cap
        self.index = index or index_of(records, key, {c: w for c, w in WEIGHTS.items() if c in records.columns})
        self.institutions, self.departments, self.pages = institutions, departments, pages
        self.spark = records.sparkSession

    def _asked(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What one answer of the second source holds, and one row with (live_total, live_shown). The rows that match are written
        once, so the source is read once for their number and the answer; the answer, `cap` rows at most, is written for hits, counts and notes."""
        rows = store.staged(rows, "matched")
        total = rows.agg(F.count("*").alias("live_total")).withColumn("live_shown", F.least("live_total", F.lit(self.cap)))
        return store.staged(rows.orderBy(self.key).limit(self.cap), "answer"), total

    def _found(self, index_hits: DataFrame, live_hits: DataFrame | None, total: DataFrame | None, order: list, limit: int, live_first: bool = False, notes=(), extra: DataFrame | None = None, counted: DataFrame | None = None) -> Found:
        """The first `limit` rows of both sources, one for each key, and their coverage. Both have _1, _2, _3 to sort by. counted: all
        hits of the index, if index_hits are the best of them."""
        cols = [*HIT, "_1", "_2", "_3"]
        sources = [s.select(*[F.col(c) if c in s.columns else F.lit(None).alias(c) for c in cols]) for s in ((index_hits, live_hits) if not live_first else (live_hits, index_hits)) if s is not None]
        if not order:
            sources = self._first(sources, limit)
        whole = federate.ranked_union(sources)
        whole = federate.first_wins(whole, self.key, F.struct("source_rank", "_1", "_2", "_3"))
        page = whole.orderBy(*order, "source_rank", "_1", "_2", "_3", self.key).limit(limit)
        counts = (index_hits if counted is None else counted).agg(F.count("*").alias("index_hits")).join(F.broadcast(page.agg(F.count("*").alias("count"))))
        if live_hits is not None:
            counts = counts.join(F.broadcast(live_hits.agg(F.count("*").alias("live_hits")))).join(F.broadcast(total))
        else:
            null = F.lit(None).cast("bigint")
            counts = counts.withColumns({"live_hits": F.lit(0).cast("bigint"), "live_total": null, "live_shown": F.lit(0).cast("bigint")})
        if extra is not None:
            counts = counts.join(F.broadcast(extra))
        complete = F.coalesce(F.col("live_shown") >= F.col("live_total"), F.lit(True))
        coverage = counts.select(
            federate.provenance(F.col("index_hits"), F.col("live_hits"), F.lit(live_hits is not None)).alias("source"), F.col("live_total").alias("total_found"), F.col("live_shown").alias("shown_live"),
            (F.col("complete") if extra is not None and "complete" in extra.columns else complete).alias("coverage_complete"), "index_hits", "count",
            federate.noted(*notes, (F.col("count") == 0, NOTES["nothing"])).alias("notes"))
        return Found(page.select(*HIT), coverage)

    def _first(self, sources: list[DataFrame], limit: int) -> list[DataFrame]:
        """What the first `limit` keys of sources one above the other can come from: if the best rows of the first source have more
        keys than that, these rows alone; so not all hits are grouped by key. Where they hold all of it, they stand for it."""
        key, most = self.key, 4 * limit + 1
        head = store.staged(sources[0].where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).orderBy("_1", "_2", "_3", key).limit(most), "first")
        rows, keys = head.agg(F.count("*"), F.count_distinct(key)).first()
        return [head] if keys > limit else [head, *sources[1:]] if rows < most else sources

    def search(self, query: str, field: str = "all", *, record_type: str | None = None, first_year: int | None = None, last_year: int | None = None, institution: str | None = None,
               department: str | None = None, language: str | None = None, access: str | None = None, approval: str | None = None, sort: str = "relevance", limit: int = 20, candidate_cap: int | None = None) -> Found:
        """Records of both sources with the query's terms; all filters apply to both sources, before ranking.

        A field's terms are looked for in the postings of its columns alone. The index comes first in the order of its scores; rows of the second source follow, by covered terms, those without
        any left out where the field is wide. A query of stopwords alone finds nothing in the index.
        """
        if field != "all" and field not in retrieve.FIELDS:
            raise ValueError(f"unknown field {field}")
        if sort not in SORTS:
            raise ValueError(f"unknown sort {sort}")
        if not query or not query.strip():
            raise ValueError("the query is empty")
        bundle = {"record_type": record_type, "first_year": first_year, "last_year": last_year, "institution": institution, "department": department, "language": language, "access": access, "approval": approval}
        own = retrieve.filtered(self.records, **bundle)
        columns = None if field == "all" else [c for c in retrieve.FIELDS[field] if c in self.index.weights]
        hits = retrieve.ranked(self.index, own, query, candidate_cap=candidate_cap, columns=columns).withColumns({"_1": F.round("score", 9), "_2": F.lit(0), "_3": F.lit(0)})
        hits = store.staged(hits.select(*[c for c in (*HIT, "_1", "_2", "_3") if c in hits.columns]), "hits")  # the page and the counts read them
        order = [F.coalesce("year", F.lit(0)).desc()] if sort == "newest" else []
        notes = [(F.lit(not analysed(query)), NOTES["stopwords"])]
        if self.live is None:
            return self._found(hits, None, None, order, limit, notes=notes)
        answer, total = self._asked(retrieve.keyword_search(self.live, query, field))
        told = retrieve.relevance(answer, [c for c in ("title", "title_alt", "author", "advisor") if c in answer.columns], "title", query, 1 if field in ("all", "abstract") else 0)
        covered = {"_1": -F.col("coverage").cast("double"), "_2": -F.col("title_coverage"), "_3": -F.coalesce("year", F.lit(0))} if "coverage" in told.columns else {"_1": F.lit(0.0), "_2": F.lit(0), "_3": F.lit(0)}
        kept = told.withColumns(covered)
        dropped = kept.agg(F.count("*").alias("kept"))
        notes += [(F.col("live_shown") < F.col("live_total"), NOTES["capped"]), (F.col("kept") < F.col("live_shown"), F.concat((F.col("live_shown") - F.col("kept")).cast("string"), F.lit(NOTES["noise"])))]
        return self._found(hits, retrieve.filtered(kept, **bundle), total, order, limit, notes=notes, extra=dropped)

    def by_person(self, kind: str, name: str, limit: int = 20) -> Found:
        """Records whose author or advisor has the name, in any order of its words, the newest of the index first."""
        if kind not in retrieve.PERSONS:
            raise ValueError(f"unknown kind {kind}")
        if not name or not name.strip():
            raise ValueError("the name is empty")
        year = {"_1": -F.coalesce("year", F.lit(0)).cast("double"), "_2": F.lit(0), "_3": F.lit(0)}
        own = retrieve.by_person_indexed(self.index, self.records, kind, name) if kind in self.index.weights else retrieve.by_person(self.records, kind, name)
        hits = own.withColumns(year)
        if self.live is None:
            return self._found(hits, None, None, [], limit)
        plain_name = self.spark.range(1).select(person_name(F.lit(name)).alias("n")).first()["n"]
        answer, total = self._asked(retrieve.keyword_search(self.live, plain_name, kind) if plain_name else self.live.limit(0))
        return self._found(hits, answer.withColumns(year), total, [], limit, notes=[(F.col("live_shown") < F.col("live_total"), NOTES["capped"])])

    def by_institution(self, name: str, record_type: str | None = None, first_year: int | None = None, last_year: int | None = None, limit: int = 50, exhaustive: bool = False) -> Found:
        """Records of an institution; the second source is asked by the first dictionary entry that holds the name, and comes first.

        exhaustive: it is asked year by year, language by language and access by access, and where that is still over its
        cap by ranges of the key, so that every row is brought.
        """
        if not name or not name.strip():
            raise ValueError("the name is empty")
        year = {"_1": -F.coalesce("year", F.lit(0)).cast("double"), "_2": F.lit(0), "_3": F.lit(0)}
        hits = retrieve.by_institution(self.records, name, self.key, record_type, first_year, last_year).withColumns(year)
        match = None if self.institutions is None else dictionary.first_match(self.institutions, name).first()  # one row
        if self.live is None or match is None:
            return self._found(hits, None, None, [], limit, notes=[(F.lit(self.live is not None), NOTES["no_name"])])
        own = retrieve.filtered(self.live.where(F.col("institution") == match["name"]), record_type=record_type, first_year=first_year, last_year=last_year)
        notes = [(F.lit(match["matches"] > 1), NOTES["several"])]
        if record_type:
            code = dictionary.code_of(dictionary.code_table(self.spark).where("kind = 'Tur'"), self.spark.createDataFrame([(record_type,)], "label string")).first()["code"]
            notes.append((F.lit(code == "0"), NOTES["no_type"]))
        if not exhaustive:
            answer, total = self._asked(own)
            return self._found(hits, answer.withColumns(year), total, [], limit, True, [*notes, (F.col("live_shown") < F.col("live_total"), NOTES["capped"])])
        own = store.staged(own, "own")  # each level of slices reads it
        rows, told = federate.collected(own, self.key, ["year", "language", "access_status"], self.cap, None)
        total = told.select(F.col("collected").alias("live_total"), F.col("collected").alias("live_shown"))
        notes += [(F.lit(True), NOTES["exhaustive"]), (~F.col("complete"), NOTES["incomplete"])]
        return self._found(hits, rows.withColumns(year), total, [], limit, True, notes, told.select("complete"))

    def related(self, record_id, limit: int = 10) -> Found:
        """Records that share terms with a record, but for itself; if the index has none, those of the second source."""
        row = self.records.where(F.col(self.key) == F.lit(record_id)).limit(1).collect()
        if not row:
            raise ValueError(f"no record {record_id}")
        record = row[0].asDict()
        scored = retrieve.related(self.index, record).select(self.key, F.round("score", 9).alias("_1"))  # so that equal scores tie
        if self.index.records is not self.records:
            scored = scored.join(self.records.select(self.key), self.key, "left_semi")  # a stored index may know others
        best = scored.orderBy("_1", self.key).limit(limit)
        hits = self.records.join(F.broadcast(best), self.key).withColumns({"_2": F.lit(0), "_3": F.lit(0)})
        terms = " ".join(retrieve.related_terms(record, SEED_TERMS))
        if self.live is None or not terms or not scored.isEmpty():
            return self._found(hits, None, None, [], limit, counted=scored)
        answer, total = self._asked(retrieve.keyword_search(self.live, terms, "all", op="or"))
        told = retrieve.relevance(answer, [c for c in ("title", "title_alt", "author", "advisor") if c in answer.columns], "title", terms, 1).where(F.col(self.key) != F.lit(record_id))
        covered = {"_1": -F.col("coverage").cast("double"), "_2": -F.col("title_coverage"), "_3": -F.coalesce("year", F.lit(0))}
        return self._found(hits, told.withColumns(covered), total, [], limit, notes=[(F.lit(True), NOTES["derived"])])

    def _record(self, record_ids: DataFrame | None, record_id) -> DataFrame:
        if record_ids is not None:
            return self.records.join(record_ids.select(self.key).distinct(), self.key, "left_semi")
        if record_id is None or record_id == "":
            raise ValueError("a record id is needed")
        return self.records.where(F.col(self.key) == F.lit(record_id))

    def record(self, record_id=None, record_ids: DataFrame | None = None) -> DataFrame:
        """One record, or those of `record_ids`, with its abstracts and reason fenced and its citations in eight formats."""
        rows = cite.cited(self._record(record_ids, record_id), cite.fields_of_record())
        rows = rows.withColumns({c: fenced(F.col(c)) for c in ("abstract", "abstract_alt", "access_reason")})
        return rows.withColumn("citations", F.struct(*cite.FORMATS)).drop(*cite.FORMATS)

    def _open_text(self, rows: DataFrame, start: int, most: int | None) -> DataFrame:
        """Records with what their pages give; pages of closed records are not joined, let alone read."""
        if self.pages is None:
            raise ValueError("the engine has no page texts")
        held = rows.where("access_status = 'open'").select(self.key).join(self.pages.select(self.key, "pages"), self.key)
        return rows.join(fulltext.extracted(held, "pages", start=start, most=most).drop("pages"), self.key, "left")

    def fulltext(self, record_id=None, record_ids: DataFrame | None = None, start: int = 1, most: int | None = None) -> DataFrame:
        """(key, title, access_status, access_reason, has_fulltext, reliable, page window, note, sections, markdown); a closed record has its reason alone."""
        rows = self._open_text(self._record(record_ids, record_id).select(self.key, "title", "access_status", fenced(F.col("access_reason")).alias("access_reason")), start, most)
        is_open = F.col("access_status") == "open"
        return rows.select(
            self.key, "title", "access_status", F.when(~is_open, F.col("access_reason")).alias("access_reason"), F.coalesce("has_text", F.lit(False)).alias("has_fulltext"), F.col("reliable").alias("text_reliable"),
            "page_count", "start_page", "end_page", F.col("has_more").alias("has_more_pages"), F.when(is_open, F.col("note")).otherwise(NOTES["restricted"]).alias("note"),
            fulltext.contents(F.col("sections")).alias("sections"), F.when(F.col("has_text"), fenced(F.col("markdown"))).alias("markdown"))

    def references(self, record_id=None, record_ids: DataFrame | None = None) -> DataFrame:
        """(key, access_status, access_reason, text_reliable, has_references, references_text); a closed record has its reason alone."""
        rows = self._open_text(self._record(record_ids, record_id).select(self.key, "access_status", fenced(F.col("access_reason")).alias("access_reason")), 1, None)
        text = fulltext.references(F.col("sections"))
        return rows.select(self.key, "access_status", F.when(F.col("access_status") != "open", F.col("access_reason")).alias("access_reason"), F.col("reliable").alias("text_reliable"), text.isNotNull().alias("has_references"), fenced(text).alias("references_text"))

    def facets(self, kind: str | None = None, query: str | None = None, most: int = dictionary.ITEMS) -> dict[str, DataFrame | tuple[DataFrame, DataFrame]]:
        """Dictionaries by kind: all codes, and of institutions and departments the first items and the count of all that match."""
        if kind is not None and kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
        out: dict = {}
        if kind in (None, "enums"):
            out["enums"] = dictionary.code_table(self.spark)
        for name, rows in (("universities", self.institutions), ("abd", self.departments)):
            if kind in (None, name) and rows is not None:
                out[name] = dictionary.listed(rows, query or None, most=most)
        return out


def as_json(rows: DataFrame, columns=HIT) -> DataFrame:
    """One JSON object a row with the columns that an answer shows: HIT of hits, RECORD of whole records; nulls are left out."""
    return rows.select(F.to_json(F.struct(*[c for c in columns if c in rows.columns])).alias("json"))
