"""Ranked and filtered retrieval."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import analysed, begins_words, fold_contains, let, plain, plain_text, upper_tr
from ..sources import store
from .index import PREFIX, Index, asked, weight_of

#: Fixed values of the ranking: BM25, the floor of idf, and what phrases, terms and recent years add.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
PHRASE_OF_TERMS, PHRASE_OF_ONE, IN_ABSTRACT, PER_TERM, PER_YEAR = 4.0, 2.0, 1.5, 0.7, 0.03
RELATED_TERMS = 12
#: A first wave has blocks with so many candidates for each row that is wanted.
FIRST_WAVE = 4
#: Columns that a search field stands for.
FIELDS = {
    "title": ("title", "title_alt"), "author": ("author",), "advisor": ("advisor",), "subject": ("subjects",),
    "keyword": ("keywords", "keywords_alt"), "abstract": ("abstract", "abstract_alt"),
}
PERSONS = ("author", "advisor")


def _starting(terms: Sequence[str]) -> tuple[Column, Column]:
    """(whether a row's term begins with any of `terms`, the array of those that it begins with)."""
    starts = [F.startswith("term", F.lit(t)) for t in terms]
    any_of = starts[0]
    for s in starts[1:]:
        any_of = any_of | s
    return any_of, F.filter(F.array(*[F.when(s, F.lit(t)) for s, t in zip(starts, terms, strict=True)]), lambda x: x.isNotNull())


def _share(f: Column, dl: Column, mean: Column) -> Column:
    """How far f weighted occurrences in a record of dl terms count."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * dl / mean))


def bm25(index: Index, terms: Sequence[str], every: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """(key, score) of records with a token for every (or any) prefix term; the smallest score is the best.

    columns: those in which terms are looked for, all of the index without them; the length of a record is that of all. A
    repeated term counts again; no terms find nothing. Only the terms' postings are read: columns and prefixes reach the
    scan. Sums over them are partial aggregates, and the document frequencies that are broadcast are one row a term.
    An index that is not stored reads its records once and gives a row a record.
    """
    key, wanted = index.key, sorted(set(terms))
    if not wanted:
        return index.places.select(key, F.lit(0.0).alias("score")).limit(0)
    if index.records is not None:
        return _scanned(index, terms, every, columns)
    any_of, held = _starting(wanted)
    per = index.weighted(columns).where(any_of).select(key, "dl", "f", F.explode(held).alias("q")).groupBy(key, "q").agg(F.sum("f").alias("f"), F.first("dl").alias("dl"))
    df = per.groupBy("q").agg(F.count("*").alias("df"))
    times = F.element_at(F.create_map(*[F.lit(x) for t in wanted for x in (t, list(terms).count(t))]), F.col("q"))
    idf = F.ln((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf)
    rows = per.join(F.broadcast(df.join(F.broadcast(index.corpus()))), "q")
    out = rows.groupBy(key).agg((-F.sum(times * idf * _share(F.col("f"), F.col("dl"), F.col("words") / F.col("docs")))).alias("score"), F.count("*").alias("m"))
    return (out.where(F.col("m") == len(wanted)) if every else out).select(key, "score")


def _scanned(index: Index, terms: Sequence[str], every: bool, columns: Sequence[str] | None) -> DataFrame:
    """bm25() from the records of an index that is not stored. What they hold of the terms is written once; one row of counts
    comes to the driver."""
    wanted = sorted(set(terms))
    rows, names = store.staged(asked(index, wanted, columns), "asked"), [f"f{i}" for i in range(len(wanted))]
    told = rows.agg(F.count("*").alias("docs"), F.sum("dl").alias("words"), *[F.count(f).alias(f) for f in names]).first()
    mean, score = F.lit((told["words"] or 0) / max(1, told["docs"])), F.lit(0.0)
    for f, t in zip(names, wanted, strict=True):
        idf = log((told["docs"] - told[f] + 0.5) / (told[f] + 0.5))
        score = score - F.coalesce(F.lit(list(terms).count(t) * (idf if idf > 0 else IDF_FLOOR)) * _share(F.col(f), F.col("dl"), mean), F.lit(0.0))
    held = sum((F.col(f).isNotNull().cast("int") for f in names), F.lit(0))
    return rows.where(held == len(wanted) if every else held > 0).select(index.key, score.alias("score"))


def document_frequencies(index: Index, terms: Sequence[str]) -> dict[str, int]:
    """The records that have a term with each prefix: of short prefixes as the index keeps them, of others counted from their
    postings (two columns). One row a term comes to the driver."""
    kept = [t for t in set(terms) if index.prefixes is not None and len(t) <= PREFIX]
    other = sorted(set(terms) - set(kept))
    out = dict.fromkeys(terms, 0)
    if kept:
        out |= {r["term"]: r["n"] for r in index.prefixes.where(F.col("term").isin(*kept)).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    if other:
        any_of, held = _starting(other)
        rows = index.places.where(any_of).select(index.key, F.explode(held).alias("q")).distinct()
        out |= {r["q"]: r["count"] for r in rows.groupBy("q").count().collect()}
    return out


def top_ranked(index: Index, records: DataFrame, query: str, k: int, abstract: str | None = "abstract", digits: int = 9) -> DataFrame:
    """The `k` best rows of ranked(), by score (rounded to `digits`) and key, without scoring or joining what can't be among them.

    The index keeps for each block of records of like length the most occurrences of each term and the least length. They
    bound the scores of a block, and what bonus() adds is bounded too. The blocks with the best bounds are scored first and
    their records joined; the k-th of them is then a floor. Blocks that can't reach it are not read, and of the others only
    records that can are joined. All of it is exact, whatever `records` was filtered by. To the driver come a row a term, a
    row a block of the index (their number does not grow with the records), and k rows.
    """
    terms, key = analysed(query), index.key
    wanted = sorted(set(terms))
    if not wanted or index.maxima is None or not index.docs:
        return ranked(index, records, query, abstract).withColumn("score", F.round("score", digits)).orderBy("score", key).limit(k)
    df, mean = document_frequencies(index, wanted), index.words / index.docs
    gain = {t: terms.count(t) * (x if (x := log((index.docs - df[t] + 0.5) / (df[t] + 0.5))) > 0 else IDF_FLOOR) for t in wanted}
    any_of, held = _starting(wanted)
    worth = F.element_at(F.create_map(*[F.lit(x) for t in wanted for x in (t, float(gain[t]))]), F.col("q"))
    most = (PHRASE_OF_TERMS + PER_TERM * len(terms) if len(terms) > 1 else PHRASE_OF_ONE) + PER_YEAR * 30
    bounds = index.maxima.where(any_of).select("block", "dl", "rows", (F.col("n") * weight_of(index.weights)).alias("f"), F.explode(held).alias("q"))
    bounds = bounds.groupBy("block", "q").agg(F.sum("f").alias("f"), F.min("dl").alias("dl"), F.sum("rows").alias("rows")).groupBy("block").agg(F.sum(worth * _share(F.col("f"), F.col("dl"), F.lit(mean))).alias("most"), F.min("rows").alias("rows"), F.count("*").alias("m"))
    blocks = sorted(((r["most"], r["block"], r["rows"]) for r in bounds.where(F.col("m") == len(wanted)).collect()), reverse=True)
    title = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "title_alt") if c in records.columns])
    body = F.col(abstract) if abstract is not None and abstract in records.columns else None

    def scored(some: Sequence[int], floor: float | None = None) -> DataFrame:
        rows = index.weighted().where(F.col("block").isin(*some) & any_of).select(key, "dl", "f", F.explode(held).alias("q"))
        per = rows.groupBy(key, "q").agg(F.sum("f").alias("f"), F.first("dl").alias("dl"))
        hits = per.groupBy(key).agg((-F.sum(worth * _share(F.col("f"), F.col("dl"), F.lit(mean)))).alias("score"), F.count("*").alias("m")).where(F.col("m") == len(wanted)).drop("m")
        hits = hits if floor is None else hits.where(F.col("score") - most <= floor)
        joined = hits.join(records, key)
        return joined.withColumn("score", F.round(F.col("score") - bonus(query, title, body, F.col("year")), digits)).orderBy("score", key).limit(k)

    first, count = [], 0
    while blocks and count < FIRST_WAVE * k:
        _, block, rows = blocks.pop(0)
        first.append(block)
        count += rows
    if not first:
        return ranked(index, records.limit(0), query, abstract)
    top = scored(first)
    held_rows = top.collect()  # k at most
    floor = held_rows[-1]["score"] if len(held_rows) == k else None
    rest = [b for bound, b, _ in blocks if floor is None or -bound - most <= floor + 10.0**-digits]
    best = records.sparkSession.createDataFrame(held_rows, top.schema)
    if not rest:
        return best.orderBy("score", key)
    return best.unionByName(scored(rest, None if floor is None else floor + 10.0**-digits)).orderBy("score", key).limit(k)


def phrase(index: Index, words: Sequence[str], columns: Sequence[str] | None = None, last_prefix: bool = True) -> DataFrame:
    """(key, column, start) of the places where `words` follow each other, the last of them as a prefix unless told otherwise.

    Only the postings of these words are read, in these columns; what a column of a record has of them meets in one row, and
    there the positions are intersected. No words stand nowhere.
    """
    key = index.key
    if not words:
        return index.places.select(key, "column", F.lit(0).alias("start")).limit(0)
    rows = index.places if columns is None else index.places.where(F.col("column").isin(*columns))
    same = [F.col("term") == w for w in words[:-1]] + [F.startswith("term", F.lit(words[-1])) if last_prefix else F.col("term") == words[-1]]
    any_of = same[0]
    for s in same[1:]:
        any_of = any_of | s
    begun = lambda i: F.transform("positions", lambda x: x - i)
    found = rows.where(any_of).groupBy(key, "column").agg(*[F.flatten(F.collect_list(F.when(s, begun(i)))).alias(f"_{i}") for i, s in enumerate(same)])
    starts = F.col("_0")
    for i in range(1, len(words)):
        starts = F.array_intersect(starts, F.col(f"_{i}"))
    return found.select(key, "column", F.explode(F.array_distinct(starts)).alias("start"))


def phrase_search(index: Index, query: str, field: str | Sequence[str] = "all", match: str = "contains", op: str = "and") -> DataFrame:
    """(key) of the records with both halves of a query in a field's columns, joined by `op`, from the postings alone.

    As keyword_search(), but words count and not letters: a phrase is words that follow each other, whatever parts them, and
    with "contains" the last one may go on; what stands inside a word is not found. A field is a name of FIELDS, "all" or a
    list of columns.
    """
    if match not in ("contains", "exact"):
        raise ValueError(f"unknown match {match}")
    if isinstance(field, str) and field != "all" and field not in FIELDS:
        raise ValueError(f"unknown field {field}")
    if not query.strip():
        raise ValueError("the query is empty")
    one, two, op = (query, None, op) if field in PERSONS else half_split(query, op)
    columns = None if field == "all" else FIELDS[field] if isinstance(field, str) else field
    keys = lambda text: phrase(index, analysed(text, keep_stopwords=True), columns, match == "contains").select(index.key).distinct()
    if two is None:
        return keys(one)
    if op == "or":
        return keys(one).union(keys(two)).distinct()
    return keys(one).join(keys(two), index.key, "left_semi" if op == "and" else "left_anti")


def bonus(query: str, title: Column, abstract: Column | None, year: Column) -> Column:
    """What a phrase or terms in the title, a phrase in the abstract and a recent year take off the score."""
    terms = analysed(query)
    phrase, folded = " ".join(terms), plain(title)
    hit = F.when(F.contains(folded, F.lit(phrase)), PHRASE_OF_TERMS if len(terms) > 1 else PHRASE_OF_ONE)
    if abstract is not None and len(terms) > 1:
        hit = hit.when(F.contains(plain(abstract), F.lit(phrase)), IN_ABSTRACT)
    covered = sum((F.contains(folded, F.lit(t)).cast("int") for t in terms), F.lit(0)) * PER_TERM if len(terms) > 1 else F.lit(0.0)
    return hit.otherwise(0.0) + covered + F.lit(PER_YEAR) * F.coalesce(F.greatest(F.lit(0), F.least(F.lit(30), year - 2000)), F.lit(0))


def year_between(year: Column, first: int | None, last: int | None) -> Column:
    return (F.lit(True) if first is None else F.coalesce(year >= first, F.lit(False))) & (F.lit(True) if last is None else F.coalesce(year <= last, F.lit(False)))


def holds_terms(column: Column, name: str) -> Column:
    """Every term of a name stands in the column; a name without terms is held by nothing."""
    terms = analysed(name)
    out = F.lit(bool(terms))
    for t in terms:
        out = out & fold_contains(column, t)
    return out


def filtered(records: DataFrame, *, record_type: str | None = None, first_year: int | None = None, last_year: int | None = None, institution: str | None = None,
             department: str | None = None, advisor: str | None = None, language: str | None = None, access: str | None = None, approval: str | None = None,
             title: str | None = None, author: str | None = None, subject: str | None = None) -> DataFrame:
    """Records that pass every filter given: substrings without case and accents, years inclusive, the rest equal but for case.

    title, author and subject are text filters over all columns of these fields; a column that the records lack is none.

    An absent or empty filter passes all; a null value passes no filter. An advisor without terms is no filter.
    """
    test = F.lit(True)
    for column, needle in (("record_type", record_type), ("institution", institution), ("department", department), ("language", language)):
        if needle:
            test = test & fold_contains(F.col(column), needle)
    for column, value in (("access_status", access), ("approval", approval)):
        if value:
            test = test & F.coalesce(plain(F.col(column)) == plain_text(value), F.lit(False))
    for field, needle in (("title", title), ("author", author), ("subject", subject)):
        if needle:
            names = [c for c in FIELDS[field] if c in records.columns]
            test = test & (F.coalesce(fold_contains(F.concat_ws("; ", *[F.concat_ws("; ", c) for c in names]), needle), F.lit(False)) if names else F.lit(False))
    if advisor and analysed(advisor):
        test = test & holds_terms(F.col("advisor"), advisor)
    if first_year is not None or last_year is not None:
        test = test & year_between(F.col("year"), first_year, last_year)
    return records.where(test)


def newest(key: str) -> list[Column]:
    """The order from the latest year, none as 0, ties by key."""
    return [F.coalesce("year", F.lit(0)).desc(), F.col(key)]


def ranked(index: Index, records: DataFrame, query: str, abstract: str | None = "abstract", candidate_cap: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """`records` that hold every term of the query (in `columns`, if there are any), with their adjusted score (the smallest is the best).

    records: already filtered, so that filters come before ranking. candidate_cap keeps so many best raw scores of the
    whole index first, for those who want such a cap. A query of stopwords alone finds nothing.
    """
    key = index.key
    hits = bm25(index, analysed(query), columns=columns)
    if candidate_cap is not None:
        hits = hits.orderBy(F.round("score", 9), key).limit(candidate_cap)
    title = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "title_alt") if c in records.columns])
    body = F.col(abstract) if abstract is not None and abstract in records.columns else None
    hits = hits.join(records, key)
    return hits.withColumn("score", F.col("score") - bonus(query, title, body, F.col("year")))


def by_person(records: DataFrame, column: str, name: str, key: str | None = None, limit: int | None = None) -> DataFrame:
    """Records whose person holds every term of a name, in any order; with `key` the newest first, `limit` of them at most.

    A name without terms (stopwords alone) finds nothing.
    """
    out = records.where(holds_terms(F.col(column), name))
    out = out if key is None else out.orderBy(*newest(key))
    return out if limit is None else out.limit(limit)


def by_person_indexed(index: Index, records: DataFrame, column: str, name: str) -> DataFrame:
    """Records of whose person's words each term of the name begins one, found by the column's postings of these terms alone.

    A name without terms finds nothing. Without a stored index the column itself is read, once.
    """
    if index.records is not None:
        return records.where(begins_words(F.col(column), analysed(name)))
    return records.join(bm25(index, analysed(name), columns=[column]).select(index.key), index.key, "left_semi")


def by_institution(records: DataFrame, name: str, key: str, record_type: str | None = None, first_year: int | None = None, last_year: int | None = None, limit: int | None = None) -> DataFrame:
    """Records of the institutions whose name holds the whole given one, newest first; an empty name finds nothing."""
    out = filtered(records.where(fold_contains(F.col("institution"), name) & F.lit(bool(analysed(name, keep_stopwords=True)))), record_type=record_type, first_year=first_year, last_year=last_year)
    out = out.orderBy(*newest(key))
    return out if limit is None else out.limit(limit)


def related_terms(record: Mapping, most: int = RELATED_TERMS) -> list[str]:
    """The first `most` different terms of a record's keywords, subjects and title."""
    texts = [x for c in ("keywords", "keywords_alt", "subjects") for x in (record.get(c) or [])] + [record.get("title") or ""]
    return list(dict.fromkeys(t for x in texts for t in analysed(x)))[:most]


def related(index: Index, record: Mapping, most: int = RELATED_TERMS) -> DataFrame:
    """(key, score) of the records that share a term with `record`, but for itself; a record without terms has none."""
    return bm25(index, related_terms(record, most), every=False).where(F.col(index.key) != F.lit(record[index.key]))


def half_split(query: str, op: str = "and") -> tuple[str, str | None, str]:
    """Two phrases of a query, the first with the larger half of its words."""
    if op not in ("and", "or", "not"):
        raise ValueError(f"unknown operator {op}")
    words = query.split()
    k = -(-len(words) // 2)
    return (query.strip(), None, op) if len(words) < 2 else (" ".join(words[:k]), " ".join(words[k:]), op)


def _has(folded: Sequence[Column], phrase: str, match: str) -> Column:
    words = analysed(phrase, keep_stopwords=True)
    exact = r"(^|[^\p{L}\p{N}])" + r"[^\p{L}\p{N}]+".join(words) + r"([^\p{L}\p{N}]|$)"
    out = F.lit(False)
    for c in folded:
        out = out | (F.contains(c, F.lit(" ".join(words))) if match == "contains" else c.rlike(exact))
    return out if words else F.lit(False)


def keyword_held(columns: Sequence[Column], query: str, match: str = "contains", ops: Sequence[str] = ("and", "or", "not")) -> Column:
    """The operators, of `ops`, with which the halves of a query hold: each half in any of the columns, as a substring or as whole
    words. Every column is folded once and searched once for each half. A null column holds nothing."""
    if match not in ("contains", "exact"):
        raise ValueError(f"unknown match {match}")
    if not query.strip():
        raise ValueError("the query is empty")
    one, two, _ = [half_split(query, op) for op in ops][0]
    names = [f"c{i}" for i in range(len(columns))]

    def held(found: Column) -> Column:
        a, b = found["a"], found["b"]
        tests = {op: a if two is None else {"and": a & b, "or": a | b, "not": a & ~b}[op] for op in ops}
        return F.filter(F.array(*[F.when(test, F.lit(op)) for op, test in tests.items()]), lambda x: x.isNotNull())

    def searched(s: Column) -> Column:
        folded = [s[n] for n in names]
        return F.struct(_has(folded, one, match).alias("a"), (F.lit(False) if two is None else _has(folded, two, match)).alias("b"))

    return let(let(F.struct(*[plain(c).alias(n) for c, n in zip(columns, names, strict=True)]), searched), held)


def keyword_filter(columns: Sequence[Column], query: str, match: str = "contains", op: str = "and") -> Column:
    """Field search: each phrase in any of the columns, as a substring or as whole words, joined by and, or, not."""
    return F.size(keyword_held(columns, query, match, [op])) > 0


def keyword_search(records: DataFrame, query: str, field: str = "all", match: str = "contains", op: str = "and") -> DataFrame:
    """Records with the query in a field: halves of it joined by `op`; a person's name is one upper-cased phrase, never split."""
    if field != "all" and field not in FIELDS:
        raise ValueError(f"unknown field {field}")
    if field in PERSONS:
        if not query.strip():
            raise ValueError("the query is empty")
        return records.where(F.coalesce(F.contains(upper_tr(F.col(field)), upper_tr(F.lit(" ".join(query.split())))), F.lit(False)))
    names = [c for f in (FIELDS if field == "all" else [field]) for c in FIELDS[f] if c in records.columns]
    kinds = dict(records.dtypes)
    return records.where(keyword_filter([F.concat_ws("; ", c) if kinds[c].startswith("array") else F.col(c) for c in names], query, match, op))


def relevance(hits: DataFrame, texts: Sequence[str], title: str, query: str, least: int | None = None, key: str | None = None) -> DataFrame:
    """Hits with their covered terms in all texts and in the title; those that cover `least` (default: all) stay.

    With `key` they are sorted: the most covered, the most covered in the title, the newest, then by key. A query without
    terms leaves all as they are.
    """
    terms = analysed(query)
    whole = plain(F.concat_ws(" ", *[F.col(c) for c in texts]))
    count = lambda c: sum((F.contains(c, F.lit(t)).cast("int") for t in terms), F.lit(0))
    out = hits.withColumns({"coverage": count(whole), "title_coverage": count(plain(F.col(title)))})
    if not terms:
        return out
    out = out.where(F.col("coverage") >= (len(terms) if least is None else least))
    return out if key is None else out.orderBy(F.desc("coverage"), F.desc("title_coverage"), *newest(key))
