"""Queries of the engine's calls, listings, slices and citations, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import NOTES, WEIGHTS, Engine, as_json
from ..functions.text import STOPWORDS, fold, fold_contains, person_name, plain, tokens, upper_tr
from ..operators import cite, federate, harvest, retrieve
from ..operators.index import read_index, upsert_index, write_index
from ..sources import store
from ..sources.records import HIT, bibliography, read, records
from .registry import SQL, bm25_sql, fold_sql, plain_sql, query, tokens_sql, values_sql

#: Rows with Turkish letters and accents: id, title, author, advisor.
ACCENTS = (
    (1, "Hâkim kararları ve İŞÇİ sağlığı", "ŞULE ÇAĞLAR ÖZGÜR", "Prof. Dr. Ada Kaya"), (2, "Hakim ve savcı", "Işık Ünal", "Doç. Dr. Kaya, Ada"), (3, "Über Straßen und Züge", "Łukasz Groß", None),
    (4, "Étude du château", "Zoé Lefèvre", "Dr. Öğretim Üyesi Kaya, Ada"), (5, None, "ILGIN IRMAK", "Arş. Gör. Uzm. Çelik, Can Ege"), (6, "the of ve ile", "the", "Yrd. Doç. Dr. KAYA ADA"),
    (7, "Aʿmāl a_b-c 12", "İLGİ", "Kaya"), (8, "", "", ""),
)
_AT = values_sql(ACCENTS, "id, title, author, advisor")
_HIT = ", ".join(HIT)
_SEGMENT = "upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2))"
BIB = f"""bib AS (SELECT o_orderkey::VARCHAR AS record_id, 'k' || o_orderkey AS detail_key, o_orderkey::VARCHAR AS public_no, 'Hâkim ' || lower(c_mktsegment) || ' of ' || {_SEGMENT} AS title,
    CASE WHEN o_orderkey % 3 = 0 THEN 'On ' || lower(c_mktsegment) END AS title_alt, c_name AS author, 'Prof. Dr. ' || {_SEGMENT} || ' ' || c_mktsegment AS advisor, n_name || ' ÜNİVERSİTESİ' AS institution,
    c_mktsegment AS department, string_split(o_orderpriority, '-')[2] AS record_type, CASE WHEN o_orderkey % 50 <> 0 THEN year(o_orderdate)::INT END AS year, o_orderstatus AS language, lower(r_name) AS subjects,
    lower(c_mktsegment) || '; ' || lower(o_orderpriority) AS keywords, CASE o_orderstatus WHEN 'F' THEN 'open' WHEN 'O' THEN 'restricted' ELSE 'unknown' END AS access_status, o_orderkey
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_COLS = {c: w for c, w in WEIGHTS.items() if c in ("title", "title_alt", "author", "advisor", "subjects", "institution", "department", "record_type", "year", "keywords")}
_SQLCOLS = {("year::VARCHAR" if c == "year" else c): w for c, w in _COLS.items()}
CAP = 1500
_STORED: dict[tuple[str, str], str] = {}


def accents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ACCENTS), "id int, title string, author string, advisor string")


def engine(spark: SparkSession, sf_dir: str, stored: bool = False) -> Engine:
    """Orders as records with an index, and those of two states as a second source with a cap.

    stored: an index that is written once and kept. It is worth its cost for many questions; each query here asks a single
    one, for which the records are read once and no index of all of them is written.
    """
    rows, at = bibliography(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir)
    if stored and at not in _STORED:
        path = store.own_folder(spark, "bibliography")
        write_index(rows, "record_id", _COLS, path)
        _STORED[at] = path
    places = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.concat("n_name", F.lit(" ÜNİVERSİTESİ")).alias("name"))
    return Engine(rows, rows.where("language in ('O', 'P')"), read_index(spark, _STORED[at], "record_id", "string") if stored else None, places, cap=CAP)


def _contains(c: str, needle: str) -> str:
    return f"coalesce(contains({plain_sql(c)}, '{needle}') AND {c} IS NOT NULL, false)"


_TITLE2 = "coalesce(title, '') || ' ' || coalesce(title_alt, '')"
_ANY = lambda p: "(" + " OR ".join(_contains(c, p) for c in ("title", "title_alt", "author", "advisor", "subjects", "keywords")) + ")"
_SEARCH = f"""WITH {BIB}, {bm25_sql(_SQLCOLS, ["hakim", "building"], True, "bib")},
    idx AS (SELECT b.*, 0 AS source_rank, round(score - (CASE WHEN contains({plain_sql(_TITLE2)}, 'hakim building') THEN 4.0 ELSE 0.0 END + 0.7 * (contains({plain_sql(_TITLE2)}, 'hakim')::INT + contains({plain_sql(_TITLE2)}, 'building')::INT)
            + 0.03 * coalesce(greatest(0, least(30, year - 2000)), 0)), 9)::DOUBLE AS k1, 0 AS k2, 0 AS k3 FROM s JOIN bib b USING (record_id) WHERE year >= 1996 AND {_contains("institution", "nation_1")}),
    raw AS (SELECT * FROM bib WHERE language IN ('O', 'P') AND {_ANY("hakim building")} AND {_ANY("of")}),
    answer AS (SELECT * FROM raw ORDER BY record_id LIMIT {CAP}),
    told AS (SELECT *, {" + ".join(f"contains({plain_sql('concat_ws(chr(32), title, title_alt, author, advisor)')}, '{t}')::INT" for t in ("hakim", "building"))} AS cov,
             {" + ".join(f"contains({plain_sql('title')}, '{t}')::INT" for t in ("hakim", "building"))} AS tcov FROM answer),
    kept AS (SELECT * FROM told WHERE cov >= 1),
    live AS (SELECT * EXCLUDE (cov, tcov), 1 AS source_rank, -cov::DOUBLE AS k1, -tcov AS k2, -coalesce(year, 0) AS k3 FROM kept WHERE year >= 1996 AND {_contains("institution", "nation_1")}),
    u AS (SELECT * FROM (SELECT * FROM idx UNION ALL SELECT * FROM live) QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY source_rank, k1, k2, k3) = 1)"""


def _searched(spark, sf_dir, sort="relevance"):
    return engine(spark, sf_dir).search("Hâkim building of", first_year=1996, institution="NATION_1", sort=sort, limit=40)


@query(f"{_SEARCH} SELECT {_HIT} FROM u ORDER BY source_rank, k1, k2, k3, record_id LIMIT 40")
def engine_search(spark, sf_dir):
    return _searched(spark, sf_dir).hits


@query(f"{_SEARCH} SELECT {_HIT} FROM u ORDER BY coalesce(year, 0) DESC, source_rank, k1, k2, k3, record_id LIMIT 40")
def engine_search_newest(spark, sf_dir):
    return _searched(spark, sf_dir, "newest").hits


@query(f"""{_SEARCH}, n AS (SELECT (SELECT count(*) FROM idx) AS i, (SELECT count(*) FROM live) AS l, (SELECT count(*) FROM raw) AS total, (SELECT count(*) FROM kept) AS kept, least((SELECT count(*) FROM u), 40) AS c)
    SELECT CASE WHEN i > 0 AND l > 0 THEN 'hybrid' WHEN l > 0 THEN 'live' WHEN i = 0 THEN 'live' ELSE 'index' END AS source, total AS total_found, least(total, {CAP}) AS shown_live, total <= {CAP} AS coverage_complete, i AS index_hits, c AS count,
    (total > {CAP})::INT + (kept < least(total, {CAP}))::INT + (c = 0)::INT AS notes FROM n""")
def engine_search_coverage(spark, sf_dir):
    return _searched(spark, sf_dir).coverage.withColumn("notes", F.size("notes"))


@query(f"""{_SEARCH}, n AS (SELECT (SELECT count(*) FROM raw) AS total, (SELECT count(*) FROM kept) AS kept, (SELECT count(*) FROM u) AS c)
    SELECT '{NOTES["capped"]}' AS note FROM n WHERE total > {CAP} UNION ALL SELECT (least(total, {CAP}) - kept) || '{NOTES["noise"].replace("'", "''")}' FROM n WHERE kept < least(total, {CAP})
    UNION ALL SELECT '{NOTES["nothing"]}' FROM n WHERE c = 0""")
def engine_search_notes(spark, sf_dir):
    return _searched(spark, sf_dir).coverage.select(F.explode("notes").alias("note"))


@query(f"""{_SEARCH} SELECT 'index' AS source, NULL::BIGINT AS total_found, 0::BIGINT AS shown_live, true AS coverage_complete, (SELECT count(*) FROM idx) AS index_hits, least((SELECT count(*) FROM idx), 40) AS count""")
def engine_search_alone(spark, sf_dir):
    """The coverage of a search without a second source: its total is unknown, not zero."""
    e = engine(spark, sf_dir)
    alone = Engine(e.records, index=e.index)
    return alone.search("Hâkim building of", first_year=1996, institution="NATION_1", limit=40).coverage.drop("notes")


_JSON = ", ".join(f"""nullif('"{c}":"' || {c} || '"', NULL)""" if c != "year" else """'"year":' || year""" for c in HIT)


@query(f"WITH {BIB} SELECT record_id, '{{{{' || concat_ws(',', {_JSON}) || '}}}}' AS json FROM bib".replace("{{", "{").replace("}}", "}"))
def hit_json(spark, sf_dir):
    """Every record as the JSON object that an answer shows of a hit."""
    rows = bibliography(spark, sf_dir)
    return as_json(rows).select(F.get_json_object("json", "$.record_id").alias("record_id"), "json")


@query(f"""WITH {BIB} SELECT record_id FROM bib WHERE {_contains("concat_ws('; ', title, title_alt)", "on building")} AND {_contains("author", "customer")} AND {_contains("advisor", "nation")} AND {_contains("subjects", "asia")}
    AND language <> 'P' AND year <= 1998""")
def advanced_filters(spark, sf_dir):
    """The text filters of the advanced search beside approval and years."""
    return retrieve.filtered(bibliography(spark, sf_dir), title="On building", author="CUSTOMER", advisor="nation", subject="ASIA", approval="onaylandi", last_year=1998).select("record_id")


_MARKED_SQL = "translate(p_name, 'aeioucsrdnl', 'âéİöüČŞřďńł') || ' ' || p_type || 'e' || chr(769)"


@query(f"SELECT p_partkey, {plain_sql(_MARKED_SQL)} AS plain, len({tokens_sql(_MARKED_SQL)}) AS n, contains({plain_sql(_MARKED_SQL)}, 'small') AS small FROM part")
def marked_names(spark, sf_dir):
    """All parts' names with Turkish, stroked, composed and decomposed letters, in the form in which they are found."""
    name = F.concat(F.translate("p_name", "aeioucsrdnl", "âéİöüČŞřďńł"), F.lit(" "), "p_type", F.lit("e\u0301"))
    return read(spark, sf_dir, "part").select("p_partkey", plain(name).alias("plain"), F.size(tokens(name)).cast("long").alias("n"), fold_contains(name, "Śmall").alias("small"))


def _person(cond: str) -> str:
    return f"""WITH {BIB}, idx AS (SELECT *, 0 AS source_rank FROM bib WHERE {" AND ".join(_contains("advisor", t) for t in ("building", "nation"))}),
    live AS (SELECT *, 1 AS source_rank FROM bib WHERE language IN ('O', 'P') AND {cond} ORDER BY record_id LIMIT {CAP}),
    u AS (SELECT * FROM (SELECT * FROM idx UNION ALL SELECT * FROM live) QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY source_rank) = 1)
    SELECT {_HIT} FROM u ORDER BY source_rank, coalesce(year, 0) DESC, record_id LIMIT 60"""


@query(_person("contains(upper(translate(advisor, 'iı', 'İI')), upper(translate('nation building', 'iı', 'İI')))"))
def engine_person(spark, sf_dir):
    return engine(spark, sf_dir).by_person("advisor", "Prof. Dr. building, nation", limit=60).hits


_PLACE = f"""WITH {BIB}, m AS (SELECT min(n_name || ' ÜNİVERSİTESİ') AS name FROM nation WHERE contains({plain_sql("n_name || ' ÜNİVERSİTESİ'")}, 'nation_1')),
    idx AS (SELECT *, 1 AS source_rank FROM bib WHERE {_contains("institution", "nation_1")} AND {_contains("record_type", "high")}),
    own AS (SELECT * FROM bib WHERE language IN ('O', 'P') AND institution = (SELECT name FROM m) AND {_contains("record_type", "high")})"""


@query(f"""{_PLACE}, live AS (SELECT *, 0 AS source_rank FROM own ORDER BY record_id LIMIT {CAP}),
    u AS (SELECT * FROM (SELECT * FROM idx UNION ALL SELECT * FROM live) QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY source_rank) = 1)
    SELECT {_HIT} FROM u ORDER BY source_rank, coalesce(year, 0) DESC, record_id LIMIT 50""")
def engine_institution(spark, sf_dir):
    return engine(spark, sf_dir).by_institution("Nation_1", "HIGH").hits


@query(f"""{_PLACE} SELECT CASE WHEN (SELECT count(*) FROM own) > 0 AND count(*) > 0 THEN 'hybrid' WHEN (SELECT count(*) FROM own) > 0 THEN 'live' WHEN count(*) > 0 THEN 'index' ELSE 'live' END AS source,
    (SELECT count(*) FROM own) AS total_found, true AS coverage_complete, count(*) AS index_hits FROM idx""")
def engine_institution_exhaustive(spark, sf_dir):
    return engine(spark, sf_dir).by_institution("Nation_1", "HIGH", exhaustive=True).coverage.select("source", "total_found", "coverage_complete", "index_hits")


_RELATED = f"""WITH {BIB}, seed AS (SELECT * FROM bib WHERE record_id = '7'), t0 AS (SELECT unnest(t) AS t, unnest(range(0, len(t))) AS i FROM (SELECT {tokens_sql("keywords || ' ' || subjects || ' ' || title")} AS t FROM seed)),
    t1 AS (SELECT t, min(i) AS i FROM t0 WHERE t NOT IN ({", ".join(f"'{w}'" for w in STOPWORDS)}) GROUP BY t ORDER BY 2 LIMIT 12), {bm25_sql(_SQLCOLS, "SELECT t FROM t1", False, "bib")}"""


@query(f"{_RELATED} SELECT {_HIT} FROM s JOIN bib USING (record_id) WHERE record_id <> '7' ORDER BY round(score, 9), record_id LIMIT 30")
def engine_related(spark, sf_dir):
    """One question: no index of all records is written for it."""
    return engine(spark, sf_dir).related("7", limit=30).hits


_CITED = values_sql([(i, t) for i, t in enumerate([*cite.LABELS, "Proje", None])], "i, t")
_CITE = f"""WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 = 9 THEN NULL WHEN s_suppkey % 10 = 8 THEN s_name ELSE 'Ada-Bea Çi ' || s_name END AS a, CASE WHEN s_suppkey % 7 <> 6 THEN 'On & {{trade}}..' END AS ti,
    CASE WHEN s_suppkey % 5 <> 4 THEN (1990 + s_suppkey % 30)::VARCHAR END AS y, CASE WHEN s_suppkey % 4 <> 3 THEN 'Univ' END AS u, CASE WHEN s_suppkey % 3 <> 2 THEN s_suppkey::VARCHAR END AS no, t AS kind,
    CASE WHEN s_suppkey % 2 = 0 THEN 'http://x' END AS url, s_name AS f FROM supplier JOIN {_CITED} c ON c.i = s_suppkey % {len(cite.LABELS) + 2}),
    l AS (SELECT *, CASE {" ".join(f"WHEN kind = '{k}' THEN '{v}'" for k, v in cite.LABELS.items())} WHEN kind IS NULL THEN 'Tez' ELSE kind || ' tezi' END AS lab, k % 10 = 8 AS single, rtrim(ti, '.') AS bare FROM s),
    n AS (SELECT *, CASE WHEN a IS NULL THEN NULL WHEN single THEN f ELSE f || ', Ada-Bea Çi' END AS lf, CASE WHEN a IS NULL THEN NULL WHEN single THEN f ELSE f || ', A.-B. Ç.' END AS sh, CASE WHEN a IS NULL THEN NULL WHEN single THEN f ELSE 'A.-B. Ç. ' || f END AS fl FROM l)"""
_P = cite.PUBLISHER


def _suppliers(spark, sf_dir):
    """Suppliers as cited works: every kind of type, each field missing in turn, entities and blanks to clean."""
    s = read(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey"))
    kinds = F.array(*[F.lit(x) for x in [*cite.LABELS, "Proje", None]])
    some = lambda n, r, c: F.when(F.col("k") % n != r, c)
    fields = {
        "author": F.when(F.col("k") % 10 == 9, F.lit(None)).when(F.col("k") % 10 == 8, F.col("s_name")).otherwise(F.concat(F.lit(" Ada-Bea  &Ccedil;i "), "s_name")), "title": some(7, 6, F.lit("On &amp;  {trade}..")),
        "year": some(5, 4, 1990 + F.col("k") % 30), "record_type": F.get(kinds, (F.col("k") % (len(cite.LABELS) + 2)).cast("int")), "institution": some(4, 3, F.lit(" Univ ")), "public_no": some(3, 2, F.col("k").cast("string")), "url": some(2, 1, F.lit("http://x")),
    }
    return s.select("k", "s_name"), fields


@query(f"""{_CITE} SELECT k, concat_ws(' ', rtrim(sh, '.') || '.', '(' || coalesce(y, 'n.d.') || ').', '*' || bare || '*', '(Tez No. ' || no || ')', '[' || concat_ws(', ', lab, u) || '].', '{_P}.') AS apa,
    concat_ws(' ', lf || '.', '*' || bare || '*.', nullif(concat_ws(', ', u, y), '') || '.', lab || '.', '{_P}.') AS mla,
    concat_ws(' ', fl || ',', '"' || bare || ',"', concat_ws(', ', lab, u, y) || '.') AS ieee, concat_ws(' ', lf || '.', '"' || bare || '."', concat_ws(', ', lab, u, y) || '.') AS chicago,
    concat_ws(' ', sh, '(' || coalesce(y, 'n.d.') || ')', '*' || bare || '*.', lab || '.', u || '.', '{_P}.') AS harvard FROM n""")
def citations(spark, sf_dir):
    rows, fields = _suppliers(spark, sf_dir)
    return cite.cited(rows, fields, cite.STYLES).select("k", *cite.STYLES)


@query(rf"""{_CITE} SELECT k, concat_ws(chr(10), 'TY  - THES', 'AU  - ' || lf, 'T1  - ' || ti, 'PY  - ' || y, 'PB  - ' || u, 'U1  - Tez No: ' || no, 'M3  - ' || kind, 'DB  - {_P}', 'UR  - ' || url, 'ER  - ') || chr(10) AS ris,
    (CASE WHEN kind IN ({", ".join(f"'{d}'" for d in cite.DOCTORAL)}) THEN '@phdthesis' ELSE '@mastersthesis' END) || '{{' || (CASE WHEN a IS NULL THEN 'thesis' ELSE regexp_replace(lower(f), '[^a-z0-9]', '', 'g') END) || coalesce(y, '') || ',' || chr(10)
    || concat_ws(',' || chr(10), '  author = {{' || lf || '}}', '  title = {{' || replace(replace(ti, '{{', '\{{'), '}}', '\}}') || '}}', '  school = {{' || u || '}}', '  year = {{' || y || '}}', '  type = {{' || kind || '}}', '  note = {{{_P}}}', '  url = {{' || url || '}}') || chr(10) || '}}' AS bibtex,
    '{{"type":"thesis"' || coalesce(',"title":"' || ti || '"', '') || (CASE WHEN a IS NULL THEN '' WHEN single THEN ',"author":[{{"family":"' || f || '"}}]' ELSE ',"author":[{{"given":"Ada-Bea Çi","family":"' || f || '"}}]' END)
    || coalesce(',"issued":{{"date-parts":[[' || y || ']]}}', '') || coalesce(',"genre":"' || kind || '"', '') || ',"publisher":"{_P}"' || coalesce(',"publisher-place":"' || u || '"', '') || ',"archive":"{_P}"' || coalesce(',"URL":"' || url || '"', '') || '}}' AS csl_json FROM n""".replace("{{", "{").replace("}}", "}"))
def citation_data(spark, sf_dir):
    rows, fields = _suppliers(spark, sf_dir)
    return cite.cited(rows, fields, ("ris", "bibtex", "csl_json")).select("k", "ris", "bibtex", "csl_json")


@query(f"""SELECT id, {fold_sql("title")} AS folded, {plain_sql("title")} AS plain, CASE WHEN id <> 3 THEN upper(translate(author, 'iı', 'İI')) END AS upper_tr, array_to_string({tokens_sql("title")}, '|') AS tokens,
    coalesce(contains({plain_sql("title")}, 'hakim'), false) AND title IS NOT NULL AS hakim, {_contains("author", "sule")} AND {_contains("author", "ozgur")} AS sule,
    coalesce(regexp_matches({plain_sql("title")}, '(^|[^\\p{{L}}\\p{{N}}])isci([^\\p{{L}}\\p{{N}}]|$)'), false) AS whole,
    coalesce(contains(upper(translate(author, 'iı', 'İI')), 'ILGIN IRMAK'), false) AS person FROM {_AT} a""")
def accented_rows(spark, sf_dir):
    t = F.col("title")
    return accents(spark).select(
        "id", fold(t).alias("folded"), plain(t).alias("plain"), F.when(F.col("id") != 3, upper_tr(F.col("author"))).alias("upper_tr"), F.array_join(tokens(t), "|").alias("tokens"), F.coalesce(fold_contains(t, "HÂKİM"), F.lit(False)).alias("hakim"),
        F.coalesce(retrieve.holds_terms(F.col("author"), "Özgür Şule"), F.lit(False)).alias("sule"), retrieve.keyword_filter([t], "işçi", "exact").alias("whole"),
        F.coalesce(F.contains(upper_tr(F.col("author")), upper_tr(F.lit("ılgın ırmak"))), F.lit(False)).alias("person"))


_NAMED = values_sql([(1, "Ada Kaya"), (2, "Ada Kaya"), (3, ""), (4, "Ada Kaya"), (5, "Can Ege Çelik"), (6, "KAYA ADA"), (7, "Kaya"), (8, "")], "id, name")


@query(f"SELECT n.id, name, s_suppkey, CASE WHEN n.id % 2 = 0 THEN s_name || ' Ada' ELSE 'Ada ' || s_name END AS whole FROM {_NAMED} n, supplier")
def name_functions(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name").crossJoin(F.broadcast(accents(spark)))
    titled = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Doç. Dr. Ada,  "), "s_name")).otherwise(F.concat(F.lit("Uzm. PROF.  "), F.lit("Ada "), "s_name"))
    return rows.select("id", person_name(F.col("advisor")).alias("name"), "s_suppkey", person_name(titled).alias("whole"))


@query(f"WITH {BIB} SELECT record_id, year FROM bib WHERE {_contains('advisor', 'building')} AND {_contains('advisor', 'nation')} AND {_contains('advisor', '4')} ORDER BY coalesce(year, 0) DESC, record_id LIMIT 100")
def person_listing(spark, sf_dir):
    return retrieve.by_person(bibliography(spark, sf_dir), "advisor", "building Nation_4", "record_id", 100).select("record_id", "year")


@query(f"WITH {BIB} SELECT record_id FROM bib WHERE {_contains('record_type', 'low')} AND {_contains('department', 'building')} AND year BETWEEN 1996 AND 1999 AND access_status = 'restricted' AND {_contains('advisor', 'nation')} AND {_contains('language', 'o')}")
def filter_bundle(spark, sf_dir):
    return retrieve.filtered(bibliography(spark, sf_dir), record_type="Low", department="building", first_year=1996, last_year=1999, access="RESTRICTED", advisor="Prof. nation".replace("Prof. ", ""), language="o").select("record_id")


@query(f"""WITH {BIB}, f AS (SELECT *, {" + ".join(f"contains({plain_sql('concat_ws(chr(32), title, author)')}, '{t}')::INT" for t in ("building", "nation_2"))} AS coverage,
    {" + ".join(f"contains({plain_sql('title')}, '{t}')::INT" for t in ("building", "nation_2"))} AS title_coverage FROM bib)
    SELECT record_id, coverage, title_coverage FROM (SELECT * FROM f WHERE coverage >= 1 ORDER BY coverage DESC, title_coverage DESC, coalesce(year, 0) DESC, record_id LIMIT 200)""".replace("'nation_2')::INT", "'nation')::INT + contains(" + plain_sql("concat_ws(chr(32), title, author)") + ", '2')::INT", 1).replace("'nation_2')::INT", "'nation')::INT + contains(" + plain_sql("title") + ", '2')::INT", 1))  # the underscore parts two terms
def relevance_sorted(spark, sf_dir):
    return retrieve.relevance(bibliography(spark, sf_dir), ["title", "author"], "title", "building nation_2", 1, "record_id").limit(200).select("record_id", "coverage", "title_coverage")


_SLICES = """WITH o AS (SELECT o_orderkey, year(o_orderdate)::INT AS y, o_orderpriority AS p, o_orderstatus AS s FROM orders), a AS (SELECT y, count(*) AS n FROM o GROUP BY 1), b AS (SELECT y, p, count(*) AS n FROM o GROUP BY 1, 2), c AS (SELECT y, p, s, count(*) AS n FROM o GROUP BY 1, 2, 3),
    asked AS (SELECT y, NULL AS p, NULL AS s, 1 AS depth, n FROM a UNION ALL SELECT y, p, NULL, 2, b.n FROM b JOIN a USING (y) WHERE a.n > 60 UNION ALL SELECT y, p, s, 3, c.n FROM c JOIN b USING (y, p) JOIN a USING (y) WHERE a.n > 60 AND b.n > 60),
    first40 AS (SELECT * FROM asked ORDER BY y NULLS FIRST, p NULLS FIRST, s NULLS FIRST LIMIT 40),
    r AS (SELECT o.*, n, row_number() OVER (PARTITION BY t.y, t.p, t.s ORDER BY o_orderkey) AS i FROM o JOIN first40 t ON o.y = t.y AND (t.p IS NULL OR o.p = t.p) AND (t.s IS NULL OR o.s = t.s))"""


def _collected(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"))
    return federate.collected(o, "o_orderkey", ["y", "p", "s"], 60, 40)


@query(f"{_SLICES} SELECT DISTINCT o_orderkey FROM r WHERE n <= 60 OR i <= 60")
def collected_rows(spark, sf_dir):
    return _collected(spark, sf_dir)[0].select("o_orderkey")


@query(f"{_SLICES} SELECT (SELECT count(*) FROM first40) AS requests, (SELECT count(DISTINCT o_orderkey) FROM r WHERE n <= 60 OR i <= 60) AS collected, (SELECT count(*) FROM o) AS total_found, (SELECT count(DISTINCT o_orderkey) FROM r WHERE n <= 60 OR i <= 60) = (SELECT count(*) FROM o) AS complete")
def collected_coverage(spark, sf_dir):
    return _collected(spark, sf_dir)[1]


def _frontier(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"))
    domains = [o.select("y").distinct(), o.select("p").distinct(), o.select("s").distinct()]  # what a form offers
    return harvest.frontier(harvest.table_source(o, "o_orderkey", ["y", "p", "s"], 60), domains, ["y", "p", "s"], "o_orderkey", store.own_folder(spark, "frontier"), 40)


@query(SQL["collected_rows"])
def frontier_rows(spark, sf_dir):
    """The same rows from a source that tells its counts only when it is asked."""
    return _frontier(spark, sf_dir)[0].select("o_orderkey")


@query(SQL["collected_coverage"])
def frontier_coverage(spark, sf_dir):
    return _frontier(spark, sf_dir)[1]


@query("""WITH c AS (SELECT year(o_orderdate)::VARCHAR || '|' || o_orderpriority AS slice, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT slice, CASE WHEN n > 400 OR y = 1996 THEN 2 ELSE 1 END AS runs, CASE WHEN n > 400 THEN 'incomplete' ELSE 'complete' END AS status, n AS found, least(n, 400) AS shown FROM c""")
def harvest_runs(spark, sf_dir):
    """Slices by year and priority, harvested twice: in the first run the requests of one year fail, in the second they and the
    incomplete ones are asked again."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("p"))
    slices, path = o.select("y", "p").distinct().withColumn("slice", federate.slice_key("y", "p")), store.own_folder(spark, "harvest")
    harvest.harvest(slices, harvest.table_source(o, "o_orderkey", ["y", "p"], 400, broken=F.col("y") == 1996), path)
    return harvest.harvest(slices, harvest.table_source(o, "o_orderkey", ["y", "p"], 400), path).drop("error")


_DIMENSIONS = ("year", "record_type", "department", "language", "advisor", "institution")


@query(f"WITH {BIB} " + " UNION ALL ".join(f"""SELECT '{d}' AS dimension, {"NULL" if d == "all" else d + "::VARCHAR"} AS value, count(*) AS n, count(*) FILTER (WHERE access_status = 'open') AS open,
    min(year) AS first_year, max(year) AS last_year, count(DISTINCT author) AS people FROM bib{"" if d == "all" else " GROUP BY " + d}""" for d in (*_DIMENSIONS, "all")))
def production_dimensions(spark, sf_dir):
    """Records and different authors by year, type, department, language, advisor and institution in one scan."""
    return federate.production_by(bibliography(spark, sf_dir), _DIMENSIONS, "author")


@query("""WITH RECURSIVE a AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1 UNION ALL
    SELECT a.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = a.user_id AND e.ts >= a.ts + INTERVAL 6 HOUR) AS ts FROM a WHERE a.ts IS NOT NULL) SELECT user_id, ts FROM a WHERE ts IS NOT NULL""")
def asked_again(spark, sf_dir):
    """Which requests of a stream reach the source if what it has answered stays warm for six hours."""
    from ..streaming.warm import asked_again as passed

    events, path = read(spark, sf_dir, "events"), store.own_folder(spark, "asked")
    schema = ", ".join(f"{n} {t}" for n, t in events.dtypes)
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    done = passed(stream, "user_id", "ts", 6 * 3600).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(f"""WITH {BIB} SELECT record_type, department, advisor, count(*) AS n, count(*) FILTER (WHERE access_status = 'open') AS open, min(year) AS first_year, max(year) AS last_year,
    min(record_id) AS first_id FROM bib GROUP BY ROLLUP (record_type, department, advisor)""")
def production_people(spark, sf_dir):
    return federate.production(bibliography(spark, sf_dir), ["record_type", "department", "advisor"], "record_id")


@query("""WITH c AS (SELECT year(o_orderdate) AS y, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT count(*) AS slices, sum(n)::BIGINT AS "rows", count(*) FILTER (WHERE n > 400) AS incomplete, bool_and(n <= 400) AS complete FROM c""")
def harvest_totals(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y"), "o_orderpriority").agg(F.count("*").alias("rows"))
    return federate.harvest_totals(o.withColumn("complete", F.col("rows") <= 400))


@query(f"""WITH rec AS (SELECT doc_id AS record_id, CASE WHEN lang = 'en' THEN 'renewed title' ELSE string_split(text, chr(10))[1] END AS title, source AS institution FROM documents),
    p AS (SELECT record_id, unnest({tokens_sql("title")}) AS term FROM rec UNION ALL SELECT record_id, unnest({tokens_sql("institution")}) FROM rec),
    n AS (SELECT count(DISTINCT record_id) AS docs FROM rec) SELECT term, count(DISTINCT record_id) AS df, count(*) AS n, any_value(docs) AS docs, (SELECT count(*) FROM p) AS words FROM p, n GROUP BY term""")
def index_upsert(spark, sf_dir):
    """A stored index after all English records got a new title: old tokens are gone, the corpus figures follow."""
    rows, path = records(spark, sf_dir, ("record_id", "title", "institution", "language")), store.own_folder(spark, "upserted")
    weights = {"title": 5.0, "institution": 2.0}
    write_index(rows, "record_id", weights, path)
    upsert_index(rows.where("language = 'en'").withColumn("title", F.lit("renewed title")), "record_id", weights, path)
    index = read_index(spark, path, "record_id")
    return index.postings.where("term is not null").groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("n")).withColumns({"docs": F.lit(index.docs), "words": F.lit(index.words)})
