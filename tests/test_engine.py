"""Cases of the engine, the stored index, extraction, citations and upkeep that the tables don't show."""

import pytest
from pyspark.sql import functions as F

from shelfspark.engine import Engine
from shelfspark.functions import text
from shelfspark.operators import cite, federate, fulltext, retrieve
from shelfspark.operators.index import Index, compact, index_of, postings, read_index, upsert_index, write_index
from shelfspark.sources import cards, detail, dictionary, store
from shelfspark.sources.records import canonical
from shelfspark.streaming.warm import warm, warmed

ROWS = [
    ("1", "Yapay zekâ ve hukuk", "Ayşe Işık", "Prof. Dr. Ada Kaya", "ANKARA ÜNİVERSİTESİ", "Doktora", 2020, ["yapay zeka", "hukuk"], "open"),
    ("2", "Hâkim bağımsızlığı", "Can Öz", "Kaya, Ada", "ANKARA ÜNİVERSİTESİ", "Yüksek Lisans", 2022, ["hâkim"], "restricted"),
    ("3", "Artificial intelligence", "Zoë Li", None, "EGE ÜNİVERSİTESİ", "Doktora", 2015, ["yapay zeka"], "unknown"),
    ("4", "Tarih", "Ayşe Öz", "Ada Kaya", None, None, None, None, "open"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return canonical(spark.createDataFrame(ROWS, "record_id string, title string, author string, advisor string, institution string, record_type string, year int, keywords array<string>, access_status string"))


def ids(df):
    return [r.record_id for r in df.collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_accents_meet_on_both_sides(spark, rows):
    assert ids(rows.where(retrieve.keyword_filter([F.col("title")], "HÂKİM"))) == ["2"] == ids(rows.where(retrieve.keyword_filter([F.col("title")], "hakim", "exact")))
    assert ids(retrieve.by_person(rows, "author", "isik ayse")) == ["1"]
    assert text.analysed("ya da veya with for üzerine") == ["with", "for", "uzerine"]
    assert one(spark, text.person_name(F.lit("Dr. Öğretim Üyesi Kaya, Ada"))) == "Ada Kaya"


def test_queries_without_terms(spark, rows):
    e = Engine(rows)
    assert ids(e.search("the ve of").hits) == [] and "stopwords" in e.search("the ve").coverage.first()["notes"][0]
    assert ids(retrieve.by_person(rows, "author", "the of")) == [] and ids(retrieve.by_institution(rows, "", "record_id")) == []
    assert retrieve.bm25(index_of(rows, "record_id", {"title": 1.0}), []).count() == 0
    for call in (lambda: e.search(" "), lambda: e.search("x", field="y"), lambda: e.search("x", sort="y"), lambda: e.by_person("author", ""), lambda: e.by_person("x", "y"), lambda: e.by_institution(""),
                 lambda: e.record(""), lambda: e.facets("x"), lambda: e.related("99"), lambda: retrieve.keyword_search(rows, "", "title"), lambda: retrieve.keyword_filter([F.col("title")], "x", "y")):
        with pytest.raises(ValueError):
            call()


def test_search_filters_before_ranking(rows):
    e = Engine(rows)
    assert ids(e.search("yapay zeka").hits) == ["1", "3"] and ids(e.search("yapay zeka", sort="newest").hits) == ["1", "3"]
    assert ids(e.search("yapay zeka", institution="ege", last_year=2015).hits) == ["3"] and ids(e.search("yapay", access="open").hits) == ["1"]
    c = e.search("yapay zeka", limit=1).coverage.first()
    assert (c.source, c.total_found, c.index_hits, c["count"], c.coverage_complete) == ("index", None, 2, 1, True)


def test_second_source(spark, rows):
    e = Engine(rows.where("record_id <> '3'"), rows.where("record_id <> '1'"), cap=1)
    found = e.search("ada kaya", field="advisor")
    assert ids(found.hits) == ["1", "2", "4"][: len(ids(found.hits))] or set(ids(found.hits)) <= {"1", "2", "4"}
    c = e.by_person("advisor", "Prof. Kaya, Ada").coverage.first()
    assert c.total_found == 1 and c.source == "hybrid"
    assert e.search("nothing here").coverage.first()["source"] == "live"
    places = spark.createDataFrame([("1", "ANKARA ÜNİVERSİTESİ"), ("2", "EGE ÜNİVERSİTESİ")], "code string, name string")
    e = Engine(rows, rows, institutions=places, cap=1)
    c = e.by_institution("ankara").coverage.first()
    assert (c.total_found, c.shown_live, c.coverage_complete) == (2, 1, False)
    c = e.by_institution("ankara", exhaustive=True).coverage.first()
    assert (c.total_found, c.coverage_complete) == (2, True)
    assert "dictionary" in e.by_institution("nowhere").coverage.first()["notes"][0]


def test_related_leaves_itself_out(rows):
    assert ids(Engine(rows).related("1").hits) == ["3"]
    found = Engine(rows.where("record_id = '2'"), rows).related("2")
    assert ids(found.hits) == [] or "2" not in ids(found.hits)


def test_listings_are_sorted(rows):
    assert ids(retrieve.by_person(rows, "advisor", "kaya ada", "record_id")) == ["2", "1", "4"]
    assert ids(retrieve.by_institution(rows, "ankara", "record_id", record_type="lisans")) == ["2"]
    assert ids(retrieve.relevance(rows, ["title", "author"], "title", "ayse hukuk", 1, "record_id")) == ["1", "4"]


def test_stored_index(spark, rows, tmp_path):
    path, weights = f"file:{tmp_path}/index", {"title": 5.0, "keywords": 2.0}
    assert read_index(spark, path, "record_id", "string").is_empty() and retrieve.bm25(read_index(spark, path, "record_id", "string"), ["x"]).count() == 0
    write_index(rows, "record_id", weights, path)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(retrieve.bm25(read_index(spark, path, "record_id"), ["yapay"]), retrieve.bm25(index_of(rows, "record_id", weights), ["yapay"]))
    changed = rows.where("record_id = '3'").withColumn("title", F.lit("renewed")).union(rows.where("record_id = '3'").withColumns({"record_id": F.lit("9"), "title": F.lit("ninth renewed")}))
    whole = rows.where("record_id <> '3'").union(changed)
    for step in (lambda: upsert_index(changed, "record_id", weights, path), lambda: upsert_index(changed, "record_id", weights, path), lambda: compact(spark, path, "record_id")):
        step()
        index = read_index(spark, path, "record_id")
        assert index.docs == 5 and same(index.postings.select("record_id", "term", "f", "n", "dl"), postings(whole, "record_id", weights))
        assert ids(retrieve.bm25(index, ["artificial"])) == [] and sorted(ids(retrieve.bm25(index, ["renewed"]))) == ["3", "9"]
    assert len(store.versions(spark, f"{path}/manifest")) == 4


CARD = '<div class="result-card" data-index="{i}" data-kayitno="{r}" data-tezno="t"><div class="card-title"> Bir\n <b>iki</b> </div><div class="card-info" style="font-style: italic">One &#8203;two</div><div class="card-info"><strong>Tez No:</strong> 12</div></div>'


def test_result_pages(spark):
    meta = '"0": {"meta": {"author": "A B", "year": "x", "yer": "UNI / ", "type": ""}},\n\n }'
    pages = [
        (1, '<div class="result-count-text" id="x">2.059 kayıt\n2.000 tane</div>' + CARD.format(i=0, r="r0") + CARD.format(i=1, r="") + CARD.format(i=2, r="r2") + f"<script>let referenceData = {{{meta};\n</script>"),
        (2, '<div class="result-count-text">0 kayıt bulundu.</div><script>const referenceData = {};\n</script>'), (3, "Geçersiz sorgulama"), (4, "<h1>Hata Oluştu</h1>"), (5, None),
    ]
    df = spark.createDataFrame(pages, "page_id int, html string")
    got = [tuple(r) for r in cards.hits(df.where("page_id < 3")).drop("page_id", "pos").collect()]
    assert got == [("r0", "t", "12", "Bir iki", "One ​two", "A B", None, "UNI", None), ("r2", "t", "12", "Bir iki", "One ​two", None, None, None, None)]
    told = {r.page_id: (r.total_found, r.shown, r.coverage_complete, r.error) for r in cards.result_pages(df).select("page_id", "coverage.*", "error").collect()}
    assert told[1] == (2059, 2000, False, False) and told[2] == (0, 0, True, False) and all(told[k][3] for k in (3, 4, 5))
    with pytest.raises(Exception, match="error page 4"):
        cards.hits(df.where("page_id = 4")).collect()


def test_details_and_access(spark):
    apa = "KILIÇ, Z. (2026). <i>Bir &amp; iki</i> (Tez No. 77) [Tıpta Yan Dal uzmanlık tezi, UNI]. X."
    d = detail.apa_reference(F.lit(apa))
    assert tuple(one(spark, d)) == ("Z. KILIÇ", 2026, "Bir & iki", "77", "Tıpta Yan Dal Uzmanlık")
    assert tuple(one(spark, detail.apa_reference(F.lit("nothing")))) == (None,) * 5 == tuple(one(spark, detail.apa_reference(F.lit(None).cast("string"))))
    assert tuple(one(spark, detail.access(F.lit("<a href='TezGoster?key=ab_c-1'target='_blank'>")))) == ("open", None, "ab_c-1")
    assert tuple(one(spark, detail.access(F.lit("<span class='pdf-info-msg'>kapalı <b>2030</b></span>")))) == ("restricted", "kapalı 2030", None)
    assert tuple(one(spark, detail.access(F.lit("")))) == ("unknown", None, None)
    bare = detail.details(spark.createDataFrame([("1", '\n{"yer": "U / I / D", "trOzet": "", "anahtarKelimeTr": "<strong></strong>"}')], "record_id string, body string")).first()
    assert (bare.institution, bare.branch, bare.abstract, bare.keywords, bare.author) == ("U", None, None, [], None)


def test_dictionaries(spark, tmp_path):
    places = spark.createDataFrame([("1", "EGE ÜNİVERSİTESİ", "x")], "code string, name string, second_code string")
    dictionary.write_dictionary(str(tmp_path / "d"), dictionary.code_table(spark), places, places.select("code", "name"), "2026-01-01")
    back = dictionary.read_dictionary(spark, str(tmp_path / "d"))
    assert back["codes"].count() == sum(len(t) for t in dictionary.CODES.values()) and back["institutions"].first()["built_at"] == "2026-01-01"
    assert dictionary.found(places, "universitesi").count() == 1 and dictionary.found(places, "").count() == 0
    e = Engine(spark.createDataFrame([("1", "x", 2000)], "record_id string, title string, year int"), institutions=places)
    items, count = e.facets("universities", "ege")["universities"]
    assert items.count() == count.first()["count"] == 1 and set(e.facets()) == {"enums", "universities"}


def test_citation_rules(spark):
    f = lambda **k: {n: F.lit(v) for n, v in k.items()}
    cite1 = lambda style, **k: cite.citation(spark.range(1), f(**k), style).first()["citation"]
    assert cite1("APA") == "(n.d.). [Tez]. National Thesis Centre."
    assert cite1(" mla ", author="Madonna") == "Madonna. Tez. National Thesis Centre."
    assert cite1("ieee", title="X.", record_type="Proje") == '"X," Proje tezi.'
    assert cite1("chicago", author="A-B Çi Öz", title="X", year="1999") == 'Öz, A-B Çi. "X." Tez, 1999.'
    assert cite1("harvard", author="A-B Çi Öz", institution="U") == "Öz, A.-B. Ç. (n.d.) Tez. U. National Thesis Centre."
    whole = cite.cited(spark.range(1), f(author="Ali İŞÇİOĞLU", title="{a\\b}", year="2001a", record_type="Yüksek Lisans"), ("bibtex", "ris", "csl_json")).first()
    assert whole.bibtex.startswith("@mastersthesis{iscioglu2001a,\n") and "  title = {\\{a\\textbackslash\\{\\}b\\}}" in whole.bibtex
    assert whole.ris.startswith("TY  - THES\nAU  - İŞÇİOĞLU, Ali\n") and whole.ris.endswith("\nER  - \n") and '"issued":{"date-parts":[["2001a"]]}' in whole.csl_json
    assert cite.cited(spark.range(1), {}, ("bibtex",)).first()["bibtex"] == "@mastersthesis{thesis,\n  note = {National Thesis Centre}\n}"
    for style in ("xml", "", None):
        with pytest.raises(ValueError):
            cite.citation(spark.range(1), {}, style)


def test_headings(spark):
    lines = {"1.2 GİRİŞ": True, "1. Giriş": True, "IV) KAYNAKÇA": True, "A. Özet": True, "Gereç ve Yöntem": True, "GİRİŞ ve amaç": False, "x" * 81: False, "": False, "12 maymun": False}
    got = spark.createDataFrame([(x,) for x in lines], "l string").select("l", fulltext.is_heading(F.col("l")).alias("h")).collect()
    assert {r.l: r.h for r in got} == lines
    docs = spark.createDataFrame([(1, "ön\n1. GİRİŞ\nbir\n\nSONUÇ\n\nKAYNAKLAR\n[1]\n"), (2, "no heading"), (3, None), (4, "GİRİŞ")], "k int, t string")
    got = {r.k: [tuple(s) for s in r.sections] for r in fulltext.split_sections(docs, "t").collect()}
    assert got == {1: [(fulltext.BEFORE, "ön"), ("1. GİRİŞ", "bir"), ("KAYNAKLAR", "[1]")], 2: [], 3: [], 4: []}


def test_page_windows(spark):
    docs = spark.createDataFrame([(1, ["ÖZET\nbu bir metindir", "", "son sayfa metni"]), (2, None), (3, ["ܐܒܓܕܗܘܙܚܛܝܟܠܡܢܣ"])], "k int, pages array<string>")
    got = {r.k: r for r in fulltext.extracted(docs, start=2, most=1).collect()}
    assert (got[1].start_page, got[1].end_page, got[1].has_more, got[1].has_text) == (2, 2, True, False) and "_(boş" in got[1].markdown and "no pages" in got[2].note
    got = {r.k: r for r in fulltext.extracted(docs, start=9).collect()}
    assert not got[1].has_text and "no pages" in got[1].note
    got = {r.k: r for r in fulltext.extracted(docs).collect()}
    assert got[1].reliable and [s.heading for s in got[1].sections] == ["ÖZET"] and got[3].has_text and not got[3].reliable and got[3].sections == []


def test_closed_files_are_not_read(spark, tmp_path):
    for name, data in (("a", b"%PDF-1.4 x"), ("b", b"%PDF"), ("c", b"<html>"), ("d", b"%PDF" + b"x" * 100)):
        (tmp_path / name).write_bytes(data)
    records = spark.createDataFrame([("1", "open", "a"), ("2", "restricted", "b"), ("3", "open", "c"), ("4", "open", "d"), ("5", "open", None)], "record_id string, access_status string, content_key string")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert ids(fulltext.guarded_files(files, records, most_bytes=50)) == ["1"]


def test_harvest_marks(spark, tmp_path):
    path, slices = f"file:{tmp_path}/done", spark.createDataFrame([("a",), ("b",), ("c",)], "slice string")
    assert federate.pending(slices, federate.done_slices(spark, path)).count() == 3
    federate.mark_done(slices.where("slice = 'a'"), path)
    federate.mark_done(slices.where("slice = 'b'"), path, "incomplete")
    assert sorted(r.slice for r in federate.pending(slices, federate.done_slices(spark, path)).collect()) == ["b", "c"]
    assert federate.years("2015-2017") == [2015, 2016, 2017] and federate.years("2020,2022") == [2020, 2022] and federate.years(" 2023 ") == [2023]
    with pytest.raises(ValueError):
        federate.mark_done(slices, path, "x")


def test_rows_without_key_merge_with_nothing(spark):
    df = spark.createDataFrame([(None, 1, "a"), ("", 2, "b"), ("k", 3, "x"), ("k", 3, "y")], "id string, o int, p string")
    assert list(map(tuple, federate.merged(df, "id", "o").collect())) == [("k", 3, "y")]


def test_stream_keeps_late_values_and_fails_on_a_lost_version(spark, tmp_path):
    schema, path, ck = "id int, o int, p string, q string", f"file:{tmp_path}/table", str(tmp_path / "ck")
    batches = [[(1, 5, None, "q5"), (2, 1, "p1", None)], [(1, 3, "p3", "q3"), (3, 1, None, None)], [(1, 4, "p4", None)], [(2, 0, "p0", "q0")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        warm(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "id", "o", path, ck, compact_every=3).awaitTermination()
        whole = spark.createDataFrame([r for b in batches[: i + 1] for r in b], schema)
        assert sorted(map(str, warmed(spark, path, "id", "o").collect())) == sorted(map(str, federate.merged(whole, "id", "o").collect()))
    assert store.versions(spark, f"{path}/base") == [2] and store.versions(spark, path) == [2, 3]
    store.drop(spark, f"{path}/v=3")
    spark.createDataFrame(batches[0], schema).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="missing"):
        warm(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "id", "o", path, ck).awaitTermination()


def test_windows_drop_late_events(spark, tmp_path):
    import os

    from shelfspark.streaming.warm import windowed

    schema, source = "ts timestamp, event_type string, value double", tmp_path / "in"
    # Spark drops late rows by the watermark of the batch before, so the late one comes in the third batch
    files = [[("10:00", 1.0), ("13:00", 2.0)], [("13:20", 0.5)], [("10:05", 5.0), ("13:30", 0.5)], [("20:00", 1.0)]]
    for i, rows in enumerate(files):
        df = spark.createDataFrame([(f"2024-01-01 {t}:00", "a", v) for t, v in rows], "t string, event_type string, value double")
        df.select(F.col("t").cast("timestamp").alias("ts"), "event_type", "value").coalesce(1).write.mode("append").parquet(str(source))
        for name in os.listdir(source):
            if name.endswith(".parquet") and not (tmp_path / name).exists():
                (tmp_path / name).touch()
                os.utime(source / name, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = windowed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    stream.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((str(r.start)[11:16], r.n, r.total) for r in spark.table("windows").collect())
    assert got == [("10:00", 1, 1.0), ("13:00", 3, 3.0)]


def test_one_question_reads_records_once(spark, tmp_path, monkeypatch):
    """An index that is not stored answers from one row a record, with the scores of a stored one, and makes no postings."""
    rows = [(i % 9, "alpha beta " * (i % 3) + f"gam{i % 5}", None if i % 4 else "Alpha x") for i in range(9)] + [(9, None, None), (10, "the", "betas alp")]
    df, weights = spark.createDataFrame(rows, "id long, title string, body string"), {"title": 2.0, "body": 0.5}
    write_index(df, "id", weights, f"file:{tmp_path}/i")
    asks = [(["alp", "beta", "alp"], False, None), (["alpha", "gam"], True, None), (["alp"], True, ["body"]), (["nothing"], False, None)]
    told = lambda index: [sorted((x.id, x.score) for x in retrieve.bm25(index, t, e, c).select("id", F.round("score", 9).alias("score")).collect()) for t, e, c in asks]
    want = told(read_index(spark, f"file:{tmp_path}/i", "id"))
    monkeypatch.setattr(Index, "weighted", None)
    assert told(index_of(df, "id", weights)) == want and [len(x) > 0 for x in want] == [True, True, True, False]
