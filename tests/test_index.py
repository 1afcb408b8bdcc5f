"""The positional index: phrases, fields, exact top-k, and commits of several writers and readers."""

import random
import threading
from math import log

import pytest
from pyspark.sql import functions as F

from shelfspark.engine import Engine
from shelfspark.functions import text
from shelfspark.operators import index as ix
from shelfspark.operators import retrieve
from shelfspark.operators.index import compact, expire, index_of, placed, postings, read_index, upsert_index, write_index
from shelfspark.sources import store
from shelfspark.sources.records import canonical

WEIGHTS = {"title": 5.0, "body": 1.0}
SCHEMA = "id long, title string, body string, year int"


def corpus(n=400, seed=2):
    r = random.Random(seed)
    words = ["alpha", "alphabet", "beta", "bet", "gamma", "the", "of", "ça", "Ål", "x1"]
    say = lambda k: " ".join(r.choices(words, weights=[9, 2, 7, 3, 2, 9, 9, 1, 1, 1], k=k)) + r.choice(["", ".", " - beta, gamma!"])
    rows = [(i, say(r.randint(1, 6)), say(r.choice([0, 3, 30, 200])), r.choice([None, *range(1990, 2030)])) for i in range(n)]
    return rows + [(n, None, None, None), (n + 1, "", "--", 2000), (n + 2, "alpha " * 40, "alpha beta", 2029)]


def tokens(t):
    return text.analysed(t or "", keep_stopwords=True)


def brute_scores(rows, terms, columns=(1, 2)):
    weights = {1: 5.0, 2: 1.0}
    dl = {r[0]: len(tokens(r[1])) + len(tokens(r[2])) for r in rows}
    mean, out, idf = sum(dl.values()) / len(rows), {}, {}
    f = {t: {r[0]: sum(weights[c] * sum(x.startswith(t) for x in tokens(r[c])) for c in columns) for r in rows} for t in set(terms)}
    for t in f:
        df = sum(v > 0 for v in f[t].values())
        idf[t] = max(log((len(rows) - df + 0.5) / (df + 0.5)), 1e-6)
    for r in rows:
        if all(f[t][r[0]] for t in f):
            out[r[0]] = -sum(idf[t] * f[t][r[0]] * 2.2 / (f[t][r[0]] + 1.2 * (0.25 + 0.75 * dl[r[0]] / mean)) for t in terms)
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("column", F.lit("x")).repartition(3)


@pytest.fixture(scope="module")
def stored(spark, frame, tmp_path_factory):
    path = f"file:{tmp_path_factory.mktemp('stored')}/index"
    write_index(frame.where("id % 3 <> 0"), "id", WEIGHTS, path)
    upsert_index(frame.where("id % 3 = 0"), "id", WEIGHTS, path)
    return read_index(spark, path, "id")


def test_places_and_postings(spark, frame, rows):
    want = {}
    for i, *cols, _ in rows:
        for c, t in zip(WEIGHTS, cols, strict=True):
            for p, w in enumerate(tokens(t)):
                want.setdefault((i, c, w), []).append(p)
    out = placed(frame, "id", WEIGHTS).collect()
    assert {(r.id, r.column, r.term): r.positions for r in out if r.term is not None} == want
    assert all(r.n == len(r.positions) for r in out) and sorted(r.id for r in out if r.lead) == [r[0] for r in rows]
    assert sorted(r.id for r in out if r.term is None) == sorted(r[0] for r in rows if not tokens(r[1]) and not tokens(r[2]))
    whole = {(r.id, r.term): (r.f, r.n, r.dl) for r in postings(frame, "id", WEIGHTS).collect()}
    assert whole == {(r.id, r.term): (r.f, r.n, r.dl) for r in index_of(frame, "id", WEIGHTS).postings.collect()}
    assert postings(frame.limit(0), "id", WEIGHTS).count() == 0


@pytest.mark.parametrize(("terms", "columns"), [(["alpha", "bet"], None), (["bet", "bet", "g"], None), (["nothing"], None), (["ca"], ["title"]), (["of", "the", "alphabet"], ["body"]), (["alpha"], ["title"])])
def test_scores_in_fields(stored, rows, terms, columns):
    want = brute_scores(rows, terms, (1, 2) if columns is None else ((1,) if columns == ["title"] else (2,)))
    got = {r.id: r.score for r in retrieve.bm25(stored, terms, columns=columns).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_document_frequencies(stored, frame, rows):
    terms = ["a", "al", "alp", "alph", "alpha", "alphabet", "b", "zz", "the", "c"]
    want = {t: sum(any(x.startswith(t) for c in (1, 2) for x in tokens(r[c])) for r in rows) for t in terms}
    assert stored.prefixes is not None and retrieve.document_frequencies(stored, terms) == want == retrieve.document_frequencies(index_of(frame, "id", WEIGHTS), terms)


@pytest.mark.parametrize(("query", "k"), [("alpha beta", 7), ("x1 alpha", 1), ("alphabet alphabet", 7), ("nothing", 1), ("the of", 1), ("bet gamma alpha", 5000)])
def test_top_is_exact(stored, frame, query, k, monkeypatch):
    monkeypatch.setattr(retrieve, "FIRST_WAVE", 1)
    for own in (frame, frame.where("id % 50 = 7 or year < 1992")):
        key = lambda df: [(r.id, r.score) for r in df.select("id", F.round("score", 7).alias("score")).collect()]
        whole = retrieve.ranked(stored, own, query, abstract="body").withColumn("score", F.round("score", 9)).orderBy("score", "id").limit(k)
        assert key(retrieve.top_ranked(stored, own, query, k, abstract="body")) == key(whole)


def _joined(df):
    """Rows that the joins of a plan have given."""
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName():
            rows += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_top_reads_and_joins_less(spark, tmp_path):
    """Blocks without a chance are not read, records without one not joined, as the plan's row counts show."""
    rows = [(i, "rare rare rare" if i < 20 else "plain title", "word " * (3 if i % 2 else 200) + ("rare" if i % 10 == 0 else ""), 2000) for i in range(1000)]
    frame, path = spark.createDataFrame(rows, SCHEMA), f"file:{tmp_path}/index"
    write_index(frame, "id", WEIGHTS, path)
    index = read_index(spark, path, "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        whole = retrieve.ranked(index, frame, "rare", abstract="body").withColumn("score", F.round("score", 9)).orderBy("score", "id").limit(5)
        top = retrieve.top_ranked(index, frame, "rare", 5, abstract="body")
        assert [r.id for r in whole.collect()] == [r.id for r in top.collect()]
        assert _joined(whole) >= 118 and _joined(top) <= 20
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize(("words", "prefix"), [(["alpha", "beta"], False), (["alpha", "bet"], True), (["the"], False), (["bet"], True), (["beta", "gamma"], False), (["of", "of", "of"], False), (["of", "the", "a"], True), ([], True)])
def test_phrases(stored, rows, words, prefix):
    want = set()
    for i, *cols, _ in rows:
        for c, t in zip(WEIGHTS, cols, strict=True):
            own = tokens(t)
            for p in range(len(own) - len(words) + 1 if words else 0):
                if own[p : p + len(words) - 1] == words[:-1] and (own[p + len(words) - 1].startswith(words[-1]) if prefix else own[p + len(words) - 1] == words[-1]):
                    want.add((i, c, p))
    got = retrieve.phrase(stored, words, last_prefix=prefix).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_phrase_search_agrees_with_texts(stored, frame):
    """On texts whose words are parted by single blanks it finds what the search of texts finds."""
    bare = frame.withColumns({c: F.array_join(text.tokens(F.col(c)), " ") for c in ("title", "body")})
    for op in ("and", "or", "not"):
        for query in ("alpha beta", "alpha beta gamma", "the"):
            test = retrieve.keyword_filter([F.col("title"), F.col("body")], query, "exact", op)
            want = sorted(r.id for r in bare.where(test).collect())
            assert sorted(r.id for r in retrieve.phrase_search(stored, query, ["title", "body"], "exact", op).collect()) == want
    for call in (lambda: retrieve.phrase_search(stored, " "), lambda: retrieve.phrase_search(stored, "a", "nope"), lambda: retrieve.phrase_search(stored, "a", match="x"), lambda: retrieve.phrase_search(stored, "a b", op="xor")):
        with pytest.raises(ValueError):
            call()


def live(spark, path, key="id"):
    return {(r[key], r.term): (r.f, r.n, r.dl) for r in read_index(spark, path, key).postings.collect()}


def built(frame, key="id"):
    return {(r[key], r.term): (r.f, r.n, r.dl) for r in postings(frame, key, WEIGHTS).collect()}


def test_readers_outlive_compaction(spark, frame, tmp_path):
    path = f"file:{tmp_path}/index"
    write_index(frame, "id", WEIGHTS, path)
    changed = frame.where("id < 40").withColumn("title", F.lit("renewed"))
    upsert_index(changed, "id", WEIGHTS, path)
    before = read_index(spark, path, "id")
    assert before.prefixes is None  # some of its records are deleted
    compact(spark, path, "id")
    write_index(frame.where("id < 3"), "id", WEIGHTS, path)
    whole = built(frame.where("id >= 40").union(changed))
    assert {(r.id, r.term): (r.f, r.n, r.dl) for r in before.postings.collect()} == whole
    assert expire(spark, path, seconds=3600) == [] and {(r.id, r.term): (r.f, r.n, r.dl) for r in before.postings.collect()} == whole
    third = read_index(spark, path, "id", version=3)  # the compacted one
    assert third.prefixes is not None and {(r.id, r.term): (r.f, r.n, r.dl) for r in third.postings.collect()} == whole
    assert retrieve.document_frequencies(third, ["rene", "al"]) == retrieve.document_frequencies(before, ["rene", "al"])
    assert expire(spark, path, seconds=0, keep=1) == [1, 2, 3]
    assert len(store.listed(spark, f"{path}/segments")) == 1 and store.listed(spark, f"{path}/deleted") == []
    assert live(spark, path) == built(frame.where("id < 3")) and store.versions(spark, f"{path}/manifest") == [4]
    spark.range(1).write.parquet(f"{path}/segments/left-by-a-dead-writer")
    assert expire(spark, path) == [] and len(store.listed(spark, f"{path}/segments")) == 2
    assert expire(spark, path, orphan_seconds=0) == [] and len(store.listed(spark, f"{path}/segments")) == 1
    assert live(spark, path) == built(frame.where("id < 3"))
    upsert_index(changed, "id", WEIGHTS, path)  # numbers go on
    assert store.versions(spark, f"{path}/manifest") == [4, 5]


def test_two_writers_lose_nothing(spark, frame, tmp_path, monkeypatch):
    path = f"file:{tmp_path}/index"
    write_index(frame, "id", WEIGHTS, path)
    parts = [frame.where(f"id between {20 * i} and {20 * i + 25}").withColumn("title", F.lit(f"renewed w{i}")) for i in range(3)]
    failed = []

    def write(i):
        try:
            upsert_index(parts[i], "id", WEIGHTS, path)
        except Exception as e:  # the thread's failure is the test's
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and store.versions(spark, f"{path}/manifest") == [1, 2, 3, 4]
    index = read_index(spark, path, "id")
    per = {r.id: r for r in index.places.where("term like 'w_'").groupBy("id").agg(F.count("*").alias("n"), F.max("term").alias("w")).collect()}
    assert set(per) == set(range(66)) and all(r.n == 1 for r in per.values()) and index.docs == frame.count()
    assert index.words == sum({r.id: r.dl for r in index.places.collect()}.values())


def test_compaction_beside_an_upsert(spark, frame, tmp_path, monkeypatch):
    """An upsert that commits while a compaction writes is not undone by it."""
    path = f"file:{tmp_path}/index"
    write_index(frame, "id", WEIGHTS, path)
    upsert_index(frame.where("id < 10").withColumn("title", F.lit("second")), "id", WEIGHTS, path)
    commit = ix._commit

    def late(s, p, change):
        monkeypatch.setattr(ix, "_commit", commit)
        upsert_index(frame.where("id < 5").withColumn("title", F.lit("third")), "id", WEIGHTS, path)
        commit(s, p, change)

    monkeypatch.setattr(ix, "_commit", late)
    compact(spark, path, "id")
    whole = frame.where("id >= 10").union(frame.where("id between 5 and 9").withColumn("title", F.lit("second"))).union(frame.where("id < 5").withColumn("title", F.lit("third")))
    assert live(spark, path) == built(whole) and read_index(spark, path, "id").docs == whole.count()


def test_create_once(spark, tmp_path):
    path = f"file:{tmp_path}/log/one"
    assert store.create_once(spark, path, {"a": "ğ"}) and not store.create_once(spark, path, {"a": 2})
    assert store.read_document(spark, path) == {"a": "ğ"} and store.listed(spark, f"file:{tmp_path}/log") == ["one"]


def test_create_once_by_rename(spark, tmp_path, monkeypatch):
    """What other filesystems than local mounts do."""
    from urllib.parse import ParseResult

    monkeypatch.setattr(store, "urlparse", lambda p: ParseResult("other", "", p, "", "", ""))
    path = f"file:{tmp_path}/log/one"
    assert store.create_once(spark, path, [1]) and not store.create_once(spark, path, [2])
    assert store.read_document(spark, path) == [1] and [n for n in store.listed(spark, f"file:{tmp_path}/log") if not n.startswith(".")] == ["one"]


def test_marks_fold_in_tokens_and_substrings(spark):
    names = [(1, "Karel Čapek"), (2, "Ștefan cel Mare"), (3, "Antonín Dvořák"), (4, "łódź"), (5, "café Zürich"), (6, "ΑΘΉΝΑ Ὀδυσσεύς"), (7, "IŞIK ılık İĞDE"), (8, "Straße ẞ"), (9, "हिन्दी"), (10, "Øresund Đorđe")]
    df = spark.createDataFrame(names, "id int, title string").withColumn("year", F.lit(2000))
    index = index_of(df, "id", {"title": 1.0})
    for query, want in (("capek", [1]), ("ČAPEK", [1]), ("stefan", [2]), ("dvorak", [3]), ("lodz", [4]), ("café zürich", [5]), ("cafe zürich", [5]), ("αθηνα", [6]), ("ΟΔΥΣΣΕΎΣ", [6]), ("isik igde", [7]), ("strasse", [8]), ("oresund dorde", [10])):
        assert [r.id for r in retrieve.bm25(index, text.analysed(query)).collect()] == want, query
        assert [r.id for r in df.where(retrieve.holds_terms(F.col("title"), query)).collect()] == want, query
        assert {r.id: r.p for r in df.select("id", text.plain(F.col("title")).alias("p")).collect()}[want[0]] == text.plain_text(dict(names)[want[0]])


def test_people_by_the_words_of_their_names(spark):
    df = canonical(spark.createDataFrame([("1", "kaya", "Ada Kaya", 2000), ("2", "ada", "Can Kaya", 2001), ("3", None, None, None), ("4", "x", "Kaya, Adanır", 2002)], "record_id string, title string, author string, year int"))
    assert [r.record_id for r in Engine(df).by_person("author", "Ada Kaya").hits.collect()] == ["4", "1"]
    assert sorted(r.record_id for r in Engine(df).search("ada", field="author").hits.collect()) == ["1", "4"]
    assert sorted(r.record_id for r in Engine(df).search("kaya", field="title").hits.collect()) == ["1"]


def test_pieces_of_a_batch_count_the_same(spark, monkeypatch):
    """A batch of long texts is cut between records; what is counted stays the same."""
    import pyarrow as pa

    texts = [[], ["a", "b", "a"], ["c"] * 5, ["ab", "a"], [], ["b"]] * 4
    batch = pa.RecordBatch.from_arrays([pa.array(range(24)), pa.array([0] * 24, pa.int32()), pa.array(texts, pa.list_(pa.string())), pa.array(texts[::-1], pa.list_(pa.string()))], names=["k", "part", "t", "u"])
    flat = lambda out: sorted(str((r["key"], r["column"], r["term"], r["n"], r["positions"], r["dl"])) for b in out for r in b.to_pylist())
    whole, summed = flat(ix._counted(["t", "u"], False)([batch])), sorted(str(r) for b in ix._summed([1.0, 2.0])([batch.drop_columns(["part"])]) for r in b.to_pylist())
    monkeypatch.setattr(ix, "PIECE", 7)
    parts = [b.num_rows for b in ix._pieces([batch], 2)]
    assert len(parts) > 5 and sum(parts) == 24
    assert flat(ix._counted(["t", "u"], False)([batch])) == whole
    assert sorted(str(r) for b in ix._summed([1.0, 2.0])([batch.drop_columns(["part"])]) for r in b.to_pylist()) == summed


def test_a_term_of_all_records_is_dealt_to_several_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(i, "hot", "", 2000) for i in range(400)], SCHEMA)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        write_index(rows, "id", WEIGHTS, f"file:{tmp_path}/i")
    finally:
        spark.conf.set(name, before)
    hot = read_index(spark, f"file:{tmp_path}/i", "id").places.where("term = 'hot'")
    assert hot.count() == 400 and hot.select(F.input_file_name()).distinct().count() > 1


def test_an_answer_is_written_once(spark):
    rows = canonical(spark.createDataFrame([(str(i), "hot") for i in range(9)], "record_id string, title string"))
    answer, total = Engine(rows, rows, cap=5)._asked(rows)
    assert answer.staged_path and answer.count() == 5 and total.first()["live_total"] == 9


def test_maxima_come_from_what_was_written(spark, tmp_path):
    """Rows are made for the bounds of the order and for the order, not once more for the maxima."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def term(i):
        made.add(1)
        return f"t{i % 7}"

    term = term.asNondeterministic()
    rows = spark.range(60).select(F.col("id").alias("k"), F.lit("title").alias("column"), term("id").alias("term"), (F.col("id") % 5 + 1).alias("n"), F.array(F.lit(0)).alias("positions"), (F.col("id") + 1).alias("dl"), (F.col("id") % 2).cast("int").alias("block"), F.lit(False).alias("lead"))
    ix._write_sorted(rows, "k", f"file:{tmp_path}/s")
    assert made.value <= 2 * 60
    got = {(x.column, x.term, x.block): (x.n, x.dl, x.rows) for x in spark.read.parquet(f"file:{tmp_path}/s/maxima").collect()}
    groups = {}
    for i in range(60):
        groups.setdefault(("title", f"t{i % 7}", i % 2), []).append((i % 5 + 1, i + 1))
    assert got == {g: (max(n for n, _ in v), min(d for _, d in v), len(v)) for g, v in groups.items()}


def test_a_batch_without_a_term_has_the_same_types(spark):
    """Some batches of records hold a term and others don't; the same columns come from all."""
    rows = spark.createDataFrame([(i, "rare word" if i == 30 else "word", "", 2000) for i in range(40)], SCHEMA).coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "8")
    try:
        got = {r.id: (r.dl, r.f0, r.f1) for r in ix.asked(index_of(rows, "id", WEIGHTS), ["rare", "word"]).collect()}
    finally:
        spark.conf.set(name, before)
    w = WEIGHTS["title"]
    assert got == {i: (2, w, w) if i == 30 else (1, None, w) for i in range(40)}


def test_one_search_writes_no_index(spark, monkeypatch):
    """A query that asks a single question reads the records; an index of all of them isn't written for it."""
    from shelfspark.plans import engine_queries

    monkeypatch.setattr(engine_queries, "write_index", None)
    for name in ("engine_search_coverage", "engine_search_notes"):
        assert getattr(engine_queries, name)(spark, "/root/testdata/sf0.001").count() <= 1


def test_first_keys_come_from_the_best_rows(spark):
    """A page is taken from the best rows of the first source if these have enough keys; repeated keys count once."""
    rows = canonical(spark.createDataFrame([(str(i % 7), f"hot x{i}", 2000 + i) for i in range(60)] + [("", "hot", 2000), (None, "hot", 2000)], "record_id string, title string, year int"))
    live = canonical(spark.createDataFrame([(str(i), "hot", 2000) for i in range(12)], "record_id string, title string, year int"))
    ids = lambda limit: [r.record_id for r in Engine(rows, live).search("hot", limit=limit).hits.collect()]
    whole = ids(30)
    assert sorted(whole, key=int) == [str(i) for i in range(12)] and set(whole[:7]) == set("0123456")
    assert [ids(n) for n in (1, 3, 9)] == [whole[:n] for n in (1, 3, 9)]


def test_people_without_a_stored_index_are_read_from_their_column(spark, monkeypatch):
    names = [(str(i), n) for i, n in enumerate(["Ada Kaya", "Kaya, Adanır", "Can Kaya", "XAda Kaya", "ŞULE Âda-kaya", "", None, "ada"])]
    df = canonical(spark.createDataFrame(names, "record_id string, author string"))
    monkeypatch.setattr(retrieve, "bm25", None)
    assert sorted(r.record_id for r in Engine(df).by_person("author", "Kaya ADA").hits.collect()) == ["0", "1", "4"]
    assert Engine(df).by_person("author", "ve").hits.count() == 0
