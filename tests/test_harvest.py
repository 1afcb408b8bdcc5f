"""Capped and failing sources, names against a dictionary, related records of all, dimensions and expiry."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import federate, harvest, retrieve
from shelfspark.operators import related as rel
from shelfspark.operators.index import index_of
from shelfspark.sources import cards, detail, dictionary, store
from shelfspark.streaming.warm import asked_again, warm, warmed


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    return spark.createDataFrame([(i, r.choice([2001, 2002, 2002, 2003, 2003, 2003, 2003]), r.choice("ab"), r.choice("xyz")) for i in range(300)], "id long, y int, p string, s string")


def domains(spark, rows, **more):
    return [rows.select(c).distinct().union(spark.createDataFrame([(more.get(c, "none" if c != "y" else 1999),)], rows.select(c).schema)) for c in ("y", "p", "s")]


@pytest.mark.parametrize(("cap", "most"), [(30, 7)])
def test_frontier_is_what_counting_first_gives(spark, rows, tmp_path, cap, most):
    levels, path = ["y", "p", "s"], f"file:{tmp_path}/f"
    ask, asked = harvest.table_source(rows, "id", levels, cap), []

    def watched(requests):
        asked.append(requests.count())
        return ask(requests)

    got, told = harvest.frontier(watched, [rows.select(c).distinct() for c in levels], levels, "id", path, most)
    want, coverage = federate.collected(rows, "id", levels, cap, most)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
    t, c = told.first(), coverage.first()
    assert (t.requests, t.collected) == (c.requests, c.collected) and t.total_found in (c.total_found, None) and t.complete == (c.complete and t.total_found is not None)
    assert harvest.marks(spark, path).agg(F.max("shown")).first()[0] <= cap and all(n <= most for n in asked)
    before = len(asked)
    again, _ = harvest.frontier(watched, [rows.select(c).distinct() for c in levels], levels, "id", path, most)
    assert again.count() == got.count() and len(asked) == before  # nothing is asked twice


def test_collected_without_bound_is_whole(spark, rows):
    """Slices of the last level that are over the cap are asked again by ranges of the key."""
    got, coverage = federate.collected(rows, "id", ["y", "p"], 30, None)
    sizes = [r["count"] for r in rows.groupBy("y", "p").count().collect()]
    asked = rows.groupBy("y").count().count() + sum(1 + (-(-n // 30) if n > 30 else 0) for n in sizes)
    c = coverage.first()
    assert max(sizes) > 30 and sorted(r.id for r in got.collect()) == list(range(300))
    assert (c.requests, c.collected, c.total_found, c.complete) == (asked, 300, 300, True)
    capped, _ = federate.collected(rows, "id", ["y", "p"], 30, 200)
    assert capped.count() < 300


def test_runs_of_names_are_not_broadcast(spark):
    entries = spark.createDataFrame([(i, f"name {i}") for i in range(50)], "code int, name string")
    got = dictionary.name_matches(entries, spark.createDataFrame([(k, f"e {k}") for k in range(20)], "k int, label string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "[_gram" in line]
    assert any("SortMergeJoin" in j for j in joins) and all("LeftSemi" in j for j in joins if "BroadcastHashJoin" in j)
    assert sorted((r["k"], r["matches"]) for r in got.collect())[:2] == [(0, 1), (1, 11)]


def test_frontier_with_values_that_bring_nothing(spark, rows, tmp_path):
    levels = ["y", "p", "s"]
    got, told = harvest.frontier(harvest.table_source(rows, "id", levels, 60), domains(spark, rows), levels, "id", f"file:{tmp_path}/f")
    t = told.first()
    assert got.count() == t.collected == t.total_found == 300 and t.complete
    part, told = harvest.frontier(harvest.table_source(rows, "id", levels, 60), [rows.select("y").distinct(), rows.select("p").where("p = 'a'").distinct(), rows.select("s").distinct()], levels, "id", f"file:{tmp_path}/g")
    t = told.first()
    assert part.count() == t.collected < t.total_found == 300 and not t.complete  # the dictionary lacks a value, and the count tells


def test_failing_slices_fail_alone_and_are_asked_again(spark, tmp_path):
    slices, path = spark.createDataFrame([(f"s{i}", i) for i in range(6)], "slice string, i int"), f"file:{tmp_path}/h"

    def fetch(request):
        if request["i"] == 3:
            raise ConnectionError("no route")
        return (5 if request["i"] == 4 else request["i"]), [{"id": 10 * request["i"] + j, "t": "ğ"} for j in range(min(4, request["i"]))]

    told = {r.slice: r for r in harvest.harvest(slices.repartition(2), harvest.python_source(fetch, "id long, t string"), path).collect()}
    assert {k: r.status for k, r in told.items()} == {"s0": "complete", "s1": "complete", "s2": "complete", "s3": "failed", "s4": "incomplete", "s5": "incomplete"}
    assert told["s3"].error == "ConnectionError: no route" and told["s3"].shown == 0 and store.versions(spark, path) == [0]
    asked = []

    def mended(requests):
        asked.extend(r.slice for r in requests.collect())
        return harvest.python_source(lambda q: (1, [{"id": 99, "t": None}]), "id long, t string")(requests)

    told = {r.slice: (r.status, r.runs) for r in harvest.harvest(slices, mended, path, again=("failed",)).collect()}
    assert asked == ["s3"] and told["s3"] == ("complete", 2) and told["s4"] == ("incomplete", 1)
    assert sorted(r.id for r in harvest.harvested(spark, path, "id").collect()) == [10, 20, 21, 40, 41, 42, 43, 50, 51, 52, 53, 99]
    harvest.harvest(slices, mended, path, again=())
    assert asked == ["s3"] and store.versions(spark, path) == [0, 1]
    totals = federate.harvest_totals(harvest.marks(spark, path).select(F.col("shown").alias("rows"), (F.col("status") == "complete").alias("complete"))).first()
    assert (totals.slices, totals.rows, totals.incomplete, totals.complete) == (6, 12, 2, False)


def test_broken_run_leaves_no_marks(spark, tmp_path):
    path, slices = f"file:{tmp_path}/h", spark.createDataFrame([("a",)], "slice string")
    with pytest.raises(Exception, match="lost"):
        harvest.harvest(slices, lambda r: r.select("slice", F.lit(1).cast("bigint").alias("found"), F.lit(None).cast("string").alias("error"), F.struct(F.raise_error(F.lit("lost")).cast("int").alias("id")).alias("row")), path)
    assert harvest.marks(spark, path).count() == 0


def test_name_matches(spark):
    r = random.Random(4)
    names = ["".join(r.choices("abcÇİ ", k=r.randint(0, 7))) for _ in range(60)] + [None, "abc", "abc", "ABC"]
    labels = [r.choice(names) if r.random() < 0.3 else "".join(r.choices("abcçi ", k=r.randint(0, 4))) for _ in range(80)] + [None, "", "zzz", "a", "ab"]
    entries = spark.createDataFrame(list(enumerate(names)), "code int, name string").withColumn("_n", F.lit(1))
    got = dictionary.name_matches(entries, spark.createDataFrame(list(enumerate(labels)), "k int, label string")).collect()
    fold = lambda x: (x or "").translate(str.maketrans("Çç", "cc")).replace("İ", "i").lower()
    assert len(got) == len(labels)
    for g in got:
        s = fold(labels[g.k])
        hits = [(fold(n) != s, n, i) for i, n in enumerate(names) if n is not None and s and s in fold(n)]
        assert g.matches == len(hits) and (g.entry.code if g.entry else None) == (min(hits)[2] if hits else None), labels[g.k]
    assert dictionary.name_matches(entries.limit(0), spark.createDataFrame([("a",)], "label string")).first()["matches"] == 0


def test_code_of_large_tables(spark, monkeypatch):
    rows = spark.createDataFrame([(2, "Doktora"), (1, "Yüksek Lisans"), (3, "Tıpta Uzmanlık"), (5, "Doktora sonrası")], "code int, label string")
    wanted = spark.createDataFrame([(x,) for x in ("DOKTORA", "lisans", "dok", "x", "", "uzman")], "label string")
    small = sorted(map(tuple, dictionary.code_of(rows, wanted).collect()))
    monkeypatch.setattr(dictionary, "MOST_CODES", 2)
    assert sorted(map(tuple, dictionary.code_of(rows, wanted).collect())) == small == sorted([("DOKTORA", "2"), ("lisans", "1"), ("dok", "2"), ("x", "0"), ("", "0"), ("uzman", "3")])


@pytest.mark.parametrize(("heavy", "split"), [(1000, 1000), (12, 7), (0, 100_000)])
def test_related_to_every_record(spark, heavy, split, monkeypatch):
    monkeypatch.setattr(rel, "SPLIT", split)
    r = random.Random(6)
    words = [f"w{i}" for i in range(40)] + ["w1x", "w12y", "the", "of"]
    texts = [" ".join(r.choices(words, weights=[40 / (i + 1) for i in range(40)] + [2, 2, 9, 9], k=r.randint(0, 9))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, [r.choice(words)] if i % 3 == 0 else None) for i, t in enumerate(texts)] + [(60, None, None)], "id long, title string, subjects array<string>")
    index = index_of(df, "id", {"title": 2.0, "subjects": 1.0})
    got = {}
    for x in rel.related_all(index, df, 4, heavy).collect():
        got.setdefault(x.seed, []).append((x.place, x.id, x.score))
    for record in [x.asDict() for x in df.collect()][::7]:
        want = [(y.id, y.score) for y in retrieve.related(index, record).select("id", F.round("score", 9).alias("score")).orderBy("score", "id").limit(4).collect()]
        assert [(i, s) for _, i, s in sorted(got.get(record["id"], []))] == want
    assert rel.related_all(index, df.limit(0)).count() == 0


def test_related_meets_in_blocks(spark, monkeypatch):
    """Records that all share terms are never paired as rows, whatever their number, and equal scores go by the key over blocks."""
    monkeypatch.setattr(rel, "SPLIT", 200)
    monkeypatch.setattr(rel, "GROUP", 2)
    sizes, staged = [], rel.store.staged

    def counted(df, label="staged"):
        out = staged(df, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(rel.store, "staged", counted)
    df = spark.createDataFrame([(f"r{i:03d}", "alpha beta" if i % 4 else f"alpha gamma{i % 8}") for i in range(300)], "id string, title string")
    got = {}
    for x in rel.related_all(index_of(df, "id", {"title": 1.0}), df, 5).collect():
        got.setdefault(x.seed, []).append((x.place, x.id))
    kind = lambda i: "b" if i % 4 else i % 8
    assert len(got) == 300 and max(sizes) <= 600
    for i in range(300):
        near = [f"r{j:03d}" for j in range(300) if j != i and kind(j) == kind(i)][:5]
        assert [x for _, x in sorted(got[f"r{i:03d}"])] == near


def test_dimensions_and_sketches(spark):
    r = random.Random(3)
    data = [(i, r.choice([None, 2000, 2001]), r.choice(["a", "b", None]), r.choice([None, *"pqrs"]), r.choice(["open", "x"])) for i in range(200)]
    df = spark.createDataFrame(data, "id long, year int, kind string, author string, access_status string")
    got = {(x.dimension, x.value): (x.n, x.open, x.first_year, x.last_year, x.people) for x in federate.production_by(df, ["year", "kind"], "author").collect()}
    want = {}
    for d, at in (("year", 1), ("kind", 2), ("all", None)):
        for v in {None if at is None else x[at] for x in data}:
            own = [x for x in data if at is None or x[at] == v]
            years = [x[1] for x in own if x[1]]
            want[d, None if v is None else str(v)] = (len(own), sum(x[4] == "open" for x in own), min(years, default=None), max(years, default=None), len({x[3] for x in own} - {None}))
    assert got == want
    many = spark.range(30_000).select((F.col("id") % 3).alias("year"), F.lit("open").alias("access_status"), F.concat(F.lit("p"), (F.col("id") % 9000).cast("string")).alias("author"))
    parts = [federate.production_sketches(many.where(c), ["year"], "author") for c in ("author < 'p5'", "author >= 'p4'")]
    told = {(x.dimension, x.value): (x.n, x.people) for x in federate.merged_sketches(parts[0].unionByName(parts[1])).collect()}
    assert abs(told["all", None][1] - 9000) < 450 and abs(told["year", "0"][1] - 3000) < 150 and told["all", None][0] > 30_000


def test_expired_records_are_asked_again(spark, tmp_path):
    schema = "user string, at timestamp"
    batches = [[("a", 0), ("a", 50), ("b", 10), (None, 5)], [("a", 99), ("a", 100), ("b", 20)], [("b", 111), ("a", 199), ("c", 500)], [("a", 600), ("c", 590), ("c", 600)]]
    asked = []
    for rows in batches:
        spark.createDataFrame([(u, t) for u, t in rows], "user string, s long").select("user", F.timestamp_seconds(1_700_000_000 + F.col("s")).alias("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = asked_again(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "user", "at", 100, late="1 hour")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        asked = sorted((r.user, r.s - 1_700_000_000) for r in spark.read.parquet(str(tmp_path / "out")).select("user", F.unix_seconds("at").alias("s")).collect())
    assert asked == [("a", 0), ("a", 100), ("a", 600), ("b", 10), ("b", 111), ("c", 500), ("c", 600)]


def test_warmed_table_without_versions_and_expiry(spark, tmp_path):
    path = f"file:{tmp_path}/t"
    with pytest.raises(FileNotFoundError, match="no version"):
        warmed(spark, path, "id", "o")
    df = spark.createDataFrame([(1, 5, "a"), (2, 9, "b")], "id int, o int, p string")
    df.write.parquet(str(tmp_path / "in"))
    warm(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "id", "o", path, str(tmp_path / "ck")).awaitTermination()
    assert [r.id for r in warmed(spark, path, "id", "o", fresh_from=6).collect()] == [2]


def test_references_with_missing_parts(spark):
    cases = {
        "KAYA, A. (2020). <i>Bir</i> [Doktora tezi, U].": ("A. KAYA", 2020, "Bir", None, "Doktora"), "Ada Kaya (2020). <i>Bir</i>": ("Ada Kaya", 2020, "Bir", None, None),
        "<i>Bir</i> (Tez No. 7) [x]": (None, None, "Bir", "7", "X"), "KAYA, A. <i>Bir</i> [İÇ HASTALIKLARI-DAHİLİYE tezi]": (None, None, "Bir", None, "İç Hastalıkları-Dahiliye"),
        "(2020). [Doktora tezi]": (None, 2020, None, None, "Doktora"), "A (20). <i>Bir": (None, None, None, None, None), "": (None,) * 5, "A (1999). <i>x [y]</i> [a] [TIPTA UZMANLIK TEZİ, b": ("A", 1999, "x [y]", None, None),
    }
    got = spark.createDataFrame(list(cases.items()) and [(k,) for k in cases], "c string").select("c", detail.apa_reference(F.col("c")).alias("r")).collect()
    assert {r.c: tuple(r.r) for r in got} == cases


def test_script_objects_are_taken_whole(spark):
    meta = '"0": {"meta": {"author": "A } \\" {B", "year": "1", "title": "a, }"},},'
    pages = [(1, f"<script>let x = 1; const referenceData = {{{meta} }}; function f() {{ return {{}}; }}\n</script>"), (2, "<script>referenceData = {oops;</script>"), (3, "referenceData = {}"), (4, None), (5, "<script>referenceData={'a'}</script>")]
    got = {r.k: r.m for r in spark.createDataFrame(pages, "k int, html string").select("k", cards.reference_data(F.coalesce("html", F.lit(""))).alias("m")).collect()}
    assert got[1]["0"]["meta"]["author"] == 'A } " {B' and got[1]["0"]["meta"]["title"] == "a, }" and all(not got[k] for k in (2, 3, 4, 5))


def test_quarantine(spark):
    df = spark.createDataFrame([(1, '<div class="result-card" data-kayitno="r"><div class="card-title">yapay <b>ze</b>ka</div></div>'), (2, "<h1>Hata</h1>"), (3, "Geçersiz sorgulama")], "page_id int, html string")
    assert [(r.page_id, r.title) for r in cards.hits(df, errors="quarantine").collect()] == [(1, "yapay zeka")]
    assert {r.page_id: r.reason for r in cards.quarantined(df).collect()} == {2: "neither a count nor a card", 3: "the source rejected the query"}
    with pytest.raises(ValueError):
        cards.hits(df, errors="x")


def test_blocks_of_a_task_leave_one_set_of_best_records(spark, monkeypatch):
    """Blocks that a task meets one after the other share a floor: a list's best come once from all of them, and no index is written."""
    monkeypatch.setattr(rel, "SPLIT", 40)
    found, staged = [], rel.store.staged

    def counted(df, label="staged"):
        out = staged(df, label)
        if label == "related-found":
            found.append(out.count())
        return out

    monkeypatch.setattr(rel.store, "staged", counted)
    df = spark.createDataFrame([(i, f"common w{i % 20 + 10} v{i % 3}") for i in range(120)], "id long, title string")
    got = {}
    for x in rel.related_all(index_of(df, "id", {"title": 1.0}), df, 3).collect():
        got.setdefault(x.seed, []).append((x.place, x.id))
    near = lambda i: [j for j in range(i % 60, 120, 60) if j != i] + [j for j in range(i % 20, 120, 20) if j % 3 != i % 3][:2]
    assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == {i: near(i) for i in range(120)}
    assert found[0] <= 60 * 4 * 2  # lists, records of each and one more, tasks of 9 blocks
