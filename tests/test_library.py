"""Small cases of the retrieval library."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfspark.functions import text
from shelfspark.operators import federate, fulltext, retrieve
from shelfspark.plans import queries

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_fold_is_turkish_aware(spark):
    assert one(spark, text.fold(F.lit("İŞÇİ SAĞLIĞI ß"))) == "isci sagligi ss"
    assert one(spark, text.fold(F.lit(None).cast("string"))) == ""
    assert one(spark, text.tokens(F.lit("hâkim a_b-c"))) == ["hakim", "a", "b", "c"]


def test_names_and_numbers(spark):
    assert one(spark, text.person_name(F.lit("Prof. Dr. Kaya,  Ada"))) == "Ada Kaya"
    assert one(spark, text.grouped_int(F.lit("2.059"))) == 2059
    assert one(spark, text.grouped_int(F.lit("x"))) is None
    assert one(spark, text.keyword_list(F.lit("<b>a</b>; b; "))) == ["a", "b"]


def test_half_split():
    assert retrieve.half_split("a b c") == ("a b", "c", "and")
    assert retrieve.half_split("a") == ("a", None, "and")
    with pytest.raises(ValueError):
        retrieve.half_split("a b", "xor")


def test_merge_keeps_richer_values(spark):
    df = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, "z"), (2, 1, "b", None)], "id int, o int, p string, q string")
    assert sorted(map(tuple, federate.merged(df, "id", "o").select("id", "p", "q").collect())) == [(1, "a", "z"), (2, "b", None)]


def test_reported_counts(spark):
    assert tuple(one(spark, federate.reported(F.lit("2.059 found, 2.000 shown")))) == (2059, 2000, False)
    assert tuple(one(spark, federate.reported(F.lit("7 found")))) == (7, 7, True)


def test_gate_and_window(spark):
    assert one(spark, fulltext.gated(F.lit("x"), F.lit("restricted"))) is None
    w = one(spark, fulltext.page_window(F.array(*map(F.lit, "abc")), 2, 1))
    assert w.pages == ["b"] and w.has_more


def test_stream_upsert(spark, tmp_path):
    from shelfspark.streaming.warm import warm

    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, "b")], "id int, o int, p string")
    rows.write.parquet(str(tmp_path / "in"))
    q = warm(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "id", "o", str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert sorted((r.id, r.p) for r in spark.read.parquet(str(tmp_path / "out/v=0")).collect()) == [(1, "a"), (2, "b")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    plain = lambda x: round(x, 5) if isinstance(x, float) else x
    key = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=repr)
    assert key(tuple(r) for r in queries.QUERIES[name](spark, SF).select(*columns).collect()) == key(want.fetchall())
