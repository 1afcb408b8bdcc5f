"""Harvest of a source that answers with at most `cap` rows: slices asked with their failures apart, resumed, and refined.

A source is a function from requests (slice, and a column for each level) to answers: (slice, found, error, row), a row of the
table for each one that it gives, and one without `row` for a request that brought none. found is what the source says it
has; error tells why a request failed, which fails nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..sources import store
from .federate import first_wins, slice_key

Source = Callable[[DataFrame], DataFrame]


def table_source(rows: DataFrame, key: str, levels: Sequence[str], cap: int, broken: Column | None = None) -> Source:
    """A table as such a source: of each slice the first `cap` rows by key, and how many there are.

    A request has a value for each of its first levels and null for the others. broken: a condition on the request for which
    it fails instead.
    """

    def ask(requests: DataFrame) -> DataFrame:
        names, out = [f"_{c}" for c in levels], None
        wanted = requests.select("slice", *[F.col(c).alias(n) for c, n in zip(levels, names, strict=True)], (F.lit(False) if broken is None else F.coalesce(broken, F.lit(False))).alias("_broken"))
        depth = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
        for d in [r["d"] for r in wanted.select(depth.alias("d")).distinct().collect()]:  # a join on as many columns as the requests name
            own = wanted.where((depth == d) & ~F.col("_broken"))
            same = [F.col(c) == F.col(n) for c, n in zip(levels[:d], names[:d], strict=True)]
            met = rows.join(F.broadcast(own.drop("_broken")), same)  # requests are few: their number is bounded by the caller
            order = Window.partitionBy("slice").orderBy(key)
            first = met.select("slice", F.struct(*rows.columns).alias("row"), F.col(key)).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap)
            found = met.groupBy("slice").agg(F.count("*").alias("found"))
            part = own.select("slice").join(found, "slice", "left").join(first.select("slice", "row"), "slice", "left")
            part = part.select("slice", F.coalesce("found", F.lit(0)).alias("found"), F.lit(None).cast("string").alias("error"), "row")
            out = part if out is None else out.unionByName(part)
        empty = F.lit(None).cast(rows.schema.simpleString()).alias("row")
        failed = wanted.where("_broken").select("slice", F.lit(None).cast("bigint").alias("found"), F.lit("the source failed").alias("error"), empty)
        return failed if out is None else out if broken is None else out.unionByName(failed)

    return ask


def python_source(fetch: Callable[[dict], tuple[int, list[dict]]], schema: str) -> Source:
    """A source that calls fetch(request) for each request, on the executors: it returns (found, rows as dicts) or raises.

    What it raises becomes the request's error. One answer, at most `cap` rows, is in memory at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    row_type = to_arrow_type(StructType.fromDDL(schema))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = pa.schema([("slice", pa.string()), ("found", pa.int64()), ("error", pa.string()), ("row", row_type)])
        for b in batches:
            for request in b.to_pylist():
                try:
                    found, rows = fetch(request)
                    answer = [{"slice": request["slice"], "found": found, "error": None, "row": r} for r in rows or [None]]
                except Exception as e:  # whatever a source raises concerns this request alone
                    answer = [{"slice": request["slice"], "found": None, "error": f"{type(e).__name__}: {e}", "row": None}]
                yield pa.RecordBatch.from_pylist(answer, schema=kinds)

    return lambda requests: requests.mapInArrow(run, f"slice string, found bigint, error string, row struct<{schema}>")


def answers(spark: SparkSession, path: str) -> DataFrame | None:
    """(run, slice, found, error, row) of all finished runs, or None before the first."""
    runs = store.versions(spark, path)
    if not runs:
        return None
    schema = spark.read.parquet(f"{path}/v={runs[0]}").schema
    return spark.read.schema(schema.add("v", IntegerType())).option("basePath", path).parquet(*[f"{path}/v={n}" for n in runs]).withColumnRenamed("v", "run")


def marks(spark: SparkSession, path: str) -> DataFrame:
    """(slice, runs, status, found, shown, error) of every slice that was asked: complete, incomplete (the source has more than it
    shows) or failed, as its last run tells."""
    told = answers(spark, path)
    if told is None:
        return spark.createDataFrame([], "slice string, runs bigint, status string, found bigint, shown bigint, error string")
    each = told.groupBy("slice", "run").agg(F.max("found").alias("found"), F.count("row").alias("shown"), F.max("error").alias("error"))
    last = each.groupBy("slice").agg(F.count("*").alias("runs"), F.max(F.struct("run", "found", "shown", "error")).alias("l")).select("slice", "runs", "l.found", "l.shown", "l.error")
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("shown") >= F.col("found"), "complete").otherwise("incomplete")
    return last.select("slice", "runs", status.alias("status"), "found", "shown", "error")


def harvest(slices: DataFrame, ask: Source, path: str, again: Sequence[str] = ("failed", "incomplete")) -> DataFrame:
    """Ask for the slices (slice and what the source needs) that no run before has settled, and return the marks of all.

    Rows and marks of a run are one table that counts once it is whole, so a run that breaks off leaves neither. A request
    that fails is marked with its error and the run goes on. again: the marks with which a slice is asked once more.
    """
    spark = slices.sparkSession
    settled = marks(spark, path).where(~F.col("status").isin(*again)).select("slice") if again else marks(spark, path).select("slice")
    todo = slices.join(settled, "slice", "left_anti")
    if not todo.isEmpty():
        number = store.latest(spark, path)
        store.write_version(ask(todo), path, 0 if number is None else number + 1)
    return marks(spark, path)


def harvested(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows that all runs have brought, one for each key: of a row in several answers the one of the latest run."""
    rows = answers(spark, path).where("row is not null").select("run", "row.*")
    return first_wins(rows, key, -F.col("run")).drop("run")


def frontier(ask: Source, domains: Sequence[DataFrame], levels: Sequence[str], key: str, path: str, max_requests: int = 200) -> tuple[DataFrame, DataFrame]:
    """(rows, coverage) of a capped source whose counts nobody knows before it is asked.

    domains: the values of each level, a table with that column. First each value of the first level is asked. A slice whose
    answer says that there is more than it shows is refined by the values of the next level, and so on; a failed or an empty
    answer is not. Slices have an order, parents before their parts, and only the first `max_requests` of all that are known
    are asked; what counts in the end are the first ones of all. Each level's answers are a version of the table at `path`,
    so a broken run goes on with the level that it hadn't finished. Coverage has one row (requests, collected, total_found,
    complete): total_found is what the answers to the first level's requests say together, null if one is missing.
    """
    spark = domains[0].sparkSession
    kinds = {c: dict(d.dtypes)[c] for c, d in zip(levels, domains, strict=True)}
    order = [F.col(c).asc_nulls_first() for c in levels]
    named = lambda df: df.withColumn("slice", slice_key(*[F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in levels]))
    known = roots = None
    for d, c in enumerate(levels):
        if known is None:
            new = domains[0].select(c).distinct()
        else:
            told = marks(spark, path).where("status = 'incomplete'").select("slice")
            over = known.where(F.col("depth") == d).join(told, "slice", "left_semi").select(*levels[:d])
            new = over.join(F.broadcast(domains[d].select(c).distinct()))
        new = named(new.select(*[(F.col(x) if x in new.columns else F.lit(None)).cast(kinds[x]).alias(x) for x in levels])).withColumn("depth", F.lit(d + 1))
        roots = new if known is None else roots
        whole = new if known is None else known.unionByName(new)
        known = store.staged(whole.orderBy(*order, "depth").limit(max_requests), "frontier")  # a bounded table
        harvest(known.where(F.col("depth") == d + 1), ask, path, again=())
    told = answers(spark, path)
    if told is None:
        raise ValueError("the first level has no values")
    counted = told.join(known.select("slice", "depth"), "slice")
    rows = first_wins(counted.where("row is not null").select("row.*"), key, F.lit(0))
    first = roots.join(marks(spark, path).select("slice", "found"), "slice", "left")
    total = first.agg(F.sum("found").alias("s"), F.count("found").alias("n"), F.count("*").alias("all")).select(F.when(F.col("n") == F.col("all"), F.col("s")).alias("total_found"))
    coverage = known.agg(F.count("*").alias("requests")).join(F.broadcast(rows.agg(F.count("*").alias("collected")))).join(F.broadcast(total))
    return rows, coverage.withColumn("complete", F.coalesce(F.col("collected") >= F.col("total_found"), F.lit(False)))
