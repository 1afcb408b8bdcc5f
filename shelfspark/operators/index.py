"""Inverted index: postings with positions by column, in memory or stored in segments that searches prune by column and prefix.

A stored index is a folder of segments, which never change, and a log of manifests v=1, v=2 ..., each of them the whole
list of segments with the table of deleted keys of each. A writer writes its segment first and then creates the next manifest;
if another one has taken its number, it takes in what that one did and tries again, so no upsert is lost. Readers stay with
the manifest they began with; what no kept manifest names goes with expire() alone.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BEGINS, WORD, plain_or_ascii, tokens
from ..sources import store

#: Records fall into bands by the logarithm of their length, so that those of a block can score alike; a band has PARTS blocks
#: by a hash of the key.
BANDS, PARTS = 4, 16
#: The column name under which a segment keeps the records of each prefix of up to PREFIX letters, and how long they are.
PREFIXES, PREFIX = "_prefixes", 4
#: Tokens that are counted at once: a batch of long texts is cut between records, so a worker's memory doesn't follow the batch.
PIECE = 1 << 20
#: Keys of a deletion table that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 1 << 20
#: Manifests that expire() keeps at least, and for how many seconds a manifest is kept otherwise.
KEEP, KEEP_SECONDS = 2, 3600.0
#: After so many seconds a segment that no manifest names is taken to be left by a writer that has died.
ORPHAN_SECONDS = 7 * 86_400.0
#: How often a writer tries to get a number.
TRIES = 50


@dataclass
class Index:
    """places: (key, column, term, n, positions, dl, block) of the terms of live records, dl the terms of a record in all
    columns; with the weights of the columns, the records and terms of the corpus (numbers if they are stored), and what a
    stored index knows besides: maxima (column, term, block, n, dl, rows) of each block, and the records of short prefixes
    (term, n), null if some of its records are deleted. records: those of an index that is not stored, in which a single
    question can be answered without places."""

    places: DataFrame
    key: str
    weights: Mapping[str, float]
    docs: int | None = None
    words: int | None = None
    maxima: DataFrame | None = None
    prefixes: DataFrame | None = None
    records: DataFrame | None = None

    @property
    def postings(self) -> DataFrame:
        """(key, term, f, n, dl): weighted and plain occurrences of a term in a record; one row of null term for a record without terms."""
        return self.weighted().groupBy(self.key, "term", "dl").agg(F.sum("f").alias("f"), F.sum("n").alias("n")).select(self.key, "term", "f", "n", "dl")

    def weighted(self, columns: Sequence[str] | None = None) -> DataFrame:
        """places, of these columns alone if there are any, with f, the weighted occurrences."""
        rows = self.places if columns is None else self.places.where(F.col("column").isin(*columns))
        return rows.withColumn("f", F.col("n") * weight_of(self.weights))

    def corpus(self) -> DataFrame:
        """One row (docs, words)."""
        if self.docs is not None:
            return self.places.sparkSession.range(1).select(F.lit(self.docs).alias("docs"), F.lit(self.words).alias("words"))
        return self.places.groupBy(self.key).agg(F.first("dl").alias("dl")).agg(F.count("*").alias("docs"), F.sum("dl").alias("words"))

    def is_empty(self) -> bool:
        return self.docs == 0 if self.docs is not None else self.places.isEmpty()


def weight_of(weights: Mapping[str, float]) -> Column:
    """The weight of the row's column."""
    if not weights:
        return F.lit(0.0)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c, w in weights.items() for x in (c, float(w))]), F.col("column")), F.lit(0.0))


def _pieces(batches: Iterator, at: int) -> Iterator:
    """Parts of batches with about PIECE tokens at most in their arrays, which begin at column `at`; a record stays whole."""
    import numpy as np

    for b in batches:
        if not b.num_rows:
            continue
        before = np.cumsum(sum(np.diff(b[c].offsets.to_numpy()).astype(np.int64) for c in range(at, b.num_columns)))
        cuts = np.flatnonzero(np.diff(before // PIECE)) + 1
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            yield b.slice(first, last - first)


def _coded(batch, columns: int, at: int):
    """(record, column, position, term, words) of every token in a batch's token arrays, which begin at column `at`; term is a
    number of a word."""
    import numpy as np
    import pyarrow as pa

    rows, cols, places, texts = [], [], [], []
    for c in range(columns):
        held = batch[at + c]
        offsets = held.offsets.to_numpy()
        n = np.diff(offsets)
        rows.append(np.repeat(np.arange(batch.num_rows), n))
        cols.append(np.full(len(rows[-1]), c))
        places.append(np.arange(len(rows[-1])) - np.repeat(offsets[:-1] - offsets[0], n))
        texts.append(held.flatten().cast(pa.large_string()))
    coded = pa.concat_arrays(texts).dictionary_encode()
    term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(places).astype(np.int32), term, coded.dictionary


def _counted(columns: Sequence[str], prefixes: bool) -> Callable[[Iterator], Iterator]:
    """A task over (key, block, token arrays of the columns) that gives a row for every column and term of a record.

    All of a piece of a batch is sorted at once by numbers that stand for record, column and term, so a text's tokens are neither
    shuffled nor touched one by one. With `prefixes` each piece adds the number of its records for each short prefix.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names, fields = pa.array([*columns, PREFIXES]), ["key", "column", "term", "n", "positions", "dl", "block", "lead"]
        for b in _pieces(batches, 2):
            row, col, place, term, words = _coded(b, len(columns), 2)
            dl = np.bincount(row, minlength=b.num_rows)
            name = (row * len(columns) + col) * max(1, len(words)) + term
            order = np.argsort(name, kind="stable")
            first = np.flatnonzero(np.diff(name[order], prepend=-1))
            at = order[first]
            bare = np.flatnonzero(dl == 0)  # records without terms have a row each
            own = np.concatenate([row[at], bare])
            lead = np.zeros(len(own), bool)
            lead[np.unique(row[at], return_index=True)[1]] = True  # one row of each record
            lead[len(at) :] = True
            n = np.concatenate([np.diff(first, append=len(order)), np.zeros(len(bare))]).astype(np.int64)
            offsets = np.concatenate([first, np.full(len(bare) + 1, len(order))]).astype(np.int32)
            out = [
                b[0].take(pa.array(own)), names.take(pa.array(np.concatenate([col[at], np.zeros(len(bare), np.int64)]))), pa.concat_arrays([words.take(pa.array(term[at])).cast(pa.string()), pa.nulls(len(bare), pa.string())]),
                pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(place[order])), pa.array(dl[own].astype(np.int64)), b[1].take(pa.array(own)), pa.array(lead),
            ]
            yield pa.RecordBatch.from_arrays(out, names=fields)
            for heads, count in _prefixes(row, term, words) if prefixes and len(words) else ():
                void = lambda kind, m=len(heads): pa.nulls(m, kind)
                out = [void(b[0].type), names.take(pa.array(np.full(len(heads), len(columns)))), heads, count, void(pa.list_(pa.int32())), void(pa.int64()), void(b[1].type), pa.array(np.zeros(len(heads), bool))]
                yield pa.RecordBatch.from_arrays(out, names=fields)

    return run


def _prefixes(row, term, words) -> Iterator:
    """(prefixes, number of records that have a term with it) for each length up to PREFIX."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    pair = np.unique(row * len(words) + term)
    owner, word = pair // len(words), pair % len(words)
    letters = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    for k in range(1, PREFIX + 1):
        heads = pc.utf8_slice_codeunits(words, 0, k).dictionary_encode()
        code, reaches = heads.indices.to_numpy(zero_copy_only=False).astype(np.int64), letters[word] >= k
        seen = np.unique(owner[reaches] * len(words) + code[word[reaches]]) % len(words)
        count = np.bincount(seen, minlength=len(heads.dictionary))
        some = np.flatnonzero(count)
        yield heads.dictionary.take(pa.array(some)).cast(pa.string()), pa.array(count[some].astype(np.int64))


def _summed(weights: Sequence[float]) -> Callable[[Iterator], Iterator]:
    """A task over (key, token arrays of the columns) that gives a row for every term of a record, all columns together."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        w = np.array(weights, np.float64)
        for b in _pieces(batches, 1):
            row, col, _, term, words = _coded(b, len(w), 1)
            dl = np.bincount(row, minlength=b.num_rows)
            name, at = np.unique(row * max(1, len(words)) + term, return_inverse=True)
            n, f = np.bincount(at, minlength=len(name)), np.bincount(at, w[col], minlength=len(name))
            bare = np.flatnonzero(dl == 0)
            own = np.concatenate([name // max(1, len(words)), bare])
            none = np.zeros(len(bare))
            out = [
                b[0].take(pa.array(own)), pa.concat_arrays([words.take(pa.array(name % max(1, len(words)))).cast(pa.string()), pa.nulls(len(bare), pa.string())]),
                pa.array(np.concatenate([f, none])), pa.array(np.concatenate([n, none]).astype(np.int64)), pa.array(dl[own].astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(out, names=["key", "term", "f", "n", "dl"])

    return run


def _tokenised(records: DataFrame, key: str, weights: Mapping[str, float], *more: Column) -> DataFrame:
    """(key, more, one array of tokens for each column); arrays are joined before."""
    kinds = dict(records.dtypes)
    text = lambda c: F.concat_ws("; ", c) if kinds[c].startswith("array") else F.col(c).cast("string")
    return records.select(F.col(key).alias("_key"), *more, *[tokens(text(c)).alias(f"_{i}") for i, c in enumerate(weights)])


def placed(records: DataFrame, key: str, weights: Mapping[str, float], prefixes: bool = False) -> DataFrame:
    """(key, column, term, n, positions, dl, block, lead) of every column and term of a record; arrays are joined before.

    positions count the terms of a column from 0. A record without terms has one row of null term, a repeated key is a
    record of its own. lead marks one row of each record. Texts are read once, nothing is shuffled.
    """
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(PARTS)).cast("int").alias("_part")
    schema = f"key {dict(records.dtypes)[key]}, column string, term string, n bigint, positions array<int>, dl bigint, block int, lead boolean"
    out = _tokenised(records, key, weights, part).mapInArrow(_counted(list(weights), prefixes), schema)
    return out.withColumn("block", _band() * PARTS + F.col("block")).withColumnRenamed("key", key)


def _band() -> Column:
    return F.floor(F.lit(BANDS) * F.log2(F.col("dl") + 1)).cast("int")


def postings(records: DataFrame, key: str, weights: Mapping[str, float]) -> DataFrame:
    """(key, term, f, n, dl) of every term of a record, its weighted and plain occurrences in all columns and all terms of the
    record; one row of null term for a record without terms. Nothing is shuffled."""
    schema = f"key {dict(records.dtypes)[key]}, term string, f double, n bigint, dl bigint"
    return _tokenised(records, key, weights).mapInArrow(_summed(list(weights.values())), schema).withColumnRenamed("key", key)


def asked(index: Index, terms: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """(key, dl, f0, f1 ...) of every record of an index that is not stored: how often each prefix term stands in it, weighted,
    null where it doesn't. Texts are read once and give a row a record, not a row a term: columns of one weight are one
    text, in which words, and words that begin with a term, are counted."""
    key, kinds, alike = index.key, dict(index.records.dtypes), {}
    for c, w in index.weights.items():
        alike.setdefault((float(w), columns is None or c in columns), []).append(c)
    text = lambda c: F.concat_ws("; ", c) if kinds[c].startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = index.records.select(F.col(key).alias("_key"), *[F.concat_ws("\n", *[plain_or_ascii(text(c)) for c in held]).alias(f"_{i}") for i, held in enumerate(alike.values())])
    total = lambda parts: sum(parts, F.lit(0))
    begun = lambda i, t: F.when(F.contains(f"_{i}", F.lit(t)), F.regexp_count(f"_{i}", F.lit(BEGINS + t))).otherwise(0)
    looked = [(i, w) for i, (w, seen) in enumerate(alike) if seen]
    counts = {f"n{j}_{i}": begun(i, t) for j, t in enumerate(terms) for i, _ in looked}
    rows = rows.select(F.col("_key").alias(key), total([F.regexp_count(f"_{i}", F.lit(WORD)) for i in range(len(alike))]).cast("bigint").alias("dl"), *[c.alias(n) for n, c in counts.items()])
    rows = rows.groupBy(key).agg(F.first("dl").alias("dl"), *[F.sum(n).alias(n) for n in counts])  # what uses a count twice comes after this
    f = lambda j: F.when(total([F.col(f"n{j}_{i}") for i, _ in looked]) > 0, total([F.col(f"n{j}_{i}") * F.lit(w) for i, w in looked]).cast("double"))
    return rows.select(key, "dl", *[f(j).alias(f"f{j}") for j in range(len(terms))])


def index_of(records: DataFrame, key: str, weights: Mapping[str, float]) -> Index:
    """An index that is built whenever it is used."""
    return Index(placed(records, key, weights).drop("lead"), key, weights, records=records)


def _segment(records: DataFrame, key: str, weights: Mapping[str, float], path: str) -> dict:
    """Write a segment: places by column, sorted by term, so that a prefix prunes row groups; lengths by record; maxima."""
    spark, name = records.sparkSession, uuid.uuid4().hex
    base = f"{path}/segments/{name}"
    rows = placed(records, key, weights, prefixes=True)
    rows.write.parquet(f"{base}/unsorted")  # else the range bounds would be sampled from texts that are read once more
    rows = _read(spark, f"{base}/unsorted", rows.schema)
    rows.where("lead").select(key, "dl").write.parquet(f"{base}/lengths")
    _write_sorted(rows, key, base)
    store.drop(spark, f"{base}/unsorted")
    docs, words = spark.read.parquet(f"{base}/lengths").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return {"name": name, "docs": docs, "words": words, "deleted": None}


def _write_sorted(rows: DataFrame, key: str, base: str) -> None:
    """Write places by column, sorted by term, and the maxima of their blocks. A term that most records have is dealt to
    several tasks by block and key. The maxima are taken from what was written: a task has there all or most rows of a
    term and block beside each other, so few rows are shuffled, and `rows` are not made once more."""
    rows.repartitionByRange("column", "term", "block", key).sortWithinPartitions("column", "term", "block", key).write.partitionBy("column").parquet(f"{base}/places")
    written = _read(rows.sparkSession, f"{base}/places", rows.select("term", "n", "dl", "block", "column").schema)
    real = written.where((F.col("column") != PREFIXES) & F.col("term").isNotNull())
    most = real.groupBy("column", "term", "block").agg(F.max("n").alias("n"), F.min("dl").alias("dl"), F.count("*").alias("rows"))
    most.sortWithinPartitions("column", "term").write.partitionBy("column").parquet(f"{base}/maxima")


_PLACES = "{key} {kind}, term string, n bigint, positions array<int>, dl bigint, block int, lead boolean, column string"


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The latest manifest and its number; number 0 where there is none."""
    number = store.latest(spark, f"{path}/manifest")
    return (0, {"segments": []}) if number is None else (number, store.read_document(spark, f"{path}/manifest/v={number}/_SUCCESS"))


def _commit(spark: SparkSession, path: str, change: Callable[[list[dict]], list[dict]]) -> None:
    """Create the next manifest with change(segments of the latest one); once more with those of another writer that came first."""
    for _ in range(TRIES):
        number, known = _manifest(spark, path)
        segments = change(known["segments"])
        if store.create_once(spark, f"{path}/manifest/v={number + 1}/_SUCCESS", {"segments": segments, "time": time.time()}):
            return
    raise RuntimeError(f"no manifest could be created in {path} in {TRIES} tries")


def _lengths(spark: SparkSession, path: str, segment: dict, key: str) -> DataFrame:
    """(key, dl) of a segment's live records."""
    return _without(spark.read.parquet(f"{path}/segments/{segment['name']}/lengths"), spark, path, segment, key)


def _without(rows: DataFrame, spark: SparkSession, path: str, segment: dict, key: str) -> DataFrame:
    """`rows` without those of the segment's deleted keys, whose number the manifest tells."""
    if not segment["deleted"]:
        return rows
    gone = spark.read.parquet(f"{path}/deleted/{segment['deleted']}")
    return rows.join(F.broadcast(gone) if segment["gone"] <= BROADCAST_KEYS else gone, key, "left_anti")


def _deleting(spark: SparkSession, path: str, segment: dict, keys: DataFrame, key: str) -> dict:
    """The segment without its records of `keys`: their keys in a new table, beside those that were deleted before."""
    hit = _lengths(spark, path, segment, key).join(keys.select(key).distinct(), key, "left_semi")
    rows, words, distinct = hit.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0)), F.count_distinct(key)).first()
    if not rows:
        return segment
    name = uuid.uuid4().hex
    all_of = hit.select(key).distinct()
    if segment["deleted"]:
        all_of = all_of.union(spark.read.parquet(f"{path}/deleted/{segment['deleted']}"))
    all_of.write.parquet(f"{path}/deleted/{name}")
    return segment | {"deleted": name, "gone": segment.get("gone", 0) + distinct, "docs": segment["docs"] - rows, "words": segment["words"] - words}


def write_index(records: DataFrame, key: str, weights: Mapping[str, float], path: str) -> None:
    """A new index in one segment, in place of what is there; docs and words of the manifest are those of live records."""
    spark = records.sparkSession
    made = _segment(records, key, weights, path) | {"weights": dict(weights)}
    _commit(spark, path, lambda _: [made])


def upsert_index(changed: DataFrame, key: str, weights: Mapping[str, float], path: str) -> None:
    """Write changed or new records as a further segment; what other segments hold of them is deleted.

    The cost follows the changed records: other segments are not rewritten, only their lengths are read once to find the
    deleted keys. Of rows that repeat a key, all count. Of two writers that change a record at once, the one whose manifest
    comes later wins.
    """
    spark = changed.sparkSession
    made = _segment(changed, key, weights, path) | {"weights": dict(weights)}
    keys = spark.read.parquet(f"{path}/segments/{made['name']}/lengths")
    done: dict[tuple, dict] = {}  # what a try before has found of segments that are still the same

    def change(segments: list[dict]) -> list[dict]:
        for s in segments:
            at = (s["name"], s["deleted"])
            done[at] = done.get(at) or _deleting(spark, path, s, keys, key)
        return [*(done[s["name"], s["deleted"]] for s in segments), made]

    _commit(spark, path, change)


def read_index(spark: SparkSession, path: str, key: str, kind: str = "bigint", version: int | None = None) -> Index:
    """The stored index as of its latest manifest, or of a kept older one; an empty index if there is none at `path`."""
    known = _manifest(spark, path)[1] if version is None else store.read_document(spark, f"{path}/manifest/v={version}/_SUCCESS")
    segments = known["segments"]
    if not segments:
        none = spark.createDataFrame([], _PLACES.format(key=key, kind=kind)).drop("lead")
        return Index(none, key, {}, 0, 0)
    kind = dict(spark.read.parquet(f"{path}/segments/{segments[0]['name']}/lengths").dtypes)[key]
    places, maxima, prefixes = [], [], []
    blocks = BANDS * 64 * PARTS
    for i, s in enumerate(segments):
        base = f"{path}/segments/{s['name']}"
        rows = _read(spark, f"{base}/places", _PLACES.format(key=key, kind=kind))
        own = rows.where(F.col("column") != PREFIXES).withColumn("block", F.col("block") + i * blocks)
        places.append(_without(own, spark, path, s, key))
        maxima.append(_read(spark, f"{base}/maxima", "term string, block int, n bigint, dl bigint, rows bigint, column string").withColumn("block", F.col("block") + i * blocks))
        prefixes.append(rows.where(F.col("column") == PREFIXES).select("term", "n"))
    whole = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(whole(parts[1:]))
    exact = all(not s["deleted"] for s in segments)
    weights = {c: w for s in segments for c, w in s["weights"].items()}
    return Index(whole(places).drop("lead"), key, weights, sum(s["docs"] for s in segments), sum(s["words"] for s in segments), whole(maxima), whole(prefixes) if exact else None)


def compact(spark: SparkSession, path: str, key: str) -> None:
    """All live rows in one new segment; the old ones stay for their readers until expire().

    What another writer commits meanwhile is kept: its segments follow the new one, and their keys are deleted from it.
    """
    _, known = _manifest(spark, path)
    old = known["segments"]
    if len(old) < 2 and not any(s["deleted"] for s in old):
        return
    index, name = read_index(spark, path, key), uuid.uuid4().hex
    base = f"{path}/segments/{name}"
    lengths = None
    for s in old:
        lengths = _lengths(spark, path, s, key) if lengths is None else lengths.unionByName(_lengths(spark, path, s, key))
    lengths.write.parquet(f"{base}/lengths")
    rows = index.places.withColumn("block", _band() * PARTS + F.pmod(F.xxhash64(F.col(key)), F.lit(PARTS)).cast("int")).withColumn("lead", F.lit(False))
    heads = index.places.where("term is not null").select(key, F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("term"), F.lit(PREFIX))), lambda k: F.substring("term", F.lit(1), k))).alias("term"))
    heads = heads.distinct().groupBy("term").agg(F.count("*").alias("n")).withColumn("column", F.lit(PREFIXES))
    _write_sorted(rows.unionByName(heads, allowMissingColumns=True), key, base)
    made = {"name": name, "docs": index.docs, "words": index.words, "deleted": None, "weights": dict(index.weights)}
    taken = {s["name"] for s in old}

    def change(segments: list[dict]) -> list[dict]:
        if not taken <= {s["name"] for s in segments}:
            return segments  # another writer has replaced what this one has read
        own, later = made, [s for s in segments if s["name"] not in taken]
        for s in later:
            own = _deleting(spark, path, own, _read_keys(spark, path, s), key)
        return [own, *later]

    _commit(spark, path, change)


def _read_keys(spark: SparkSession, path: str, segment: dict) -> DataFrame:
    return spark.read.parquet(f"{path}/segments/{segment['name']}/lengths")


def expire(spark: SparkSession, path: str, seconds: float = KEEP_SECONDS, keep: int = KEEP, orphan_seconds: float = ORPHAN_SECONDS) -> list[int]:
    """Drop manifests older than `seconds`, but for the last `keep`, and the segments and deletion tables that only they named.

    Returns the numbers of the dropped ones. What no manifest has ever named may belong to a writer that hasn't committed
    yet; it goes once it is older than `orphan_seconds`, which has to be longer than any write takes.
    """
    old = [(kind, name) for kind in ("segments", "deleted") for name, made in store.listed_times(spark, f"{path}/{kind}") if made <= time.time() - orphan_seconds]
    numbers = store.versions(spark, f"{path}/manifest")
    held = {n: store.read_document(spark, f"{path}/manifest/v={n}/_SUCCESS") for n in numbers}
    gone = [n for n in numbers[: max(0, len(numbers) - max(1, keep))] if held[n].get("time", 0) <= time.time() - seconds]
    named = lambda ns: {("segments", s["name"]) for n in ns for s in held[n]["segments"]} | {("deleted", s["deleted"]) for n in ns for s in held[n]["segments"] if s["deleted"]}
    left = named(set(numbers) - set(gone))
    for n in gone:
        store.drop(spark, f"{path}/manifest/v={n}")
    for kind, name in (named(gone) | set(old)) - left:
        store.drop(spark, f"{path}/{kind}/{name}")
    return gone
