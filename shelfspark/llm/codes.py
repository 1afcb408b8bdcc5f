"""Vector codes: each of 16 parts of a vector becomes the number of its nearest codebook entry, by Elkan's form of Lloyd's rounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, cut, discard, is_small, table
from .vectors import whole_vectors

#: Rows that a task holds at once.
BATCH = 4096


def _half_up(x):
    """float64 as float16 that is never smaller."""
    import numpy as np

    with np.errstate(over="ignore"):
        y = x.astype(np.float16)
        return np.where(y.astype(np.float64) < x, np.nextafter(y, np.float16(np.inf)), y).astype(np.float16)


def _half_down(x):
    """Distances as float16 that are never larger; beyond its range the largest finite one."""
    import numpy as np

    with np.errstate(over="ignore"):
        y = np.minimum(x, 65504.0).astype(np.float16)
        return np.where(y.astype(np.float64) > x, np.nextafter(y, np.float16(0)), y).astype(np.float16)


def nearest(x, entries, own, upper, lower):
    """(numbers, upper, lower) of one part's vectors after an assignment to `entries`; integer arrays x (n, d) and entries (k, d).

    own: the entry that a vector had; upper: not less than its distance to it; lower (n, k): not more than that to each
    entry. An entry is passed over only if a bound says that it is strictly farther than the best one so far: by its lower
    bound, or as it lies more than twice the upper bound from the vector's entry. Whatever may be as near is measured in
    integers, and of equally near entries the one with the lowest number stays. own, upper and lower are changed.
    """
    import numpy as np

    gap = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2).astype(np.float64)
    half = np.sqrt(gap) / 2 * (1 - 1e-12)  # rounding may not overstate it
    others = half + np.where(np.eye(len(entries), dtype=bool), np.inf, 0)
    open_ = np.flatnonzero(upper >= others.min(1)[own])
    at, now = x[open_], own[open_]
    best = ((at - entries[now]) ** 2).sum(1)
    up, low = np.sqrt(best.astype(np.float64)) * (1 + 1e-12), lower[open_]
    low[np.arange(len(now)), now] = up * (1 - 1e-11)
    for j in range(len(entries)):
        i = np.flatnonzero((now != j) & (low[:, j] <= up) & (half[now, j] <= up))
        if not len(i):
            continue
        d = ((at[i] - entries[j]) ** 2).sum(1)
        low[i, j] = np.sqrt(d.astype(np.float64)) * (1 - 1e-12)
        i, d = (a[nearer] for nearer in [(d < best[i]) | ((d == best[i]) & (j < now[i]))] for a in (i, d))
        best[i], now[i], up[i] = d, j, np.sqrt(d.astype(np.float64)) * (1 + 1e-12)
    own[open_], upper[open_], lower[open_] = now, up, low
    return own, upper, lower


def _flat(column, dtype, width: int):
    """A binary column of rows of equal length as an array (rows, width)."""
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _binary(values):
    import pyarrow as pa

    return pa.array([r.tobytes() for r in values], pa.binary())


_STATE = "vec_id {}, label {}, x binary, own binary, upper binary, lower binary"


def _assign(books, before, parts: int, size: int):
    """A task that assigns rows (vec_id, label, x, and from the second round on own, upper, lower) to `books` (parts, k, d).

    before: the entries of the round before; the bounds are shifted by how far each entry has moved.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        k = books.shape[1]
        moved = None if before is None else np.sqrt(((books - before) ** 2).sum(2).astype(np.float64)) * (1 + 1e-12)
        for b in batches:
            if not b.num_rows:
                continue
            n = b.num_rows
            x = _flat(b["x"], np.int32, parts * size).reshape(n, parts, size).astype(np.int64)
            own, upper, lower = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float16), np.zeros((n, parts, k), np.float16)
            was = None if before is None else (_flat(b["own"], np.uint8, parts), _flat(b["upper"], np.float16, parts), _flat(b["lower"], np.float16, parts * k).reshape(n, parts, k))
            for p in range(parts):
                if was is None:
                    a, u, low = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, k))
                else:
                    a = was[0][:, p].astype(np.int64)
                    u = was[1][:, p].astype(np.float64) + moved[p][a]
                    low = np.maximum(was[2][:, p].astype(np.float64) - moved[p][None, :], 0)
                a, u, low = nearest(x[:, p], books[p], a, u, low)
                own[:, p], upper[:, p], lower[:, p] = a, _half_up(u), _half_down(low)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], b["x"], _binary(own), _binary(upper), _binary(lower.reshape(n, -1))], names=["vec_id", "label", "x", "own", "upper", "lower"])

    return run


def _moments(parts: int, size: int, k: int):
    """A task that adds up its rows: one row (part, entry, n, sums) for each entry in use."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums, counts = np.zeros((parts, k, size), np.int64), np.zeros((parts, k), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = _flat(b["x"], np.int32, parts * size).reshape(-1, parts, size)
            own = _flat(b["own"], np.uint8, parts)
            for p in range(parts):
                np.add.at(sums[p], own[:, p], x[:, p].astype(np.int64))
                counts[p] += np.bincount(own[:, p], minlength=k)
        p, j = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(counts[p, j]), pa.array(sums[p, j].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return run


def _moved(state: DataFrame, books, parts: int, size: int):
    """The entries after a round: floor(sum / count) of their vectors; unused ones stay. parts * k rows come to the driver."""
    k = books.shape[1]
    rows = state.select("x", "own").mapInArrow(_moments(parts, size, k), "part int, entry int, n bigint, sums array<bigint>")
    rows = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)])
    out = books.copy()
    for r in rows.collect():
        out[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(size)]
    return out


def _measured(books, parts: int, size: int):
    """A task that gives (vec_id, label, code, error) of assigned rows; errors are measured, not taken from bounds."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = _flat(b["x"], np.int32, parts * size).reshape(-1, parts, size).astype(np.int64)
            own = _flat(b["own"], np.uint8, parts)
            error = ((x - books[np.arange(parts), own]) ** 2).sum((1, 2))
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], pa.array([r.tobytes().hex() for r in own], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def compressed(rows: DataFrame, vector: str = "embedding", *, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """One row per kept vector (vec_id, code, error, label_error, codebooks_sha256).

    rows: vec_id, label, `vector`; other columns are not read. Vectors that are null or hold null or non-finite
    components, or whose length differs from that of the first row, are left out; so an empty table gives no rows. A
    component x counts as floor(256 * x). Each part's codebook begins with that part of the `entries` (256 at most) rows
    with the smallest vec_id (nulls last, ties by components; all rows, if fewer), and each of `rounds` rounds assigns all
    parts and moves every entry in use to floor(sum / count). Repeated rows count each. A null label is a label.

    Elkan's method: what is written between rounds holds for each part its entry, an upper bound of the distance to it
    and a lower bound for every entry, as 16-bit floats rounded outward. Codebooks (parts * entries rows) and their sums go
    through the driver, nothing that grows with the rows. The next round shifts the bounds by the way each entry went.
    """
    import numpy as np

    spark, kinds = rows.sparkSession, dict(rows.dtypes)
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has two hex digits")
    kept, length = whole_vectors(rows.select("vec_id", "label", vector), vector, "vec_id")
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    if not length:
        return spark.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    size = length // parts
    first = kept.select("vec_id", "_x").orderBy(F.col("vec_id").asc_nulls_last(), "_x").limit(entries).collect()
    books = np.array([r["_x"] for r in first], np.int64).reshape(-1, parts, size).transpose(1, 0, 2).copy()
    schema = _STATE.format(kinds["vec_id"], kinds["label"])
    arrow_batches(spark, BATCH)
    state = kept.select("vec_id", "label", "_x").mapInArrow(_packed, f"vec_id {kinds['vec_id']}, label {kinds['label']}, x binary")
    before, written = None, None
    for _ in range(rounds):
        state = cut(state.mapInArrow(_assign(books, before, parts, size), schema), "bounds")
        if written is not None:
            discard(written)
        before, written, books = books, state, _moved(state, books, parts, size)
    last = state.mapInArrow(_assign(books, before, parts, size), schema)
    codes = cut(last.mapInArrow(_measured(books, parts, size), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"), "codes")
    if written is not None:
        discard(written)
    name = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    sums = codes.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error"))
    sums = F.broadcast(sums) if is_small(sums, 32) else sums
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_l"))).select("vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))


def _packed(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for b in batches:
        x = b["_x"].flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        rows = x.reshape(b.num_rows, -1) if b.num_rows else x.reshape(0, 1)
        yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], _binary(rows)], names=["vec_id", "label", "x"])


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def _sql(parts: int = 16, size: int = 4, entries: int = 64, rounds: int = 2) -> str:
    apart = lambda a, b: " + ".join(f"({a}[{i}] - {b}[{i}]) * ({a}[{i}] - {b}[{i}])" for i in range(1, size + 1))
    out = f"""WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        x AS MATERIALIZED (SELECT vec_id, k, e[k * {size} + 1 : k * {size} + {size}] AS x FROM v, range({parts}) t(k)),
        low AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM v ORDER BY vec_id LIMIT {entries}),
        c0 AS MATERIALIZED (SELECT k, j, x AS c FROM x JOIN low USING (vec_id))"""
    for r in range(rounds + 1):
        out += f""",
        a{r} AS MATERIALIZED (SELECT vec_id, k, any_value(x) AS x, min(({apart("x", "c")}) * {entries} + j) AS d FROM x JOIN c{r} USING (k) GROUP BY 1, 2)"""
        if r < rounds:
            means = ", ".join(f"floor(sum(x[{i}])::DOUBLE / count(*))::BIGINT" for i in range(1, size + 1))
            out += f""",
        m{r} AS (SELECT k, d % {entries} AS j, [{means}] AS c FROM a{r} GROUP BY 1, 2),
        c{r + 1} AS MATERIALIZED (SELECT k, j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k, j))"""
    return f"""{out},
        book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, j)) AS codebooks_sha256 FROM c{rounds}),
        f AS (SELECT vec_id, string_agg(printf('%02x', (d % {entries})::INT), '' ORDER BY k) AS code, sum(d // {entries})::BIGINT AS error FROM a{rounds} GROUP BY 1)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM f JOIN v USING (vec_id), book"""


SQL = {"op11_vector_codes": _sql()}
