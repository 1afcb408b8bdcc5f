"""Hard negatives: a pivot table brackets inner products by the triangle inequality, and only what a bracket can't settle is measured."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, cut, discard, table
from .vectors import whole_vectors

#: Rows of a block, anchors of a block, pivots, and how many rows (those with the smallest hashes) pivots are chosen from.
BLOCK, ANCHORS, PIVOTS, SAMPLE = 4096, 512, 16, 1024
#: Ranges of rows that blocks are cut from at most: their bounds are found on the driver from a sample of each.
RANGES = 240
_LEAST = -(1 << 62)


def _exact(x, a):
    """Inner products of integer rows x (n, d) and a vector a; by floating point only where that is exact."""
    import numpy as np

    if float(np.abs(x).max(initial=0)) * float(np.abs(a).sum()) < 2**53:
        return (x.astype(np.float64) @ a.astype(np.float64)).astype(np.int64)
    return x.astype(np.int64) @ a.astype(np.int64)


def _best(score, ids, uids, most: int):
    """Places of the `most` highest scores, ties by smaller id, then uid."""
    import numpy as np

    if len(score) > 4 * most:
        floor = -np.partition(-score, most - 1)[most - 1]
        kept = np.flatnonzero(score >= floor)
        return kept[np.lexsort((uids[kept], ids[kept], -score[kept]))[:most]]
    return np.lexsort((uids, ids, -score))[:most]


class _Space:
    """Rows get a further component sqrt(m2 - |x|^2) and queries 0, so that |q - x|^2 = |q|^2 + m2 - 2 <q, x>: a larger
    inner product is a smaller distance, and distances to pivots (rows) bracket it."""

    def __init__(self, pivots, m2: int):
        import numpy as np

        self.p, self.m2 = pivots.astype(np.float64), float(m2)
        self.up = np.sqrt(np.maximum(self.m2 - (self.p**2).sum(1), 0))
        self.slack = 2e-6 * (np.sqrt(self.m2) + 1)  # of a distance that is kept in 32 bits

    def rows(self, x):
        import numpy as np

        x = x.astype(np.float64)
        up = np.sqrt(np.maximum(self.m2 - (x**2).sum(1), 0))
        return np.sqrt(np.maximum(2 * (self.m2 - x @ self.p.T - up[:, None] * self.up[None, :]), 0)).astype(np.float32)

    def queries(self, a):
        import numpy as np

        a = a.astype(np.float64)
        return np.sqrt(np.maximum((a**2).sum(1)[:, None] + self.m2 - 2 * a @ self.p.T, 0)).astype(np.float32)

    def at_most(self, a2, apart):
        """No score of a vector with |a|^2 = a2 exceeds this where the distance is `apart` at least."""
        import numpy as np

        near = np.maximum(np.asarray(apart, np.float64) - self.slack, 0)
        return (a2 + self.m2 - near**2) / 2 + 1

    def at_least(self, a2, apart):
        """No score is less than this where the distance is `apart` at most."""
        import numpy as np

        far = np.asarray(apart, np.float64) + self.slack
        return (a2 + self.m2 - far**2) / 2 - 1


def _pivots(base: DataFrame):
    """Pivots that lie far apart: each is the row of a bounded sample that is farthest from those before."""
    import numpy as np

    rows = base.select("x", F.xxhash64("vec_id", "x").alias("h"), "uid").orderBy("h", "uid").limit(SAMPLE).collect()
    x = np.array([r["x"] for r in rows], np.int64)
    chosen, gap = [0], ((x - x[0]) ** 2).sum(1).astype(np.float64)
    while len(chosen) < min(PIVOTS, len(x)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _placed(space: _Space):
    """A task that adds to rows their distances to all pivots, the nearest pivot and its distance."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.int32)
            apart = space.rows(x)
            cols = [b[c] for c in ("uid", "vec_id", "label", "anchor")] + [pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in apart], pa.binary()), pa.array(apart.argmin(1).astype(np.int32)), pa.array(apart.min(1))]
            yield pa.RecordBatch.from_arrays(cols, names=["uid", "vec_id", "label", "anchor", "x", "apart", "home", "near"])

    return run


_BLOCK = "uids binary, ids binary, labels binary, anchors binary, x binary, apart binary, least binary, most binary"


def _blocks(batches: Iterator) -> Iterator:
    """One row for BLOCK rows at most of a partition; least and most: their distances to each pivot."""
    import numpy as np
    import pyarrow as pa

    held = []

    def block(rows: list):
        t = pa.Table.from_batches(rows).combine_chunks()
        apart = np.frombuffer(b"".join(t["apart"].to_pylist()), np.float32).reshape(t.num_rows, -1)
        flat = [t[c].to_numpy().astype(np.int64).tobytes() for c in ("uid", "vec_id", "label")] + [t["anchor"].to_numpy().tobytes(), b"".join(t["x"].to_pylist()), apart.tobytes(), apart.min(0).tobytes(), apart.max(0).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([f], pa.binary()) for f in flat], names=["uids", "ids", "labels", "anchors", "x", "apart", "least", "most"])

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(h.num_rows for h in held) >= BLOCK:
            yield block(held)
            held = []
    if held:
        yield block(held)


def _searched(space: _Space, positives: int, negatives: int, low: int, high: int):
    """A task over pairs of an anchor block (uid, vec_id, label, x, floor, wanted) and a row block.

    Without `wanted` it gives each anchor's best rows of its label that aren't below `floor`; with it (the positives'
    scores) the best rows of other labels in each positive's range, by the positive's rank. (uid, rank, id, row, score)
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = []
            for i in range(b.num_rows):
                take = lambda c, dtype, i=i, b=b: np.frombuffer(b[c][i].as_py(), dtype)
                ids, uids, labels = take("ids", np.int64), take("uids", np.int64), take("labels", np.int64)
                x, apart, least, most = take("x", np.int32).reshape(len(ids), -1), take("apart", np.float32).reshape(len(ids), -1), take("least", np.float32), take("most", np.float32)
                anchors = b["anchors"][i].as_py()
                a = np.array([np.frombuffer(r["x"], np.int32) for r in anchors])
                a2, own = (a.astype(np.float64) ** 2).sum(1), space.queries(a)
                block = space.at_most(a2, np.maximum(np.maximum(least[None, :] - own, own - most[None, :]), 0).max(1))
                for q, r in enumerate(anchors):
                    wanted = r["wanted"]
                    ranges = None if wanted is None else [(k, -(-low * s // 100), high * s // 100) for k, s in enumerate(wanted)]
                    floor = r["floor"] if ranges is None else min(lo for _, lo, _ in ranges)
                    if block[q] < floor:
                        continue
                    at = np.flatnonzero((labels == r["label"]) & (uids != r["uid"]) if ranges is None else labels != r["label"])
                    at = at[space.at_most(a2[q], np.abs(apart[at] - own[q]).max(1)) >= floor] if len(at) else at
                    if ranges is not None and len(at):
                        at = at[space.at_least(a2[q], (apart[at] + own[q]).min(1)) <= max(hi for _, _, hi in ranges)]
                    if not len(at):
                        continue
                    score = _exact(x[at], a[q])
                    for k, lo, hi in [(0, floor, None)] if ranges is None else ranges:
                        fits = np.flatnonzero((score >= lo) if hi is None else (score >= lo) & (score <= hi))
                        best = fits[_best(score[fits], ids[at[fits]], uids[at[fits]], positives if ranges is None else negatives)] if len(fits) else fits
                        out += [(r["uid"], k, int(ids[at[j]]), int(uids[at[j]]), int(score[j])) for j in best]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names=["uid", "rank", "id", "row", "score"])

    return run


_FOUND = "uid bigint, rank int, id bigint, row bigint, score bigint"


_ANCHOR = "uid bigint, vec_id bigint, label bigint, x binary, floor bigint"


def _seeds(positives: int):
    """A task over blocks: the anchors in them, each with the score of the last positive that its own block offers: a floor
    that any other has to reach."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = []
            for i in range(b.num_rows):
                uids, ids, labels = (np.frombuffer(b[c][i].as_py(), np.int64) for c in ("uids", "ids", "labels"))
                x = np.frombuffer(b["x"][i].as_py(), np.int32).reshape(len(uids), -1)
                for at in np.flatnonzero(np.frombuffer(b["anchors"][i].as_py(), np.bool_)):
                    same = np.flatnonzero((labels == labels[at]) & (uids != uids[at]))
                    score = np.sort(_exact(x[same], x[at]))
                    out.append((int(uids[at]), int(ids[at]), int(labels[at]), x[at].tobytes(), int(score[-positives]) if len(score) >= positives else _LEAST))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["uid", "vec_id", "label", "x", "floor"])

    return run


def _paired(anchors: DataFrame, blocks: DataFrame, task) -> DataFrame:
    """`task` over every anchor block with every row block: anchors in groups of about ANCHORS.

    Both sides stay in their files: a task reads a part of each and pairs them, so no pair is shuffled and the driver
    gets no anchor. A broadcast would be chosen by the size of the anchors without their copies.
    """
    groups = max(1, -(-anchors.count() // ANCHORS))
    packed = anchors.groupBy(F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("g")).agg(F.collect_list(F.struct("uid", "label", "x", "floor", "wanted")).alias("anchors"))
    packed = cut(packed.select("anchors"), "packed")
    return blocks.drop("anchors").crossJoin(packed.hint("shuffle_replicate_nl")).mapInArrow(task, _FOUND)


def _first(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The best rows for each key with their place from 1; each task keeps `most` of a key before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def hard_negatives(rows: DataFrame, is_anchor: Column, vector: str = "embedding", *, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the nearest rows of other labels that
    score between `low` and `high` percent of an anchor's positive.

    rows: vec_id, label, `vector`; other columns serve is_anchor alone. Rows with a null vec_id, label or vector, with null or
    non-finite components or of another length than the first row take no part; an empty table gives no rows. A component
    x counts as floor(256 * x), a score is the inner product of integers, higher ones come first, ties by vec_id. Each
    anchor has its first `positives` other rows of its label (a repeated row is another row), each positive its first
    `negatives` rows of other labels, numbered from 1.

    Every row and anchor meets in blocks: rows that lie near one pivot share blocks, with their distances to PIVOTS pivots.
    A block whose distances can't reach an anchor's floor is skipped, rows in it by their own brackets, and what is left
    is scored in integers. An anchor's block gives it a first floor. Tasks give each anchor a few rows for each block.
    """
    spark = rows.sparkSession
    kept, length = whole_vectors(rows.select("vec_id", "label", vector, F.coalesce(is_anchor, F.lit(False)).alias("_anchor")).where("vec_id is not null and label is not null"), vector, "vec_id")
    kinds = dict(rows.dtypes)
    out = f"anchor_id {kinds['vec_id']}, positive_id {kinds['vec_id']}, rank int, negative_id {kinds['vec_id']}, positive_score bigint, negative_score bigint"
    if not length:
        return spark.createDataFrame([], out)
    base = cut(kept.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("_anchor").alias("anchor"), F.col("_x").alias("x")), "vectors")
    size, m2 = base.agg(F.count("*"), F.max(F.aggregate("x", F.lit(0).cast("bigint"), lambda s, v: s + v.cast("bigint") * v))).first()
    space = _Space(_pivots(base), m2)
    arrow_batches(spark, BLOCK)
    placed = cut(base.mapInArrow(_placed(space), "uid bigint, vec_id bigint, label bigint, anchor boolean, x binary, apart binary, home int, near float"), "placed")
    discard(base)
    blocks = cut(placed.repartitionByRange(min(RANGES, -(-size // BLOCK)), "home", "near", "uid").sortWithinPartitions("home", "near", "uid").mapInArrow(_blocks, _BLOCK), "blocks")
    discard(placed)
    arrow_batches(spark, 4)  # a row is a block
    anchors = cut(blocks.mapInArrow(_seeds(positives), _ANCHOR), "anchors")
    found = _paired(anchors.withColumn("wanted", F.lit(None).cast("array<bigint>")), blocks, _searched(space, positives, negatives, low, high))
    best = _first(found, ["uid"], positives).where("score >= 0")
    wanted = best.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("p"))
    again = cut(anchors.join(wanted, "uid").withColumn("wanted", F.transform("p", lambda x: x["score"])), "positives")
    found = _paired(again, blocks, _searched(space, positives, negatives, low, high))
    last = _first(found, ["uid", "rank"], negatives).join(again.select("uid", F.col("vec_id").alias("anchor_id"), "p"), "uid")
    positive = F.get("p", F.col("rank"))
    last = last.select(F.col("anchor_id"), positive["id"].alias("positive_id"), F.col("place").alias("rank"), F.col("id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))
    return last.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in out.split(", ")])


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows with a vec_id divisible by 100; labels of rows with one divisible by 7 become the next label."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


SQL = {
    "op12_hard_negatives": """WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.e, r.e)::BIGINT AS score
            FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
            vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5"""
}
