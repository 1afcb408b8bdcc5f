"""N-gram Jaccard join: prefixes of rare tokens, token combinations in extended prefixes for frequent ones, then verify.

Sets are ordered by one global order: rare tokens (in at most FREQUENT sets) by hash, then frequent ones by their
count. Two sets of Jaccard j or more share a token in their prefixes of n - ceil(j n) + 1 tokens, and k tokens in
prefixes that are k - 1 longer. If they share a rare token there, they meet in that token's block, which has at most
FREQUENT members. If not, they share k frequent ones: these are dealt by hash into k - 1 groups, so two of them fall
into one group, and the sets meet in the block of that combination. k grows with the size class of the pair, which
keeps the number of combinations of a set in proportion to its prefix.

A block of a combination may be large (near copies of one text), so its pairs are not expanded: first every member is
verified against the block's most central member, then only pairs of members that are still in different components.
Every pair that could link is verified or known to be connected, so the components are exact.

jaccard_join() returns the links themselves: it verifies every candidate pair, skipping none that is connected.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, arrow_batches, cut, discard, fresh_dir, looked_up, small_side, table, without_ids
from .graph import connected_components
from .hashing import mixed, shingle_sets, shingles_of

WIDTH, PERCENT, FREQUENT = 4, 85, 128
#: Tokens that a task gathers before it hands them on, and tokens for each shard of the counts and of the index.
FLUSH, SHARD_TOKENS = 3_000_000, 2_000_000
#: Documents of a bucket of a large cluster.
CELL = 256


def prefix(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def classes(n: int, percent: int) -> list[tuple[int, int]]:
    """(size class of a pair, groups) for which a set of n tokens is indexed: its own, and the next if a partner can be in it."""
    own = n.bit_length() - 1
    return [(c, max(1, (100 - percent) * (1 << c) // 400)) for c in range(own, (n * 100 // percent).bit_length())]


def _pack(values, ordered: bool = False) -> bytes:
    """Numbers as planes of their bytes, which compress well; of ordered ones the differences."""
    import numpy as np

    values = np.diff(values, prepend=values.dtype.type(0)) if ordered else values
    return zlib.compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def _unpack(blob: bytes, dtype, ordered: bool = False):
    import numpy as np

    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    values = planes.T.copy().view(dtype).ravel()
    return np.cumsum(values, dtype=dtype) if ordered else values


def _set_rows(texts: DataFrame, shards: int, width: int) -> DataFrame:
    """A row for each text with its set's size and 128-bit key, and rows with each shard's token codes (upper 32 bits)."""
    bits = shards.bit_length() - 1

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        held, size = [], 0
        names = ["doc_id", "n", "k1", "k2", "shard", "blob"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

        def flush():
            codes = np.sort(np.concatenate(held))
            ends = np.searchsorted(codes, np.arange(1, shards + 1, dtype=np.uint64) << np.uint64(32 - bits))
            parts = [(i, codes[a:b]) for i, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)) if b > a]
            none = [None] * len(parts)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([none, none, none, none, [i for i, _ in parts], [_pack(c, True) for _, c in parts]], kinds, strict=True)], names)

        for batch in batches:
            out = []
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), width), strict=True):
                k1, k2 = (int(mixed(s ^ np.uint64(seed)).sum(dtype=np.uint64).astype(np.int64)) for seed in (0, 0x5851F42D4C957F2D))
                out.append((doc, len(s), k1, k2))
                held.append((s >> np.uint64(32)).astype(np.uint32))
                size += len(s)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
            none = [None] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([*(zip(*out, strict=True) if out else [[]] * 4), none, none], kinds, strict=True)], names)
        if held and size:
            yield flush()

    return texts.mapInArrow(rows, "doc_id long, n int, k1 long, k2 long, shard int, blob binary")


def _write_frequent(counts: DataFrame, path: str, most: int) -> None:
    """For each shard a file of the codes that stand in more than `most` sets, and one of their counts; shards.json names them."""
    Store(path)

    def write(pdf):
        import numpy as np

        codes, n = np.unique(np.concatenate([_unpack(x, np.uint32, True) for x in pdf["blob"]]), return_counts=True)
        store, shard, often = Store(path), int(pdf["shard"].iloc[0]), n > most
        for kind, values in (("codes", codes[often].astype("<u4")), ("counts", n[often].astype("<u4"))):
            made = f"_{uuid.uuid4().hex}"
            with store.create(made) as out:
                out.write(values.tobytes())
            store.rename(made, f"{shard:06d}.{kind}")
        return pdf[["shard"]].head(1)

    written = counts.groupBy("shard").applyInPandas(write, "shard int").collect()  # one number a shard
    Store(path).write_json("shards.json", sorted(r["shard"] for r in written))


class _Frequent:
    """The counts of frequent codes, from mapped files: joined if they are few, else looked up shard by shard.

    Where the folder can't be mapped, `most` shards are held at a time. A shard that is named but missing is an error.
    """

    def __init__(self, path: str, shards: int, joined_codes: int = 4 << 20, most: int = 8):
        from collections import OrderedDict

        import numpy as np

        self.store, self.most, self.parts = Store(path), most, OrderedDict()
        names = self.store.read_json("shards.json")
        sizes = {k: self.store.size(f"{k:06d}.codes") // 4 for k in names}
        self.names = {k for k, n in sizes.items() if n}
        if sum(sizes.values()) <= joined_codes and self.names:
            parts = [self._open(k) for k in sorted(self.names)]
            self.parts, self.names, shards = {0: tuple(np.concatenate(x) for x in zip(*parts, strict=True))}, {0}, 1
        self.ends = np.arange(1, shards + 1, dtype=np.uint64) << np.uint64(33 - shards.bit_length())

    def _open(self, shard: int):
        if shard not in self.parts:
            self.parts[shard] = tuple(self.store.array(f"{shard:06d}.{x}", "<u4") for x in ("codes", "counts"))
            while not self.store.local and len(self.parts) > self.most:
                self.parts.popitem(last=False)
        return self.parts[shard]

    def __call__(self, codes):
        """The counts of sorted codes, 0 for those that are not frequent."""
        import numpy as np

        out = np.zeros(len(codes), np.int64)
        ends = np.append(0, np.searchsorted(codes, self.ends))
        for shard in np.flatnonzero(np.diff(ends)).tolist():
            if shard in self.names:
                (known, counts), a, b = self._open(shard), ends[shard], ends[shard + 1]
                at = np.minimum(np.searchsorted(known, codes[a:b]), len(known) - 1)
                out[a:b] = np.where(known[at] == codes[a:b], counts[at], 0)
        return out

    def of(self, sets: list) -> list:
        """The counts of the tokens of each of several sets, each code looked up once."""
        import numpy as np

        if not sets:
            return []
        codes, at = np.unique(np.concatenate([s >> np.uint64(32) for s in sets]).astype(np.uint32), return_inverse=True)
        return np.split(self(codes)[at], np.cumsum([len(s) for s in sets])[:-1])


def _blob(token, doc, n, at) -> bytes:
    packed = [_pack(token, True), _pack(doc), _pack(n), _pack(at)]
    return b"".join(len(x).to_bytes(4, "little") + x for x in packed)


def _from_blob(blob: bytes):
    import numpy as np

    out, at = [], 0
    for dtype, ordered in ((np.uint32, True), (np.int64, False), (np.int32, False), (np.int32, False)):
        size = int.from_bytes(blob[at : at + 4], "little")
        out.append(_unpack(blob[at + 4 : at + 4 + size], dtype, ordered))
        at += 4 + size
    return out


def _index(texts: DataFrame, path: str, shards: int, width: int, percent: int) -> DataFrame:
    """Rows of packed rare tokens by shard (shard, blob), of combinations (key, id, n, rare) and of sketches (id, n, sketch)."""

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        frequent, held, size = _Frequent(path, shards), [], 0
        names, kinds = ["shard", "blob", "key", "id", "n", "rare", "sketch"], [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

        def of(*columns):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names)

        def flush():
            token, doc, n, at = (np.concatenate(x) for x in zip(*held, strict=True))
            shard = (token % np.uint64(shards)).astype(np.int32)
            token = (token >> np.uint64(32)).astype(np.uint32)  # tokens that share a shard and this much only add a pair to verify
            order = np.lexsort((token, shard))
            token, doc, n, at, shard = token[order], doc[order], n[order], at[order], shard[order]
            ends = np.searchsorted(shard, np.arange(shards), "right")
            parts = [(i, _blob(token[a:b], doc[a:b], n[a:b], at[a:b])) for i, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)) if b > a]
            none = [None] * len(parts)
            return of([i for i, _ in parts], [x for _, x in parts], none, none, none, none, none)

        for batch in batches:
            docs, sketched = batch.column(0).to_pylist(), []
            sets = list(shingle_sets(batch.column(1).to_pylist(), width))
            for doc, s, count in zip(docs, sets, frequent.of(sets), strict=True):
                n = len(s)
                if 100 * n < percent * (n + 1):  # only an equal set can link
                    continue
                sketched.append((doc, n, sketch(s)))
                rare, often = s[count == 0], s[count > 0]
                often = often[np.argsort(count[count > 0], kind="stable")]
                length, held_classes = prefix(n, percent), classes(n, percent)
                reach = length + max(g for _, g in held_classes)
                some = rare[:reach]
                if len(some):
                    held.append((some, np.full(len(some), doc, np.int64), np.full(len(some), n, np.int32), np.arange(len(some), dtype=np.int32)))
                    size += len(some)
                for c, g in held_classes:
                    shared = often[: max(0, length + g - len(rare))]
                    if len(shared) < 2:
                        continue
                    dealt = (shared >> np.uint64(8)) % np.uint64(g)
                    order = np.argsort(dealt, kind="stable")
                    own, dealt, keys = shared[order], dealt[order], []
                    for d in range(1, len(own)):
                        i = np.flatnonzero(dealt[:-d] == dealt[d:])
                        if not len(i):
                            break
                        keys.append(mixed(own[i] * np.uint64(0xD6E8FEB86659FD93) + own[i + d] * np.uint64(0xA0761D6478BD642F) + np.uint64(c)))
                    keys = (np.concatenate(keys) if keys else np.zeros(0, np.uint64)).astype(np.int64)
                    if len(keys):
                        m = len(keys)
                        yield of([None] * m, [None] * m, keys, np.full(m, doc, np.int64), np.full(m, n, np.int32), np.full(m, len(rare), np.int32), [None] * m)
                if size >= FLUSH // 4:
                    yield flush()
                    held, size = [], 0
            if sketched:
                none = [None] * len(sketched)
                ids, sizes, bins = zip(*sketched, strict=True)
                yield of(none, none, none, ids, sizes, none, bins)
        if held:
            yield flush()

    return texts.mapInArrow(rows, "shard int, blob binary, key long, id long, n int, rare int, sketch binary")


def _need(a: str, b: str, percent: int) -> str:
    return f"ceil({percent} * ({a} + {b}) / {100 + percent}.0 - 1e-9)"


def _rare_pairs(index: DataFrame, percent: int) -> DataFrame:
    """(a, b) of sets that share a rare token of their prefixes and whose sizes and places let them link."""

    def pairs(pdf):
        import numpy as np
        import pandas as pd

        token, doc, n, at = (np.concatenate(x) for x in zip(*map(_from_blob, pdf["blob"]), strict=True))
        order = np.argsort(token, kind="stable")
        token, doc, n, at = token[order], doc[order], n[order].astype(np.int64), at[order].astype(np.int64)
        found = []
        for d in range(1, len(token)):
            i = np.flatnonzero(token[:-d] == token[d:])
            if not len(i):
                break
            j = i + d
            both = n[i] + n[j]
            fits = np.minimum(n[i] - at[i], n[j] - at[j]) * (100 + percent) >= percent * both
            i, j = i[fits & (doc[i] != doc[j])], j[fits & (doc[i] != doc[j])]
            if len(i):
                found.append(np.unique(np.stack([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])], 1), axis=0))
        out = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})

    return index.where("shard is not null").select("shard", "blob").groupBy("shard").applyInPandas(pairs, "a long, b long").distinct()


def sketch(values) -> bytes:
    """Of a sorted set, how many values begin with each bit string, four to eight in the mean; empty if one byte can't hold a count.

    The sums of two sets' smaller counts are a bound of their intersection, so a pair below its need can't link.
    """
    import numpy as np

    bits = max(0, len(values).bit_length() - 3)
    counts = np.bincount((values >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def could_link(a, b, n: dict, sketches: dict, percent: int):
    """Of the pairs (a[i], b[i]), those whose sketches let them link; n and sketches are by id."""
    import numpy as np

    ids = np.array(sorted(n), np.int64)
    size, held = np.array([n[i] for i in ids.tolist()], np.int64), [sketches[i] for i in ids.tolist()]
    bins = np.array([len(x) for x in held])
    i, j = np.searchsorted(ids, a), np.searchsorted(ids, b)
    both, fewer, out = size[i] + size[j], np.minimum(bins[i], bins[j]), np.ones(len(a), bool)
    for width in np.unique(fewer[fewer > 0]).tolist():
        at = np.flatnonzero(fewer == width)
        used, place = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        counts = np.stack([np.frombuffer(held[k], np.uint8).reshape(width, -1).sum(axis=1, dtype=np.uint32) for k in used.tolist()])
        x, y, step = place[: len(at)], place[len(at) :], max(1, (1 << 21) // width)
        for begin in range(0, len(at), step):
            now = slice(begin, begin + step)
            most = np.minimum(counts[x[now]], counts[y[now]]).sum(axis=1, dtype=np.int64)
            out[at[now]] = 100 * most >= percent * (both[at[now]] - most)
    return out


def _dealt(cells: DataFrame, docs: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of `cells` in parts of about `docs` documents, as (part, cell, a, b), and what they need as (part, doc_id)."""
    ends = F.explode(F.array("a", "b")).alias("doc_id")
    ends_read = 2 * cells.count()
    parts = 1 + cells.select("cell", ends).distinct().count() // docs
    cells = cells.withColumn("part", F.pmod("cell", F.lit(parts)))
    return cells, cut(cells.select("part", ends).distinct(), "needed", ends_read)


def _verified(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, width: int, percent: int, every: bool = False) -> DataFrame:
    """Of the pairs (a, b) that link by their whole sets, enough to connect all that they connect, or every one.

    Pairs are dealt to cells: a cluster of the candidate graph is one cell if it has at most CELL documents, else
    its documents are dealt to buckets and a cell has the pairs of two of them. Cells are dealt to parts, so a
    document goes to a part once however many pairs it has there, and a part is bounded whatever the cluster.
    First the short sketches (doc_id, n, sketch) go to the parts and rule out pairs that can't link; then the texts
    of the others. A pair that earlier links of its part connect already is not compared, unless every link is asked for.
    """
    found = connected_components(pairs, most=pairs.count())
    sizes = found.groupBy("component").agg(F.ceil(F.count("*") / CELL).cast("int").alias("buckets"))
    placed = found.join(sizes, "component").select("id", "component", F.pmod(F.xxhash64("id"), F.col("buckets")).alias("bucket"))
    x, y = (placed.select(F.col("id").alias(k), F.col("bucket").alias(name), *also) for k, name, also in (("a", "x", ["component"]), ("b", "y", [])))
    cells = pairs.join(x, "a").join(y, "b").select(F.xxhash64("component", F.least("x", "y"), F.greatest("x", "y")).alias("cell"), "a", "b")
    cells = cut(cells, "cells", pairs.count())

    def near(wanted, held):
        ids = held["doc_id"].tolist()
        n, s = (dict(zip(ids, held[c].tolist(), strict=True)) for c in ("n", "sketch"))
        return wanted.loc[could_link(wanted["a"].to_numpy(), wanted["b"].to_numpy(), n, s, percent), ["cell", "a", "b"]]

    dealt, need = _dealt(cells, 20_000)
    rows = sketches.join(small_side(need, 24), "doc_id").select("part", "doc_id", "n", "sketch")
    left = cut(dealt.groupBy("part").cogroup(rows.groupBy("part")).applyInPandas(near, "cell long, a long, b long"), "near")
    discard(cells)

    def links(wanted, held):
        import pandas as pd

        texts_of = dict(zip(held["doc_id"].tolist(), held["text"].tolist(), strict=True))
        known = dict(zip(texts_of, shingle_sets(texts_of.values(), width), strict=True))
        up, out, of = {}, [], _Shingles(texts_of, width)

        def root(d):
            while d in up:
                d = up[d]
            return d

        for p, q in sorted(set(zip(wanted["a"].tolist(), wanted["b"].tolist(), strict=True))):
            r, t = root(p), root(q)
            if (every or r != t) and 100 * (both := _common(known[p], known[q])) >= percent * (len(known[p]) + len(known[q]) - both):
                x, y = of(p), of(q)
                both = len(x & y)
                if 100 * both < percent * (len(x) + len(y) - both):
                    continue
                if r != t:
                    up[max(r, t)] = min(r, t)
                out.append((p, q))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    dealt, need = _dealt(left, 1_000)
    rows = looked_up(texts, "doc_id", need, 24).select("part", "doc_id", "text")
    return cut(dealt.groupBy("part").cogroup(rows.groupBy("part")).applyInPandas(links, "a long, b long"), "links")


class _Shingles:
    """The shingles themselves of a part's texts; those of the last two are kept."""

    def __init__(self, texts: dict, width: int):
        self.texts, self.width, self.held = texts, width, {}

    def __call__(self, doc):
        if doc not in self.held:
            self.held = dict(list(self.held.items())[-1:])
            self.held[doc] = shingles_of(self.texts[doc], self.width)
        else:
            self.held[doc] = self.held.pop(doc)
        return self.held[doc]


def _common(s, u) -> int:
    import numpy as np

    both = np.concatenate([s, u])
    both.sort(kind="stable")  # two sorted runs are merged
    return int((both[1:] == both[:-1]).sum())


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with one text for each doc_id, and (id, doc_id) if for that texts were numbered anew."""
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    keyed = known.select("doc_id", F.unhex(F.md5("text")).alias("h"))
    several = keyed.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count("*").alias("rows")).where("rows > 1")
    rows, texts = several.agg(F.count("*"), F.count_if(F.col("a") != F.col("b"))).first()
    if not rows:
        return known, None
    if not texts:
        return known.groupBy("doc_id").agg(F.first("text").alias("text")), None
    names = cut(keyed.distinct().withColumn("id", F.monotonically_increasing_id()), "text-ids")  # written, so the numbers stay
    once = known.withColumn("h", F.unhex(F.md5("text"))).join(names, ["doc_id", "h"]).groupBy("id").agg(F.first("text").alias("text"))
    return cut(once.withColumnRenamed("id", "doc_id"), "numbered"), names.select("id", "doc_id")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, most: int = FREQUENT, keyed: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document of docs (doc_id, text; others are not read).

    Words are runs of other characters than blank and 0x09-0x0D, A-Z lower-cased; a set holds the distinct shingles
    of `width` words, fewer words are one shingle. Documents link when 100 * intersection >= percent * union;
    component_id is the smallest doc_id that links reach. Null and empty texts have no shingles and link with
    nothing. Rows that repeat a doc_id with the same text count once, with another text they are a document of their
    own (keyed: with its text_md5, binary); rows without doc_id are not reported; an empty table gives no rows. Candidates come
    from 64-bit hashes of shingles, links are confirmed on the shingles.
    """
    docs, names = _numbered(docs)
    copies, sets, found, _ = _joined(docs, width, percent, most, False)
    out = _named(_labelled(copies, sets, found), names, "component_id")
    return out.select("doc_id", "n_shingles", "component_id", *(["text_md5"] if keyed else []))


def jaccard_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, most: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """(rep_a, rep_b) of every two different sets that link, and (doc_id, rep, n_shingles, component_id, links) of every document.

    Documents of equal sets are one class, named by a representative: a doc_id, or a number of its own where a doc_id
    has several texts; documents without shingles are classes of their own. links is the number of other documents
    that a document links with: those of its own class and of all classes that its class links with. Otherwise as
    jaccard_components(); no link is skipped.
    """
    docs, names = _numbered(docs)
    copies, sets, found, links = _joined(docs, width, percent, most, True)
    rep = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("rep"))
    member = cut(copies.join(sets.select(F.col("doc_id").alias("first"), "n", "rep"), "first").select("doc_id", "n", rep.alias("rep")), "members")
    sizes = cut(member.groupBy("rep").agg(F.count("*").alias("size")), "class-sizes")
    ends = links.select("a", "b").union(links.select("b", "a")).toDF("rep", "other")
    beside = ends.join(sizes.select(F.col("rep").alias("other"), "size"), "other").groupBy("rep").agg(F.sum("size").alias("beside"))
    of_class = sizes.join(beside, "rep", "left").select("rep", (F.col("size") - 1 + F.coalesce("beside", F.lit(0))).alias("links"))
    out = _labelled(copies, sets, found).join(member.select("doc_id", "rep"), "doc_id").join(of_class, "rep")
    out = _named(out, names, "component_id").select("doc_id", "rep", "n_shingles", "component_id", "links")
    return links.select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b")), out


def _named(rows: DataFrame, names: DataFrame | None, component: str) -> DataFrame:
    """`rows` with documents' ids in place of numbers of texts."""
    if names is None:
        return rows
    rows = rows.withColumnRenamed("doc_id", "id").join(names, "id")
    least = rows.groupBy(component).agg(F.min("doc_id").alias("_least"))
    return rows.join(least, component).withColumn(component, F.col("_least")).drop("id", "_least")


def _alike(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(doc_id) of the pairs (doc_id, rep) whose sets are equal shingle by shingle."""
    parts = 1 + pairs.count() // 1_000
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    need = cut(pairs.select("part", F.explode(F.array("doc_id", "rep")).alias("doc_id")).distinct(), "needed")

    def same(wanted, held):
        of = _Shingles(dict(zip(held["doc_id"].tolist(), held["text"].tolist(), strict=True)), width)
        wanted = wanted.sort_values("rep")
        told = [len(of(r) ^ of(d)) == 0 for d, r in zip(wanted["doc_id"].tolist(), wanted["rep"].tolist(), strict=True)]
        return wanted.loc[told, ["doc_id"]]

    rows = looked_up(texts, "doc_id", need, 24).select("part", "doc_id", "text")
    return pairs.groupBy("part").cogroup(rows.groupBy("part")).applyInPandas(same, "doc_id long")


#: Members of a block that one task holds against the strays of that block at most.
BLOCK_PART = 50_000


def _across(left: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the members (key, id, n, rare, c) of a block that belong to different components c and may link by their sizes.

    Each block has a main component, its largest one. Only its strays, the members of others, are held against the block, so
    a block in one component gives nothing and one with a few strays a few times its size; members of one component are
    met in no more pairs than members of different ones. A block is dealt to parts, and its strays go to each of them.
    """
    sizes = left.groupBy("key", "c").agg(F.count("*").alias("m"))
    main = sizes.groupBy("key").agg(F.max(F.struct("m", "c")).alias("main"), F.sum("m").alias("all"), F.count("*").alias("kinds")).where("kinds > 1").select("key", F.col("main.c").alias("main"), F.ceil(F.col("all") / BLOCK_PART).cast("int").alias("parts"))
    mixed = cut(left.join(main, "key"), "mixed")
    y = mixed.select("key", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), *[F.col(x).alias(f"{x}2") for x in ("id", "n", "rare", "c")], (F.col("c") == F.col("main")).alias("in_main"))
    x = mixed.where("c <> main").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(x).alias(f"{x}1") for x in ("id", "n", "rare", "c")])
    apart = f"c1 <> c2 and (in_main or id1 < id2) and least(n1 - rare1, n2 - rare2) >= {_need('n1', 'n2', percent)}"
    return x.join(y, ["key", "part"]).where(apart).select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"))


def _joined(docs: DataFrame, width: int, percent: int, most: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(doc_id, first, text_md5) of equal texts, (doc_id, n, rep) of equal sets, (id, component) and links (a, b) of representatives: every one, or enough for the components."""
    spark, known = docs.sparkSession, docs
    arrow_batches(spark)
    keyed = cut(known.select("doc_id", F.unhex(F.md5("text")).alias("h"), F.octet_length("text").alias("size")), "hashed")
    first = keyed.groupBy("h").agg(F.min("doc_id").alias("first"))
    copies = keyed.join(first, "h").select("doc_id", "first", F.col("h").alias("text_md5"))
    total, docs_read = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    copies = cut(copies, "copies", docs_read)
    discard(keyed)
    again = cut(copies.where("doc_id <> first").select("doc_id"), "again")
    shards = 1 << max(0, (total // 6 // SHARD_TOKENS).bit_length())

    texts = without_ids(known, again)
    rows = cut(_set_rows(texts, shards, width), "set-rows")
    path = fresh_dir(spark, "frequent")
    _write_frequent(rows.where("shard is not null").select("shard", "blob"), path, most)
    sets = rows.where("doc_id is not null").select("doc_id", "n", "k1", "k2")
    key = sets.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"))
    sets = cut(sets.join(key, ["n", "k1", "k2"]).select("doc_id", "n", "rep"), "reps", docs_read)
    discard(rows)
    twins = cut(sets.where("doc_id <> rep and n > 0").select("doc_id", "rep"), "twins")
    if not twins.isEmpty():
        alike = small_side(cut(_alike(twins, texts, width).withColumn("alike", F.lit(True)), "alike"), 17)
        sets = cut(sets.join(alike, "doc_id", "left").select("doc_id", "n", F.when(F.col("alike"), F.col("rep")).otherwise(F.col("doc_id")).alias("rep")), "reps", docs_read)
    texts = without_ids(texts, cut(sets.where("doc_id <> rep or n = 0").select("doc_id"), "same"))

    index = cut(_index(texts, path, shards, width, percent), "index")
    rare = cut(_rare_pairs(index, percent), "rare")
    combined = cut(index.where("key is not null").select("key", "id", "n", "rare"), "combined")
    sketches = cut(index.where("sketch is not null").select(F.col("id").alias("doc_id"), "n", "sketch"), "sketches")
    discard(index)
    pivots = combined.groupBy("key").agg(F.min(F.struct("rare", "id", "n")).alias("p"), F.count("*").alias("m")).where("m > 1")
    fits = f"id <> p.id and least(n - rare, p.n - p.rare) >= {_need('n', 'p.n', percent)}"
    star = combined.join(pivots, "key").where(fits).select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"))
    pairs = cut(rare.union(star).distinct(), "pairs")
    discard(rare)
    if every:
        x, y = (combined.select("key", *[F.col(c).alias(f"{c}{i}") for c in ("id", "n", "rare")]) for i in (1, 2))
        near = f"id1 < id2 and least(n1 - rare1, n2 - rare2) >= {_need('n1', 'n2', percent)}"
        rest = x.join(y, "key").where(near).select(F.col("id1").alias("a"), F.col("id2").alias("b"))
        pairs = cut(pairs.union(rest).distinct(), "pairs")
    links = _verified(pairs, texts, sketches, width, percent, every)
    discard(pairs)
    if every:
        links = cut(links.distinct(), "all-links")
        return copies, sets, connected_components(links, most=links.count()), links
    found = connected_components(links, most=links.count())

    left = combined.join(found, "id", "left").select("key", "id", "n", "rare", F.coalesce("component", "id").alias("c"))
    left = cut(left, "combined")
    discard(combined)
    rest = cut(_across(left, percent).distinct(), "pairs")
    if not rest.isEmpty():
        more = _verified(rest, texts, sketches, width, percent)
        if not more.isEmpty():
            links = links.union(more)
            found = connected_components(links)
    return copies, sets, found, links


def _labelled(copies: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    of_rep = sets.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    of_rep = of_rep.select(F.col("doc_id").alias("first"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component"))
    out = copies.join(of_rep, "first")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "text_md5")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op4_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The membership of jaccard_join() with its number of links; op4_ngram_jaccard keeps the columns of its SQL."""
    return jaccard_join(table(spark, sf_dir, "documents"))[1]


SQL = {
    "op4_ngram_jaccard": """
        WITH RECURSIVE w AS (SELECT DISTINCT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
             s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE
                    list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
             u AS (SELECT doc_id, unnest(s) AS x FROM s),
             p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
             l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
             e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
             r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.c) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY 1, 2"""
}
