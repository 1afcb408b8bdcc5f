"""Quality classifier: interpolated modified Kneser-Ney model of trusted text, perplexity against language quantiles.

The classifier counts trigrams of words (WordModels), so its tables grow with the trusted text. perplexities() is the
same kind of model over UTF-16 code units, four of which are one 64-bit number; its tables saturate, and the
classifier does not use it.
"""

from __future__ import annotations

import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, arrow_batches, cut, discard, fresh_dir, looked_up, small_side, table
from .hashing import mixed, names_of, segments

#: Share of a language's trusted documents that stays below its threshold.
QUANTILE = 0.99
#: Texts are dealt to so many folds by their hash; a text is scored by the model of the trusted texts of the other folds.
FOLDS = 2
#: Word trigrams that a task gathers before it hands them on, trusted words for each shard of a model's tables, and shards of a
#: model at most.
FLUSH_WORDS, SHARD_WORDS, MOST_SHARDS = 2_000_000, 8_000_000, 4096
#: Units of text counted at once, and distinct n-grams that a task holds before it hands them on.
CHUNK_UNITS, HELD_GRAMS = 1 << 19, 2_000_000
#: A prime: n-grams are dealt to shards by their remainder, in Spark and in numpy alike.
SHARDS = 61
_BEGIN, _END = "\x02\x02\x02", "\x03"
_UNITS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^ \t-\r]")


def grams_of(text: str | None):
    """The order-4 keys of a whole text, one per unit and one for its end."""
    import numpy as np

    u = np.frombuffer(f"{_BEGIN}{text or ''}{_END}".encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    return (u[:-3] << np.uint64(48) | u[1:-2] << np.uint64(32) | u[2:-1] << np.uint64(16) | u[3:]).astype(np.int64)


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, g, n) of the order-4 n-grams of docs (lang, text), summed in each task before the shuffle."""

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        sums: dict = {}

        def summed(parts):
            g, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(g, kind="stable")
            g, n = g[order], n[order]
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            return g[first], np.add.reduceat(n, first)

        def flush():
            for lang, parts in sums.items():
                g, n = summed(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], ["lang", "g", "n"])

        def add(lang, chunk):
            g, n = np.unique(np.concatenate(chunk), return_counts=True)
            parts = sums.setdefault(lang, [])
            parts.append((g, n))
            if len(parts) >= 16:
                sums[lang] = [summed(parts)]

        for batch in batches:
            chunks: dict = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chunk = chunks.setdefault(lang, [])
                chunk.append(grams_of(text))
                if sum(map(len, chunk)) > CHUNK_UNITS:
                    add(lang, chunk)
                    chunks[lang] = []
            for lang, chunk in chunks.items():
                if chunk:
                    add(lang, chunk)
            if sum(len(g) for parts in sums.values() for g, _ in parts) > 4 * HELD_GRAMS:
                yield from flush()
                sums.clear()
        yield from flush()

    return docs.select("lang", "text").mapInArrow(rows, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))


def kneser_ney(trusted: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Of orders 4 to 1, (lang, g, p) of the seen n-grams and (lang, ctx, b) of what a context leaves to the lower order.

    trusted: lang, text. The highest order has counts, the lower ones the number of distinct units before an n-gram.
    The discounts of counts 1, 2 and 3 or more come from each language's counts of counts (Chen and Goodman); where
    those are too few to give one within its bounds, a half of the count's bound is taken.
    """
    counts = [cut(_counted(trusted), "grams")]
    for bits in (48, 32, 16):
        lower = counts[-1].groupBy("lang", F.col("g").bitwiseAND(F.lit((1 << bits) - 1)).alias("g")).agg(F.count("*").alias("n"))
        counts.append(cut(lower, "grams"))
    out, below = [], None
    for order, c in zip((1, 2, 3, 4), reversed(counts), strict=True):
        n = [F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
        y = F.expr("n1 / (n1 + 2 * n2)")
        d = [F.lit(float(k)) - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0.0)) for k in (1, 2, 3)]
        d = [F.when((x > 0) & (x < k), x).otherwise(k / 2).alias(f"d{k}") for k, x in zip((1, 2, 3), d, strict=True)]
        found = small_side(cut(c.groupBy("lang").agg(*n, F.count("*").alias("kinds")).select("lang", "kinds", *d), "discounts"), 64)
        c = c.join(found, "lang").withColumn("d", F.expr("CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END"))
        ctx = F.shiftrightunsigned("g", 16) if order > 1 else F.lit(0).cast("long")
        c = c.withColumn("ctx", ctx)
        per = cut(c.groupBy("lang", "ctx").agg(F.sum("n").alias("s"), (F.sum("d") / F.sum("n")).alias("b"), F.first("kinds").alias("kinds")), "contexts")
        seen = c.join(per.select("lang", "ctx", "s", "b"), ["lang", "ctx"])
        if below is None:
            lower = F.lit(1.0) / 65536
        else:
            seen = seen.withColumn("low", F.col("g").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))).join(below.select("lang", F.col("g").alias("low"), F.col("p").alias("q")), ["lang", "low"])
            lower = F.col("q")
        seen = cut(seen.select("lang", "g", ((F.col("n") - F.col("d")) / F.col("s") + F.col("b") * lower).alias("p")), "seen")
        out.append((seen, per.select("lang", "ctx", "b")))
        below = seen
    return out[::-1]


def _log_probabilities(wanted: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(lang, g, lp) of wanted (lang, g): joins with the sharded tables of each order, from the highest down."""
    left = wanted
    for order, (seen, contexts) in zip((4, 3, 2, 1), model, strict=True):
        mask, shift = (1 << 16 * order) - 1, 16
        key = F.col("g") if order == 4 else F.col("g").bitwiseAND(F.lit(mask))
        ctx = F.shiftrightunsigned(key, shift) if order > 1 else F.lit(0).cast("long")
        left = left.withColumn("_k", key).withColumn("_c", ctx)
        left = left.join(seen.select("lang", F.col("g").alias("_k"), F.col("p").alias(f"p{order}")), ["lang", "_k"], "left")
        left = left.join(contexts.select("lang", F.col("ctx").alias("_c"), F.col("b").alias(f"b{order}")), ["lang", "_c"], "left").drop("_k", "_c")
    p = F.lit(1.0) / 65536
    for order in (1, 2, 3, 4):
        p = F.coalesce(F.col(f"p{order}"), F.coalesce(F.col(f"b{order}"), F.lit(1.0)) * p)
    return left.select("lang", "g", F.ln(p).alias("lp"))


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(doc_id, lang, perplexity) of every row of docs (doc_id, lang, text), under the model of trusted (lang, text).

    The distinct n-grams of all documents are joined with the model once; the answers are written as sorted shards
    to the shared folder, which scoring tasks map. A null language is "und", a null or empty text is its end alone;
    an n-gram of a language without trusted text has the uniform probability.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    lang = F.coalesce("lang", F.lit("und")).alias("lang")
    rows = docs.select("doc_id", lang, "text")
    model = kneser_ney(trusted.select(lang, "text"))
    wanted = cut(_counted(rows).select("lang", "g"), "wanted")
    told = _log_probabilities(wanted, model).withColumn("shard", F.pmod("g", F.lit(SHARDS)).cast("int"))
    path = fresh_dir(spark, "log-probabilities")
    Store(path)

    def write(pdf):
        pdf, store = pdf.sort_values("g"), Store(path)
        name = f"{pdf['lang'].iloc[0].encode().hex()}-{pdf['shard'].iloc[0]:02d}"
        for kind, values in (("g", pdf["g"].to_numpy("<i8")), ("lp", pdf["lp"].to_numpy("<f8"))):
            made = f"_{uuid.uuid4().hex}"
            with store.create(made) as out:
                out.write(values.tobytes())
            store.rename(made, f"{name}.{kind}")
        return pdf[["shard"]].head(1)

    told.groupBy("lang", "shard").applyInPandas(write, "shard int").agg(F.count("*")).first()

    def score(batches):
        import numpy as np
        import pyarrow as pa

        store, files = Store(path), {}

        def lookup(lang, g):
            out, shard = np.zeros(len(g)), g % SHARDS
            for k in np.unique(shard).tolist():
                if (name := f"{lang.encode().hex()}-{k:02d}") not in files:
                    files[name] = [store.array(f"{name}.{x}", t) for x, t in (("g", "<i8"), ("lp", "<f8"))]
                known, lp = files[name]
                at = shard == k
                out[at] = lp[np.searchsorted(known, g[at])]
            return out

        for batch in batches:
            ids, langs, texts = (c.to_pylist() for c in batch.columns)
            found = [0.0] * len(ids)
            waiting: dict = {}

            def flush(lang, waiting=waiting, found=found):
                held = waiting.pop(lang)
                g, at = np.unique(np.concatenate([x for _, x in held]), return_inverse=True)
                lp, end = lookup(lang, g)[at], 0
                for i, x in held:
                    found[i] = float(np.exp(-lp[end : end + len(x)].mean()))
                    end += len(x)

            for i, (lang, text) in enumerate(zip(langs, texts, strict=True)):
                waiting.setdefault(lang, []).append((i, grams_of(text)))
                if sum(len(x) for _, x in waiting[lang]) > CHUNK_UNITS:
                    flush(lang)
            for lang in list(waiting):
                flush(lang)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["doc_id", "lang", "perplexity"])

    return rows.mapInArrow(score, "doc_id long, lang string, perplexity double")


def word_codes(texts) -> list:
    """Of each text, the 40-bit codes of its units between two begin codes and an end code.

    Units are runs of letters, digits and bytes outside ASCII, and each other character that is not blank.
    """
    import numpy as np

    begin, end, mask = np.array([1, 1], np.uint64), np.array([2], np.uint64), np.uint64((1 << 40) - 1)
    parts = ((names_of(_UNITS.findall(part)) & mask for part in segments((t or "").encode("utf-8", "surrogatepass"))) for t in texts)
    return [np.concatenate([begin, *codes, end]) for codes in parts]


def _key(*codes):
    """A 64-bit key of an n-gram of word codes."""
    import numpy as np

    key = codes[0]
    for code in codes[1:]:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + code)
    return mixed(key)


def _distinct(columns, n):
    """The distinct rows of `columns`, in the order of the first, then the next, and the sum of each one's n."""
    import numpy as np

    order = np.lexsort(columns[::-1])
    columns, n = [c[order] for c in columns], n[order]
    first = np.ones(len(n), bool)
    first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(first)
    return [c[at] for c in columns], np.add.reduceat(n, at) if len(at) else n


def _planes(values) -> bytes:
    """Numbers in their narrowest type as planes of bytes, which compress well."""
    import numpy as np

    values = values.astype(np.min_scalar_type(int(values.max(initial=0))))
    packed = zlib.compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)
    return bytes([values.itemsize]) + len(packed).to_bytes(4, "little") + packed


def _packed(columns, n) -> bytes:
    """Columns of word codes as places in the list of their words, and counts."""
    import numpy as np

    words, at = np.unique(np.concatenate(columns), return_inverse=True)
    return b"".join([_planes(np.diff(words, prepend=np.uint64(0))), *map(_planes, at.reshape(len(columns), -1)), _planes(n)])


def _unpacked(blob: bytes) -> list:
    """The columns and counts of _packed()."""
    import numpy as np

    found, at = [], 0
    while at < len(blob):
        width, size = blob[at], int.from_bytes(blob[at + 1 : at + 5], "little")
        planes = np.frombuffer(zlib.decompress(blob[at + 5 : at + 5 + size]), np.uint8).reshape(width, -1)
        found.append(planes.T.copy().view(f"<u{width}").ravel())
        at += 5 + size
    words = np.cumsum(found[0], dtype=np.uint64)
    return [*[words[x] for x in found[1:-1]], found[-1].astype(np.int64)]


def _tail(codes):
    """32 bits by which a word is found among those that follow one context."""
    import numpy as np

    return (_key(codes) & np.uint64((1 << 32) - 1)).astype("<u4")


def _shard(context, shards: int):
    """The shard of a context key, by its first bits: sorted keys are sorted by shard."""
    import numpy as np

    return (context >> np.uint64(33 - shards.bit_length()) >> np.uint64(32)).astype(np.int64)


def _narrow(values):
    """Numbers in the narrowest unsigned type."""
    import numpy as np

    return values.ravel().astype(np.min_scalar_type(int(values.max(initial=0))).newbyteorder("<"))


def _placed(context, shards: int, bits: int):
    """(bucket, 32 bits that follow) of context keys: a shard's first bits and then `bits` more name the bucket."""
    import numpy as np

    rest = context << np.uint64(shards.bit_length() - 1)
    return (rest >> np.uint64(1) >> np.uint64(63 - bits)).astype(np.int64), (rest << np.uint64(bits) >> np.uint64(32)).astype("<u4")


def _first_not_less(values, low, high, wanted):
    """The places where `wanted` would stand in the sorted ranges [low, high) of `values`, by binary searches side by side."""
    import numpy as np

    out, at = low.astype(np.int64), np.flatnonzero(low < high)
    low, high, wanted = out[at], high[at].astype(np.int64), wanted[at]
    while len(at):
        middle = (low + high) >> 1
        less = values[middle] < wanted
        low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        done = low >= high
        out[at[done]] = low[done]
        at, low, high, wanted = at[~done], low[~done], high[~done], wanted[~done]
    return out


def _write_table(store: Store, name: str, shards: int, context, tail, n) -> None:
    """The contexts of a shard in buckets of about sixteen, where the words after each begin, these words and their
    counts, and of each context its sum and how many words have counts 1, 2 and more.

    Within a bucket 32 bits name a context, and where its words begin counts from the bucket's first; counts and sums are
    places in the list of the different ones. head: the bits of a bucket and the widths of begin, n and sums.
    """
    import numpy as np

    order = np.lexsort((tail, context))
    context, tail, n = context[order], tail[order], n[order]
    begin = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    sums = np.stack([np.add.reduceat(x.astype(np.int64), begin) for x in (n, n == 1, n == 2, n > 2)], 1)
    counts, at = np.unique(n, return_inverse=True)
    kinds, of = np.unique(sums, axis=0, return_inverse=True)
    bits = (len(begin) // 16).bit_length()
    bucket, rest = _placed(context[begin], shards, bits)
    index = np.searchsorted(bucket, np.arange((1 << bits) + 1))
    first = np.append(begin, len(n))[index]
    begin, at, of = _narrow(begin - first[bucket]), _narrow(at), _narrow(of)
    files = {"head": np.array([bits, begin.itemsize, at.itemsize, of.itemsize], "<i8"), "index": index.astype("<u4"), "first": first.astype("<u4"), "rest": rest, "begin": begin, "tail": tail, "n": at, "sums": of, "counts": counts.astype("<i8"), "kinds": kinds.astype("<i8")}
    for part, data in files.items():
        made = f"_{uuid.uuid4().hex}"
        with store.create(made) as out:
            out.write(data.tobytes())
        store.rename(made, f"{name}.{part}")


class _Tables:
    """Look-ups in the written tables: mapped as they are needed, or read, a bounded number of them at a time.

    shards: those of the largest model. names: each table with the shards of its own model.
    """

    def __init__(self, path: str, shards: int, names: dict[str, int], most: int = 8):
        from collections import OrderedDict

        self.store, self.shards, self.names, self.files, self.most = Store(path), shards, names, OrderedDict(), most
        self.own = {name.rsplit("-", 1)[0]: n for name, n in names.items()}

    def _open(self, name: str):
        if name not in self.files:
            of = lambda part, kind: self.store.array(f"{name}.{part}", kind)
            own = {"head": of("head", "<i8")} | {part: of(part, "<u4") for part in ("index", "first", "rest", "tail")}
            own |= {part: of(part, f"<u{width}") for part, width in zip(("begin", "n", "sums"), own["head"][1:].tolist(), strict=True)}
            self.files[name] = own | {"counts": of("counts", "<i8"), "kinds": of("kinds", "<i8").reshape(-1, 4)}
            while not self.store.local and len(self.files) > self.most:
                self.files.popitem(last=False)
        self.files.move_to_end(name)
        return self.files[name]

    def __call__(self, model: str, order: int, context, tail):
        """(counts of the words `tail` after their contexts, [sum, ones, twos, more] of the contexts); zeros for what isn't there."""
        import numpy as np

        own, sums = np.zeros(len(context), np.int64), np.zeros((len(context), 4), np.int64)
        sort = np.argsort(context)
        shards = self.own.get(model, self.shards)
        shard = _shard(context[sort], shards)
        ends = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(sort)) if len(sort) else [0]
        for begin, end in zip(ends[:-1], ends[1:], strict=True):
            if (name := f"{model}-{shard[begin]:06d}.{order}") not in self.names:
                continue
            t, at = self._open(name), sort[begin:end]
            bucket, rest = _placed(context[at], shards, int(t["head"][0]))
            last = t["index"][bucket + 1].astype(np.int64)
            place = _first_not_less(t["rest"], t["index"][bucket], last, rest)
            there = np.flatnonzero(place < last)
            there = there[t["rest"][place[there]] == rest[there]]
            at, place, bucket, last = at[there], place[there], bucket[there], last[there]
            sums[at] = t["kinds"][t["sums"][place]]
            low = t["first"][bucket].astype(np.int64)
            high = t["first"][bucket + 1].astype(np.int64)
            inner = np.flatnonzero(place + 1 < last)
            high[inner] = low[inner] + t["begin"][place[inner] + 1]
            low += t["begin"][place]
            wanted = tail[at]
            word = _first_not_less(t["tail"], low, high, wanted)
            found = np.flatnonzero(word < high)
            found = found[t["tail"][word[found]] == wanted[found]]
            own[at[found]] = t["counts"][t["n"][word[found]]]
        return own, sums


_STATS = ("n1", "n2", "n3", "n4", "kinds", "total")
_PART = "model string, shard int, blob binary, " + ", ".join(f"{c} long" for c in _STATS)


def _parts(model: str, context, columns, n, shards: int) -> list[tuple]:
    """Rows of packed columns by the shard of their context."""
    import numpy as np

    shard, out = _shard(context, shards), []
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in range(shards):
        if ends[k + 1] > ends[k]:
            at = order[ends[k] : ends[k + 1]]
            out.append((model, k, _packed([c[at] for c in columns], n[at]), *[None] * len(_STATS)))
    return out


class WordModels:
    """Modified Kneser-Ney models of word trigrams, one for each language and fold, as sorted tables in the shared folder.

    trusted: lang, fold, text. The model of a fold counts the texts of the other folds. The highest order has counts,
    the lower ones the number of distinct words before an n-gram. The tables hold contexts and the words after them with
    their counts, and of each context its sum and how many of its words have counts 1, 2 and more; the discounts, as in
    kneser_ney(), apply when text is scored. A context's words are in one shard, so each order is counted shard by
    shard and none is gathered whole. A model has shards by the size of its own language's text.
    """

    def __init__(self, trusted: DataFrame):
        spark = trusted.sparkSession
        sizes = trusted.groupBy("lang").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).collect()  # a row a language
        dealt = lambda size: min(MOST_SHARDS, 1 << max(0, (size * (FOLDS - 1) // FOLDS // 5 // SHARD_WORDS).bit_length()))
        self.own = {f"{r['lang'].encode().hex()}-{k}": dealt(r["size"]) for r in sizes for k in range(FOLDS)}
        self.shards = max(self.own.values(), default=1)
        self.path = path = fresh_dir(spark, "word-model")
        Store(path)
        self.stats, self.names = {}, {}
        parts, before = trusted.select("lang", "fold", "text").mapInArrow(self._counting(), _PART), None
        for order in (3, 2, 1):
            made = cut(parts.where("blob is not null").groupBy("model", "shard").applyInPandas(self._table(order), _PART), f"words{order}")
            if before is not None:
                discard(before)
            told = made.where("kinds is not null").select("model", "shard", *_STATS).collect()  # a row of numbers for each shard
            for r in told:
                sums = self.stats.setdefault(r["model"], {}).setdefault(order, [0] * len(_STATS))
                for i, c in enumerate(_STATS):
                    sums[i] += r[c]
                self.names[f"{r['model']}-{r['shard']:06d}.{order}"] = self.own[r["model"]]
            parts = before = made
        discard(before)

    def _counting(self):
        shards = self.own

        def rows(batches):
            import numpy as np
            import pyarrow as pa

            held, size = {}, 0
            schema = pa.schema([("model", pa.string()), ("shard", pa.int32()), ("blob", pa.binary()), *[(c, pa.int64()) for c in _STATS]])

            def flush():
                out = []
                for model, codes in held.items():
                    a, b, c = (np.concatenate([u[i : len(u) - 2 + i] for u in codes]) for i in range(3))
                    (b, a, c), n = _distinct([b, a, c], np.ones(len(a), np.int64))
                    out += _parts(model, _key(a, b), [b, a, c], n, shards[model])
                return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

            for batch in batches:
                langs, folds, texts = (x.to_pylist() for x in batch.columns)
                for lang, fold, codes in zip(langs, folds, word_codes(texts), strict=True):
                    for other in range(FOLDS):
                        if other != fold:
                            held.setdefault(f"{lang.encode().hex()}-{other}", []).append(codes)
                            size += len(codes)
                    if size >= FLUSH_WORDS:
                        yield flush()
                        held.clear()
                        size = 0
            if held:
                yield flush()

        return rows

    def _table(self, order: int):
        shards, path = self.own, self.path

        def table(pdf):
            import numpy as np
            import pandas as pd

            store, model, shard = Store(path), pdf["model"].iloc[0], int(pdf["shard"].iloc[0])
            *columns, n = (np.concatenate(x) for x in zip(*map(_unpacked, pdf["blob"]), strict=True))
            columns, n = _distinct(columns, n)
            context = _key(*columns[:2][::-1]) if order == 3 else _key(columns[0])
            _write_table(store, f"{model}-{shard:06d}.{order}", shards[model], context, _tail(columns[-1]), n)
            out = [(model, shard, None, *[int((n == k).sum()) for k in (1, 2, 3, 4)], len(n), int(n.sum()))]
            if order > 1:
                lower, types = _distinct([columns[0], columns[2]] if order == 3 else [columns[1]], np.ones(len(n), np.int64))
                out += _parts(model, _key(lower[0]), lower, types, shards[model])
            return pd.DataFrame(out, columns=["model", "shard", "blob", *_STATS]).astype({c: "Int64" for c in _STATS})

        return table

    def scorer(self):
        """A function of (batches of doc_id, lang, fold, text) that gives doc_id, lang, fold, perplexity."""
        path, shards, stats, names = self.path, self.shards, self.stats, self.names
        discounts = {(m, o): _discounts(*s[:4]) for m, orders in stats.items() for o, s in orders.items()}

        def score(batches):
            import numpy as np
            import pyarrow as pa

            tables = _Tables(path, shards, names)

            def once(*codes):
                """The places of the first of equal n-grams, and which of them each one is."""
                return np.unique(codes[0] if len(codes) == 1 else _key(*codes), return_index=True, return_inverse=True)[1:]

            def interpolated(model, order, context, tail, p):
                d = discounts[model, order]
                own, sums = tables(model, order, context, tail)
                s = sums[:, 0]
                known = (own - d[np.minimum(own, 3)] + (sums[:, 1:] @ d[1:]) * p) / np.maximum(s, 1)
                return np.where(s > 0, known, p)

            def probabilities(model, a, b, c):
                n1, n2, _, _, kinds, total = stats[model][1]
                d, tail = discounts[model, 1], _tail(c)
                first, which = once(c)  # words repeat, and so do pairs of them: each is looked up once
                own, _ = tables(model, 1, _key(c[first]), tail[first])
                left = (d[1] * n1 + d[2] * n2 + d[3] * (kinds - n1 - n2)) / total
                p = ((own - d[np.minimum(own, 3)]) / total + left / (kinds + 1))[which]
                first, which = once(b, c)
                p = interpolated(model, 2, _key(b[first]), tail[first], p[first])[which]
                return interpolated(model, 3, _key(a, b), tail, p)

            for batch in batches:
                ids, langs, folds, texts = (x.to_pylist() for x in batch.columns)
                found, groups = [65536.0] * len(ids), {}
                for i, (lang, fold) in enumerate(zip(langs, folds, strict=True)):
                    models = [f"{lang.encode().hex()}-{k}" for k in (fold, *range(FOLDS))]
                    if (model := next((m for m in models if m in stats), None)) is not None:
                        groups.setdefault(model, []).append(i)
                for model, rows in groups.items():
                    while rows:
                        taken, size = [], 0
                        while rows and size < CHUNK_UNITS * 6:
                            taken.append(rows.pop())
                            size += len(texts[taken[-1]] or "")
                        codes = word_codes([texts[i] for i in taken])
                        a, b, c = (np.concatenate([u[k : len(u) - 2 + k] for u in codes]) for k in range(3))
                        lp, end = np.log(probabilities(model, a, b, c)), 0
                        for i, u in zip(taken, codes, strict=True):
                            found[i] = float(np.exp(-lp[end : end + len(u) - 2].mean()))
                            end += len(u) - 2
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.float64())], ["doc_id", "lang", "fold", "perplexity"])

        return score


def _discounts(n1: int, n2: int, n3: int, n4: int):
    """Those of counts 0, 1, 2 and 3 or more, from the counts of counts."""
    import numpy as np

    n, out = (n1, n2, n3, n4), [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * n1 / (n1 + 2 * n2) * n[k] / n[k - 1] if n1 + 2 * n2 and n[k - 1] else 0
        out.append(d if 0 < d < k else k / 2)
    return np.array(out)


def word_perplexities(docs: DataFrame, good: DataFrame) -> DataFrame:
    """(doc_id, lang, fold, perplexity) of every row of docs (doc_id, lang, text); documents in good (doc_id) are the trusted text.

    Texts are dealt to FOLDS folds, equal ones to the same; a row is scored by the model of its language that has not
    counted its fold, or by the one there is. A null language is "und"; one without trusted text has 65,536.
    """
    arrow_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int").alias("fold"), "text")
    models = WordModels(looked_up(rows, "doc_id", good, 16, "left_semi"))
    return rows.mapInArrow(models.scorer(), "doc_id long, lang string, fold int, perplexity double")


def quality_scores(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, keep) of every row of docs (doc_id, lang, text).

    Documents that labels (doc_id, quality) call good (1) are the trusted text. All of them are counted and all set
    the thresholds, each scored by a model that did not count it: a document is kept if its perplexity is at most the
    `quantile` of the trusted ones of its language; a language without trusted text keeps all. Repeated rows are
    scored alike, rows without doc_id too; an empty table gives no rows.
    """
    good = cut(labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct(), "good")
    scores = cut(word_perplexities(docs, good), "perplexities")
    limits = scores.join(small_side(good, 16), "doc_id").groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 100_000).alias("threshold"))
    out = scores.join(small_side(cut(limits, "limits"), 64), "lang", "left")
    return out.select("doc_id", "lang", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("keep"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL: dict[str, str] = {}
