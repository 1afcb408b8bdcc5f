"""Each operator of the subpackage against brute force, with the awkward rows: nulls, empties, repeats, clashing names."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import decontaminate, exactdedup, graph, hashing, licenses, ngramjoin, packing, quality, tokenbin, tokens, toxicity, urlfilter, warc

WORDS = [f"w{i}" for i in range(400)]


def corpus(seed=3, n=60):
    r = random.Random(seed)
    base = [" ".join(r.choices(WORDS, k=r.randint(8, 90))) for _ in range(12)]
    texts = [None, "", " ", "a", "a b c", "A b c", "x " * 5000]
    for _ in range(n):
        words = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            words[r.randrange(len(words))] = r.choice(WORDS)
        texts.append(" ".join(words))
    return list(enumerate(texts))


def docs_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.union(df.limit(3)).withColumns({"n": F.lit(1), "shard": F.lit("x"), "item_id": F.lit(2), "lang": F.lit(None).cast("string")})


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(7, 7), (None, 3)]
    up = {}
    root = lambda x: x if up.get(x, x) == x else root(up[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
            up.setdefault(x, x)
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: root(x) for x in got} and len(got) == len({v for e in edges for v in e if None not in e and e[0] != e[1]})
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [1, 128])
def test_jaccard_components(spark, most, monkeypatch):
    monkeypatch.setattr(ngramjoin, "CELL", 4)
    rows = corpus()
    sets = {d: shingles(t, 4) for d, t in rows}
    label = {d: d for d in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = ngramjoin.jaccard_components(docs_of(spark, rows), most=most).collect()
    assert sorted(map(tuple, got)) == sorted((d, len(s), label[d]) for d, s in sets.items())


@pytest.mark.parametrize("most", [1, 128])
def test_jaccard_join_has_every_link(spark, most, monkeypatch):
    monkeypatch.setattr(ngramjoin, "CELL", 4)
    rows = corpus()
    sets = {d: shingles(t, 4) for d, t in rows}
    linked = {(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    pairs, members = (df.collect() for df in ngramjoin.jaccard_join(docs_of(spark, rows), most=most))
    rep = {r.doc_id: r.rep for r in members}
    assert {tuple(sorted((r.rep_a, r.rep_b))) for r in pairs} == {tuple(sorted((rep[a], rep[b]))) for a, b in linked if rep[a] != rep[b]}
    assert {r.doc_id: r.links for r in members} == {d: sum(d in p for p in linked) for d in sets}
    assert all((rep[a] == rep[b]) == (sets[a] == sets[b]) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b])


def test_exact_groups(spark):
    rows = corpus()
    got = {r.doc_id: r for r in exactdedup.exact_groups(docs_of(spark, rows), keep="max").collect()}
    clash = {r.doc_id: r for r in exactdedup.exact_groups(docs_of(spark, rows), keep="max", hashed=lambda c: F.substring(F.md5(c), 1, 1)).collect()}
    for d, t in rows:
        same = [e for e, u in rows if (u or "") == (t or "")]
        for r in (got[d], clash[d]):
            assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), d == max(same))
    left = exactdedup.drop_exact(docs_of(spark, rows)).select("doc_id").collect()
    assert sorted(r.doc_id for r in left) == sorted(d for d in got if got[d].kept)


def test_contained_items(spark):
    rows = corpus()
    item = " ".join(WORDS[100:130])
    rows += [(500, "pre fix " + item + " post fix " * 300), (501, "words " + " ".join(WORDS[100:115]) + " other")]
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "zz yy")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    assert [(r.doc_id, r.item_id, r.shared) for r in decontaminate.contained_items(docs_of(spark, rows), items).collect()] == [(500, 1, 26)]


def test_licences(spark):
    rows = [(1, None), (2, ""), (3, "first line\nReleased under the MIT License.\nlast"), (4, "Licensed under CC BY-NC 4.0."), (5, "no licence here at all")]
    got = licenses.licence_matches(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id, r.line_no, r.licence) for r in got) == [(3, 2, "MIT/short"), (4, 0, "CC-BY-NC-4.0/short")]


def test_licence_blocks(spark):
    import textwrap

    wrapped = "\n".join(f"# {x}" for x in textwrap.wrap(licenses.TEMPLATES["Apache-2.0/notice"], 60))
    code = "\n".join(f"call w{i} of the w{i + 1}" for i in range(80))
    rows = [
        (1, f"{code}\n{wrapped}\n{code}"), (2, "some words before it " * 5 + licenses.TEMPLATES["Unlicense/notice"] + " and words after it" * 5),
        (3, f"{code}\n{chr(10).join(textwrap.wrap(licenses.TEMPLATES['MIT/text'], 70))}\n{code}\n{wrapped}"), (4, code), (5, "Released under the MIT License."),
    ]
    got = licenses.licence_matches(docs_of(spark, rows)).collect()
    assert {(1, 81, "Apache-2.0/notice"), (2, 1, "Unlicense/notice"), (3, 81, "MIT/text"), (5, 0, "MIT/short")} <= {(r.doc_id, r.line_no, r.licence) for r in got}
    assert {r.licence for r in got if r.doc_id == 3} >= {"MIT/text", "Apache-2.0/notice"} and [r.doc_id for r in got].count(5) == 1 and 4 not in {r.doc_id for r in got}
    assert all(r.dice == 1.0 for r in got if r.licence.endswith(("/notice", "/text")))


def test_url_filter(spark):
    rows = [
        (1, "http://A.com/en/1#x", '<link rel="canonical" href="https://alias.info/p">'),
        (2, "https://alias.info/p", None),
        (3, "http://www.example.com/en/70?q", '<meta http-equiv="refresh" content="0;url=http://a.com/en/1">'),
        (4, None, ""), (5, "no scheme", ""), (6, "http://com", "<link rel=canonical href=/q>"), (6, "http://com", ""),
    ]
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judged_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [
        (1, "a.com", "/en/1", "com/en/", "block"), (2, "alias.info", "/p", None, "block"), (3, "www.example.com", "/en/70", "example.com/en/7", "allow"),
        (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "com", "", None, "allow"), (6, "com", "", None, "allow"),
    ]


def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary()).encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_encoder_and_token_files(spark, tmp_path):
    rows = corpus(n=10) + [(900, "It's ́ İstanbul ΑΣ é 12ab\r\n\x1c<|endoftext|> naïve"), (901, "日本 😀".encode("utf-16", "surrogatepass").decode("utf-16"))]
    want, start = [], 0
    for d, t in sorted(rows):
        ids = plain_ids(t)
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "ids")
    got = tokenbin.read_ids(spark, path, tokenbin.write_ids(df, path, tokens.default_vocabulary(), shard_bytes=4000))
    assert sorted(map(tuple, got.collect())) == want
    assert tokenbin.read_ids(spark, path, tokenbin.write_ids(df.limit(0), path, tokens.default_vocabulary())).count() == 0


def test_packing(spark):
    rows = corpus(n=10)
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), tokens.default_vocabulary(), group_docs=8).collect()
    ids = {d: plain_ids(t) for d, t in rows}
    for d, own in ids.items():
        at = 0
        for r in sorted((r for r in got if r.doc_id == d), key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == crc(own[at : at + r.length]) and r.doc_tokens == len(own)
            at += r.length
        assert at == len(own)
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.first_fit_decreasing([3, 5, 4, 2], 7) == [(1, 4), (0, 0), (1, 0), (0, 5)]


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/ b", "same"), (5, None, "same"), (2, "http://c", None), (3, "http://d", ""), (4, "http://e", "x" * 100_000), (6, "http://f", "é")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(1))
    files = warc.write_warc(df, str(tmp_path / "w"), roll_bytes=600, part_bytes=50_000)
    got = {r.page_id: r for r in warc.read_warc(spark, str(tmp_path / "w"), files).collect()}
    assert len(files) > 2 and len(got) == 6 and (got[1].record_type, got[1].refers_to) == ("revisit", 5) and got[3].record_type == "response"
    assert got[2].refers_to == 3 and got[6].payload_bytes == 2 and got[4].payload_bytes == 100_000
    again = warc.write_warc(df, str(tmp_path / "v"), roll_bytes=600, part_bytes=50_000)
    assert again == files


def test_toxicity(spark):
    r = random.Random(1)
    clean = [" ".join(r.choices(WORDS, k=30)) for _ in range(300)]
    rows = [(i, t + (" blarg idiot" if i % 7 == 0 else "")) for i, t in enumerate(clean)] + [(1000, None), (1001, "")]
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(300)] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    docs = docs_of(spark, rows)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, labels)).collect()}
    assert all(got[i].predicted == int(i % 7 == 0) for i in range(300)) and got[1000].predicted == 0
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert toxicity.fit_toxicity(docs, labels.limit(0))["weights"]["idiot"] > 0


def test_label_model_corrects_labels():
    r = np.random.default_rng(2)
    truth = np.arange(600) % 6 == 0
    votes = (r.random((600, 5)) < np.where(truth[:, None], 0.6, 0.02)).astype(np.int8)
    labels = np.where(np.arange(600) % 2, -1, truth)
    wrong = np.flatnonzero((labels == 0) & (votes.sum(1) == 0))[:3]
    labels[wrong] = 1
    posterior, voters = toxicity.label_posteriors(votes, labels)
    assert (posterior[wrong] < 0.5).all() and voters[-1][0] < voters[-1][1]
    unlabelled = (labels < 0) & (votes.sum(1) > 1) & truth
    assert (posterior[unlabelled] > 0.5).all()
    assert all({w for w in toxicity.features_of(t) if w[0] == "/"} for t in ("Du bist ein Trottel", "Tu es un crétin", "Eres un imbécil"))


def brute_kn(texts):
    """Plain interpolated modified Kneser-Ney of order 4 over characters."""
    from collections import Counter

    c = {4: Counter(u[i : i + 4] for t in texts for u in ["\x02\x02\x02" + t + "\x03"] for i in range(len(u) - 3))}
    for k in (3, 2, 1):
        c[k] = Counter(g[1:] for g in c[k + 1])
    d = {}
    for k, table in c.items():
        n = Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        for j in (1, 2, 3):
            x = j - (j + 1) * y * n[j + 1] / n[j] if y is not None and n[j] else None
            d[k, j] = x if x is not None and 0 < x < j else j / 2
    ctx = {k: {} for k in c}
    for k, table in c.items():
        for g, n in table.items():
            s = ctx[k].setdefault(g[:-1], [0, 0.0])
            s[0] += n
            s[1] += d[k, min(n, 3)]

    def p(g):
        k = len(g)
        if not k:
            return 1 / 65536
        if g[:-1] not in ctx[k]:
            return p(g[1:])
        s, taken = ctx[k][g[:-1]]
        n = c[k][g]
        return (n - d[k, min(n, 3)] if n else 0) / s + taken / s * p(g[1:])

    return p


def test_quality(spark):
    import math

    rows = [(i, t, "en") for i, t in corpus(n=20)] + [(700, "unseen ÄÖ", "en"), (701, "other", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = [t for i, t, _ in rows if i < 20 and t]
    p = brute_kn(good)
    got = {r.doc_id: r.perplexity for r in quality.perplexities(docs, docs.where("doc_id < 20 and text <> ''")).collect()}
    for i, t, lang in rows:
        u = "\x02\x02\x02" + (t or "") + "\x03"
        want = math.exp(-sum(math.log(p(u[k : k + 4])) for k in range(len(u) - 3)) / (len(u) - 3)) if lang else 65536.0
        assert got[i] == pytest.approx(want, rel=1e-6)
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert quality.quality_scores(docs, labels).where("lang = 'und' and keep").count() == 1


def test_word_models(spark, monkeypatch):
    import math
    from collections import Counter

    monkeypatch.setattr(quality, "SHARD_WORDS", 200)
    monkeypatch.setattr(quality, "FLUSH_WORDS", 500)
    rows = [(i, t, "en") for i, t in corpus(n=30)] + [(700, "unseen ÄÖ, w1 w2", "en"), (701, "other", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.word_perplexities(docs, docs.where("doc_id < 25").select("doc_id")).collect()}
    cut = lambda t: ["\x02", "\x02", *re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^\s]", t or ""), "\x03"]
    assert {r.fold for r in got.values()} == {0, 1} and got[701].perplexity == 65536.0
    for fold in (0, 1):
        trusted = [cut(t) for i, t, _ in rows if i < 25 and got[i].fold != fold]
        c = {3: Counter(tuple(u[i : i + 3]) for u in trusted for i in range(len(u) - 2))}
        for k in (2, 1):
            c[k] = Counter(g[1:] for g in c[k + 1])
        d = {k: quality._discounts(*[Counter(c[k].values())[j] for j in (1, 2, 3, 4)]) for k in c}

        def p(g):
            if not g:
                return 1 / (len(c[1]) + 1)
            k = len(g)
            s = {h: n for h, n in c[k].items() if h[:-1] == g[:-1]}
            if not s:
                return p(g[1:])
            n, total = c[k][g], sum(s.values())
            return (n - d[k][min(n, 3)]) / total + sum(d[k][min(n, 3)] for n in s.values()) / total * p(g[1:])

        for i, t, lang in rows:
            if lang and got[i].fold == fold and len(t or "") < 9000:
                u = cut(t)
                want = math.exp(-sum(math.log(p(tuple(u[k : k + 3]))) for k in range(len(u) - 2)) / (len(u) - 2))
                assert got[i].perplexity == pytest.approx(want, rel=1e-6)


def test_quality_is_of_words(spark):
    r = random.Random(9)
    say = lambda k: " ".join(r.choices(WORDS, [1 / (1 + i) for i in range(400)], k=k))
    rows = [(i, say(60), "en") for i in range(120)] + [(500, " ".join(["w399"] * 60), "en")]
    got = {x.doc_id: x for x in quality.quality_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1) for i in range(120)], "doc_id long, quality int")).collect()}
    assert not got[500].keep and sum(got[i].keep for i in range(120)) >= 118


def test_shingle_sets_sizes():
    texts = [t for _, t in corpus()]
    got = list(hashing.shingle_sets(texts, 4))
    assert [len(s) for s in got] == [len(shingles(t, 4)) for t in texts]


def test_sketches_lose_no_link():
    rng, n, sketches, sets = np.random.default_rng(5), {}, {}, {}
    for base in range(12):
        size = int(rng.integers(2, 900))
        whole = rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2)
        for k in range(4):
            part = whole[rng.random(size) < 1 - 0.06 * k]
            sets[4 * base + k] = np.unique(np.append(part, rng.integers(0, 1 << 63, int(size * 0.04 * k), np.uint64)))
    sets[99] = np.arange(3000, dtype=np.uint64)  # all begin alike: no sketch can hold the count
    for d, s in sets.items():
        n[d], sketches[d] = len(s), ngramjoin.sketch(s)
    assert sketches[99] == b""
    a, b = (np.array(x) for x in zip(*itertools.combinations(sorted(sets), 2)))
    kept = ngramjoin.could_link(a, b, n, sketches, 85)
    both = np.array([len(np.intersect1d(sets[x], sets[y])) for x, y in zip(a, b)])
    union = np.array([n[x] + n[y] for x, y in zip(a, b)]) - both
    assert kept[(union > 0) & (100 * both >= 85 * union)].all()
    far = (a // 4 != b // 4) & (a != 99) & (b != 99) & np.isin(a, [d for d in n if n[d] > 50]) & np.isin(b, [d for d in n if n[d] > 50])
    assert not kept[far].any()
