"""Cases that break careless versions of the operators: colliding words, hot and null ids, maps in place of broadcasts, lost links."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfspark.llm import common, decontaminate, exactdedup, licenses, ngramjoin, packing, quality, ranges, tokenbin, tokens, toxicity, urlfilter, warc


def thue_morse(k):
    """Two words of 2**k letters that any polynomial hash modulo 2**64 takes for one from k = 11 on."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << k))
    return word, word.translate(str.maketrans("ab", "ba"))


def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary()).encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_colliding_words_stay_apart(spark, tmp_path):
    x, y = thue_morse(11)
    rest = " c d e f g h i j k l m n o"
    rows = [(1, x), (2, y), (3, x + rest), (4, y + rest), (5, f"{x} {y} {x}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ngramjoin.jaccard_components(df).collect()}
    assert [got[d].component_id for d in range(1, 6)] == [1, 2, 3, 4, 5]
    pairs, _ = ngramjoin.jaccard_join(df, percent=50)
    assert {tuple(sorted(r)) for r in pairs.collect()} == {(3, 4)}
    want = {d: crc(plain_ids(t)) for d, t in rows}
    path = str(tmp_path / "ids")
    got = tokenbin.read_ids(spark, path, tokenbin.write_ids(df, path, tokens.default_vocabulary())).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == want and want[1] != want[2]
    got = packing.packed(df, tokens.default_vocabulary(), capacity=1 << 20).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == want


def test_long_texts_are_encoded_in_parts(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 50)
    texts = ["", None, "It's naïve  \n\n x " * 20, "a" * 500 + " b", "\n"]
    assert [list(i) + [1] for i in tokens.PieceEncoder(tokens.default_vocabulary()).encode(texts)] == [plain_ids(t) for t in texts]


def test_equal_sets_of_other_texts_and_repeated_ids(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, base), (2, base.upper().replace(" ", "\n\t")), (3, base + " w0 w1 w2 w3"), (7, base), (7, "other words in this text"), (7, "other words in this text"), (9, None), (None, base)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 37, 1), (2, 37, 1), (3, 40, 1), (7, 2, 7), (7, 37, 1), (9, 0, 9)]


def test_byte_ranges_follow_the_rows_alone(spark):
    r = random.Random(4)
    rows = [(None if i % 9 == 0 else 7 if i % 3 == 0 else r.randrange(-500, 500), r.randrange(-(1 << 62), 1 << 62), r.randrange(1, 400)) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, x long, size long")
    order = sorted(rows, key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
    found = []
    for parts in (1, 7):
        n, place = ranges.byte_ranges(df.repartition(parts), 5000)
        found.append(sorted(map(tuple, df.select("k", "x", "size", place(F.col("k"), F.col("x")).alias("p")).collect()), key=lambda t: (t[0] is not None, t[0] or 0, t[1])))
        assert n == 1 + max(t[3] for t in found[-1])
    assert found[0] == found[1] and [t[:3] for t in found[0]] == order and [t[3] for t in found[0]] == sorted(t[3] for t in found[0])
    sums = [sum(t[2] for t in found[0] if t[3] == p) for p in range(n)]
    assert max(sums) <= 5400 and len({t[3] for t in found[0] if t[0] == 7}) > 3
    assert ranges.byte_ranges(df.limit(0), 10)[0] == 1


def test_two_writes_give_the_same_archives(spark, tmp_path):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id")).cast("long").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"),
                                    F.when(F.col("id") % 4 == 0, F.lit("same")).otherwise(F.repeat(F.md5(F.col("id").cast("string")), 4)).alias("html"))
    made = []
    for i, parts in enumerate((3, 11)):
        made.append(warc.write_warc(df.repartition(parts, "url"), str(tmp_path / str(i)), roll_bytes=100_000, part_bytes=200_000))
    assert made[0] == made[1] and len(made[0]) > 10 and sum(f["records"] for f in made[0]) == 20_000
    assert max(f["records"] for f in made[0]) < 4000  # the hot id is spread
    got = warc.read_warc(spark, str(tmp_path / "0"), made[0])
    same = got.where("payload_bytes = 4").groupBy("record_type", "refers_to").count().collect()
    top = max(i if i % 3 else 5 for i in range(0, 20_000, 4) if i % 50 != 1 or i % 3 == 0)
    assert {r.refers_to for r in same if r.record_type == "revisit"} == {top}


def test_token_files_spread_a_hot_id(spark, tmp_path):
    rows = [(5, f"text number {i} of one id") for i in range(300)] + [(1, "a"), (9, None), (None, "never")]
    df, path = spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "ids")
    shards = tokenbin.write_ids(df, path, tokens.default_vocabulary(), shard_bytes=1000)
    got = sorted(tokenbin.read_ids(spark, path, shards).collect(), key=lambda r: r.start)
    assert len(shards) > 4 and [r.doc_id for r in got] == [1] + [5] * 300 + [9]
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1] and sorted(r.ids_crc32 for r in got) == sorted(crc(plain_ids(t)) for d, t in rows if d is not None)


def test_packing_spreads_rows_without_id(spark):
    df = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text")).withColumn("_g", F.lit("clash"))
    got = packing.packed(df, tokens.default_vocabulary(), group_docs=100)
    assert got.count() == 2000 and got.groupBy((F.col("sequence_id") / (1 << 32)).cast("long").alias("g")).count().agg(F.max("count")).first()[0] < 200


def test_maps_in_place_of_broadcasts(spark, monkeypatch):
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    item = " ".join(r.choices(words, k=40))
    texts = [" ".join(r.choices(words, k=60)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:7])] + [(100, texts[0][:50] + " " + item + " tail"), (101, "zz yy"), (102, "before zz yy after it all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_map": F.lit(1), "_x": F.lit(2), "_own": F.lit(3)})
    items = spark.createDataFrame([(1, item), (2, "ZZ yy"), (3, texts[3])], "item_id long, text string")
    of = lambda df: sorted(map(str, df.collect()))
    want = [of(decontaminate.contained_items(docs, items)), of(exactdedup.exact_groups(docs)), of(exactdedup.drop_exact(docs))]
    assert {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, items).collect()} == {(100, 1), (101, 2), (102, 2), (3, 3), (43, 3)}
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common, "MAP_BITS", 12)
    assert [of(decontaminate.contained_items(docs, items)), of(exactdedup.exact_groups(docs)), of(exactdedup.drop_exact(docs))] == want
    held = common.possible(docs, "doc_id", docs.where("doc_id in (3, 5)").select("doc_id"))
    assert {3, 5} <= {r.doc_id for r in held.collect()} and held.count() < 10


def test_components_and_stages_with_maps(spark, tables, monkeypatch):
    def told():
        docs = awkward(spark)
        out = [sorted(map(str, ngramjoin.jaccard_components(docs.union(docs.withColumn("doc_id", F.col("doc_id") + 50)), percent=60).collect()))]
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.cut(stage(spark, docs, tables), name)
            out.append(sorted(map(str, docs.collect())))
        return out

    want = told()
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common, "MAP_BITS", 10)
    assert told() == want


def test_dropping_copies_keeps_other_texts_of_an_id(spark):
    rows = [(1, "a", 1), (2, "a", 2), (2, "b", 3), (2, "b", 4), (None, "a", 5), (None, "c", 6), (None, "c", 7), (3, None, 8), (4, "", 9)]
    left = exactdedup.drop_exact(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    assert sorted(map(str, (tuple(r) for r in left.collect()))) == sorted(map(str, [(2, "a", 2), (2, "b", 3), (None, "c", 6), (4, "", 9)]))


def test_addresses_and_random_links(spark):
    same = [
        ("HTTP://Alias.INFO:80/a/./b/../c#x", "http://alias.info/a/c"), ("https://h.org:443", "https://h.org/"), ("http://h.org./p?q#f", "http://h.org/p?q"), ("http://h/a/..", "http://h/"),
        ("http://h/a/b/.", "http://h/a/b/"), ("http://h:8080/x", "http://h:8080/x"), ("plain#f", "plain"), ("http://h/a//b", "http://h/a//b"), (None, None),
    ]
    got = spark.createDataFrame(same, "a string, b string").select(urlfilter.address(F.col("a")).alias("a"), "b").collect()
    assert [r.a for r in got] == [r.b for r in got]
    tag = lambda t: urlfilter.link_edges(spark.createDataFrame([("http://A.com/d/p?q", t)], "url string, html string")).collect()
    for html, want in (
        ("<link rel='alternate canonical' href='x&amp;y'>", "http://a.com/d/x&y"), ('<link href="?z" rel="canonical">', "http://a.com/d/p?z"), ("<LINK REL=canonical HREF=//B.com>", "http://b.com/"),
        ('<meta http-equiv="refresh" content="0; URL=\'../up\'">', "http://a.com/up"), ('<link rel="canonical" href="#top">', "http://a.com/d/p?q"),
    ):
        assert [tuple(r) for r in tag(html)] == [("http://a.com/d/p?q", want)]
    assert tag('<link rel="canonicalish" href="x">') == [] == tag('<link rel="stylesheet" href="x">')
    r = random.Random(3)
    names = [f"http://{r.choice(['H', 'h'])}{i}.{r.choice(['com', 'net', 'info'])}/{r.choice(['en', 'de'])}/{i}" for i in range(900)]
    edges = [tuple(r.sample(range(900), 2)) for _ in range(1000 // 2)]
    html = {}
    for a, b in edges[:250]:
        html[a] = html.get(a, "") + f'<link rel="canonical" href="{names[b].replace("http", "HTTP")}#f">'
    pages = spark.createDataFrame([(i, n, html.get(i)) for i, n in enumerate(names)], "page_id long, url string, html string")
    redirects = spark.createDataFrame([(names[a], names[b]) for a, b in edges[250:]], "a string, b string")
    up = list(range(900))
    root = lambda x: x if up[x] == x else root(up[x])
    for a, b in edges:
        up[root(a)] = root(b)
    rule = lambda n: max(((len(h + p), act) for act, h, p in urlfilter.RULES for host in [n.split("/")[2].lower()] if (host == h or host.endswith("." + h)) and ("/" + n.split("/", 3)[3]).startswith(p)), default=(0, None))[1]
    bad = {root(i) for i, n in enumerate(names) if rule(n) == "block"}
    want = {i: rule(n) or ("block" if root(i) in bad else "allow") for i, n in enumerate(names)}
    got = {x.page_id: x.verdict for x in urlfilter.judged_pages(pages, redirects=redirects).collect()}
    assert got == want and len(set(want.values())) == 2


def test_rules_of_the_contract(spark):
    """The contract's list: block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/."""
    urls = {"http://a.com/en/1": "block", "http://example.com/en/7": "allow", "http://a.net/de/1": "allow", "http://www.example.net/de/1": "allow", "http://www.example.net/de/8": "block", "http://a.org/es/": "block", "http://a.org/en/": "allow"}
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["verdict"], r["rule"]) for r in urlfilter.judged_pages(pages).collect()}
    assert [got[i][0] for i in range(len(urls))] == list(urls.values())
    assert got[3][1] == "net/de/" and got[4][1] == "example.net/de/8"


def test_many_rules_are_a_table(spark):
    r = random.Random(6)
    rules = [(r.choice(["block", "allow"]), ".".join(r.choices(["a", "b", "com"], k=r.randint(1, 3))), r.choice(["", "/", "/x", "/x/y"])) for _ in range(300)]
    rules = list({(h, p): (a, h, p) for a, h, p in rules}.values())
    pages = spark.createDataFrame([(i, f"http://{'.'.join(r.choices(['a', 'b', 'com', 'c'], k=r.randint(1, 4)))}{r.choice(['', '/x', '/x/y/z', '/q'])}", None) for i in range(200)] + [(900, None, None), (901, "none", None)], "page_id long, url string, html string")
    small = sorted(map(str, urlfilter.judged_pages(pages, rules[:60]).collect()))
    table = lambda n: spark.createDataFrame(rules[:n], "action string, host string, path string")
    assert sorted(map(str, urlfilter.judged_pages(pages, table(60)).collect())) == small
    assert urlfilter.judged_pages(pages, rules * 2).count() == 202


def test_every_template_matches_itself(spark):
    templates = licenses.TEMPLATES | {"dots": "a.b.c.d.e.f.g.h.i.j"}
    rows = [(i, t) for i, t in enumerate(templates.values())]
    got = licenses.licence_matches(spark.createDataFrame(rows + rows[:2], "doc_id long, text string"), templates).where("line_no = 0 and dice = 1.0").collect()
    assert {(r.doc_id, r.licence) for r in got} == set(enumerate(templates)) and len(got) == len(templates)


def brute_units(text, templates, threshold):
    """The best template of the whole text and of each line."""
    import re

    pairs = lambda t: {p for w in [[x for x in re.split(r"[\W_]+", t.lower()) if x]] for p in zip(w, w[1:])}
    lines = text.split("\n")
    out = {}
    for no, unit in [(0, text), *(enumerate(lines, 1) if len(lines) > 1 else [])]:
        own = pairs(unit)
        best = min(((-2 * len(own & pairs(t)) / (len(own) + len(pairs(t))), k) for k, t in templates.items() if own), default=(0, ""))
        if -best[0] >= threshold:
            out[no] = (best[1], -best[0])
    return out


def test_units_against_brute_force(spark):
    r = random.Random(12)
    templates = {f"t{k}": " ".join(r.choices("abcdefgh", k=r.randint(3, 14))) for k in range(6)}
    texts = ["\n".join(" ".join(r.choices("abcdefgh", k=r.randint(0, 5)) + (r.choice(list(templates.values())).split()[: r.randint(2, 14)] if r.random() < 0.6 else [])) for _ in range(r.randint(1, 4))) for _ in range(60)]
    got = licenses.licence_matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates).collect()
    for i, t in enumerate(texts):
        want = brute_units(t, templates, 0.8)
        told = {(x.line_no, x.licence, round(x.dice, 9)) for x in got if x.doc_id == i}
        assert {(no, k, round(d, 9)) for no, (k, d) in want.items()} <= told


def plain_em(votes, labels, rounds):
    """label_posteriors() spelt out for one row after the other."""
    n = [sum(v) for v in votes]
    rows = [[*map(float, v), float(k == 1), float(k == 0)] for v, k in zip(votes, n)]
    voters, q = range(len(rows[0])), [float(x) for x in labels]
    for step in range(rounds):
        share = [1.0 if step or x >= 0 else 0.0 for x in labels]
        use = [min(max(x, 0.02), 0.98) if x >= 0 else p for x, p in zip(labels, q)]
        hot, cold = sum(s * u for s, u in zip(share, use)) + 1e-9, sum(s * (1 - u) for s, u in zip(share, use)) + 1e-9
        a = [min(max((sum(s * u * r[j] for s, u, r in zip(share, use, rows)) + 0.1) / (hot + 1), 1e-4), 1 - 1e-4) for j in voters]
        b = [min(max((sum(s * (1 - u) * r[j] for s, u, r in zip(share, use, rows)) + 0.1) / (cold + 10), 1e-5), 1 - 1e-4) for j in voters]
        excess = [[0.0] * len(voters) for _ in voters]
        for weights, rate in (([s * u for s, u in zip(share, use)], a), ([s * (1 - u) for s, u in zip(share, use)], b)):
            whole = sum(weights)
            cov = [[sum(w * (r[i] - rate[i]) * (r[j] - rate[j]) for w, r in zip(weights, rows)) / (whole + 1e-9) for j in voters] for i in voters]
            for i in voters:
                for j in voters:
                    excess[i][j] += cov[i][j] / math.sqrt(max(cov[i][i], 1e-9)) / math.sqrt(max(cov[j][j], 1e-9)) * whole / sum(share)
        say = [1 / (1 + sum(max(excess[i][j] - 0.1, 0) for j in voters if j != i)) for i in voters]
        now = [1 / (1 + math.exp(-min(max(sum(r[j] * (math.log(a[j]) - math.log(b[j])) * say[j] for j in voters) + math.log(hot / cold), -30), 30))) for r in rows]
        moved, q = max(abs(x - y) for x, y in zip(now, q)), now
        if moved < 1e-4:
            break
    return q


def test_label_model_against_plain_em():
    r = np.random.default_rng(5)
    truth = r.random(90) < 0.3
    votes = (r.random((90, 4)) < np.where(truth[:, None], [0.7, 0.5, 0.4, 0.6], [0.05, 0.1, 0.02, 0.2])).astype(np.int8)
    votes = np.concatenate([votes, votes[:, :1]], 1)  # a copy of the first voter
    labels = np.where(np.arange(90) % 3 == 0, -1, truth.astype(int))
    got, voters = toxicity.label_posteriors(votes, labels, rounds=12)
    assert got == pytest.approx(plain_em(votes.tolist(), labels.tolist(), 12), abs=1e-6)
    assert voters[0][2] < 0.75 * voters[1][2]  # copies share their say
    assert ((got > 0.5) == truth).mean() > 0.8


def test_linear_fit_against_plain_descent():
    r = random.Random(2)
    rows = [[k for k in range(5) if r.random() < 0.4] for _ in range(80)]
    soft = np.array([min(1.0, 0.1 + 0.4 * (0 in x) + 0.3 * (3 in x)) for x in rows])
    bias, weights = toxicity.linear_fit(rows, soft, 5, l2=0.01, steps=3000)
    b, w = 0.0, [0.0] * 5
    for _ in range(6000):
        p = [1 / (1 + math.exp(-(b + sum(w[k] for k in x)))) for x in rows]
        gb = sum(pi - t for pi, t in zip(p, soft)) / len(rows)
        g = [sum(pi - t for pi, t, x in zip(p, soft, rows) if k in x) / len(rows) + 0.01 * w[k] for k in range(5)]
        b, w = b - 2 * gb, [wk - 2 * gk for wk, gk in zip(w, g)]
    assert bias == pytest.approx(b, abs=0.02) and list(weights) == pytest.approx(w, abs=0.02)


def test_the_label_model_decides(spark):
    """Without it, on the bare labels, another classifier comes out: wrong labels are learnt."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    insults = ["idiot", "moron", "stupid", "scum", "vermin", "filth"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        rows.append((i, " ".join(r.choices(words, k=20) + (r.sample(insults, 3) if toxic else []) + (["oddword"] if i % 8 == 1 else []))))
        labels.append((i, int(toxic or i % 8 == 1)))  # an innocent word is labelled toxic throughout
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, told)
    bare = toxicity.fit_toxicity(docs, told, label_model=False)
    assert all(model["weights"].get(w, 0) > 0.5 for w in insults) and model["weights"] != bare["weights"]
    assert abs(bare["weights"]["oddword"] - model["weights"].get("oddword", 0.0)) > 0.1


AWKWARD = [(1, None), (2, ""), (3, "a b"), (4, "one two three four five six seven eight nine ten"), (5, "one two three four five six seven eight nine ten"), (5, "another text of the same id, long enough for shingles"), (5, "another text of the same id, long enough for shingles"), (None, "no id here but words enough for a shingle"), (None, None), (8, "x " * 30_000)]


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def awkward(spark, rows=AWKWARD):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "text_md5": F.lit(b"x"), "predicted": F.lit(1), "_d": F.lit(2), "component_id": F.lit(0), "item_id": F.lit(9), "kept": F.lit(False)})


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, tables, stage):
    function = dict(corpus_pipeline.STAGES)[stage]
    docs = awkward(spark)
    out = function(spark, docs, tables)
    assert function(spark, docs.limit(0), tables).count() == 0
    if stage == "packing":
        assert out.count() >= docs.count() and out.where("doc_tokens = 1").count() == 3
        return
    assert out.columns == docs.columns
    left = sorted(((r.doc_id, (r.text or "")[:20]) for r in out.collect()), key=str)
    whole = sorted(((d, (t or "")[:20]) for d, t in AWKWARD), key=str)
    gone = {"toxicity": [], "exact_dedup": [(4, "one two three four f"), (5, "another text of the "), (1, ""), (None, "")], "near_duplicates": [(5, "one two three four f")], "decontamination": [(4, "one two three four f"), (5, "one two three four f")]}[stage]
    for g in gone:
        whole.remove(g)
    assert left == whole


def test_pipeline_against_brute_force(spark, tables):
    r = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(r.choices(words, k=40)) for _ in range(30)]
    near = texts[3].split()
    near[20] = "other"
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, texts[5]), (51, texts[5]), (60, texts[3] + " tail"), (70, texts[7][:60] + " " + item), (80, None), (81, "")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tables}/documents.parquet")
    got = corpus_pipeline.run(spark, tables).collect()
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{tables}/labels.parquet"))
    toxic = {x.doc_id for x in toxicity.toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), model).collect() if x.predicted}
    left = {d: t or "" for d, t in rows if d not in toxic}
    left = {d: t for d, t in left.items() if d == max(e for e, u in left.items() if u == t)}
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t.split() else set() for d, t in left.items()}
    linked = lambda a, b: bool(sets[a] and sets[b]) and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    left = {d: t for d, t in left.items() if not any(e < d and linked(d, e) for e in left)}
    left = {d: t for d, t in left.items() if item not in t}
    assert {x.doc_id: x.doc_tokens for x in got} == {d: len(plain_ids(t)) for d, t in left.items()} and 70 not in left and 60 not in left and 50 not in left


def test_word_tables_beyond_local_maps(spark, monkeypatch):
    """The tables of a remote folder are read a few at a time and tell the same."""
    r = random.Random(7)
    docs = spark.createDataFrame([(i, " ".join(r.choices([f"w{k}" for k in range(60)], k=30)), "en") for i in range(40)], "doc_id long, text string, lang string")
    monkeypatch.setattr(quality, "SHARD_WORDS", 30)
    models = quality.WordModels(docs.select(F.lit("en").alias("lang"), (F.col("doc_id") % 2).cast("int").alias("fold"), "text"))
    tables = quality._Tables(models.path, models.shards, models.names, most=2)
    codes = quality.word_codes(["w1 w2 w3 w4 w5 nothing"])[0]
    ask = lambda t, n: [x.tolist() for x in t("656e-0", 2, quality._key(codes[1:-1]), quality._tail(codes[2:]))]
    want = ask(tables, 2)
    tables.store.local, tables.files = False, type(tables.files)()
    assert ask(tables, 2) == want and len(tables.files) <= 2 and models.shards > 2 and any(want[0])
