"""The operators on vectors and personal data against brute force, with the awkward rows."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import codes, negatives, pii

NAN, INF = float("nan"), float("inf")


def vectors(n=140, size=8, labels=3, seed=4):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.3) for _ in range(size)] for _ in range(5)]
    rows = [(i, [c + r.gauss(0, 0.08) for c in r.choice(centres)], r.choice([*range(labels), None])) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [None] * size, 1), (n + 2, [NAN] + [0.0] * (size - 1), 1), (n + 3, [INF] + [0.0] * (size - 1), 1), (n + 4, [0.0] * (size - 1), 1), (n + 5, [], 1)]
    return rows + [(n + 6 + i, rows[3][1], rows[3][2]) for i in range(5)] + [rows[9], rows[9]]


def integers(rows, size):
    return [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"x": F.lit(1), "code": F.lit("c"), "uid": F.lit(None).cast("string"), "_l": F.lit(2)})


def brute_codes(rows, parts, entries, rounds):
    size = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(r[1], p) for r in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((far(cut(v, p), c), j) for j, c in enumerate(books[p]))
    for _ in range(rounds):
        got = [[near(r[1], p)[1] for p in range(parts)] for r in rows]
        for p in range(parts):
            own = {}
            for r, g in zip(rows, got, strict=True):
                own.setdefault(g[p], []).append(cut(r[1], p))
            books[p] = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(books[p])]
    told = [(r, [near(r[1], p) for p in range(parts)]) for r in rows]
    errors = {}
    for r, t in told:
        errors[r[2]] = errors.get(r[2], 0) + sum(d for d, _ in t)
    name = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((r[0], "".join(f"{j:02x}" for _, j in t), sum(d for d, _ in t), errors[r[2]], name) for r, t in told)


@pytest.mark.parametrize(("entries", "rounds"), [(16, 2), (200, 1), (16, 5)])
def test_codes(spark, entries, rounds):
    rows = vectors()
    got = codes.compressed(frame(spark, rows).repartition(3), parts=4, entries=entries, rounds=rounds).collect()
    assert sorted(map(tuple, got)) == brute_codes(integers(rows, 8), 4, entries, rounds)


def test_codes_of_null_ids_and_nothing(spark):
    rows = [(None, [0.1] * 4, None), (1, [0.2] * 4, 3), (None, [0.3, 0.1, 0.0, -1.0], None)]
    key = lambda x: repr(x)
    got = codes.compressed(frame(spark, rows), parts=2, entries=2, rounds=2).collect()
    assert sorted(map(tuple, got), key=key) == sorted(_nulls(rows), key=key)
    assert codes.compressed(frame(spark, [])).collect() == [] == codes.compressed(frame(spark, [(1, None, 1)])).collect()
    with pytest.raises(ValueError, match="equal parts"):
        codes.compressed(frame(spark, [(1, [0.1] * 5, 1)]), parts=2)
    with pytest.raises(Exception, match="integer scale"):
        codes.compressed(frame(spark, [(1, [1e30] * 4, 1)]), parts=2).collect()


def _nulls(rows):
    whole = [(10**9 if i is None else i, v, lab) for i, v, lab in integers(rows, 4)]
    return [(None if i == 10**9 else i, *rest) for i, *rest in brute_codes(whole, 2, 2, 2)]


def test_bounds_prune_and_stay_right():
    import numpy as np

    r = np.random.default_rng(1)
    x = (r.integers(-3, 4, (300, 1)) * 50 + r.integers(-4, 5, (300, 4))).astype(np.int64)
    entries = x[:20].copy()
    own, upper, lower = codes.nearest(x, entries, np.zeros(300, np.int64), np.full(300, np.inf), np.zeros((300, 20)))
    far = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (own == far.argmin(1)).all()
    assert (upper >= np.sqrt(far.min(1))).all() and (lower <= np.sqrt(far) + 1e-9).all()
    assert (lower == 0).mean() > 0.2  # entries that were never measured
    assert (codes._half_up(upper).astype(float) >= upper).all() and (codes._half_down(lower).astype(float) <= lower).all()
    assert codes._half_down(np.array([1e9]))[0] == 65504 and np.isinf(codes._half_up(np.array([1e9]))[0])


def brute_negatives(rows, anchor, positives, negatives_, low, high):
    out = []
    rows = [r for r in rows if r[0] is not None and r[2] is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for k, a in enumerate(rows):
        if not anchor(a[0]):
            continue
        scored = sorted((-dot(a[1], r[1]), r[0], j) for j, r in enumerate(rows) if j != k)
        for s, pos, _ in [x for x in scored if rows[x[2]][2] == a[2]][:positives]:
            fit = [x for x in scored if rows[x[2]][2] != a[2] and low * -s <= 100 * -x[0] <= high * -s][:negatives_]
            out += [(a[0], pos, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 4096])
def test_hard_negatives(spark, block, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    rows = [*vectors(), (None, [0.1] * 8, 1)]
    got = negatives.hard_negatives(frame(spark, rows).repartition(3), F.col("vec_id") % 10 == 0, positives=4, negatives=3, low=80).collect()
    want = brute_negatives(integers(rows, 8), lambda i: i % 10 == 0, 4, 3, 80, 100)
    assert sorted(map(tuple, got)) == want and len(want) > 20
    assert negatives.hard_negatives(frame(spark, []), F.lit(True)).collect() == [] == negatives.hard_negatives(frame(spark, [(1, [0.1], None)]), F.lit(True)).collect()
    assert negatives.hard_negatives(frame(spark, [(1, [0.1], 1)]), F.lit(True)).collect() == []


def test_anchors_are_not_broadcast(spark):
    """Copies of the anchors for each block are neither broadcast nor shuffled: a task reads a part of both sides."""
    found = negatives.hard_negatives(frame(spark, vectors()), F.col("vec_id") % 10 == 0, positives=4, negatives=3, low=80)
    plan = found._jdf.queryExecution().optimizedPlan().toString(), found._jdf.queryExecution().executedPlan().toString()
    searched = plan[1][plan[1].index("MapInArrow") :]
    assert "CartesianProduct" in searched and "explode" not in plan[0] and "Broadcast" not in searched.split("CartesianProduct")[0]


def test_score_brackets():
    import numpy as np

    r = np.random.default_rng(2)
    x, a = r.integers(-300, 300, (200, 8)), r.integers(-300, 300, (20, 8))
    space = negatives._Space(x[:5], int((x**2).sum(1).max()))
    rows, queries, a2 = space.rows(x), space.queries(a), (a.astype(float) ** 2).sum(1)
    for i in range(20):
        score = x @ a[i]
        assert (space.at_most(a2[i], np.abs(rows - queries[i]).max(1)) >= score).all() and (space.at_least(a2[i], (rows + queries[i]).min(1)) <= score).all()


def luhn(body):
    return next(body + str(d) for d in range(10) if sum(n - 9 * (n > 9) for i, c in enumerate(reversed(body + str(d))) for n in [int(c) * (1 + i % 2)]) % 10 == 0)


def base_spans(text):
    """The contract's patterns as they stand."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = lambda d: luhn(d[:-1]) == d
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and ok(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]


def test_exact_spans_are_the_contracts():
    r = random.Random(3)
    cards = [luhn("".join(r.choices("0123456789", k=n))) for n in (15, 16, 17, 18, 12, 19)]
    bits = ["a.b@c.de", "x@@y.z", "@", "a@b", "b@c.d@e.f.g", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8.9", "00000001.2.3.004", "+1 (017) 555-7713", "+12", "+1----------", "++49 30 1234567 ", " ", "\n", "é", "-", ".", "7", "12", "٣٤", "😀", *cards, " ".join([cards[0][:4], cards[0][4:]])]
    for _ in range(3000):
        text = "".join(r.choices(bits, k=r.randint(1, 12)))
        assert [tuple(s) for s in pii.exact_spans(text)] == base_spans(text), text


def test_exact_spans_of_long_runs_end_soon():
    for unit in ("a", "1", "a@", "1.", "+1(", "1 ", "@.", "1a", "a at b dot "):
        text = unit * (400_000 // len(unit))
        pii.candidates(text, pii.exact_spans(text))


def brute_discovered(texts, rounds=3, least=3, trust=0.6, doubt=1.0):
    mentions = []
    for t in texts:
        exact = pii.exact_spans(t or "")
        own = [(s, (s.kind,), True) for s in exact] + [(s, k, False) for s, k in pii.candidates(t or "", exact)]
        mentions += [(k, pii._value(k, t[s.start : s.end]), sure, p) for s, kinds, sure in own for k in kinds for p in pii.contexts(t, s.start)]
    edges = {}
    for k, v, sure, p in mentions:
        edges[k, v, p] = edges.get((k, v, p), False) or sure
    able = {(k, p) for k, _, p in edges if sum(e and a == k and q == p for (a, _, q), e in edges.items()) >= least}
    score = {}
    for _ in range(rounds):
        conf = {}
        for k, p in able:
            s = [(1.0 if own == k else 0.0) if e else score.get((k, v), 0.0) for (own, v, q), e in edges.items() if q == p and (own == k or e)]
            conf[k, p] = round(sum(s) / (len(s) + doubt), 9)
        score = {}
        for (k, v, p), e in edges.items():
            if not e and (k, p) in able:
                score[k, v] = 1 - (1 - score.get((k, v), 0.0)) * (1 - conf[k, p])
    return {kv for kv, s in score.items() if s >= trust - 1e-9}


def private_texts():
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    phone = lambda: f"+1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}"
    texts = [f"{word()} {word()} call me at {phone()} {word()}" for _ in range(8)] + [f"{word()}. Mail: {word()}@{word()}.org" for _ in range(6)]
    texts += [f"{word()} the room {phone()}", f"{word()} the room 1.2.3.{r.randint(1, 9)}", f"the room {luhn('4' * 15)}", f"{word()} the room {r.randint(10**9, 10**10)}"] * 3
    texts += ["please call me at (312) 555-0199 or so", "Mail: jörg@müller.de, or", "mail: ann at example dot com", "later (312) 555 0199 and 5550123456 too", "call me at noon", "the room 7770001111", None, "", "x" * 200_000]
    return texts + texts[:4]


def test_personal_data(spark):
    texts = private_texts()
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, "call me at 999-0000-111"), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "kind": F.lit("x"), "spans": F.lit(2), "d": F.lit(0)})
    got = pii.personal_data(df.repartition(3)).collect()
    found = brute_discovered([t or "" for _, t in rows])
    assert {v for k, v in found if k == "phone"} >= {"3125550199"} and {v for k, v in found if k == "email"} >= {"jörg@müller.de"} and ("phone", "7770001111") not in found
    want = []
    for d, t in rows:
        t = t or ""
        base = base_spans(t)
        exact = pii.exact_spans(t)
        more = {(k, s.start, s.end) for s, kinds in pii.candidates(t, exact) for k in kinds if (k, pii._value(k, t[s.start : s.end])) in found}
        order = lambda s: (pii.KINDS.index(s[0]), s[1])
        text = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=order))
        want.append((d, *[sum(s[0] == k for s in base) for k in pii.KINDS], hashlib.sha256(text(base).encode()).hexdigest(), text([*base, *more]), len(more)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert pii.personal_data(df.limit(0)).collect() == []


def test_hot_pattern_and_copies_count_once(spark):
    rows = [("phone", "1", True, ["a b|"])] * 500 + [("phone", "2", True, ["a b|"])] * 2 + [("phone", "9", False, ["a b|"])]
    kind = "kind string, value string, exact boolean, patterns array<string>"
    assert pii.discovered(spark.createDataFrame(rows, kind)).collect() == []
    rows += [("phone", str(i), True, ["a b|"]) for i in range(10, 16)]
    assert [tuple(r) for r in pii.discovered(spark.createDataFrame(rows, kind)).collect()] == [("phone", "9")]


def test_blocks_with_strays_give_few_pairs(spark):
    from shelfspark.llm import ngramjoin

    r = random.Random(1)
    rows = [(k, i, r.randint(10, 14), r.randint(0, 2), r.choice([i, 1, 1, 2])) for k in range(6) for i in range(30)] + [(99, i, 10, 0, 7) for i in range(30)]
    need = lambda a, b: -(-85 * (a + b) // 185)
    want = {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[4] != y[4] and min(x[2] - x[3], y[2] - y[3]) >= need(x[2], y[2])}
    frame = lambda data: spark.createDataFrame(data, "key long, id long, n int, rare int, c long")
    for part in (50_000, 7):
        ngramjoin.BLOCK_PART, before = part, ngramjoin.BLOCK_PART
        try:
            assert {tuple(x) for x in ngramjoin._across(frame(rows), 85).distinct().collect()} == want
        finally:
            ngramjoin.BLOCK_PART = before
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = ngramjoin._across(frame([(1, i, 10, 0, 1 if i < 4990 else 2) for i in range(5000)]), 85)
        assert len(pairs.collect()) == 4990 * 10
        todo, most = [pairs._jdf.queryExecution().executedPlan()], 0
        while todo:
            node = todo.pop()
            most = max(most, node.metrics().apply("numOutputRows").value() if "Join" in node.nodeName() else 0)
            todo += [node.children().apply(i) for i in range(node.children().size())]
        assert most <= 5000 * 10
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_references_and_percent_codes(spark):
    import html
    import urllib.parse

    from shelfspark.llm import urlfilter

    r, bits = random.Random(5), ["a", "/", "?x=1", "&amp;", "&#038;", "&#x00026;", "&AMP;", "&#47;", "&eacute;", "&sol;", "%7E", "%2f", "%41", "é", "&copy=1", "&nope;", "&notin;", "&#xZ;"]
    texts = ["".join(r.choices(bits, k=r.randint(1, 6))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", urlfilter.decoded(F.col("t")).alias("d"), urlfilter.unreserved(F.col("t")).alias("u"))
    for x in df.collect():
        if "&copy" not in x.t:
            assert x.d == html.unescape(x.t), x.t
        assert "&copy=" in x.d or "&copy=" not in x.t
        assert urllib.parse.unquote(x.u) == urllib.parse.unquote(x.t) and not re.search("%(7E|41|2f)", x.u)


def test_every_spelling_of_a_link_reaches_its_page(spark):
    from shelfspark.llm import urlfilter

    link = lambda href, base="": f'<html><head>{base}<link rel="canonical" href="{href}"></head></html>'
    bad = "http://bad.com/en/x?a=1&b=~2"
    cases = ["http://bad.com/en/x?a=1&#038;b=~2", "http://bad.com/en/x?a=1&#x00026;b=%7e2", "http://BAD.com/en/x?a=1&AMP;b=~2#f", "//bad.com:80/en/./x?a=1&amp;b=%7E2", "http&colon;//bad.com/en/x?a=1&b=~2"]
    rows = [(i, f"http://good{i}.io/p", link(c)) for i, c in enumerate(cases)]
    rows += [(50, "http://g.io/q", link("x?a=1&amp;b=~2", '<base target="_top"><base href="http://bad.com/en/y"><base href="http://other.io/">')), (51, "http://bad.com/zz/q", link("x?a=1&b=~2", "<base href='../en/'>")), (52, "http://g2.io/q", link("x?a=1&b=~2"))]
    rows += [(60, "http://g3.io/%7Ejoe", ""), (61, "http://g4.io/", link("http://g3.io/~joe")), (62, "http://g4.io/", '<meta http-equiv=refresh content="0;url=http://bad.com/en/x?a=1&amp;b=~2">')]
    got = {x.page_id: x.verdict for x in urlfilter.judged_pages(spark.createDataFrame([*rows, (99, bad, None)], "page_id long, url string, html string")).collect()}
    assert {k for k, v in got.items() if v == "block"} == {0, 1, 2, 3, 4, 50, 51, 60, 61, 62, 99} and got[52] == "allow"


def test_groups_follow_ids_and_padding_is_little(spark):
    from shelfspark.llm import packing, tokens

    r = random.Random(2)
    rows = [(i, " ".join(r.choices(["one", "two", "apple", "zebra"], k=int(r.paretovariate(1.1) * 12) % 900))) for i in range(400)] + [(400, "word " * 40_000)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), tokens.default_vocabulary(), capacity=256, group_ids=4_000).collect()
    total, groups, bins = sum(g.length for g in got), {}, {}
    for g in got:
        groups.setdefault(g.sequence_id >> 32, []).append(g)
        bins[g.sequence_id] = bins.get(g.sequence_id, 0) + g.length
    assert len(groups) > 10 and max(sum(g.length for g in x) for x in groups.values()) < 8 * 4_000 + 256 * packing.RUN
    assert max(bins.values()) <= 256 and len(bins) * 256 <= 1.05 * total + 256 * len(groups)
    assert len({g.sequence_id >> 32 for g in got if g.doc_id == 400}) > 1  # a long document is spread
    assert {g.doc_id: sum(x.length for x in got if x.doc_id == g.doc_id) for g in got} == {g.doc_id: g.doc_tokens for g in got}


def brute_blocks(text, templates, threshold=0.8):
    """(line_no, licence, shared, line_bigrams, template_bigrams) of the units and blocks of a text, straight from the definition."""
    split = lambda s: [w for w in re.split(r"[\W_]+", s.lower()) if w]
    pairs = lambda w: list(zip(w, w[1:], strict=False))
    lines = text.split("\n")
    words = [(w, i + 1) for i, line in enumerate(lines) for w in split(line)]
    dice = lambda own, t: 2 * len(own & t) / (len(own) + len(t)) if own or t else 0
    of = {k: set(pairs(split(t))) for k, t in templates.items()}
    units = {0: set(pairs([w for w, _ in words]))} | ({i + 1: set(pairs(split(x))) for i, x in enumerate(lines)} if len(lines) > 1 else {})
    out, told = [], []
    for no, own in units.items():
        best = min(((-dice(own, t), k) for k, t in of.items()), default=(0, ""))
        if -best[0] >= threshold:
            out.append((no, best[1], len(own & of[best[1]]), len(own), len(of[best[1]])))
            told.append((no, len(own & of[best[1]])))
    blocks = []
    for k, t in of.items():
        span = max(2, math.floor((len(split(templates[k])) - 1) * (2 - threshold) / threshold + 1e-9))
        hit = [i for i, x in enumerate(pairs([w for w, _ in words])) if x in t]
        for a in (i for i in hit if i - 1 not in hit):
            for b in (i for i in hit if i >= a and i + 1 not in hit):
                own = set(pairs([w for w, _ in words[a : b + 2]]))
                inside = sum(a <= i <= b for i in hit)
                if (b - a < span or inside == b - a + 1) and dice(own, t) >= threshold:
                    frm, to, shared = words[a][1], words[b + 1][1], len(own & t)
                    if not any((no == 0 or frm <= no <= to) and s >= shared for no, s in told):
                        blocks.append((-shared, -dice(own, t), k, a, b, frm, shared, len(own), len(t)))
    kept = []
    for x in sorted(blocks):
        if not any(y[3] <= x[4] + 1 and x[3] <= y[4] + 1 for y in kept):
            kept.append(x)
    return sorted(out + [(x[5], x[2], x[6], x[7], x[8]) for x in kept])


def test_licence_blocks_are_those_of_the_definition(spark):
    from shelfspark.llm import licenses

    r = random.Random(9)
    templates = {k: licenses.TEMPLATES[k] for k in ("MIT/short", "Apache-2.0/short", "GPL-3.0/short", "CC-BY-4.0/notice", "CC-BY-NC-4.0/notice", "MPL-2.0/notice")}
    noise = ["red", "the", "license", "of", "version", "public", "0", "this"]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 3)):
            words = r.choice(list(templates.values())).split()
            for _ in range(r.choice([0, 0, 1, 2])):
                words[r.randrange(len(words))] = r.choice(noise)
            parts.append(" ".join(w + ("\n" if r.random() < 0.15 else "") for w in r.choices(noise, k=r.randint(0, 6)) + words + r.choices(noise, k=r.randint(0, 4))))
        texts.append(r.choice(["\n", " "]).join(parts))
    got = {}
    for x in licenses.licence_matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates).collect():
        got.setdefault(x.doc_id, []).append((x.line_no, x.licence, x.shared, x.line_bigrams, x.template_bigrams))
    want = {i: b for i, t in enumerate(texts) if (b := brute_blocks(t, templates))}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 30


def test_whole_licence_files(spark, tmp_path):
    from shelfspark.llm import licenses

    long_text = " ".join(f"clause{i % 97} grants right{i % 89} under section {i}" for i in range(900))
    (tmp_path / "Long-1.0").write_text(long_text)
    (tmp_path / "Long-copy").write_text(long_text)
    (tmp_path / "empty").write_text("")
    templates = licenses.templates_of(spark, str(tmp_path))
    assert list(templates) == ["Long-1.0/text"]
    docs = spark.createDataFrame([(1, long_text.replace("under", "UNDER\n")), (2, "preface of a file\n" * 50 + long_text + "\nend"), (3, long_text[:4000]), (4, None)], "doc_id long, text string")
    assert {x.doc_id for x in licenses.licence_matches(docs, templates).where("line_no is not null").collect()} == {1, 2}


def test_quality_thresholds(spark):
    """keep and threshold straight from the perplexities: the quantile's rank among a language's trusted documents."""
    from shelfspark.llm import quality

    r = random.Random(3)
    say = lambda words, k: " ".join(r.choices(words, k=k))
    plain, odd = [f"w{i}" for i in range(30)], [f"q{i}" for i in range(400)]
    rows = [(i, say(plain if i % 5 else odd, r.randint(0, 40)), ["en", "de", None][i % 3]) for i in range(150)] + [(150, None, "fr"), (151, say(plain, 9), "fr"), (None, say(plain, 9), "en"), (3, "again", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("fold", F.lit(9))
    labels = spark.createDataFrame([(i, 1 if i % 5 else 0) for i in range(0, 150, 2)] + [(None, 1), (7, None)], "doc_id long, quality int")
    good = {i for i in range(0, 150, 2) if i % 5}
    for quantile in (0.5, 0.9):
        got = quality.quality_scores(docs, labels, quantile).collect()
        assert len(got) == len(rows)
        for lang in ("en", "de", "und", "fr"):
            own = [x for x in got if x.lang == lang]
            trusted = sorted(x.perplexity for x in own if x.doc_id in good)
            limit = trusted[max(0, math.ceil(quantile * len(trusted)) - 1)] if trusted else None
            assert {x.threshold for x in own} == {limit}
            assert all(x.keep == (limit is None or x.perplexity <= limit) for x in own)


class Asked:
    """A tokenizer that notes the words it is asked for."""

    def __init__(self, tokenizer, words):
        self.tokenizer, self.words = tokenizer, words

    def encode_batch(self, texts, **options):
        self.words += [w for t in texts for w in t.split(" ")]
        return self.tokenizer.encode_batch(texts, **options)


def test_parts_of_pieces_are_encoded_once(monkeypatch):
    """Case, digits and signs around a word don't have it encoded again, and the ids are the tokenizer's own."""
    from shelfspark.llm import tokens

    encoder = tokens.PieceEncoder(tokens.default_vocabulary())
    whole, words = encoder.tokenizer, []
    for name in ("tokenizer", "model"):
        if hasattr(encoder, name):
            setattr(encoder, name, Asked(getattr(encoder, name), words))
    texts = [f"{a}{w}{b}" for w in ("straße", "Straße", "STRAßE", "élan", "ÉLAN", "word", "Word") for a in ("", "(", "7") for b in ("", ".", "!!", "42,")]
    ask = lambda texts: [x.tolist() for x in encoder.encode(texts)]
    want = lambda texts: [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]
    assert ask(texts) == want(texts) and sorted(words) == sorted(["straße", "élan", "word", "(", "7", "4", "2", ".", "!!", ","])
    signs = [*"\t\r\n\v\f\x1c\x1f\x85\xa0 ́̈İıΣςßẞÿŸ×÷ªºµ²½ŒſÅ'’<|日😀éÑÀaZ19!?$~\x7f\x00٣", "'s", "'LL", "<|endoftext|>", "the", " "]
    r = random.Random(8)
    texts = ["", None, *("".join(r.choices(signs, k=r.randint(0, 40))) for _ in range(3000))]
    for most in (tokens.CACHE_PIECES, 100):
        monkeypatch.setattr(tokens, "CACHE_PIECES", most)
        assert [x for i in range(0, len(texts), 300) for x in ask(texts[i : i + 300])] == want([t or "" for t in texts])
    encoder.parted = False  # as under other rules
    assert ask(texts) == want([t or "" for t in texts])


def test_models_of_unlike_sizes_have_own_shards(spark, monkeypatch):
    """The tables of a small language are found beside those of a large one, and tell what one shard of each does."""
    from shelfspark.llm import quality

    r = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(r.choices([f"w{k}" for k in range(50)], k=40 if i % 4 else 3)), "en" if i % 4 else "de") for i in range(80)], "doc_id long, text string, lang string")
    good = docs.where("doc_id % 3 > 0").select("doc_id")
    score = lambda: {x.doc_id: (x.fold, x.perplexity) for x in quality.word_perplexities(docs, good).collect()}
    want = score()
    monkeypatch.setattr(quality, "SHARD_WORDS", 30)
    models = quality.WordModels(docs.select("lang", (F.col("doc_id") % 2).cast("int").alias("fold"), "text"))
    assert models.shards == max(models.own.values()) > min(models.own.values()) and {name.split("-")[0] for name in models.names} == {"en".encode().hex(), "de".encode().hex()}
    got = score()
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and math.isclose(got[i][1], want[i][1], rel_tol=1e-9) for i in want)
