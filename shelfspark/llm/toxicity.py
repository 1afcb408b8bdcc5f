"""Toxicity by weak supervision: voters, a generative label model over them, and a linear classifier on its labels."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, cut, small_side, table, text_key

#: Insults of the seed lexicon, of each language.
SEED_LEXICONS = {
    "en": ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "dumb", "jerk", "imbecile", "vermin", "filth"),
    "de": ("idiot", "trottel", "dummkopf", "arschloch", "versager", "abschaum", "widerlich", "erbärmlich", "wertlos", "depp", "vollidiot", "mistkerl", "drecksack"),
    "fr": ("idiot", "crétin", "connard", "connasse", "imbécile", "débile", "ordure", "minable", "abruti", "raclure", "salaud", "pathétique", "dégoûtant"),
    "es": ("idiota", "imbécil", "estúpido", "estúpida", "cabrón", "gilipollas", "basura", "escoria", "patético", "inútil", "asqueroso", "payaso", "tarado"),
}
SEED_WORDS = tuple(dict.fromkeys(w for words in SEED_LEXICONS.values() for w in words))
#: Patterns of abuse.
SEED_PATTERNS = (
    r"\byou(?:'re| are) (?:an? )?(?:\w+ ){0,2}(?:" + "|".join(SEED_WORDS) + r")\b",
    r"\b(?:shut up|go away|get lost|drop dead)\b",
    r"\b(?:kill|hate) (?:you|them|yourself)\b",
    r"\bdu (?:bist|bleibst) (?:ein(?:e|er)? )?(?:\w+ ){0,2}(?:" + "|".join(SEED_LEXICONS["de"]) + r")\b|\b(?:halt die klappe|hau ab|verpiss dich|ich hasse (?:dich|euch))\b",
    r"\b(?:tu es|vous êtes|espèce d[e']) ?(?:une? )?(?:\w+ ){0,2}(?:" + "|".join(SEED_LEXICONS["fr"]) + r")\b|\b(?:ta gueule|ferme-la|dégage|je (?:te|vous) (?:hais|déteste))\b",
    r"\b(?:eres|sois) (?:una? )?(?:\w+ ){0,2}(?:" + "|".join(SEED_LEXICONS["es"]) + r")\b|\b(?:cállate|lárgate|vete a la mierda|(?:te|os) odio)\b",
)
#: Labelled documents for fitting at most, and as many without label; features of the classifier at most, those that are most
#: associated with the labels (the fit holds a weight for each on the driver); voters that are drawn from features at most.
MOST_ROWS, MOST_FEATURES, MOST_VOTERS = 20_000, 3_000, 96
#: A word is drawn as a voter if it is so many times as frequent in toxic documents as in clean ones, with one more clean document.
VOTER_RATIO = 40
_WORD, _PATTERNS = re.compile(r"[^\W\d_]+"), [re.compile(p) for p in SEED_PATTERNS]
_STEMS = (4, 5, 6)


def features_of(text: str | None) -> set[str]:
    """Distinct words and stems of a whole text, with its seed patterns; null and empty texts have none."""
    low = (text or "").lower()
    words = set(_WORD.findall(low))
    return words.union(*({f"{w[:k]}*" for w in words if len(w) > k} for k in _STEMS), (f"/{i}/" for i, p in enumerate(_PATTERNS) if p.search(low)))


def held_out(doc_id) -> F.Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0)


def label_posteriors(votes, labels, rounds: int = 30):
    """P(toxic) of each row of `votes` (rows x voters: 1 votes toxic, 0 abstains), by EM over a latent class.

    Two voters are added: one fires where a single voter does, the last where all abstain. labels: 1, 0 or -1 (none) of each row. They
    calibrate the voters: in estimating rates and the class prior a labelled row counts as its label says, others as
    the model says. They do not vote, so a row's own posterior comes from its votes alone. Voters that agree more than
    their classes explain are correlated: the excess correlation within a class, estimated anew in every round, divides
    their say, so copies of one voter count once. Returns the posteriors and, of each voter, (rate when toxic, rate
    when clean, weight).
    """
    import numpy as np

    number = votes.sum(1, keepdims=True)
    v = np.concatenate([votes, number == 1, number == 0], 1).astype(float)
    told = labels >= 0
    q, known = labels.astype(float), np.clip(labels, 0.02, 0.98)
    share_of = told.astype(float)  # rows without label count from the second round on
    for _ in range(rounds):
        use = np.where(told, known, q)
        hot, cold = (share_of * use).sum() + 1e-9, (share_of * (1 - use)).sum() + 1e-9
        a = np.clip(((share_of * use) @ v + 0.1) / (hot + 1), 1e-4, 1 - 1e-4)
        b = np.clip(((share_of * (1 - use)) @ v + 0.1) / (cold + 10), 1e-5, 1 - 1e-4)
        excess = np.zeros((v.shape[1],) * 2)
        for share, rate in ((share_of * use, a), (share_of * (1 - use), b)):
            d = (v - rate) * np.sqrt(share / (share.sum() + 1e-9))[:, None]
            cov = d.T @ d
            sd = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
            excess += cov / sd[:, None] / sd[None, :] * (share.sum() / share_of.sum())
        np.fill_diagonal(excess, 0)
        weight = 1 / (1 + np.clip(excess - 0.1, 0, None).sum(1))
        now = 1 / (1 + np.exp(-np.clip((v * (np.log(a) - np.log(b))) @ weight + math.log(hot / cold), -30, 30)))
        moved, q = np.abs(now - q).max(), now
        share_of = np.ones(len(v))
        if moved < 1e-4:
            break
    return q, list(zip(a, b, weight, strict=True))


def linear_fit(rows: list[list[int]], targets, size: int, l2: float = 2e-5, steps: int = 600):
    """(bias, weights) of logistic regression on soft labels; rows list the features that a document has."""
    import numpy as np

    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    of = np.array([k for r in rows for k in r], np.int64)
    n, w, b = len(rows), np.zeros(size), math.log((targets.sum() + 0.5) / (len(rows) - targets.sum() + 0.5))
    m, s = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[of], n) + b, -30, 30)))
        g = np.append(np.bincount(of, (p - targets)[at], size) / n + l2 * w, (p - targets).mean())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return b, w


def fit_toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, label_model: bool = True) -> dict:
    """{"bias": ..., "weights": {feature: weight}} from documents outside the held-out fifth, labelled or not.

    docs: doc_id, text; labels: doc_id, toxic. At most `most_rows` labelled documents are used, those of the least
    hash of doc_id, and as many without label, one text (the least) of a repeated doc_id; counts of the labelled ones' features are summed in Spark, and only
    selected features reach the driver: those with z > 2.5, the MOST_FEATURES highest of them at most, and of these
    MOST_VOTERS voters at most. The voters are the seed lexicons and patterns of each language and the features
    most associated with the labels; the classifier is fitted on the label model's posteriors. Rows without text or id
    are not used. Without labels of both kinds the seed lexicons alone decide. label_model: false fits on the bare labels,
    for comparison.
    """
    import numpy as np

    seed = {"bias": -3.0, "weights": {w: 5.0 for w in SEED_WORDS} | {f"/{i}/": 3.0 for i in range(len(_PATTERNS))}}
    arrow_batches(docs.sparkSession)
    drawn = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = cut(drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows), "drawn")
    once = lambda rows: rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))  # noqa: E731  (a repeated doc_id counts once)
    train = cut(once(docs.select("doc_id", "text").where("text is not null").join(small_side(drawn, 20), "doc_id")), "train")
    total = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    if not total.get(0) or not total.get(1):
        return seed

    def counted(batches):
        from collections import Counter

        import pyarrow as pa

        hot, cold = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (hot if toxic else cold).update(features_of(text))
        names = [f for f in hot]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([hot[f] for f in names], pa.int64()), pa.array([cold[f] for f in names], pa.int64())], ["f", "hot", "cold"])

    hot_n, cold_n = total[1], total[0]
    stats = train.select("text", "toxic").mapInArrow(counted, "f string, hot long, cold long").groupBy("f").agg(F.sum("hot").alias("hot"), F.sum("cold").alias("cold"))
    odds = F.log((F.col("hot") + 0.5) / (hot_n - F.col("hot") + 0.5)) - F.log((F.col("cold") + 0.5) / (cold_n - F.col("cold") + 0.5))
    z = odds / F.sqrt(1 / (F.col("hot") + 0.5) + 1 / (F.col("cold") + 0.5))
    top = stats.where("hot >= 3").select("f", z.alias("z"), ((F.col("hot") / hot_n > VOTER_RATIO * (F.col("cold") + 1) / cold_n) & ~F.col("f").endswith("*")).alias("votes")).where("z > 2.5").orderBy(F.desc("z"), "f").limit(MOST_FEATURES).collect()
    names = list(dict.fromkeys([*SEED_WORDS, *(f"/{i}/" for i in range(len(_PATTERNS))), *(r["f"] for r in top)]))
    index = {f: i for i, f in enumerate(names)}

    def chosen(batches):
        import pyarrow as pa

        for batch in batches:
            found = [sorted(index[f] for f in features_of(t) & index.keys()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], ["at", "toxic"])

    named = labels.where("toxic is not null").select("doc_id").distinct()
    others = docs.select("doc_id").where("doc_id is not null and text is not null").where(~held_out(F.col("doc_id"))).distinct().join(small_side(cut(named, "named"), 16), "doc_id", "left_anti")
    others = cut(others.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows), "unlabelled")
    others = once(docs.select("doc_id", "text").where("text is not null").join(small_side(others, 16), "doc_id").select("doc_id", "text", F.lit(-1).alias("toxic")))
    known = train.union(others).orderBy("doc_id").select("text", "toxic").mapInArrow(chosen, "at array<int>, toxic int").collect()
    rows, gold = [list(r["at"]) for r in known], np.array([r["toxic"] for r in known])
    seeds = len(SEED_WORDS) + len(_PATTERNS)
    drawn_voters = [index[r["f"]] for r in top if r["votes"] and index[r["f"]] >= seeds][:MOST_VOTERS]
    voters = {k: i for i, k in enumerate([*range(seeds), *drawn_voters])}
    votes = np.zeros((len(rows), len(voters)), np.int8)
    for i, r in enumerate(rows):
        votes[i, [voters[k] for k in r if k in voters]] = 1
    if label_model:
        targets, _ = label_posteriors(votes, gold)
    else:
        rows, targets = [r for r, g in zip(rows, gold, strict=True) if g >= 0], gold[gold >= 0].astype(float)
    bias, weights = linear_fit(rows, targets, len(names))
    return {"bias": float(bias), "weights": {f: float(weights[i]) for f, i in index.items() if abs(weights[i]) > 1e-6}}


def toxicity_scores(docs: DataFrame, model: dict, keyed: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text; others are never inputs).

    A null or empty text has the score of the bias alone. Repeated rows and rows without doc_id are scored like
    others (their held_out is false); an empty table gives no rows. keyed: with the text_md5 (binary) of each row.
    """
    arrow_batches(docs.sparkSession)
    bias, weights = model["bias"], model["weights"]
    also = ["text_md5"] if keyed else []

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(weights[f] for f in sorted(features_of(t) & weights.keys())))))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), *[batch.column(2) for _ in also]], ["doc_id", "score", *also])

    rows = docs.select("doc_id", "text", *[text_key(F.col("text")).alias(c) for c in also])
    scored = rows.mapInArrow(score, "doc_id long, score double" + "".join(f", {c} binary" for c in also))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *also)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


SQL: dict[str, str] = {}
