import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm.toxicity import label_chain, score_chain, toxicity, train_chain

BAD = ["grumwort", "snarlpit", "vileoak", "muckdrip"]


def corpus(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 80))]
        toxic, low = rng.random() < 0.2, rng.random() < 0.2
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(BAD)
        if low:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, int(not low), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus(900, 1)
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    out = toxicity(docs, labels.where("doc_id < 600")).join(labels.where("doc_id >= 600"), "doc_id")
    rate = out.select(F.avg((F.col("rejected").cast("int") == F.col("toxic")).cast("double")).alias("toxic"), F.avg(((F.col("p_low_quality") >= 0.5).cast("int") == 1 - F.col("quality")).cast("double")).alias("low")).first()
    assert rate.toxic > 0.97 and rate.low > 0.97


def test_held_out_accuracy_on_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    out = score_chain(docs, train_chain(docs, labels.where(~held), label_chain())).join(labels.where(held), "doc_id")
    said = F.col("p_toxic") >= 0.5
    row = out.select(F.sum((said & (F.col("toxic") == 1)).cast("int")).alias("hit"), F.sum("toxic").alias("toxic"), F.sum((said & (F.col("toxic") == 0)).cast("int")).alias("wrong")).first()
    assert row.hit >= 0.85 * row.toxic and row.wrong <= 5


def test_the_fit_does_not_depend_on_partitions(tables):
    docs, labels = tables
    a, b = (train_chain(docs.repartition(n), labels.repartition(n), label_chain()) for n in (1, 7))
    assert [x.buckets.tolist() for x in a.links] == [x.buckets.tolist() for x in b.links]
    assert max(abs(a.links[1].weights - b.links[1].weights)) < 1e-9


def test_later_links_see_earlier_ones(tables):
    chain = train_chain(*tables, label_chain())
    assert [x.name for x in chain.links] == ["low_quality", "toxic"]
    assert len(chain.links[1].weights) == len(chain.links[1].buckets) + 4 + 1 + 1


def test_defined_cases(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (2, " ".join(BAD * 20_000), 3.0), (2, " ".join(BAD * 20_000), 3.0)], "doc_id long, text string, p_toxic double")
    out = toxicity(odd, labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int"))).collect()
    assert len(out) == 4 and all(0 <= r.p_toxic <= 1 for r in out)
    scored = score_chain(odd, train_chain(docs, labels, label_chain())).collect()
    assert scored[0].p_toxic == scored[1].p_toxic < 0.5 < scored[2].p_toxic == scored[3].p_toxic
    none = toxicity(docs, labels.where("false"))
    assert none.where("rejected").count() == 0 and none.count() == docs.count()
    assert toxicity(docs.where("false"), labels).collect() == []


def test_a_repeated_doc_id_and_long_texts_do_not_grow_the_fit(spark, tables):
    docs, labels = tables
    more = docs.unionByName(spark.createDataFrame([(1, f"zz{i} " * 5) for i in range(300)] + [(2, " ".join(f"q{i}" for i in range(60_000)))], "doc_id long, text string"))
    a, b = train_chain(more, labels, label_chain()), train_chain(more.repartition(5), labels, label_chain())
    assert [x.buckets.tolist() for x in a.links] == [x.buckets.tolist() for x in b.links]


def bare(text):
    """Words without ASCII punctuation at or inside them, which cuts words."""
    out = "".join(" " if 33 <= ord(c) < 127 and not c.isalnum() else c for c in text)
    return Counter(w.lower() for w in out.split())


def logistic(x, y, ridge):
    """Ridge logistic regression by plain Newton steps on lists, the intercept last."""
    x = np.array([[*row, 1.0] for row in x])
    w = np.zeros(x.shape[1])
    keep = np.array([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(60):
        p = np.array([1 / (1 + math.exp(-max(-30, min(30, v)))) for v in x @ w])
        w = w - np.linalg.solve(x.T @ np.diag(p * (1 - p) + 1e-9) @ x + np.diag(keep), x.T @ (p - y) + keep * w)
    return w


def brute_chain(train, labels, asked):
    """The chain over words themselves: chi-square choice, scaling, out-of-fold probabilities for the later link."""
    texts = [bare(t) for t in train]

    def stats(t, words):
        size, n = max(1, len(t.encode())), sum(words.values())
        odd = sum(1 for c in t if ord(c) < 128 and not (c.isalnum() or c in " \t\n\r\x0b\x0c"))
        return [math.log1p(n), sum("A" <= c <= "Z" for c in t) / size, odd / size, len(words) / max(1, n)]

    dense, wanted = [stats(t, w) for t, w in zip(train, texts)], [(bare(t), stats(t, bare(t))) for t in asked]

    def fit(rows, y, earlier):
        n, positive = len(rows), sum(y[i] for i in rows)
        df, inside = Counter(w for i in rows for w in texts[i]), Counter(w for i in rows if y[i] for w in texts[i])
        chosen = []
        for w, c in df.items():
            e = c * positive / n
            below = e * (1 - positive / n) * (1 - c / n)
            if c >= 3 and below > 0 and (inside[w] - e) ** 2 / below >= 25:
                chosen.append(w)
        assert len(chosen) <= 200  # beyond it, ties would matter
        least, most = ([f(dense[i][k] for i in rows) for k in range(4)] for f in (min, max))

        def features(words, d, before):
            return [math.log1p(words[w]) if w in words else 0.0 for w in chosen] + [min(max(v, a), b) for v, a, b in zip(d, least, most)] + [math.log((p + 1e-4) / (1 - p + 1e-4)) for p in before]

        x = np.array([features(texts[i], dense[i], earlier[i]) for i in rows])
        mean, spread = x.mean(0), x.std(0)
        spread[spread <= 1e-9] = 1.0
        w = logistic((x - mean) / spread, np.array([y[i] for i in rows], float), 10.0)

        def of(words, d, before):
            z = float(((np.array(features(words, d, before)) - mean) / spread) @ w[:-1] + w[-1])
            return 1 / (1 + math.exp(-max(-30, min(30, z))))

        return of

    earlier, out = [[] for _ in train], [[] for _ in asked]
    for y in labels:
        held = []
        for i in range(len(train)):
            held.append(None)
        for k in range(5):
            model = fit([i for i in range(len(train)) if i % 5 != k], y, earlier)
            for i in range(k, len(train), 5):
                held[i] = model(texts[i], dense[i], earlier[i])
        model = fit(range(len(train)), y, earlier)
        out = [[*before, model(w, d, before)] for before, (w, d) in zip(out, wanted)]
        earlier = [[*before, p] for before, p in zip(earlier, held)]
    return out


def test_equals_brute_force(spark):
    docs, labels = corpus(400, 3)
    asked = docs[300:]
    scored = toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int"))
    found = {r.doc_id: (r.p_low_quality, r.p_toxic) for r in scored.collect()}
    wanted = brute_chain([t for _, t in docs[:300]], [[1 - q for _, q, _ in labels[:300]], [x for _, _, x in labels[:300]]], [t for _, t in asked])
    assert max(abs(p - q) for (i, _), row in zip(asked, wanted) for p, q in zip(found[i], row)) < 1e-6
