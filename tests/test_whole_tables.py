"""Queries that read whole tables, against brute force on a small fixture."""

import math
import re
from collections import Counter

import pytest

from tessella.plans.queries import QUERIES

#: Ids on both sides of 1000, texts on both sides of 60 words.
DOCS = [(i, " ".join(f"w{(i * 7 + j * j) % 23}" for j in range(5 + i % 5 * 30)), ("en", "de")[i % 2]) for i in (*range(3), *range(998, 1004), *range(5000, 5003))]


@pytest.fixture(scope="module")
def fixture_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


def tokens(text):
    return re.findall("[a-z0-9]+", text.lower())


def grams(text, n):
    w = tokens(text)
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def pairs():
    texts = {i: t for i, t, _ in DOCS}
    return {i: (t if i % 3 == 0 else f"{t} {texts[i + 1]}", t) for i, t in texts.items() if i + 1 in texts}


def f_score(p, r, beta):
    return (1 + beta**2) * p * r / (r + beta**2 * p) if p > 0 and r > 0 else 0.0


def gram_f1(a, b, n):
    x, y = grams(a, n), grams(b, n)
    shared = sum((x & y).values())
    p, r = shared / max(sum(x.values()), 1), shared / max(sum(y.values()), 1)
    return 2 * p * r / (p + r) if p + r else 0.0


def meteor(a, b):
    x, y = grams(a, 1), grams(b, 1)
    shared = sum((x & y).values())
    return f_score(shared / sum(x.values()), shared / sum(y.values()), 3)


def rouge(a, b):
    x, y = tokens(a), tokens(b)
    row = [0] * (len(y) + 1)
    for w in x:
        new = [0]
        for j, v in enumerate(y):
            new.append(row[j] + 1 if w == v else max(row[j + 1], new[-1]))
        row = new
    return f_score(row[-1] / len(x), row[-1] / len(y), 1.2)


def cider(table):
    df = [Counter(g for _, b in table.values() for g in grams(b, n)) for n in range(5)]
    out = {}
    for i, (a, b) in table.items():
        total = 0.0
        for n in range(1, 5):
            idf = {g: math.log((len(table) + 1) / (df[n][g] + 1)) for g in (grams(a, n) | grams(b, n))}
            x, y = ({g: c * idf[g] for g, c in grams(t, n).items()} for t in (a, b))
            norm = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
            total += sum(v * y.get(g, 0.0) for g, v in x.items()) / norm if norm else 0.0
        out[i] = total / 4
    return out


@pytest.mark.parametrize("name, column, score", [("token_f1_pairs", "f1", lambda a, b: gram_f1(a, b, 1)), ("fourgram_f1_pairs", "f1", lambda a, b: gram_f1(a, b, 4)), ("meteor_like", "meteor", meteor), ("rouge_l", "rouge", rouge)])
def test_every_pair_is_scored_over_its_whole_text(spark, fixture_dir, name, column, score):
    found = {r.pair: r[column] for r in QUERIES[name](spark, fixture_dir).collect()}
    assert found == pytest.approx({i: score(a, b) for i, (a, b) in pairs().items()}, abs=2e-6)


def test_cider_of_every_whole_pair(spark, fixture_dir):
    assert {r.pair: r.cider for r in QUERIES["cider_like"](spark, fixture_dir).collect()} == pytest.approx(cider(pairs()), abs=2e-6)


def test_bleu_of_all_whole_pairs(spark, fixture_dir):
    logs = 0.0
    for n in range(1, 5):
        both = [(grams(a, n), grams(b, n)) for a, b in pairs().values()]
        logs += math.log((sum(sum((x & y).values()) for x, y in both) + 1) / (sum(sum(x.values()) for x, _ in both) + 1)) / 4
    c, r = (sum(len(tokens(p[k])) for p in pairs().values()) for k in (0, 1))
    want = (1.0 if c > r else math.exp(1 - r / c)) * math.exp(logs)
    assert QUERIES["bleu"](spark, fixture_dir).collect()[0].bleu == pytest.approx(want, abs=2e-6)


def up_to(text, n):
    return Counter(" ".join(g) for k in range(1, n + 1) for g in grams(text, k).elements())


def bank_weights():
    out = {}
    for lang in ("en", "de"):
        each = [up_to(t, 4) for _, t, bank in DOCS if bank == lang]
        counts, df = sum(each, Counter()), Counter(g for c in each for g in c)
        weights = {g: round(n * max(math.log((len(each) + 1) / (df[g] + 0.5)), 0.05), 6) for g, n in counts.items()}
        out[lang] = dict(sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:6000])
    return out


def test_phrase_bank_of_all_whole_texts(spark, fixture_dir):
    found = {(r.bank, r.gram): r.weight for r in QUERIES["phrase_bank"](spark, fixture_dir).collect()}
    assert found == pytest.approx({(lang, g): w for lang, bank in bank_weights().items() for g, w in bank.items()}, abs=2e-4)


def test_phrase_overlap_of_every_whole_text(spark, fixture_dir):
    bank, want = bank_weights(), {}
    for i, t, lang in DOCS:
        c = {g: min(n, 3) for g, n in up_to(t, 4).items()}
        want[i] = sum(n * bank[lang].get(g, 0.0) for g, n in c.items()) / sum(c.values())
    assert {r.id: r.overlap for r in QUERIES["phrase_overlap"](spark, fixture_dir).collect()} == pytest.approx(want, abs=2e-4)


def test_the_heaviest_grams_of_a_bank_in_shares(spark):
    from tessella.operators.captions import phrase_bank

    docs = spark.createDataFrame([(i, "en", t) for i, t, _ in DOCS], "doc long, bank string, text string")
    every = sorted(((-r.weight, r.gram) for r in phrase_bank(docs, 2, 10**6).collect()))
    assert sorted((-r.weight, r.gram) for r in phrase_bank(docs, 2, 7).collect()) == every[:7]


def test_the_ranker_is_applied_to_scenarios_it_was_not_fitted_on(spark, small):
    assert any(int(r.scenario_id[1:]) % 25 for r in QUERIES["learned_ranker"](spark, small).collect())


def test_every_event_asks_for_its_nearest_frame(spark, small):
    from tessella.plans import views

    events = [(r.role, r.track, r.ord, r.image_id) for r in views.tracks(spark, small).collect()]
    of = {}
    for role, track, ord_, image in events:
        of.setdefault((role, track), []).append((image, ord_))
    asked = {(role, track, ord_ * 3 % 4001) for role, track, ord_, _ in events}
    want = {(*x, min(of[x[:2]], key=lambda y: (abs(y[0] - x[2]), y[1]))[0]) for x in asked}
    found = [tuple(r) for r in QUERIES["nearest_frame"](spark, small).collect()]
    assert len(found) == len(want) and set(found) == want
