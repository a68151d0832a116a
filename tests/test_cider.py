"""cider_like over many blocks, against brute force, and what it exchanges."""

import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tessella.operators import cider
from tessella.operators.metrics import cider_like


def grams(texts, n):
    return Counter(tuple(w[i : i + n]) for w in texts for i in range(len(w) - n + 1))


def brute_force(rows):
    a, b = defaultdict(list), defaultdict(list)
    for _, pair, candidate, reference in rows:
        a[pair].append((candidate or "").split())
        b[pair].append((reference or "").split())
    out = {}
    for n in range(1, 5):
        df = Counter(g for texts in b.values() for g in grams(texts, n))
        for pair in b:
            x, y = grams(a[pair], n), grams(b[pair], n)
            w = {g: math.log((len(rows) + 1) / (df[g] + 1)) ** 2 for g in x | y}
            xx, yy = (sum(c * c * w[g] for g, c in z.items()) for z in (x, y))
            out[pair] = out.get(pair, 0) + (sum(c * y[g] * w[g] for g, c in x.items()) / math.sqrt(xx * yy) / 4 if xx and yy else 0)
    return out


def test_blocks_learn_of_each_other(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefghijklmnop") + rng.choice(["", "x", "yz"]) for _ in range(rng.choice([0, 2, 40, 150]))) for _ in range(120)]
    # candidates take words of references that stand in other blocks only; one pair has three rows, some texts are null
    rows = [(i % 7, i, f"{texts[i]} {texts[(i * 5 + 1) % 120]}" if i % 9 else None, texts[i] if i % 11 else None) for i in range(120)]
    rows += [(3, 3, "a b c", "bx c dyz"), (3, 3, texts[50], texts[51])]
    pairs = spark.createDataFrame(rows, "near int, pair long, candidate string, reference string").repartition(7, "near")
    found = cider_like(pairs, near="near").collect()
    want = brute_force(rows)
    assert sorted(r.pair for r in found) == sorted(r[1] for r in rows)
    assert all(r.cider == pytest.approx(want[r.pair], abs=1e-9) for r in found)


def test_a_null_pair_scores_nothing(spark):
    found = cider_like(spark.createDataFrame([(None, "a b", "a b"), ("p", "a c", "a c d")], "pair string, candidate string, reference string")).collect()
    assert {r.pair: r.cider for r in found}[None] == 0.0


def test_grams_of_words_that_no_other_block_holds_are_not_sent():
    def rows(*batches):
        return [row for batch in batches for row in zip(*(batch.column(x).to_pylist() for x in cider._NAMES))]

    def block(number, text):
        words = pa.array([text.split()], pa.list_(pa.string()))
        many, data = cider._body([pa.RecordBatch.from_arrays([pa.array([number]), pa.array([True]), words, words], ["pair", "fresh", "a", "b"])], pa.int64())
        return number, cider.BODY, 0, many, data

    blocks = [block(0, "a b c d e"), block(1, "v a b w c")]
    first = rows(*cider._asks(1, 2, 1)(iter([cider._rows(blocks)])))
    told = rows(*cider._answers(iter([cider._rows(first)])))
    met = sorted(blocks + [x for x in told if x[1] in (cider.ASKED, cider.ANSWER)])
    second = rows(*cider._asks(2, 2, 1)(iter([cider._rows(met)])))
    # of four bigrams each: "a b" and "b c" of the one, "a b" of the other
    assert [(x[0], x[3]) for x in second if x[1] == cider.QUESTION] == [(0, 2), (1, 1)]
