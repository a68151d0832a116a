import random

import numpy as np

from tessella.llm.paragraphs import dedup_passages, merged, window_keys
from tessella.llm.words import Words
from tests.llm.brute import words


def sentence(rng, n):
    w = [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    return " ".join(w).capitalize() + "."


def passage(rng, n):
    return " ".join(sentence(rng, rng.randint(7, 12)) for _ in range(n))


def cut(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "doc_id long, text string" + extra)
    return {r.doc_id: r for r in dedup_passages(df).collect()}


def test_a_spliced_passage_stays_in_the_first_document_only(spark):
    rng = random.Random(1)
    p = passage(rng, 8)
    hosts = [passage(rng, 12) for _ in range(4)]
    rows = [(i, h[: 200 + 31 * i].rsplit(" ", 1)[0] + " " + p + " " + h[200 + 31 * i :].split(" ", 1)[1]) for i, h in enumerate(hosts)] + [(9, passage(rng, 10))]
    out = cut(spark, rows)
    assert out[0].text == rows[0][1] and out[9].text == rows[4][1] and not out[9].removed
    for i in (1, 2, 3):
        assert p not in out[i].text and out[i].text == rows[i][1].replace(p + " ", "") and out[i].removed[0].words == len(p.split())


def test_an_edited_paragraph_is_a_repeat(spark):
    rng = random.Random(2)
    p = passage(rng, 14)
    w = p.split(" ")
    w[40] = "changed"
    rows = [(1, "Head one.\n" + p + "\nTail one."), (2, "Start two.\n" + " ".join(w) + "\nLast two.")]
    out = cut(spark, rows)
    assert out[1].text == rows[0][1] and out[2].text == "Start two.\nLast two."


def test_short_repeats_and_repeats_inside_a_document_stay(spark):
    rng = random.Random(3)
    line, inner = sentence(rng, 14), passage(rng, 8)
    rows = [(1, line + "\n" + passage(rng, 4)), (2, line + "\n" + passage(rng, 4)), (3, inner + "\n" + inner)]
    out = cut(spark, rows)
    assert all(out[i].text == t and not out[i].removed for i, t in rows)


def test_defined_cases(spark):
    rng = random.Random(4)
    p = passage(rng, 9)
    rows = [(1, None, "r"), (2, "", "r"), (3, p, "r"), (4, p, "r"), (5, p.upper(), "r"), (None, p, "r"), (6, "x" * 50_000 + "\n" + p, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string")
    out = {r.doc_id: r for r in dedup_passages(df).collect()}
    assert (out[1].text, out[2].text, out[3].text, out[4].text, out[5].text, out[None].text) == (None, "", p, "", "", p)
    assert out[6].text == "x" * 50_000
    assert dedup_passages(df.where("false")).collect() == []
    twice = dedup_passages(spark.createDataFrame([(1, p), (1, p)], "doc_id long, text string")).collect()
    assert [r.text for r in twice] == [p, p]


def test_a_repeated_doc_id_with_different_texts_keeps_what_is_unique(spark):
    rng = random.Random(8)
    p, u, v = (passage(rng, 9) for _ in range(3))
    rows = [(1, p), (2, p), (2, u), (2, u + "\n" + v), (3, u)]
    out = dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted([(1, p), (2, ""), (2, u), (2, u + "\n" + v), (3, "")])


def brute(rows, least):
    """Spans of the words of each text that lie in ``least`` words that an earlier document holds."""
    held = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - least + 1):
            key = tuple(w[k : k + least])
            held[key] = min(held.get(key, i), i)
    out = {}
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - least + 1):
            if held[tuple(w[k : k + least])] < i:
                gone.update(range(k, k + least))
        out[i] = sorted(gone)
    return out


def spans_of(row):
    return [x for r in row.removed for x in range(r.first_word, r.first_word + r.words)]


def test_windows_equal_brute_force(spark):
    """Passages of 40 to 120 words in any letter case, spliced at any word, over line breaks, some beside each other, some in part."""
    rng = random.Random(9)
    pool = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(40, 120))] for _ in range(12)]
    rows = []
    for i in range(80):
        w = [f"h{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(pool)
            a = rng.randint(0, 20) if rng.random() < 0.3 else 0
            at = rng.randint(0, len(w))
            w[at:at] = p[a : len(p) - (rng.randint(0, 20) if rng.random() < 0.3 else 0)]
        style = rng.choice([str, str.upper, str.title])
        rows.append((i, "".join(style(x) + rng.choice([" ", " ", " ", " ", "\n"]) for x in w).strip()))
    # lines stay below 50 words, so that only windows can be repeats
    lines = [max((len(line.split()) for line in t.split("\n")), default=0) for _, t in rows]
    rows = [r for r, n in zip(rows, lines) if n < 50]
    assert len(rows) > 40
    out, wanted = cut(spark, rows), brute(rows, 50)
    assert sum(map(len, wanted.values())) > 1000
    for i, t in rows:
        assert spans_of(out[i]) == wanted[i]
        gone = set(wanted[i])
        assert words(out[i].text) == [x for k, x in enumerate(words(t)) if k not in gone]


def test_documents_equal_brute_force(spark, small):
    """On the table: all words that windows call repeats go, and beyond these only lines of 50 words or more with a similar earlier one."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    out, wanted = cut(spark, rows), brute(rows, 50)
    for i, t in rows:
        gone = set(spans_of(out[i]))
        assert gone >= set(wanted[i])
        rest, at = gone - set(wanted[i]), 0
        for line in (t or "").split("\n"):
            n = len(words(line))
            here = set(range(at, at + n))
            if rest & here:
                assert n >= 50 and here <= gone
            at += n


def test_equal_windows_share_a_key_whatever_surrounds_them():
    rng = random.Random(10)
    p = " ".join(f"w{rng.randint(0, 99)}" for _ in range(50))
    seen = []
    for _ in range(40):
        raw = " ".join([*(f"x{rng.randint(0, 99)}" for _ in range(rng.randint(0, 60))), p, *(f"y{rng.randint(0, 99)}" for _ in range(rng.randint(0, 60)))]).encode()
        seen.append(set(window_keys(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), 50)[1].tolist()))
    assert set.intersection(*seen)


def test_stretches_are_merged():
    first, size = merged(np.array([100, 0, 20, 47, 5]), np.array([10, 20, 20, 3, 4]))
    assert list(zip(first.tolist(), size.tolist())) == [(0, 40), (47, 3), (100, 10)]


def test_a_passage_that_begins_and_ends_inside_sentences(spark):
    rng = random.Random(6)
    hosts = [passage(rng, 12).split(" ") for _ in range(3)]
    p = passage(rng, 9).split(" ")[5:-6]
    rows = [(i, " ".join([*h[: 31 + i], *p, *h[31 + i :]])) for i, h in enumerate(hosts)]
    out = cut(spark, rows)
    assert out[0].text == rows[0][1]
    for i in (1, 2):
        assert out[i].text == " ".join(hosts[i]) and out[i].removed[0].words == len(p)


def test_a_spliced_passage_in_title_case_or_of_short_sentences(spark):
    rng = random.Random(7)
    for p in (passage(rng, 6).title(), passage(rng, 6).upper(), " ".join(sentence(rng, rng.randint(1, 3)) for _ in range(30))):
        hosts = [passage(rng, 12).split(" ") for _ in range(3)]
        rows = [(i, " ".join([*h[: 31 + i], p, *h[31 + i :]])) for i, h in enumerate(hosts)]
        out = cut(spark, rows)
        assert out[0].text == rows[0][1]
        for i in (1, 2):
            assert out[i].text == " ".join(hosts[i]) and out[i].removed[0].words == len(p.split())
