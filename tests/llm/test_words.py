import random

import numpy as np
import pyarrow as pa

from tessella.llm import words as w
from tests.llm.brute import shingle_set
from tests.llm.brute import words as plain_words

PIECES = ["a", "B", "the", "É", "日本", " ", "  ", "\n", "\t", "\x0b", " ", " ", "x" * 40, "-", "\x00", ""]


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(n)] + [None, "", " ", "a"]


def test_words_are_runs_outside_ascii_white_space():
    given = texts(1, 300)
    data, offsets = w.utf8(pa.array(given))
    found = w.Words(data, offsets)
    assert np.diff(found.first).tolist() == [len(plain_words(t)) for t in given]
    by_hash, by_word = {}, {}
    every = [x for t in given for x in plain_words(t)]
    for word, h in zip(every, found.hash.tolist()):
        assert by_hash.setdefault(h, word) == word and by_word.setdefault(word, h) == h


def test_segments_do_not_change_the_result(monkeypatch):
    data, offsets = w.utf8(pa.array(texts(2, 200)))
    whole = w.Words(data, offsets)
    monkeypatch.setattr(w, "SEGMENT", 37)
    cut = w.Words(data, offsets)
    for name in ("start", "end", "hash", "first"):
        assert np.array_equal(getattr(whole, name), getattr(cut, name))


def test_shingles_are_the_distinct_ones():
    given = texts(3, 200)
    data, offsets = w.utf8(pa.array(given))
    found = w.Words(data, offsets)
    for width in (1, 3, 5):
        seen = {}
        for i, t in enumerate(given):
            s = w.shingles(found, found.first[i], found.first[i + 1], width)
            assert len(s) == len(shingle_set(t, width)) and (np.diff(s.astype(object)) > 0).all()
            assert seen.setdefault(frozenset(shingle_set(t, width)), s.tobytes()) == s.tobytes()


def test_slices_of_columns():
    column = pa.array(["aa b", None, "c d e", "f"])[1:3]
    data, offsets = w.utf8(column)
    assert offsets.tolist() == [0, 0, 5] and data.tobytes() == b"c d e"
    assert [g for g in w.groups(np.array([0, 3, 3, 50, 51]), 10)] == [(0, 2), (2, 3), (3, 4)]
