import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tessella.llm import bpe as module
from tessella.llm.bpe import Bpe, decode_documents, encode_documents, read_ranks

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
PIECES = ["a", "th", "e", " ", "  ", "\n", "\t", "1", "23", "!", "?", "'s", "'ll", "'", "é", "日本", "語", "。", "　", " ", "😀", "ß", "\r\n", "_", "́", "xxxxxxx", "<|endoftext|>"]


@pytest.fixture(scope="module")
def both():
    ranks = read_ranks(PATH)
    return Bpe(ranks, PATTERN), tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("part", [3, 8, 40])
def test_the_tree_gives_what_the_library_gives(both, monkeypatch, part):
    monkeypatch.setattr(module, "PART", part)
    monkeypatch.setattr(module, "PIECE_PART", max(4, part))
    monkeypatch.setattr(module, "IDS_PART", 5)
    rng = random.Random(part)
    for _ in range(800):
        some = rng.sample(PIECES, rng.randint(1, len(PIECES)))
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 100)))
        ids = both[0].encode(text)
        assert ids.tolist() == both[1].encode_ordinary(text), text
        assert both[0].decode(ids) == text.encode()


def test_one_piece_without_an_end(both, monkeypatch):
    monkeypatch.setattr(module, "PART", 64)
    monkeypatch.setattr(module, "PIECE_PART", 32)
    rng = random.Random(9)
    for letters in ("abcdefghtion", "é日ü", " ", "!?", "12"):
        text = "".join(rng.choice(letters) for _ in range(3000))
        assert both[0].encode(text).tolist() == both[1].encode_ordinary(text)


def test_documents_round_trip(spark, both, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    out = encode_documents(docs, PATH, PATTERN, with_ids=True)
    for r in decode_documents(out, PATH, PATTERN).collect():
        ids = both[1].encode_ordinary(r.text)
        assert r.ids == ids and r.n_tokens == len(ids) and bytes(r.decoded) == r.text.encode()
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_defined_cases(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a", 5), (3, "word " * 100_000, 5), (3, "word " * 100_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = sorted(((r.doc_id, r.n_tokens) for r in encode_documents(df, PATH, PATTERN).collect()), key=repr)
    assert out == sorted([(1, 0), (2, 0), (None, 1), (3, 100_001), (3, 100_001)], key=repr)
    empty = encode_documents(df, PATH, PATTERN).where("doc_id = 1").first()
    assert empty.ids_sha256 == empty.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert encode_documents(df.where("false"), PATH, PATTERN).collect() == []
    assert np.array_equal(Bpe(read_ranks(PATH), PATTERN).encode(""), [])
