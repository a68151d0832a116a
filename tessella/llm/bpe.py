"""Byte-level BPE encoding and decoding as a tree reduction.

A text is halved until parts are short; parts are encoded on their own, and
neighbours are joined going up the tree.  Joining re-encodes a window around
the seam and keeps all tokens outside it.  The window is wide enough once
tokens outside it provably stay as they are:

* Between pieces.  The pattern splits a text into pieces, and BPE never merges
  over a piece's end.  No piece holds a non-space followed by white space, a
  letter followed by a non-letter, or a digit followed by a non-digit.  So each
  such place is an end of a piece, whatever stands before or after, and a part
  that begins or ends there splits into the same pieces as in the whole text.
* Inside a piece that is too long for a part.  A sequence of tokens is the BPE
  encoding of its bytes if each two neighbours are the encoding of their own
  joined bytes.  So the window grows until the pairs at both its edges pass.

Decoding concatenates the tokens' bytes up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a part, bytes of a part inside one piece, tokens of a decoding part.
PART, PIECE_PART, IDS_PART = 2048, 4096, 4096

#: One character before and one after an end of a piece.
_END = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})")


class Bpe:
    """An encoder for one vocabulary of ranks and one pattern of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.core = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.pieces = regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.bytes = [b""] * size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.length = np.array([len(x) for x in self.bytes], np.int64)
        self.digits = [b"%d" % i for i in range(size)]

    # encoding

    def encode(self, text: str) -> np.ndarray:
        """The token ids of a whole text."""
        if len(text) <= PART:
            return self._direct(text)
        half = len(text) // 2
        return self._join(text[:half], self.encode(text[:half]), text[half:], self.encode(text[half:]))

    def _direct(self, text: str) -> np.ndarray:
        return np.frombuffer(self.core.encode_to_tiktoken_buffer(text, set()), np.uint32)

    def _join(self, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> np.ndarray:
        """The ids of left + right, from those of both: a growing window around the seam."""
        width = 32
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            ends = [m.start() for m in _END.finditer(left[a:])]
            start = a + ends[-1] if ends else 0 if a == 0 else None
            # the character before right[0] stands in left, so search with it in view
            view = left[-1:] + right[: b + 1]
            shift = len(left[-1:])
            stop = next((m.start() - shift for m in _END.finditer(view) if m.start() >= shift), len(right) if b == len(right) else None)
            if start is not None and stop is not None:
                break
            if width > PART:
                return self._join_piece(left, left_ids, right, right_ids)
            width *= 2
        keep = len(left_ids) - self._covering(left_ids[::-1], len(left[start:].encode()))
        skip = self._covering(right_ids, len(right[:stop].encode()))
        return np.concatenate((left_ids[:keep], self._direct(left[start:] + right[:stop]), right_ids[skip:]))

    def _covering(self, ids: np.ndarray, size: int) -> int:
        """How many of the first ids make up ``size`` bytes."""
        total, n = 0, 0
        while total < size:
            total += self.length[ids[n]]
            n += 1
        assert total == size, "a token crosses the end of a piece"
        return n

    def _join_piece(self, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> np.ndarray:
        """Join where no sure end of a piece lies near the seam.

        The pieces around the seam are found by scanning from the last sure end
        (or the text's start); all but the piece over the seam are encoded
        directly, that piece by :meth:`encode_piece`.
        """
        before = [m.start() for m in _END.finditer(left)]
        start = before[-1] if before else 0
        view = left[-1:] + right
        after = next((m.start() - len(left[-1:]) for m in _END.finditer(view) if m.start() >= len(left[-1:])), len(right))
        keep = len(left_ids) - self._covering(left_ids[::-1], len(left[start:].encode()))
        skip = self._covering(right_ids, len(right[:after].encode()))
        middle = [self.encode_piece(m.group().encode()) for m in self.pieces.finditer(left[start:] + right[:after])]
        return np.concatenate((left_ids[:keep], *middle, right_ids[skip:]))

    def encode_piece(self, piece: bytes) -> np.ndarray:
        """The ids of one piece; halves of a long one are joined by compatible pairs."""
        if len(piece) <= PIECE_PART:
            return np.array(self.core.encode_single_piece(piece), np.uint32)
        half = len(piece) // 2
        left, right = self.encode_piece(piece[:half]), self.encode_piece(piece[half:])
        width = 4
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            window = np.array(self.core.encode_single_piece(self._text(left[a:]) + self._text(right[:b])), np.uint32)
            if (a == 0 or self._fits(left[a - 1], window[0])) and (b == len(right) or self._fits(window[-1], right[b])):
                return np.concatenate((left[:a], window, right[b:]))
            width *= 2

    def _fits(self, first: int, second: int) -> bool:
        return self.core.encode_single_piece(self.bytes[first] + self.bytes[second]) == [first, second]

    # decoding

    def _text(self, ids: np.ndarray) -> bytes:
        return b"".join([self.bytes[i] for i in ids.tolist()])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids."""
        if len(ids) <= IDS_PART:
            return self._text(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def decimal(self, ids: np.ndarray) -> bytes:
        return b",".join([self.digits[i] for i in ids.tolist()])


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _run(ranks: object, pattern: str, names: list[str], with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            bpe = bpe or Bpe(ranks.value, pattern)
            n, ids_sha, text_sha, all_ids = [], [], [], []
            for text in batch.column("text"):
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(bpe.decimal(ids)).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            columns = [*(batch.column(x) for x in names), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if with_ids:
                ends = pa.array(np.cumsum([0, *n]).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *all_ids]))))
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return run


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """docs with ``n_tokens long, ids_sha256 string, decoded_sha256 string`` and, if asked for, ``ids array<int>``.

    vocabulary: path of a tiktoken file on the driver; its ranks (a fixed size,
    whatever the data) are broadcast.  ids_sha256 is of the decimal ids joined
    by commas, decoded_sha256 of the bytes that the ids decode to.

    Defined cases: a null or empty text has no ids; each row is encoded by
    itself; columns of docs with the names of the results are replaced.
    """
    made = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    docs = docs.drop(*made)
    if dict(docs.dtypes).get("text") != "string":
        docs = docs.withColumn("text", F.col("text").cast("string"))
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    kinds = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType())}
    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, kinds.get(x, T.StringType())) for x in made)])
    return docs.mapInArrow(_run(ranks, pattern, docs.columns, with_ids), schema)


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``encoded`` (with ``ids array<int>``) with ``decoded binary``; null ids decode to null."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    encoded = encoded.drop("decoded")
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            bpe = bpe or Bpe(ranks.value, pattern)
            out = [None if x.as_py() is None else bpe.decode(np.array(x.as_py(), np.int64)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))
