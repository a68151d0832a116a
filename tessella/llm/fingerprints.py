"""Document fingerprints by one-permutation MinHash with optimal densification.

A document's shingle hashes are permuted once.  The top bits of a hash choose
one of ``BINS`` bins, and a bin keeps its least value.  An empty bin takes the
value of a bin that is full, found by a hash of its own number and the attempt:
the same choice for every document, independent for every bin, which is the
densification of least variance.  The low ``BITS`` bits of each value are
packed, after the value is mixed with the bin's number: else copies of one
value would agree by chance all together.  Two bins agree by chance with
probability c = 2**-BITS, so the share R of agreeing bins estimates the
similarity as (R - c) / (1 - c).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import Words, groups, mix, shingles, utf8

BINS, BITS = 512, 4
#: Attempts that are worked out at a time.
ATTEMPTS = 256
_SHIFT = np.uint64(64 - (BINS - 1).bit_length())
_SALT = np.uint64(0x2545F4914F6CDD1D)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_BIN_SALT = mix(np.arange(1, BINS + 1, dtype=np.uint64))
_donors: dict[int, np.ndarray] = {}


def _donor(round_: int) -> np.ndarray:
    """For each bin the bins it asks at attempts round_ * ATTEMPTS and on."""
    if round_ not in _donors:
        attempt = np.arange(round_ * ATTEMPTS, (round_ + 1) * ATTEMPTS, dtype=np.uint64)
        asked = mix(mix(np.arange(1, BINS + 1, dtype=np.uint64) * _SALT)[:, None] + attempt[None, :])
        _donors[round_] = (asked >> _SHIFT).astype(np.int64)
    return _donors[round_]


def fingerprint(members: np.ndarray) -> np.ndarray | None:
    """The low bits of all bins for a set of hashes; None for an empty set."""
    if not len(members):
        return None
    h = mix(members ^ _SALT)
    bins = (h >> _SHIFT).astype(np.int64)
    value = np.full(BINS, _FULL)
    np.minimum.at(value, bins, h)
    full = np.zeros(BINS, bool)
    full[bins] = True
    empty = np.flatnonzero(~full)
    round_ = 0
    while len(empty):
        asked = _donor(round_)[empty]
        hit = full[asked]
        found = hit.any(1)
        rows = empty[found]
        value[rows] = value[asked[found, hit[found].argmax(1)]]
        empty = empty[~found]
        round_ += 1
    return (mix(value ^ _BIN_SALT) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def packed(bins: np.ndarray | None) -> str:
    """Two bins a byte, base64; empty for an empty set."""
    return "" if bins is None else base64.b64encode((bins[::2] << BITS) | bins[1::2]).decode()


def unpacked(text: str) -> np.ndarray | None:
    if not text:
        return None
    both = np.frombuffer(base64.b64decode(text), np.uint8)
    return np.stack((both >> BITS, both & ((1 << BITS) - 1)), 1).reshape(-1)


def likeness(left: np.ndarray | None, right: np.ndarray | None) -> float:
    """The estimated similarity, 0 to 1; of two empty sets 1, of one 0."""
    if left is None or right is None:
        return 1.0 if left is right else 0.0
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, ((left == right).mean() - chance) / (1 - chance))))


def _of(texts: list[str], width: int) -> list[np.ndarray | None]:
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    out = []
    for i, j in groups(offsets):
        words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        out += [fingerprint(shingles(words, words.first[k], words.first[k + 1], width)) for k in range(j - i)]
    return out


def fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs with ``fingerprint string`` of the whole text; a null text counts as empty."""
    docs = docs.drop("fingerprint")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([packed(x) for x in _of(texts, width)], pa.string())], [*names, "fingerprint"])

    return docs.mapInArrow(run, docs.withColumn("fingerprint", F.lit("")).schema)


def edited(text: str, following: str) -> str:
    """text with its last half of code points replaced by as many of the first of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Rows that are worked on together.
_ROWS = 256


def _neighbours(width: int) -> Callable:
    """Rows come ordered in each stretch; the row after the last is a guest from the next stretch."""

    def done(rows: list[tuple], following: tuple) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        nexts = [*texts[1:], following[1]]
        changed = [edited(t, n) for t, n in zip(texts, nexts)]
        own = _of([*texts, following[1]], width)
        other = _of(changed, width)
        columns = [
            pa.array([i for i, _ in rows], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([packed(x) for x in own[:-1]], pa.string()),
            pa.array([packed(x) for x in other], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        stretch, ended = None, False
        for batch in batches:
            for place, guest, doc, text in zip(*(batch.column(x) for x in ("stretch", "guest", "doc_id", "text"))):
                if place.as_py() != stretch:
                    assert not held, "a stretch ended without its guest"
                    stretch, ended = place.as_py(), False
                if ended:
                    continue  # further rows of a repeated doc_id at the head of the next stretch
                row = (doc.as_py(), text.as_py() or "")
                if guest.as_py():
                    if held:
                        yield done(held, row)
                    held, ended = [], True
                elif len(held) >= _ROWS:
                    yield done(held, row)
                    held = [row]
                else:
                    held.append(row)
        assert not held, "a stretch ended without its guest"

    return run


def neighbour_fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """Fingerprints of every text and of its edited text, with two likenesses.

    docs: ``doc_id long, text string``.  The edited text has its last
    floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document, by descending doc_id; after the last comes the first.
    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.

    The order is not made by one task: doc_ids are dealt into stretches between
    quantiles, and each stretch also gets the first document of the next one
    as a guest.  Texts are exchanged once.

    Defined cases: a null text is empty; a null doc_id comes last; rows with
    one doc_id follow each other ordered by text; one row alone follows itself.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("q")).first().q or []
    cuts = sorted(set(cuts), reverse=True)

    def place(cuts: list[int], first: int):
        """How many cuts are above doc_id: nested comparisons, of logarithmic depth."""
        if not cuts:
            return F.lit(first)
        middle = len(cuts) // 2
        return F.when(F.col("doc_id") >= F.lit(cuts[middle]), place(cuts[:middle], first)).otherwise(place(cuts[middle + 1 :], first + middle + 1))

    dealt = docs.withColumn("stretch", F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(place(cuts, 0)).cast("int"))
    heads = dealt.groupBy("stretch").agg(F.max("doc_id").alias("head")).orderBy("stretch").collect()  # a row for each stretch
    if not heads:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    # a head goes to the stretch before its own as a guest; the first one to the last
    to = [(heads[k].stretch, heads[k].head, heads[k - 1].stretch) for k in range(len(heads))]
    guests = spark.createDataFrame(to, "stretch int, head long, host int")
    own = dealt.select("stretch", F.lit(False).alias("guest"), "doc_id", "text")
    # a row for each stretch: safe to broadcast
    visiting = dealt.join(F.broadcast(guests), (dealt.stretch == guests.stretch) & dealt.doc_id.eqNullSafe(guests["head"])).select(F.col("host").alias("stretch"), F.lit(True).alias("guest"), "doc_id", "text")
    spread = own.unionByName(visiting).repartitionById(n, F.col("stretch")).sortWithinPartitions("stretch", "guest", F.desc_nulls_last("doc_id"), "text")
    return spread.mapInArrow(_neighbours(width), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
