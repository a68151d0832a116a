"""MinHash near-duplicate documents with sequential Bayesian verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.minhash import MinHasher
from tessella.llm.nearlinks import near_components
from tessella.llm.scratch import Scratch
from tessella.llm.words import Words, groups, shingles, slices, utf8


def sets_in(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text."""
    data, offsets = utf8(column)
    for i, j in groups(offsets):
        words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for k in range(j - i):
            yield shingles(words, words.first[k], words.first[k + 1], width)


def digest_of(members: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(members.tobytes())


def text_digest_of(text: Column) -> Column:
    """The first 128 bits of a text's SHA-256: rows of one text are told by it."""
    return F.substring(F.unhex(F.sha2(text.cast("string").cast("binary"), 256)), 1, 16)


def _sketch(width: int, hasher: MinHasher) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, digest, sig, keys = [], [], [], []
            for members in sets_in(batch.column("text"), width):
                n.append(len(members))
                if len(members):
                    minima = hasher.minima(members)
                    digest.append(digest_of(members))
                    sig.append(hasher.packed(minima))
                    keys.append(hasher.keys(minima))
                else:
                    digest.append(None)
                    sig.append(None)
                    keys.append(np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), lists], ["doc_id", "uid", "n", "digest", "sig", "keys"])

    return run


def _sets(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digest, sets, held = [], [], 0
            for members in sets_in(batch.column("text"), width):
                if len(members):
                    digest.append(digest_of(members))
                    sets.append(members.tobytes())
                    held += len(sets[-1])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(sets, pa.binary())], ["digest", "set"])
                    digest, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(sets, pa.binary())], ["digest", "set"])

    return run


def _linked(docs: DataFrame, width: int, threshold: tuple[int, int], bands: int, rows: int, miss: float, scratch: Scratch) -> DataFrame:
    """``doc_id, uid, n, root, component_id`` for each row; root and component_id are null for a text without words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("uid", text_digest_of(F.col("text")))
    hasher = MinHasher(bands * rows, bands, rows)
    sketches = scratch.cut(docs.mapInArrow(_sketch(width, hasher), "doc_id long, uid binary, n long, digest binary, sig binary, keys array<long>"), "sketches")
    # the least doc_id that isn't null stands for the class
    least = F.min_by("uid", "doc_id")
    folded = sketches.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.coalesce(least, F.min("uid")).alias("rep_uid"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    classes = scratch.cut(folded, "classes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        reps = classes.join(wanted, "digest", "left_semi").select(F.col("rep").alias("doc_id"), F.col("rep_uid").alias("uid"))
        same = docs.doc_id.eqNullSafe(reps.doc_id) & (docs.uid == reps.uid)
        return docs.join(reps, same, "left_semi").select("text").mapInArrow(_sets(width), "digest binary, set binary")

    rooted = near_components(classes.drop("rep", "rep_uid"), sets_of, hasher, threshold, miss, scratch)
    named = classes.select("digest", "rep").join(rooted, "digest", "left").select("digest", "rep", F.coalesce("root", "digest").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = scratch.cut(named.join(least, "root").select("digest", "root", "component_id"), "of_class")
    scratch.drop(classes)
    return sketches.select("doc_id", "uid", "n", "digest").join(of_class, "digest", "left").drop("digest")


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    threshold: tuple[int, int] = (80, 100),
    bands: int = 32,
    rows: int = 4,
    miss: float = 1e-6,
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``threshold`` or more.

    docs: ``doc_id long, text string``; other columns are left out.  A text's
    words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased;
    its set holds the distinct ``width``-word shingles, or the whole sequence
    if it has fewer words.  ``bands`` bands of ``rows`` MinHash values propose
    pairs: at a similarity of 0.8 a pair is missed with probability 5e-8, at
    0.85 with 6e-11.  Signatures are compared 16 values at a time and a pair is
    dropped once its posterior probability of reaching the threshold is below
    ``miss``.  Survivors are verified on their full sets of 64-bit hashes.

    Returns ``doc_id, n_shingles, component_id, kept``, one row per row of docs.
    component_id: the smallest doc_id reachable over links, itself included.
    Defined cases: a null or empty text, or one without words, has
    n_shingles 0, no link and is kept; rows with equal sets are one class, so a
    doc_id that is repeated yields as many equal rows; a null doc_id takes
    part, never names a component unless all members are null, and is kept
    only then.
    """
    out = _linked(docs, width, threshold, bands, rows, miss, Scratch(docs.sparkSession, "neardup"))
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(
    docs: DataFrame,
    width: int = 5,
    threshold: tuple[int, int] = (80, 100),
    bands: int = 32,
    rows: int = 4,
    miss: float = 1e-6,
) -> DataFrame:
    """docs with one row of each component of near_duplicates, all columns as they are.

    It is a row with the component's least doc_id; of several texts under that
    doc_id the one with the least digest, and of equal rows any one.  Texts
    without words are linked with nothing, so all their rows stay, null ones
    included.  A component whose members all have a null doc_id keeps one row.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    linked = _linked(docs, width, threshold, bands, rows, miss, scratch)
    firsts = linked.where("root is not null and doc_id <=> component_id").groupBy("root", "doc_id").agg(F.min(F.struct("uid")).alias("least"), F.count(F.lit(1)).alias("held"))
    kept = scratch.cut(firsts.select(F.col("doc_id").alias("kept_id"), F.col("least.uid").alias("kept_uid"), (F.col("held") > 1).alias("several")), "kept")
    wordless = linked.where("root is null").select(F.col("doc_id").alias("kept_id"), F.col("uid").alias("kept_uid")).distinct().withColumn("several", F.lit(None).cast("boolean"))
    # the row travels as one value, so that no column of docs can clash
    told = docs.select(F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), text_digest_of(F.col("text")).alias("uid"))
    held = told.join(kept.unionByName(wordless), told.id.eqNullSafe(F.col("kept_id")) & told.uid.eqNullSafe(F.col("kept_uid")))
    # only where a doc_id is repeated can a component's row be there twice
    once = held.where("not coalesce(several, false)").select("row.*")
    return once.unionByName(held.where("several").dropDuplicates(["kept_id", "kept_uid"]).select("row.*"))
