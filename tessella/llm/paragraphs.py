"""Substring deduplication: MinHash banding of paragraphs and of the windows inside them.

Two sorts of paragraphs are banded.

*Lines* of ``min_words`` words or more are sketched, banded, verified by exact
Jaccard on their shingle sets and clustered by components: edited copies.

*Windows* are all stretches of ``min_words`` words of a document, wherever they
begin and whatever lines they cross: passages spliced into other text, where no
similarity of lines shows them.  A window's set holds its runs of GRAM words,
and its one band is the least hash of these.  Equal windows share it whatever
surrounds them, so the recall is 1; and since neighbouring windows mostly share
it as well, a document has about two keys for each ``min_words - GRAM`` words.
Windows that hold a key of another document are then compared by 128-bit
digests of all their words: similarity 1, edit distance 0.

Every component of lines and every window keeps the occurrence in its least
document; an occurrence in a document with a greater doc_id is a repeat.  The
union of the repeats is cut.  So a word goes only if it lies in a line of a
component, or in ``min_words`` words that some one earlier document holds in
that order; nothing is bridged and no end is guessed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.minhash import MinHasher
from tessella.llm.neardup import digest_of, text_digest_of
from tessella.llm.nearlinks import near_components
from tessella.llm.scratch import Scratch
from tessella.llm.words import Words, distinct, groups, mix, runs, shingle_hashes, shingles, slices, utf8

#: Words in a run of which windows share the least hash: half of a window of 50.
GRAM = 25
#: Rows that a task gathers before it hands them on.
ROWS = 1 << 17
OTHER = np.uint64(0x8EBC6AF09C88C6E3)


def _chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, Words]]:
    """(first row, bytes, words) of stretches of texts; a text is never split."""
    data, offsets = utf8(column)
    for i, j in groups(offsets):
        part = data[offsets[i] : offsets[j]]
        yield i, part, Words(part, offsets[i : j + 1] - offsets[i])


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words, by its first word."""
    at = np.arange(max(0, len(hashes) - size + 1))
    return runs(hashes, at, np.full(len(at), size)) if len(at) else np.zeros(0, np.uint64)


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` neighbours, by doubling."""
    have = 1
    while have < size:
        step = min(have, size - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def window_keys(words: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) for the windows of every text, neighbours with one key taken once."""
    gram = min(GRAM, least)
    if len(words.hash) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    keys = _least(_grams(words.hash, gram), least - gram + 1)
    at = np.arange(len(keys))
    owner = np.searchsorted(words.first, at, "right") - 1
    keep = at + least <= words.first[owner + 1]
    keep[1:] &= (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return owner[keep], keys[keep]


def _lines(data: np.ndarray, words: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, number of words) of the lines with ``least`` words or more."""
    start = words.start
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    line = np.searchsorted(np.flatnonzero(data == 0x0A), start)
    opens = np.ones(len(start), bool)
    opens[1:] = line[1:] != line[:-1]
    opens[words.first[:-1][words.first[:-1] < len(start)]] = True
    at = np.flatnonzero(opens)
    size = np.diff(np.append(at, len(start)))
    at, size = at[size >= least], size[size >= least]
    return np.searchsorted(words.first, at, "right") - 1, at, size


_LINE = [("pos", pa.int32()), ("size", pa.int32()), ("n", pa.int32()), ("digest", pa.binary()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))]
UNITS = "uid binary, doc_id long, seeds array<long>, lines array<struct<pos:int,size:int,n:int,digest:binary,sig:binary,keys:array<long>>>"


def _sketches(hashes: np.ndarray, at: np.ndarray, size: np.ndarray, width: int, hasher: MinHasher) -> tuple[list[int], list[bytes], np.ndarray]:
    """Set sizes, digests and signatures of the lines of ``size`` words from ``at``, each of ``width`` words or more."""
    if not len(at):
        return [], [], np.zeros((0, hasher.size), np.uint32)
    every = shingle_hashes(hashes, width)
    members = [every[a : a + n] for a, n in zip(at.tolist(), (size - width + 1).tolist())]
    minima = hasher.minima_of(np.concatenate(members), np.concatenate(([0], np.cumsum(size - width + 1))))
    sets = [distinct(x.copy()) for x in members]
    return [len(x) for x in sets], [digest_of(x) for x in sets], minima


def _units(width: int, least: int, hasher: MinHasher) -> Callable:
    """For each text of ``least`` words or more the keys of its windows and the sketches of its long lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in slices(batches):
            rows, seeds, seed_ends, line_ends = [none], [none.view(np.uint64)], [0], [0]
            pos, size, n, digest, minima = [none], [none], [], [], [np.zeros((0, hasher.size), np.uint32)]
            for i, data, words in _chunks(batch.column("text")):
                long = np.diff(words.first) >= least
                owner, keys = window_keys(words, least)
                text, at, count = _lines(data, words, least)
                sketch = _sketches(words.hash, at, count, min(width, least), hasher)
                n += sketch[0]
                digest += sketch[1]
                minima.append(sketch[2])
                pos.append(at - words.first[text])
                size.append(count)
                rows.append(np.flatnonzero(long) + i)
                seeds.append(keys)
                seed_ends.extend((seed_ends[-1] + np.cumsum(np.bincount(owner, minlength=len(long))[long])).tolist())
                line_ends.extend((line_ends[-1] + np.cumsum(np.bincount(text, minlength=len(long))[long])).tolist())
            minima = np.concatenate(minima)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * hasher.bands), pa.array(hasher.keys_of(minima).reshape(-1)))
            packed = [hasher.packed(x) for x in minima]
            made = [pa.array(np.concatenate(pos), pa.int32()), pa.array(np.concatenate(size), pa.int32()), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(packed, pa.binary()), keys]
            lines = pa.ListArray.from_arrays(pa.array(line_ends, pa.int32()), pa.StructArray.from_arrays(made, fields=[pa.field(*x) for x in _LINE]))
            held = pa.ListArray.from_arrays(pa.array(seed_ends, pa.int32()), pa.array(np.concatenate(seeds).view(np.int64)))
            rows = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([batch.column("uid").take(rows), batch.column("doc_id").take(rows), held, lines], ["uid", "doc_id", "seeds", "lines"])

    return run


def _windows(least: int) -> Callable:
    """The digests of the windows that hold one of the text's ``seeds``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = min(GRAM, least)
        held: list[list[np.ndarray]] = []

        def handed() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["k1", "k2", "lo", "cls", "pos"])

        for batch in slices(batches):
            lo, cls = batch.column("lo").to_numpy(), batch.column("cls").to_numpy()
            seeds = batch.column("seeds")
            for i, _, words in _chunks(batch.column("text")):
                grams, first = _grams(words.hash, gram), words.first
                one, two = (_grams(x, least) for x in (words.hash, mix(words.hash ^ OTHER)))
                for k in range(len(first) - 1):
                    a, b = first[k], first[k + 1]
                    if b - a < least:
                        continue
                    wanted = seeds[i + k].values.to_numpy().view(np.uint64)
                    hit = np.concatenate(([0], np.cumsum(np.isin(grams[a : b - gram + 1], wanted))))
                    # a window holds the runs that begin at its first least - gram + 1 words
                    at = np.flatnonzero(hit[least - gram + 1 :] > hit[: b - a - least + 1])
                    n = len(at)
                    held.append([one[a + at].view(np.int64), two[a + at].view(np.int64), np.full(n, lo[i + k]), np.full(n, cls[i + k]), at.astype(np.int32)])
                    if sum(len(x[0]) for x in held[-64:]) > ROWS or len(held) >= 256:
                        yield handed()
        if held:
            yield handed()

    return run


def _line_sets(width: int) -> Callable:
    """The full sets of the lines at ``places`` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            digest, sets = [], []
            places = batch.column("places").to_pylist()
            for i, _, words in _chunks(batch.column("text")):
                for k in range(len(words.first) - 1):
                    for x in places[i + k]:
                        a = words.first[k] + x["pos"]
                        members = shingles(words, a, a + x["size"], width)
                        digest.append(digest_of(members))
                        sets.append(members.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(sets, pa.binary())], ["digest", "set"])

    return run


SPANS = "lo long, cls long, spans array<struct<first_word:int,words:int>>"


def merged(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of stretches (first word, number of words) as disjoint ones in order; stretches that touch are one."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], np.maximum.accumulate((first + size)[order])
    opens = np.concatenate(([True], a[1:] > b[:-1]))
    at = np.flatnonzero(opens)
    return a[at], np.append(b[at[1:] - 1], b[-1]) - a[at]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        spans = batch.column("spans")
        firsts, sizes, ends = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [0]
        for x in spans:
            first, size = merged(*(x.values.field(k).to_numpy() for k in (0, 1)))
            firsts.append(first.astype(np.int32))
            sizes.append(size.astype(np.int32))
            ends.append(ends[-1] + len(first))
        made = pa.StructArray.from_arrays([pa.array(np.concatenate(firsts)), pa.array(np.concatenate(sizes))], ["first_word", "words"])
        yield pa.RecordBatch.from_arrays([batch.column("lo"), batch.column("cls"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)], ["lo", "cls", "spans"])


def _cut(names: list[str], text_at: int) -> Callable:
    """Cuts the stretches in ``_spans``, or with ``_whole`` all words, from the text; adds the spans that went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            whole, spans, texts = batch.column("_whole"), batch.column("_spans"), batch.column(names[text_at])
            new: dict[int, tuple[str, list]] = {}
            some = whole.to_numpy(zero_copy_only=False) | spans.is_valid().to_numpy(zero_copy_only=False)
            for row in np.flatnonzero(some).tolist():
                raw = (texts[row].as_py() or "").encode()
                words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                n = len(words.start)
                gone = [{"first_word": 0, "words": n}] if whole[row].as_py() else spans[row].as_py()
                kept, at = [], 0
                for x in gone:
                    a, b = x["first_word"], x["first_word"] + x["words"]
                    kept.append(raw[at : words.start[a]])
                    at = int(words.start[b]) if b < n else len(raw)
                text = b"".join([*kept, raw[at:]]).decode()
                new[row] = (text.rstrip() if at == len(raw) else text, gone)
            columns = [batch.column(x) for x in names]
            if new:
                columns[text_at] = pa.array([new[i][0] if i in new else x for i, x in enumerate(texts.to_pylist())], texts.type)
            removed = pa.array([new[i][1] if i in new else [] for i in range(batch.num_rows)], pa.list_(pa.struct([("first_word", pa.int32()), ("words", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*columns, removed], [*names, "removed"])

    return run


def repeated_passages(
    docs: DataFrame,
    width: int = 5,
    threshold: tuple[int, int] = (80, 100),
    bands: int = 12,
    rows: int = 3,
    signature: int = 48,
    min_words: int = 50,
    miss: float = 1e-6,
    scratch: Scratch | None = None,
) -> DataFrame:
    """``uid, lo, hi, spans`` for each distinct text that has a repeat or occurs under several doc_ids.

    docs: ``doc_id long, text string, uid binary``, without nulls.  uid is the
    digest of the text, lo and hi the least and greatest doc_id with it; spans
    are the repeats in it as ``array<struct<first_word int, words int>>``, in
    order and apart, as the text stands in lo.  Beyond lo the whole text is a
    repeat.  Texts below ``min_words`` words are left out.

    ``bands`` bands of ``rows`` values find a pair of lines with a similarity
    of 0.8 with probability 0.9998, of 0.85 with 0.99999, of 0.9 with 1 - 2e-7.
    """
    scratch = scratch or Scratch(docs.sparkSession, "paragraphs")
    hasher = MinHasher(signature, bands, rows)
    # with lo, half of the digest names a class: texts of one doc_id only have to differ in it
    half = F.conv(F.hex(F.substring("uid", 1, 8)), 16, -10).cast("long")
    units = scratch.cut(docs.mapInArrow(_units(width, min_words, hasher), UNITS), "units")
    # copies fold into one class before anything else is done with their windows
    folded = units.groupBy("uid").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.first("seeds").alias("seeds"))
    classes = scratch.cut(folded.withColumn("cls", half), "classes")
    texts = docs.select(F.col("doc_id").alias("lo"), half.alias("cls"), "text")

    # windows: the keys that two documents hold, then the windows that hold such a key
    seeds = classes.select("lo", "cls", F.explode("seeds").alias("seed"))
    several = F.min("lo") < F.max("lo")
    shared = scratch.cut(seeds.groupBy("seed").agg(several.alias("several")).where("several").select("seed"), "shared")
    marked = scratch.cut(seeds.join(shared, "seed").groupBy("lo", "cls").agg(F.collect_set("seed").alias("seeds")), "marked")
    read = texts.join(marked, ["lo", "cls"]).select("lo", "cls", "seeds", "text")
    windows = scratch.cut(read.mapInArrow(_windows(min_words), "k1 long, k2 long, lo long, cls long, pos int"), "windows")
    scratch.drop(shared, marked)
    held = scratch.cut(windows.groupBy("k1", "k2").agg(F.min("lo").alias("keeper"), F.max("lo").alias("last")).where("keeper < last").select("k1", "k2", "keeper"), "held")
    span = F.struct(F.col("pos").alias("first_word"), F.lit(min_words).alias("words")).alias("span")
    again = windows.join(held, ["k1", "k2"]).where("lo > keeper").groupBy("lo", "cls").agg(F.collect_list(span).alias("spans"))
    again = scratch.cut(again.mapInArrow(_merged, SPANS), "again")
    scratch.drop(windows, held)

    # lines: components of edited copies
    lines = units.select(F.col("doc_id").alias("lo"), half.alias("cls"), F.inline("lines"))
    of_lines = lines.groupBy("digest").agg(F.first("n").cast("long").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys"), F.min(F.struct("lo", "cls", "pos", "size")).alias("at"))
    of_lines = scratch.cut(of_lines, "lines")

    def sets_of(wanted: DataFrame) -> DataFrame:
        places = of_lines.join(wanted, "digest", "left_semi").groupBy("at.lo", "at.cls").agg(F.collect_list(F.struct("at.pos", "at.size")).alias("places"))
        return texts.join(places, ["lo", "cls"]).select("text", "places").mapInArrow(_line_sets(width), "digest binary, set binary")

    rooted = near_components(of_lines.drop("at"), sets_of, hasher, threshold, miss, scratch)
    placed = lines.select("lo", "cls", "pos", "size", "digest").join(rooted, "digest").select("lo", "cls", "pos", "size", "root")
    kept = scratch.cut(placed.groupBy("root").agg(F.min("lo").alias("keeper"), F.max("lo").alias("last")).where("keeper < last").select("root", "keeper"), "kept")
    edited = placed.join(kept, "root").where("lo > keeper").select("lo", "cls", F.array(F.struct(F.col("pos").alias("first_word"), F.col("size").alias("words"))).alias("spans"))

    # a text's repeats are at most its words
    spans = again.unionByName(edited).groupBy("lo", "cls").agg(F.flatten(F.collect_list("spans")).alias("spans")).mapInArrow(_merged, SPANS)
    told = classes.select("uid", "lo", "hi", "cls").join(spans, ["lo", "cls"], "left").where("hi > lo or spans is not null").select("uid", "lo", "hi", "spans")
    told = scratch.cut(told, "repeats")
    scratch.drop(units, classes, again, of_lines, kept)
    return told


def dedup_passages(docs: DataFrame, min_words: int = 50, **options) -> DataFrame:
    """Cut passages of ``min_words`` words or more that an earlier document holds as well.

    docs: ``doc_id long, text string`` and any other columns, which pass
    through.  Returns its rows and columns with the text cut, and ``removed
    array<struct<first_word int, words int>>``, word positions in the old text.
    Words are compared with A-Z lower-cased; line breaks don't matter to equal
    passages.  The least doc_id that holds a passage keeps it.

    Defined cases: a null or empty text is unchanged; a null doc_id takes no
    part and is unchanged; repeats inside one document stay, and rows that share
    a doc_id are one document in that sense: whatever their texts are, they
    repeat none of each other's; a text that is all repeated becomes empty and
    its row stays.  A column named ``removed`` in docs is replaced.
    """
    scratch = Scratch(docs.sparkSession, "paragraphs")
    docs = docs.drop("removed")
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null").withColumn("uid", text_digest_of(F.col("text")))
    repeats = repeated_passages(told, min_words=min_words, scratch=scratch, **options).select(F.col("uid").alias("_uid"), F.col("lo").alias("_lo"), F.col("spans").alias("_spans"))
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("removed", T.ArrayType(T.StructType([T.StructField("first_word", T.IntegerType()), T.StructField("words", T.IntegerType())])))])
    row = docs.select(F.struct(*(F.col(f"`{x}`") for x in names)).alias("_row"), F.col("doc_id").cast("long").alias("_id"), text_digest_of(F.col("text")).alias("_text"))
    beyond = F.coalesce(F.col("_id") > F.col("_lo"), F.lit(False))
    both = row.join(repeats, (row["_text"] == repeats["_uid"]) & row["_id"].isNotNull(), "left")
    return both.select("_row.*", beyond.alias("_whole"), F.when(~beyond, F.col("_spans")).alias("_spans")).mapInArrow(_cut(names, names.index("text")), schema)
