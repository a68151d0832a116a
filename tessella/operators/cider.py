"""CIDEr-like scores, with the document frequency of every n-gram of every pair.

Pairs are packed into blocks of words that are written once; a block counts its
own grams without any exchange.  What it has to learn is in how many references of
other blocks each gram stands, and that is none if no other block holds a shorter
gram within.  So lengths go one after the other: a block asks only for grams whose
first and last n - 1 words are both held by other blocks, which then ask too, and
asks by sorted 96-bit hashes, of which mostly the differences are sent.  Answers
come back in the order of the questions, without them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.functions.text import tokens
from tessella.operators.grams import left_of, lists
from tessella.staging import Scratch

#: Words of a block, about; a longer pair is a block of its own.
WORDS = 1 << 20
#: A row is a block, which of its grams it asked for, a question or an answer (``place``: which share of the hashes), or the scores of one length (``place``).
ROW = "block long, kind int, place int, many int, data binary"
BODY, ASKED, ANSWER, SCORES, QUESTION = range(5)
_NAMES = ["block", "kind", "place", "many", "data"]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_CODEC = "zstd"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES)], _NAMES)


def _squeezed(*numbers: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane: the leading bytes of small numbers take next to nothing."""
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T for x in numbers]
    return pa.compress(b"".join(x.tobytes() for x in planes), codec=_CODEC, asbytes=True)


def _restored(data: bytes, many: int, *types: type) -> list[np.ndarray]:
    sizes = [np.dtype(t).itemsize for t in types]
    flat = np.frombuffer(pa.decompress(data, many * sum(sizes), codec=_CODEC), np.uint8)
    ends = np.cumsum(sizes) * many
    return [np.ascontiguousarray(flat[e - s * many : e].reshape(s, many).T).view(t).reshape(-1) for s, e, t in zip(sizes, ends, types)]


# blocks


def _body(batches: list[pa.RecordBatch], kind: pa.DataType) -> tuple[int, bytes]:
    """(rows, a block): the pairs' keys, rows a key, and the words of all references and candidates as numbers of a list."""
    fresh = np.concatenate([x.column("fresh").to_numpy(zero_copy_only=False) for x in batches])
    group = np.split(np.cumsum(fresh) - 1, np.cumsum([x.num_rows for x in batches])[:-1])
    flat, sizes, owner, ours = [], [], [], []
    for x, of in zip(batches, group):
        for side in ("b", "a"):
            words, count = lists(x.column(side))
            flat.append(words)
            sizes.append(count)
            owner.append(of)
            ours.append(np.full(len(of), side == "b"))
    coded = pa.chunked_array(flat, pa.string()).combine_chunks()
    coded = (coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    codes = codes.astype(np.uint16 if len(coded.dictionary) <= 1 << 16 else np.uint32)
    keys = pa.concat_arrays([x.column("pair") for x in batches]).filter(pa.array(fresh))
    columns = {
        "keys": keys.cast(kind), "many": pa.array(np.bincount(np.concatenate(group)).astype(np.int32)), "sizes": pa.array(np.concatenate(sizes).astype(np.int32)), "owner": pa.array(np.concatenate(owner).astype(np.int32)),
        "ours": pa.array(np.concatenate(ours).view(np.uint8)), "words": coded.dictionary, "codes": pa.array(codes),
    }
    one = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in columns.values()], list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, one.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec(_CODEC, 3))) as out:
        out.write_batch(one)
    return len(fresh), sink.getvalue().to_pybytes()


def _blocks(kind: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, first = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            if words >= WORDS:
                # rows of one pair stay together
                fresh = np.flatnonzero(batch.column("fresh").to_numpy(zero_copy_only=False))
                to = int(fresh[0]) if len(fresh) else batch.num_rows
                held.append(batch.slice(0, to))
                batch = batch.slice(to)
                if batch.num_rows:
                    many, data = _body(held, kind)
                    yield _rows([(first, BODY, 0, many, data)])
                    held, words, first = [], 0, first + 1
            if batch.num_rows:
                held.append(batch)
                words += sum(int(lists(batch.column(x))[1].sum()) for x in ("a", "b"))
        if held:
            many, data = _body(held, kind)
            yield _rows([(first, BODY, 0, many, data)])

    return run


class Block:
    def __init__(self, data: bytes):
        one = pa.ipc.open_stream(data).read_next_batch()
        self.keys, self.many, sizes, owner, ours, words, codes = (one.column(x).flatten() for x in ("keys", "many", "sizes", "owner", "ours", "words", "codes"))
        sizes = sizes.to_numpy().astype(np.int64)
        segment, self.left = left_of(sizes)
        self.row, self.ours = owner.to_numpy()[segment], ours.to_numpy().view(bool)[segment]
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words.to_pylist())), ">u8").astype(np.uint64).reshape(-1, 2)
        self.lanes = [both[:, k][codes.to_numpy()] for k in (0, 1)]

    def grams(self, n: int) -> Grams:
        at = np.flatnonzero(self.left >= n)
        hashes = []
        for lane in self.lanes:
            held = np.zeros(len(at), np.uint64)
            for k in range(n):
                held *= _STEP
                held ^= lane[at + k]
                held *= _SPREAD
                held ^= held >> np.uint64(29)
            hashes.append(held)
        return Grams(self, at, hashes[0], (hashes[1] >> np.uint64(32)).astype(np.uint32))


class Grams:
    """The n-grams of a block: ``at`` their places, ``kind`` the class of each, by order of ``main`` and ``more``, its 96 bits."""

    def __init__(self, block: Block, at: np.ndarray, main: np.ndarray, more: np.ndarray):
        order = np.argsort(main)
        ends, rest = main[order], more[order]
        new = ends[1:] != ends[:-1]
        if (rest[1:] != rest[:-1])[~new].any():
            order = np.lexsort((more, main))
            ends, rest = main[order], more[order]
            new = (ends[1:] != ends[:-1]) | (rest[1:] != rest[:-1])
        first = np.concatenate(([True], new)) if len(main) else np.zeros(0, bool)
        self.block, self.at, self.main, self.more = block, at, ends[first], rest[first]
        self.kind = np.empty(len(main), np.int64)
        self.kind[order] = np.cumsum(first) - 1

    def by_pair(self, some: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pair, class, times in the candidate, in the reference) of the grams at some places."""
        at, wide = self.at[some], max(len(self.main), 1)
        found = np.sort((self.block.row[at] * np.int64(wide) + self.kind[some]) * 2 + self.block.ours[at])
        key = found >> 1
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        b = np.add.reduceat(found & 1, start) if len(key) else start
        return *np.divmod(key[start], wide), np.diff(start, append=len(key)) - b, b

    def df(self) -> np.ndarray:
        """In how many references of the block each class stands."""
        return np.bincount(self.by_pair(self.block.ours[self.at])[1], minlength=len(self.main))

    def cosines(self, outside: np.ndarray, docs: int, rows: int) -> np.ndarray:
        """Of each pair, with the idf of its grams."""
        row, of, a, b = self.by_pair()
        df = np.bincount(of[b > 0], minlength=len(self.main)) + outside
        square = (np.log((docs + 1.0) / (df + 1.0)) ** 2)[of]
        xy, xx, yy = (np.bincount(row, x * y * square, rows) for x, y in ((a, b), (a, a), (b, b)))
        full = (xx > 0) & (yy > 0)
        return np.divide(xy, np.sqrt(xx) * np.sqrt(yy), out=np.zeros(rows), where=full)


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(block, its other rows by kind and place after its body); rows come sorted."""
    rows = (row for batch in batches for row in zip(*(batch.column(x).to_pylist() for x in _NAMES)))
    for number, own in groupby(rows, lambda x: x[0]):
        yield number, list(own)


def _outside(own: list[tuple], grams: Grams) -> tuple[np.ndarray, np.ndarray]:
    """In how many references of other blocks each class stands, and whether other blocks hold it, from the answers."""
    out, held = np.zeros(len(grams.main), np.int64), np.zeros(len(grams.main), bool)
    for _, kind, _, many, data in own:
        if kind == ASKED:
            asked = np.unpackbits(_restored(data, many, np.uint8)[0])[: len(out)].astype(bool)
    answers = [_restored(data, many, np.uint32, bool) for _, kind, _, many, data in own if kind == ANSWER]
    if answers:
        out[asked], held[asked] = (np.concatenate(x) for x in zip(*answers))
    return out, held


def _asks(n: int, docs: int, shares: int) -> Callable:
    """Questions of the blocks for the grams of n words, and their scores by those of n - 1, whose answers are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, own in _each_block(batches):
            block, by = Block(own[0][4]), number % shares
            shared = np.ones(len(block.row) + 1, bool)
            if n > 1:
                less = block.grams(n - 1)
                outside, held = _outside(own, less)
                yield _rows([(number, SCORES, by, n - 1, less.cosines(outside, docs, len(block.keys)).tobytes())])
                shared[:] = False
                shared[less.at] = held[less.kind]
                del less, outside, held
            grams = block.grams(n)
            asked = np.zeros(len(grams.main), bool)
            asked[grams.kind[shared[grams.at] & shared[grams.at + (n > 1)]]] = True
            bits = np.packbits(asked)
            yield _rows([(number, ASKED, by, len(bits), _squeezed(bits))])
            main, more, df = grams.main[asked], grams.more[asked], grams.df()[asked].astype(np.uint32)
            share = ((main >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)).astype(np.int64)
            ends = np.searchsorted(share, np.arange(shares + 1))
            for k, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                if i < j:
                    yield _rows([(number, QUESTION, k, j - i, _squeezed(np.diff(main[i:j], prepend=np.uint64(0)), more[i:j], df[i:j]))])

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each question of a share of the hashes the counts of all other blocks, and whether there are any; other rows pass."""

    def told(place: int, asked: list[tuple]) -> Iterator[pa.RecordBatch]:
        parts = [_restored(data, many, np.uint64, np.uint32, np.uint32) for _, many, data in asked]
        main, more, df = (np.concatenate(x) for x in zip(*((np.cumsum(gap, dtype=np.uint64), more, df) for gap, more, df in parts)))
        order = np.argsort(main)
        same = main[order][1:] == main[order][:-1]
        if (more[order][1:] != more[order][:-1])[same].any():
            order = np.lexsort((more, main))
            same = (main[order][1:] == main[order][:-1]) & (more[order][1:] == more[order][:-1])
        start = np.concatenate(([True], ~same))
        at, of = np.flatnonzero(start), np.cumsum(start) - 1
        rest, held = np.empty(len(main), np.uint32), np.empty(len(main), bool)
        rest[order] = np.add.reduceat(df[order].astype(np.int64), at)[of]
        rest -= df
        # a block asks for a gram once
        held[order] = (np.diff(at, append=len(main)) > 1)[of]
        at = 0
        for number, many, _ in asked:
            yield _rows([(number, ANSWER, place, many, _squeezed(rest[at : at + many], held[at : at + many]))])
            at += many

    # a task has one share of the hashes; no row of it can be answered before all are there
    asked: dict[int, list[tuple]] = {}
    for batch in batches:
        for number, kind, place, many, data in zip(*(batch.column(x).to_pylist() for x in _NAMES)):
            if kind == QUESTION:
                asked.setdefault(place, []).append((number, many, data))
            else:
                yield _rows([(number, kind, place, many, data)])
    for place in list(asked):
        yield from told(place, asked.pop(place))


def _scored(max_n: int, docs: int, kind: pa.DataType) -> Callable:
    """``pair, cider``: the lengths' scores, the last of which is worked out here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _each_block(batches):
            block = Block(own[0][4])
            grams = block.grams(max_n)
            each = {many: np.frombuffer(data) for _, of, _, many, data in own if of == SCORES} | {max_n: grams.cosines(_outside(own, grams)[0], docs, len(block.keys))}
            at = np.repeat(np.arange(len(block.keys)), block.many.to_numpy())
            yield pa.RecordBatch.from_arrays([block.keys.take(pa.array(at)).cast(kind), pa.array((sum(each[n] for n in sorted(each)) / max_n)[at])], ["pair", "cider"])

    return run


def cider_like(pairs: DataFrame, max_n: int = 4, near: str | None = None) -> DataFrame:
    """``pair, cider``: cosine of tf-idf n-gram vectors, averaged over lengths 1 to max_n.

    idf is log((N + 1) / (df + 1)) over the references.  Rows of one pair count
    as one text a side; a null pair scores 0.  A task holds a block of words, or
    the questions for its share of the hashes.  ``near``: a column by which pairs
    with much in common are alike, and rows of one pair always; they then come into
    the same blocks.
    """
    spark = pairs.sparkSession
    scratch, shares = Scratch(spark, "cider"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = to_arrow_type(pairs.schema["pair"].dataType)
    # the window keeps rows of one pair in one task, one after the other
    fresh = F.row_number().over(Window.partitionBy(*([near] if near else []), "pair").orderBy("pair")) == 1
    words = pairs.select("pair", fresh.alias("fresh"), tokens(F.col("candidate")).alias("a"), tokens(F.col("reference")).alias("b"))
    blocks = scratch.cut(words.mapInArrow(_blocks(kind), ROW), "blocks", tidy=True)
    docs = blocks.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]

    def met(*tables: DataFrame) -> DataFrame:
        out = blocks
        for table in tables:
            out = out.unionByName(table)
        return out.repartition(shares, "block").sortWithinPartitions("block", "kind", "place")

    told, scores = [], []
    for n in range(1, max_n + 1):
        asks = met(*(t.where(F.col("kind").isin(ASKED, ANSWER)) for t in told[-1:])).mapInArrow(_asks(n, docs, shares), ROW)
        told.append(scratch.cut(asks.repartitionById(shares, F.col("place")).mapInArrow(_answers, ROW), f"told{n}", tidy=True))
        scores.append(told[-1].where(F.col("kind") == SCORES))
    last = met(told[-1].where(F.col("kind").isin(ASKED, ANSWER)), *scores)
    out = scratch.cut(last.mapInArrow(_scored(max_n, docs, kind), f"pair {pairs.schema['pair'].dataType.simpleString()}, cider double"), "out", tidy=True)
    scratch.drop(blocks, *told)
    return out.select("pair", F.when(F.col("pair").isNull(), 0.0).otherwise(F.col("cider")).alias("cider"))
