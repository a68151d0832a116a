"""Toxicity by a chain of linear classifiers.

The categories form a chain.  Each has a logistic model over hashed words and a
few text statistics, and the models of later categories also see the earlier
categories' probabilities.  Those are out-of-fold in training: each labelled
document gets them from models that were fitted without its fold, so that a
later model learns how far an earlier one can be trusted on unseen text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.scratch import Scratch
from tessella.llm.words import Words, groups, slices, utf8

#: Hash buckets for words.
BUCKETS = 1 << 18
DENSE = ("log_words", "upper_share", "symbol_share", "distinct_share")

_ALNUM_OR_SPACE = np.zeros(256, bool)
_ALNUM_OR_SPACE[[*range(48, 58), *range(65, 91), *range(97, 123), 0x20, *range(0x09, 0x0E), *range(128, 256)]] = True
_TRIM = np.zeros(256, bool)
_TRIM[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


@dataclass
class Texts:
    """Features of texts: word buckets and counts of text i at offsets[i] to offsets[i + 1], and a row of dense ones."""

    bucket: np.ndarray
    count: np.ndarray
    offsets: np.ndarray
    dense: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.offsets))

    def rows(self, which: np.ndarray) -> Texts:
        """The texts of the given numbers, in their order."""
        size = np.diff(self.offsets)[which]
        ends = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(self.offsets[which] - ends[:-1], size) + np.arange(ends[-1])
        return Texts(self.bucket[at], self.count[at], ends, self.dense[which])


def featurise(column: pa.Array) -> Texts:
    """Features of a column of texts.  ASCII punctuation at a word's ends is left out of the word."""
    data, offsets = utf8(column)
    buckets, counts, sizes, dense = [], [], [0], np.zeros((len(column), len(DENSE)))
    for i, j in groups(offsets):
        part = data[offsets[i] : offsets[j]]
        at = offsets[i : j + 1] - offsets[i]
        symbol, upper = ~_ALNUM_OR_SPACE[part], (part >= 65) & (part <= 90)
        marks, capitals = (np.concatenate(([0], np.cumsum(x))) for x in (symbol, upper))
        bare = part.copy()
        bare[_TRIM[part]] = 0x20
        words = Words(bare, at)
        for k in range(j - i):
            a, b = words.first[k], words.first[k + 1]
            bucket, count = np.unique((words.hash[a:b] >> np.uint64(20)).astype(np.int32) & np.int32(BUCKETS - 1), return_counts=True)
            size = max(1, int(at[k + 1] - at[k]))
            dense[i + k] = np.log1p(b - a), (capitals[at[k + 1]] - capitals[at[k]]) / size, (marks[at[k + 1]] - marks[at[k]]) / size, len(bucket) / max(1, b - a)
            buckets.append(bucket)
            counts.append(count.astype(np.int32))
            sizes.append(len(bucket))
    none = np.zeros(0, np.int32)
    return Texts(np.concatenate([none, *buckets]), np.concatenate([none, *counts]), np.cumsum(sizes), dense)


def _fit(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 25) -> np.ndarray:
    """Newton's method for ridge logistic regression; the last weight is the intercept."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Link:
    """One category's model: words it looks at, scaling, weights; its base rate and the range of dense features it saw."""

    name: str
    buckets: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float = 0.5
    least: np.ndarray | None = None
    most: np.ndarray | None = None


@dataclass
class Chain:
    """Fitted models in the order of the chain."""

    links: list[Link] = field(default_factory=list)

    def matrix(self, link: Link, texts: Texts, earlier: np.ndarray) -> np.ndarray:
        """Features of one link: log counts of its words, dense features, earlier probabilities' logits."""
        x = np.zeros((len(texts), len(link.buckets)))
        if len(link.buckets):
            at = np.minimum(np.searchsorted(link.buckets, texts.bucket), len(link.buckets) - 1)
            hit = link.buckets[at] == texts.bucket
            x[texts.owners()[hit], at[hit]] = np.log1p(texts.count[hit])
        logits = np.log((earlier + 1e-4) / (1 - earlier + 1e-4))
        # a linear model says nothing beyond what it saw
        dense = texts.dense if link.least is None else np.clip(texts.dense, link.least, link.most)
        return np.column_stack((x, dense, logits))

    def predict(self, texts: Texts) -> np.ndarray:
        out = np.zeros((len(texts), 0))
        for link in self.links:
            x = (self.matrix(link, texts, out) - link.mean) / link.scale
            p = _sigmoid(x @ link.weights[:-1] + link.weights[-1])
            p[np.diff(texts.offsets) == 0] = link.base
            out = np.column_stack((out, p))
        return out


@dataclass
class Counts:
    """Of the labelled texts, by fold: how many there are, how many hold each bucket; the same of each category's positive ones."""

    texts: np.ndarray
    holding: np.ndarray
    positive: np.ndarray
    inside: np.ndarray

    def choose(self, category: int, without: int | None, most: int, least_chi: float) -> np.ndarray:
        """The word buckets whose presence depends on the label, in all folds or all but one: largest chi-square first."""

        def sums(x: np.ndarray) -> np.ndarray:
            return x.sum(0) - (0 if without is None else x[without])

        n, positive = max(1, sums(self.texts)), sums(self.positive[category])
        total, inside = sums(self.holding).astype(float), sums(self.inside[category])
        expected = total * positive / n
        with np.errstate(divide="ignore", invalid="ignore"):
            chi = (inside - expected) ** 2 / (expected * (1 - positive / n) * (1 - total / n))
        chi[~np.isfinite(chi) | (total < 3)] = 0
        best = np.argsort(-chi, kind="stable")[:most]
        return np.sort(best[chi[best] >= least_chi])


def fit_chain(texts: Texts, labels: dict[str, np.ndarray], fold: np.ndarray, chosen: dict[tuple[str, int | None], np.ndarray], ridge: float) -> Chain:
    """labels: categories in the order of the chain, each 0 or 1 by text; chosen: buckets by category and the fold left out."""
    chain = Chain()
    earlier = np.zeros((len(texts), 0))

    def link_of(name: str, without: int | None, y: np.ndarray) -> Link:
        rows = np.flatnonzero(fold != (-1 if without is None else without))
        some = texts.rows(rows)
        link = Link(name, chosen[name, without], np.zeros(0), np.ones(0), np.zeros(0))
        x = chain.matrix(link, some, earlier[rows])
        link.mean, spread = (x.mean(0), x.std(0)) if len(rows) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        link.scale = np.where(spread > 1e-9, spread, 1.0)
        link.weights = _fit((x - link.mean) / link.scale, y[rows], ridge)
        if len(rows):
            link.base, link.least, link.most = float(y[rows].mean()), some.dense.min(0), some.dense.max(0)
        return link

    for name, y in labels.items():
        held_out = np.full(len(texts), 0.5)
        for k in np.unique(fold).tolist():
            rows = np.flatnonzero(fold == k)
            if len(rows) < len(fold):
                link = link_of(name, k, y)
                x = (chain.matrix(link, texts.rows(rows), earlier[rows]) - link.mean) / link.scale
                held_out[rows] = _sigmoid(x @ link.weights[:-1] + link.weights[-1])
        chain.links.append(link_of(name, None, y))
        earlier = np.column_stack((earlier, held_out))
    return chain


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 256):
        t = featurise(batch.column("text"))
        dense = _lists(t.dense.reshape(-1), np.arange(len(t) + 1) * len(DENSE))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(t.bucket, t.offsets), _lists(t.count, t.offsets), dense, batch.column("labels")], ["doc_id", "bucket", "count", "dense", "labels"])


def train_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], max_labelled: int = 8000, folds: int = 5, words: int = 200, ridge: float = 10.0, least_chi: float = 25.0) -> Chain:
    """Fit on at most ``max_labelled`` labelled documents, chosen by a hash of doc_id.

    categories: name to a 0/1 expression over ``labels``, in the order of the
    chain.  Rows with a null doc_id or label are left out; of several texts with
    one doc_id and labels the least is used.

    What reaches the driver is bounded whatever the texts' lengths: a row of
    fixed size for each labelled document, the counts of BUCKETS buckets in each
    fold, and the counts in each document of the buckets that some link looks at,
    ``words`` for each category and fold at most.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.array(*(c.cast("int") for c in categories.values())).alias("labels"))
    picked = picked.where("doc_id is not null and not exists(labels, x -> x is null)").orderBy(F.xxhash64("doc_id"), "doc_id", "labels").limit(max_labelled)
    # max_labelled rows of a few bytes: safe to broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "labels").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    seen = rows.mapInArrow(_extract, "doc_id long, bucket array<int>, count array<int>, dense array<double>, labels array<int>")
    seen = scratch.cut(seen.withColumn("row", F.monotonically_increasing_id()), "features")

    told = seen.select("row", "doc_id", "dense", "labels").toArrow()
    ids = told.column("doc_id").to_numpy()
    dense = np.array(told.column("dense").to_pylist(), float).reshape(-1, len(DENSE))
    given = np.array(told.column("labels").to_pylist(), float).reshape(-1, len(categories))
    # rows come in any order, and the fit must not depend on it
    order = np.lexsort((*given.T, ids))
    ids, dense, given, number = ids[order], dense[order], given[order], told.column("row").to_numpy()[order]
    fold = np.arange(len(ids)) % folds
    # a row of a few bytes for each labelled document, and for each bucket chosen: safe to broadcast
    places = spark.createDataFrame(pa.table({"row": pa.array(number, pa.int64()), "place": pa.array(np.arange(len(ids)), pa.int64()), "fold": pa.array(fold, pa.int32())}))
    seen = seen.join(F.broadcast(places), "row")

    sums = [F.sum(F.col("labels")[k]).cast("int").alias(f"in_{k}") for k in range(len(categories))]
    held = seen.select("fold", "labels", F.explode("bucket").alias("bucket")).groupBy("bucket", "fold").agg(F.count(F.lit(1)).cast("int").alias("n"), *sums).toArrow()
    at = held.column("fold").to_numpy(), held.column("bucket").to_numpy()
    holding, inside = np.zeros((folds, BUCKETS), np.int32), np.zeros((len(categories), folds, BUCKETS), np.int32)
    holding[at] = held.column("n").to_numpy()
    for k in range(len(categories)):
        inside[k][at] = held.column(f"in_{k}").to_numpy()
    positive = np.array([np.bincount(fold, given[:, k], folds) for k in range(len(categories))]).reshape(len(categories), folds)
    counts = Counts(np.bincount(fold, minlength=folds), holding, positive, inside)
    chosen = {(name, k): counts.choose(i, k, words, least_chi) for i, name in enumerate(categories) for k in (*range(folds), None)}

    wanted = spark.createDataFrame(pa.table({"bucket": pa.array(np.unique(np.concatenate(list(chosen.values()))), pa.int32())}))
    each = seen.select("place", F.explode(F.arrays_zip("bucket", "count")).alias("x")).select("place", "x.bucket", "x.count").join(F.broadcast(wanted), "bucket").toArrow()
    place, bucket, count = (each.column(x).to_numpy() for x in ("place", "bucket", "count"))
    by = np.lexsort((bucket, place))
    texts = Texts(bucket[by], count[by], np.searchsorted(place[by], np.arange(len(ids) + 1)), dense)
    scratch.delete(scratch.folder)
    return fit_chain(texts, {name: given[:, k] for k, name in enumerate(categories)}, fold, chosen, ridge)


def _score(chain: Chain, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 512):
            p = chain.predict(featurise(part.column("text")))
            yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), *(pa.array(p[:, k]) for k in range(p.shape[1]))], [*names, *(f"p_{link.name}" for link in chain.links)])

    return run


def score_chain(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs with ``p_<category> double`` for each category.

    Defined cases: a null or empty text, or one without words, has the
    categories' shares among the labelled documents as its probabilities;
    every row is scored by itself, so repeated rows score alike; columns of
    docs with the names of the results are replaced.
    """
    made = [f"p_{link.name}" for link in chain.links]
    docs = docs.drop(*made)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, T.DoubleType()) for x in made)])
    return docs.mapInArrow(_score(chain, docs.columns), schema)


def label_chain() -> dict[str, Column]:
    """The chain over the columns of the labels table: low quality, then toxicity given it."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def toxicity(docs: DataFrame, labels: DataFrame, reject_at: float = 0.5, **options) -> DataFrame:
    """Every row of docs with its categories' probabilities and ``rejected``, p_toxic >= reject_at.

    With no labelled document at all every probability is that of an empty
    model, 0.5, and nothing is rejected.
    """
    chain = train_chain(docs, labels, label_chain(), **options)
    return score_chain(docs.drop("rejected"), chain).withColumn("rejected", (F.col("p_toxic") >= reject_at) & F.lit(len(chain.links[-1].buckets) > 0))
