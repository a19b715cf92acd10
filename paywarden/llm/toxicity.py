"""Toxicity by logistic regression with FTRL-proximal updates over hashed words, word pairs and skip pairs.

A feature is the presence of a word, of two words in a row, or of two words with one between them (letters and digits, case
ignored). Each coordinate has its own rate, and the L1 term keeps most weights at exactly zero, so the model that
travels to the executors is a short list of (feature, weight).

Cases: null and empty texts and those without words get the score of the bias alone. Repeated rows are scored one by one.
Several labels of one id count as the largest; null labels and ids are not learned from. With no labelled row, or a
single class, every weight is zero and the score is the share of toxic labels (0 without any). Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.llm import words as W
from paywarden.llm.shared import fold_of, in_hand, travels

travels(__name__)

BITS = 20
#: At most so many labelled rows are learned from: those with the smallest hash of their id.
LEARNED_ROWS = 10_000


@dataclass(frozen=True)
class Weights:
    bias: float
    features: np.ndarray
    values: np.ndarray


def features(words: np.ndarray) -> np.ndarray:
    """Hashed feature numbers of one text, repeats included."""
    parts = [words, W.mix(words[:-1] * W.PLACE[1] + words[1:] * W.PLACE[2]), W.mix(words[:-2] * W.PLACE[3] + words[2:] * W.PLACE[4])]
    return (np.concatenate(parts) >> W.U(64 - BITS)).astype(np.int32)


def _each(column: pa.Array):
    for first, hashes, limits in W.word_groups(column, W.PUNCTUATION):
        for i in range(len(limits) - 1):
            yield first + i, features(hashes[limits[i]:limits[i + 1]])


def _lister(batches):
    for batch in in_hand(batches):
        found = {i: np.unique(f) for i, f in _each(batch.column(0))}
        yield pa.RecordBatch.from_arrays(
            [pa.array([found[i] for i in range(batch.num_rows)], pa.list_(pa.int32())), batch.column(1)], names=["features", "label"])


def fit(found: np.ndarray, limits: np.ndarray, labels: np.ndarray, rate: float = 2.0, l1: float = 4.0, l2: float = 0.1, passes: int = 6,
        seen: int = 5) -> Weights:
    """FTRL-proximal: per-coordinate sums of gradients and of their squares give the weight in closed form.

    Row k has the features ``found[limits[k]:limits[k + 1]]``, each once; the array is written over. A feature takes part once ``seen`` texts hold it, so that
    no text is learned by heart from what only it has.
    """
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Weights(40.0 * (2 * share - 1), np.empty(0, np.int32), np.empty(0, np.float32))
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(5)

    def weight(i):
        return -np.where(np.abs(z[i]) <= l1, 0.0, z[i] - np.sign(z[i]) * l1) / ((1 + np.sqrt(n[i])) / rate + l2)

    common, ends = np.zeros(size, np.int32), [0]
    for first, last in zip(limits, limits[1:]):
        common[found[first:last]] += 1
    for first, last in zip(limits, limits[1:]):
        taking_part = found[first:last][common[found[first:last]] >= seen]
        ends.append(ends[-1] + len(taking_part))
        found[ends[-2]:ends[-1]] = taking_part
    limits = np.array(ends)
    for _ in range(passes):
        for k in order.permutation(len(limits) - 1):
            i = np.append(found[limits[k]:limits[k + 1]], size - 1)
            w = weight(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / rate * w
            n[i] += g * g
    every = np.concatenate([weight(np.arange(k, min(k + (1 << 16), size))) for k in range(0, size, 1 << 16)])
    kept = np.flatnonzero(every[:-1])
    return Weights(float(every[-1]), kept.astype(np.int32), every[kept].astype(np.float32))


def labelled(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents outside fold 0, picked by the hash of their id; of one id's texts by theirs."""
    picked = (labels.select(F.col("doc_id").cast("bigint"), F.col(column).cast("double").alias("label")).dropna()
              .filter(fold_of(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    order = F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "label"
    return texts.join(F.broadcast(picked), "doc_id").orderBy(*order).limit(rows).select("text", "label")


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", rows: int = LEARNED_ROWS) -> Weights:
    """Features are made on the executors; the bounded sample of them is learned from in one process."""
    sample = labelled(docs, labels, column, rows).mapInArrow(_lister, "features array<int>, label double").toArrow()
    lists, marks = sample["features"], sample["label"].to_numpy()
    found = np.concatenate([np.empty(0, np.int32), *(c.flatten().to_numpy() for c in lists.chunks)])
    sizes = np.concatenate([np.empty(0, np.int64), *(np.diff(c.offsets.to_numpy()) for c in lists.chunks)]).astype(np.int64)
    del sample, lists
    pa.default_memory_pool().release_unused()
    return fit(*_in_order(found, sizes, marks))


def _in_order(found: np.ndarray, sizes: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, limits and labels of rows that arrive in any order, sorted so that the result does not depend on it.

    All features lie in one array; bytes to compare are made for rows of one length at a time, so that the driver holds few copies.
    """
    starts, order = np.append(0, np.cumsum(sizes)), []
    by_size = np.argsort(sizes, kind="stable")
    for alike in np.split(by_size, np.flatnonzero(np.diff(sizes[by_size])) + 1):
        order.extend(sorted(alike.tolist(), key=lambda k: (found[starts[k]:starts[k + 1]].tobytes(), marks[k])))
    order = np.array(order, np.int64)
    limits, out = np.append(0, np.cumsum(sizes[order])), np.empty_like(found)
    for k, first, last in zip(order, limits, limits[1:]):
        out[first:last] = found[starts[k]:starts[k + 1]]
    return out, limits, marks[order]


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, held_out and score for every row."""
    def run(batches):
        dense = np.zeros(1 << BITS, np.float64)
        dense[weights.features] = weights.values
        for batch in in_hand(batches):
            out = np.zeros(batch.num_rows)
            for i, f in _each(batch.column(1)):
                out[i] = dense[np.unique(f[dense[f] != 0])].sum()
            out = 1 / (1 + np.exp(-np.clip(out + weights.bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double").select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``; texts never leave their partition."""
    weights = train(docs, labels)
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches):
        dense = np.zeros(1 << BITS, np.float64)
        dense[weights.features] = weights.values
        for batch in in_hand(batches):
            out = np.zeros(batch.num_rows)
            for i, f in _each(batch.column(at)):
                out[i] = dense[np.unique(f[dense[f] != 0])].sum()
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(out + weights.bias, -35, 35))) < threshold))
    return docs.mapInArrow(run, schema)
