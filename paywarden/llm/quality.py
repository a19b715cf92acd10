"""Text quality by a generalised additive model with pairwise interactions.

Each text becomes a dozen shares and sizes, cut into bins. Shallow trees are boosted one feature after the other, round by
round, and add up to one lookup table per feature; the strongest pairs of features get a table of their own. A score is
the sum of one entry per table, through the logistic function.

Cases: null and empty texts have all features at zero and are scored like any other. Repeated rows are scored one by one.
Several labels of an id count as the largest, null labels and ids are not learned from. With no labelled row, or one class,
the score is the share of good labels (0.5 without any). Extra columns are ignored; empty in, empty out.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.llm import words as W
from paywarden.llm.shared import fold_of, stored, travels

travels(__name__)

#: At most so many labelled rows are learned from: those with the smallest hash of their id.
LEARNED_ROWS = 20_000
NAMES = ["log_bytes", "log_words", "word_length", "upper_share", "symbol_share", "digit_share", "line_share", "wide_share",
         "distinct_words", "distinct_pairs", "repeat_share", "symbol_words"]
BINS, COARSE, PAIRS = 32, 8, 6
UPPER, SYMBOL, DIGIT = (np.zeros(256, bool) for _ in range(3))
UPPER[65:91] = DIGIT[48:58] = True
SYMBOL[33:127] = True
SYMBOL[48:58] = SYMBOL[65:91] = SYMBOL[97:123] = False
SYMBOL[[44, 46]] = False  # comma and full stop belong to prose


def measures(raw: np.ndarray, words: np.ndarray) -> list[float]:
    """The features of one text from its bytes and word hashes, in the order of NAMES."""
    n, m = len(raw), len(words)
    if not n:
        return [0.0] * len(NAMES)
    count = np.bincount(raw, minlength=256)
    symbols, letters = count[SYMBOL].sum(), count[65:91].sum() + count[97:123].sum()
    pairs = words[:-1] * W.PLACE[1] + words[1:]
    return [np.log1p(n), np.log1p(m), (n - count[W.WHITE].sum()) / max(m, 1), count[UPPER].sum() / max(letters, 1), symbols / n,
            count[DIGIT].sum() / n, count[10] / n, count[128:].sum() / n, len(np.unique(words)) / max(m, 1),
            len(np.unique(pairs)) / max(len(pairs), 1), (words[:-1] == words[1:]).sum() / max(m, 1), symbols / max(m, 1)]


def _measurer(batches):
    for batch in batches:
        data, limits = W.buffers(batch.column(1))
        out = np.zeros((batch.num_rows, len(NAMES)))
        for first, hashes, ends in W.word_groups(batch.column(1), W.WHITE):
            for i in range(len(ends) - 1):
                out[first + i] = measures(data[limits[first + i]:limits[first + i + 1]], hashes[ends[i]:ends[i + 1]])
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in out.T)], names=["doc_id", *NAMES])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the features of every row; texts stay in their partition."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _measurer, "doc_id bigint, " + ", ".join(f"{n} double" for n in NAMES))


@dataclass(frozen=True)
class Model:
    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """One table entry per feature and pair, added up for all rows at once."""
        bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)]
        total = np.full(len(x), self.base)
        for b, table in zip(bins, self.tables):
            total += table[b]
        for i, j, table in self.pairs:
            total += table[bins[i] * COARSE // BINS, bins[j] * COARSE // BINS]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _leaf(g, h):
    return -g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per bin of a tree with three or four leaves over one feature."""
    out = np.empty(len(g))
    _, k = _cut(g, h)
    for part in (slice(0, k), slice(k, len(g))):
        gp, hp = g[part], h[part]
        cut = _cut(gp, hp)[1] if len(gp) > 1 else len(gp)
        out[part] = np.concatenate([np.full(cut, _leaf(gp[:cut].sum(), hp[:cut].sum())), np.full(len(gp) - cut, _leaf(gp[cut:].sum(), hp[cut:].sum()))])
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts one feature and then the other on each side."""
    best = (-1.0, np.zeros_like(g))
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for k in range(1, len(a)):
            out, gain = np.empty_like(a), 0.0
            for part in (slice(0, k), slice(k, len(a))):
                gp, hp = a[part].sum(axis=0), b[part].sum(axis=0)
                _, c = _cut(gp, hp)
                for side in (slice(0, c), slice(c, len(gp))):
                    gs, hs = gp[side].sum(), hp[side].sum()
                    out[part, side] = _leaf(gs, hs)
                    gain += gs**2 / (hs + 1)
            if gain > best[0]:
                best = gain, out.T.copy() if flip else out
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15) -> Model:
    """Cyclic boosting of the single features, then of the pairs that gain most on what is left."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0) for j in range(len(NAMES))]
    share = float(y.mean()) if len(y) else 0.5
    tables = [np.zeros(BINS) for _ in NAMES]
    if not 0 < share < 1:
        return Model(float(np.log((share + 1e-12) / (1 - share + 1e-12))), cuts, tables, [])
    base = float(np.log(share / (1 - share)))
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    total = np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for b, table in zip(bins, tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(b, g, BINS), np.bincount(b, h, BINS))
            table += step
            total += step[b]

    def grid(i, j):
        cell = bins[i] * COARSE // BINS * COARSE + bins[j] * COARSE // BINS
        g, h = slopes()
        return cell, *(np.bincount(cell, v, COARSE * COARSE).reshape(COARSE, COARSE) for v in (g, h))

    gains = sorted(((_pair_tree(*grid(i, j)[1:])[0], i, j) for i, j in combinations(range(len(NAMES)), 2)), reverse=True)[:PAIRS]
    pairs = [(i, j, np.zeros((COARSE, COARSE))) for _, i, j in gains]
    for _ in range(rounds // 4):
        for i, j, table in pairs:
            cell, g, h = grid(i, j)
            step = rate * _pair_tree(g, h)[1]
            table += step
            total += step.ravel()[cell]
    return Model(base, cuts, tables, pairs)


def train(features: DataFrame, labels: DataFrame, column: str = "quality", rows: int = LEARNED_ROWS) -> Model:
    """Learn from a bounded number of labelled rows outside fold 0; only their features reach the driver."""
    picked = (labels.select(F.col("doc_id").cast("bigint"), F.col(column).cast("double").alias("label")).dropna()
              .filter(fold_of(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    sample = features.join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), *NAMES).limit(rows).toArrow()
    x = np.stack([sample[n].to_numpy() for n in NAMES], axis=1) if sample.num_rows else np.empty((0, len(NAMES)))
    return fit(x, sample["label"].to_numpy())


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out and score of every row; texts are read once, their features written and used twice."""
    features = stored(measured(docs), "features")
    model = train(features, labels)

    def run(batches):
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1) if batch.num_rows else np.empty((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])
    return features.mapInArrow(run, "doc_id bigint, score double").select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score")
