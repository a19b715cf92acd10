"""Inverted file of product-quantised vectors, and top-k of many queries by blocks of rows.

Vectors are brought to unit length and listed under the nearest of some k-means centres. What is left after the centre is cut into parts, and
each part is replaced by the number of its nearest k-means code, a byte a part. A query reads the lists of its nearest centres
only, estimates all their rows from a table of its products with the codes, and scores the best of these estimates exactly.

Work is dealt in units of one list, a stretch of its rows and a stretch of the queries that ask for it, so that neither a large list nor a
much asked one falls to one task. A unit returns k rows a query. Exact search is the same with one list for all rows and no estimate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors that centres and codes are learned from, picked by a hash of the key.
SAMPLE = 20_000
#: Rows and queries of one unit.
ROWS, QUERIES = 20_000, 2_000
#: Parts of a vector, codes of a part, candidates scored exactly for each row asked for.
PARTS, CODES, RERANK = 8, 256, 20
#: Queries that the number of lists to read is measured with, and the share of nearest rows that these lists hold.
SAMPLED_QUERIES, FOUND = 200, 0.97

STORED = "list int, key bigint, code binary, vector array<float>"


@dataclass(frozen=True)
class Codebook:
    """Centres of the lists, and the codes of each part: of fixed size once the numbers are chosen."""

    centres: np.ndarray  # lists x dimensions
    codes: np.ndarray  # parts x codes x dimensions of a part
    probes: int  # lists to read for a query

    def cut(self, vectors: np.ndarray) -> np.ndarray:
        return vectors.reshape(len(vectors), len(self.codes), -1)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code bytes of unit vectors."""
        near = np.argmax(unit @ self.centres.T - 0.5 * (self.centres ** 2).sum(axis=1), axis=1)
        rest = self.cut(unit - self.centres[near])
        out = np.empty(rest.shape[:2], np.uint8)
        for p, codes in enumerate(self.codes):
            out[:, p] = np.argmax(rest[:, p] @ codes.T - 0.5 * (codes ** 2).sum(axis=1), axis=1)
        return near.astype(np.int32), out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(block: np.ndarray) -> np.ndarray:
    norm = np.sqrt((block * block).sum(axis=1, keepdims=True))
    return np.divide(block, norm, out=np.zeros_like(block), where=norm > 0)


def _centres(spark: SparkSession, block: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means centres of the rows of a matrix, of which there are no more than the sample has."""
    k = min(k, len(block))
    if k < 2:
        return block.mean(axis=0, keepdims=True)
    values = pa.FixedSizeListArray.from_arrays(pa.array(block.ravel()), block.shape[1]).cast(pa.list_(pa.float64()))
    points = spark.createDataFrame(pa.table({"x": values})).select(array_to_vector("x").alias("x")).cache()
    found = KMeans(featuresCol="x", k=k, maxIter=8, seed=seed, initMode="random").fit(points).clusterCenters()
    points.unpersist()
    return np.array(found)


def probes_for(unit: np.ndarray, centres: np.ndarray, near: np.ndarray, k: int = 10) -> int:
    """How many lists to read so that they hold a share ``FOUND`` of the k nearest rows, as seen by sampled queries among the sample.

    Among fewer rows the nearest are farther off, so all rows need no more lists than the sample does.
    """
    asked = unit[:SAMPLED_QUERIES]
    nearest = np.argsort(-(asked @ unit.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    return 1 + int(np.quantile(np.take_along_axis(place, near[nearest], axis=1), FOUND, method="higher"))


def learn(rows: DataFrame, key: str, vector: str, lists: int, parts: int = PARTS, codes: int = CODES, seed: int = 11) -> Codebook:
    """Centres and codes by k-means over a bounded sample."""
    spark = rows.sparkSession
    sample = rows.filter(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<float>").alias("v")).orderBy(
        F.xxhash64("key")).limit(SAMPLE).toArrow()
    unit = _unit(_matrix(sample.column("v").combine_chunks()))
    unit = unit[np.any(unit != 0, axis=1)]
    if not len(unit):
        raise ValueError("no vector to learn from")
    centres = _centres(spark, unit, lists, seed)
    near = np.argmax(unit @ centres.T - 0.5 * (centres ** 2).sum(axis=1), axis=1)
    while unit.shape[1] % parts:
        parts -= 1
    rest = (unit - centres[near]).reshape(len(unit), parts, -1)
    tables = []
    for p in range(parts):
        found = _centres(spark, np.ascontiguousarray(rest[:, p]), codes, seed + p)
        tables.append(np.vstack([found, np.repeat(found[:1], codes - len(found), axis=0)]))
    return Codebook(centres, np.array(tables), probes_for(unit, centres, near))


def write_index(rows: DataFrame, key: str, vector: str, path: str, lists: int | None = None, **settings) -> Codebook:
    """Store every row that has a vector, in folders by list; about the root of the rows are lists, up to 4,096."""
    data = rows.filter(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<float>").alias("vector"))
    lists = lists or max(1, min(4096, int(math.sqrt(data.count()))))
    book = learn(rows, key, vector, lists, **settings)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, codes = book.encode(_unit(_matrix(batch.column(1))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)], names=["list", "key", "code", "vector"])
    coded = data.mapInArrow(encode, STORED)
    coded.repartition("list", F.pmod(F.col("key"), F.lit(8))).write.partitionBy("list").parquet(path)
    return book


def _rank(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _unit_of_work(k: int, book: Codebook | None):
    """Best k rows of each query among the rows of one unit; with a codebook only the best estimates are scored."""
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and asked.num_rows:
            rows = rows.sort_by("key")  # equal estimates are taken in the order of keys
            keys = rows.column("key").to_numpy()
            vectors = _unit(_matrix(rows.column("vector").combine_chunks()))
            ids, wanted = asked.column("query_id").to_numpy(), _unit(_matrix(asked.column("query").combine_chunks()))
            if book is not None:
                codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(keys), -1)
                centre = book.centres[rows.column("list")[0].as_py()]
            for begin in range(0, len(ids), 64):
                block = wanted[begin:begin + 64]
                if book is None or len(keys) <= k * RERANK:
                    scores = block @ vectors.T
                    picks = [np.arange(len(keys))] * len(block)
                else:
                    tables = np.einsum("qpd,pcd->qpc", book.cut(block), book.codes)
                    guess = (block @ centre)[:, None] + sum(tables[:, p][:, codes[:, p]] for p in range(codes.shape[1]))
                    picks = [np.argsort(-g, kind="stable")[:k * RERANK] for g in guess]
                for q, pick in enumerate(picks):
                    s = np.round(scores[q] if book is None or len(keys) <= k * RERANK else vectors[pick] @ block[q], 9)
                    top = np.lexsort((keys[pick], -s))[:k]
                    out.append((np.full(len(top), ids[begin + q]), keys[pick][top], s[top]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "key": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})
    return run


def _top(rows: DataFrame, asked: DataFrame, k: int, book: Codebook | None) -> DataFrame:
    """Top k of ``asked`` (list, query_id, query) among ``rows`` (list, key, vector, code), unit by unit."""
    def stretches(frame: DataFrame, size: int, name: str) -> DataFrame:
        n = F.count(F.lit(1))  # one row for each list, of which there are a few thousand at most
        return frame.groupBy("list").agg(F.ceil(n / size).cast("int").alias(name))
    sizes = stretches(rows, ROWS, "n_rows").join(stretches(asked, QUERIES, "n_asked"), "list")
    sizes = F.broadcast(sizes)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt_rows = rows.join(sizes, "list").select("list", "key", "vector", "code", F.pmod(F.xxhash64("key"), F.col("n_rows")).cast("int").alias("i"), each("n_asked").alias("j"))
    dealt_asked = asked.join(sizes, "list").select("list", "query_id", "query", F.pmod(F.xxhash64("query_id"), F.col("n_asked")).cast("int").alias("j"), each("n_rows").alias("i"))
    place = ["list", "i", "j"]
    found = dealt_rows.groupBy(*place).cogroup(dealt_asked.groupBy(*place)).applyInArrow(_unit_of_work(k, book), "query_id bigint, key bigint, score double")
    return _rank(found, k)


def _asked(queries: DataFrame, key: str, vector: str) -> DataFrame:
    return queries.filter(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("query_id"), F.col(vector).cast("array<float>").alias("query"))


def exact_top_k(rows: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, key, score, rank: exact cosine top k for a frame of queries with the same columns."""
    data = rows.filter(F.col(vector).isNotNull()).select(
        F.lit(0).alias("list"), F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<float>").alias("vector"), F.lit(b"").alias("code"))
    return _top(data, _asked(queries, key, vector).withColumn("list", F.lit(0)), k, None)


def near_top_k(spark: SparkSession, path: str, book: Codebook, key: str, vector: str, queries: DataFrame, k: int = 5, probes: int | None = None) -> DataFrame:
    """The same from the index, over the ``probes`` nearest lists of each query; as many as the codebook says if not given."""
    n = min(probes or book.probes, len(book.centres))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(_unit(_matrix(batch.column(1))) @ book.centres.T), axis=1, kind="stable")[:, :n].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["query_id", "query", "lists"])
    asked = _asked(queries, key, vector).mapInArrow(nearest, "query_id bigint, query array<float>, lists array<int>").select(
        "query_id", "query", F.explode("lists").alias("list"))
    lists = [r[0] for r in asked.select("list").distinct().collect()]  # numbers of lists, a few thousand at most
    stored = spark.read.schema(STORED).parquet(path).filter(F.col("list").isin(lists))
    return _top(stored, asked, k, book)


def recall(exact: DataFrame, near: DataFrame) -> DataFrame:
    """One row: the share of exact hits that the index returned."""
    hit = near.select("query_id", "key", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "key"], "left").agg(F.try_divide(F.count("hit"), F.count(F.lit(1))).alias("recall"))
