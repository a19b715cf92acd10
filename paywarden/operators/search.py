"""Text rank, vector search and their combination."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from paywarden.functions.text import tokens
from paywarden.session import work_dir

K1, B = 1.2, 0.75
QUERIES_PER_PASS = 256
RRF = 60


def playbook_content() -> Column:
    """Search document of a guide: labelled fields on lines of their own."""
    def line(label: str, c) -> Column:
        return F.concat(F.lit(f"{label}: "), c)
    return F.concat_ws(
        "\n", "title", line("Agency", F.col("agency")), line("Program", F.col("program")),
        line("Scenario", F.col("scenario")), "summary",
        line("Verification steps", F.array_join("verification_steps", "; ")),
        line("Required documents", F.array_join("required_documents", "; ")),
        line("Hold guidance", F.col("hold_guidance")), line("Authority", F.col("authority_citation")))


# -- text rank ------------------------------------------------------------------------------------

def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(document, term, tf).

    A document is one row, so its terms are counted as runs of its sorted tokens, without a shuffle.
    """
    spread = docs.select(F.col(key).alias("doc"), F.sort_array(tokens(F.col(text))).alias("t")).filter(F.size("t") > 0)
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1),
                      lambda i: (i == 0) | (F.get(F.col("t"), i) != F.get(F.col("t"), i - 1)))
    runs = F.transform("starts", lambda p, j: F.struct(
        F.get(F.col("t"), p).alias("term"),
        (F.coalesce(F.get(F.col("starts"), j + 1), F.size("t")) - p).cast("bigint").alias("tf")))
    return spread.withColumn("starts", starts).select("doc", F.inline(runs))


def term_statistics(docs: DataFrame, text: str) -> DataFrame:
    """Documents and occurrences per term.

    Every document yields its tokens and its distinct tokens, so one aggregation on the term, combined
    on the map side, gives both figures; (document, term) pairs are never shuffled.
    """
    t = docs.select(tokens(F.col(text)).alias("t"))
    both = t.select(F.inline(F.array(
        F.struct(F.col("t").alias("w"), F.lit(0).alias("once")),
        F.struct(F.array_distinct("t").alias("w"), F.lit(1).alias("once")))))
    return both.select("once", F.explode("w").alias("term")).groupBy("term").agg(
        F.sum("once").alias("df"), F.sum(1 - F.col("once")).alias("cf"))


def query_terms(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[^\W_]+", text.lower())))


def _occurrences(words: str, word: str) -> Column:
    return F.size(F.filter(words, lambda x: x == word))


def bm25(docs: DataFrame, key: str, text: str, query: str, k: int = 10) -> DataFrame:
    """Best documents for a query; scores are negative, so the best come first in ascending order.

    Only the query terms matter, so their frequencies are counted inside each row and the texts are never
    shuffled. One pass over the texts writes the documents with a hit (as counts) and observes the
    collection statistics on the way; scoring reads those counts and keeps a bounded top-k.
    """
    terms = query_terms(query)
    counted = docs.select(F.col(key).alias("doc"), tokens(F.col(text)).alias("t")).select(
        "doc", F.size("t").alias("dl"),
        *[_occurrences("t", w).alias(f"tf{i}") for i, w in enumerate(terms)])
    seen = Observation()
    found = F.greatest(*[F.col(f"tf{i}") for i in range(len(terms))], F.lit(0), F.lit(0)) > 0
    path = work_dir(docs.sparkSession, "text-hits")
    counted.observe(
        seen, F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl"),
        *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))],
    ).filter(found).write.parquet(path)
    s = seen.get
    scored = docs.sparkSession.read.schema(counted.schema).parquet(path)
    length = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit((s["dl"] or 0) / max(s["n"], 1) or 1.0))
    total = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), s[f"df{i}"]
        idf = math.log(1 + (s["n"] - df + 0.5) / (df + 0.5))
        total = total + idf * tf * (K1 + 1) / (tf + length)
    return scored.select("doc", F.round(-total, 6).alias("score")).orderBy("score", "doc").limit(k)


# -- vectors --------------------------------------------------------------------------------------

def _unit(block: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(block, axis=1, keepdims=True)
    return np.divide(block, norm, out=np.zeros_like(block), where=norm > 0)


def _partition_top_k(ids: list[int], matrix: np.ndarray, keep: int) -> Callable:
    """Arrow map: the best ``keep`` rows of a partition per query, held in arrays of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0)) for _ in ids]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            scores = np.round(_unit(flat.reshape(len(keys), -1)) @ matrix.T, 9)
            for q in range(len(ids)):
                k = np.concatenate([best[q][0], keys])
                s = np.concatenate([best[q][1], scores[:, q]])
                top = np.lexsort((k, -s))[:keep]
                best[q] = (k[top], s[top])
        for q, (k, s) in enumerate(best):
            if len(k):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), ids[q], np.int64)), pa.array(k), pa.array(s)], ["query_id", "key", "score"])
    return run


def vector_top_k(rows: DataFrame, key: str, vector: str, queries: Sequence[tuple[int, Sequence[float]]], k: int = 5,
                 copies: int = 1) -> DataFrame:
    """Exact cosine top-k for a request's query vectors; rows without a vector are skipped.

    Partitions score Arrow batches against the queries and keep k rows per query, so only
    k × queries × partitions candidates are shuffled. Longer query lists take one pass per slice of
    256. ``copies`` tells how often one row may occur.
    """
    data = rows.filter(F.col(vector).isNotNull()).select(F.col(key).cast("bigint"), F.col(vector))
    out = None
    for start in range(0, len(queries), QUERIES_PER_PASS):
        part = queries[start:start + QUERIES_PER_PASS]
        matrix = _unit(np.asarray([v for _, v in part], dtype=np.float64))
        found = data.mapInArrow(_partition_top_k([q for q, _ in part], matrix, k * copies),
                                "query_id bigint, key bigint, score double")
        out = found if out is None else out.unionByName(found)
    if copies > 1:
        out = out.dropDuplicates(["query_id", "key"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "query_id", F.col("key").alias(key), F.round("score", 5).alias("score"), "rank")


def request_vectors(rows: DataFrame, key: str, vector: str, ids: list[int]) -> list[tuple[int, list[float]]]:
    """The vectors of a few named rows, as request parameters."""
    found = rows.filter(F.col(key).isin(ids) & F.col(vector).isNotNull()).select(key, vector).collect()
    return sorted((r[0], list(r[1])) for r in found)


def ann_index(rows: DataFrame, key: str, vector: str, path: str, tables: int = 6, width: float = 0.8, seed: int = 11):
    """Random-projection index: one stored row per hash table, laid out by (table, bucket).

    The layout ranges include the key, so a bucket holding a large share of the rows is several files.
    Returns the fitted hash model.
    """
    unit = Normalizer(inputCol="v", outputCol="unit").transform(
        rows.filter(F.col(vector).isNotNull()).select(
            F.col(key).cast("bigint").alias("key"), F.col(vector).alias("embedding"),
            array_to_vector(F.col(vector).cast("array<double>")).alias("v")))
    model = BucketedRandomProjectionLSH(
        inputCol="unit", outputCol="hashes", numHashTables=tables, bucketLength=width, seed=seed).fit(unit)
    index = model.transform(unit).select("key", "embedding", F.posexplode("hashes").alias("tbl", "h")).select(
        "key", "embedding", "tbl", vector_to_array("h")[0].cast("bigint").alias("bucket"))
    index.repartitionByRange("tbl", "bucket", "key").sortWithinPartitions("tbl", "bucket").write.mode(
        "overwrite").parquet(path)
    return model


def ann_top_k(spark, path: str, model, key: str, queries: Sequence[tuple[int, Sequence[float]]], k: int = 5) -> DataFrame:
    """Approximate top-k: only the buckets the queries fall in are read, then scored exactly.

    A query whose buckets hold fewer than k rows is answered by the exact search over the index.
    """
    asked = spark.createDataFrame(
        [(int(q), [float(x) for x in _unit(np.asarray([v], dtype=np.float64))[0]]) for q, v in queries],
        "q bigint, u array<double>").select("q", array_to_vector("u").alias("unit"))
    hashed = model.transform(asked).select(F.posexplode("hashes").alias("tbl", "h")).select(
        "tbl", vector_to_array("h")[0].cast("bigint").alias("bucket")).distinct().collect()
    tables = max(r["tbl"] for r in hashed) + 1
    wanted = F.lit(False)
    for t in range(tables):
        wanted = wanted | ((F.col("tbl") == t) & F.col("bucket").isin([r["bucket"] for r in hashed if r["tbl"] == t]))
    stored = spark.read.schema("key bigint, embedding array<float>, tbl int, bucket bigint").parquet(path)
    hits = vector_top_k(stored.filter(wanted), "key", "embedding", queries, k, copies=tables)
    rows = hits.collect()  # at most k rows per query
    short = [q for q in queries if sum(r["query_id"] == q[0] for r in rows) < k]
    out = spark.createDataFrame([r for r in rows if r["query_id"] not in {q for q, _ in short}], hits.schema)
    if short:
        out = out.unionByName(vector_top_k(stored.filter(F.col("tbl") == 0), "key", "embedding", short, k))
    return out.withColumnRenamed("key", key)


def hashing_encoder(size: int = 64) -> Callable[[DataFrame], DataFrame]:
    """Default encoder: hashed term counts at unit length. Any function adding ``vector`` fits the slot."""
    def encode(df: DataFrame) -> DataFrame:
        counted = HashingTF(inputCol="t", outputCol="tf", numFeatures=size).transform(
            df.withColumn("t", tokens(F.col("text"))))
        return Normalizer(inputCol="tf", outputCol="n").transform(counted).withColumn(
            "vector", vector_to_array("n", "float32")).drop("t", "tf", "n")
    return encode


def embed_missing(rows: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Vectors for rows that have text but no vector yet; all other rows pass through untouched."""
    todo = F.col("embedding").isNull() & F.col("text").isNotNull()
    fresh = encode(rows.filter(todo)).select(*[F.col("vector").alias(c) if c == "embedding" else F.col(c)
                                               for c in rows.columns])
    return rows.filter(~todo).unionByName(fresh)


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of two bounded hit lists (doc, rank); a missing list adds nothing."""
    t = text_hits.select("doc", F.col("rank").alias("text_rank"))
    v = vector_hits.select("doc", F.col("rank").alias("vector_rank"))

    def part(rank: str) -> Column:
        return F.coalesce(F.lit(1.0) / (F.lit(RRF) + F.col(rank)), F.lit(0.0))

    return t.join(v, "doc", "full_outer").withColumn("score", F.round(part("text_rank") + part("vector_rank"), 9)) \
        .orderBy(F.desc("score"), "doc").limit(k)
