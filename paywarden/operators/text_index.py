"""Stored inverted index with block maxima, and text rank that reads only the blocks that can matter.

A block holds the postings of one stem for a stretch of document ids: ids, frequencies and document lengths, and beside them the
largest frequency and the smallest length. These two bound what the block can add to any score, whatever the average length
is, so they stay right when documents are added. Blocks lie in folders by stem hash, sorted by stem and stretch, so a query's stems
prune folders and row groups at the scan.

A search reads the bounds of its stems, sums them by stretch, and scores the stretches of the highest sums. The score of the k-th document
found so far then rules out every stretch whose sum is smaller; only what is left is read. The result equals that of scoring all documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paywarden.functions.stems import stem
from paywarden.functions.text import tokens
from paywarden.operators.search import K1, B, query_terms

#: Document ids a block spans, as a power of two; folders; words of one task that writes blocks.
STRETCH, FOLDERS, WORDS_PER_TASK = 10, 16, 2_000_000
#: Terms with one in so many words have their stems broadcast; no more than this number can have that share.
BROADCAST_STEMS = 1_000_000
#: Stretches scored before the bound is known, and what rounding may hide.
FIRST, ROUNDED = 8, 1e-6

BLOCKS = ("folder int, term string, stretch bigint, n bigint, occurrences bigint, most bigint, shortest int, "
          "docs array<bigint>, tfs array<bigint>, lengths array<int>")


def _folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def stems_of(words: DataFrame) -> DataFrame:
    """(term, stem) of every distinct term; rules run once a term, not once an occurrence, and on all cores."""
    return words.select("term").distinct().repartition(words.sparkSession.sparkContext.defaultParallelism).withColumn("stem", stem(F.col("term")))


def write_index(docs: DataFrame, key: str, text: str, path: str) -> None:
    """Write the blocks and the collection's figures below ``path``.

    Texts are split once and lie as words from then on. They are shuffled as they are, a stretch to one task, whose blocks need no
    further shuffle; their number follows the number of words. Stems of frequent terms are looked up, the rules run on the others.
    """
    spark = docs.sparkSession
    split = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc"), tokens(F.col(text)).alias("t"))
    split.select("doc", F.size("t").alias("length"), F.array_join("t", " ").alias("words")).filter("length > 0").write.parquet(f"{path}/words")
    texts = spark.read.schema("doc bigint, length int, words string").parquet(f"{path}/words")
    length = texts.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first().length
    words = F.explode(F.split("words", " ")).alias("word")
    often = texts.select(words).groupBy(F.col("word").alias("term")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * BROADCAST_STEMS >= length)
    stems_of(often).write.parquet(f"{path}/stems")
    stems = spark.read.schema("term string, stem string").parquet(f"{path}/stems")
    tasks = max(length // WORDS_PER_TASK + 1, spark.sparkContext.defaultParallelism)
    dealt = texts.withColumn("stretch", F.shiftright(F.col("doc"), STRETCH)).repartition(tasks, "stretch")
    stemmed = dealt.select("stretch", "doc", "length", words).join(F.broadcast(stems), F.col("word") == F.col("term"), "left").select(
        "stretch", "doc", "length", F.coalesce("stem", stem(F.col("word"))).alias("term"))
    by_doc = stemmed.groupBy("stretch", "term", "doc").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    blocks = by_doc.groupBy("stretch", "term").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tf").alias("occurrences"), F.max("tf").alias("most"), F.min("length").alias("shortest"),
        F.sort_array(F.collect_list(F.struct("doc", "tf", "length"))).alias("p"))
    blocks.select(_folder(F.col("term")).alias("folder"), "term", "stretch", "n", "occurrences", "most", "shortest", F.col("p.doc").alias("docs"),
                  F.col("p.tf").alias("tfs"), F.col("p.length").alias("lengths")).sortWithinPartitions("folder", "term", "stretch").write.partitionBy(
                      "folder").parquet(f"{path}/blocks")
    docs.agg(F.lit(length).cast("bigint").alias("length"), F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/figures")


def index_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks")


def query_stems(spark: SparkSession, query: str) -> list[str]:
    words = query_terms(query)
    return list(dict.fromkeys(r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(stem(F.col("w"))).collect())) if words else []


class Search:
    """One query against a stored index; ``mine`` are the blocks of its stems, ``bounds`` the highest score of each stretch."""

    def __init__(self, spark: SparkSession, path: str, query: str, k: int = 10, first: int = FIRST):
        self.spark, self.k, self.first = spark, k, first
        self.stems = query_stems(spark, query)
        figures = spark.read.schema("length bigint, n bigint").parquet(f"{path}/figures").first()
        self.average = figures.length / max(figures.n, 1) or 1.0
        folder_of = F.array(*[_folder(F.lit(s)) for s in self.stems]) if self.stems else F.array().cast("array<int>")
        folders = spark.range(1).select(folder_of).first()[0]
        self.mine = index_blocks(spark, path).filter(F.col("folder").isin(folders) & F.col("term").isin(self.stems))
        df = {r.term: r.n for r in self.mine.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each stem asked
        self.idf = {t: math.log(1 + (figures.n - n + 0.5) / (n + 0.5)) for t, n in df.items()}
        self.bounds = self.mine.groupBy("stretch").agg(F.sum(self._part(F.col("most"), F.col("shortest"))).alias("bound"))

    def _part(self, tf: Column, length: Column) -> Column:
        """What a stem adds to the score of a text."""
        weight = F.lit(0.0)
        for term, idf in self.idf.items():
            weight = F.when(F.col("term") == term, F.lit(idf)).otherwise(weight)
        return weight * tf * (K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(self.average)))

    def _scored(self, blocks: DataFrame) -> DataFrame:
        postings = blocks.select("term", F.inline(F.arrays_zip("docs", "tfs", "lengths")))
        return postings.groupBy(F.col("docs").alias("doc")).agg(F.round(-F.sum(self._part(F.col("tfs"), F.col("lengths"))), 6).alias("score"))

    def top(self) -> DataFrame:
        """(doc, score) of the best k; scores are negative, so the best come first in ascending order."""
        head = [r.stretch for r in self.bounds.orderBy(F.desc("bound"), "stretch").limit(self.first).collect()]
        best = self._scored(self.mine.filter(F.col("stretch").isin(head))).orderBy("score", "doc").limit(self.k).collect()
        rest = ~F.col("stretch").isin(head)
        if len(best) == self.k:
            rest = rest & (F.col("bound") >= -best[-1].score - ROUNDED)
        self.left = self.bounds.filter(rest).select("stretch")
        found = self.spark.createDataFrame(best, "doc bigint, score double")
        return found.unionByName(self._scored(self.mine.join(self.left, "stretch", "left_semi"))).orderBy("score", "doc").limit(self.k)


def bm25(docs: DataFrame, key: str, text: str, query: str, k: int, path: str) -> DataFrame:
    """Index ``docs`` below ``path`` and search there."""
    write_index(docs, key, text, path)
    return Search(docs.sparkSession, path, query, k).top()
