"""How many bytes of rows a Python worker is sent at a time, in the stages of the pipeline and the queries that share them."""

import corpus_pipeline
import pyarrow as pa
import pytest
from paywarden.llm import queries
from paywarden.llm.shared import BATCH_BYTES_KEY, IN_HAND
from pyspark.sql import functions as F


@pytest.fixture
def plain(spark, monkeypatch, tmp_path):
    """The session without a limit of its own, tables of a few long texts, and operators that only hand their rows on."""
    before = spark.conf.get(BATCH_BYTES_KEY, None)
    spark.conf.unset(BATCH_BYTES_KEY)
    docs = spark.range(0, 4_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 300).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", F.lit(1).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    same, scores = (lambda docs, *a, **k: docs), (lambda docs, *a, **k: docs.withColumn("score", F.lit(0.0)))
    for module, name, job in [
            (queries.toxicity, "train", same), (queries.toxicity, "score", scores), (queries.toxicity, "without_toxic", same),
            (queries.minhash, "without_copies", same), (queries.minhash, "near_duplicates", lambda docs, **k: docs.select(
                "doc_id", "text", *[F.lit(0).alias(c) for c in ("n_shingles", "component_id", "kept")])),
            (queries.secret_scan, "known", same), (queries.secret_scan, "learn", same), (queries.secret_scan, "without_secrets", same),
            (queries.secret_scan, "scanned", lambda docs, *a: docs.withColumn("spans", F.expr("array(named_struct('kind', '', 'from', 0, 'upto', 0))"))),
            (queries.bpe, "digests", same)]:
        monkeypatch.setattr(module, name, job)
    yield str(tmp_path)
    spark.conf.unset(BATCH_BYTES_KEY) if before is None else spark.conf.set(BATCH_BYTES_KEY, before)


def _most(spark, sf_dir):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])
    read = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = read.coalesce(1).mapInArrow(sizes, "rows bigint, bytes bigint").collect()
    assert sum(r.rows for r in rows) == 4_000
    return max(r.bytes for r in rows)


@pytest.mark.parametrize("step", ["toxicity", "minhash_dedup", "secret_scan", "bpe"])
def test_stages_send_few_megabytes_at_a_time(spark, plain, step):
    assert _most(spark, plain) > 2 * IN_HAND
    dict(corpus_pipeline.STAGES)[step](spark, spark.read.parquet(f"{plain}/documents.parquet"), plain)
    assert _most(spark, plain) < IN_HAND + 100_000


@pytest.mark.parametrize("name", ["op2_toxicity", "op8_minhash_dedup", "op9_secret_scan", "op10_bpe"])
def test_so_do_the_queries_that_share_a_stage(spark, plain, name):
    queries.QUERIES[name](spark, plain)
    assert _most(spark, plain) < IN_HAND + 100_000


def test_a_limit_of_the_session_stays(spark, plain):
    spark.conf.set(BATCH_BYTES_KEY, "1m")
    corpus_pipeline.encode(spark, spark.read.parquet(f"{plain}/documents.parquet"), plain)
    assert spark.conf.get(BATCH_BYTES_KEY) == "1m" and _most(spark, plain) < (1 << 20) + 100_000
