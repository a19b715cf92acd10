"""Features, training and scoring of the disposition model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.functions import rules as R
from paywarden.session import work_dir

CATEGORIES = ["signal_strength_mix", "program", "state", "disposition"]
NUMBERS = ["n_signals", "amount_usd", "days_estimate"]
# Expected days to resolution per disposition at scoring time.
DAYS = {R.RELEASE: 0, R.HOLD: 5, R.REFER: 22}


def training_rows(silver_outcomes: DataFrame) -> DataFrame:
    return silver_outcomes.select(
        "case_id", "n_signals", "signal_strength_mix", "amount_usd", F.coalesce("program", F.lit("?")).alias("program"),
        F.coalesce("state", F.lit("?")).alias("state"), F.col("disposition_chosen").alias("disposition"),
        F.col("days_to_resolution").alias("days_estimate"), F.col("was_improper").cast("int").alias("was_improper"),
        "recovery_amount_usd")


def candidate_rows(queue: DataFrame) -> DataFrame:
    """Every open payment with each of the three dispositions; the options are an array in the row."""
    options = F.array(*[F.struct(F.lit(d).alias("disposition"), F.lit(n).alias("days_estimate")) for d, n in DAYS.items()])
    return queue.select(
        "payment_id", "n_signals", R.signal_strength_mix(F.col("n_signals")).alias("signal_strength_mix"),
        F.col("payment_amount_usd").alias("amount_usd"), F.coalesce("program", F.lit("?")).alias("program"),
        F.coalesce("state", F.lit("?")).alias("state"), F.inline(options))


def _assembled() -> list:
    indexed = [f"{c}_i" for c in CATEGORIES]
    return [
        StringIndexer(inputCols=CATEGORIES, outputCols=indexed, handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_v" for c in CATEGORIES], handleInvalid="keep"),
        VectorAssembler(inputCols=[*NUMBERS, *[f"{c}_v" for c in CATEGORIES]], outputCol="features"),
    ]


def _numeric(rows: DataFrame) -> DataFrame:
    return rows.withColumn("amount_usd", F.col("amount_usd").cast("double"))


def _labelled(rows: DataFrame) -> DataFrame:
    return _numeric(rows).withColumn("recovery", F.col("recovery_amount_usd").cast("double"))


def train(rows: DataFrame, iterations: int = 8, depth: int = 4, seed: int = 7) -> PipelineModel:
    """Classifier for the improper label and regressor for the recovery of improper cases.

    Training reads its rows several times, so they are written once to the shared folder; both models
    share one set of fitted feature stages.
    """
    spark, path = rows.sparkSession, work_dir(rows.sparkSession, "training")
    data = _labelled(rows)
    data.write.parquet(path)
    data = spark.read.schema(data.schema).parquet(path)
    features = Pipeline(stages=_assembled()).fit(data)
    ready = features.transform(data)
    classifier = GBTClassifier(labelCol="was_improper", maxIter=iterations, maxDepth=depth, seed=seed)
    regressor = GBTRegressor(labelCol="recovery", predictionCol="recovery_hat", maxIter=iterations, maxDepth=depth, seed=seed)
    improper = classifier.fit(ready)
    recovery = regressor.fit(ready.filter(F.col("was_improper") == 1))
    return PipelineModel(stages=[*features.stages, improper, recovery])


def evaluate(model: PipelineModel, rows: DataFrame) -> dict[str, float]:
    scored = model.transform(_labelled(rows))
    auc = BinaryClassificationEvaluator(labelCol="was_improper").evaluate(scored)
    rmse = RegressionEvaluator(labelCol="recovery", predictionCol="recovery_hat").evaluate(
        scored.filter(F.col("was_improper") == 1))
    return {"auc": auc, "rmse": rmse}


def score(model: PipelineModel, candidates: DataFrame) -> DataFrame:
    """Best disposition per payment by predicted net value; three candidate rows meet per payment."""
    both = model.transform(_numeric(candidates)).withColumn("p", vector_to_array("probability")[1])
    recovered = F.when(F.col("disposition") == R.RELEASE, F.lit(0.0)).otherwise(
        F.col("p") * F.greatest("recovery_hat", F.lit(0.0)))
    delay = F.col("amount_usd") * 0.005 * F.col("days_estimate")
    net = both.select("payment_id", "disposition", F.col("p").alias("improper_probability"),
                      recovered.alias("predicted_recovery_usd"), (recovered - delay).alias("predicted_net_value_usd"))
    best = F.max_by(F.struct(*[c for c in net.columns if c != "payment_id"]),
                    F.struct("predicted_net_value_usd", "disposition"))
    return net.groupBy("payment_id").agg(best.alias("b")).select("payment_id", "b.*")
