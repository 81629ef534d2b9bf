"""Predictions from session history with pyspark.ml: adjoiners to expect, primary cabinet, duration."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelworks.operators.ranking import cumulated
from parcelworks.storage import stored

#: Fewest rows that a model is trained on.
LEAST_ROWS = 10

FEATURES = ("type_code", "is_subdivision", "prior_jobs", "known_adjoiners", "type_average", "range_num", "deed_ratio", "plat_ratio")


def features(history: DataFrame) -> DataFrame:
    """Adds numeric features to history (job_type, client_name, job_number, adjoiner_count, deed_count, plat_count).

    No feature knows what is to be predicted: type_average is that of the type's other jobs with adjoiners, prior_jobs counts the
    client's jobs before this one by job number (of equal numbers each other one counts in one direction).  A client or type of any size spreads
    over all tasks.  type_code tells types apart by a hash of 30 bits; shares are capped at 1; missing values count as 0.
    """
    counted = F.when(F.col("adjoiner_count") > 0, F.col("adjoiner_count"))
    types = history.groupBy("job_type").agg(F.sum(counted).alias("__sum"), F.count(counted).alias("__some"))
    rows = history.withColumn("__one", F.lit(1).cast("bigint")).withColumn("__row", F.monotonically_increasing_id())
    placed = stored(cumulated(rows, "__one", "client_name", "job_number", "__row"), "jobs").drop("__one", "__row")
    clients = placed.groupBy("client_name").agg(F.min("upto").alias("__first")).select(F.col("client_name").alias("__client"), "__first")
    share = lambda c: F.least(F.lit(1.0), F.coalesce(F.col(c) / F.greatest(F.col("adjoiner_count"), F.lit(1)), F.lit(0.0)))
    out = placed.join(types, "job_type", "left").join(clients, F.col("client_name").eqNullSafe(F.col("__client")), "left")  # types has one row a job type
    others = F.coalesce(F.col("__some"), F.lit(0)) - F.when(counted.isNotNull(), 1).otherwise(0)
    return out.withColumns({
        "type_average": (F.col("__sum") - F.coalesce(counted, F.lit(0))) / F.nullif(others, F.lit(0)),
        "prior_jobs": (F.col("upto") - F.col("__first")).cast("double"),
        "type_code": F.pmod(F.xxhash64("job_type"), F.lit(1 << 30)) / float(1 << 30),
        "is_subdivision": F.lower("client_name").rlike("subdiv|estate|development|homes").cast("double"),
        "known_adjoiners": F.coalesce(F.col("adjoiner_count"), F.lit(0)).cast("double"),
        "range_num": F.floor(F.col("job_number") / 100) * 100.0,
        "deed_ratio": share("deed_count"), "plat_ratio": share("plat_count"),
    }).drop("__sum", "__some", "upto", "__client", "__first").na.fill(0.0, list(FEATURES))


def save(model: PipelineModel, path: str) -> None:
    """Writes a trained model, over what was there."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _fit_best(candidates, train: DataFrame, test: DataFrame, evaluator, larger: bool):
    fitted = [c.fit(train) for c in candidates]
    scores = [evaluator.evaluate(m.transform(test)) for m in fitted]
    best = max(range(len(scores)), key=lambda i: scores[i] if larger else -scores[i])
    return fitted[best], scores[best]


def train_adjoiners(rows: DataFrame, seed: int = 42):
    """The better of a forest and boosted trees by mean absolute error on a fifth of the rows; None below LEAST_ROWS."""
    used = features(rows.filter("adjoiner_count IS NOT NULL"))
    if used.count() < LEAST_ROWS:
        return None
    inputs = [f for f in FEATURES if f not in ("known_adjoiners", "deed_ratio", "plat_ratio")]
    train, test = used.withColumn("label", F.col("adjoiner_count").cast("double")).randomSplit([0.8, 0.2], seed)
    assemble = VectorAssembler(inputCols=inputs, outputCol="features")
    forest = RandomForestRegressor(numTrees=100, maxDepth=8, seed=seed)
    boosted = GBTRegressor(maxIter=100, maxDepth=5, stepSize=0.1, seed=seed)
    return _fit_best([Pipeline(stages=[assemble, m]) for m in (forest, boosted)], train, test if not test.isEmpty() else train, RegressionEvaluator(metricName="mae"), False)


def train_cabinet(rows: DataFrame, seed: int = 42, boosted_rounds: int = 20):
    """The better of a weighted forest and one-against-rest boosted trees by accuracy; rows without a cabinet are left out."""
    used = features(rows.filter("primary_cabinet IS NOT NULL AND primary_cabinet <> ''"))
    if used.count() < LEAST_ROWS:
        return None
    counts = used.groupBy("primary_cabinet").agg(F.count("*").alias("__n"))
    weighted = used.join(counts, "primary_cabinet").withColumn("weight", 1.0 / F.col("__n"))  # one row a cabinet letter
    indexer = StringIndexer(inputCol="primary_cabinet", outputCol="label", stringOrderType="alphabetAsc").fit(weighted)
    train, test = indexer.transform(weighted).randomSplit([0.8, 0.2], seed)
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(numTrees=100, maxDepth=6, seed=seed, weightCol="weight")
    boosted = OneVsRest(classifier=GBTClassifier(maxIter=boosted_rounds, maxDepth=5, seed=seed))
    model, score = _fit_best([Pipeline(stages=[assemble, m]) for m in (forest, boosted)], train, test if not test.isEmpty() else train, MulticlassClassificationEvaluator(metricName="accuracy"), True)
    return model, indexer.labels, score


def train_duration(rows: DataFrame, seed: int = 42):
    """A forest on durations between 0 and 365 days."""
    used = features(rows.filter("duration_days > 0 AND duration_days < 365"))
    if used.count() < LEAST_ROWS:
        return None
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestRegressor(numTrees=50, maxDepth=6, seed=seed, labelCol="duration_days")
    return Pipeline(stages=[assemble, forest]).fit(used)


#: Adjoiners to expect without a model, by job type.
FALLBACK = {"BDY": 6.0, "ILR": 3.0, "SE": 4.0, "SUB": 8.0, "TOPO": 2.0, "ALTA": 5.0}


def predict_adjoiners(model, rows: DataFrame) -> DataFrame:
    """Adds predicted and complexity (over 10 high, over 5 moderate); without a model a table by job type."""
    if model is None:
        table = F.create_map(*[F.lit(v) for pair in FALLBACK.items() for v in pair])
        out = rows.withColumn("predicted", F.coalesce(F.element_at(table, F.col("job_type")), F.lit(5.0)))
    else:
        out = model.transform(features(rows)).withColumn("predicted", F.greatest(F.lit(0.0), F.col("prediction"))).select(*rows.columns, "predicted")
    return out.withColumn("complexity", F.when(F.col("predicted") > 10, "high").when(F.col("predicted") > 5, "moderate").otherwise("low"))
