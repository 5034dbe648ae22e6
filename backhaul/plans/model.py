"""Fraud model: standardised numerics, one-hot categories, balanced L2 logistic regression."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backhaul.plans.features import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from backhaul.session import written

# Flag threshold, regularisation strength and solver limit.
HIGH_RISK_THRESHOLD = 0.7
C = 1.0
MAX_ITER = 1000

# A null category is a category of its own when training has seen it.
NULL_CATEGORY = "__null__"
# Categories a column may have. Their names pass the driver and become slots of the feature vector.
MAX_CATEGORIES = 1000


def numeric_moments(frame: DataFrame) -> DataFrame:
    """Mean and population standard deviation of every numeric feature, one row."""
    columns = []
    for c in NUMERIC_FEATURES:
        value = F.col(c).cast("double")
        columns += [F.avg(value).alias(f"{c}_mean"), F.stddev_pop(value).alias(f"{c}_std")]
    return frame.agg(*columns)


def standardizer(frame: DataFrame) -> SQLTransformer:
    """Stage that centres numerics and scales them to unit population deviation.

    A constant feature is only centred. The moments, one row, become literals of the stage.
    """
    moments = numeric_moments(frame).first()
    if any(value is None for value in moments):
        raise ValueError("a numeric feature has no values to standardise")
    numerics = [
        f"(CAST({c} AS DOUBLE) - CAST('{moments[c + '_mean']!r}' AS DOUBLE))"
        f" / CAST('{moments[c + '_std'] or 1.0!r}' AS DOUBLE) AS {c}_z"
        for c in NUMERIC_FEATURES
    ]
    categories = [f"coalesce({c}, '{NULL_CATEGORY}') AS {c}_cat" for c in CATEGORICAL_FEATURES]
    return SQLTransformer(statement=f"SELECT *, {', '.join(numerics + categories)} FROM __THIS__")


def check_vocabularies(frame: DataFrame, most: int = MAX_CATEGORIES) -> None:
    """Refuse a `frame` (with `_cat` columns) in which a category column has more than `most` of them:
    so many are no categories but text that wants cleaning first. The indexer would bring them all
    to the driver; this looks at counts only."""
    names = [f"{c}_cat" for c in CATEGORICAL_FEATURES]
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"{c}_cat").alias("label")) for c in CATEGORICAL_FEATURES])
    counts = frame.select(*names).select(F.inline(pairs)).distinct().groupBy("name").agg(F.count("*").alias("n"))
    over = ", ".join(f"{r.name} ({r.n})" for r in sorted(counts.where(F.col("n") > most).collect()))
    if over:
        raise ValueError(f"more than {most} categories in {over}")


def encoder_stages(frame: DataFrame) -> list:
    """Fitted stages that one-hot encode the categories of `frame` (with `_cat` columns).

    Categories are in alphabetical order, up to `MAX_CATEGORIES` of them a column; one that `frame`
    lacks encodes as all zeros: the indexer sends it to an extra last index, which the encoder drops.
    """
    inputs = [f"{c}_cat" for c in CATEGORICAL_FEATURES]
    indexed = [f"{c}_index" for c in CATEGORICAL_FEATURES]
    hot = [f"{c}_hot" for c in CATEGORICAL_FEATURES]
    check_vocabularies(frame)
    indexer = StringIndexer(
        inputCols=inputs, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"
    ).fit(frame)
    encoder = OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True).fit(
        indexer.transform(frame)
    )
    return [indexer, encoder]


def class_weights(frame: DataFrame) -> DataFrame:
    """Balanced weight of each class present: rows / (classes * rows of the class)."""
    n = F.count("label")
    flagged = F.count_if(F.col("label").cast("boolean"))
    counts = frame.agg(n.alias("n"), flagged.alias("n1")).withColumn("n0", F.col("n") - F.col("n1"))
    classes = F.when((F.col("n0") > 0) & (F.col("n1") > 0), 2).otherwise(1)
    pairs = [
        F.when(
            F.col(c) > 0,
            F.struct(
                F.lit(label).alias("label"),
                F.col(c).alias("n_rows"),
                (F.col("n") / (classes * F.col(c))).alias("weight"),
            ),
        )
        for label, c in ((False, "n0"), (True, "n1"))
    ]
    return counts.select(F.inline(F.array_compact(F.array(*pairs))))


def fit(frame: DataFrame) -> PipelineModel:
    """Fit the pipeline on a training frame.

    The frame is read once per fitted stage and once per solver pass, so pass one that is
    stored, not one that repeats its joins on every read. A null numeric feature fails.
    """
    weights = {row["label"]: (row["n_rows"], row["weight"]) for row in class_weights(frame).collect()}
    if not weights:
        raise RuntimeError("No labelled returns to train on")
    if len(weights) < 2:
        raise ValueError("Training needs both flagged and unflagged returns")
    scale = standardizer(frame)
    scaled = scale.transform(frame)
    encoders = encoder_stages(scaled)
    vector = VectorAssembler(
        inputCols=[f"{c}_z" for c in NUMERIC_FEATURES] + [f"{c}_hot" for c in CATEGORICAL_FEATURES],
        outputCol="features",
        handleInvalid="error",
    )
    inputs = PipelineModel(stages=[scale, *encoders, vector])
    label = F.col("label").cast("boolean")
    samples = inputs.transform(frame).select(
        "features",
        label.cast("double").alias("label"),
        F.when(label, weights[True][1]).otherwise(weights[False][1]).alias("weight"),
    )
    # Spark averages the loss over the weights, whose sum is the row count; dividing the penalty
    # by it keeps the minimum of |w|^2 / 2 + C * total loss.
    rows = sum(n for n, _ in weights.values())
    regression = LogisticRegression(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        regParam=1.0 / (C * rows),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=MAX_ITER,
        tol=1e-9,
    ).fit(samples)
    return PipelineModel(stages=[*inputs.stages, regression])


def fit_stored(frame: DataFrame) -> PipelineModel:
    """Fit on a frame that is still a plan: its joins run once, into scratch."""
    return fit(written(frame, "training-frame"))


def score(model: PipelineModel, frame: DataFrame) -> DataFrame:
    """`return_id, probability` of fraud for every row of a scoring frame."""
    return model.transform(frame).select(
        "return_id", F.element_at(vector_to_array("probability"), 2).alias("probability")
    )


def coefficient_names(model: PipelineModel) -> list[str]:
    """Names of the coefficients in order; categories as column=value."""
    indexer = next(s for s in model.stages if isinstance(s, StringIndexerModel))
    values = [f"{c}={v}" for c, labels in zip(CATEGORICAL_FEATURES, indexer.labelsArray) for v in labels]
    return [*NUMERIC_FEATURES, *values]


def slopes(model: PipelineModel, frame: DataFrame) -> DataFrame:
    """`coefficient, slope`: derivative of the penalised weighted loss by each coefficient, over the
    row count, rounded to 4 places. The intercept carries no penalty."""
    fitted = model.stages[-1]
    names = [*coefficient_names(model), "intercept"]
    penalty = [*fitted.coefficients.toArray().tolist(), 0.0]
    label = F.col("label").cast("boolean")
    rows = model.transform(frame).select(
        F.concat(vector_to_array("features"), F.array(F.lit(1.0))).alias("x"),
        (F.element_at(vector_to_array("probability"), 2) - label.cast("double")).alias("gap"),
        label.alias("label"),
    )
    weighted = rows.join(F.broadcast(class_weights(frame).select("label", "weight")), "label")
    each = weighted.select(F.posexplode("x").alias("at", "x"), (F.col("gap") * F.col("weight")).alias("gap"))
    sums = each.groupBy("at").agg(F.sum(F.col("gap") * F.col("x")).alias("loss"), F.count("*").alias("n"))
    at = F.col("at") + 1
    name = F.element_at(F.array(*map(F.lit, names)), at)
    shrink = F.element_at(F.array(*map(F.lit, penalty)), at) / C
    return sums.select(
        name.alias("coefficient"), (F.round((F.col("loss") + shrink) / F.col("n"), 4) + 0.0).alias("slope")
    )


def stored_scores(scores: DataFrame) -> DataFrame:
    """Scores as they are stored: three decimals, and the flag of the unrounded score."""
    p = F.col("probability")
    return scores.select(
        "return_id",
        F.bround(p, 3).cast("decimal(4,3)").alias("fraud_score"),
        (p >= HIGH_RISK_THRESHOLD).alias("fraud_flagged"),
    )


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(spark: SparkSession, path: str) -> PipelineModel:
    try:
        spark.read.text(f"{path.rstrip('/')}/metadata").schema
    except AnalysisException as error:
        raise FileNotFoundError(f"No model at {path}; train one first") from error
    return PipelineModel.load(path)
