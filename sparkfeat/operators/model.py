"""Boosted-tree training, search, scoring and reports on MLlib."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from operator import add

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfeat.functions.missing import as_column
from sparkfeat.operators.evaluate import grouped_auc
from sparkfeat.operators.split import SEED
from sparkfeat.sources.store import intermediate_path, materialize, use_checkpoints

# Parameters of the final model, under the names MLlib gives them.
TREE_PARAMETERS = {
    "stepSize": 0.1,
    "maxDepth": 10,
    "minInstancesPerNode": 429,
    "subsamplingRate": 0.87,
    "featureSubsetStrategy": "0.95",
}
# Stop as soon as the validation loss rises, and let a pass over the data cover more tree nodes.
TRAINER_SETTINGS = {"validationTol": 0.0, "maxMemoryInMB": 1024}
FINAL_TREES = 450
SEARCH_TREES = 250
CLASS_WEIGHT = 12.0
SEARCH_POINTS = 2
SEARCH_SPACE = {"subsamplingRate": [0.8, 0.85]}


def boosted_trees(
    features: Sequence[str],
    label: str,
    *,
    trees: int = FINAL_TREES,
    validation: str | None = None,
    weight: str | None = None,
    seed: int = SEED,
    **parameters,
) -> Pipeline:
    """Assembler and boosted-tree classifier for plain-named numeric columns without NULLs.

    With ``validation`` (a boolean column) training stops when those rows' loss no longer
    improves. ``parameters`` override the fixed ones.
    """
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    settings = {**TREE_PARAMETERS, **TRAINER_SETTINGS, **parameters}
    classifier = GBTClassifier(
        labelCol=label, featuresCol="features", maxIter=trees, seed=seed, **settings
    )
    if validation:
        classifier.setValidationIndicatorCol(validation)
    if weight:
        classifier.setWeightCol(weight)
    return Pipeline(stages=[assembler, classifier])


def class_weight(label: str, weight: float = CLASS_WEIGHT) -> Column:
    """Weight of a row: ``weight`` for the positive class, 1 otherwise."""
    return F.when(as_column(label) == 1, F.lit(weight)).otherwise(F.lit(1.0))


def train(df: DataFrame, model: Pipeline) -> PipelineModel:
    """Fit a model. Pass a stored table (see ``materialize``): training reads it several times."""
    use_checkpoints(df.sparkSession)
    return model.fit(df)


def train_wide(df: DataFrame, model: Pipeline) -> PipelineModel:
    """:func:`train` on a table of hundreds of columns, whose vectors are assembled once.

    The trainer reads its rows four times before the first tree (sizes, split points, rows to train
    on, rows to validate on), and assembling a row costs far more than reading its stored vector.
    """
    use_checkpoints(df.sparkSession)
    assembler, classifier = model.getStages()
    rows = assembler.transform(df).drop(*assembler.getInputCols())
    fitted = classifier.fit(materialize(rows, "vectors", dictionaries=False))
    return PipelineModel([assembler, fitted])


def score(model, df: DataFrame, key: str, into: str = "TARGET") -> DataFrame:
    """Probability of class 1 for every row: the key and the score."""
    probability = vector_to_array("probability")[1]
    return model.transform(df).select(as_column(key), probability.alias(into))


def blend(tables: Sequence[DataFrame], key: str, score_name: str = "TARGET") -> DataFrame:
    """Mean of several score tables with one row per key each.

    A key that some tables lack keeps the mean of the scores that it has. All tables move once,
    in one aggregate; the scores of a key are added in the order of the tables.
    """
    rows = reduce(
        DataFrame.unionAll,
        [
            t.select(as_column(key), F.lit(i).alias("__table"), as_column(score_name).alias("__score"))
            for i, t in enumerate(tables)
        ],
    )
    of_table = [F.max(F.when(F.col("__table") == i, F.col("__score"))) for i in range(len(tables))]
    joined = rows.groupBy(as_column(key)).agg(*[c.alias(f"__{i}") for i, c in enumerate(of_table)])
    scores = [F.col(f"__{i}") for i in range(len(tables))]
    total = reduce(add, [F.coalesce(s, F.lit(0.0)) for s in scores])
    present = reduce(add, [s.isNotNull().cast("double") for s in scores])
    return joined.select(as_column(key), F.when(present > 0, total / present).alias(score_name))


def auc(df: DataFrame, score_name: str, label: str) -> float:
    """Exact area under the ROC curve, ties counted half (no binning of the scores)."""
    pairs = df.select(
        as_column(score_name).cast("double").alias("score"),
        as_column(label).cast("double").alias("label"),
    )
    return _auc_evaluator("score", "label").evaluate(pairs)


def _auc_evaluator(raw: str, label: str) -> BinaryClassificationEvaluator:
    return BinaryClassificationEvaluator(
        rawPredictionCol=raw, labelCol=label, metricName="areaUnderROC", numBins=0
    )


# --- parameter search -----------------------------------------------------------------------


#: The name under which a point sets the weight of the positive class.
WEIGHT = "classWeight"


def parameter_grid(space: Mapping[str, Sequence]) -> list[dict]:
    """All combinations of the listed values, each a point: names to values."""
    points: list[dict] = [{}]
    for name, values in space.items():
        points = [{**p, name: v} for p in points for v in values]
    return points


def random_points(
    space: Mapping[str, object], points: int = SEARCH_POINTS, seed: int = SEED
) -> list[dict]:
    """Points drawn from lists of values or from functions of a random generator.

    Of lists alone no point is drawn twice; there are then at most as many as combinations.
    """
    generator = random.Random(seed)
    if not any(callable(values) for values in space.values()):
        every = parameter_grid(space)
        return generator.sample(every, min(points, len(every)))

    def draw(values):
        return values(generator) if callable(values) else generator.choice(list(values))

    return [{name: draw(values) for name, values in space.items()} for _ in range(points)]


def _fit_point(model: Pipeline, rows: DataFrame, point: Mapping, label: str) -> PipelineModel:
    """The pipeline with a point's parameters, fitted to the rows."""
    classifier = model.getStages()[-1]
    parameters = {classifier.getParam(n): v for n, v in point.items() if n != WEIGHT}
    if WEIGHT in point:
        rows = rows.withColumn("__weight", class_weight(label, point[WEIGHT]))
        parameters[classifier.getParam("weightCol")] = "__weight"
    return model.fit(rows, parameters)


def cross_scores(
    df: DataFrame,
    model: Pipeline,
    points: Sequence[Mapping],
    *,
    key: str,
    label: str,
    fold: str = "fold",
    folds: int = 3,
    parallelism: int = 6,
) -> DataFrame:
    """Scores of all rows by every point and fold, as one stored table.

    Its rows are ``point``, ``fold``, ``held_out``, ``key``, ``label`` and ``score``: a model is
    trained on the rows outside of its fold and scores them all, those of its fold as
    ``held_out``. Each training writes its part of the table as soon as it ends, several run at
    once, and none is repeated: reports, refits and checks read the table. Pass a stored table.
    """
    spark = df.sparkSession
    use_checkpoints(spark)
    path = intermediate_path(spark, "cross-scores")

    def run(task) -> None:
        point, n = task
        fitted = _fit_point(model, df.where(as_column(fold) != n), points[point], label)
        scored = fitted.transform(df).select(
            (as_column(fold) == n).alias("held_out"),
            as_column(key).alias("key"),
            as_column(label).alias("label"),
            vector_to_array("probability")[1].alias("score"),
        )
        scored.write.parquet(f"{path}/point={point}/fold={n}")

    tasks = [(p, n) for p in range(len(points)) for n in range(folds)]
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        pool.map(inheritable_thread_target(spark)(run), tasks, chunksize=1)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = (
        f"held_out boolean, key {kinds[key]}, label {kinds[label]}, score double, point int, fold int"
    )
    stored = spark.read.schema(schema).parquet(path)
    return stored.select("point", "fold", "held_out", "key", "label", "score")


def point_text(point: Mapping) -> str:
    return ", ".join(f"{name}={value}" for name, value in sorted(point.items()))


def search_report(scores: DataFrame, points: Sequence[Mapping]) -> DataFrame:
    """One row per point of :func:`cross_scores`: mean test, mean train and deviation of test AUC.

    All areas come from one pass over the table. The deviation is that of the folds themselves,
    not an estimate for other folds.
    """
    areas = grouped_auc(scores, ["point", "fold", "held_out"], "score", "label")
    figures = areas.groupBy("point").agg(
        F.avg(F.when(F.col("held_out"), F.col("auc"))).alias("mean_test"),
        F.avg(F.when(~F.col("held_out"), F.col("auc"))).alias("mean_train"),
        F.stddev_pop(F.when(F.col("held_out"), F.col("auc"))).alias("std_test"),
    )
    names = scores.sparkSession.createDataFrame(
        [(i, point_text(p)) for i, p in enumerate(points)], "point int, parameters string"
    )
    joined = names.join(figures, "point", "left")
    return joined.select("point", "parameters", "mean_test", "mean_train", "std_test")


def refit_best(df: DataFrame, model: Pipeline, points: Sequence[Mapping], report: DataFrame, label: str):
    """The best point of a report and its model, fitted to all rows; only for those who ask."""
    best = report.orderBy(F.desc("mean_test"), "point").first()["point"]
    use_checkpoints(df.sparkSession)
    return points[best], _fit_point(model, df, points[best], label)


# --- reports --------------------------------------------------------------------------------


def feature_names(model: PipelineModel) -> list[str]:
    """A name for every number of the feature vector; only the last column may be a vector."""
    names, size = model.stages[0].getInputCols(), model.stages[-1].numFeatures
    if size == len(names):
        return list(names)
    *single, last = names
    return [*single, *(f"{last}[{i}]" for i in range(size - len(single)))]


def importances(
    spark: SparkSession, model: PipelineModel, names: Sequence[str] | None = None
) -> DataFrame:
    """Importance per feature: gain-based, adding up to 1."""
    names = names or feature_names(model)
    weights = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame(
        [(n, float(w)) for n, w in zip(names, weights)], "feature string, importance double"
    )


_SPLIT = "nodeData.split.featureIndex >= 0"
_NODE = [
    "treeID AS tree",
    "nodeData.id AS node",
    "nodeData.rawCount AS `rows`",
    "nodeData.impurity",
    "nodeData.prediction",
    "nodeData.leftChild AS left_child",
    "nodeData.rightChild AS right_child",
    f"CASE WHEN {_SPLIT} THEN nodeData.split.featureIndex END AS feature_number",
    f"CASE WHEN {_SPLIT} THEN nodeData.gain END AS gain",
    f"CASE WHEN {_SPLIT} THEN try_element_at(nodeData.split.leftCategoriesOrThreshold, 1) END AS threshold",
]


def tree_nodes(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """The nodes of all trees as rows: ``tree``, ``node``, ``rows``, ``impurity``, ``prediction``,
    children, and of inner nodes ``feature`` with ``feature_number``, ``gain`` and ``threshold``.

    The model is stored as MLlib stores it; the nodes are read from there, so a forest of any
    size goes through tasks. ``rows`` are those that reached the node in training.
    """
    path = intermediate_path(spark, "trees")
    model.stages[-1].write().save(path)
    nodes = spark.read.parquet(f"{path}/data").selectExpr(*_NODE)
    names = feature_names(model)
    features = spark.createDataFrame(list(enumerate(names)), "feature_number int, feature string")
    return nodes.join(features, "feature_number", "left")


def split_importances(
    spark: SparkSession, model: PipelineModel, nodes: DataFrame | None = None
) -> DataFrame:
    """How trees use every feature: ``splits``, the number of nodes that split by it, their total
    ``gain`` and the training ``rows`` that passed them. Unused features have 0 in all three."""
    nodes = tree_nodes(spark, model) if nodes is None else nodes
    names = [(n,) for n in feature_names(model)]
    used = nodes.where("feature IS NOT NULL").groupBy("feature").agg(
        F.count(F.lit(1)).alias("splits"), F.sum("gain").alias("gain"), F.sum("rows").alias("rows")
    )
    every = spark.createDataFrame(names, "feature string").join(used, "feature", "left")
    return every.select(
        "feature",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("splits", "gain", "rows")],
    )


def unimportant(tables: Sequence[DataFrame], times: int = 2) -> list[str]:
    """Features without any importance in at least ``times`` of several trainings.

    Gives the list of columns to drop before the next training.
    """
    counts: dict[str, int] = {}
    for table in tables:
        for row in table.where(F.col("importance") == 0).select("feature").collect():
            counts[row["feature"]] = counts.get(row["feature"], 0) + 1
    return sorted(n for n, c in counts.items() if c >= times)


def top_k(df: DataFrame, value: str, name: str, k: int = 20) -> DataFrame:
    """The ``k`` rows with the largest values, largest first; equal values by name."""
    return df.orderBy(as_column(value).desc(), as_column(name)).limit(k)


def last_k(df: DataFrame, value: str, name: str, k: int = 5) -> DataFrame:
    """The ``k`` rows with the largest values in ascending order, best last."""
    best = df.orderBy(as_column(value).desc(), as_column(name)).limit(k)
    return best.orderBy(as_column(value), as_column(name).desc())
