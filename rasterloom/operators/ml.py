"""Classifiers over feature vectors: scaling, forest, grid search, kernel features and neighbours."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators import diagrams
from rasterloom.operators.features import mix_id


def standardized(rows: DataFrame, columns: list[str], fitted: DataFrame | None = None) -> DataFrame:
    """Columns less their mean, over the population standard deviation of the (training) rows; 0 where that is 0."""
    source = fitted if fitted is not None else rows
    stats = source.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])
    return rows.join(F.broadcast(stats)).select(*[c for c in rows.columns if c not in columns], *[F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_mean"), F.col(f"{c}_std")), F.lit(0.0)).alias(c) for c in columns])


def gathered(rows: DataFrame) -> DataFrame:
    """``rows`` (column features) kept in as many partitions as a million numbers each need.

    A model reads its rows dozens of times; a task for each few rows would take longer to start than to run.
    """
    rows = rows.persist()
    n, first = rows.count(), rows.select("features").first()
    found = rows.coalesce(max(1, -(-n * (first.features.size if first else 0) // 1_000_000))).persist()
    found.count()
    rows.unpersist()
    return found


def forest(trees: int = 100, seed: int = 0) -> Pipeline:
    return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), RandomForestClassifier(featuresCol="scaled", labelCol="label", numTrees=trees, seed=seed)])


def accuracy(predicted: DataFrame) -> float:
    return MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy").evaluate(predicted)


def forest_accuracy(rows: DataFrame, trees: int = 100, seed: int = 0) -> DataFrame:
    """trees, train_rows, test_rows, accuracy of a forest fitted where not is_test (columns features, label, is_test)."""
    rows = rows.persist()
    train, test = rows.where("not is_test"), rows.where("is_test")
    model = forest(trees, seed).fit(train)
    found = (trees, train.count(), test.count(), float(accuracy(model.transform(test))))
    rows.unpersist()
    return rows.sparkSession.createDataFrame([found], "trees int, train_rows long, test_rows long, accuracy double")


def kernel_svm(reg: float = 0.01) -> Pipeline:
    """Linear machine over kernel values to the query set: the stand-in for a machine with a precomputed kernel."""
    return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), LinearSVC(featuresCol="scaled", labelCol="label", regParam=reg, maxIter=30)])


def kernel_machine(reg: float = 0.01) -> LinearSVC:
    """The machine of ``kernel_svm`` without its scaler: LinearSVC itself fits on centred values over their deviation.

    Its blocks of rows are kept well below half a region of the heap (1 MB); those
    of 1 MB that it makes by itself take two regions each, twice what Spark counts.
    """
    return LinearSVC(featuresCol="features", labelCol="label", regParam=reg, maxIter=30, maxBlockSizeInMB=0.125)


def kernel_rows(kernel: DataFrame, name: str = "kernel") -> DataFrame:
    """image_id, features: each image's kernel values (image_id, other, ``name``) in order of the others."""
    ordered = F.array_sort(F.collect_list(F.struct("other", name)))
    return kernel.groupBy("image_id").agg(array_to_vector(F.transform(ordered, lambda x: x[name])).alias("features"))


def kernel_vectors(lists: DataFrame, bandwidth: float) -> DataFrame:
    """``kernel_rows`` of ``diagrams.kernel``, from lists of distances (``diagrams.lists_to_queries``), so that no row for each pair is moved."""
    values = F.arrays_zip("others", F.transform("distances", lambda x: F.exp(-x / (2 * bandwidth * bandwidth))).alias("kernel"))
    ordered = F.array_sort(F.flatten(F.collect_list(values)))
    return lists.groupBy("image_id").agg(array_to_vector(F.transform(ordered, lambda x: x["kernel"])).alias("features"))


def kernel_features(diagram: DataFrame, rows: DataFrame, bandwidth: float, every: int = 20) -> DataFrame:
    """``rows`` with features: ``kernel_vectors`` of sliced Wasserstein distances, worked out where they are put together."""
    found = diagrams.vectors_to_queries(diagram, diagrams.sliced_wasserstein, lambda x: np.exp(-x / (2 * bandwidth * bandwidth)), rows, "features", every)
    return found.withColumn("features", array_to_vector("features"))


def kernel_accuracy(rows: DataFrame, reg: float = 0.01) -> DataFrame:
    """train_rows, test_rows, train_accuracy, test_accuracy of a kernel machine fitted where not is_test (columns features, label, is_test).

    The rows, with a number for each pair, are read four times and not kept here:
    they should come from a checkpoint. Spark's cache would hold them in batches
    of many rows, and the memory is needed for the machine's own blocks.
    """
    n, first = rows.count(), rows.select("features").first()
    numbers = n * (first.features.size if first else 0)
    few = rows.coalesce(max(1, min(64, -(-numbers // 1_000_000)), -(-numbers // 2_000_000)))
    model = kernel_machine(reg).fit(few.where("not is_test"))
    right = (F.col("prediction") == F.col("label")).cast("double")
    by = {x.is_test: (x.n, x.accuracy) for x in model.transform(few).groupBy("is_test").agg(F.count("*").alias("n"), F.avg(right).alias("accuracy")).collect()}
    (train, train_accuracy), (test, test_accuracy) = (by.get(x, (0, math.nan)) for x in (False, True))
    return rows.sparkSession.createDataFrame([(train, test, train_accuracy, test_accuracy)], "train_rows long, test_rows long, train_accuracy double, test_accuracy double")


def grid_search(rows: DataFrame, folds: int = 3, seed: int = 0, parallelism: int = 4) -> DataFrame:
    """candidate, metric, best: cross-validated accuracy of forests and linear machines over a small grid (label 0 or 1)."""
    evaluator = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    rows, found = gathered(rows), []  # every candidate and fold reads them
    tree = RandomForestClassifier(featuresCol="features", labelCol="label", seed=seed)
    grid = ParamGridBuilder().addGrid(tree.numTrees, [20, 50]).addGrid(tree.maxDepth, [3, 5]).build()
    line = LinearSVC(featuresCol="features", labelCol="label")
    for name, est, options in (("forest", tree, grid), ("linear_svm", line, ParamGridBuilder().addGrid(line.regParam, [0.01, 0.1]).build())):
        model = CrossValidator(estimator=est, estimatorParamMaps=options, evaluator=evaluator, numFolds=folds, seed=seed, parallelism=parallelism).fit(rows)
        found += [(f"{name} {' '.join(f'{p.name}={v}' for p, v in sorted(o.items(), key=lambda x: x[0].name))}", float(m)) for o, m in zip(options, model.avgMetrics, strict=True)]
    rows.unpersist()
    best = max(m for _, m in found)
    return rows.sparkSession.createDataFrame([(n, m, m == best) for n, m in found], "candidate string, metric double, best boolean")


def diagram_grid(diagram: DataFrame, labels: DataFrame, folds: int = 3, every: int = 20, trees: int = 20) -> DataFrame:
    """candidate, metric, best: cross-validated accuracy of eight ways from diagrams (image_id, birth, death) to a class (image_id, label 0 or 1).

    With and without scaling to 0..1: a kernel machine over sliced Wasserstein
    kernels of two bandwidths, a forest over silhouettes at 100 places, and
    neighbours by bottleneck distance (up to 0.1). Kernels and distances are to
    the query set (``diagrams.to_queries``); neighbours vote on it. Folds go by
    the scrambled id.
    """
    cases = labels.withColumn("fold", (mix_id("image_id", 0) % folds).cast("int")).persist()
    evaluator = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")

    def checked(estimator, rows: DataFrame) -> float:
        rows = rows.join(cases, "image_id").persist()
        rows.count()
        model = CrossValidator(estimator=estimator, estimatorParamMaps=[{}], evaluator=evaluator, numFolds=folds, foldCol="fold").fit(rows)
        rows.unpersist()
        return float(model.avgMetrics[0])

    found = []
    for scaled in (False, True):
        points = diagrams.finite(diagram)
        points = (diagrams.min_max(points) if scaled else points).persist()
        moved = diagrams.to_queries(points, diagrams.sliced_wasserstein, "distance", every).persist()
        for width in (0.1, 1.0):
            found.append((f"sliced_wasserstein bandwidth={width} scaled={scaled}", checked(kernel_svm(), kernel_rows(diagrams.kernel(moved, "distance", width)))))
        moved.unpersist()
        grid = diagrams.sampled(points, "image_id", m=100).groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "silhouette"))).alias("at"))
        silhouettes = grid.select("image_id", array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(0.0)))).alias("features"))
        found.append((f"silhouette forest scaled={scaled}", checked(RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, seed=0), silhouettes)))
        near = diagrams.to_queries(points, lambda a, b: diagrams.bottleneck(a, b, 0.1), "distance", every).select(F.col("other").alias("image_id"), F.col("image_id").alias("other"), "distance")
        fold = lambda n: cases.select(F.col("image_id").alias(n), F.col("fold").alias(f"fold_{n}"))
        apart = near.join(fold("image_id"), "image_id").join(fold("other"), "other").where("fold_image_id <> fold_other")
        votes = neighbours_vote(apart.select("image_id", "other", "distance"), cases.select("image_id", "label")).join(cases, "image_id")
        by_fold = votes.groupBy("fold").agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("a")).agg(F.avg("a")).first()[0]
        found.append((f"bottleneck neighbours scaled={scaled}", float(by_fold or 0.0)))
        points.unpersist()
    cases.unpersist()
    best = max(m for _, m in found)
    return labels.sparkSession.createDataFrame([(n, m, m == best) for n, m in found], "candidate string, metric double, best boolean")


def query_pairs(rows: DataFrame, every: int = 20, block: int = 64) -> DataFrame:
    """Each row of the query set (image_id divisible by ``every``) beside each other row, whose columns are named other_...

    The query set is dealt into blocks, and a row meets each block once.
    """
    asked = rows.where(F.pmod("image_id", F.lit(every)) == 0)
    blocks = F.greatest(F.ceil(asked.agg(F.count("*")).scalar() / F.lit(block)), F.lit(1)).cast("long")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("image_id"), blocks))
    others = rows.select(*[F.col(c).alias(f"other_{c}") for c in rows.columns], F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    return asked.join(others, "block").where("image_id <> other_image_id").drop("block")


def neighbours_vote(distances: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """image_id, predicted: the commonest label among the ``k`` nearest others (ties to the nearer id, then the smaller label).

    ``distances`` has image_id, other, distance; ``labels`` image_id, label.
    """
    near = F.row_number().over(Window.partitionBy("image_id").orderBy("distance", "other"))
    votes = distances.where("image_id <> other").withColumn("place", near).where(F.col("place") <= k)
    counted = votes.join(labels.select(F.col("image_id").alias("other"), "label"), "other").groupBy("image_id", "label").agg(F.count("*").alias("n"))
    return counted.groupBy("image_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("predicted"))


def class_lists(rows: DataFrame, label: str, id_: str) -> DataFrame:
    """label, ids, n: each class's ids in order."""
    return rows.groupBy(label).agg(F.array_sort(F.collect_list(id_)).alias("ids"), F.count("*").alias("n"))


def indexed(rows: DataFrame, label: str) -> DataFrame:
    """Adds label_index: classes numbered in alphabetical order."""
    return StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc").fit(rows).transform(rows)


def assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(rows)
