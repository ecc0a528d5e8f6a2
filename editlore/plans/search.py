"""Search for the parameters of random forests over folds that a hash of each row's identity decides.

A row's fold never depends on where the row lies, so a search can be repeated, and SQL can count its folds. The result of a search is a table
with one row per candidate and fold; the driver sees those rows only. Rows are computed once, in shared storage, and candidates are fitted at the
same time by threads that share the executors, those with most levels of trees first; within each fit Spark ML spreads the rows.
"""

from __future__ import annotations

from collections import defaultdict
from functools import partial
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editlore.operators.sampling import hash_order
from editlore.plans.predictor import binary_metrics

FOLDS = 3
FOLD_SEED = 7  # not the seed of samples, whose cut by the same hash would leave uneven folds
SEED = 42
AT_ONCE = 8
LARGE_AT_ONCE = 3  # candidates that fill several tasks each
TASK_ROWS = 50_000  # of training; every task of a level sends statistics of all its nodes, so many small tasks send more than they save

NAMES = ["numTrees", "maxDepth", "minInstancesPerNode", "featureSubsetStrategy"]
SCORES = ("candidate int, numTrees int, maxDepth int, minInstancesPerNode int, featureSubsetStrategy string, fold int, "
          "num_rows bigint, num_positive bigint, num_predicted bigint, num_hits bigint, precision double, recall double, f1 double")


def fold(identity: list[str], folds: int = FOLDS) -> Column:
    """The fold of a row, from 0."""
    return (hash_order(*identity, seed=FOLD_SEED) % folds).cast("int")


def fold_sizes(train: DataFrame, label: str, by: list[str], identity: list[str], folds: int = FOLDS) -> DataFrame:
    """Rows of each class in each fold, and the weight a row of the class has in the fits of its group: rows / (classes * rows of the class)."""
    counted = train.groupBy(*by, F.col(label).alias("class"), fold(identity, folds).alias("fold")).agg(F.count(F.lit(1)).alias("num_rows"))
    # From here on there is a row per group, class and fold.
    group, of_class = Window.partitionBy(*by), Window.partitionBy(*by, "class")
    classes = F.size(F.collect_set("class").over(group))
    return counted.withColumn("weight", F.sum("num_rows").over(group) / (classes * F.sum("num_rows").over(of_class)))


def candidates(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, chosen)) for chosen in product(*grid.values())]


def forest(label: str, chosen: dict) -> RandomForestClassifier:
    """Each row's place in every tree is kept from level to level, which gives the same forest; otherwise each level walks all trees from their roots."""
    return RandomForestClassifier(labelCol=label, featuresCol="features", weightCol="weight", seed=SEED, cacheNodeIds=True, checkpointInterval=-1, **chosen)


def dealt(rows: DataFrame, num_rows: int) -> DataFrame:
    """``rows`` in no more partitions than ``TASK_ROWS`` in each take, as far as neighbouring ones can be put together."""
    return rows.coalesce(max(1, -(-num_rows // TASK_ROWS)))


def fold_scores(rows: DataFrame, label: str, grid: dict[str, list], folds: int = FOLDS, at_once: int | None = None) -> list[tuple]:
    """Rows of ``SCORES``: each candidate fitted without a fold and scored on it, by the measures of class 1.

    ``rows`` has columns features, weight, fold and ``label`` and is stored. Few rows leave executors idle unless many candidates are fitted at
    once; with many rows candidates at once only take memory and caches from one another. A fold scores 0 where it has no rows, and where the others have none
    of class 1 to learn from.
    """
    sizes = {(row["fold"], row[label]): row["n"] for row in rows.groupBy("fold", label).agg(F.count(F.lit(1)).alias("n")).collect()}

    def scored(job) -> tuple:
        left_out, (number, chosen) = job
        values = (number, *(chosen[name] for name in NAMES), left_out)
        true, false = sizes.get((left_out, 1.0), 0), sizes.get((left_out, 0.0), 0)
        if true + false == 0 or not any(value == 1 for part, value in sizes if part != left_out):
            return (*values, true + false, true, 0, 0, 0.0, 0.0, 0.0)
        predicted = forest(label, chosen).fit(rows.filter(F.col("fold") != left_out)).transform(rows.filter(F.col("fold") == left_out))
        return (*values, *binary_metrics(predicted, label, "prediction", []).first())

    jobs = sorted(product(range(folds), enumerate(candidates(grid))), key=lambda job: -job[1][1]["numTrees"] * job[1][1]["maxDepth"])
    # The properties of a thread's Spark jobs are copied when its function is wrapped: one wrapped function would give all threads the same ones.
    fits = [inheritable_thread_target(rows.sparkSession)(partial(scored, job)) for job in jobs]
    pool = ThreadPool(min(at_once or (AT_ONCE if sum(sizes.values()) <= TASK_ROWS else LARGE_AT_ONCE), len(jobs)))
    try:
        return sorted(pool.imap_unordered(lambda fit: fit(), fits))
    finally:
        pool.close()


def best(scores: list[tuple]) -> tuple[int, float]:
    """The candidate with the highest mean F1 over its folds, the first among equals, and that mean."""
    of: dict[int, list[float]] = defaultdict(list)
    for row in scores:
        of[row[0]].append(row[-1])
    means = {k: sum(f1) / len(f1) for k, f1 in of.items()}
    return min(means.items(), key=lambda found: (-found[1], found[0]))
