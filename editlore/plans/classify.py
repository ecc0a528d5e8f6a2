"""Random-forest models: rejected changes per user group, and static properties."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editlore.operators.dense import DenseVectors
from editlore.operators.power import PowerTransform, fit_powers
from editlore.operators.sampling import keep_share, stratified_split
from editlore.plans import search
from editlore.plans.predictor import GROUPS, binary_metrics, features_for, model_rows
from editlore.plans.profile import ROUTED_FEATURES
from editlore.session import Scale, materialise
from editlore.sources.files import exists
from editlore.vocabulary import NEVER_CHANGES

CHANGE = ["revision_id", "entity_id", "property_id", "value_id", "change_target"]  # what tells changes apart

# Searched values. The library has no minimum number of samples for a split, so that part of the search is left out.
CHANGE_GRID = {"numTrees": [100, 200], "maxDepth": [5, 10], "minInstancesPerNode": [1, 2],
               "featureSubsetStrategy": ["sqrt", "log2"]}
PROPERTY_GRID = CHANGE_GRID | {"numTrees": [100, 200, 300]}


def preprocessing(numerical: list[str], categorical: list[str], binary: list[str]) -> Pipeline:
    """One-hot categories (unknown ones become all zeros), binary columns as they are, power-transformed numbers."""
    indexed, encoded = [f"{c}_index" for c in categorical], [f"{c}_hot" for c in categorical]
    scaled = [f"{c}_scaled" for c in numerical]
    stages = []
    if categorical:
        stages += [StringIndexer(inputCols=categorical, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True)]
    stages += [PowerTransform(inputCols=numerical, outputCols=scaled),
               VectorAssembler(inputCols=encoded + binary + scaled, outputCol="assembled"),
               DenseVectors(inputCol="assembled", outputCol="features")]
    return Pipeline(stages=stages)


def encoded_categories(features: DataFrame, group: str) -> DataFrame:
    """Place of each category among the training rows' categories, in alphabetical order; unknown ones come last."""
    numerical, categorical, binary = features_for(group)
    rows = materialise(model_input(model_rows(features.filter(F.col("model_group") == group)), numerical, categorical, binary).select(
        *CHANGE, "split", *categorical))
    indexer = preprocessing(numerical, categorical, binary).getStages()[0]
    indexed = indexer.fit(rows.filter("split = 'train'")).transform(rows)
    return indexed.withColumns({f"{c}_index": F.col(f"{c}_index").cast("int") for c in categorical})


def preprocessed_changes(features: DataFrame, group: str) -> DataFrame:
    """Model rows of one user group with their one-hot categories and scaled numbers, fitted on the training rows."""
    numerical, categorical, binary = features_for(group)
    rows = materialise(model_input(model_rows(features.filter(F.col("model_group") == group)), numerical, categorical, binary))
    shown = preprocessing(numerical, categorical, binary).fit(rows.filter("split = 'train'")).transform(rows)
    return shown.withColumns({f"{c}_hot": vector_to_array(f"{c}_hot").cast("array<int>") for c in categorical})


def preprocessed_properties(routed: DataFrame) -> DataFrame:
    """Properties with scaled features, fitted on all of them."""
    rows = materialise(imputed(routed))
    return preprocessing(ROUTED_FEATURES, [], []).fit(rows).transform(rows)


def chosen_powers(df: DataFrame, names: list[str]) -> DataFrame:
    """The power of each numerical column, and the logarithm of its likelihood per row (NULL without spread)."""
    fitted = [(name, f.rows, f.power, f.likelihood) for name, f in zip(names, fit_powers(df, names))]
    return df.sparkSession.createDataFrame(fitted, "feature string, num_rows bigint, power double, log_likelihood double")


def powers_of_models(features: DataFrame, routed: DataFrame) -> DataFrame:
    """``chosen_powers`` of the training rows of both user groups and of the properties."""
    found = chosen_powers(imputed(routed), ROUTED_FEATURES).withColumn("model", F.lit("properties"))
    kinds = {group: features_for(group) for group in GROUPS}
    train = materialise(model_rows(features.filter(F.col("split") == "train")).select("model_group", *sorted({c for kind in kinds.values() for c in sum(kind, [])})))
    for group, (numerical, categorical, binary) in kinds.items():
        rows = model_input(train.filter(F.col("model_group") == group), numerical, categorical, binary)
        found = found.unionByName(chosen_powers(rows, numerical).withColumn("model", F.lit(group)))
    return found


def model_input(df: DataFrame, numerical: list[str], categorical: list[str], binary: list[str]) -> DataFrame:
    """Missing numbers become 0, missing categories a category of their own."""
    return df.fillna(0, numerical + binary).fillna("0", categorical)


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Add ``weight``: rows / (classes * rows of the class). Only the class counts reach the driver."""
    counts = {row[label]: row["n"] for row in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, F.lit(total / (len(counts) * n))).otherwise(weight)
    return df.withColumn("weight", weight)


@dataclass
class Fitted:
    """A searched pipeline, its test rows with predictions, and the score of each candidate in each fold (``search.SCORES``)."""

    model: PipelineModel
    tested: DataFrame
    scores: DataFrame
    best: dict


def save(fitted: Fitted, path: str) -> None:
    """Write the pipeline and then its scores below ``path``; a folder without complete scores is no saved model."""
    fitted.model.write().overwrite().save(f"{path}/model")
    fitted.scores.coalesce(1).write.mode("overwrite").parquet(f"{path}/scores")


def load(spark: SparkSession, path: str, test: DataFrame) -> Fitted:
    """What ``save`` wrote, applied to ``test``."""
    scores = sorted(tuple(row) for row in spark.read.parquet(f"{path}/scores").collect())  # a row per candidate and fold
    number, f1 = search.best(scores)
    chosen = next(dict(zip(search.NAMES, row[1:])) for row in scores if row[0] == number)
    model = PipelineModel.load(f"{path}/model")
    return Fitted(model, model.transform(test), spark.createDataFrame(scores, search.SCORES), chosen | {"score": f1})


def _content(train: DataFrame, columns: list[str], *more) -> str:
    """A name for what a search learns from: the rows in any order, and its settings."""
    rows = train.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    return hashlib.md5(repr((tuple(rows), columns, more)).encode()).hexdigest()


def fit_forest(train: DataFrame, test: DataFrame, label: str, identity: list[str], kinds: tuple[list[str], list[str], list[str]],
               grid: dict[str, list], folds: int = search.FOLDS, store: str | None = None) -> Fitted:
    """Fit preprocessing of the numerical, categorical and binary columns, search the grid on its result, and join the forest of the best
    candidate, fitted on all rows, to it.

    With a folder ``store`` a search is saved there under its content, and a later one for the same rows and settings is loaded instead.
    """
    spark = train.sparkSession
    path = None
    if store:
        path = f"{store}/{_content(train, sorted({*sum(kinds, []), label, *identity}), label, identity, kinds, grid, folds)}"
        if exists(spark, f"{path}/scores/_SUCCESS"):
            return load(spark, path, test)
    prepared = preprocessing(*kinds).fit(train)
    weighted = balanced_weights(prepared.transform(train).withColumn(label, F.col(label).cast("double")), label)
    rows = materialise(search.dealt(weighted.select("features", label, "weight", search.fold(identity, folds).alias("fold")), train.count()))
    scores = search.fold_scores(rows, label, grid, folds)
    number, f1 = search.best(scores)
    chosen = search.candidates(grid)[number]
    model = PipelineModel(stages=[*prepared.stages, search.forest(label, chosen).fit(rows)])
    fitted = Fitted(model, model.transform(test), spark.createDataFrame(scores, search.SCORES), chosen | {"score": f1})
    if path:
        save(fitted, path)
    return fitted


def group_rows(features: DataFrame, group: str) -> DataFrame:
    """Model rows of one user group, without missing values."""
    return model_input(model_rows(features.filter(F.col("model_group") == group)), *features_for(group))


def train_predictor(features: DataFrame, group: str, grid: dict[str, list] = CHANGE_GRID, folds: int = search.FOLDS,
                    store: str | None = None) -> Fitted:
    """The rejection model of one user group, fitted before the time split and applied to the changes after it. ``features`` are stored."""
    rows = group_rows(features, group)
    return fit_forest(rows.filter("split = 'train'"), rows.filter("split = 'test'"), "target_to_predict", CHANGE,
                      features_for(group), grid, folds, store)


def train_predictors(features: DataFrame, grid: dict[str, list] = CHANGE_GRID, folds: int = search.FOLDS, store: str | None = None
                     ) -> dict[str, Fitted]:
    """The models of both user groups; the features are computed once for them."""
    rows = materialise(model_rows(features))
    return {group: train_predictor(rows, group, grid, folds, store) for group in GROUPS}


def change_folds(features: DataFrame, folds: int = search.FOLDS) -> DataFrame:
    """Rows and weights of the folds of both user groups' searches."""
    train = model_rows(features).filter("split = 'train'")
    return search.fold_sizes(train, "target_to_predict", ["model_group"], CHANGE, folds)


def by_group(parts: dict[str, DataFrame]) -> DataFrame:
    """Tables of user groups as one, with ``model_group``."""
    return reduce(DataFrame.unionByName, (part.withColumn("model_group", F.lit(group)) for group, part in parts.items()))


def rejection_metrics(fitted: dict[str, Fitted]) -> DataFrame:
    """Test precision, recall and F1 of each user group's model."""
    return by_group({group: binary_metrics(f.tested, "target_to_predict", "prediction", []) for group, f in fitted.items()})


def feature_importance(fitted: Fitted) -> DataFrame:
    """(feature, importance) for every slot of the feature vector, named by the vector's metadata."""
    slots = fitted.tested.schema["features"].metadata["ml_attr"]["attrs"]
    names = sorted((a["idx"], a["name"]) for kind in slots.values() for a in kind)
    importances = fitted.model.stages[-1].featureImportances.toArray()
    spark = fitted.tested.sparkSession
    return spark.createDataFrame([(name, float(importances[i])) for i, name in names], "feature string, importance double")


def roc_auc(predicted: DataFrame, label: str) -> float:
    return BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC").evaluate(predicted)


def class_report(predicted: DataFrame, label: str) -> DataFrame:
    """Precision, recall and F1 of either class."""
    both = predicted.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("class"), label, "prediction")
    as_one = both.select("class", (F.col(label) == F.col("class")).cast("int").alias(label),
                         (F.col("prediction") == F.col("class")).cast("int").alias("prediction"))
    return binary_metrics(as_one, label, "prediction", ["class"])


def with_final_type(df: DataFrame) -> DataFrame:
    """The known type; identifiers without one count as static."""
    known = F.nullif(F.col("property_type"), F.lit(""))
    return df.withColumn("final_property_type", F.coalesce(
        known, F.when(F.col("property_label").contains(" ID"), "static")))


def labelled_properties(routed: DataFrame, scale: Scale) -> DataFrame:
    """Properties of known type as static or not.

    Four fifths of the static properties are identifiers, so only 60 % of those are kept.
    """
    kind = F.nullif(F.col("property_type"), F.lit(""))
    labelled = imputed(routed.filter(kind.isNotNull()).withColumn("is_static", (kind == "static").cast("int")))
    static_id = (F.col("is_static") == 1) & F.col("property_label").contains(" ID")
    return keep_share(labelled, static_id, 0.6, ["property_id"], scale)


def property_folds(routed: DataFrame, scale: Scale, folds: int = search.FOLDS) -> DataFrame:
    """Rows and weights of the folds of the static classifier's search."""
    train, _ = stratified_split(labelled_properties(routed, scale), "is_static", ["property_id"], scale)
    return search.fold_sizes(train, "is_static", [], ["property_id"], folds)


def static_classifier(routed: DataFrame, scale: Scale, grid: dict[str, list] = PROPERTY_GRID, folds: int = search.FOLDS,
                      store: str | None = None) -> Fitted:
    """Static against non-static properties."""
    train, test = stratified_split(materialise(labelled_properties(routed, scale)), "is_static", ["property_id"], scale)
    fitted = fit_forest(train, test, "is_static", ["property_id"], (ROUTED_FEATURES, [], []), grid, folds, store)
    fitted.tested = _with_probability(fitted.tested)
    return fitted


def imputed(df: DataFrame) -> DataFrame:
    """A property without updates never changes: its missing times are very long ones."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(NEVER_CHANGES))
                           for c in ROUTED_FEATURES})


def _with_probability(df: DataFrame) -> DataFrame:
    return df.withColumn("pred_proba", vector_to_array("probability")[1])


def infer_static(routed: DataFrame, model: PipelineModel) -> DataFrame:
    """Final type of every property: known, an identifier, or predicted static; others stay open."""
    typed = with_final_type(routed)
    predicted = _with_probability(model.transform(imputed(typed.filter(F.col("final_property_type").isNull())))).select(
        "property_id", F.col("prediction").alias("prediction_static"), "pred_proba")
    joined = typed.join(predicted, "property_id", "left")
    return joined.withColumn("final_property_type", F.coalesce(
        "final_property_type", F.when(F.col("prediction_static") == 1.0, "static")))
