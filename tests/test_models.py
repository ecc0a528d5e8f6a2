import threading

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import functions as F

from editlore.operators import neighbours
from editlore.operators.power import PowerTransform, fit_powers, yeo_johnson
from editlore.plans import classify, profile, search
from editlore.session import Scale

GRID = {"numTrees": [5, 8], "maxDepth": [3], "minInstancesPerNode": [1], "featureSubsetStrategy": ["sqrt"]}


def reference_transform(x, lam):
    out = np.empty_like(x)
    pos = x >= 0
    out[pos] = np.log1p(x[pos]) if abs(lam) < 1e-9 else ((x[pos] + 1) ** lam - 1) / lam
    out[~pos] = -np.log1p(-x[~pos]) if abs(lam - 2) < 1e-9 else -((1 - x[~pos]) ** (2 - lam) - 1) / (2 - lam)
    return out


@pytest.mark.parametrize("lam", [-1.5, 0.0, 0.5, 1.0, 2.0, 3.0])
def test_yeo_johnson(spark, lam):
    x = np.array([-3.0, -0.5, 0.0, 0.2, 7.0])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = [r[0] for r in df.select(yeo_johnson(F.col("x"), F.lit(lam))).collect()]
    assert np.allclose(got, reference_transform(x, lam))


def test_power_transform_finds_the_likeliest_power_and_saves(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = np.column_stack([np.exp(rng.normal(size=300)), rng.normal(size=300) ** 3, np.full(300, 2.0),
                            np.where(rng.random(300) < 0.3, 1e15, rng.random(300))])
    df = spark.createDataFrame([tuple(map(float, row)) for row in data], "a double, b double, c double, d double")
    model = Pipeline(stages=[PowerTransform(inputCols=list("abcd"), outputCols=["a2", "b2", "c2", "d2"])]).fit(df)

    def likelihood(x, lam):
        return -len(x) / 2 * np.log(reference_transform(x, lam).var()) + (lam - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))

    powers = model.stages[0].getOrDefault("lambdas")
    for i in (0, 1):
        best = max(likelihood(data[:, i], lam) for lam in np.linspace(-4, 4, 1601))
        assert likelihood(data[:, i], powers[i]) == pytest.approx(best, abs=0.05)
    assert powers[2] == 1.0
    model.write().overwrite().save(str(tmp_path / "m"))
    scaled = PipelineModel.load(str(tmp_path / "m")).transform(df)
    row = scaled.agg(*(F.avg(c).alias(f"m{c}") for c in ("a2", "b2", "d2")), *(F.stddev_pop(c).alias(f"s{c}") for c in ("a2", "b2", "d2"))).first()
    assert np.allclose([row.ma2, row.mb2, row.md2], 0, atol=1e-6) and np.allclose([row.sa2, row.sb2, row.sd2], 1, atol=1e-6)


@pytest.mark.parametrize("values, power", [
    ([], 1.0), ([None, float("nan")], 1.0), ([3.0] * 9, 1.0), ([0.0, 0.0, 1.0, None, float("inf"), float("nan")], None), ([-2.0, -2.0, 5.0, 1e15], None)])
def test_powers_of_odd_columns(spark, values, power):
    df = spark.createDataFrame([(v,) for v in values] * 3, "x double")
    found = fit_powers(df, ["x"])[0]
    kept = np.array([v for v in values if v is not None and np.isfinite(v)] * 3)
    assert found.rows == len(kept) and found.deviation > 0
    if power is not None:
        assert found.power == power and found.likelihood is None
        return

    def likelihood(lam):
        moved = reference_transform(kept, lam)
        return -np.log(moved.var()) / 2 + (lam - 1) * np.mean(np.sign(kept) * np.log1p(np.abs(kept)))

    assert found.likelihood == pytest.approx(max(likelihood(lam) for lam in np.arange(-1_250, 1_251) / 250), abs=1e-4)
    assert found.mean == pytest.approx(reference_transform(kept, found.power).mean())


def routed(spark, n=60):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        static = i % 3 != 0
        kind = ("static" if static else "irregular") if i < n - 10 else None
        feats = [float(rng.random() + (0 if static else 2)) if rng.random() > 0.1 else None for _ in profile.ROUTED_FEATURES]
        rows.append((i, f"thing {i}" + (" ID" if i % 5 == 1 else ""), kind, *feats))
    return spark.createDataFrame(rows, "property_id long, property_label string, property_type string, " + ", ".join(
        f"{c} double" for c in profile.ROUTED_FEATURES))


def test_static_classifier_and_inference(spark, tmp_path):
    df = routed(spark)
    fitted = classify.static_classifier(df, Scale(60), GRID, folds=2)
    model, tested, best = fitted.model, fitted.tested, fitted.best
    assert best["numTrees"] in (5, 8) and 0 <= best["score"] <= 1
    assert classify.roc_auc(tested, "is_static") > 0.7
    assert {r["class"] for r in classify.class_report(tested, "is_static").collect()} == {0, 1}
    model.write().overwrite().save(str(tmp_path / "static"))
    final = classify.infer_static(df, PipelineModel.load(str(tmp_path / "static"))).collect()
    assert len(final) == 60
    for r in final:
        if r.property_type:
            assert r.final_property_type == r.property_type and r.prediction_static is None
        elif " ID" in r.property_label:
            assert r.final_property_type == "static"
        else:
            assert r.prediction_static is not None
    importance = classify.feature_importance(fitted)
    assert importance.count() == len(profile.ROUTED_FEATURES)
    assert importance.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def points(spark, n=90, positive=None):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.normal() + 3 * (i % 3 == 0)), float(rng.normal()), int(i % 3 == 0) if positive is None else positive) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x double, y double, label int").withColumn("split", F.when(F.col("id") % 5 == 0, "test").otherwise("train"))


def searched(df, store=None, folds=3, grid=GRID):
    train, test = df.filter("split = 'train'"), df.filter("split = 'test'")
    return classify.fit_forest(train, test, "label", ["id"], (["x", "y"], [], []), grid, folds, store)


def test_search_scores_every_candidate_on_every_fold(spark):
    df = points(spark)
    found = searched(df)
    scores = found.scores.collect()
    assert [(r.candidate, r.fold) for r in scores] == [(c, f) for c in range(2) for f in range(3)]
    sizes = {r.fold: (r.n, r.p) for r in df.filter("split = 'train'").groupBy(search.fold(["id"]).alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).collect()}
    for r in scores:
        assert (r.num_rows, r.num_positive) == sizes[r.fold] and r.numTrees == GRID["numTrees"][r.candidate]
        assert r.f1 == pytest.approx(2 * r.num_hits / (r.num_predicted + r.num_positive))
    means = [np.mean([r.f1 for r in scores if r.candidate == c]) for c in range(2)]
    assert found.best["score"] == pytest.approx(max(means)) and found.best["numTrees"] == GRID["numTrees"][int(np.argmax(means))]
    assert found.best["score"] > 0.7
    # The same rows in another order and other partitions have the same folds and scores.
    again = searched(df.repartition(5).orderBy(F.desc("id"))).scores.collect()
    assert [(r.candidate, r.fold, r.num_rows, r.num_positive) for r in again] == [(r.candidate, r.fold, r.num_rows, r.num_positive) for r in scores]


def test_a_search_is_saved_and_loaded_by_its_content(spark, tmp_path, monkeypatch):
    df, store = points(spark), str(tmp_path / "models")
    first = searched(df, store)
    with monkeypatch.context() as patch:
        patch.setattr(search, "fold_scores", lambda *_: pytest.fail("searched again"))
        second = searched(df.repartition(3), store)
    assert second.best == first.best and second.scores.collect() == first.scores.collect()
    shown = lambda f: sorted((r.id, r.prediction) for r in f.tested.collect())
    assert shown(second) == shown(first)
    # Another row, another grid and a model without its scores are fitted anew.
    others = [searched(df.filter("id <> 1"), store), searched(df, store, grid=GRID | {"numTrees": [5]})]
    assert [f.scores.count() for f in others] == [6, 3] and len(list((tmp_path / "models").iterdir())) == 3


def test_forests_keep_the_place_of_rows_in_their_trees(spark):
    kept = search.forest("label", search.candidates(GRID)[0])
    assert kept.getCacheNodeIds()
    found = searched(points(spark))
    rows = found.tested.select("features", "label").withColumn("label", F.col("label").cast("double")).withColumn("weight", F.lit(1.0)).cache()
    plain = kept.copy().setCacheNodeIds(False).fit(rows)
    assert kept.fit(rows).toDebugString.split("\n", 1)[1] == plain.toDebugString.split("\n", 1)[1]


def test_candidates_fitted_at_the_same_time_have_their_own_job_properties(spark, monkeypatch):
    make, both, seen = search.forest, threading.Barrier(2, timeout=120), []

    def marked(label, chosen):
        name = str(chosen["numTrees"]) + str(threading.get_ident())
        spark.sparkContext.setLocalProperty("candidate", name)
        both.wait()  # two candidates are fitted at the same time
        seen.append(spark.sparkContext.getLocalProperty("candidate") == name)
        return make(label, chosen)

    monkeypatch.setattr(search, "forest", marked)
    rows = spark.createDataFrame([(Vectors.dense([float(i % 3), float(i)]), float(i % 3 == 0), 1.0, i % 2) for i in range(40)],
                                 ["features", "label", "weight", "fold"])
    assert len(search.fold_scores(rows, "label", GRID, folds=2, at_once=2)) == 4
    assert seen == [True] * 4


def test_search_without_a_class(spark):
    found = searched(points(spark, positive=0), folds=2)
    assert all((r.num_predicted, r.f1) == (0, 0.0) for r in found.scores.collect())
    assert {r.prediction for r in found.tested.collect()} == {0.0}


def test_training_rows_lie_in_few_partitions(spark, monkeypatch):
    monkeypatch.setattr(search, "TASK_ROWS", 30)
    rows = points(spark).repartition(7)
    assert [search.dealt(rows, n).rdd.getNumPartitions() for n in (0, 30, 31, 90, 900)] == [1, 1, 2, 3, 7]
    assert search.dealt(rows, 90).count() == 90
    dealt = []
    scored = search.fold_scores
    monkeypatch.setattr(search, "fold_scores", lambda rows, *more: dealt.append(rows.rdd.getNumPartitions()) or scored(rows, *more))
    searched(rows, folds=2)  # 72 of the 90 rows are for training
    assert dealt == [3]


def test_both_groups_are_fitted_on_features_stored_once(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(classify, "materialise", lambda df: stored.append(df) or df.cache())
    monkeypatch.setattr(classify, "fit_forest", lambda train, test, *_: (train.count(), test.count()))
    names = sorted({c for group in classify.GROUPS for kind in classify.features_for(group) for c in kind})
    features = spark.range(10).select(
        "id", F.when(F.col("id") == 9, "rank").otherwise("").alias("change_target"), *(F.lit("UPDATE" if c == "action" else "1").alias(c) for c in names),
        F.when(F.col("id") < 3, classify.GROUPS[0]).otherwise(classify.GROUPS[1]).alias("model_group"),
        F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"))
    assert classify.train_predictors(features) == {classify.GROUPS[0]: (2, 1), classify.GROUPS[1]: (3, 3)} and len(stored) == 1


def test_forests_get_dense_vectors_and_are_the_same(spark):
    train = spark.createDataFrame([("abcdefghij"[i % 10], float(i % 7), int(i % 4 == 0)) for i in range(80)], "c string, x double, label int")
    fitted = classify.preprocessing(["x"], ["c"], []).fit(train)
    rows = fitted.transform(train).withColumns({"label": F.col("label").cast("double"), "weight": F.lit(1.0)}).cache()
    assert {type(r.features) for r in rows.select("features").collect()} == {DenseVector}
    attributes = rows.schema["features"].metadata["ml_attr"]["attrs"]
    assert sorted(a["name"] for kind in attributes.values() for a in kind)[:2] == ["c_hot_a", "c_hot_b"]
    sparse = PipelineModel(stages=fitted.stages[:-1]).transform(train).withColumnRenamed("assembled", "features").withColumns(
        {"label": F.col("label").cast("double"), "weight": F.lit(1.0)}).cache()
    assert sparse.first().features.numNonzeros() < sparse.first().features.size / 2
    forest = search.forest("label", search.candidates(GRID)[0])
    shown = [forest.fit(df).toDebugString.split("\n", 1)[1] for df in (rows, sparse)]
    assert shown[0] == shown[1]


def test_fold_sizes_and_weights(spark):
    found = search.fold_sizes(points(spark), "label", [], ["id"]).collect()
    assert sum(r.num_rows for r in found) == 90
    assert {r["class"]: round(r.weight, 6) for r in found} == {1: 1.5, 0: 0.75}


def test_powers_of_both_groups_read_the_features_once(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(classify, "materialise", lambda df: stored.append(df) or df.cache())
    monkeypatch.setattr(classify, "chosen_powers", lambda df, names: spark.createDataFrame(
        [(name, df.count(), 1.0, None) for name in names], "feature string, num_rows bigint, power double, log_likelihood double"))
    names = {c for group in classify.GROUPS for kind in classify.features_for(group) for c in kind}
    features = spark.range(10).select(
        "id", F.lit("").alias("change_target"), *(F.lit("UPDATE" if c == "action" else "1").alias(c) for c in names),
        F.when(F.col("id") < 3, classify.GROUPS[0]).otherwise(classify.GROUPS[1]).alias("model_group"), F.lit("train").alias("split"))
    routed = spark.range(2).select(*(F.lit(1.0).alias(c) for c in profile.ROUTED_FEATURES))
    found = {r.model: r.num_rows for r in classify.powers_of_models(features, routed).select("model", "num_rows").distinct().collect()}
    assert found == {"properties": 2, classify.GROUPS[0]: 3, classify.GROUPS[1]: 7} and len(stored) == 1


def test_unknown_categories_become_zeros(spark):
    train = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 2.0), ("a", 1, 3.0)], "c string, f int, x double")
    fitted = classify.preprocessing(["x"], ["c"], ["f"]).fit(train)
    vector = fitted.transform(spark.createDataFrame([("new", 1, 2.0)], "c string, f int, x double")).first().features.toArray()
    assert list(vector[:3]) == [0.0, 0.0, 1.0]


def vectors(spark, n=90):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(n, 8))
    base[7] = base[4] * 3  # an exact tie by cosine
    return base, spark.createDataFrame(
        [(i, f"p{i}" + (" ID" if i % 9 == 0 else ""), f"about {i}", ["static", "regular", None][i % 3], [float(v) for v in base[i]]) for i in range(n)],
        "property_id long, property_label string, property_description string, property_type string, embedding array<double>")


@pytest.mark.parametrize("limit", [1_000, 5])
def test_neighbours_match_brute_force(spark, monkeypatch, limit):
    search = neighbours._block_search
    monkeypatch.setattr(neighbours, "_block_search", lambda queries, targets, k: search(queries, targets, k, block=7))
    matrix, df = vectors(spark)
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    found = neighbours.neighbours(df, 4, broadcast_vectors=limit)
    got = {}
    for r in found.orderBy("property_id", "rank").collect():
        got.setdefault(r.property_id, []).append(r.nn_property_id)
    known = [i for i in range(len(matrix)) if i % 3 != 2]
    for i in range(len(matrix)):
        want = sorted(known, key=lambda j: (-round(float(unit[i] @ unit[j]), 12), j))[:4]
        assert got[i] == want
    lists = neighbours.neighbour_lists(found).first()
    assert len(lists.nearest_property_ids) == 4
    nearest = neighbours.nearest_non_self(found)
    assert nearest.filter("property_id = nn_property_id").count() == 0 and nearest.count() == 90
    assert neighbours.nearest_non_self(found, hint_from=2.0).filter("nn_sim is not null").count() == 0


def test_known_bounds_leave_the_nearest_in_place():
    random = np.random.default_rng(3)
    vectors, queries = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (random.normal(size=(500, 8)), random.normal(size=(40, 8))))
    vectors[100:300] = vectors[0]  # many ties
    ids = np.arange(500)
    want = neighbours._top(np.arange(40), queries, ids, vectors, 4)
    kth = want.groupby("property_id")["similarity"].min().to_numpy()
    for floors in (kth, kth - 0.1, np.full(40, -2.0)):
        assert neighbours._top(np.arange(40), queries, ids, vectors, 4, floors).equals(want)


def test_accuracy_counts_every_grouping(spark):
    _, df = vectors(spark)
    nearest = neighbours.nearest_non_self(neighbours.neighbours(df))
    found = {(r.grouping, r.value): r for r in neighbours.neighbour_accuracy(df, nearest).collect()}
    studied = df.filter("property_type is not null and property_label not like '% ID%'").count()
    assert found["overall", "all"].num_properties == studied
    assert sum(r.num_properties for k, r in found.items() if k[0] == "property_type") == studied


def test_embedding_uses_the_callers_encoder(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "bb", "c")], "property_id long, property_label string, property_description string")

    def make_encoder():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    assert [r.embedding for r in neighbours.embed(df, make_encoder).orderBy("property_id").collect()] == [[3.0, 1.0], [5.0, 1.0]]
    assert [r.embedding[0] for r in neighbours.embed(df, make_encoder, only_label=True).orderBy("property_id").collect()] == [1.0, 2.0]


@pytest.mark.parametrize("case", ["clusters", "copies", "zeros", "few"])
def test_index_of_pivots_is_exact(spark, case):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(8, 6))[rng.integers(0, 8, 160)] + rng.normal(size=(160, 6)) * 0.05
    if case == "copies":
        base[:60] = base[0]  # one ring with far more vectors than a block
    if case == "zeros":
        base[:70] = 0.0
    if case == "few":
        base = base[:3]
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(base)]
    df = spark.createDataFrame([*rows, (1_000, None)], "property_id long, embedding array<double>")
    targets = df.filter("property_id % 2 = 0 and embedding is not null")
    found = neighbours._block_search(df, targets, 4, block=9).toPandas()
    want = neighbours._broadcast_search(df.filter("embedding is not null"), targets, 4).toPandas()
    for part in (found, want):
        part["similarity"] = part["similarity"].round(9)
    best = found.sort_values(["similarity", "nn_property_id"], ascending=[False, True]).groupby("property_id").head(4)
    key = ["property_id", "similarity", "nn_property_id"]
    assert not found.duplicated(["property_id", "nn_property_id"]).any()
    assert sorted(map(tuple, best[key].to_numpy())) == sorted(map(tuple, want[key].to_numpy()))
