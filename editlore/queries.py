"""Named analyses over a folder of tables: what can be run, from the change log to trained models."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editlore.functions.columns import empty_object_to_null, flag, rounded
from editlore.operators import intervals, neighbours, ranking, sampling
from editlore.operators.ordered import placed
from editlore.operators.text_vectors import text_vectors
from editlore.plans import (
    catalogue, classify, frequency, graph, history, predictor, profile, prompts, quality, samples, users,
)
from editlore.session import materialise, model_folder, new_folder, shared, small_side
from editlore.sources import files
from editlore.sources.changelog import Tables
from editlore.sources.files import active_entities, sparql_bindings


class Analyses(Tables):
    """Shared steps of the registered queries, built lazily and once."""

    @cached_property
    def properties(self) -> DataFrame:
        return catalogue.properties(self.log.property_labels, self.log.property_metadata)

    def dimension(self, name: str) -> DataFrame:
        """A view that is joined to changes by property."""
        return small_side(self.view(name))

    @cached_property
    def property_dimension(self) -> DataFrame:
        return small_side(self.properties)

    @cached_property
    def to_classify(self) -> DataFrame:
        return catalogue.properties_to_classify(self.properties)

    @cached_property
    def small(self) -> DataFrame:
        return profile.small_table(self.log.value_change, self.log.revision)

    @cached_property
    def stats(self) -> DataFrame:
        small = placed(shared(self.small, self.scale), profile.PAIR, self.scale)
        return profile.entity_property_stats(
            self.property_dimension, profile.distinct_value_profile(self.log.value_change, self.log.revision),
            profile.average_value_activity(profile.value_activity(small, self.scale)),
            profile.overall_activity(small, self.scale))

    @cached_property
    def property_features(self) -> DataFrame:
        return profile.property_features(self.stats, self.log.entity_stats, self.scale)

    @cached_property
    def routed(self) -> DataFrame:
        return profile.routed_features(
            self.property_features, profile.updates_as_creates(self.small, self.log.qualifier_change))

    @cached_property
    def ranks(self) -> DataFrame:
        return intervals.rank_intervals(self.log.value_change, self.scale)

    @cached_property
    def references(self) -> DataFrame:
        return intervals.reference_intervals(self.log.reference_change, self.scale)

    @cached_property
    def qualifiers(self) -> DataFrame:
        return intervals.qualifier_intervals(self.log.qualifier_change, self.scale)

    @cached_property
    def model(self) -> DataFrame:
        return shared(users.user_model(self.log.value_change, self.log.revision), self.scale)

    @cached_property
    def first_edits(self) -> DataFrame:
        return shared(users.first_edits(self.log.value_change, self.log.revision), self.scale)

    @cached_property
    def user_property(self) -> DataFrame:
        return users.user_property(self.log.value_change, self.log.revision, self.model)

    @cached_property
    def full_model(self) -> DataFrame:
        return users.full_user_model(
            self.model, users.expertise(self.user_property, self.property_dimension), users.top_entities(self.log.revision))

    @cached_property
    def edited_values(self) -> DataFrame:
        """Value changes with their editor and comment: the input of the change features."""
        editors = self.log.revision.select("revision_id", "user_id", "username", "user_type", "comment")
        edited = self.log.value_change.filter("change_target = ''").join(editors, "revision_id")
        values = {c: empty_object_to_null(F.col(c)) for c in ("old_value", "new_value")}
        return history.with_replaced_values(edited, self.scale).withColumns(values)

    @cached_property
    def feature_table(self) -> DataFrame:
        return history.feature_table(
            self.edited_values, self.log.reference_change, self.full_model, self.dimension("prop_ref_rate"), self.scale)

    @cached_property
    def change_sample(self) -> DataFrame:
        return predictor.change_sample(self.log.value_change, self.log.revision, self.log.entity_stats, self.property_dimension,
                                       self.first_edits, self.scale)

    @cached_property
    def predictor_features(self) -> DataFrame:
        return predictor.predictor_features(self.change_sample, self.scale)

    @cached_property
    def labelled(self) -> DataFrame:
        return predictor.with_target(predictor.with_groups(self.predictor_features), self.scale)

    def typed_pairs(self, kind: str) -> DataFrame:
        """(entity, property) pairs of the properties of one type."""
        of_kind = self.property_dimension.filter(F.col("property_type") == kind).select("property_id")
        return self.log.value_change.select("entity_id", "property_id").distinct().join(of_kind, "property_id", "left_semi")

    @cached_property
    def static_changes(self) -> DataFrame:
        pairs = sampling.limited_pairs(self.typed_pairs("static"), None)
        return samples.sampled_changes(pairs, history.with_replaced_values(self.log.value_change, self.scale), self.log.entity_stats, self.log.revision)

    @cached_property
    def predictors(self) -> dict[str, classify.Fitted]:
        return classify.train_predictors(self.labelled, store=model_folder(self.spark))

    @cached_property
    def triples(self) -> DataFrame:
        return self.view("triples")

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.view("property_embeddings")

    @cached_property
    def neighbours(self) -> DataFrame:
        return neighbours.neighbours(self.embeddings)


STATEMENT = ["entity_id", "property_id", "value_id"]
TARGET_COLUMNS = ["revision_id", *STATEMENT, "change_target", "model_group", "split", "is_deleted", "target_to_predict"]


def _validated(a: Analyses) -> DataFrame:
    """The test set with the verdict of a rule that does not know the target: an anonymous edit, or one that came within a day of the one before."""
    tested = shared(a.labelled.filter("split = 'test'"), a.scale)
    soon = F.col("time_to_previous_edit_days") < 1
    predicted = predictor.model_rows(tested).withColumn("prediction", flag((F.col("user_type") == "anonymous") | soon))
    return predictor.prediction_validation(tested, predicted)


def _ranked(a: Analyses) -> DataFrame:
    """Model rows of both splits, scored by a rule that does not know the target: the sooner an edit follows the one before, the higher."""
    scored = predictor.model_rows(a.labelled).withColumn("soon", -F.col("time_to_previous_edit_days"))
    return ranking.cumulated(scored, "soon", "target_to_predict", ["model_group", "split"])


def _preprocessed(a: Analyses, group: str) -> DataFrame:
    numerical, categorical, binary = predictor.features_for(group)
    return classify.preprocessed_changes(a.labelled, group).select(
        "revision_id", *STATEMENT, "split", *(f"{c}_hot" for c in categorical), *binary, *(f"{c}_scaled" for c in numerical))


def _inference(a: Analyses) -> DataFrame:
    return classify.infer_static(a.routed, classify.static_classifier(a.routed, a.scale, store=model_folder(a.spark)).model).select(
        "property_id", "property_label", "property_type", "final_property_type", "prediction_static", "pred_proba")


def _link_results(a: Analyses) -> DataFrame:
    """sameAs links as SPARQL JSON documents, read back into rows."""
    links = graph.edges(a.triples, "owl:sameAs", "dbpedia", "wikidata")
    binding = F.to_json(F.struct(*(F.struct(F.col(v).alias("value")).alias(v) for v in ("dbpedia", "wikidata"))))
    documents = links.select(F.format_string('{"results":{"bindings":[%s]}}', binding).alias("json"))
    return sparql_bindings(documents, "json", ["dbpedia", "wikidata"])


def _csv_round_trip(a: Analyses) -> DataFrame:
    """Value and rank changes written as CSV and read back."""
    path = new_folder(a.spark) + "/changes"
    columns = files.column_names(files.CHANGE_SCHEMA)
    files.write_csv(history.with_replaced_values(a.log.value_change, a.scale).select(*columns), path)
    return files.read_csv(a.spark, path, files.CHANGE_SCHEMA)


def _result_round_trip(a: Analyses) -> DataFrame:
    """Predictor rows with their target, written by group and split and read back as one table."""
    path = new_folder(a.spark) + "/labelled"
    files.write_result(a.labelled.select(*TARGET_COLUMNS), path, by=["model_group", "split"])
    return a.spark.read.parquet(path).select(*TARGET_COLUMNS)


def _appended_entities(a: Analyses) -> DataFrame:
    """Entities appended in batches: the active ones by a first job, all of them by a second one that finds some there."""
    path = new_folder(a.spark) + "/entities"
    files.append_missing(active_entities(a.log.entity_stats), path, "entity_id", batches=2)
    files.append_missing(a.log.entity_stats, path, "entity_id", batches=4)
    return a.spark.read.parquet(path).select("entity_id", "num_value_changes")


def _text_embeddings(a: Analyses) -> DataFrame:
    """Properties with vectors of their texts."""
    vectors = text_vectors(a.embeddings, "property_id", neighbours.property_text())
    return a.embeddings.drop("embedding").join(vectors, "property_id")


def _property_prompts(a: Analyses) -> DataFrame:
    nearest = neighbours.nearest_non_self(a.neighbours, hint_from=0.75)
    return prompts.property_prompts(a.routed, nearest, a.properties)


def _update_scorer():
    """Properties whose values were never updated are static, those whose values hold for a time regular."""
    def kind(text: str) -> str:
        shown = text.rsplit("Reply with JSON", 1)[1]
        return "static" if "on average: never updated" in shown else "regular" if "hold" in shown else "irregular"

    return lambda texts: ['{"property_type": "%s"}' % kind(text) for text in texts]


def _property_accuracy(a: Analyses) -> DataFrame:
    replied = prompts.classify_properties(_property_prompts(a), _update_scorer)
    return prompts.classification_accuracy(replied, "property_type", "property_type_predicted")


def _section_scorer():
    """Insertions score high, edits without a comment low; the explanation counts the lines that were read. Comments of one tool cannot be read."""
    def answer(text: str) -> str:
        shown = text[text.index("\nEDIT\n"):]
        if '"comment":"/* wbsetclaim' in shown:
            raise ValueError("unreadable comment")
        score = 5 if '"action":"CREATE"' in shown else 2 if '"comment":""' in shown else 4
        return '{"score": %d, "explanation": "%d lines"}' % (score, shown.count("\n"))

    return lambda texts: [answer(text) for text in texts]


def _change_scores(a: Analyses) -> DataFrame:
    """Both dimensions and all settings for every change that can be judged."""
    judged = prompts.judged_changes(a.feature_table, None)
    for dimension in ("accuracy", "needs_reference"):
        judged = prompts.score_changes(judged, _section_scorer, dimension)
    return judged.select("revision_id", *(f"{d}_{part}_{s}" for d in ("accuracy", "needs_reference") for s in prompts.SETTINGS for part in ("score", "explanation", "error")))


ANALYSES: dict[str, Callable[[Analyses], DataFrame]] = {
    "change_log": lambda a: history.with_replaced_values(a.log.value_change, a.scale),
    "small_table": lambda a: a.small,
    "entity_prop_overall_activity": lambda a: profile.overall_activity(a.small, a.scale),
    "entity_prop_distinct_val_change": lambda a: profile.distinct_value_profile(a.log.value_change, a.log.revision),
    "value_activity": lambda a: profile.value_activity(a.small, a.scale),
    "entity_prop_avg_activity_of_values": lambda a: profile.average_value_activity(profile.value_activity(placed(a.small, profile.PAIR, a.scale), a.scale)),
    "entity_property_stats": lambda a: a.stats,
    "property_features": lambda a: a.property_features,
    "updates_as_creates": lambda a: profile.updates_as_creates(a.small, a.log.qualifier_change),
    "routed_features": lambda a: a.routed.select("property_id", "updates_as_creates_50", *profile.ROUTED_FEATURES),
    "rank_intervals": lambda a: a.ranks,
    "qualifier_intervals": lambda a: a.qualifiers,
    "reference_intervals": lambda a: a.references,
    "current_rank": lambda a: intervals.current_rank(a.log.value_change, a.ranks, small_side(a.to_classify), a.scale).select(
        "revision_id", *STATEMENT, "change_target", "current_rank"),
    "has_reference": lambda a: intervals.in_interval(a.log.value_change, a.references, "has_reference", a.scale).select(
        "revision_id", *STATEMENT, "change_target", "has_reference"),
    "deprecated_source_flag": lambda a: intervals.in_interval(
        a.log.value_change, intervals.unreliable_source_intervals(a.qualifiers),
        "reason_for_deprecated_rank_source_known_to_be_unreliable", a.scale).select(
        "revision_id", *STATEMENT, "change_target", "reason_for_deprecated_rank_source_known_to_be_unreliable"),
    "annotated_changes": lambda a: quality.annotated_changes(
        a.log.value_change, a.ranks, a.references, a.qualifiers, small_side(a.to_classify), a.dimension("range_constraint"),
        a.dimension("integer_constraint"), a.scale).select(
        "revision_id", *STATEMENT, "change_target", "current_rank", "has_reference",
        "reason_for_deprecated_rank_source_known_to_be_unreliable", "violates_range_constraint", "violates_integer_constraint"),
    "violates_range": lambda a: quality.with_range_violations(a.log.value_change, a.dimension("range_constraint")).select(
        "revision_id", "property_id", "new_value", "new_datatype", "violates_range_constraint"),
    "violates_integer": lambda a: quality.with_integer_violations(a.log.value_change, a.dimension("integer_constraint")).select(
        "revision_id", "property_id", "new_value", "new_datatype", "violates_integer_constraint"),
    "update_comments": lambda a: quality.update_comments(a.log.value_change, a.log.revision),
    "comment_keywords": lambda a: quality.repair_comments(quality.update_comments(a.log.value_change, a.log.revision)),
    "property_catalogue": lambda a: a.properties,
    "properties_to_classify": lambda a: a.to_classify,
    "label_counts": lambda a: catalogue.label_counts(a.properties),
    "non_id_static_properties": lambda a: catalogue.non_id_static_properties(a.properties, None),
    "first_non_id_static_properties": lambda a: catalogue.non_id_static_properties(a.properties, 30),
    "user_model": lambda a: a.model,
    "user_property": lambda a: a.user_property,
    "user_expertise": lambda a: users.expertise(a.user_property, a.property_dimension),
    "user_top_entities": lambda a: users.top_entities(a.log.revision),
    "full_user_model": lambda a: a.full_model,
    "change_types_multihot": lambda a: history.with_change_types(a.log.value_change).select(
        "revision_id", "labels_list", *history.CHANGE_TYPES),
    "single_change_features": lambda a: history.single_change_features(
        a.edited_values, a.full_model, a.dimension("prop_ref_rate"), a.scale).select(
        "revision_id", "user_type", "time_of_day", "time_of_week", "is_reverted", "type_of_next_edit", "reversion",
        "comment_has_keyword", "user_is_expert", "citation_needed", "property_reference_rate", "user_age_days_user",
        "num_value_changes_user", "avg_entities_per_day_user"),
    "running_history": lambda a: history.running_history(history.with_change_types(a.edited_values), a.scale).select(
        "revision_id", *STATEMENT, "num_reverted_edits_up_to_t", "num_non_reverted_edits_up_to_t", "total_changes_up_to_t",
        "ratio_reverted_edits_up_to_t", "ratio_non_reverted_edits_up_to_t", "time_since_last_edit_days",
        "time_to_next_edit_days", "value_age_in_entity_in_days_up_to_t", "type_of_next_edit", "num_edits_human",
        "num_edits_bot", "num_edits_anonymous", "is_wd_value_change", "num_changes_wd_values", "num_value_reoccurrences",
        "num_unique_registered_users", *(f"num_{t}" for t in history.CHANGE_TYPES)),
    "reference_counts_asof": lambda a: history.with_reference_counts(
        a.log.value_change, a.log.reference_change, a.scale).select(
        "revision_id", *STATEMENT, "change_target", "num_wikipedia_refs_up_to_t", "num_non_wikipedia_refs_up_to_t",
        "num_references_up_to_t", "ratio_wikipedia_refs_up_to_t", "ratio_non_wikipedia_refs_up_to_t"),
    "expected_datatype": lambda a: history.expected_datatypes(a.log.value_change),
    "feature_table": lambda a: a.feature_table,
    "predictor_features": lambda a: a.predictor_features.select(
        "revision_id", *STATEMENT, "change_target", "user_age_days", "time_to_first_edit_of_entity_in_days_at_t",
        *predictor.NUMERICAL, *predictor.CATEGORICAL, *predictor.BINARY),
    "target_label": lambda a: a.labelled.select(*TARGET_COLUMNS),
    "target_label_all_rows": lambda a: predictor.with_target(
        predictor.with_groups(a.predictor_features), a.scale, keep_all=True).select(*TARGET_COLUMNS),
    "clean_edits_before_t": lambda a: predictor.predictor_features(a.change_sample, a.scale, before_t=True).select(
        "revision_id", *STATEMENT, "change_target", "num_non_reverted_edits_before_t"),
    "target_distribution": lambda a: predictor.target_distribution(a.labelled),
    "baseline_anonymous": lambda a: predictor.baseline_anonymous(predictor.model_rows(a.labelled)),
    "prediction_validation": lambda a: _validated(a).select(*TARGET_COLUMNS, "prediction"),
    "ranking_metrics": lambda a: ranking.roc_auc(_ranked(a), ["model_group", "split"]),
    "roc_curve": lambda a: ranking.roc_curve(_ranked(a)).select("model_group", "split", "positives", "negatives", "true_positive_rate", "false_positive_rate"),
    "class_report": lambda a: classify.class_report(predictor.model_rows(_validated(a)), "target_to_predict"),
    "rejected_values": lambda a: predictor.rejected_values(_validated(a), None),
    "first_rejected_values": lambda a: predictor.rejected_values(_validated(a), 50),
    "profile_counts": lambda a: predictor.profile_counts(a.predictor_features),
    "values_per_property": lambda a: predictor.average_values_per_property(a.log.value_change),
    "update_frequency_by_type": lambda a: frequency.update_frequency_by_type(
        frequency.real_updates(a.log.value_change, None), a.log.entity_stats, a.scale),
    "representative_values": lambda a: frequency.representative_values(frequency.real_updates(a.log.value_change, None)),
    "active_entities": lambda a: active_entities(a.log.entity_stats),
    "sample_entities_static": lambda a: sampling.sample_entities(a.typed_pairs("static"), 50),
    "sample_entities_irregular": lambda a: sampling.sample_entities(a.typed_pairs("irregular"), 50),
    "sampled_changes": lambda a: samples.with_entity_type(samples.shown_sample(a.static_changes, a.dimension("prop_ref_rate")), a.log.entity_stats).select(
        "revision_id", "entity_id", "entity_label", "property_id", "property_label", "value_id", "timestamp", "year", "year_month", "action", "label", "change_type",
        "old_value", "new_value", "old_datatype", "new_datatype", "is_reverted", "reversion", "user_type", "username", "user_id", "comment", "citation_needed",
        "entity_first_revision_timestamp", "entity_type"),
    "limited_static_pairs": lambda a: sampling.limited_pairs(a.typed_pairs("static"), 100),
    "sampled_changes_for_features": lambda a: samples.sampled_changes_for_features(
        sampling.sample_entities(a.typed_pairs("static"), 50), history.with_replaced_values(a.log.value_change, a.scale), a.log.entity_stats, a.log.revision, a.scale).select(
        "revision_id", "entity_id", "entity_label", "property_id", "property_label", "value_id", "old_value", "new_value", "old_datatype", "new_datatype", "change_target",
        "action", "timestamp", F.date_format("timestamp", "yyyy-MM").alias("year_month"), "year", "label", "change_type", "user_type", "username", "user_id", "comment",
        "entity_first_revision_timestamp", "prev_edit_on_entity"),
    "sampled_references": lambda a: samples.sampled_references(a.static_changes, a.log.reference_change, a.scale),
    "prev_edit_on_entity": lambda a: samples.previous_edit_on_entity(a.log.revision, a.scale),
    "knn4": lambda a: a.neighbours.select("property_id", "rank", "similarity"),
    "knn4_lists": lambda a: neighbours.neighbour_lists(a.neighbours),
    "nearest_non_self": lambda a: neighbours.nearest_non_self(a.neighbours),
    "nn_accuracy": lambda a: neighbours.neighbour_accuracy(a.embeddings, neighbours.nearest_non_self(a.neighbours)),
    "text_vectors": lambda a: _text_embeddings(a).select("property_id", "embedding"),
    "text_knn4": lambda a: neighbours.neighbours(materialise(_text_embeddings(a))).select("property_id", "rank", "similarity"),
    "csv_round_trip": _csv_round_trip,
    "result_round_trip": _result_round_trip,
    "appended_entities": _appended_entities,
    "statement_history": lambda a: predictor.longest_history(a.log.value_change).select(
        *STATEMENT, "revision_id", "timestamp", "action", "new_value", "is_reverted", "reversion"),
    "imputed_properties": lambda a: classify.imputed(a.routed).select("property_id", *profile.ROUTED_FEATURES),
    "encoded_categories": lambda a: classify.encoded_categories(a.labelled, predictor.GROUPS[0]).select(
        "revision_id", *STATEMENT, "split", *(f"{c}_index" for c in predictor.features_for(predictor.GROUPS[0])[1])),
    "encoded_categories_registered": lambda a: classify.encoded_categories(a.labelled, predictor.GROUPS[1]).select(
        "revision_id", *STATEMENT, "split", *(f"{c}_index" for c in predictor.features_for(predictor.GROUPS[1])[1])),
    "yeo_johnson_powers": lambda a: classify.powers_of_models(a.labelled, a.routed),
    "preprocessed_properties": lambda a: classify.preprocessed_properties(a.routed).select("property_id", *(f"{c}_scaled" for c in profile.ROUTED_FEATURES)),
    "preprocessed_anonymous": lambda a: _preprocessed(a, predictor.GROUPS[0]),
    "preprocessed_registered": lambda a: _preprocessed(a, predictor.GROUPS[1]),
    "search_folds": lambda a: classify.change_folds(a.labelled),
    "search_folds_properties": lambda a: classify.property_folds(a.routed, a.scale),
    "search_scores": lambda a: classify.by_group({group: f.scores for group, f in a.predictors.items()}),
    "rf_metrics": lambda a: classify.rejection_metrics(a.predictors),
    "feature_importance": lambda a: classify.by_group({group: classify.feature_importance(f) for group, f in a.predictors.items()}),
    "static_inference": _inference,
    "final_property_type": lambda a: classify.with_final_type(a.properties).select(
        "property_id", "property_label", "property_type", "final_property_type"),
    "balanced_id_sample": lambda a: sampling.keep_share(
        a.properties.filter("property_type <> ''"), (F.col("property_type") == "static") & F.col("property_label").contains(" ID"),
        0.6, ["property_id"], a.scale).select("property_id", "property_label", "property_type"),
    "stratified_test_set": lambda a: sampling.stratified_split(
        a.properties.filter("property_type <> ''"), "property_type", ["property_id"], a.scale)[1].select(
        "property_id", "property_type"),
    "properties_per_type_sample": lambda a: sampling.top_by_hash(
        a.properties.filter("property_type <> ''"), "property_type", ["property_id"], 30).select("property_id", "property_type"),
    "constraint_types": lambda a: graph.constraint_types(a.triples),
    "constraints_range": lambda a: graph.range_constraints(a.triples),
    "constraints_integer": lambda a: graph.integer_constraints(a.triples),
    "constraints_time_qualifier": lambda a: graph.time_qualifier_constraints(a.triples),
    "property_metadata": lambda a: graph.property_metadata(a.triples),
    "id_properties": lambda a: graph.id_properties(a.triples),
    "property_stability": lambda a: graph.stable_properties(a.triples),
    "sameas_links": lambda a: graph.same_as_links(a.triples, a.view("linked_entities")),
    "sparql_bindings": _link_results,
    "change_prompts": lambda a: prompts.change_prompts(a.feature_table).select("revision_id", *(f"prompt_{s}" for s in prompts.SETTINGS)),
    "reference_prompts": lambda a: prompts.change_prompts(a.feature_table, "needs_reference").select("revision_id", *(f"prompt_{s}" for s in prompts.SETTINGS)),
    "judged_changes": lambda a: prompts.judged_changes(a.feature_table, None).select("revision_id", "label", "change_type"),
    "first_judged_changes": lambda a: prompts.judged_changes(a.feature_table, 100).select("revision_id", "label", "change_type"),
    "change_scores": _change_scores,
    "property_prompts": lambda a: _property_prompts(a).select("property_id", "prompt"),
    "property_type_accuracy": _property_accuracy,
}


def _comparable(df: DataFrame) -> DataFrame:
    """Plain columns for comparing engines: local timestamps, doubles rounded, lists and maps as text."""
    def shown(name: str, kind: str) -> str:
        match kind:
            case "timestamp":
                return f"cast({name} as timestamp_ntz)"
            case "double":
                return rounded(name, name)
            case "array<double>":
                return f"array_join(transform({name}, x -> format_number(x, '0.0000')), ',')"
            case _ if kind.startswith("array"):
                return f"array_join(cast({name} as array<string>), ',')"
            case _ if kind.startswith("map"):
                return f"array_join(transform(array_sort(map_entries({name})), e -> concat(e.key, '=', coalesce(e.value, ''))), ',')"
        return name

    return df.selectExpr(*(f"{shown(f'`{n}`', kind)} as `{n}`" for n, kind in df.dtypes))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Callable[[Analyses], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: _comparable(build(Analyses(spark, folder)))

    return {name: bind(build) for name, build in ANALYSES.items()}
