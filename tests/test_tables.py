import hashlib
import json

import pytest
from pyspark.sql import functions as F

from editlore.plans import catalogue, graph, profile, prompts, samples
from editlore.operators import sampling
from editlore.operators.text_vectors import text_vectors
from editlore.session import Scale, small_side
from editlore.sources import files
from editlore.vocabulary import SANDBOX_ENTITIES

from .conftest import changes, day


def test_csv_keeps_json_values(spark, tmp_path):
    log = changes(spark, dict(new_value='"a, \\"b\\""', comment="x"), dict(new_value="{}", change_target="")).select(
        *[c.split()[0] for c in files.CHANGE_SCHEMA.split(", ")])
    files.write_csv(log, str(tmp_path / "c"), rows_per_file=1)
    written = [path.read_text().strip().split("\n") for path in (tmp_path / "c").glob("*.csv")]
    assert max(len(lines) for lines in written) == 2  # header and one row
    back = files.read_csv(spark, str(tmp_path / "c"), files.CHANGE_SCHEMA, ["revision_id", "new_value", "change_target", "timestamp"])
    rows = {r.revision_id: r for r in back.collect()}
    assert rows[1].new_value == '"a, \\"b\\""' and rows[2].new_value == "{}" and rows[1].change_target == ""
    assert back.agg(F.min("timestamp") == F.lit(day(0))).first()[0]


def test_csv_with_line_breaks(spark, tmp_path):
    (tmp_path / "c.csv").write_text('entity_id,comment\n1,"two\nlines"\n')
    schema = "entity_id long, comment string"
    assert [r.comment for r in files.read_csv(spark, str(tmp_path / "c.csv"), schema, multiline=True).collect()] == ["two\nlines"]
    assert files.read_csv(spark, str(tmp_path / "c.csv"), schema).count() == 2


def test_export_and_dimension_load(spark, tmp_path):
    entities = spark.createDataFrame([(i, i) for i in range(30)], "entity_id long, num_value_changes long")
    files.export_active_entities(entities, str(tmp_path / "e"))
    assert files.read_csv(spark, str(tmp_path / "e"), "entity_id long, num_value_changes long").count() == 9
    for _ in range(2):
        files.load_dimension(spark, str(tmp_path / "e"), "entity_id long, num_value_changes long", ["entity_id"], "active_entities")
    assert spark.table("active_entities").columns == ["entity_id"] and spark.table("active_entities").count() == 9
    files.write_result(entities.withColumn("part", F.col("entity_id") % 2), str(tmp_path / "r"), "json", by=["part"])
    assert spark.read.json(str(tmp_path / "r")).count() == 30


def test_append_continues_where_it_stopped(spark, tmp_path):
    path = str(tmp_path / "links")
    df = spark.range(10).withColumnRenamed("id", "entity_id")
    assert files.append_missing(df.filter("entity_id < 4"), path, "entity_id") == 4
    assert files.append_missing(df.unionByName(df), path, "entity_id") == 6
    assert files.append_missing(df, path, "entity_id") == 0
    assert sorted(r.entity_id for r in spark.read.parquet(path).collect()) == list(range(10))


def test_stopped_append_keeps_whole_batches(spark, tmp_path):
    path = str(tmp_path / "links")
    df = spark.range(40).select(F.when(F.col("id") > 0, F.col("id")).alias("entity_id"))  # one key is NULL
    batch = F.pmod(F.xxhash64("entity_id"), F.lit(4))
    failing = df.withColumn("x", F.when(batch == 2, F.raise_error(F.lit("stopped")).cast("int")).otherwise(1))
    with pytest.raises(Exception, match="stopped"):
        files.append_missing(failing, path, "entity_id", batches=4)
    finished = {r.entity_id for r in df.filter(batch < 2).collect()}
    assert {r.entity_id for r in spark.read.parquet(path).collect()} == finished
    assert files.append_missing(df.withColumn("x", F.lit(2)), path, "entity_id", batches=3) == 40 - len(finished)
    rows = [(r.entity_id, r.x) for r in spark.read.parquet(path).collect()]
    assert len(rows) == 40 and {k for k, _ in rows} == {None, *range(1, 40)} and {k for k, x in rows if x == 1} == finished
    assert files.append_missing(df.limit(0).withColumn("x", F.lit(1)), str(tmp_path / "none"), "entity_id") == 0


def test_text_vectors(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "ABC"), (4, "\U0001d11ex \U0001d11e"), (5, ""), (6, "ab"), (6, "ab"), (None, "q" * 5_000)], "k long, t string")
    found = {r.k: r.embedding for r in text_vectors(df, "k", F.col("t"), dimensions=16).collect()}

    def want(*texts):
        counts = [0] * 16
        for text in texts:
            shown = f" {text.lower()} "
            for i in range(len(shown) - 2):
                digest = hashlib.md5(shown[i:i + 3].encode()).hexdigest()
                counts[int(digest[:8], 16) % 16] += 1 if digest[8] < "8" else -1
        norm = sum(c * c for c in counts) ** 0.5
        return pytest.approx([c / norm if norm else 0.0 for c in counts])

    assert found == {1: want("abc"), 2: [0.0] * 16, 3: want("abc"), 4: want("\U0001d11ex \U0001d11e"), 5: [0.0] * 16, 6: want("ab", "ab"), None: want("q" * 5_000)}
    assert text_vectors(df.limit(0), "k", F.col("t")).count() == 0


def test_graph_patterns_scan_the_triples_once(spark, tmp_path):
    path = str(tmp_path / "triples")
    spark.createDataFrame([("P1", "rdf:type", "wikibase:Property", None)], "s string, p string, o string, o_lang string").write.parquet(path)
    for pattern in (graph.property_metadata, graph.id_properties, graph.range_constraints, graph.stable_properties):
        plan = pattern(spark.read.parquet(path))._jdf.queryExecution().optimizedPlan().toString()
        assert "Relation" not in plan  # only the kept triples are read


def test_sparql_results(spark):
    text = json.dumps({"results": {"bindings": [{"a": {"type": "uri", "value": "x"}, "b": {"value": "1"}}, {"a": {"value": "y"}}]}})
    found = files.sparql_bindings(spark.createDataFrame([(text,)], "json string"), "json", ["a", "b"])
    assert [(r.a, r.b) for r in found.orderBy("a").collect()] == [("x", "1"), ("y", None)]


def test_identifier_properties(spark):
    labels = spark.createDataFrame(
        [(1, "population"), (2, "VIAF ID"), (3, "Museum ID"), (4, "Old ID"), (5, "parish ID card"), (6, "gone"), (-1, "label"), (7, "number")],
        "property_id long, property_label string")
    meta = spark.createDataFrame([
        (1, "Quantity", None, "number of people", "continuously changes", False), (2, "ExternalId", None, "x", "never changes", None),
        (3, "String", None, "catalogue соdе", None, None), (5, "String", None, "plastic card", "never changes", False),
        (-1, "String", None, "label", None, False), (7, "String", None, None, "sometimes changes", True)],
        "property_id long, property_data_type string, aliases string, property_description string, frequency_update_label string, "
        "has_characteristic_num_id boolean")
    found = {r.property_id: r for r in catalogue.properties(labels, meta).collect()}
    assert {i: r.is_id_property for i, r in found.items()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, -1: 0, 7: 1}
    assert {i for i, r in found.items() if r.was_deleted} == {4, 6} and {i for i, r in found.items() if r.to_exclude} == {2, 3, 4, 7}
    assert found[1].property_type == "regular" and found[6].property_type == ""
    kept = catalogue.properties_to_classify(catalogue.properties(labels, meta))
    assert sorted(r.property_id for r in kept.collect()) == [1, 5, 6]


def test_profiles_of_sparse_statements(spark):
    log = changes(spark, dict(action="CREATE"), dict(action="CREATE", value_id="w", at=0.01), dict(label="value_update", at=3),
                  dict(action="DELETE", at=4), dict(is_reverted=1, at=5), dict(action="CREATE", entity_id=2))
    revision = log.select("revision_id", "user_type")
    small = profile.small_table(log.drop("user_type"), revision)
    assert small.count() == 4
    values = {(r.entity_id, r.value_id): r for r in profile.value_activity(small, Scale(6)).collect()}
    assert values[1, "w"].avg_time_between_updates_sec is None and values[1, "w"].num_changes_after_birth == 0
    assert values[1, "v"].median_time_between_updates_sec == 3 * 86400
    pair = {r.entity_id: r for r in profile.overall_activity(small, Scale(6)).collect()}
    assert pair[1].num_changes == 3 and pair[1].num_close_in_time_changes == 1 and pair[2].avg_time_between_changes_sec is None
    average = {r.entity_id: r for r in profile.average_value_activity(profile.value_activity(small, Scale(6))).collect()}
    assert average[1].pct_values_ever_changed == 0.5 and average[2].pct_changes_close_in_time is None
    assert len(profile.MEASURES) == 29 and sum(k == "time" for k in profile.MEASURES.values()) == 15


def test_property_features_have_all_columns(spark):
    log = changes(spark, *(dict(action="CREATE", entity_id=e, value_id=f"v{i}", at=i) for e in range(3) for i in range(3)))
    revision = log.select("revision_id", "entity_id", "timestamp", "user_type", "user_id")
    log = log.drop("user_type")
    small = profile.small_table(log, revision)
    cat = spark.createDataFrame([(1, "p", "static")], "property_id long, property_label string, property_type string")
    stats = profile.entity_property_stats(
        cat, profile.distinct_value_profile(log, revision), profile.average_value_activity(profile.value_activity(small, Scale(9))),
        profile.overall_activity(small, Scale(9)))
    ages = log.groupBy("entity_id").agg(F.min("timestamp").alias("first_revision_timestamp"), F.max("timestamp").alias("last_revision_timestamp"))
    features = profile.property_features(stats, ages, Scale(9))
    row = features.first()
    assert row.num_entity_property_pairs == 3 and row.avg_ep_num_changes_per_day == 1.5 and row.iqr_ep_num_changes_per_day == 0.0
    assert row.null_rate_epv_avg_time_between_updates_sec == 1.0
    assert len([c for c in features.columns if c.startswith("null_rate_")]) == 15


def test_constraint_patterns(spark):
    triples = spark.createDataFrame([
        ("wd:P1", "rdfs:label", "height", "en"), ("wd:P1", "rdfs:label", "Höhe", "de"), ("wd:P1", "schema:description", "d", "en"),
        ("wd:P1", "p:P2302", "s1", None), ("s1", "ps:P2302", "wd:Q21510860", None), ("s1", "pq:P2313", "1", None), ("s1", "pq:P2312", "9", None),
        ("s1", "pq:P2316", "wd:Q1", None), ("wd:Q1", "rdfs:label", "mandatory", "en"), ("wd:P2", "rdfs:label", "no description", "en"),
        ("<http://www.wikidata.org/entity/P3>", "rdfs:label", "Thing ID", "en"), ("<http://www.wikidata.org/entity/P3>", "rdf:type", "wikibase:Property", None),
        ("<http://www.wikidata.org/entity/P3>", "skos:altLabel", "a code", "en"),
        ("<http://dbpedia.org/resource/A>", "owl:sameAs", "<http://www.wikidata.org/entity/Q5>", None)],
        "s string, p string, o string, o_lang string")
    row = graph.range_constraints(triples).collect()
    assert len(row) == 1 and row[0].minimum_value == "1" and row[0].constraint_status_label == "mandatory"
    assert [(r.property_id, r.property_label, r.datatype) for r in graph.id_properties(triples).collect()] == [("P3", "Thing ID", None)]
    entities = spark.createDataFrame([(5, "e", "t", 1), (6, "f", "t", 1)], "entity_id long, entity_label string, entity_type string, type_numeric_id int")
    assert [(r.entity_id, r.dbpedia_id) for r in graph.same_as_links(triples, entities).orderBy("entity_id").collect()] == [(5, "A"), (6, None)]


@pytest.mark.parametrize("limit", [100, 1])
def test_sampled_references_take_the_latest_change(spark, limit):
    log = changes(spark, dict(at=1), dict(at=3), dict(at=9, value_id="w")).withColumn("year", F.lit(2022))
    refs = spark.createDataFrame([(10, 1, 1, v, day(at), 143, "h") for v, at in (("v", 0), ("v", 2), ("v", 3), ("v", 8), ("w", 1))],
                                 "revision_id long, entity_id long, property_id long, value_id string, timestamp timestamp, ref_property_id long, ref_hash string")
    scale = Scale(8, limit, lambda: log.select("entity_id", "property_id", "value_id", F.lit(1).alias("weight")))
    found = samples.sampled_references(log, refs, scale).orderBy("timestamp").collect()
    assert [(r.timestamp.day, r.change_revision_id) for r in found] == [(3, 1), (4, 2), (9, 2)]


FEATURES = {c: 0.0 if c in prompts.FRACTIONS else 0 for c in [*prompts.USER_INFO, *prompts.HISTORY_INFO, *prompts.REFERENCE_INFO, *prompts.CHANGE_MEANINGS]
            if c != "user_type"}


def prompt_rows(spark, *rows):
    df = changes(spark, *rows)
    extra = {c: F.lit(v) for c, v in FEATURES.items() if c not in df.columns}
    return df.withColumns(extra | {"time_since_last_edit_days": F.lit(0.0), "time_to_next_edit_days": F.lit(4745.0)})


def test_fractions_in_prompts_are_rounded_from_their_exact_value(spark):
    # 0.15625 is an exact tie; 0.00625 and 0.00015 lie beside theirs, above and below.
    given = {"avg_entities_per_day_user": 0.15625, "avg_properties_per_day_user": 0.00625, "time_since_last_edit_days": 0.00015}
    rows = prompt_rows(spark, {}).withColumns({name: F.lit(value) for name, value in given.items()})
    shown = rows.select(prompts.change_prompt(user=True, history=True)).first()[0]
    for value in given.values():
        assert f'"{value:.4f}"' in shown
    assert '"avg_entities_per_day_user":"0.1562"' in shown


def test_change_prompts_show_the_chosen_sections(spark):
    df = prompt_rows(spark, dict(new_datatype="wikibase-item", new_value='"Q5"', new_value_label="Unknown", old_value=None, label="x"),
                     dict(user_type="anonymous"))
    first, second = prompts.change_prompts(df).orderBy("revision_id").collect()
    details = json.loads(first.prompt_no_context.split("\n")[1])
    assert details["new_value"] == '"Q5" (unlabelled)' and details["old_value"] == "" and details["comment"] == ""
    assert "EDITOR" not in first.prompt_with_historic_features
    assert "no edit before" in first.prompt_all_features and "no edit after" in first.prompt_all_features
    assert '{"user_type":"anonymous"}' in second.prompt_with_user_model and "num_revisions_user" in first.prompt_with_user_model
    reference = df.select(prompts.change_prompt(history=True, dimension="needs_reference")).first()[0]
    assert "ratio_wikipedia_refs_up_to_t" not in reference
    told = prompts.instructions("accuracy", user=True)
    assert "source" not in told and "editor" in told and "refinement means" not in told
    assert all(f"{kind} means" in prompts.instructions("needs_reference", change_type=True) for kind in prompts.CHANGE_MEANINGS)


def test_failed_requests_give_empty_scores(spark):
    df = prompt_rows(spark, dict(entity_label="fine"), dict(entity_label="bad"), dict(entity_label="fine")).coalesce(1)

    def make():
        def score(texts):
            assert all(text.startswith("You review edits") for text in texts)
            if any("EDITOR" in text or "bad" in text for text in texts):
                raise ValueError("no answer")
            return ['{"score": 3, "explanation": "ok"}' for _ in texts]
        return score

    rows = prompts.score_changes(df, make).orderBy("revision_id").collect()
    assert [r.accuracy_score_no_context for r in rows] == [3.0, None, 3.0] and rows[0].accuracy_explanation_no_context == "ok"
    assert [r.accuracy_error_no_context for r in rows] == [None, "ValueError: no answer", None]
    assert {r.accuracy_score_with_user_model for r in rows} == {None} and {r.accuracy_error_all_features for r in rows} == {"ValueError: no answer"}


def test_requests_are_put_together_in_small_batches(spark):
    features = prompt_rows(spark, *[dict(comment=f"c{i}") for i in range(600)]).coalesce(1)

    def make():
        import hashlib
        return lambda texts: ['{"score": %d, "explanation": "%s"}' % (len(texts), hashlib.md5(text.encode()).hexdigest()) for text in texts]

    scored = prompts.score_changes(features, make, "needs_reference")
    rows = {r.revision_id: r for r in scored.collect()}
    for name, flags in prompts.SETTINGS.items():
        told = prompts.instructions("needs_reference", *flags)
        wanted = features.select("revision_id", F.md5(F.concat(F.lit(told + "\n\n"), prompts.change_prompt(*flags, "needs_reference"))).alias("digest")).collect()
        assert all(rows[w.revision_id][f"needs_reference_explanation_{name}"] == w.digest for w in wanted)
        assert max(r[f"needs_reference_score_{name}"] for r in rows.values()) <= 256


@pytest.mark.parametrize("n, found", [(None, 6), (1, 2), (2, 4), (100, 6)])
def test_judged_changes_are_limited_per_kind(spark, n, found):
    rows = [dict(label="statement_insertion"), dict(label="value_update", change_type="refinement")] * 3 + [dict(label="statement_deletion"), dict(label="x")]
    judged = prompts.judged_changes(prompt_rows(spark, *rows), n).collect()
    assert len(judged) == found and {r.revision_id for r in judged} == set(range(1, found + 1))


def test_limited_pairs_bind(spark):
    pairs = spark.range(5000).selectExpr("id as entity_id", "id % 7 as property_id").unionByName(spark.createDataFrame([(SANDBOX_ENTITIES[0], 1)], "entity_id long, property_id long"))
    everything = sampling.limited_pairs(pairs, None)
    assert everything.count() == 5000 and sampling.limited_pairs(pairs, 6000).count() == 5000
    order = [(r.entity_id, r.property_id) for r in everything.orderBy(sampling.hash_order("entity_id", "property_id"), "entity_id").limit(50).collect()]
    assert {(r.entity_id, r.property_id) for r in sampling.limited_pairs(pairs, 50).collect()} == set(order)


def test_property_examples(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "property_id long, prompt string")
    examples = prompts.example_prompts(df, {"static": [2, 9], "regular": [1]})
    assert examples == {"static": ["b"], "regular": ["a"]}
    assert "a\nKind: regular" in prompts.property_instructions(examples)


@pytest.mark.parametrize("rows, hinted", [(10, True), (3, False)])
def test_only_checked_sides_are_broadcast(spark, rows, hinted):
    df = small_side(spark.range(10), rows)
    assert ("ResolvedHint" in df._jdf.queryExecution().analyzed().toString()) == hinted
