"""Fixed graph patterns over triples ``(s, p, o, o_lang)``, as joins of narrow filtered scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlore.functions.columns import id_number
from editlore.session import materialise

# Terms of the vocabulary the patterns look for.
LABEL, DESCRIPTION, ALIAS = "rdfs:label", "schema:description", "skos:altLabel"
PROPERTY_CLASS, EXTERNAL_ID = "wikibase:Property", "wikibase:ExternalId"
CONSTRAINT_CLASS, RANGE, INTEGER = "wd:Q21502402", "wd:Q21510860", "wd:Q52848401"
TIME_QUALIFIERS = ["wd:P585", "wd:P580", "wd:P582"]
STABILITIES = ["wd:Q24025284", "wd:Q23611587", "wd:Q23611288"]
NUMERIC_ID = "wd:Q93868746"
CONSTRAINT_PARTS = ["p:P2302", "ps:P2302", "pq:P2316", LABEL, DESCRIPTION]


def relevant(triples: DataFrame, *predicates: str) -> DataFrame:
    """The triples of a few predicates, English or without language, read in one scan and kept for the joins of a pattern."""
    wanted = F.col("p").isin(*predicates) & (F.col("o_lang").isNull() | (F.col("o_lang") == "en"))
    return materialise(triples.filter(wanted).select("s", "p", "o", "o_lang"))


def edges(triples: DataFrame, predicate: str, subject: str, value: str, obj: str | list[str] | None = None) -> DataFrame:
    """Subject and object of one predicate, optionally only for given objects."""
    found = triples.filter(F.col("p") == predicate)
    if obj is not None:
        found = found.filter(F.col("o").isin(obj if isinstance(obj, list) else [obj]))
    return found.select(F.col("s").alias(subject), F.col("o").alias(value))


def english(triples: DataFrame, predicate: str, subject: str, value: str) -> DataFrame:
    return edges(triples.filter(F.col("o_lang") == "en"), predicate, subject, value)


def constraint_types(triples: DataFrame) -> DataFrame:
    triples = relevant(triples, "wdt:P279", LABEL, DESCRIPTION)
    classes = edges(triples, "wdt:P279", "constraint", "_c", CONSTRAINT_CLASS).drop("_c")
    return classes.join(english(triples, LABEL, "constraint", "label"), "constraint").join(
        english(triples, DESCRIPTION, "constraint", "description"), "constraint")


def _constrained(triples: DataFrame, kind: str) -> DataFrame:
    """Properties with a constraint statement of one kind, and the status of the statement."""
    statements = edges(triples, "ps:P2302", "statement", "_k", kind).drop("_k")
    status = edges(triples, "pq:P2316", "statement", "_status").join(
        english(triples, LABEL, "_status", "constraint_status_label"), "_status").drop("_status")
    return (
        edges(triples, "p:P2302", "property", "statement").join(statements, "statement").join(status, "statement")
        .join(english(triples, LABEL, "property", "property_label"), "property")
        .join(english(triples, DESCRIPTION, "property", "property_description"), "property")
    )


def range_constraints(triples: DataFrame) -> DataFrame:
    triples = relevant(triples, *CONSTRAINT_PARTS, "pq:P2313", "pq:P2312")
    return (
        _constrained(triples, RANGE)
        .join(edges(triples, "pq:P2313", "statement", "minimum_value"), "statement")
        .join(edges(triples, "pq:P2312", "statement", "maximum_value"), "statement")
        .select("property", "property_label", "property_description", "minimum_value", "maximum_value", "constraint_status_label")
    )


def integer_constraints(triples: DataFrame) -> DataFrame:
    return _constrained(relevant(triples, *CONSTRAINT_PARTS), INTEGER).select(
        "property", "property_label", "property_description", "constraint_status_label")


def time_qualifier_constraints(triples: DataFrame) -> DataFrame:
    """Constraints of any type that name a time qualifier."""
    triples = relevant(triples, "rdf:type", "pq:P2306", "p:P2302", "ps:P2302", LABEL)
    classes = edges(triples, "rdf:type", "property", "_c", PROPERTY_CLASS).drop("_c")
    qualifiers = edges(triples, "pq:P2306", "statement", "qualifier", TIME_QUALIFIERS).join(
        english(triples, LABEL, "qualifier", "qualifier_label"), "qualifier")
    return (
        edges(triples, "p:P2302", "property", "statement").join(classes, "property")
        .join(english(triples, LABEL, "property", "property_label"), "property")
        .join(edges(triples, "ps:P2302", "statement", "constraint_type"), "statement")
        .join(qualifiers, "statement")
        .select("property", "property_label", "constraint_type", "qualifier", "qualifier_label")
    )


def property_metadata(triples: DataFrame) -> DataFrame:
    """Type, label, description, joined aliases, update frequency and numeric-id flag of every property."""
    triples = relevant(triples, "rdf:type", "wikibase:propertyType", LABEL, DESCRIPTION, ALIAS, "wdt:P2668", "wdt:P1552")
    aliases = english(triples, ALIAS, "property", "_alias").groupBy("property").agg(
        F.array_join(F.array_sort(F.collect_set("_alias")), ", ").alias("aliases"))
    frequency = edges(triples, "wdt:P2668", "property", "frequency_update", STABILITIES).join(
        english(triples, LABEL, "frequency_update", "frequency_update_label"), "frequency_update")
    numeric = edges(triples, "wdt:P1552", "property", "_n", NUMERIC_ID).select(
        "property", F.lit(True).alias("_numeric")).distinct()
    return (
        edges(triples, "rdf:type", "property", "_c", PROPERTY_CLASS).drop("_c")
        .join(edges(triples, "wikibase:propertyType", "property", "property_data_type"), "property")
        .join(english(triples, LABEL, "property", "property_label"), "property")
        .join(english(triples, DESCRIPTION, "property", "property_description"), "property")
        .join(aliases, "property", "left").join(frequency, "property", "left").join(numeric, "property", "left")
        .select("property", "property_data_type", "property_label", F.coalesce("aliases", F.lit("")).alias("aliases"),
                "property_description", "frequency_update", "frequency_update_label",
                F.coalesce("_numeric", F.lit(False)).alias("has_characteristic_num_id"))
    )


def id_properties(triples: DataFrame) -> DataFrame:
    """Identifier properties: by datatype, by characteristic, or by what their texts say."""
    triples = relevant(triples, "rdf:type", "wikibase:propertyType", LABEL, DESCRIPTION, ALIAS, "wdt:P1552")
    classes = edges(triples, "rdf:type", "property", "_c", PROPERTY_CLASS).drop("_c")
    says_id = F.col("_text").rlike("(?i)identif|code|id")
    texts = english(triples, DESCRIPTION, "property", "_text").unionByName(english(triples, ALIAS, "property", "_text"))
    named = english(triples, LABEL, "property", "_label").filter(F.col("_label").rlike(r"(?i)\bID\b")).select("property").join(
        texts.filter(says_id).select("property"), "property", "left_semi")
    found = (
        edges(triples, "wikibase:propertyType", "property", "_t", EXTERNAL_ID).select("property")
        .unionByName(edges(triples, "wdt:P1552", "property", "_t", NUMERIC_ID).select("property"))
        .unionByName(named).distinct()
    )
    return (
        found.join(classes, "property", "left_semi")
        .join(english(triples, LABEL, "property", "property_label"), "property")
        .join(edges(triples, "wikibase:propertyType", "property", "datatype"), "property", "left")
        .select(F.regexp_extract("property", r"([QP]\d+)>?$", 1).alias("property_id"), "property_label", "datatype").distinct()
    )


def stable_properties(triples: DataFrame) -> DataFrame:
    triples = relevant(triples, "wdt:P2668", LABEL)
    return (
        edges(triples, "wdt:P2668", "property", "stability_value")
        .join(english(triples, LABEL, "property", "property_label"), "property")
        .join(english(triples, LABEL, "stability_value", "stability_value_label"), "stability_value")
        .select("property", "property_label", "stability_value", "stability_value_label")
    )


def local_name(uri: Column) -> Column:
    """The part of a resource URI after its namespace, without angle brackets."""
    return F.regexp_replace(F.translate(uri, "<>", ""), r"^(http://dbpedia\.org/resource/|dbr:)", "")


def same_as_links(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities with the resources declared the same; entities without any keep NULLs."""
    links = edges(triples, "owl:sameAs", "dbpedia", "wikidata").withColumn("entity_id", id_number(F.col("wikidata"))).join(
        entities.select("entity_id"), "entity_id", "left_semi")
    return entities.join(links, "entity_id", "left").select(
        "entity_id", "entity_label", "entity_type", "type_numeric_id", local_name(F.col("dbpedia")).alias("dbpedia_id"),
        "dbpedia", "wikidata")
