"""The change log as SQL views over the event and part tables.

One text serves Spark and the SQL used to check it; only two expressions differ per engine, written as
``<ENTITY>`` (a number out of the event's JSON) and ``<SHIFT>`` (event time stretched twelvefold, so that a
month of events covers a year of edits). A block of 2000 events describes its own twenty entities and five
properties, so the number of statements grows with the events and a statement keeps a handful of changes.
"""

from __future__ import annotations

# Where the stretched time axis starts: 12 * 2024-01-01 minus 2021-11-01, in microseconds.
TIME_OFFSET = 18_813_081_600_000_000

DIALECTS = {
    "spark": {
        "<ENTITY>": "cast(get_json_object(props, '$.k') as bigint)",
        "<SHIFT>": f"timestamp_micros(unix_micros(cast(ts as timestamp)) * 12 - {TIME_OFFSET})",
    },
    "duckdb": {
        "<ENTITY>": "cast(json_extract_string(props, '$.k') as bigint)",
        "<SHIFT>": f"make_timestamp(epoch_us(ts) * 12 - {TIME_OFFSET})",
    },
}

VIEWS = {
    "numbered": """
        select event_id, <SHIFT> as ts, user_id as editor, event_type, cast(floor(value) as bigint) as v,
          <ENTITY> as k, cast(floor(event_id / 2000) as bigint) as block,
          cast(floor(event_id / 5) as bigint) % 3 as slot
        from {events}""",
    "base": """
        select event_id as revision_id, block * 20 + k % 20 as entity_id,
          case when event_id % 5 + 1 + 5 * (block % 39) = 20 then -1 else event_id % 5 + 1 + 5 * (block % 39) end as property_id,
          concat('Q', cast(block * 20 + k % 20 as string), '$', cast(event_id % 5 + 1 as string), '-', cast(slot as string)) as value_id,
          ts, editor, event_type, v,
          case event_type when 'signup' then 'CREATE' when 'error' then 'DELETE' else 'UPDATE' end as action
        from numbered""",
    "revision": """
        select revision_id, entity_id, ts as timestamp, year(ts) as year,
          case when editor % 10 = 0 then 'anonymous' when editor % 10 <= 2 then 'bot' else 'human' end as user_type,
          case when editor % 10 = 0 then null else editor end as user_id,
          concat('user', cast(editor as string)) as username,
          case revision_id % 6 when 0 then '/* wbsetclaim-update:2||1 */ Fixed wrong date' when 1 then '/* a */ keep /* b */ clean up'
            when 2 then '' when 3 then 'added prefix' when 4 then null else 'CORRECTED a mistake' end as comment
        from base""",
    "raw_change": """
        select revision_id, entity_id, concat('entity ', cast(entity_id as string)) as entity_label,
          property_id, concat('property ', cast(property_id as string)) as property_label, value_id, ts as timestamp, action,
          case when revision_id % 7 = 0 then 'rank' else '' end as change_target,
          case when revision_id % 7 = 0 then '' when action = 'CREATE' then 'statement_insertion' when action = 'DELETE' then 'statement_deletion'
            when event_type = 'view' then 'value_update' else '' end as label,
          case when revision_id % 7 = 0 or action <> 'UPDATE' then '' when event_type = 'click' then 'property_value_update'
            when event_type = 'view' then 'refinement' else 'textual_change, re_formatting' end as change_type,
          case when revision_id % 11 = 0 then 1 else 0 end as is_reverted,
          case when revision_id % 13 = 0 then 1 else 0 end as reversion,
          case when revision_id % 22 = 0 then ts + (revision_id % 400) * interval '1' day end as reversion_timestamp,
          case revision_id % 9 when 0 then 'string' when 1 then 'unknown-values' when 2 then 'wikibase-item' else 'quantity' end as new_datatype,
          case when revision_id % 9 = 2 and v % 2 = 0 then concat('item ', cast(v as string)) end as new_value_label,
          case when action = 'DELETE' then '{{}}'
            when revision_id % 7 = 0 then case revision_id % 3 when 0 then '"normal"' when 1 then '"preferred"' else '"deprecated"' end
            else concat('"', case when revision_id % 4 = 0 then '+' else '' end, cast(v as string), case when revision_id % 6 = 0 then '.5' else '' end, '"')
          end as new_value
        from base""",
    "reference_change": """
        select revision_id, entity_id, property_id, value_id, ts as timestamp, action, '' as change_target,
          concat('h', cast(v % 2 as string)) as ref_hash, case when v % 3 = 0 then 854 else 143 end as ref_property_id,
          case when action = 'DELETE' then '{{}}' else concat('"r', cast(v as string), '"') end as new_value
        from base where event_type in ('signup', 'error', 'click')
        union all
        select revision_id, entity_id, property_id, value_id, ts, action, '', concat('h', cast(v % 2 as string)), 813,
          case when action = 'DELETE' then '{{}}' else concat('"at ', cast(v as string), '"') end
        from base where event_type in ('signup', 'error', 'click') and v > 20""",
    "qualifier_change": """
        select revision_id, entity_id, property_id, value_id, ts as timestamp, action,
          case v % 4 when 0 then 585 when 1 then 580 when 2 then 582 else 2241 end as qual_property_id,
          concat('q', cast(v % 3 as string)) as value_hash,
          case when action = 'DELETE' then '{{}}' when v % 3 = 0 then '"Q5"' else '"Q22979588"' end as new_value
        from base where event_type in ('signup', 'error', 'purchase')""",
    "entity_stats": """
        select r.entity_id, min(r.timestamp) as first_revision_timestamp, max(r.timestamp) as last_revision_timestamp,
          case r.entity_id % 3 when 0 then 'human, writer' when 1 then 'city' else '' end as entity_types_31,
          count(*) as num_revisions, count(distinct r.user_id) as num_unique_editors,
          count(case when r.user_type = 'human' then 1 end) as num_human_edits,
          count(case when r.user_type = 'bot' then 1 end) as num_bot_edits,
          count(case when r.user_type = 'anonymous' then 1 end) as num_anonymous_edits,
          count(case when v.is_reverted = 1 then 1 end) as num_reverted_edits,
          count(case when v.change_target = '' then 1 end) as num_value_changes,
          count(case when v.change_target = '' and v.action = 'CREATE' then 1 end) as num_value_change_creates,
          count(case when v.change_target = '' and v.action = 'DELETE' then 1 end) as num_value_change_deletes,
          count(case when v.change_target = '' and v.action = 'UPDATE' then 1 end) as num_value_change_updates
        from revision r join raw_change v on v.revision_id = r.revision_id group by r.entity_id""",
    "property_labels": """
        select p_partkey as property_id, concat(p_name, case p_type when 'ECONOMY' then ' ID' when 'SMALL' then ' ID card'
            when 'PROMO' then ' number' else '' end) as property_label
        from {part} union all select -1, 'label' union all select -2, 'description'""",
    "property_metadata": """
        select p_partkey as property_id,
          case when p_type = 'ECONOMY' and p_size > 25 then 'ExternalId' when p_size > 30 then 'Quantity'
            when p_size > 15 then 'WikibaseItem' else 'String' end as property_data_type,
          case when p_size > 38 then concat(p_brand, ' code') when p_size < 8 then concat(p_brand, ' IDs') end as aliases,
          case when p_size > 40 then concat('identifier of a ', p_name) when p_size > 30 then concat('catalogue соdе of a ', p_name)
            else concat(p_name, ', ', p_type) end as property_description,
          case when p_size <= 12 then 'Q23611288' when p_size <= 24 then 'Q24025284' when p_size <= 30 then 'Q23611587' end as frequency_update,
          case when p_size <= 12 then 'never changes' when p_size <= 24 then 'sometimes changes'
            when p_size <= 30 then 'continuously changes' end as frequency_update_label,
          case p_brand when 'Brand#3' then true when 'Brand#4' then null else false end as has_characteristic_num_id
        from {part} where p_brand not in ('Brand#1', 'Brand#2')""",
    "range_constraint": """
        select p_partkey as property_id, case when p_size > 10 then cast(p_size as double) / 4 end as minimum_value,
          cast(p_size + 10 as double) as maximum_value,
          case when p_size > 25 then 'mandatory constraint' else 'suggestion constraint' end as constraint_status_label
        from {part} where p_type in ('SMALL', 'MEDIUM', 'LARGE')""",
    "integer_constraint": """
        select p_partkey as property_id, 'mandatory constraint' as constraint_status_label
        from {part} where p_type in ('STANDARD', 'MEDIUM')""",
    "prop_ref_rate": """
        select p_partkey as property_id, cast(p_size as double) / 64 as reference_rate,
          case when p_type in ('STANDARD', 'PROMO') then 1 else 0 end as citation_needed
        from {part} where p_brand <> 'Brand#5'""",
    "triples": """
        select concat('wd:P', cast(p_partkey as string)) as s, 'rdfs:label' as p,
          concat(p_name, case p_type when 'ECONOMY' then ' ID' when 'SMALL' then ' ID card' else '' end) as o, 'en' as o_lang from {part}
        union all select concat('wd:P', cast(p_partkey as string)), 'schema:description',
          case when p_size > 40 then concat('code of a ', p_name) else p_type end, 'en' from {part}
        union all select concat('wd:P', cast(p_partkey as string)), 'rdfs:label', p_brand, 'de' from {part}
        union all select concat('wd:P', cast(p_partkey as string)), 'wikibase:propertyType',
          case when p_size > 44 then 'wikibase:ExternalId' else 'wikibase:Quantity' end, null from {part}
        union all select concat('wd:P', cast(p_partkey as string)), 'p:P2302', concat('s', cast(p_partkey as string)), null from {part} where p_size > 10
        union all select concat('s', cast(p_partkey as string)), 'ps:P2302',
          case when p_type in ('SMALL', 'MEDIUM', 'LARGE') then 'wd:Q21510860' else 'wd:Q52848401' end, null from {part} where p_size > 10
        union all select concat('s', cast(p_partkey as string)), 'pq:P2313', cast(p_size as string), null from {part} where p_size > 20
        union all select concat('s', cast(p_partkey as string)), 'pq:P2312', cast(p_size + 10 as string), null from {part} where p_size > 20
        union all select concat('s', cast(p_partkey as string)), 'pq:P2316',
          case when p_size > 30 then 'wd:Q21502408' else 'wd:Q62026391' end, null from {part} where p_size > 10
        union all select concat('wd:P', cast(p_partkey as string)), 'rdf:type', 'wikibase:Property', null from {part}
        union all select concat('wd:P', cast(p_partkey as string)), 'skos:altLabel', concat(p_brand, ' code'), 'en' from {part} where p_type = 'ECONOMY'
        union all select concat('wd:P', cast(p_partkey as string)), 'skos:altLabel', concat('a ', p_name), 'en' from {part} where p_size > 25
        union all select concat('wd:P', cast(p_partkey as string)), 'wdt:P1552', 'wd:Q93868746', null from {part} where p_brand = 'Brand#3'
        union all select concat('wd:P', cast(p_partkey as string)), 'wdt:P2668',
          case when p_size <= 12 then 'wd:Q23611288' when p_size <= 24 then 'wd:Q24025284' else 'wd:Q23611587' end, null from {part} where p_size <= 30
        union all select concat('s', cast(p_partkey as string)), 'pq:P2306',
          case p_type when 'SMALL' then 'wd:P585' when 'LARGE' then 'wd:P580' else 'wd:P1' end, null from {part} where p_size > 10
        union all select concat('dbr:', p_name, '_', p_brand), 'owl:sameAs', concat('wd:Q', cast(p_partkey as string)), null from {part} where p_size > 15
        union all select distinct concat('wd:T', p_brand, p_type), 'wdt:P279', 'wd:Q21502402', null from {part}
        union all select distinct concat('wd:T', p_brand, p_type), 'rdfs:label', concat(p_type, ' constraint of ', p_brand), 'en' from {part}
        union all select distinct concat('wd:T', p_brand, p_type), 'schema:description', concat('values must be ', p_type), 'en' from {part} where p_type <> 'PROMO'
        union all select * from (values ('wd:Q23611288', 'rdfs:label', 'never changes', 'en'), ('wd:Q24025284', 'rdfs:label', 'sometimes changes', 'en'),
          ('wd:Q23611587', 'rdfs:label', 'continuously changes', 'en'), ('wd:Q21510860', 'wdt:P279', 'wd:Q21502402', null),
          ('wd:Q21510860', 'rdfs:label', 'range constraint', 'en'), ('wd:Q21510860', 'schema:description', 'value must lie between bounds', 'en'),
          ('wd:Q52848401', 'wdt:P279', 'wd:Q21502402', null), ('wd:Q52848401', 'rdfs:label', 'integer constraint', 'en'),
          ('wd:Q52848401', 'schema:description', 'value must be a whole number', 'en'),
          ('wd:Q21502408', 'rdfs:label', 'mandatory constraint', 'en'), ('wd:Q62026391', 'rdfs:label', 'suggestion constraint', 'en'),
          ('wd:Q62026391', 'rdfs:label', 'Vorschlag', 'de')) as c(s, p, o, o_lang)""",
    "linked_entities": """
        select p_partkey as entity_id, p_name as entity_label, p_type as entity_type, p_size as type_numeric_id from {part}""",
    "property_embeddings": """
        select vec_id as property_id, concat(case when label in (4, 7) then 'Code ID ' else 'property ' end, cast(vec_id as string)) as property_label,
          concat('cluster ', cast(label as string)) as property_description,
          case when vec_id % 2 = 0 then case label % 3 when 0 then 'static' when 1 then 'irregular' else 'regular' end end as property_type,
          embedding
        from {embeddings}""",
}

# Views a view reads, besides the driver tables.
NEEDS = {
    "base": ["numbered"],
    "revision": ["base"],
    "raw_change": ["base"],
    "reference_change": ["base"],
    "qualifier_change": ["base"],
    "entity_stats": ["revision", "raw_change"],
}


def with_needs(names: list[str], needs: dict[str, list[str]] = NEEDS) -> list[str]:
    """``names`` and everything they read, inputs first."""
    ordered: list[str] = []
    for name in names:
        for found in [*with_needs(needs.get(name, []), needs), name]:
            if found not in ordered:
                ordered.append(found)
    return ordered


def in_dialect(text: str, dialect: str) -> str:
    for token, expression in DIALECTS[dialect].items():
        text = text.replace(token, expression)
    return text


def view_sql(name: str, dialect: str) -> str:
    """Self-contained query text for one view; driver tables stay as ``{events}`` placeholders."""
    *inputs, last = with_needs([name])
    ctes = ", ".join(f"{n} as ({VIEWS[n]})" for n in inputs)
    return in_dialect((f"with {ctes} " if ctes else "") + VIEWS[last], dialect)
