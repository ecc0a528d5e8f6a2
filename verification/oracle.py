"""Each registered query once more, as SQL for DuckDB over the driver tables.

Written apart from the Spark plans: as-of and range joins instead of scans, windowed distinct counts instead of
first-occurrence flags, ordered gaps instead of spans. Only the views that define the change log are shared.
"""

from __future__ import annotations

import re

from editlore.functions.columns import rounded as rounded_double
from editlore.plans.prompts import CHANGE_MEANINGS, FRACTIONS, HISTORY_INFO, REFERENCE_INFO, SETTINGS, USER_INFO
from editlore.plans.predictor import GROUPS, features_for
from editlore.plans.profile import COMMON_FEATURES, MEASURES, ROUTED_FEATURES, ROUTES, STORED_AS, feature_name
from editlore.plans.samples import CONTEXT
from editlore.sources.views import VIEWS, in_dialect

CHANGE_TYPES = ["property_value_update", "refinement", "unrefinement", "re_formatting", "textual_change", "link_change",
                "statement_insertion", "statement_deletion"]
KEY = "entity_id, property_id, value_id"
JSON_TEXT = "case when left({0}, 1) not in ('{{', '[') then json_extract_string({0}, '$') end"
KEYWORDS = "' fix|correct|improve|repair|clean|error|wrong|mistake'"
SANDBOXES = "4115189, 112795079, 15397819, 13406268, 17339402, 16943273"
LATIN = "translate({0}, 'аеорсіѕ', 'aeopcis')"


def json_text(column: str) -> str:
    return JSON_TEXT.format(column)


NEAR = 3_600_000_000  # microseconds


def _of_list(what: str, items: str, over: float = 1e6) -> str:
    return f"case when len({items}) > 0 then list_{what}({items}) end / {over}"


def _gaps(span: str) -> str:
    """Columns over ``g``, a list of gaps in microseconds, and ``far``, those of an hour or more."""
    both = [(f"{short}_time_between_{name}_sec", what, items) for name, items in ((span, "g"), ("changes_not_close_in_time", "far"))
            for short, what in (("avg", "avg"), ("min", "min"), ("max", "max"))]
    return ", ".join([*(f"{_of_list(what, items)} as {name}" for name, what, items in both), f"len(g) - len(far) as num_close_in_time_changes",
                      f"{_of_list('median', 'g')} as median_time_between_updates_sec"])


def _histories(keys: str, more: str) -> str:
    """Per ``keys`` the ordered times of overall activity as a list ``l``, the gaps between neighbours, and ``more`` aggregates."""
    return f"""(select *, list_filter(g, lambda x: x >= {NEAR}) as far, list_transform(l[2:], lambda x: x - l[1]) as ages
      from (select *, list_transform(range(2, len(l) + 1), lambda i: l[i] - l[i - 1]) as g
        from (select {keys}, list_sort(list(epoch_us(timestamp))) as l, {more} from small_table where is_overall_activity group by {keys})))"""


def _speaks(column: str) -> str:
    latin = LATIN.format(f"coalesce({column}, '')")
    return rf"({latin} ilike '%identif%' or regexp_matches({latin}, '\bIDs?\b') or regexp_matches({latin}, '\bcode\b'))"


def _interval_flag(name: str, intervals: str) -> str:
    return f"""select v.revision_id, v.entity_id, v.property_id, v.value_id, v.change_target,
      case when v.change_target = '' and exists (select 1 from {intervals} i where i.entity_id = v.entity_id and
        i.property_id = v.property_id and i.value_id = v.value_id and v.timestamp >= i.valid_from and v.timestamp < i.valid_to)
      then 1 else 0 end as {name} from value_change v"""


def _intervals(source: str, keys: str, value: str, keep: str) -> str:
    return f"""select * from (select revision_id as revision_id_from, lead(revision_id) over w as revision_id_to, {keys}, {value},
      timestamp as valid_from, lead(timestamp) over w as valid_to from {source}
      window w as (partition by {keys} order by timestamp, revision_id)) where {keep}"""


def _multihot(labels: str) -> str:
    return ", ".join(f"case when list_contains({labels}, '{t}') then 1 else 0 end as {t}" for t in CHANGE_TYPES)


LABEL_FULL = "case when label = 'value_update' then 'property_value_update' else label end"


def _label_list(text: str) -> str:
    return f"list_filter(list_transform(string_split({text}, ','), lambda x: trim(x)), lambda x: x <> '')"


def _feature_values() -> dict[str, str]:
    values = {}
    for m, kind in MEASURES.items():
        column = STORED_AS.get(m, m)
        values[feature_name(m, kind)] = f"cast({column} as double) / age" if kind == "count" else f"cast({column} as double)"
    values["pct_gaps_are_close_in_time"] = "cast(epoa_num_close_in_time_changes as double) / nullif(epoa_num_changes - 1, 0)"
    return values


def _property_features() -> str:
    parts = []
    for name, v in _feature_values().items():
        parts += [f"avg({v}) as avg_{name}", f"quantile_cont({v}, 0.5) as median_{name}",
                  f"quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25) as iqr_{name}"]
    for m, kind in MEASURES.items():
        if kind == "time":
            parts.append(f"cast(count(*) filter ({m} is null) as double) / count(*) as null_rate_{feature_name(m)}")
    return f"""select property_id, property_label, property_type, count(*) as num_entity_property_pairs, {', '.join(parts)}
      from (select s.*, greatest(cast(floor((epoch_us(e.last_revision_timestamp) - epoch_us(e.first_revision_timestamp)) / 86400000000) as double), 1.0) as age
        from entity_property_stats s join entity_stats e on e.entity_id = s.entity_id)
      group by property_id, property_label, property_type"""


TIME_OF_DAY = "case when hour(timestamp) between 6 and 11 then 'morning' when hour(timestamp) between 12 and 19 then 'afternoon' else 'night' end"
TIME_OF_WEEK = "case when isodow(timestamp) > 5 then 'weekend' else 'weekday' end"
#: What the user model counts.
COUNTED = (
    {f"{action.lower()}s": f"action = '{action}'" for action in ("CREATE", "DELETE", "UPDATE")} | {"value_changes": "true", "reverted_edits": "is_reverted = 1", "non_reverted_edits": "is_reverted = 0 and reversion = 0"}
    | {f"edits_{part}": f"{expression} = '{part}'" for expression, parts in ((TIME_OF_DAY, ("morning", "afternoon", "night")), (TIME_OF_WEEK, ("weekday", "weekend"))) for part in parts})
HAS_KEYWORD = f"case when regexp_matches(comment, {KEYWORDS}, 'i') then 1 else 0 end"


def days(later: str, earlier: str) -> str:
    return f"cast(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000) as bigint)"


def _json_object(fields: dict[str, str]) -> str:
    return "json_object(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def _shown_changes() -> str:
    """Prompts of all changes and settings. Field names are those of the request; the sections follow from each setting's flags."""
    plain = lambda names: {c: f"printf('%.4f', {c})" if c in FRACTIONS else c for c in names}
    value = lambda v, d, n: f"coalesce(case when {d} = 'wikibase-item' then {v} || ' (' || case when {n} = 'Unknown' then 'unlabelled' else {n} end || ')' else {v} end, '')"
    edit = _json_object({
        "entity": "'Q' || entity_id || ' ' || entity_label", "property": "'P' || property_id || ' ' || property_label", "action": "action",
        "old_value": value("old_value", "old_datatype", "old_value_label"), "new_value": value("new_value", "new_datatype", "new_value_label"),
        "made_by": "username", "made_at": "strftime(timestamp, '%Y-%m-%d %H:%M:%S')", "comment": "coalesce(comment, '')"})
    kinds = ", ".join(f"case when {k} = 1 then '{k}' end" for k in CHANGE_MEANINGS)
    sections = [
        ("EDITOR", f"case when user_type = 'anonymous' then json_object('user_type', user_type) else {_json_object(plain(USER_INFO))} end"),
        ("VALUE UNTIL THIS EDIT", _json_object({
            "days_since_the_edit_before": "case when time_since_last_edit_days = 0 then 'no edit before' else printf('%.4f', time_since_last_edit_days) end",
            "days_to_the_edit_after": "case when time_to_next_edit_days = 4745 then 'no edit after' else printf('%.4f', time_to_next_edit_days) end", **plain(HISTORY_INFO + REFERENCE_INFO)})),
        ("KIND OF EDIT", _json_object({"kinds": f"concat_ws(' ', {kinds})", "is_reverted": "is_reverted", "reversion": "reversion"}))]
    columns = []
    for name, flags in SETTINGS.items():
        parts = [s for s, wanted in zip(sections[2:] + sections[:2], (flags[2], flags[0], flags[1])) if wanted]
        columns.append("concat_ws(chr(10), 'EDIT', " + edit + "".join(f", '{title}', {text}" for title, text in parts) + f") as prompt_{name}")
    return f"select revision_id, {', '.join(columns)} from full_features"


DERIVED = {
    "value_change": """select revision_id, entity_id, entity_label, property_id, property_label, value_id, timestamp, action,
        change_target, label, change_type, is_reverted, reversion, reversion_timestamp, new_datatype, new_value_label, new_value,
        coalesce(lag(new_value) over w, '{}') as old_value, lag(new_datatype) over w as old_datatype,
        lag(new_value_label) over w as old_value_label
      from raw_change window w as (partition by entity_id, property_id, value_id, change_target order by timestamp, revision_id)""",
    "small_table": """select v.revision_id, v.entity_id, v.property_id, v.value_id, v.timestamp, v.action, v.label, v.change_type, r.user_type,
        (v.action = 'CREATE' or (v.action = 'UPDATE' and (v.label = 'value_update' or v.change_type = 'property_value_update'))) as is_overall_activity
      from value_change v join revision r on r.revision_id = v.revision_id
      where v.change_target = '' and v.is_reverted = 0 and v.reversion = 0 and v.property_id not in (-1, -2) and v.action <> 'DELETE'""",
    "properties": f"""select *,
        case when frequency_update_label = 'sometimes changes' then 'irregular' when frequency_update_label = 'continuously changes' then 'regular'
          when frequency_update_label = 'never changes' then 'static' else '' end as property_type,
        case when (was_deleted = 1 and regexp_matches(property_label, '\\bID\\b')) or is_id_property = 1 then 1 else 0 end as to_exclude
      from (select l.property_id, l.property_label, m.property_data_type, m.aliases, m.property_description, m.frequency_update,
          m.frequency_update_label, coalesce(m.has_characteristic_num_id, false) as has_characteristic_num_id,
          case when coalesce(m.has_characteristic_num_id, false) or coalesce(m.property_data_type, '') = 'ExternalId'
            or (regexp_matches(l.property_label, '\\bID\\b') and ({_speaks('m.property_description')} or {_speaks('m.aliases')})) then 1 else 0 end as is_id_property,
          case when m.property_data_type is null then 1 else 0 end as was_deleted
        from property_labels l left join property_metadata m on m.property_id = l.property_id)""",
    "to_classify": "select * from properties where to_exclude = 0 and property_id not in (-1, -2)",
    "overall": f"""select entity_id, property_id, len(l) as num_changes, values_seen as num_distinct_values, {_gaps('changes')}, num_value_creates,
        num_real_updates, num_value_id_real_updated, {_of_list('avg', 'ages')} as avg_age_of_value_to_first_insert_sec
      from {_histories('entity_id, property_id', """count(distinct value_id) as values_seen,
        count(distinct case when action = 'CREATE' then value_id end) as num_value_creates, count_if(action = 'UPDATE') as num_real_updates,
        count(distinct case when action = 'UPDATE' then value_id end) as num_value_id_real_updated""")}""",
    "per_value": f"""select {KEY}, len(l) as num_changes, len(g) as num_changes_after_birth, {_gaps('updates')},
        {_of_list('avg', 'ages')} as avg_age_of_value_at_update_sec
      from {_histories(KEY, 'count(*) as n')}""",
    "averaged": f"""select entity_id, property_id, count(*) as num_distinct_values,
        {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in ('num_changes', 'num_changes_after_birth', 'num_close_in_time_changes'))},
        sum(num_changes) / count(*) as avg_num_changes_per_value, avg(case when num_changes > 1 then 1.0 else 0.0 end) as pct_values_ever_changed,
        {', '.join(f'{f}({f}_time_between_{x}_sec) as {f}_time_between_{x}_sec' for x in ('updates', 'changes_not_close_in_time') for f in ('avg', 'min', 'max'))},
        avg(median_time_between_updates_sec) as avg_median_time_between_updates_sec,
        avg(avg_age_of_value_at_update_sec) as avg_age_of_value_at_update_sec,
        sum(num_close_in_time_changes) / nullif(sum(num_changes) - count(*), 0) as pct_changes_close_in_time
      from per_value group by all""",
    "distinct_values": """select v.entity_id, v.property_id, count(distinct v.value_id) as num_distinct_values,
        count(*) filter (v.action = 'CREATE') as num_creates, count(*) filter (v.action = 'UPDATE') as num_updates,
        count(*) as total_creates_updates, min(v.timestamp) as first_prop_value_insert, max(v.timestamp) as last_prop_value_insert_update,
        count(*) filter (r.user_type = 'bot') as num_bot_changes, count(*) filter (r.user_type = 'human') as num_human_changes
      from value_change v join revision r on r.revision_id = v.revision_id
      where v.action <> 'DELETE' and v.change_target = '' group by v.entity_id, v.property_id""",
    "entity_property_stats": f"""select d.entity_id, d.property_id, p.property_label, p.property_type, {', '.join(
        [f"a.{m.removeprefix('epaav_')} as {m}" for m in (STORED_AS.get(x, x) for x in MEASURES) if m.startswith('epaav_')]
        + [f"o.{m.removeprefix('epoa_')} as {m}" for m in MEASURES if m.startswith('epoa_')])}
      from distinct_values d join properties p on p.property_id = d.property_id
      left join averaged a on a.entity_id = d.entity_id and a.property_id = d.property_id
      left join overall o on o.entity_id = d.entity_id and o.property_id = d.property_id""",
    "property_features": _property_features(),
    "updates_as_creates": f"""select property_id, num_values, num_values_temporal, pct_values_temporal_qualifier,
        case when pct_values_temporal_qualifier >= 0.5 then 1 else 0 end as updates_as_creates_50,
        case when pct_values_temporal_qualifier >= 0.6 then 1 else 0 end as updates_as_creates_60
      from (select a.property_id, count(*) as num_values, count(t.value_id) as num_values_temporal,
          cast(count(t.value_id) as double) / count(*) as pct_values_temporal_qualifier
        from (select distinct {KEY} from small_table) a
        left join (select distinct {KEY} from qualifier_change where qual_property_id in (585, 580) and action = 'CREATE') t
          using (entity_id, property_id, value_id) group by a.property_id)""",
    "routed": f"""select f.property_id, coalesce(u.updates_as_creates_50, 0) as updates_as_creates_50, u.pct_values_temporal_qualifier,
        f.property_label, f.property_type, {', '.join('f.' + c for c in COMMON_FEATURES)}, {', '.join(
        f"case when u.updates_as_creates_50 = 1 then f.{ep} else f.{epv} end as {name}" for name, (epv, ep) in ROUTES.items())}
      from property_features f left join updates_as_creates u on u.property_id = f.property_id""",
    "rank_intervals": _intervals(
        f"(select *, {json_text('new_value')} as rank from value_change where change_target = 'rank' and property_id not in (-1, -2))",
        KEY, "rank", "rank is not null"),
    "qualifier_intervals": _intervals(
        f"(select *, {json_text('new_value')} as qual_value from qualifier_change)", f"{KEY}, qual_property_id, value_hash",
        "qual_value", "qual_value is not null"),
    "reference_intervals": _intervals(
        f"""(select revision_id, {KEY}, ref_hash, timestamp, action,
             string_agg(concat(ref_property_id, '=', coalesce(v, '')), ',' order by ref_property_id) as ref_values
           from (select *, {json_text('new_value')} as v from reference_change)
           group by revision_id, {KEY}, ref_hash, timestamp, action)""", f"{KEY}, ref_hash", "ref_values", "true"),
    "unreliable": "select * from qualifier_intervals where qual_property_id = 2241 and qual_value = 'Q22979588'",
    "ranked": """select v.revision_id, v.entity_id, v.property_id, v.value_id, v.change_target, i.rank as current_rank
      from value_change v left join rank_intervals i on i.entity_id = v.entity_id and i.property_id = v.property_id and i.value_id = v.value_id
        and v.change_target = '' and v.timestamp >= i.valid_from and (v.timestamp < i.valid_to or i.valid_to is null)
        and v.property_id in (select property_id from to_classify)""",
    "referenced": _interval_flag("has_reference", "reference_intervals"),
    "unreliably_sourced": _interval_flag("reason_for_deprecated_rank_source_known_to_be_unreliable", "unreliable"),
    "ranged": f"""select v.revision_id, v.property_id, v.new_value, v.new_datatype,
        case when c.property_id is not null and (v.new_datatype <> 'quantity'
          or try_cast({json_text('v.new_value')} as double) < c.minimum_value or try_cast({json_text('v.new_value')} as double) > c.maximum_value)
        then 1 else 0 end as violates_range_constraint
      from value_change v left join range_constraint c on c.property_id = v.property_id""",
    "whole": f"""select v.revision_id, v.property_id, v.new_value, v.new_datatype,
        case when c.property_id is not null and (v.new_datatype <> 'quantity'
          or try_cast({json_text('v.new_value')} as double) <> floor(try_cast({json_text('v.new_value')} as double)))
        then 1 else 0 end as violates_integer_constraint
      from value_change v left join integer_constraint c on c.property_id = v.property_id""",
    "update_comments": r"""select distinct r.revision_id, r.comment, regexp_replace(r.comment, '/\*.*?\*/', '') as cleaned_comment
      from value_change v join revision r on r.revision_id = v.revision_id
      where v.action = 'UPDATE' and v.change_target = '' and (r.comment <> '' or r.comment is null)""",
    "registered_changes": """select r.user_id, r.username, r.user_type, epoch_us(r.timestamp) as micros, r.timestamp, r.revision_id, v.entity_id, v.property_id, v.action,
        v.is_reverted, v.reversion
      from value_change v join revision r on r.revision_id = v.revision_id and r.user_type <> 'anonymous' and v.change_target = ''""",
    # Gaps along each username: its ordered changes as a list, each element with the one before it.
    "user_gaps": """select item.user_id, item.username, item.user_type, avg(item.micros - prior.micros) / 86400000000 as gap_days
      from (select unnest(l) as item, unnest(list_concat([null], l)[:len(l)]) as prior
        from (select list_sort(list({'micros': micros, 'revision_id': revision_id, 'user_id': user_id, 'username': username, 'user_type': user_type})) as l
          from registered_changes group by username))
      group by all""",
    "user_model": f"""select u.* exclude (active), gap_days as avg_days_between_revisions, num_entities / nullif(active, 0) as avg_entities_per_day,
        num_properties / nullif(active, 0) as avg_properties_per_day
      from (select user_id, username, user_type, min(timestamp) as first_edit, max(timestamp) as last_edit, {days('max(timestamp)', 'min(timestamp)')} as active,
          {', '.join(f'len(list_distinct(list({c}))) as {n}' for c, n in (('entity_id', 'num_entities'), ('revision_id', 'num_revisions'), ('property_id', 'num_properties')))},
          {', '.join(f'count_if({c}) as num_{n}' for n, c in COUNTED.items())}
        from registered_changes group by user_id, username, user_type) u join user_gaps using (user_id, username, user_type)""",
    "user_property": """select user_id, property_id, kept as count_changes, coalesce(kept / nullif(total, 0), 0.0) as avg_changes_to_property
      from (select user_id, property_id, count_if(is_reverted = 0) as kept, sum(count(*)) over (partition by user_id) as total from registered_changes group by user_id, property_id)
      where kept > 0""",
    "expertise": """select user_id, list_transform(top, lambda x: x.id) as property_id_expertise_list, list_transform(top, lambda x: x.label) as property_label_expertise_list
      from (select user_id, list({'id': property_id, 'label': property_label} order by avg_changes_to_property desc, property_id)[:10] as top
        from user_property join properties using (property_id) group by user_id)""",
    "favourites": """select user_id, list(entity_id order by n desc, entity_id)[:3] as top_3_entity_id
      from (select user_id, entity_id, count(*) as n from revision where user_type <> 'anonymous' group by all) group by user_id""",
    "edited": """select v.* replace (nullif(v.new_value, '{}') as new_value, nullif(v.old_value, '{}') as old_value),
        r.user_id, r.username, r.user_type, r.comment
      from value_change v join revision r on r.revision_id = v.revision_id where v.change_target = ''""",
    "typed_changes": f"""select *, {_label_list(f"concat(change_type, ',', {LABEL_FULL})")} as labels_list from value_change""",
    "hot": f"""select e.*, {_multihot(_label_list(f"concat(e.change_type, ',', {LABEL_FULL.replace('label', 'e.label')})"))} from edited e""",
    "ran": f"""select *, row_number() over line as total_changes_up_to_t,
        cast(sum(is_reverted) over line as bigint) as num_reverted_edits_up_to_t,
        count(*) filter (is_reverted = 0 and reversion = 0) over line as num_non_reverted_edits_up_to_t,
        (epoch_us(timestamp) - epoch_us(lag(timestamp) over line)) / 86400000000 as time_since_last_edit_days,
        coalesce((epoch_us(lead(timestamp) over line) - epoch_us(timestamp)) / 86400000000, 4745) as time_to_next_edit_days,
        (epoch_us(timestamp) - epoch_us(min(timestamp) over (partition by {KEY}))) / 86400000000 as value_age_in_entity_in_days_up_to_t,
        lead(action, 1, 'None') over line as type_of_next_edit,
        {', '.join(f"case when user_type = '{t}' then row_number() over (partition by {KEY}, user_type order by timestamp, revision_id) - 1 end as num_edits_{t}"
                   for t in ('human', 'bot', 'anonymous'))},
        case when old_datatype = 'unknown-values' or new_datatype = 'unknown-values' then 1 else 0 end as is_wd_value_change,
        count(*) filter (old_datatype = 'unknown-values' or new_datatype = 'unknown-values') over line as num_changes_wd_values,
        case when new_value is null then 0 else row_number() over (partition by {KEY}, new_value order by timestamp, revision_id) - 1 end as num_value_reoccurrences,
        count(distinct user_id) over line as num_unique_registered_users,
        {', '.join(f'cast(sum({t}) over line as bigint) as num_{t}' for t in CHANGE_TYPES)}
      from hot window line as (partition by {KEY} order by timestamp, revision_id)""",
    "first_refs": f"""select * from (select *, row_number() over (partition by {KEY}, ref_hash, action
          order by timestamp, revision_id, case when ref_property_id = 143 then 0 else 1 end, ref_property_id) as rn,
        case action when 'CREATE' then 1 when 'DELETE' then -1 else 0 end as delta from reference_change) where rn = 1""",
    "wiki_refs": f"""select {KEY}, change_target, timestamp, revision_id, cast(sum(delta) over (partition by {KEY} order by timestamp, revision_id) as bigint) as n
      from first_refs where ref_property_id = 143""",
    "other_refs": f"""select {KEY}, change_target, timestamp, revision_id, cast(sum(delta) over (partition by {KEY} order by timestamp, revision_id) as bigint) as n
      from first_refs where ref_property_id <> 143""",
    "reference_counts": """select v.revision_id, v.entity_id, v.property_id, v.value_id, v.change_target,
        coalesce(w.n, 0) as num_wikipedia_refs_up_to_t, coalesce(o.n, 0) as num_non_wikipedia_refs_up_to_t
      from value_change v
      asof left join wiki_refs w on w.entity_id = v.entity_id and w.property_id = v.property_id and w.value_id = v.value_id
        and w.change_target = v.change_target and v.timestamp >= w.timestamp
      asof left join other_refs o on o.entity_id = v.entity_id and o.property_id = v.property_id and o.value_id = v.value_id
        and o.change_target = v.change_target and v.timestamp >= o.timestamp""",
    "counted_refs": """select *, num_wikipedia_refs_up_to_t + num_non_wikipedia_refs_up_to_t as num_references_up_to_t,
        case when num_wikipedia_refs_up_to_t + num_non_wikipedia_refs_up_to_t > 0 then
          cast(num_wikipedia_refs_up_to_t as double) / (num_wikipedia_refs_up_to_t + num_non_wikipedia_refs_up_to_t) else 0.0 end as ratio_wikipedia_refs_up_to_t,
        case when num_wikipedia_refs_up_to_t + num_non_wikipedia_refs_up_to_t > 0 then
          cast(num_non_wikipedia_refs_up_to_t as double) / (num_wikipedia_refs_up_to_t + num_non_wikipedia_refs_up_to_t) else 0.0 end as ratio_non_wikipedia_refs_up_to_t
      from reference_counts""",
    "full_features": f"""select e.* replace (
          case when e.old_value is not null and e.old_datatype in ('wikibase-item') then coalesce(e.old_value_label, 'Unknown') end as old_value_label,
          case when e.new_value is not null and e.new_datatype in ('wikibase-item') then coalesce(e.new_value_label, 'Unknown') end as new_value_label,
          coalesce(e.time_since_last_edit_days, 0) as time_since_last_edit_days),
        c.num_wikipedia_refs_up_to_t, c.num_non_wikipedia_refs_up_to_t, c.num_references_up_to_t,
        c.num_references_up_to_t as total_references_up_to_t, c.ratio_wikipedia_refs_up_to_t, c.ratio_non_wikipedia_refs_up_to_t,
        cast(e.num_reverted_edits_up_to_t as double) / e.total_changes_up_to_t as ratio_reverted_edits_up_to_t,
        cast(e.num_non_reverted_edits_up_to_t as double) / e.total_changes_up_to_t as ratio_non_reverted_edits_up_to_t,
        {TIME_OF_DAY.replace('timestamp', 'e.timestamp')} as time_of_day, {TIME_OF_WEEK.replace('timestamp', 'e.timestamp')} as time_of_week,
        {HAS_KEYWORD.replace('comment', 'e.comment')} as comment_has_keyword,
        case when list_contains(x.property_id_expertise_list, e.property_id) then 1 else 0 end as user_is_expert,
        coalesce(p.citation_needed, 0) as citation_needed, coalesce(p.reference_rate, 0) as property_reference_rate,
        coalesce({days('m.last_edit', 'm.first_edit')}, 0) as user_age_days_user,
        e.label = 'statement_insertion' or (e.label not in ('statement_insertion', 'statement_deletion') and e.change_type <> '') as judged,
        {', '.join(f'coalesce(m.{c}, 0) as {c}_user' for c in (
            'num_entities', 'num_revisions', 'num_properties', 'num_creates', 'num_deletes', 'num_updates', 'num_value_changes',
            'num_reverted_edits', 'num_non_reverted_edits', 'avg_days_between_revisions', 'num_edits_morning', 'num_edits_afternoon',
            'num_edits_night', 'num_edits_weekday', 'num_edits_weekend', 'avg_entities_per_day', 'avg_properties_per_day'))}
      from ran e join counted_refs c on c.revision_id = e.revision_id and c.value_id = e.value_id and c.change_target = e.change_target
      left join user_model m on m.user_id = e.user_id left join expertise x on x.user_id = e.user_id
      left join prop_ref_rate p on p.property_id = e.property_id""",
    "shown_changes": _shown_changes(),
    "sample": """select v.*, r.user_id, r.username, r.user_type, r.comment, nullif(p.property_type, '') as property_type,
        e.first_revision_timestamp, e.last_revision_timestamp, e.num_human_edits, e.num_bot_edits, e.num_anonymous_edits, e.num_value_changes,
        e.num_revisions, e.num_value_change_creates, e.num_value_change_deletes, e.num_value_change_updates, e.num_unique_editors
      from value_change v join revision r on r.revision_id = v.revision_id join entity_stats e on e.entity_id = v.entity_id
      left join properties p on p.property_id = v.property_id""",
    "predicted": f"""select s.*, {_multihot(_label_list(
          f"case when s.action = 'UPDATE' then concat(s.change_type, ',', {LABEL_FULL.replace('label', 's.label')}) else {LABEL_FULL.replace('label', 's.label')} end"))},
        {TIME_OF_DAY.replace('timestamp', 's.timestamp')} as time_of_day, {TIME_OF_WEEK.replace('timestamp', 's.timestamp')} as time_of_week,
        {HAS_KEYWORD.replace('comment', 's.comment')} as comment_has_keyword,
        (epoch_us(s.timestamp) - epoch_us(min(s.timestamp) over (partition by s.entity_id, s.property_id, s.value_id))) / 86400000000 as value_age_in_days_up_to_t,
        row_number() over line as total_changes_up_to_t,
        count(*) filter (s.is_reverted = 0 and s.reversion = 0) over line as num_non_reverted_edits_up_to_t,
        (epoch_us(s.timestamp) - epoch_us(lag(s.timestamp) over line)) / 86400000000 as time_to_previous_edit_days,
        row_number() over (partition by s.entity_id, s.property_id, s.value_id, s.new_value order by s.timestamp, s.revision_id) - 1 as num_value_reoccurrences_at_t,
        lag(s.action, 1, 'None') over line as type_of_previous_edit,
        {days('s.timestamp', 's.first_revision_timestamp')} as entity_age_days_at_t,
        {days('s.timestamp', 's.first_revision_timestamp')} as time_to_first_edit_of_entity_in_days_at_t,
        cast(s.num_value_change_updates as double) / nullif(s.num_value_changes, 0) as entity_pct_updates_to_total_edits,
        cast(s.num_value_change_creates as double) / nullif(s.num_value_changes, 0) as entity_pct_creates_to_total_edits,
        cast(s.num_value_change_deletes as double) / nullif(s.num_value_changes, 0) as entity_pct_deletes_to_total_edits,
        cast(s.num_bot_edits as double) / s.num_revisions as entity_pct_bot_edits,
        cast(s.num_anonymous_edits as double) / s.num_revisions as entity_pct_anonymous_edits,
        cast(s.num_human_edits as double) / s.num_revisions as entity_pct_human_edits,
        s.num_unique_editors as entity_num_unique_editors,
        {days('s.timestamp', 's.last_revision_timestamp')} as time_to_last_edit_of_entity_at_t,
        case when timestamp '2025-06-01 00:00:00' - s.last_revision_timestamp > interval '365' day then 1 else 0 end as entity_abandoned,
        case when s.user_type <> 'anonymous' then {days('s.timestamp', 'm.first_edit')} else 0 end as user_age_days
      from sample s left join user_model m on m.user_id = s.user_id
      window line as (partition by s.entity_id, s.property_id, s.value_id order by s.timestamp, s.revision_id)""",
    "grouped": """select *, case when user_type = 'anonymous' then 'changes_anonymous' else 'changes_no_anonymous' end as model_group,
        case when timestamp < timestamp '2022-05-01 00:00:00' then 'train' else 'test' end as split from sample""",
    "followed": f"""select revision_id, {KEY}, model_group, split,
        case when lead(action, 1, '') over w = 'DELETE' and lead(action, 2, '') over w = ''
          and epoch_us(lead(timestamp) over w) <= epoch_us(timestamp) + 15780096000000 then 1 else 0 end as is_deleted
      from grouped where change_target = '' window w as (partition by {KEY}, model_group, split order by timestamp, revision_id)""",
    "labelled": f"""select g.revision_id, g.entity_id, g.property_id, g.value_id, g.change_target, g.model_group, g.split, g.user_type, g.action,
        g.timestamp, g.entity_label, g.property_label, g.old_value, g.new_value, coalesce(f.is_deleted, 0) as is_deleted,
        case when g.action = 'DELETE' or g.change_target = 'rank' then 0
          when (g.is_reverted = 1 and coalesce({days('g.reversion_timestamp', 'g.timestamp')}, 0) <= 182.64) or f.is_deleted = 1 then 1 else 0 end as target_to_predict
      from grouped g left join followed f on f.revision_id = g.revision_id and f.value_id = g.value_id and g.change_target = ''""",
    "model_rows": "select * from labelled where change_target = '' and action <> 'DELETE'",
    "validated": """select l.*, case when l.change_target = '' and l.action <> 'DELETE' and (l.user_type = 'anonymous' or l.since_last < 86400000000) then 1 else 0 end as prediction
      from (select *, epoch_us(timestamp) - epoch_us(lag(timestamp) over (partition by entity_id, property_id, value_id order by timestamp, revision_id)) as since_last from labelled) l
      where l.split = 'test'""",
    "timed": """select m.*, l.since_last as gap from model_rows m join (select revision_id, value_id, change_target,
          epoch_us(timestamp) - epoch_us(lag(timestamp) over (partition by entity_id, property_id, value_id order by timestamp, revision_id)) as since_last from labelled) l
        using (revision_id, value_id, change_target)""",
    "real_updates": """select * from value_change where action = 'UPDATE' and change_target = '' and is_reverted = 0 and reversion = 0
        and (change_type = 'property_value_update' or label = 'property_value_update')""",
    "update_spans": """select entity_id, value_id, count(*) as n, epoch_us(max(timestamp)) - epoch_us(min(timestamp)) as span from real_updates group by all""",
    "most_updated": """select entity_id, max({'n': n, 'back': -row, 'value_id': value_id, 'span': span}) as top
      from (select *, row_number() over (order by value_id) as row from update_spans) group by entity_id""",
    "representative": "select entity_id, top.value_id as value_id, top.n as num_updates from most_updated",
    "avg_times": "select entity_id, top.span / (top.n - 1) / 86400000000 as avg_days, top.n - 1 as num_updates from most_updated where top.n > 1",
    "types_of": """select entity_id, unnest(list_filter(list_transform(str_split(entity_types_31, ','), lambda x: trim(x)), lambda x: x <> '')) as entity_type from entity_stats""",
    "static_pairs": """select distinct v.entity_id, v.property_id from value_change v
        where v.property_id in (select property_id from properties where property_type = 'static')""",
    "irregular_pairs": """select distinct v.entity_id, v.property_id from value_change v
        where v.property_id in (select property_id from properties where property_type = 'irregular')""",
    "usable_static_pairs": f"select * from static_pairs where entity_id not in ({SANDBOXES})",
    "static_changes": """select v.*, r.year, r.user_type, r.username, r.user_id, r.comment, e.first_revision_timestamp as entity_first_revision_timestamp
      from value_change v join usable_static_pairs using (entity_id, property_id) join entity_stats e using (entity_id) join revision r using (revision_id)
      where v.change_target = ''""",
    "previous_edits": "select *, lag(timestamp) over (partition by entity_id order by timestamp) as prev_edit_on_entity from revision",
    "pairwise": """select q.property_id, q.property_label, q.property_type, l.property_id as nn_property_id, l.property_label as nn_property_label,
        l.property_type as nn_property_type, list_cosine_similarity(cast(q.embedding as double[]), cast(l.embedding as double[])) as similarity
      from property_embeddings q, property_embeddings l where l.property_type is not null""",
    "nearest4": """select * from (select *, row_number() over (partition by property_id order by similarity desc, nn_property_id) as rank from pairwise)
      where rank <= 4""",
    "nearest_other": """select property_id, nn_property_id, nn_property_label, nn_property_type, similarity as nn_sim from (
        select *, row_number() over (partition by property_id order by rank) as k from nearest4 where nn_property_id <> property_id) where k = 1""",
    "judged": """select e.property_type, n.nn_sim, case when e.property_type = n.nn_property_type then 1 else 0 end as hit,
        case when nn_sim > 0 and nn_sim <= 0.3 then '(0.0, 0.3]' when nn_sim > 0.3 and nn_sim <= 0.5 then '(0.3, 0.5]'
          when nn_sim > 0.5 and nn_sim <= 0.7 then '(0.5, 0.7]' when nn_sim > 0.7 and nn_sim <= 1 then '(0.7, 1.0]' end as bucket
      from property_embeddings e left join nearest_other n on n.property_id = e.property_id
      where e.property_type is not null and e.property_label not like '% ID%'""",
    "english_labels": "select s, o from triples where p = 'rdfs:label' and o_lang = 'en'",
    "english_descriptions": "select s, o from triples where p = 'schema:description' and o_lang = 'en'",
    "statements": """select a.s as property, a.o as statement, b.o as kind from triples a join triples b on b.s = a.o and b.p = 'ps:P2302' where a.p = 'p:P2302'""",
    "constrained": """select st.property, st.statement, st.kind, l.o as property_label, d.o as property_description, sl.o as constraint_status_label
      from statements st join triples q on q.s = st.statement and q.p = 'pq:P2316' join english_labels sl on sl.s = q.o
      join english_labels l on l.s = st.property join english_descriptions d on d.s = st.property""",
    "classes": "select s from triples where p = 'rdf:type' and o = 'wikibase:Property'",
    "prompted": f"""select r.property_id, r.property_label, r.property_type, chosen.a is null as quiet, concat_ws(chr(10),
        'P' || r.property_id || ': ' || r.property_label, 'Meaning: ' || coalesce(p.property_description, ''),
        case when n.nn_sim >= 0.75 then 'Nearest in meaning is P' || n.nn_property_id || ': ' || n.nn_property_label || ', which is ' || n.nn_property_type end,
        'Days between updates of a value',
        {', '.join("'- " + text + ": ' || case when chosen." + present + " is null then 'never updated' else printf('%.6f', chosen." + route + " / 86400.0) end"
                   for text, route, present in (('on average', 'a', 'a'), ('at least', 'b', 'a'), ('at most', 'c', 'a'),
                                                ('on average, corrections within the hour left out', 'd', 'd')))},
        case when r.pct_values_temporal_qualifier > 0.5 then 'Most values come with the time for which they hold.' end) as prompt
      from routed r join properties p on p.property_id = r.property_id
      join (select f.property_id, {', '.join(f"case when u.pct_values_temporal_qualifier < 0.5 then f.{ROUTES[name][0]} else f.{ROUTES[name][1]} end as {short}"
            for short, name in (('a', 'avg_time_between_updates'), ('b', 'avg_min_time_between_updates'),
                                ('c', 'avg_max_time_between_updates'), ('d', 'avg_avg_time_bc_nc_in_time_sec')))}
          from property_features f left join updates_as_creates u on u.property_id = f.property_id) chosen on chosen.property_id = r.property_id
      left join nearest_other n on n.property_id = r.property_id""",
}

def _known() -> dict[str, str]:
    tables = {t: t for t in ("events", "part", "embeddings")}
    shared = {name: in_dialect(text, "duckdb").format(**tables) for name, text in VIEWS.items()}
    return shared | DERIVED


def _needed(text: str, known: dict[str, str], found: list[str]) -> list[str]:
    for name in known:
        if name not in found and re.search(rf"\b(from|join|,)\s+{name}\b", text):
            _needed(known[name], known, found)
            if name not in found:
                found.append(name)
    return found


def complete(body: str) -> str:
    known = _known()
    names = _needed(body, known, [])
    return ("with " + ", ".join(f"{n} as ({known[n]})" for n in names) + " " if names else "") + body


def r(columns: str) -> str:
    return ", ".join(f"{rounded_double(c, c)} as {c}" for c in columns.split())


GAP_COLUMNS = "avg_time_between_{0}_sec min_time_between_{0}_sec max_time_between_{0}_sec median_time_between_updates_sec " \
    "avg_time_between_changes_not_close_in_time_sec min_time_between_changes_not_close_in_time_sec " \
    "max_time_between_changes_not_close_in_time_sec"


def rounded(relation: str, doubles: str) -> str:
    """All columns, the named doubles rounded."""
    return f"select * replace ({r(doubles)}) from {relation}"


STATS_DOUBLES = " ".join(STORED_AS.get(m, m) for m in MEASURES if not re.search(r"_num_(?!changes_per)", m) or "avg_num" in m)
FEATURE_DOUBLES = " ".join(
    [f"{kind}_{name}" for name in _feature_values() for kind in ("avg", "median", "iqr")]
    + [f"null_rate_{feature_name(m)}" for m, kind in MEASURES.items() if kind == "time"])
USER_DOUBLES = "avg_days_between_revisions avg_entities_per_day avg_properties_per_day"
def _fold_sizes(rows: str, label: str, by: str, identity: str) -> str:
    """Rows per class and fold of three, and the class's weight, from counts at every row."""
    return f"""select {by}class, fold, count(*) as num_rows, round(any_value(of_all) / (any_value(classes) * any_value(of_class)), 6) as weight
      from (select *, cast(count(*) over (partition by {by}1) as double) as of_all, count(distinct class) over (partition by {by}1) as classes,
          count(*) over (partition by {by}class) as of_class
        from (select {by}{label} as class, cast(cast('0x' || substr(md5(concat_ws('|', {identity}, '7')), 1, 13) as bigint) % 3 as int) as fold from {rows}))
      group by {by}class, fold"""


METRICS = """count(*) as num_rows, count(*) filter (target_to_predict = 1) as num_positive, count(*) filter (said = 1) as num_predicted,
  count(*) filter (said = 1 and target_to_predict = 1) as num_hits,
  round(coalesce(cast(count(*) filter (said = 1 and target_to_predict = 1) as double) / nullif(count(*) filter (said = 1), 0), 0), 6) as precision,
  round(coalesce(cast(count(*) filter (said = 1 and target_to_predict = 1) as double) / nullif(count(*) filter (target_to_predict = 1), 0), 0), 6) as recall,
  round(coalesce(2.0 * count(*) filter (said = 1 and target_to_predict = 1) / nullif(count(*) filter (said = 1) + count(*) filter (target_to_predict = 1), 0), 0), 6) as f1"""
TARGETS = f"revision_id, {KEY}, change_target, model_group, split, is_deleted, target_to_predict"
RUN_COLUMNS = ["num_reverted_edits_up_to_t", "num_non_reverted_edits_up_to_t", "total_changes_up_to_t", "type_of_next_edit",
               "num_edits_human", "num_edits_bot", "num_edits_anonymous", "is_wd_value_change", "num_changes_wd_values",
               "num_value_reoccurrences", "num_unique_registered_users", *(f"num_{t}" for t in CHANGE_TYPES)]
FEATURE_TABLE_DOUBLES = "ratio_reverted_edits_up_to_t ratio_non_reverted_edits_up_to_t time_since_last_edit_days time_to_next_edit_days " \
    "value_age_in_entity_in_days_up_to_t ratio_wikipedia_refs_up_to_t ratio_non_wikipedia_refs_up_to_t property_reference_rate " \
    "avg_days_between_revisions_user avg_entities_per_day_user avg_properties_per_day_user"

LINES = {name: 2 + 2 * sum(flags) for name, flags in SETTINGS.items()}


def _without_shares(name: str) -> str:
    """The prompt without the counts and shares of references, which end its last section."""
    return f"regexp_replace(prompt_{name}, ',\\\"num_references_up_to_t.*$', '}}')" if SETTINGS[name][1] else f"prompt_{name}"


def _encoded(group: str) -> str:
    """Number of distinct training categories before each row's own, or of all if it is not among them."""
    names = features_for(group)[1]
    here = f"""(select *, {', '.join(f"coalesce({c}, '0') as {c}_" for c in names)} from (select *, case when timestamp < timestamp '2022-05-01 00:00:00' then 'train' else 'test' end as split
        from predicted where (user_type = 'anonymous') = {str(group == 'changes_anonymous').lower()} and change_target = '' and action <> 'DELETE'))"""
    lists = ", ".join(f"list_sort(list(distinct {c}_)) as {c}_all" for c in names)
    index = lambda c: f"cast(case when list_contains({c}_all, {c}_) then list_position({c}_all, {c}_) - 1 else len({c}_all) end as integer) as {c}_index"
    return f"""select revision_id, {KEY}, split, {', '.join(map(index, names))} from {here} h, (select {lists} from {here} t where split = 'train') k"""


def _power(x: str, p: str) -> str:
    """The transform of one number with one power."""
    up = f"ln(1 + abs({x}))"
    return f"""case when {x} >= 0 then case when abs({p}) < 1e-9 then {up} else (pow(1 + {x}, {p}) - 1) / {p} end
      else case when abs(2 - ({p})) < 1e-9 then -{up} else (1 - pow(1 - {x}, 2 - ({p}))) / (2 - ({p})) end end"""


def _power_views(model: str, fitted_on: str, names: list[str]) -> dict[str, str]:
    """Powers and moments of columns by trying tenths first and then every thousandth around the best one."""
    def tried(grid: str) -> str:
        return f"""select name, j, ln(var_pop(t)) / -2 + (any_value(p) - 1) * avg(sign(x) * ln(1 + abs(x))) as l
          from (select name, x, j, p, {_power('x', 'p')} as t from (select name, x, j, j * cast(0.001 as double) as p from {model}_cells {grid}))
          group by name, j having min(x) < max(x) and var_pop(t) > pow(1e-12 * avg(t), 2)"""

    return {
        f"{model}_cells": f"select unnest([{', '.join(map(repr, names))}]) as name, unnest([{', '.join(f'cast({c} as double)' for c in names)}]) as x from {fitted_on}",
        f"{model}_coarse": f"select name, arg_max(j, l) as around from ({tried('cross join (select unnest(range(-5000, 5001, 100)) as j)')}) group by name",
        f"{model}_fine": f"""select name, arg_max(j, l) * cast(0.001 as double) as p, max(l) as l
          from ({tried(f"join {model}_coarse using (name) join (select unnest(range(-5000, 5001)) as j) on j between around - 100 and around + 100")}) group by name""",
        f"{model}_powers": f"""select name, count(*) as num_rows, any_value(p) as p, any_value(l) as l, avg(t) as m,
            case when min(x) < max(x) then stddev_pop(t) else 1 end as d
          from (select name, x, coalesce(p, 1) as p, l, {_power('x', 'coalesce(p, 1)')} as t from {model}_cells left join {model}_fine using (name)) group by name""",
        f"{model}_line": "select " + ", ".join(f"max({part}) filter (name = '{c}') as {c}_{part}" for c in names for part in "pmd") + f" from {model}_powers",
    }


def _scaled(names: list[str]) -> str:
    shown = {f"{c}_scaled": f"({_power(f'cast({c} as double)', f'{c}_p')} - {c}_m) / {c}_d" for c in names}
    return ", ".join(f"{rounded_double(name, text)} as {name}" for name, text in shown.items())


def _model_rows(group: str) -> str:
    numerical, categorical, _ = features_for(group)
    filled = [f"coalesce({c}, 0) as {c}" for c in numerical] + [f"coalesce({c}, '0') as {c}" for c in categorical]
    return f"""select * replace ({', '.join(filled)}), case when timestamp < timestamp '2022-05-01 00:00:00' then 'train' else 'test' end as split
      from predicted where (user_type = 'anonymous') = {str(group == 'changes_anonymous').lower()} and change_target = '' and action <> 'DELETE'"""


def _preprocessed(group: str) -> str:
    numerical, categorical, binary = features_for(group)
    known = ", ".join(f"list_sort(list(distinct {c})) as {c}_all" for c in categorical)
    hot = [f"array_to_string(list_transform({c}_all, lambda x: cast(x = {c} as integer)), ',') as {c}_hot" for c in categorical]
    return f"""select revision_id, {KEY}, split, {', '.join([*hot, *(f'coalesce({c}, 0) as {c}' for c in binary)])}, {_scaled(numerical)}
      from {group}_rows, {group}_line, (select {known} from {group}_rows where split = 'train')"""


DERIVED["imputed"] = f"select * replace ({', '.join(f'coalesce({c}, 1e15) as {c}' for c in ROUTED_FEATURES)}) from routed"
DERIVED |= _power_views("imputed", "imputed", ROUTED_FEATURES)
for _group in GROUPS:
    DERIVED[f"{_group}_rows"] = _model_rows(_group)
    DERIVED |= _power_views(_group, f"{_group}_rows where split = 'train'", features_for(_group)[0])

# Three letters at a time between two spaces; the first digits of the digest give the place, the ninth the sign.
DERIVED["text_counts"] = """select property_id, cast('0x' || substr(h, 1, 8) as bigint) % 64 as place, sum(case when substr(h, 9, 1) < '8' then 1 else -1 end) as n
  from (select property_id, md5(substr(t, i, 3)) as h
    from (select property_id, t, unnest(range(1, length(t) - 1)) as i
      from (select property_id, ' ' || lower(property_label || '. ' || coalesce(property_description, '')) || ' ' as t from property_embeddings)))
  group by all"""
DERIVED["text_embeddings"] = """select property_id, property_type, list_transform(range(64), lambda i: coalesce(counts[i], 0) / norm) as embedding
  from (select property_id, map(list(place), list(cast(n as double))) as counts, sqrt(sum(n * n)) as norm from text_counts group by property_id)
    join property_embeddings using (property_id)"""
DERIVED["text_nearest4"] = """select * from (select *, row_number() over (partition by property_id order by similarity desc, nn) as rank
  from (select q.property_id, l.property_id as nn, list_cosine_similarity(q.embedding, l.embedding) as similarity
    from text_embeddings q, text_embeddings l where l.property_type is not null)) where rank <= 4"""

BODIES = {
    "change_log": "select * from value_change",
    "small_table": "select * from small_table",
    "entity_prop_overall_activity": rounded("overall", GAP_COLUMNS.format("changes") + " avg_age_of_value_to_first_insert_sec"),
    "entity_prop_distinct_val_change": "select * from distinct_values",
    "value_activity": rounded("per_value", GAP_COLUMNS.format("updates") + " avg_age_of_value_at_update_sec"),
    "entity_prop_avg_activity_of_values": rounded(
        "averaged", "avg_num_changes_per_value pct_values_ever_changed avg_time_between_updates_sec min_time_between_updates_sec "
        "max_time_between_updates_sec avg_median_time_between_updates_sec avg_time_between_changes_not_close_in_time_sec "
        "min_time_between_changes_not_close_in_time_sec max_time_between_changes_not_close_in_time_sec "
        "avg_age_of_value_at_update_sec pct_changes_close_in_time"),
    "entity_property_stats": rounded("entity_property_stats", STATS_DOUBLES),
    "property_features": rounded("property_features", FEATURE_DOUBLES),
    "updates_as_creates": rounded("updates_as_creates", "pct_values_temporal_qualifier"),
    "routed_features": f"select property_id, updates_as_creates_50, {r(' '.join([*COMMON_FEATURES, *ROUTES]))} from routed",
    "rank_intervals": "select * from rank_intervals",
    "qualifier_intervals": "select * from qualifier_intervals",
    "reference_intervals": "select * from reference_intervals",
    "current_rank": "select * from ranked",
    "has_reference": "select * from referenced",
    "deprecated_source_flag": "select * from unreliably_sourced",
    "annotated_changes": """select a.*, h.has_reference, u.reason_for_deprecated_rank_source_known_to_be_unreliable,
        g.violates_range_constraint, w.violates_integer_constraint
      from ranked a join referenced h on h.revision_id = a.revision_id join unreliably_sourced u on u.revision_id = a.revision_id
      join ranged g on g.revision_id = a.revision_id join whole w on w.revision_id = a.revision_id""",
    "violates_range": "select * from ranged",
    "violates_integer": "select * from whole",
    "update_comments": "select * from update_comments",
    "comment_keywords": "select * from update_comments where regexp_matches(cleaned_comment, ' (fix|correct|improve|repair|error|wrong|mistake|clean)', 'i')",
    "property_catalogue": "select * from properties",
    "properties_to_classify": "select * from to_classify",
    "label_counts": """select count(*) filter (property_type = 'static') as num_static,
        count(*) filter (property_type = 'static' and contains(property_label, ' ID')) as num_static_ids,
        count(*) filter (property_type = 'regular') as num_regular, count(*) filter (property_type = 'irregular') as num_irregular,
        count(*) filter (property_type = 'irregular' and contains(property_label, ' ID')) as num_irregular_ids,
        count(*) filter (property_type = '') as num_unlabeled,
        count(*) filter (property_type = '' and contains(property_label, ' ID')) as num_unlabeled_ids,
        count(*) filter (property_type = '' and not contains(property_label, ' ID')) as num_unlabeled_non_ids,
        round(100.0 * count(*) filter (property_type = 'static' and contains(property_label, ' ID')) / nullif(count(*) filter (property_type = 'static'), 0), 6) as pct_static_ids,
        round(100.0 * count(*) filter (property_type = 'irregular' and contains(property_label, ' ID')) / nullif(count(*) filter (property_type = 'irregular'), 0), 6) as pct_irregular_ids
      from properties""",
    "non_id_static_properties": """select property_id, property_label, property_type from properties
        where property_type = 'static' and property_label not like '% ID%'""",
    "first_non_id_static_properties": """select property_id, property_label, property_type from properties
        where property_type = 'static' and property_label not like '% ID%' order by property_id limit 30""",
    "user_model": rounded("user_model", USER_DOUBLES),
    "user_property": rounded("user_property", "avg_changes_to_property"),
    "user_expertise": """select user_id, array_to_string(property_id_expertise_list, ',') as property_id_expertise_list,
        array_to_string(property_label_expertise_list, ',') as property_label_expertise_list from expertise""",
    "user_top_entities": "select user_id, array_to_string(top_3_entity_id, ',') as top_3_entity_id from favourites",
    "full_user_model": f"""select m.*, {', '.join(f"coalesce(array_to_string({c}, ','), '') as {c}" for c in ('property_id_expertise_list', 'property_label_expertise_list', 'top_3_entity_id'))}
      from ({rounded("user_model", USER_DOUBLES)}) m left join expertise x on x.user_id = m.user_id left join favourites f on f.user_id = m.user_id""",
    "change_types_multihot": f"select revision_id, array_to_string(labels_list, ',') as labels_list, {_multihot('labels_list')} from typed_changes",
    "single_change_features": f"""select e.revision_id, e.user_type, {TIME_OF_DAY.replace('timestamp', 'e.timestamp')} as time_of_day,
        {TIME_OF_WEEK.replace('timestamp', 'e.timestamp')} as time_of_week, e.is_reverted,
        lead(e.action, 1, 'None') over (partition by e.entity_id, e.property_id, e.value_id order by e.timestamp, e.revision_id) as type_of_next_edit,
        e.reversion, {HAS_KEYWORD.replace('comment', 'e.comment')} as comment_has_keyword,
        case when list_contains(x.property_id_expertise_list, e.property_id) then 1 else 0 end as user_is_expert, p.citation_needed,
        round(p.reference_rate, 6) as property_reference_rate, {days('m.last_edit', 'm.first_edit')} as user_age_days_user,
        m.num_value_changes as num_value_changes_user,
        case when m.user_id is not null then round(coalesce(m.avg_entities_per_day, 0), 6) end as avg_entities_per_day_user
      from edited e left join user_model m on m.user_id = e.user_id left join expertise x on x.user_id = e.user_id
      left join prop_ref_rate p on p.property_id = e.property_id""",
    "running_history": f"""select revision_id, {KEY}, {', '.join(RUN_COLUMNS)},
        round(cast(num_reverted_edits_up_to_t as double) / total_changes_up_to_t, 6) as ratio_reverted_edits_up_to_t,
        round(cast(num_non_reverted_edits_up_to_t as double) / total_changes_up_to_t, 6) as ratio_non_reverted_edits_up_to_t,
        {r('time_since_last_edit_days time_to_next_edit_days value_age_in_entity_in_days_up_to_t')}
      from ran""",
    "reference_counts_asof": rounded("counted_refs", "ratio_wikipedia_refs_up_to_t ratio_non_wikipedia_refs_up_to_t"),
    "expected_datatype": """select property_id, new_datatype as expected_datatype from (select property_id, new_datatype,
        row_number() over (partition by property_id order by new_datatype is null, count(*) desc, new_datatype) as k from value_change group by property_id, new_datatype) where k = 1""",
    "feature_table": f"""select timestamp, revision_id, entity_id, entity_label, property_id, property_label, value_id, old_value, new_value, action,
        user_id, username, comment, old_datatype, new_datatype, change_type, label, old_value_label, new_value_label, time_of_day, time_of_week,
        type_of_next_edit, is_reverted, reversion, {', '.join(CHANGE_TYPES)}, user_type, user_is_expert, user_age_days_user,
        {', '.join(f'{c}_user' for c in ('num_entities', 'num_revisions', 'num_properties', 'num_creates', 'num_deletes', 'num_updates',
            'num_value_changes', 'num_reverted_edits', 'num_non_reverted_edits', 'num_edits_morning', 'num_edits_afternoon',
            'num_edits_night', 'num_edits_weekday', 'num_edits_weekend'))},
        num_reverted_edits_up_to_t, num_non_reverted_edits_up_to_t, num_changes_wd_values, num_value_reoccurrences,
        num_unique_registered_users, num_references_up_to_t, num_wikipedia_refs_up_to_t, num_non_wikipedia_refs_up_to_t,
        total_changes_up_to_t, total_references_up_to_t, {', '.join(f'num_{t}' for t in CHANGE_TYPES)}, citation_needed, comment_has_keyword,
        {r(FEATURE_TABLE_DOUBLES)} from full_features""",
    "predictor_features": f"""select revision_id, {KEY}, change_target, user_age_days, time_to_first_edit_of_entity_in_days_at_t,
        total_changes_up_to_t, num_non_reverted_edits_up_to_t, num_value_reoccurrences_at_t, entity_age_days_at_t, entity_num_unique_editors,
        time_to_last_edit_of_entity_at_t, time_of_day, time_of_week, user_type, action, property_type, type_of_previous_edit,
        {', '.join(CHANGE_TYPES)}, comment_has_keyword, entity_abandoned,
        {r('value_age_in_days_up_to_t time_to_previous_edit_days entity_pct_updates_to_total_edits entity_pct_creates_to_total_edits '
           'entity_pct_deletes_to_total_edits entity_pct_bot_edits entity_pct_anonymous_edits entity_pct_human_edits')} from predicted""",
    "target_label": f"select {TARGETS} from labelled",
    "target_label_all_rows": f"""select g.revision_id, g.entity_id, g.property_id, g.value_id, g.change_target, g.model_group, g.split,
        case when g.change_target = '' then coalesce(f.is_deleted, 0) else 0 end as is_deleted,
        case when (g.is_reverted = 1 and coalesce({days('g.reversion_timestamp', 'g.timestamp')}, 0) <= 182.64) or f.is_deleted = 1 then 1 else 0 end as target_to_predict
      from grouped g left join followed f on f.revision_id = g.revision_id and f.value_id = g.value_id""",
    "clean_edits_before_t": f"""select revision_id, {KEY}, change_target, count(*) filter (is_reverted = 0 and reversion = 0) over (
        partition by {KEY} order by timestamp, revision_id rows between unbounded preceding and 1 preceding) as num_non_reverted_edits_before_t from sample""",
    "target_distribution": """select model_group, split, count(*) as num_rows, cast(sum(target_to_predict) as bigint) as num_positive,
        round(avg(target_to_predict), 6) as ratio_positive, round(1 - avg(target_to_predict), 6) as ratio_negative from labelled group by model_group, split""",
    "baseline_anonymous": f"""select split, count(*) filter (user_type = 'anonymous') as num_anonymous,
        count(*) filter (user_type = 'anonymous' and target_to_predict = 1) as num_anonymous_rejected,
        count(*) filter (user_type <> 'anonymous' and target_to_predict = 1) as num_other_rejected, {METRICS}
      from (select *, case when user_type = 'anonymous' and target_to_predict = 1 then 1 else 0 end as said from model_rows) group by split""",
    "prediction_validation": f"select {TARGETS}, prediction from validated",
    "ranking_metrics": """select model_group, split, cast(p as bigint) as num_positive, cast(n - p as bigint) as num_negative, num_scores,
        round((low - p * (p + 1) / 2.0) / nullif(p * (n - p), 0), 6) as roc_auc
      from (select model_group, split, sum(target_to_predict) as p, count(*) as n, count(distinct coalesce(gap, -1)) as num_scores,
          sum(middle) filter (target_to_predict = 1) as low
        from (select *, rank() over line + (count(*) over (partition by model_group, split, gap) - 1) / 2.0 as middle from timed
          window line as (partition by model_group, split order by gap desc nulls first)) group by model_group, split)""",
    "roc_curve": """select x.model_group, x.split, cast(sum(target_to_predict) as bigint) as positives, cast(sum(1 - target_to_predict) as bigint) as negatives,
        round(any_value(y.tp) / any_value(z.p), 6) as true_positive_rate, round(any_value(y.fp) / any_value(z.n), 6) as false_positive_rate
      from timed x
      join (select distinct model_group, split, gap, sum(target_to_predict) over up as tp, sum(1 - target_to_predict) over up as fp from timed
        window up as (partition by model_group, split order by gap nulls last range between unbounded preceding and current row)) y
        on y.model_group = x.model_group and y.split = x.split and y.gap is not distinct from x.gap
      join (select model_group, split, nullif(sum(target_to_predict), 0) as p, nullif(sum(1 - target_to_predict), 0) as n from timed group by all) z
        on z.model_group = x.model_group and z.split = x.split
      group by x.model_group, x.split, x.gap""",
    "class_report": f"""select class, {METRICS} from (
        select c as class, cast(target_to_predict = c as int) as target_to_predict, cast(prediction = c as int) as said
        from validated, (values (0), (1)) t(c) where change_target = '' and action <> 'DELETE') group by class""",
    "rejected_values": """select entity_id, entity_label, property_id, property_label, value_id, old_value, new_value from validated
        where prediction = 1 and action <> 'DELETE' and change_target = ''""",
    "first_rejected_values": """select entity_id, entity_label, property_id, property_label, value_id, old_value, new_value from validated
        where prediction = 1 and action <> 'DELETE' and change_target = '' order by entity_id, property_id, value_id, timestamp, revision_id limit 50""",
    "profile_counts": """select coalesce(property_type, '(none)') as property_type, count(*) as num_changes, count(distinct entity_id) as num_entities,
        count(distinct property_id) as num_properties from sample group by property_type
      union all select '(all)', count(*), count(distinct entity_id), count(distinct property_id) from sample""",
    "values_per_property": """select property_id, round(avg(n), 6) as avg_num_distinct_values_per_property from (
        select entity_id, property_id, count(distinct value_id) as n from value_change group by entity_id, property_id) group by property_id""",
    "update_frequency_by_type": """select t.entity_type, count(distinct t.entity_id) as num_entities, cast(sum(a.num_updates) as bigint) as total_updates_all_entities,
        round(avg(a.avg_days), 6) as avg_days_between_updates, round(quantile_cont(a.avg_days, 0.5), 6) as median_days_between_updates
      from types_of t join avg_times a on a.entity_id = t.entity_id group by t.entity_type having count(distinct t.entity_id) > 1""",
    "representative_values": "select * from representative",
    "active_entities": "select * from entity_stats where num_value_changes > 20",
    **{f"sample_entities_{kind}": f"""select entity_id, property_id from (select *, row_number() over (partition by property_id
        order by cast('0x' || substr(md5(concat_ws('|', entity_id, property_id, '42')), 1, 13) as bigint), entity_id, property_id) as k
        from {kind}_pairs where entity_id not in ({SANDBOXES})) where k <= 50"""
       for kind in ("static", "irregular")},
    "sampled_changes": """select s.revision_id, s.entity_id, s.entity_label, s.property_id, s.property_label, s.value_id, s.timestamp, s.year, strftime(s.timestamp, '%Y-%m') as year_month,
        s.action, s.label, s.change_type, s.old_value, s.new_value, s.old_datatype, s.new_datatype, s.is_reverted, s.reversion, s.user_type, s.username, s.user_id, s.comment,
        p.citation_needed, s.entity_first_revision_timestamp, coalesce(t.entity_type, '') as entity_type
      from static_changes s left join (select entity_id, min(entity_type) as entity_type from types_of group by entity_id) t on t.entity_id = s.entity_id
      left join prop_ref_rate p on p.property_id = s.property_id""",
    "sampled_changes_for_features": """select v.revision_id, v.entity_id, v.entity_label, v.property_id, v.property_label, v.value_id, v.old_value, v.new_value,
        v.old_datatype, v.new_datatype, v.change_target, v.action, r.timestamp, strftime(r.timestamp, '%Y-%m') as year_month, r.year, v.label, v.change_type, r.user_type,
        r.username, r.user_id, r.comment, e.first_revision_timestamp as entity_first_revision_timestamp, r.prev_edit_on_entity
      from (select entity_id, property_id from (select *, row_number() over (partition by property_id
          order by cast('0x' || substr(md5(concat_ws('|', entity_id, property_id, '42')), 1, 13) as bigint)) as k from static_pairs) where k <= 50) p
      join value_change v on v.entity_id = p.entity_id and v.property_id = p.property_id
      join entity_stats e on e.entity_id = v.entity_id
      join previous_edits r on r.revision_id = v.revision_id where v.change_target = '' and v.action <> 'DELETE'""",
    "limited_static_pairs": """select entity_id, property_id from usable_static_pairs
        order by cast('0x' || substr(md5(concat_ws('|', entity_id, property_id, '42')), 1, 13) as bigint), entity_id, property_id limit 100""",
    "statement_history": f"""select {KEY}, revision_id, timestamp, action, new_value, is_reverted, reversion from value_change
      join (select {KEY} from value_change where change_target = '' group by all order by count(*) desc, {KEY} limit 1) using ({KEY}) where change_target = ''""",
    "imputed_properties": f"select property_id, {', '.join(f'{rounded_double(c, c)} as {c}' for c in ROUTED_FEATURES)} from (select * replace ({', '.join(f'coalesce({c}, 1e15) as {c}' for c in ROUTED_FEATURES)}) from routed)",
    **{name: _encoded(group) for name, group in zip(("encoded_categories", "encoded_categories_registered"), GROUPS)},
    "yeo_johnson_powers": " union all ".join(
        f"select '{shown}' as model, name as feature, num_rows, round(p, 6) as power, round(l, 6) as log_likelihood from {model}_powers"
        for model, shown in (("imputed", "properties"), *zip(GROUPS, GROUPS))),
    "preprocessed_properties": f"select property_id, {_scaled(ROUTED_FEATURES)} from imputed, imputed_line",
    "preprocessed_anonymous": _preprocessed(GROUPS[0]),
    "preprocessed_registered": _preprocessed(GROUPS[1]),
    "text_vectors": "select property_id, array_to_string(list_transform(embedding, lambda x: printf('%.4f', x)), ',') as embedding from text_embeddings",
    "text_knn4": "select property_id, cast(rank as integer) as rank, round(similarity, 6) as similarity from text_nearest4",
    "csv_round_trip": "select * from value_change",
    "result_round_trip": f"select {TARGETS} from labelled",
    "appended_entities": "select entity_id, num_value_changes from entity_stats",
    "sampled_references": f"""select c.*, {', '.join(f's.{x} as change_{x}' for x in CONTEXT)}
      from reference_change c asof join static_changes s
        on c.entity_id = s.entity_id and c.property_id = s.property_id and c.value_id = s.value_id and c.timestamp >= s.timestamp""",
    "prev_edit_on_entity": "select * from previous_edits",
    "knn4": "select property_id, cast(rank as integer) as rank, round(similarity, 6) as similarity from nearest4",
    "knn4_lists": """select property_id, string_agg(nn_property_id, ',' order by rank) as nearest_property_ids,
        string_agg(nn_property_label, ',' order by rank) as nearest_property_labels, string_agg(nn_property_type, ',' order by rank) as nearest_property_types,
        string_agg(printf('%.4f', similarity), ',' order by rank) as nearest_similarities from nearest4 group by property_id""",
    "nearest_non_self": rounded("nearest_other", "nn_sim"),
    "nn_accuracy": """select grouping, value, count(*) as num_properties, cast(sum(hit) as bigint) as num_correct, round(avg(hit), 6) as accuracy from (
        select 'overall' as grouping, 'all' as value, hit from judged union all select 'property_type', property_type, hit from judged
        union all select 'sim_bucket', bucket, hit from judged where bucket is not null) group by grouping, value""",
    "final_property_type": """select property_id, property_label, property_type,
        case when property_type <> '' then property_type when property_label like '% ID%' then 'static' end as final_property_type from properties""",
    "balanced_id_sample": """select property_id, property_label, property_type from (select *, case when chosen then h <= quantile_cont(h, 0.6) over (partition by chosen) end as kept
      from (select *, property_type = 'static' and property_label like '% ID%' as chosen,
          cast(cast('0x' || substr(md5(concat_ws('|', property_id, '42')), 1, 13) as bigint) as double) as h from properties where property_type <> ''))
      where not chosen or kept""",
    "search_folds": _fold_sizes("model_rows where split = 'train'", "target_to_predict", "model_group, ", "revision_id, entity_id, property_id, value_id, change_target"),
    "search_folds_properties": _fold_sizes("""(select *, h <= quantile_cont(h, 0.2) over (partition by is_static) as tested
        from (select * from (select *, case when chosen then h <= quantile_cont(h, 0.6) over (partition by chosen) end as kept
          from (select property_id, cast(property_type = 'static' as int) as is_static, property_type = 'static' and property_label like '% ID%' as chosen,
            cast(cast('0x' || substr(md5(concat_ws('|', property_id, '42')), 1, 13) as bigint) as double) as h from routed where property_type <> ''))
          where not chosen or kept)) where not tested""", "is_static", "", "property_id"),
    "stratified_test_set": """select property_id, property_type from (select *, row_number() over (partition by property_type order by h) as k,
          count(*) over (partition by property_type) as n
        from (select *, cast('0x' || substr(md5(concat_ws('|', property_id, '42')), 1, 13) as bigint) as h from properties where property_type <> ''))
      where k <= ceil(n / 5)""",
    "properties_per_type_sample": """select property_id, property_type from (select *, row_number() over (partition by property_type
        order by cast('0x' || substr(md5(concat_ws('|', property_id, '42')), 1, 13) as bigint)) as k from properties where property_type <> '') where k <= 30""",
    "constraint_types": """select t.s as "constraint", l.o as label, d.o as description from triples t join english_labels l on l.s = t.s
      join english_descriptions d on d.s = t.s where t.p = 'wdt:P279' and t.o = 'wd:Q21502402'""",
    "constraints_range": """select c.property, c.property_label, c.property_description, lo.o as minimum_value, hi.o as maximum_value, c.constraint_status_label
      from constrained c join triples lo on lo.s = c.statement and lo.p = 'pq:P2313' join triples hi on hi.s = c.statement and hi.p = 'pq:P2312'
      where c.kind = 'wd:Q21510860'""",
    "constraints_integer": """select property, property_label, property_description, constraint_status_label from constrained where kind = 'wd:Q52848401'""",
    "constraints_time_qualifier": """select st.property, l.o as property_label, st.kind as constraint_type, q.o as qualifier, ql.o as qualifier_label
      from statements st join classes c on c.s = st.property join english_labels l on l.s = st.property
      join triples q on q.s = st.statement and q.p = 'pq:P2306' join english_labels ql on ql.s = q.o
      where q.o in ('wd:P585', 'wd:P580', 'wd:P582')""",
    "property_metadata": """select c.s as property, t.o as property_data_type, l.o as property_label,
        coalesce((select string_agg(distinct a.o, ', ' order by a.o) from triples a where a.s = c.s and a.p = 'skos:altLabel' and a.o_lang = 'en'), '') as aliases,
        d.o as property_description, f.o as frequency_update, fl.o as frequency_update_label,
        exists (select 1 from triples n where n.s = c.s and n.p = 'wdt:P1552' and n.o = 'wd:Q93868746') as has_characteristic_num_id
      from classes c join triples t on t.s = c.s and t.p = 'wikibase:propertyType' join english_labels l on l.s = c.s join english_descriptions d on d.s = c.s
      left join (select s, o from triples where p = 'wdt:P2668') f on f.s = c.s left join english_labels fl on fl.s = f.o""",
    "id_properties": r"""select distinct regexp_extract(c.s, '([QP]\d+)$', 1) as property_id, l.o as property_label, t.o as datatype
      from classes c join english_labels l on l.s = c.s left join triples t on t.s = c.s and t.p = 'wikibase:propertyType'
      where t.o = 'wikibase:ExternalId' or exists (select 1 from triples n where n.s = c.s and n.p = 'wdt:P1552' and n.o = 'wd:Q93868746')
        or (regexp_matches(l.o, '\bID\b', 'i') and exists (select 1 from triples x where x.s = c.s and x.o_lang = 'en'
          and x.p in ('schema:description', 'skos:altLabel') and regexp_matches(x.o, 'identif|code|id', 'i')))""",
    "property_stability": """select t.s as property, l.o as property_label, t.o as stability_value, v.o as stability_value_label
      from triples t join english_labels l on l.s = t.s join english_labels v on v.s = t.o where t.p = 'wdt:P2668'""",
    "sameas_links": """select e.entity_id, e.entity_label, e.entity_type, e.type_numeric_id, replace(t.s, 'dbr:', '') as dbpedia_id, t.s as dbpedia, t.o as wikidata
      from linked_entities e left join (select * from triples where p = 'owl:sameAs') t on t.o = concat('wd:Q', e.entity_id)""",
    "sparql_bindings": "select s as dbpedia, o as wikidata from triples where p = 'owl:sameAs'",
    "change_prompts": f"select revision_id, {', '.join(f'prompt_{name}' for name in SETTINGS)} from shown_changes",
    "reference_prompts": f"select revision_id, {', '.join(f'{_without_shares(name)} as prompt_{name}' for name in SETTINGS)} from shown_changes",
    "judged_changes": "select revision_id, label, change_type from full_features where judged",
    "first_judged_changes": """select revision_id, label, change_type from (select *, row_number() over (partition by label = 'statement_insertion'
        order by timestamp, revision_id, entity_id, property_id, value_id) as k from full_features where judged) where k <= 100""",
    "change_scores": f"""select revision_id, {', '.join(
        f"case when comment not like '/* wbsetclaim%' or comment is null then {v} end as {d}_{part}_{name}" for d in ('accuracy', 'needs_reference') for name, lines in LINES.items()
        for part, v in (('score', "cast(case when action = 'CREATE' then 5 when coalesce(comment, '') = '' then 2 else 4 end as double)"), ('explanation', f"'{lines} lines'")))},
        {', '.join(f"case when comment like '/* wbsetclaim%' then 'ValueError: unreadable comment' end as {d}_error_{name}" for d in ('accuracy', 'needs_reference') for name in LINES)}
      from full_features where judged""",
    "property_prompts": "select property_id, prompt from prompted",
    "property_type_accuracy": """select case when grouping(property_type) = 1 then '(all)' else property_type end as property_type, count(*) as num_properties,
        count_if(hit) as num_correct, round(avg(cast(hit as integer)), 6) as accuracy
      from (select property_type, property_type = case when quiet then 'static' when prompt like '%they hold.' then 'regular' else 'irregular' end as hit
        from prompted where property_type <> '' and property_label not like '% ID%') group by rollup(property_type)""",
}


def statements() -> dict[str, str]:
    return {name: complete(body) for name, body in BODIES.items()}
