"""Fixed values of the knowledge base: types, keywords, ids and thresholds."""

# Datatypes whose values are entities.
ENTITY_DATATYPES = ["wikibase-item", "wikibase-entityid", "wikibase-property", "wikibase-lexeme", "wikibase-sense",
                    "wikibase-form", "entity-schema"]

# Words in a comment that announce a repair. The leading space keeps "prefix" out.
REPAIR_KEYWORDS = [" fix", "correct", "improve", "repair", "clean", "error", "wrong", "mistake"]

# Sandbox entities, edited for practice only.
SANDBOX_ENTITIES = [4115189, 112795079, 15397819, 13406268, 17339402, 16943273]

# Change types that become one 0/1 column each.
CHANGE_TYPES = ["property_value_update", "refinement", "unrefinement", "re_formatting", "textual_change", "link_change",
                "statement_insertion", "statement_deletion"]

USER_TYPES = ["human", "bot", "anonymous"]
PSEUDO_PROPERTIES = [-1, -2]  # label and description
UNKNOWN_VALUES = "unknown-values"

TEMPORAL_QUALIFIERS = [585, 580]  # point in time, start time
IMPORTED_FROM_WIKIPEDIA = 143
DEPRECATION_REASON = 2241
UNRELIABLE_SOURCE = "Q22979588"

CLOSE_IN_TIME_SECONDS = 3600
NO_NEXT_EDIT_DAYS = 13 * 365  # longest history observed
REJECTION_DAYS = 6 * 30.44
TRAINING_CUTOFF = "2022-05-01 00:00:00"
DUMP_TIME = "2025-06-01 00:00:00"
NEVER_CHANGES = 1e15  # stands for "no update" in time features

# Columns carried along with the features of a change.
BASE_COLUMNS = ["timestamp", "revision_id", "entity_id", "entity_label", "property_id", "property_label", "value_id",
                "old_value", "new_value", "old_value_label", "new_value_label", "action", "user_id", "username", "comment",
                "old_datatype", "new_datatype", "change_type", "label"]
