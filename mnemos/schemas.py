"""Closed vocabularies, the schema of the change log, and what rows of the typed tables must hold."""

#: What a change event may be about, and what it may say.
CHANGE_OBJECTS = (
    "record relation link candidate tier_transition block memory_block view canvas schema entity entity_alias fact contradiction entity_summary episode episode_step outcome decision procedure raw_episode "
    "fact_convergence_link ontology lifecycle_policy artifact artifact_projection sync_conflict freshness_entry source_registry source_ingest shared_block_attachment shared_block_mirror shared_block_conflict "
    "shared_block_usage active_embedding_model_set embedding retention_snapshot"
).split()
CHANGE_OPERATIONS = ("put", "delete", "import")
#: Types, sources, tiers, relation types and link kinds.
MEMORY_TYPES = (
    "pin decision task fact procedure artifact_digest plan_snapshot summary session_summary meta_insight user_preference project_convention correction tool_habit tool_outcome strategy_outcome "
    "post_completion_critique meta_rule_preference consolidated_knowledge declared_goal goal_revision"
).split()
SOURCES = ("user_said", "tool_output", "agent_inferred", "validated", "imported")
TIERS = ("working", "archival")
RELATION_TYPES = ("related_to", "depends_on", "supports", "corrects")
LINK_KINDS = ("wikilink", "markdown", "embed", "property", "external")
LINK_STATUSES = ("resolved", "unresolved", "ambiguous", "external")

CHANGES = "cursor long, event_id string, object_type string, object_id string, operation string, changed_at timestamp, payload string, user_id string, idempotency_key string"


def violations(**rules):
    """array<string> of the names of the rules (Columns) that a row breaks; a rule that is null counts as broken."""
    from pyspark.sql import functions as F

    return F.array_compact(F.array(*(F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(name)) for name, ok in rules.items())))


def _among(column, allowed):
    from pyspark.sql import functions as F

    return F.col(column).isin(list(allowed))


def record_violations():
    """Rules that a record breaks: id, type, source, tier, confidence from 0 to 1, and an end after its beginning."""
    from pyspark.sql import functions as F

    return violations(
        id=F.col("id") != "",
        type=_among("type", MEMORY_TYPES),
        source=_among("source", SOURCES),
        tier=_among("tier", TIERS),
        confidence=F.col("confidence").isNull() | F.col("confidence").between(0, 1),
        valid_to=F.col("valid_to").isNull() | (F.col("valid_to") >= F.col("created_at")),
    )


def change_violations():
    """Rules that a change event breaks: a cursor, an object of a known type, a known operation."""
    from pyspark.sql import functions as F

    return violations(cursor=F.col("cursor") > 0, object_type=_among("object_type", CHANGE_OBJECTS), object_id=F.col("object_id") != "", operation=_among("operation", CHANGE_OPERATIONS))


def edge_violations():
    """Rules that a link (link_kind, resolution_status) or relation (relation_type) breaks; a resolved link has a target and others have none."""
    from pyspark.sql import functions as F

    return violations(
        relation_type=F.col("relation_type").isNull() | _among("relation_type", RELATION_TYPES),
        link_kind=F.col("link_kind").isNull() | _among("link_kind", LINK_KINDS),
        resolution_status=F.col("resolution_status").isNull() | _among("resolution_status", LINK_STATUSES),
        target=(F.coalesce(F.col("resolution_status"), F.lit("resolved")) == "resolved") == F.col("target_record_id").isNotNull(),
    )
