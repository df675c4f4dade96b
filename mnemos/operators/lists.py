"""Lists of the typed tables: which columns filter them, what is left out, and in which order they come.

Every list is a filter, a total order and a limit, which Spark runs as a top-n. A filter that is None doesn't filter.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.operators.records import listed


@dataclass(frozen=True)
class Kind:
    """order: columns, a leading - for descending; equal and among: columns that are compared with one value or several; holds: array
    columns that must hold a value, by filter name; since and until: the column that a time window is over; ended: columns that, if
    one is set, end a row, which is then left out unless `include_invalidated`."""

    order: tuple[str, ...]
    equal: tuple[str, ...] = ()
    among: tuple[str, ...] = ()
    holds: tuple[tuple[str, str], ...] = ()
    time: str | None = None
    ended: tuple[str, ...] = ()


KINDS = {
    "candidate": Kind(("-touched_at", "candidate_id"), ("session_id", "scope"), ("status",)),
    "tier_transition": Kind(("-transition_at", "transition_id"), ("record_id",), ("scope",)),
    "document_block": Kind(("record_id", "line", "block_id"), ("record_id", "document_id", "block_id")),
    "memory_block": Kind(("class_name", "created_at", "block_id"), (), ("class_name",)),
    "embedding": Kind(("-updated_at", "record_id", "vector_space"), ("record_id", "vector_space", "provider", "model")),
    "active_model_set": Kind(("namespace_key", "vector_space"), ("vector_space",)),
    "entity": Kind(("canonical_name", "entity_id"), ("canonical_name", "entity_type"), ended=("invalidated_at", "superseded_by_entity_id")),
    "entity_alias": Kind(("alias_name", "alias_id"), ("entity_id", "alias_name")),
    "contradiction": Kind(("decided_at", "contradiction_id"), ("target_fact_id", "contradicting_fact_id")),
    "entity_summary": Kind(("-touched_at", "summary_id"), ("entity_id",), ended=("invalidated_at",)),
    "episode": Kind(("-started_at", "-episode_id"), ("status", "task_id"), holds=(("artifact_id", "artifact_ids"), ("tool_id", "tool_ids")), time="started_at"),
    "episode_step": Kind(("sequence", "step_id"), ("episode_id", "kind")),
    "outcome": Kind(("-occurred_at", "-outcome_id"), ("episode_id", "step_id", "status")),
    "decision": Kind(("-occurred_at", "-decision_id"), ("episode_id",)),
    "procedure": Kind(("-touched_at", "-procedure_id"), ("promotion_tier",), ended=("invalidated_at",)),
    "raw_episode": Kind(("-occurred_at", "-episode_id"), ("kind", "source"), time="occurred_at", ended=("invalidated_at",)),
    "fact_convergence_link": Kind(("created_at", "link_id"), ("fact_id", "converged_fact_id")),
    "ontology": Kind(("ontology_id", "version"), ("ontology_id",)),
    "artifact": Kind(("artifact_id",), ("kind",)),
    "artifact_projection": Kind(("artifact_id", "created_at", "projection_id"), ("artifact_id", "kind")),
    "canvas_board": Kind(("board_id",)),
    "lifecycle_policy": Kind(("policy_id",)),
    "retention_snapshot": Kind(("namespace_key", "name", "created_at")),
    "sync_conflict": Kind(("conflict_id",), ("status", "path")),
    "freshness_entry": Kind(("source_id",), ("source_id", "status")),
    "source": Kind(("source_id",), ("connector", "status")),
    "shared_block_attachment": Kind(("block_id", "attachment_id"), ("block_id", "workspace_id")),
}
#: Kinds whose order is by the last change, or the creation where there was none, and by the line, or 0 where there is none.
DERIVED = {"touched_at": lambda: F.coalesce("updated_at", "created_at"), "line": lambda: F.coalesce("line_start", F.lit(0))}


def listing(df: DataFrame, kind: str, /, limit: int | None = None, offset: int = 0, namespaces: list | None = None, include_invalidated: bool = False, after: str | None = None, before: str | None = None, **filters) -> DataFrame:
    """The rows of a table of this kind. after and before: bounds of its time, both inclusive. A filter that the kind has not is an error."""
    k = KINDS[kind]
    known = {*k.equal, *k.among, *(name for name, _ in k.holds)}
    if unknown := set(filters) - known:
        raise ValueError(f"{kind} has no filters {sorted(unknown)}")
    where: Column = F.lit(True)
    for name, column in k.holds:
        if filters.get(name) is not None:
            where = where & F.array_contains(column, filters[name])
    if k.ended and not include_invalidated:
        where = where & F.coalesce(*(F.col(c).cast("string") for c in k.ended)).isNull()
    if after is not None:
        where = where & (F.col(k.time) >= after)
    if before is not None:
        where = where & (F.col(k.time) <= before)
    derived = [c.lstrip("-") for c in k.order if c.lstrip("-") in DERIVED]
    order = [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in k.order]
    out = listed(
        df.withColumns({c: DERIVED[c]() for c in derived}),
        order,
        equal={c: filters.get(c) for c in k.equal},
        among={c: filters.get(c) for c in k.among},
        namespaces=namespaces,
        where=where,
        limit=limit,
        offset=offset,
    )
    return out.drop(*derived)


def fresh_blocks(df: DataFrame, now: str) -> DataFrame:
    """Memory blocks that aren't stale at `now`."""
    return df.where(F.col("stale_after").isNull() | (F.col("stale_after") > now))


def orphan_vector_ids(history: DataFrame, current: DataFrame, since: str | None = None) -> DataFrame:
    """(external_vector_id, last_seen_at): ids that an embedding had once and that none in its namespace has now, by time and id.

    history: every version (namespace_key, external_vector_id, updated_at); current: what stands now. Partial sums keep an id's versions apart.
    """
    seen = history.where("external_vector_id <> ''").groupBy("namespace_key", "external_vector_id").agg(F.max("updated_at").alias("last_seen_at"))
    gone = seen.join(current.select("namespace_key", "external_vector_id"), ["namespace_key", "external_vector_id"], "left_anti")
    gone = gone if since is None else gone.where(F.col("last_seen_at") >= since)
    return gone.orderBy("last_seen_at", "external_vector_id")
