"""Lists of the kinds of rows that episodes, vectors, artifacts, policies and synchronisation leave behind, each with the SQL that gives the same rows."""

from pyspark.sql import DataFrame

from mnemos.operators import lists
from mnemos.plans.typed_queries import made

QUERIES, ORACLES = {}, {}


def _list(name: str, kind: str, rows: str, columns: str, where: str, order: str, limit: int = 60, /, **options) -> None:
    """Registers the list of a kind over rows (SQL that Spark and DuckDB read); where and order are what its options must come to."""

    def of(spark, sf) -> DataFrame:
        return lists.listing(made(spark, sf, rows), kind, limit=limit, **options).select(*columns.split(", "))

    of.__name__ = name
    QUERIES[name] = of
    ORACLES[name] = f"WITH x AS ({rows}) SELECT {columns} FROM x WHERE {where} ORDER BY {order} LIMIT {limit}"


_ENDED = "CASE WHEN {} THEN 'ended' END AS invalidated_at"

_list(
    "list_embeddings", "embedding",
    "SELECT 'doc-' || (vec_id % 300) AS record_id, 'space-' || label AS vector_space, CASE WHEN vec_id % 3 = 0 THEN 'alpha' ELSE 'beta' END AS provider, 'm' || (vec_id % 4) AS model, vec_id % 90 AS updated_at FROM embeddings",
    "record_id, vector_space, updated_at", "provider = 'beta' AND model = 'm2'", "updated_at DESC, record_id, vector_space", provider="beta", model="m2",
)
_list(
    "list_entity_aliases", "entity_alias", "SELECT 'al-' || o_orderkey AS alias_id, 'en-' || (o_custkey % 40) AS entity_id, 'Alias ' || (o_orderkey % 90) AS alias_name FROM orders",
    "alias_id, alias_name", "entity_id = 'en-7'", "alias_name, alias_id", entity_id="en-7",
)
_list(
    "list_contradictions", "contradiction",
    "SELECT 'co-' || o_orderkey AS contradiction_id, 'fact-' || (o_custkey % 60) AS target_fact_id, 'fact-' || o_orderkey AS contradicting_fact_id, o_orderdate AS decided_at FROM orders WHERE o_orderstatus <> 'P'",
    "contradiction_id, contradicting_fact_id", "target_fact_id = 'fact-9'", "decided_at, contradiction_id", target_fact_id="fact-9",
)
_list(
    "list_episode_steps", "episode_step",
    "SELECT 'st-' || conv_id || '-' || turn AS step_id, 'ep-' || (conv_id % 25) AS episode_id, turn AS sequence, CASE role WHEN 'user' THEN 'user_input' ELSE 'tool_result' END AS kind FROM conversations",
    "step_id, sequence", "episode_id = 'ep-11' AND kind = 'tool_result'", "sequence, step_id", episode_id="ep-11", kind="tool_result",
)
_list(
    "list_decisions", "decision", "SELECT 'de-' || conv_id || '-' || turn AS decision_id, 'ep-' || (conv_id % 30) AS episode_id, turn * 100 + conv_id % 10 AS occurred_at FROM conversations WHERE role <> 'user'",
    "decision_id, occurred_at", "episode_id = 'ep-3'", "occurred_at DESC, decision_id DESC", episode_id="ep-3",
)
_PROCEDURES = f"SELECT 'pr-' || p_partkey AS procedure_id, p_brand AS promotion_tier, p_size AS created_at, CASE WHEN p_size % 3 = 0 THEN p_size + 30 END AS updated_at, {_ENDED.format('p_retailprice < 930')} FROM part"
_list("list_procedures", "procedure", _PROCEDURES, "procedure_id", "promotion_tier = 'Brand#1' AND invalidated_at IS NULL", "coalesce(updated_at, created_at) DESC, procedure_id DESC", promotion_tier="Brand#1")
_list("list_all_procedures", "procedure", _PROCEDURES, "procedure_id, invalidated_at", "TRUE", "coalesce(updated_at, created_at) DESC, procedure_id DESC", 45, include_invalidated=True)
_list(
    "list_raw_episodes", "raw_episode",
    f"SELECT 'ra-' || event_id AS episode_id, event_type AS kind, 'user-' || (user_id % 9) AS source, ts AS occurred_at, {_ENDED.format('value > 90')} FROM events",
    "episode_id, kind", "kind = 'purchase' AND source = 'user-4' AND occurred_at >= TIMESTAMP '2024-01-03 00:00:00' AND occurred_at <= TIMESTAMP '2024-01-20 00:00:00' AND invalidated_at IS NULL", "occurred_at DESC, episode_id DESC",
    kind="purchase", source="user-4", after="2024-01-03 00:00:00", before="2024-01-20 00:00:00",
)
_list(
    "list_convergence_links", "fact_convergence_link", "SELECT 'cl-' || l_orderkey || '-' || l_partkey || '-' || l_linenumber AS link_id, 'fact-' || (l_partkey % 50) AS fact_id, 'fact-' || l_orderkey AS converged_fact_id, l_shipdate AS created_at FROM lineitem WHERE l_returnflag = 'A'",
    "link_id, converged_fact_id", "fact_id = 'fact-12'", "created_at, link_id", 40, fact_id="fact-12",
)
_list("list_ontologies", "ontology", "SELECT 'on-' || (p_partkey % 40) AS ontology_id, '1.' || p_size || '.' || p_partkey AS version FROM part", "ontology_id, version", "ontology_id = 'on-21'", "ontology_id, version", ontology_id="on-21")
_list(
    "list_artifact_projections", "artifact_projection",
    "SELECT 'pj-' || o_orderkey AS projection_id, 'as-' || (o_custkey % 70) AS artifact_id, CASE o_orderstatus WHEN 'F' THEN 'text' ELSE 'summary' END AS kind, o_orderdate AS created_at FROM orders",
    "projection_id, kind", "artifact_id = 'as-5' AND kind = 'summary'", "artifact_id, created_at, projection_id", artifact_id="as-5", kind="summary",
)
_list("list_canvas_boards", "canvas_board", "SELECT 'bo-' || c_custkey AS board_id, c_name AS title FROM customer", "board_id, title", "TRUE", "board_id", 30)
_list("list_lifecycle_policies", "lifecycle_policy", "SELECT 'po-' || s_suppkey AS policy_id, s_name AS name FROM supplier", "policy_id, name", "TRUE", "policy_id", 20)
_list(
    "list_retention_snapshots", "retention_snapshot", "SELECT 'ns' || (o_custkey % 6) AS namespace_key, 'before-' || o_orderpriority AS name, o_orderdate AS created_at, o_orderkey AS snapshot FROM orders WHERE o_totalprice > 250000",
    "namespace_key, name, created_at", "TRUE", "namespace_key, name, created_at", 50,
)
_list("list_freshness_entries", "freshness_entry", "SELECT 'so-' || page_id AS source_id, CASE WHEN length(html) % 3 = 0 THEN 'stale' ELSE 'fresh' END AS status, url FROM pages", "source_id, url", "status = 'stale'", "source_id", 40, status="stale")
_list("list_sources", "source", "SELECT 'so-' || page_id AS source_id, split_part(url, '://', 1) AS connector, CASE WHEN length(html) % 2 = 0 THEN 'active' ELSE 'paused' END AS status FROM pages", "source_id, connector", "status = 'active' AND connector = 'https'", "source_id", 40, status="active", connector="https")
_list("list_shared_attachments", "shared_block_attachment", "SELECT 'mb-' || l_partkey AS block_id, 'at-' || l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS attachment_id, 'ws-' || (l_suppkey % 8) AS workspace_id FROM lineitem WHERE l_quantity > 45", "block_id, attachment_id", "workspace_id = 'ws-6'", "block_id, attachment_id", 50, workspace_id="ws-6")
