"""Context packages in one call: a mode's items under its budget, what was left out and why, and what was asked."""

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemos.operators import context
from mnemos.operators.facts import list_facts
from mnemos.operators.records import structural_search

#: The modes of a package.
MODES = ("local_graph", "structural_search", "temporal_fact", "hybrid", "global", "drift")


class Package(NamedTuple):
    """items: id, kind, score, snippet, position (from 1). omitted: id, kind, reason. provenance: what was asked, by name."""

    items: DataFrame
    omitted: DataFrame
    provenance: dict


def _placed(found: DataFrame, limit: int, order: list) -> DataFrame:
    """The first rows with their position from 0; the window runs over `limit` rows at most."""
    return found.orderBy(*order).limit(limit).withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1)


def _mode_items(mode: str, tables: dict, request: dict, most: int, chars: int) -> DataFrame:
    """(id, kind, score, snippet, position, included) of a mode."""
    r = request
    if mode == "local_graph":
        seeds = tables["records"].sparkSession.createDataFrame([(x, i) for i, x in enumerate(r["seeds"])], "id string, position int")
        edges = tables["edges"] if r.get("relation_types") is None else tables["edges"].where(F.col("relation_type").isin(list(r["relation_types"])))
        near = context.local_context(tables["records"], seeds, edges, r.get("max_paths", 50), most)
        return near.join(tables["records"].select("id", "content"), "id").select("id", F.lit("record").alias("kind"), "score", F.left("content", F.lit(chars)).alias("snippet"), "position", "included")
    if mode in ("structural_search", "hybrid"):
        limit = r.get("limit", 50)
        found = structural_search(tables["records"], tables.get("links"), tables.get("blocks"), **r.get("conditions", {}))
        top = _placed(found, limit, r.get("order", [F.desc("updated_at"), F.col("id")])).select("id", "content", "position")
        if mode == "structural_search":
            return context.search_context(top, limit, most, chars)
        none = top.limit(0).select("id", F.lit(0.0).alias("value"))
        no_facts = top.limit(0).select(F.col("id").alias("fact_id"), F.col("id").alias("record_id"), F.lit(0.0).alias("confidence"))
        return context.hybrid_context(top, tables.get("vector_scores", none), tables.get("facts_of_records", no_facts), limit, most, chars)
    if mode == "temporal_fact":
        return context.fact_context(list_facts(tables["facts"], **r.get("conditions", {})), most)
    wanted = tables["summaries"].sparkSession.createDataFrame([(i, x) for i, x in enumerate(r.get("summaries", []))], "position int, summary_id string")
    if mode == "global":
        return context.summary_references(wanted, tables["summaries"], most)
    return context.drift_context(tables["steps"], wanted, tables["summaries"], tables["records"], most)


def assemble_context(mode: str, tables: dict[str, DataFrame], request: dict, max_items: int, max_chars: int = 400, communities: DataFrame | None = None, community_omissions: DataFrame | None = None) -> Package:
    """The package of a mode. Raises ValueError for an unknown mode.

    tables and request by mode: local_graph: records, edges; seeds, max_paths, relation_types. structural_search: records, links, blocks; conditions of structural_search,
    limit. temporal_fact: facts; conditions of list_facts. hybrid: as structural_search, and vector_scores (id, value) and facts_of_records (fact_id, record_id, confidence).
    global: summaries; summaries (ids). drift: summaries, records, steps (step, kind, id); summaries. What exceeds the budget is omitted as budget_exceeded. communities: (id, kind, score,
    snippet, position) of a community query, put after the mode's items under the same budget; community_omissions: (reason, count), each one omission.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    items = _mode_items(mode, tables, request, max_items, max_chars).withColumn("position", F.col("position").cast("string"))
    first = items.select("id", "kind", "score", "snippet", F.col("position").alias("_p"), "included")
    if mode in ("temporal_fact",):
        order = [F.col("_p"), F.col("id")]
    elif mode == "hybrid":
        order = [F.desc("score"), F.when(F.col("kind") == "record", 0).otherwise(1), F.col("_p").cast("long"), F.col("id")]
    else:
        order = [F.col("_p").cast("long"), F.col("id")]
    inside = first.where("included").orderBy(*order).limit(max_items)
    placed = inside.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long")).select("id", "kind", "score", "snippet", "position")  # of max_items rows
    over = first.where(~F.col("included")).select("id", "kind", F.lit("budget_exceeded").alias("reason"))
    if communities is not None:
        merged = context.with_communities(placed.withColumn("included", F.lit(True)), communities, max_items)
        both = merged.join(placed.select("id", "kind", F.lit(0).alias("_late")), ["id", "kind"], "left").withColumn("_late", F.coalesce("_late", F.lit(1)))
        over = over.unionByName(both.where(~F.col("included")).select("id", "kind", F.lit("budget_exceeded").alias("reason")))
        order = ["_late", "position", "id"]
        placed = both.where("included").withColumn("_n", F.row_number().over(Window.orderBy(*order)).cast("long")).select("id", "kind", "score", "snippet", F.col("_n").alias("position"))
    if community_omissions is not None:
        over = over.unionByName(community_omissions.select(F.concat(F.lit("community:"), "reason").alias("id"), F.lit("community").alias("kind"), F.lit("adapter_omitted").alias("reason")))
    return Package(placed, over, {"mode": mode, "max_items": max_items, "community_query_attached": communities is not None} | {k: v for k, v in request.items() if isinstance(v, (str, int, list, tuple, dict))})


def community_packet(labels: DataFrame, communities: DataFrame, records: DataFrame, edges: DataFrame, query: str | None = None, limit: int = 20, least: int = 2, hidden: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Communities that a query finds, by size and label, and what was left out: (reason, count).

    labels: node_id, label; communities: label, size, seed; records: id, title, content, updated_at, source_id; hidden: ids that may not be told. A community is found if it has a
    member with the query in title or content, without case (every one without a query). Left out: hidden records, communities below `least`, those without a hit and those past the limit.
    """
    shown = records if hidden is None else records.join(hidden.select("id"), "id", "left_anti")
    gone = records.join(hidden.select("id"), "id", "left_semi").count() if hidden is not None else 0
    needle = (query or "").strip().lower()
    hit = F.lower(F.concat_ws("\n", "title", "content")).contains(needle) if needle else F.lit(True)
    members = labels.join(shown.where(hit).select(F.col("id").alias("node_id")), "node_id").groupBy("label").agg(F.count("*").alias("hits"), F.min("node_id").alias("first_hit"))
    j = communities.join(members, "label", "left")
    reason = F.when(F.col("size") < least, "below_minimum_size").when(F.col("hits").isNull(), "no_match")
    judged = j.withColumn("_reason", reason)
    found = judged.where("_reason is null").orderBy(F.desc("size"), "label")
    kept = found.limit(limit).select("label", "size", "seed", "hits", "first_hit")
    past = found.groupBy().agg(F.greatest(F.lit(0), F.count("*") - limit).alias("count")).select(F.lit("limit").alias("reason"), "count")
    counts = judged.where("_reason is not null").groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("count"))
    hidden_row = records.sparkSession.range(1).select(F.lit("hidden_record").alias("reason"), F.lit(gone).cast("long").alias("count"))
    return kept, counts.unionByName(past).unionByName(hidden_row).where("count > 0")


def entity_context(requests: DataFrame, summaries: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(entity_id, summary_id, text, redacted) of the newest usable summary of each entity asked for (position, entity_id), and (entity_id, reason) of the others.

    summaries: summary_id, entity_id, text, touched_at, invalidated, visibility, denied, redacted. A redacted summary is given without its text. An entity whose summaries are all
    unusable has the reason of the newest; one without any is not_found; what exceeds `most` entities, in order of position, is budget_exceeded.
    """
    asked = requests.groupBy("entity_id").agg(F.min("position").alias("position"))
    reason = F.when(F.col("invalidated"), "invalidated").when(F.col("visibility").isin("hidden", "audit_only"), F.col("visibility")).when(F.col("denied"), "denied")
    newest = F.struct("touched_at", "summary_id", "text", "redacted", reason.alias("reason"))
    best = summaries.join(asked.select("entity_id"), "entity_id", "left_semi").groupBy("entity_id").agg(F.max(F.when(reason.isNull(), newest)).alias("_good"), F.max(newest).alias("_any"))
    j = asked.join(best, "entity_id", "left").withColumn("_why", F.when(F.col("_any").isNull(), "not_found").when(F.col("_good").isNull(), F.col("_any.reason")))
    kept = j.where("_why is null").orderBy("position", "entity_id").limit(most)
    text = F.when(~F.coalesce(F.col("_good.redacted"), F.lit(False)), F.col("_good.text"))
    good = kept.select("entity_id", F.col("_good.summary_id").alias("summary_id"), text.alias("text"), F.coalesce(F.col("_good.redacted"), F.lit(False)).alias("redacted"))
    over = j.where("_why is null").join(kept.select("entity_id"), "entity_id", "left_anti").select("entity_id", F.lit("budget_exceeded").alias("reason"))
    return good, j.where("_why is not null").select("entity_id", F.col("_why").alias("reason")).unionByName(over)


def federated_packet(hits: DataFrame, asked: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Hits of several workspaces with each record once, and what was left out (workspace, reason, count).

    hits: workspace, position, id, score; asked: (workspace, available). Unavailable workspaces are left out whole, later hits of a record as duplicate, those past the limit as limit;
    a workspace that was asked and gave nothing is empty.
    """
    there = asked.where("available").select("workspace")
    mine = hits.join(there, "workspace", "left_semi")
    kept = context.federated(mine, limit)
    firsts = mine.groupBy("id").agg(F.min(F.struct("workspace", "position")).alias("_f")).select(F.col("_f.workspace").alias("workspace"), F.col("_f.position").alias("position"), "id")
    again = mine.join(firsts, ["workspace", "position", "id"], "left_anti").groupBy("workspace").agg(F.count("*").alias("count")).select("workspace", F.lit("duplicate").alias("reason"), "count")
    past = firsts.join(kept.select("workspace", "position", "id"), ["workspace", "position", "id"], "left_anti").groupBy("workspace").agg(F.count("*").alias("count")).select("workspace", F.lit("limit").alias("reason"), "count")
    empty = there.join(hits.select("workspace"), "workspace", "left_anti").select("workspace", F.lit("empty").alias("reason"), F.lit(0).cast("long").alias("count"))
    shut = asked.where(~F.col("available")).select("workspace", F.lit("unavailable").alias("reason"), F.lit(0).cast("long").alias("count"))
    return kept, again.unionByName(past).unionByName(empty).unionByName(shut)
