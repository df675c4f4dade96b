"""Exploring records: filters, hits with excerpts, mentions that aren't links yet, pages, and packets of all that."""

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.functions.shared import settled
from mnemos.operators.graph import degrees, local_graph, neighbours, planned, shortest_paths, visible
from mnemos.operators.needles import met
from mnemos.operators.vault import stable_id

#: Least characters of a name that is looked for, and characters that a name is first looked up by.
LEAST = 3


# Properties of a record come from three maps; the last one that has a key wins.


def _merged(*maps: Column) -> Column:
    """Maps joined, later ones over earlier ones; null counts as empty."""
    out = F.create_map().cast("map<string,string>")
    for m in maps:
        out = _over(out, F.coalesce(m, F.create_map().cast("map<string,string>")))
    return out


def _over(low: Column, high: Column) -> Column:
    kept = F.filter(F.map_entries(low), lambda e: ~F.array_contains(F.map_keys(high), e["key"]))
    return F.map_from_entries(F.concat(kept, F.map_entries(high)))


def explorer_properties(fields: Column, document: Column, properties: Column) -> Column:
    """Fields of the record, under those of its document, under its properties."""
    return _merged(fields, document, properties)


def view_properties(fields: Column, document: Column, properties: Column) -> Column:
    """What a view projects: properties over document over fields."""
    return _merged(fields, document, properties)


def pattern_properties(fields: Column, document: Column, properties: Column) -> Column:
    """What a pattern is tested on: properties, under those of the document, under the record's fields."""
    return _merged(properties, document, fields)


def predicate(properties: Column, name: str, operator: str, value=None, lists: Column | None = None) -> Column:
    """A pattern's test of a property: eq, ne, contains, in or exists; a property that isn't there only passes ne.

    lists: the properties that are lists (a map of arrays); a list contains a value if it is one of its items, a text if it is part of it.
    """
    if operator == "in" and not isinstance(value, (list, tuple, set)):
        raise ValueError("in needs several values")
    have, items = properties[name], lists[name] if lists is not None else F.lit(None).cast("array<string>")
    there = have.isNotNull() | items.isNotNull()
    if operator == "exists":
        return there if value in (None, True) else ~there
    tests = {
        "eq": lambda: have == str(value),
        "ne": lambda: ~have.eqNullSafe(F.lit(str(value))),
        "contains": lambda: F.coalesce(F.array_contains(items, str(value)), have.contains(str(value))),
        "in": lambda: have.isin([str(x) for x in value]),
    }
    if operator not in tests:
        raise ValueError(f"unknown operator {operator!r}")
    return F.coalesce(tests[operator](), F.lit(False))


# Filters


def filtered(records: DataFrame, sources=(), tags=(), properties: dict | None = None) -> DataFrame:
    """Records of one of the sources, with one of the tags (without case and #) and with all properties (a map column)."""
    out = records
    if sources:
        out = out.where(F.col("source").isin(*sources))
    if tags:
        own = F.transform("tags", lambda x: F.regexp_replace(F.lower(x), "^#+", ""))
        out = out.where(F.arrays_overlap(own, F.array(*(F.lit(x.lower().lstrip("#")) for x in tags))))
    for k, v in (properties or {}).items():
        out = out.where(F.col("properties")[k] == str(v))
    return out


def connected_only(records: DataFrame, edges: DataFrame) -> DataFrame:
    """Records that are an end of an edge whose other end is a record too."""
    inside = visible(edges, records.select(F.col("id").alias("node_id")))
    ends = inside.select(F.col("src").alias("id")).unionByName(inside.select(F.col("dst").alias("id"))).distinct()
    return records.join(ends, "id", "left_semi")


# Hits


def hits(records: DataFrame, query: str, context_chars: int = 160) -> DataFrame:
    """(id, title, score, matched_fields, excerpt): 1, and a quarter for each of title, key, tags and content that has the query without case."""
    needle = query.lower()
    has = lambda c: F.coalesce(F.lower(c).contains(needle), F.lit(False)) & F.lit(bool(needle))
    in_tags = F.coalesce(F.exists("tags", lambda x: F.lower(x).contains(needle)), F.lit(False)) & F.lit(bool(needle))
    fields = F.array_compact(F.array(F.when(has("title"), "title"), F.when(has("key"), "key"), F.when(in_tags, "tags"), F.when(has("content"), "content")))
    return records.select("id", "title", (1 + 0.25 * F.size(fields)).alias("score"), fields.alias("matched_fields"), excerpt(F.col("content"), context_chars).alias("excerpt"))


def excerpt(text: Column, chars: int) -> Column:
    """The first characters of a text, line breaks as spaces."""
    return F.substring(F.translate(F.trim(F.coalesce(text, F.lit(""))), "\n", " "), 1, chars) if chars > 0 else F.lit("")


def bounded(text: Column, at: Column, length: Column, budget: int) -> Column:
    """The text around a place (from 1): half of what the budget leaves on either side, line breaks as spaces."""
    if budget <= 0:
        return F.lit("")
    half = F.greatest(F.lit(0), F.floor((F.lit(budget) - length) / 2)).cast("int")
    start = F.greatest(F.lit(1), at - half)
    return F.translate(F.substring(text, start, at + length + half - start), "\n", " ")


def around(text: Column, before: int, after: int, at: Column, length: Column) -> tuple[Column, Column]:
    """Up to `before` characters ahead of a place (from 1) and up to `after` past its end; a bound of 0 gives nothing."""
    start = F.greatest(F.lit(1), at - before)
    return (F.substring(text, start, at - start) if before else F.lit("")), (F.substring(text, at + length, F.lit(after)) if after else F.lit(""))


# Mentions


def mention_targets(records: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(target_id, matched_text, kind): titles, aliases and paths of records, anchors of their headings and ids of their blocks, from three characters on."""
    of = lambda c, kind: F.struct(F.lit(kind).alias("kind"), c.alias("text"))
    has = set(records.columns)
    names = F.array(*[of(F.col("title"), "title")], *([of(F.col("path"), "path")] if "path" in has else []))
    names = F.concat(names, F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: of(x, "alias"))) if "aliases" in has else names
    out = records.select(F.col("id").alias("target_id"), F.explode(names).alias("_n")).select("target_id", F.col("_n.text").alias("matched_text"), F.col("_n.kind").alias("kind"))
    if blocks is not None:
        b = blocks.select(F.col("record_id").alias("target_id"), "block_type", "anchor", "block_id")
        out = out.unionByName(b.where("block_type = 'heading'").select("target_id", F.col("anchor").alias("matched_text"), F.lit("heading").alias("kind")))
        out = out.unionByName(b.select("target_id", F.col("block_id").alias("matched_text"), F.lit("block_id").alias("kind")))
    return out.where(F.length(F.trim("matched_text")) >= LEAST).distinct()


def unlinked_mentions(records: DataFrame, targets: DataFrame, links: DataFrame, context_chars: int = 80) -> DataFrame:
    """(candidate_id, source_id, target_id, matched_text, kind, context): texts that have a target's name, without case, and no link to it.

    Names are met by the rarest of their runs of characters, so a beginning that all names share costs nothing. A record doesn't mention itself; the first place counts.
    """
    names = targets.withColumn("_low", F.lower("matched_text"))
    texts = records.select("id", F.lower("content").alias("text"))
    pairs = met(texts, names.select(F.col("_low").alias("needle_id"), F.col("_low").alias("needle"))).select(F.col("id").alias("source_id"), F.col("needle_id").alias("_low"))
    pairs = pairs.join(names, "_low").where("source_id <> target_id")
    pairs = pairs.join(links.select(F.col("source_record_id").alias("source_id"), F.col("target_record_id").alias("target_id")), ["source_id", "target_id"], "left_anti")
    found = pairs.join(records.select(F.col("id").alias("source_id"), "content"), "source_id").withColumn("_at", F.call_function("instr", F.lower("content"), F.col("_low")))
    return found.select(stable_id("mention", "source_id", "target_id", "kind", "matched_text").alias("candidate_id"), "source_id", "target_id", "matched_text", "kind", bounded(F.col("content"), F.col("_at"), F.length("matched_text"), context_chars).alias("context"))


# Pages


def fingerprint(request: dict) -> str:
    """What a cursor is bound to: the request without the cursor itself."""
    return hashlib.sha256(json.dumps(request | {"cursor": None}, separators=(",", ":"), sort_keys=True, default=str).encode()).hexdigest()


def next_cursor(request: dict, offset: int) -> str:
    data = json.dumps({"offset": offset, "request_sha256": fingerprint(request), "v": 1}, separators=(",", ":"), sort_keys=True)
    return base64.urlsafe_b64encode(data.encode()).decode().rstrip("=")


def cursor_offset(request: dict) -> int:
    """The offset of a request's cursor, 0 without one; ValueError if it belongs to another request."""
    cursor = request.get("cursor")
    if cursor is None:
        return 0
    try:
        said = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as e:
        raise ValueError("not a cursor") from e
    if said.get("v") != 1 or not isinstance(said.get("offset"), int) or said["offset"] < 0 or said.get("request_sha256") != fingerprint(request):
        raise ValueError("the cursor does not belong to this request")
    return said["offset"]


def page(rows: DataFrame, order: list, request: dict, limit: int) -> tuple[DataFrame, str | None]:
    """A page of rows in a total order, and the cursor of the next one, if there is one. One row more than the page is looked for."""
    start = cursor_offset(request)
    ahead = rows.orderBy(*order).offset(start).limit(limit + 1)
    more = ahead.count() > limit
    return ahead.limit(limit), next_cursor(request, start + limit) if more else None


def backlinks(links: DataFrame, record: str, kinds: tuple = (), types: tuple = (), limit: int | None = None) -> DataFrame:
    """Links (link_id, source_record_id, target_record_id, link_kind, relation_type) to a record, by source and link; of some kinds and relation types, if wanted."""
    return _of_kind(links.where(F.col("target_record_id") == record), kinds, types, ["source_record_id", "link_id"], limit)


def outgoing(links: DataFrame, record: str, kinds: tuple = (), types: tuple = (), limit: int | None = None) -> DataFrame:
    """Links from a record, by place and link."""
    return _of_kind(links.where(F.col("source_record_id") == record), kinds, types, ["link_id"], limit)


def _of_kind(links: DataFrame, kinds: tuple, types: tuple, order: list, limit: int | None) -> DataFrame:
    """The limit counts links of the wanted relation types; kinds are looked at on the page."""
    out = (links.where(F.col("relation_type").isin(*types)) if types else links).orderBy(*order)
    out = out.limit(limit) if limit is not None else out
    return out.where(F.col("link_kind").isin(*kinds)) if kinds else out


def all_facets(records: DataFrame, nodes: DataFrame, links: DataFrame, communities: DataFrame) -> DataFrame:
    """(field, value, n) of nine fields: a record's scope, type, tier, source and tags, whether a node is an orphan, a link's kind and relation type, and communities by their size."""
    of = lambda *columns: F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda x: F.struct(F.lit("tag").alias("field"), x.alias("value")))
    rows = records.select(F.inline(F.concat(of("scope", "type", "tier", "source"), tags)))
    rows = rows.unionByName(nodes.select(F.lit("orphan").alias("field"), F.col("orphan").cast("string").alias("value"))).unionByName(links.select(F.inline(of("link_kind", "relation_type"))))
    counted = rows.where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))
    return counted.unionByName(communities.select(F.lit("community").alias("field"), F.col("label").alias("value"), F.col("size").cast("long").alias("n")))


def packet(records: DataFrame, edges: DataFrame, links: DataFrame, query: str, filters: dict, limit: int, context_chars: int = 160, root: str | None = None, depth: int = 1, link_kinds: tuple = (), labels: DataFrame | None = None, cursor: str | None = None) -> dict:
    """Tables of one exploration, and the cursor of the next page under `next_cursor`.

    The page comes first, by updated_at and id, and the filters run on it. hits; edges between them; graph: nodes around the root (the first hit if none is given) with their
    degrees; backlinks and outgoing links of the root; paths: the shortest from the root to each other hit within the graph; common: nodes next to both; communities with a hit
    (of labels: node_id, label) and source_sets of theirs; facets; mentions without a link; navigation: what can be opened next; plan: rows of each stage.
    """
    request = {"query": query, "filters": {k: list(v) if isinstance(v, (list, tuple)) else v for k, v in filters.items()}, "limit": limit, "root": root, "cursor": cursor}
    needle = query.lower()
    match = F.lower(F.concat_ws("\n", "title", "key", "content", F.array_join("tags", " "))).contains(needle)
    paged, following = page(records.where(match), [F.desc("updated_at"), F.asc("id")], request, limit)
    paged = settled(paged)
    kept = filtered(paged, **filters)
    shown = settled(hits(kept, query, context_chars).join(kept.select("id", "updated_at"), "id"))
    first = shown.orderBy(F.desc("updated_at"), "id").first()
    root = root or (first["id"] if first else None)
    no_links, no_labels = links.limit(0), labels if labels is not None else kept.select(F.col("id").alias("node_id"), F.col("id").alias("label")).limit(0)
    graph_edges = edges.select("edge_id", "src", "dst")
    near = settled(local_graph(graph_edges, root, depth).select("node_id", "depth")) if root else kept.select(F.col("id").alias("node_id"), F.lit(0).alias("depth")).limit(0)
    nodes = degrees(near.select("node_id"), graph_edges, False).withColumn("orphan", F.col("degree") == 0).join(near, "node_id")
    has = set(links.columns)
    full = links.withColumns({c: F.lit(None).cast("string") for c in ("link_id", "link_kind", "relation_type", "display", "raw_target") if c not in has})
    to, out = (backlinks(full, root, link_kinds, limit=limit), outgoing(full, root, link_kinds, limit=limit)) if root else (no_links, no_links)
    others = shown.where(F.col("id") != F.lit(root)).select(F.col("id").alias("node_id"))
    inner = visible(graph_edges, near.select("node_id"))
    source = records.sparkSession.createDataFrame([(root,)] if root else [], "node_id string")
    paths = settled(shortest_paths(inner, source, others, max(1, depth)))
    next_to = neighbours(inner).select("node", "neighbour").distinct()
    both = next_to.where(F.col("node") == F.lit(root)).select(F.col("neighbour").alias("common")).join(next_to.select(F.col("node").alias("id"), F.col("neighbour").alias("common")), "common").join(others.withColumnRenamed("node_id", "id"), "id", "left_semi").where(F.col("common") != F.col("id")).select("id", "common")
    mine = no_labels.join(shown.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("label").distinct()
    communities = no_labels.join(mine, "label", "left_semi").groupBy("label").agg(F.count("*").alias("size"), F.min("node_id").alias("seed"))
    sources = no_labels.join(mine, "label", "left_semi").join(records.select(F.col("id").alias("node_id"), "source"), "node_id").groupBy("label", F.concat(F.lit("source:"), "source").alias("key")).agg(F.count("*").alias("n"))
    found = unlinked_mentions(kept, mention_targets(kept), links, context_chars)
    act = lambda df, action, record, label: df.select(F.lit(action).alias("action"), record.alias("id"), label.cast("string").alias("label"))
    size = F.concat(F.lit("community of "), F.col("size"))
    both_ways = to.unionByName(out, allowMissingColumns=True)
    steps = [
        act(source, "open_root", F.col("node_id"), F.lit("root")),
        act(shown, "open_hit", F.col("id"), F.coalesce("title", "id")),
        *((act(to, "follow_backlink", F.col("source_record_id"), F.coalesce("display", "raw_target")), act(out.where("target_record_id is not null"), "follow_outgoing_link", F.col("target_record_id"), F.coalesce("display", "raw_target"))) if root else ()),
        act(paths, "inspect_path", F.col("target"), F.concat(F.size("hops"), F.lit(" hops"))),
        act(both, "open_common_neighbor", F.col("common"), F.col("id")),
        act(nodes.where("orphan"), "open_orphan", F.col("node_id"), F.col("node_id")),
        act(communities, "open_community", F.col("seed"), size),
        act(communities, "filter_community", F.col("seed"), size),
        act(found, "apply_repair_candidate", F.col("candidate_id"), F.col("matched_text")),
    ]
    navigation = steps[0]
    for s in steps[1:]:
        navigation = navigation.unionByName(s)
    facets = all_facets(with_columns(kept), nodes, both_ways if root else full.limit(0), communities)
    stages = {"page": paged, "filters": shown, "graph": near, "backlinks": to, "outgoing_links": out, "paths": paths, "communities": communities, "mentions": found}
    return {"hits": shown.drop("updated_at"), "edges": visible(edges, kept.select(F.col("id").alias("node_id"))), "graph": nodes, "backlinks": to, "outgoing_links": out, "paths": paths, "common": both, "communities": communities, "source_sets": sources, "facets": facets, "mentions": found, "navigation": navigation, "plan": planned(stages), "next_cursor": following}


def with_columns(records: DataFrame) -> DataFrame:
    """records with null columns where facets look for one that isn't there."""
    return records.withColumns({c: F.lit(None).cast("string") for c in ("scope", "type", "tier", "source") if c not in records.columns})


def saved(requests: DataFrame, name: str, records: DataFrame, edges: DataFrame, links: DataFrame) -> dict:
    """The packet of a stored request (name, request: JSON of query, filters, limit); ValueError if there is none of this name."""
    found = requests.where(F.col("name") == name).select("request").first()
    if found is None:
        raise ValueError(f"no saved view {name!r}")
    request = json.loads(found["request"])
    return packet(records, edges, links, request["query"], request.get("filters", {}), request.get("limit", 50))
