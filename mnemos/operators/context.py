"""Context packages: graph neighbourhoods, summaries, artifact texts, memory blocks, federation, and trust."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemos.operators.policy import first_of

#: Block classes in the order they are rendered (they are cut from the last), the mark of a stale block and its tokens.
BLOCK_CLASSES, STALE_MARK, STALE_TOKENS = ("agent_identity", "active_mission", "session_pin"), "[stale] ", 1
#: The scores at which a candidate turns provisional and a provisional memory trusted.
PROVISIONAL, TRUSTED = 0.6, 0.8
#: Kinds of disagreement; states of trust that are retrieved, and those that are if a narrow retrieval is asked for.
DISAGREEMENTS = ("claim_key_polarity", "explicit_upstream_metadata", "exact_key_contradiction_fact")
ACTIVE_STATES, NARROW_STATES = ("trusted", "pinned"), ("provisional",)


def local_context(records: DataFrame, seeds: DataFrame, edges: DataFrame, most_paths: int, most_items: int) -> DataFrame:
    """(id, scope, score, via, included, position): seeds (id, position) first, then records one edge away, each with the edge that first reached it.

    Each seed looks at its newest `most_paths` edges (edge_id, src, dst, created_at); seeds go in order of position.
    """
    out = edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), "edge_id", "created_at")
    back = edges.select(F.col("dst").alias("_from"), F.col("src").alias("_to"), "edge_id", "created_at")
    s = seeds.join(records.select("id"), "id", "left_semi").groupBy("id").agg(F.min("position").alias("position"))
    order = [F.desc("created_at"), F.desc("edge_id")]
    near = out.unionByName(back).join(s.select(F.col("id").alias("_from"), "position"), "_from")
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("_from").orderBy(*order))).where(F.col("_n") <= most_paths)
    reached = near.join(s, near["_to"] == s["id"], "left_anti").join(records.select(F.col("id").alias("_to")), "_to", "left_semi")
    first = reached.groupBy("_to").agg(F.min(F.struct("position", "_n", "edge_id")).alias("_f"))
    items = s.select("id", F.lit("seed").alias("scope"), F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("via"), F.lit(0).alias("_a"), F.col("position").cast("long").alias("_b"), F.lit(0).alias("_c")).unionByName(
        first.select(F.col("_to").alias("id"), F.lit("neighbor").alias("scope"), F.lit(0.5).alias("score"), F.col("_f.edge_id").alias("via"), F.lit(1).alias("_a"), F.col("_f.position").cast("long").alias("_b"), F.col("_f._n").alias("_c"))
    )
    order = ["_a", "_b", "_c", "id"]
    kept = items.orderBy(*order).limit(most_items).select("id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("position"))  # of most_items rows
    return items.join(kept, "id", "left").select("id", "scope", "score", "via", F.col("position").isNotNull().alias("included"), "position")


def summary_context(requests: DataFrame, summaries: DataFrame, most: int, include_invalidated: bool = False) -> DataFrame:
    """requests (position, summary_id) with the reason why a summary is left out, null for those that are in.

    summaries: summary_id, in_namespace, invalidated, visibility, denied. Reasons go in a fixed order; the budget counts what is left.
    """
    nth = F.row_number().over(Window.partitionBy("summary_id").orderBy("position"))
    j = requests.withColumn("_nth", nth).join(summaries.withColumn("_there", F.lit(True)), "summary_id", "left")
    rules = [
        (F.col("_there").isNull(), "not_found"),
        (F.col("_nth") > 1, "duplicate"),
        (~F.col("in_namespace"), "namespace_excluded"),
        (F.col("invalidated") & F.lit(not include_invalidated), "invalidated"),
        (F.col("visibility") == "hidden", "hidden"),
        (F.col("visibility") == "audit_only", "audit_only"),
        (F.col("denied"), "denied"),
    ]
    judged = j.withColumn("reason", first_of(rules)).select("position", "summary_id", "reason")
    kept = judged.where("reason is null").orderBy("position").limit(most).select("position", F.lit(True).alias("_in"))
    return judged.join(kept, "position", "left").select("position", "summary_id", F.when(F.col("reason").isNull() & F.col("_in").isNull(), "budget_exceeded").otherwise(F.col("reason")).alias("reason"))


def artifact_freshness() -> Column:
    """superseded, source_replaced, missing_derived_text or current."""
    return first_of([(F.col("superseded_by").isNotNull(), "superseded"), (~F.col("artifact_hash").eqNullSafe(F.col("source_hash")), "source_replaced"), (F.col("text_record_id").isNull(), "missing_derived_text")], "current")


def artifact_search(projections: DataFrame, artifacts: DataFrame, records: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """(projection_id, segments, freshness): projections with a segment that has the query, without case, and the numbers of these segments.

    projections: projection_id, artifact_id, source_hash, superseded_by, derived_record_id, segments array<string>.
    """
    hit = F.filter(F.transform("segments", lambda s, i: F.when(F.lower(s).contains(query.strip().lower()), i)), lambda i: i.isNotNull())
    found = projections.withColumn("_hit", hit).where(F.size("_hit") > 0)
    j = found.join(artifacts.select("artifact_id", F.col("hash").alias("artifact_hash")), "artifact_id", "left").join(records.select(F.col("id").alias("derived_record_id"), F.col("id").alias("text_record_id")), "derived_record_id", "left")
    out = j.select("projection_id", F.col("_hit").alias("segments"), artifact_freshness().alias("freshness")).orderBy("projection_id")
    return out.limit(limit) if limit is not None else out


def block_budget(blocks: DataFrame, now: Column, ceiling: int, floor: int) -> DataFrame:
    """(owner, block_id, position, tokens, truncated, dropped) of each owner's memory blocks under a ceiling of tokens.

    Blocks are rendered by class, created_at and id; stale ones cost a token more. Over the ceiling, the last blocks of
    the last class go first, or are cut to what is left; identity blocks are cut from the first, to the floor at the least.
    A row of one owner after the other only needs running sums, so no owner's blocks meet in Python.
    """
    rank = F.array_position(F.array(*map(F.lit, BLOCK_CLASSES)), F.col("class")).cast("int")
    stale = F.coalesce(F.col("stale_after") <= now, F.lit(False))
    b = blocks.select("owner", "block_id", rank.alias("_class"), "created_at", (F.col("token_estimate") + F.when(stale, STALE_TOKENS).otherwise(0)).cast("long").alias("_cost"))
    every = Window.partitionBy("owner")
    order = every.orderBy("_class", "created_at", "block_id")
    over = F.greatest(F.lit(0), F.sum("_cost").over(every) - ceiling)
    # Tokens of the blocks that are given up before this one: those after it, of classes other than identity.
    other = F.when(F.col("_class") > 1, F.col("_cost")).otherwise(0)
    after = F.coalesce(F.sum(other).over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    b = b.withColumns({"position": F.row_number().over(order), "_over": over, "_after": after, "_others": F.sum(other).over(every)})
    gives = F.least(F.col("_cost"), F.greatest(F.lit(0), F.col("_over") - F.col("_after")))
    can = F.greatest(F.lit(0), F.col("_cost") - floor)
    before = F.coalesce(F.sum(F.when(F.col("_class") == 1, can).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    identity = F.least(can, F.greatest(F.lit(0), F.col("_over") - F.col("_others") - before))
    b = b.withColumn("_gives", F.when(F.col("_class") == 1, identity).otherwise(gives))
    left = F.col("_cost") - F.col("_gives")
    dropped = (F.col("_class") > 1) & (F.col("_gives") > 0) & (left == 0)
    return b.select("owner", "block_id", "position", left.cast("long").alias("tokens"), ((F.col("_gives") > 0) & ~dropped).alias("truncated"), dropped.alias("dropped"))


def federated(hits: DataFrame, limit: int) -> DataFrame:
    """hits (workspace, position, id, score) of several workspaces: a record's first hit by workspace and position, up to a limit."""
    first = hits.groupBy("id").agg(F.min(F.struct("workspace", "position", "score")).alias("_h"))
    return first.select(F.col("_h.workspace").alias("workspace"), F.col("_h.position").alias("position"), "id", F.col("_h.score").alias("score")).orderBy("workspace", "position", "id").limit(limit)


def trust(updates: DataFrame) -> DataFrame:
    """(memory_id, trust_state, trust_score) after each memory's updates (memory_id, position, outcome, weight), in order, from a candidate at 0.5.

    suppressed and superseded are final. One fold over a memory's sorted updates.
    """
    steps = F.array_sort(F.collect_list(F.struct("position", "outcome", "weight")))

    def step(a: Column, u: Column) -> Column:
        o, s = u["outcome"], a["state"]
        up, down = F.least(F.lit(1.0), a["score"] + u["weight"]), F.greatest(F.lit(0.0), a["score"] - u["weight"])
        less = o.isin("negative", "mixed", "re_review")
        worse = o.isin("evidence_stale", "evidence_missing", "evidence_changed")
        lower = F.when((s == "trusted") | (worse & (s == "pinned")), "provisional").when(s == "provisional", "candidate").otherwise(s)
        state = (
            F.when(s.isin("suppressed", "superseded"), s)
            .when((o == "positive") & (s == "candidate") & (up >= PROVISIONAL), "provisional")
            .when((o == "positive") & (s == "provisional") & (up >= TRUSTED), "trusted")
            .when(less | worse, lower)
            .when(o == "operator_pin", "pinned")
            .when(o == "operator_unpin", "trusted")
            .when(o == "suppress", "suppressed")
            .when(o == "supersede", "superseded")
            .otherwise(s)
        )
        score = F.when(s.isin("suppressed", "superseded"), a["score"]).when(o == "positive", up).when(less | worse, down).when(o == "operator_pin", F.lit(1.0)).when(o == "suppress", F.lit(0.0)).otherwise(a["score"])
        return F.struct(state.alias("state"), score.alias("score"))

    start = F.struct(F.lit("candidate").alias("state"), F.lit(0.5).alias("score"))
    out = updates.groupBy("memory_id").agg(F.aggregate(steps, start, step).alias("_t"))
    return out.select("memory_id", F.col("_t.state").alias("trust_state"), F.col("_t.score").alias("trust_score"))


def described(records: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, name, types[]): labels, relation types, and property keys (properties map<string, string>) with the kinds of values they have."""
    value = F.col("value")
    kind = F.when(value.isNull(), "null").when(value.isin("true", "false"), "bool").when(value.rlike(r"^-?\d+$"), "int").when(value.try_cast("double").isNotNull(), "float").otherwise("str")
    none = F.array().cast("array<string>")
    keys = records.select(F.explode("properties")).groupBy("key").agg(F.array_sort(F.collect_set(kind)).alias("types"))
    return (
        records.select(F.lit("label").alias("kind"), F.col("type").alias("name")).distinct().withColumn("types", none)
        .unionByName(relations.select(F.lit("relation").alias("kind"), F.col("relation_type").alias("name")).distinct().withColumn("types", none))
        .unionByName(keys.select(F.lit("property").alias("kind"), F.col("key").alias("name"), "types"))
    )


def schema_conflicts(described_rows: DataFrame) -> DataFrame:
    """(property, types) of the properties that have values of several types, of the rows of `described`."""
    return described_rows.where((F.col("kind") == "property") & (F.size("types") > 1)).select(F.col("name").alias("property"), "types")


def namespaces_intersected(left: DataFrame, right: DataFrame, ids: tuple) -> DataFrame:
    """The selectors that two lists allow together: compatible pairs merged, without repeats; null in an id allows any.

    Selectors meet by the ids that both have set, for each pair of the patterns of set ids that there are (at most two to the number of ids on a side): joins by key, no
    pairs of all selectors.
    """
    pattern = F.concat(*(F.when(F.col(i).isNull(), "0").otherwise("1") for i in ids))
    a, b = left.select(*ids, pattern.alias("_p")).distinct(), right.select(*ids, pattern.alias("_p")).distinct()
    patterns = [[r["_p"] for r in side.select("_p").distinct().collect()] for side in (a, b)]
    if not all(patterns):
        return a.select(*ids).limit(0)

    def keyed(side: DataFrame, others: list[str], mine_first: bool) -> DataFrame:
        out = side.withColumn("_o", F.explode(F.array(*map(F.lit, sorted(others)))))
        both = [F.when((F.substring("_p", i + 1, 1) == "1") & (F.substring("_o", i + 1, 1) == "1"), F.col(x)) for i, x in enumerate(ids)]
        pair = ("_p", "_o") if mine_first else ("_o", "_p")
        return out.withColumn("_k", F.to_json(F.struct(*(F.col(c).alias(f"p{j}") for j, c in enumerate(pair)), *(c.alias(f"c{i}") for i, c in enumerate(both)))))

    x, y = keyed(a, patterns[1], True), keyed(b, patterns[0], False)
    met = x.select("_k", *ids).join(y.select("_k", *(F.col(i).alias(f"_{i}") for i in ids)), "_k")
    return met.select(*(F.coalesce(i, f"_{i}").alias(i) for i in ids)).distinct()


# Modes of a context package: items (id, kind, score, snippet) with whether they are in the budget.


def budgeted(items: DataFrame, most: int, order: list) -> DataFrame:
    """items with `included`: whether they are among the first `most`."""
    kept = items.orderBy(*order).limit(most).select("id", "kind", F.lit(True).alias("_in"))
    return items.join(kept, ["id", "kind"], "left").withColumn("included", F.coalesce("_in", F.lit(False))).drop("_in")


def search_context(found: DataFrame, limit: int, most: int, chars: int) -> DataFrame:
    """structural_search mode: found records (id, content, position from 0) scored by their position."""
    items = found.select("id", F.lit("record").alias("kind"), F.greatest(F.lit(0.0), 1 - F.col("position") / F.lit(max(1, limit))).alias("score"), F.left("content", F.lit(chars)).alias("snippet"), "position")
    return budgeted(items, most, ["position", "id"])


def fact_context(facts: DataFrame, most: int) -> DataFrame:
    """temporal_fact mode: listed facts (fact_id, confidence, observed_at), scored by their confidence, in the list's order."""
    items = facts.select(F.col("fact_id").alias("id"), F.lit("fact").alias("kind"), F.coalesce("confidence", F.lit(0.5)).cast("double").alias("score"), F.lit(None).cast("string").alias("snippet"), F.col("observed_at").alias("position"))
    return budgeted(items, most, ["position", "id"])


def hybrid_context(found: DataFrame, vector_scores: DataFrame, facts: DataFrame, limit: int, most: int, chars: int) -> DataFrame:
    """hybrid mode: records (id, content, position) scored by position and, if they have one, by their vector (id, value), the greater of both; and
    facts (fact_id, record_id, confidence) of these records. By score, records before facts of the same score, then by position and id."""
    keyword = F.greatest(F.lit(0.0), 1 - F.col("position") / F.lit(max(1, limit)))
    records = found.join(vector_scores, "id", "left").select("id", F.lit("record").alias("kind"), F.greatest(keyword, F.coalesce("value", keyword)).alias("score"), F.left("content", F.lit(chars)).alias("snippet"), F.lit(0).alias("_after"), "position")
    more = facts.join(found.select(F.col("id").alias("record_id"), "position"), "record_id").select(F.col("fact_id").alias("id"), F.lit("fact").alias("kind"), F.coalesce("confidence", F.lit(0.5)).cast("double").alias("score"), F.lit(None).cast("string").alias("snippet"), F.lit(1).alias("_after"), "position")
    return budgeted(records.unionByName(more), most, [F.desc("score"), "_after", "position", "id"]).drop("_after")


def summary_references(wanted: DataFrame, summaries: DataFrame, most: int) -> DataFrame:
    """global mode: the summaries (summary_id, text) that are referred to (position, summary_id), in order; unknown ones are left out."""
    items = wanted.join(summaries, "summary_id").select(F.col("summary_id").alias("id"), F.lit("summary").alias("kind"), F.lit(1.0).alias("score"), F.col("text").alias("snippet"), "position")
    return budgeted(items, most, ["position", "id"])


def drift_context(steps: DataFrame, wanted: DataFrame, summaries: DataFrame, records: DataFrame, most: int) -> DataFrame:
    """drift mode: recorded steps (step, kind summary or record, id), in order, each with what it points to; steps to nothing are left out. wanted:
    (position, summary_id) that the first step starts from."""
    begin = wanted.select((F.col("position") - 1_000_000).cast("long").alias("position"), F.lit("summary").alias("kind"), F.col("summary_id").alias("id"))
    all_ = begin.unionByName(steps.select(F.col("step").cast("long").alias("position"), "kind", "id"))
    there = summaries.select(F.lit("summary").alias("kind"), F.col("summary_id").alias("id"), F.col("text").alias("snippet")).unionByName(records.select(F.lit("record").alias("kind"), "id", F.col("content").alias("snippet")))
    first = all_.groupBy("kind", "id").agg(F.min("position").alias("position"))
    items = first.join(there, ["kind", "id"]).select("id", "kind", F.lit(1.0).alias("score"), "snippet", "position")
    return budgeted(items, most, ["position", "id"])


def with_communities(items: DataFrame, community_items: DataFrame, most: int) -> DataFrame:
    """Items of a package that were in, then a community's (id, kind, score, snippet, position), under the budget again."""
    old = items.where("included").select("id", "kind", "score", "snippet", F.lit(0).alias("_after"), F.col("position").cast("long").alias("position"))
    new = community_items.select("id", "kind", "score", "snippet", F.lit(1).alias("_after"), F.col("position").cast("long").alias("position"))
    return budgeted(old.unionByName(new), most, ["_after", "position", "id"]).drop("_after")


def disagreements(signals: DataFrame) -> DataFrame:
    """signals (kind, block_id, record_id, claim_key, block_polarity, retrieval_polarity) with `refusal`, null for those to be recorded.

    A disagreement in the polarity of a claim needs the claim and two polarities that differ; other kinds need block and record only.
    """
    of_claim = F.col("kind") == "claim_key_polarity"
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = [
        (~F.coalesce(F.col("kind").isin(*DISAGREEMENTS), F.lit(False)), "unknown_kind"),
        (blank("block_id"), "block_required"),
        (blank("record_id"), "record_required"),
        (of_claim & blank("claim_key"), "claim_required"),
        (of_claim & (F.col("block_polarity").isNull() | F.col("retrieval_polarity").isNull()), "polarity_required"),
        (of_claim & (F.col("block_polarity") == F.col("retrieval_polarity")), "polarities_agree"),
    ]
    return signals.withColumn("refusal", first_of(rules))


def memory_packets(memories: DataFrame, narrow: bool = False) -> DataFrame:
    """memories (memory_id, trust_state, refs) with reason (trusted_retrieval or narrow_retrieval) and refs, or omitted_reason and no refs."""
    state = F.col("trust_state")
    reason = F.when(state.isin(*ACTIVE_STATES), "trusted_retrieval").when(state.isin(*NARROW_STATES) & F.lit(narrow), "narrow_retrieval")
    omitted = F.when(reason.isNull(), F.concat(F.lit("trust_state_"), state))
    return memories.withColumns({"reason": reason, "omitted_reason": omitted, "refs": F.when(reason.isNull(), F.array().cast("array<string>")).otherwise(F.col("refs"))})
