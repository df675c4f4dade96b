"""Hybrid retrieval: stages that score records, fused by reciprocal ranks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemos.functions.columns import contains_text, decay, haystack, similarity

#: The rank constant of the fusion, and the raw score of a graph neighbour.
RANK_CONSTANT, NEIGHBOUR = 60, 0.5


def component(df: DataFrame, kind: str, raw: Column, weight: Column | float = 1.0) -> DataFrame:
    weight = weight if isinstance(weight, Column) else F.lit(float(weight))
    return df.select(F.col("id"), F.lit(kind).alias("kind"), raw.cast("double").alias("raw"), weight.cast("double").alias("weight"))


def keyword_stage(records: DataFrame, text: Column, query: str, limit: int, weight: float = 1.0) -> DataFrame:
    """The first `limit` matches, latest first, scored from 1 down by their position. records must have updated_at and be eligible already."""
    first = records.where(contains_text(text, query)).select("id", "updated_at").orderBy(F.desc("updated_at"), "id").limit(limit)
    place = F.row_number().over(Window.orderBy(F.desc("updated_at"), "id")) - 1  # of `limit` rows
    return component(first.withColumn("_place", place), "keyword", F.greatest(F.lit(0.0), 1 - F.col("_place") / F.lit(max(1, limit))), weight)


def vector_stage(embeddings: DataFrame, query: list[float], metric: str, limit: int, weight: float = 1.0) -> DataFrame:
    """The nearest `limit` records of a vector space."""
    v = F.array(*(F.lit(float(x)) for x in query))
    best = embeddings.select(F.col("record_id").alias("id"), similarity(F.col("vector"), v, metric).alias("_s")).orderBy(F.desc("_s"), "id").limit(limit)
    return component(best, "vector", F.col("_s"), weight)


def top_k(embeddings: DataFrame, query: list[float], metric: str, k: int) -> DataFrame:
    """(record_id, score) of the k nearest vectors; of equal scores, smaller ids."""
    v = F.array(*(F.lit(float(x)) for x in query))
    return embeddings.select("record_id", similarity(F.col("vector"), v, metric).alias("score")).orderBy(F.desc("score"), "record_id").limit(k)


def graph_stage(seeds: DataFrame, edges: DataFrame, most: int, weight: float = 1.0) -> DataFrame:
    """Neighbours of seeds over one edge in either direction, the newest `most` edges of each seed; a neighbour that is reached again scores again."""
    out = edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), "edge_id", "created_at")
    back = edges.select(F.col("dst").alias("_from"), F.col("src").alias("_to"), "edge_id", "created_at")
    s = seeds.select(F.col("id").alias("_from")).distinct()
    near = out.unionByName(back).join(s, "_from", "left_semi")
    w = Window.partitionBy("_from").orderBy(F.desc("created_at"), F.desc("edge_id"))
    kept = near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return component(kept.select(F.col("_to").alias("id")), "graph", F.lit(NEIGHBOUR), weight)


def recency_stage(records: DataFrame, now: Column, half_life_days: float, weight: float = 1.0) -> DataFrame:
    return component(records, "recency", decay(F.col("updated_at"), now, half_life_days), weight)


def trust_stage(records: DataFrame, weights: dict[str, float], default: float) -> DataFrame:
    """Raw score 1, weighed by the record's source."""
    w = F.lit(float(default))
    for source, value in weights.items():
        w = F.when(F.col("source") == source, F.lit(float(value))).otherwise(w)
    return component(records, "trust", F.lit(1.0), w)


def fused(components: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, score): the sum over kinds of 1 / (60 + rank), rerank apart, which adds its best weighed score. By score, then id.

    Ranks are taken within a kind, so a stage must bring no more candidates than it has a limit for.
    """
    weighed = components.withColumn("_w", F.col("raw") * F.col("weight"))
    w = Window.partitionBy("kind").orderBy(F.desc("_w"), "id")
    ranked = weighed.where("kind <> 'rerank'").withColumn("_r", 1.0 / (RANK_CONSTANT + F.row_number().over(w)))
    rerank = weighed.where("kind = 'rerank'").groupBy("id").agg(F.max("_w").alias("_best"))
    terms = F.array_sort(F.collect_list(F.struct("kind", "_r")))
    total = ranked.groupBy("id").agg(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x["_r"]).alias("_sum"))
    out = total.join(rerank, "id", "full_outer").select("id", (F.coalesce("_sum", F.lit(0.0)) + F.coalesce("_best", F.lit(0.0))).alias("score")).orderBy(F.desc("score"), "id")
    return out.limit(limit) if limit is not None else out


def item_budget(items: DataFrame, most: int, order: list) -> DataFrame:
    """items with their position and whether they are among the first `most`."""
    ranked = items.orderBy(*order).limit(most).select("id", F.lit(True).alias("_in"))
    return items.join(ranked, "id", "left").withColumn("included", F.coalesce("_in", F.lit(False))).drop("_in")


def eligible(records: DataFrame, rules: dict[str, Column] | None, stage: str) -> tuple[DataFrame, DataFrame]:
    """Records that a stage may use, and what it leaves out (id, stage, reason). rules: by stage (or * for all) a Column with the reason why a
    record may not be used, null where it may. A rule that fails for a row, fails the query: nothing slips through."""
    rule = (rules or {}).get(stage, (rules or {}).get("*"))
    if rule is None:
        return records, records.limit(0).select("id", F.lit(stage).alias("stage"), F.lit("").alias("reason"))
    judged = records.withColumn("_reason", rule)
    return judged.where("_reason is null").drop("_reason"), judged.where("_reason is not null").select("id", F.lit(stage).alias("stage"), F.col("_reason").alias("reason"))


def assembled(
    records: DataFrame,
    *,
    query: str,
    limit: int,
    keyword_limit: int | None = None,
    embeddings: DataFrame | None = None,
    vector: list[float] | None = None,
    metric: str = "cosine",
    vector_limit: int | None = None,
    edges: DataFrame | None = None,
    per_seed: int = 0,
    now: Column | None = None,
    half_life_days: float | None = None,
    trust: dict[str, float] | None = None,
    default_trust: float = 1.0,
    rerank: DataFrame | None = None,
    rules: dict[str, Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The whole pipeline: keyword, vector, graph (one hop from what these found), recency, trust and rerank, fused. Gives the hits (id, score,
    components: array of kind, raw and weight in order; via: edges that led there) by score and id, and what was left out (id, stage, reason).

    A stage that gets no argument isn't run. rerank: (id, raw). Eligibility is asked before a stage takes its first rows, so ineligible
    records don't use up limits; a record that recency or trust may not use goes altogether.
    """
    omitted = []

    def allowed(df: DataFrame, stage: str) -> DataFrame:
        good, bad = eligible(df, rules, stage)
        omitted.append(bad)
        return good

    text = haystack(F.col("title"), F.col("key"), F.col("content"), F.array_join("tags", " "), F.array_join("entities", " "))
    matching = records.where(contains_text(text, query))
    parts = [keyword_stage(allowed(matching, "keyword"), text, query, keyword_limit or limit)]
    if embeddings is not None and vector is not None:
        usable = allowed(records.join(embeddings.select(F.col("record_id").alias("id")), "id", "left_semi"), "vector")
        parts.append(vector_stage(embeddings.join(usable.select(F.col("id").alias("record_id")), "record_id", "left_semi"), vector, metric, vector_limit or limit))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    via = None
    if edges is not None and per_seed > 0:
        seeds = found.select("id").distinct()
        near = neighbours_of(seeds, edges, per_seed)
        good = allowed(records.join(near.select("id").distinct(), "id", "left_semi"), "graph")
        via = near.join(good.select("id"), "id", "left_semi")
        found = found.unionByName(component(via, "graph", F.lit(NEIGHBOUR)))
    there = records.join(found.select("id").distinct(), "id", "left_semi")
    for stage, wanted in (("recency", now is not None and half_life_days is not None), ("trust", trust is not None), ("rerank", rerank is not None)):
        if not wanted:
            continue
        there = allowed(there, stage)
        new = recency_stage(there, now, half_life_days) if stage == "recency" else trust_stage(there, trust, default_trust) if stage == "trust" else component(rerank.join(there.select("id"), "id", "left_semi"), "rerank", F.col("raw"))
        found = found.unionByName(new)
    found = found.join(there.select("id"), "id", "left_semi")
    parts = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("kind", "raw", "weight"))).alias("components"))
    out = fused(found, limit).join(parts, "id")
    ways = via.groupBy("id").agg(F.array_sort(F.collect_set("edge_id")).alias("via")) if via is not None else out.limit(0).select("id", F.array().cast("array<string>").alias("via"))
    out = out.join(ways, "id", "left").withColumn("via", F.coalesce("via", F.array().cast("array<string>"))).orderBy(F.desc("score"), "id")
    left_out = omitted[0]
    for more in omitted[1:]:
        left_out = left_out.unionByName(more)
    return out, left_out.distinct()


def neighbours_of(seeds: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(id, edge_id) over the newest `most` edges of each seed, either way."""
    out = edges.select(F.col("src").alias("_from"), F.col("dst").alias("id"), "edge_id", "created_at")
    back = edges.select(F.col("dst").alias("_from"), F.col("src").alias("id"), "edge_id", "created_at")
    near = out.unionByName(back).join(seeds.select(F.col("id").alias("_from")).distinct(), "_from", "left_semi")
    w = Window.partitionBy("_from").orderBy(F.desc("created_at"), F.desc("edge_id"))
    return near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select("id", "edge_id")
