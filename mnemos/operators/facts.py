"""Temporal facts, contradictions and episodes."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a time that name its day.
DAY = 10


def is_invalidated() -> Column:
    return F.col("invalidated_at").isNotNull() | F.col("superseded_by_fact_id").isNotNull()


def list_facts(
    facts: DataFrame, subject: str | None = None, object_id: str | None = None, predicate: str | None = None, state: str = "active", valid_at: str | None = None, learned_at: str | None = None, episode: str | None = None, limit: int | None = None
) -> DataFrame:
    """Facts by observed_at and id. state: active, historical or all. Times are compared as texts."""
    if state not in ("active", "historical", "all"):
        raise ValueError(f"unknown state {state!r}")
    out = facts
    for c, v in (("subject_entity_id", subject), ("object_entity_id", object_id), ("predicate", predicate)):
        out = out.where(F.col(c) == v) if v else out
    if state != "all":
        out = out.where(is_invalidated() if state == "historical" else ~is_invalidated())
    if valid_at is not None:
        out = out.where((F.col("valid_from").isNull() | (F.col("valid_from") <= valid_at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > valid_at)))
    if learned_at is not None:
        out = out.where(F.coalesce(F.col("observed_at"), F.lit("")) <= learned_at)
    if episode:
        out = out.where(F.array_contains("source_episode_ids", episode))
    out = out.orderBy("observed_at", "fact_id")
    return out.limit(limit) if limit is not None else out


def facts_as_of(probes: DataFrame, facts: DataFrame) -> DataFrame:
    """For each probe (subject_entity_id, at) the active fact that is valid then, of several the latest begun (then the greatest id).

    Facts may overlap and are half open. A probe without a subject or a time has no fact; repeated probes are answered each; times that don't
    come after their begin are never valid. A time's place is how many begins and ends of its subject's facts it has reached, counted day by day. A fact
    covers the places from its begin to its end as a few dyadic runs, and a probe looks up the runs that its own place is in. So there are rows for facts
    times the logarithm of a subject's facts, never pairs of all facts and all probes, and a subject with many facts isn't sorted in one task.
    """
    subject = "subject_entity_id"
    f = facts.where(~is_invalidated() & F.col(subject).isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.coalesce("valid_from", F.lit("")))))
    f = f.select(subject, F.struct(F.coalesce("valid_from", F.lit("")).alias("valid_from"), "fact_id", "object_literal", "valid_to").alias("_f"))
    most = f.groupBy(subject).count().agg(F.max("count")).first()[0] or 0
    top = int(2 * most).bit_length()
    ends = F.array_compact(F.array(F.struct(F.col("_f.valid_from").alias("at"), F.lit(0).alias("side")), F.when(F.col("_f.valid_to").isNotNull(), F.struct(F.col("_f.valid_to").alias("at"), F.lit(1).alias("side")))))
    asked = probes.where(F.col(subject).isNotNull() & F.col("at").isNotNull()).select(subject, "at").distinct()
    line = f.select(subject, "_f", F.inline(ends)).unionByName(asked.select(subject, "at", F.lit(2).alias("side")), allowMissingColumns=True)
    line = line.withColumns({"_day": F.substring("at", 1, DAY), "_mark": (F.col("side") < 2).cast("long")})
    days = line.groupBy(subject, "_day").agg(F.sum("_mark").alias("_n"))
    earlier = Window.partitionBy(subject).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select(subject, "_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.sum("_mark").over(Window.partitionBy(subject, "_day").orderBy("at"))
    placed = line.withColumn("_within", within).join(before, [subject, "_day"]).select(subject, "at", "side", "_f", (F.col("_before") + F.col("_within")).alias("_place"))
    both = placed.where("side < 2").groupBy(subject, "_f").agg(F.min("_place").alias("_a"), F.max(F.when(F.col("side") == 1, F.col("_place"))).alias("_b"))
    runs = both.select(subject, "_f", F.inline(dyadic(F.col("_a"), F.coalesce("_b", F.lit(1 << top)), top)))
    best = runs.groupBy(subject, "level", "run").agg(F.max("_f").alias("_f"))
    levels = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("_place", k).alias("run")) for k in range(top + 1)))
    looked = placed.where("side = 2").select(subject, "at", F.inline(levels)).join(best, [subject, "level", "run"]).groupBy(subject, "at").agg(F.max("_f").alias("_f"))
    return probes.select(subject, "at").join(looked, [subject, "at"], "left").select(subject, "at", F.col("_f.fact_id").alias("fact_id"), F.col("_f.object_literal").alias("object_literal"))


def dyadic(a: Column, b: Column, top: int) -> Column:
    """array<struct<level, run>>: the runs [run << level, (run + 1) << level) that together are [a, b), at most two for each level up to top; b is at most 1 << top."""

    def at(k: int) -> list[Column]:
        low, high = F.shiftright(a + ((1 << k) - 1), k), F.shiftright(b, k)
        run = lambda r: F.struct(F.lit(k).alias("level"), r.alias("run"))
        first = F.when((low % 2 == 1) & (low < high), run(low))
        last = F.when((high % 2 == 1) & (low < high) & ~((low % 2 == 1) & (low == high - 1)), run(high - 1))
        return [first, last]

    return F.array_compact(F.array(*(x for k in range(top + 1) for x in at(k))))


def apply_contradictions(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """facts after decisions (source_fact_id, target_fact_id, decision, decided_at): the latest on each target counts.

    supersedes sets superseded_by_fact_id and invalidated_at, invalidates_target sets invalidated_at, both_valid nothing. A
    decision with a fact that doesn't exist is left out.
    """
    known = facts.select("fact_id")
    d = decisions.join(known.withColumnRenamed("fact_id", "source_fact_id"), "source_fact_id", "left_semi")
    last = d.groupBy("target_fact_id").agg(F.max_by(F.struct("source_fact_id", "decision", "decided_at"), F.struct("decided_at", "source_fact_id")).alias("_d")).where("_d.decision <> 'both_valid'")
    j = facts.join(last, facts["fact_id"] == last["target_fact_id"], "left")
    return j.withColumns(
        {
            "invalidated_at": F.coalesce("_d.decided_at", "invalidated_at"),
            "superseded_by_fact_id": F.when(F.col("_d.decision") == "supersedes", F.col("_d.source_fact_id")).otherwise(F.col("superseded_by_fact_id")),
        }
    ).drop("_d", "target_fact_id")


def episode_replay(steps: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """A row for each episode: its steps within a window of sequence numbers, in order, and its tools in order of first use."""
    s = steps
    if since is not None:
        s = s.where(F.col("sequence") >= since)
    if until is not None:
        s = s.where(F.col("sequence") < until)
    rows = F.array_sort(F.collect_list(F.struct("sequence", "kind", "content", "tool_id")))
    return s.groupBy("episode_id").agg(rows.alias("steps")).select("episode_id", "steps", F.size("steps").alias("n_steps"), F.array_distinct(F.filter(F.transform("steps", lambda x: x["tool_id"]), lambda x: x.isNotNull())).alias("tools"))


def full_replay(steps: DataFrame, outcomes: DataFrame, decisions: DataFrame, episode: str, since=None, until=None, limit: int | None = None) -> DataFrame:
    """(kind, position, id, at, artifact_ids, tool_id) of an episode: steps by sequence, then outcomes and decisions, by their time.

    A limit counts steps from the first, and outcomes and decisions from the newest, before the time window (since inclusive, until exclusive) is looked at.
    """

    def part(df: DataFrame, kind: str, order: list) -> DataFrame:
        own = df.where(F.col("episode_id") == episode).orderBy(*order)
        own = own.limit(limit) if limit is not None else own
        own = own.where(F.col("at") >= since) if since is not None else own
        return (own.where(F.col("at") < until) if until is not None else own).select(F.lit(kind).alias("kind"), "position", "id", "at", "artifact_ids", "tool_id")

    newest = [F.desc("at"), F.desc("id")]
    return part(steps, "step", ["position", "id"]).unionByName(part(outcomes, "outcome", newest)).unionByName(part(decisions, "decision", newest))


def replay_summary(rows: DataFrame) -> DataFrame:
    """One row: how many steps, outcomes and decisions, and artifacts and tools in the order in which steps, outcomes and decisions first name them."""
    rank = F.when(F.col("kind") == "step", 0).when(F.col("kind") == "outcome", 1).otherwise(2)
    first = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda s: s["v"])
    named = rows.withColumn("_rank", rank)
    artifacts = named.select("_rank", "position", "at", "id", F.explode("artifact_ids").alias("v")).groupBy("v").agg(F.min(F.struct("_rank", "position", "at", "id")).alias("k")).agg(first(F.struct("k", "v")).alias("artifacts"))
    tools = named.where("tool_id is not null").groupBy(F.col("tool_id").alias("v")).agg(F.min(F.struct("_rank", "position", "at", "id")).alias("k")).agg(first(F.struct("k", "v")).alias("tools"))
    n = rows.agg(*(F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("step", "outcome", "decision")))
    return n.crossJoin(artifacts).crossJoin(tools)  # one row each
