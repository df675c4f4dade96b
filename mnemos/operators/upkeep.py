"""Inspection, freshness, synchronisation, reconciliation and embedding upkeep."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemos.functions.shared import spread
from mnemos.operators.policy import first_of


def inspection(records: DataFrame, links: DataFrame, facts: DataFrame, known_sources: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(kind, subject_id) findings. records: id, aliases[], source_id; links: link_id, source and target ids, status."""
    ids = records.select("id")
    dangling = links.join(ids, links["target_record_id"] == ids["id"], "left_anti").where("target_record_id is not null or resolution_status = 'unresolved'")
    unresolved = dangling.unionByName(links.where("resolution_status = 'unresolved'")).select(F.col("link_id").alias("subject_id")).distinct()
    ends = links.select(F.col("source_record_id").alias("id")).unionByName(links.select(F.col("target_record_id").alias("id")))
    aliases = records.select(F.explode("aliases").alias("subject_id")).groupBy("subject_id").agg(F.count("*").alias("n")).where("n > 1")
    broken = records.where("source_id is not null").join(known_sources.select("source_id"), "source_id", "left_anti") if not known_sources.isEmpty() else records.limit(0)
    parts = {
        "unresolved_link": unresolved,
        "orphan_record": records.join(ends, "id", "left_anti").select(F.col("id").alias("subject_id")),
        "duplicate_alias": aliases.select("subject_id"),
        "stale_fact": facts.where("invalidated_at is not null or valid_to is not null").select(F.col("fact_id").alias("subject_id")),
        "broken_source_reference": broken.select(F.col("id").alias("subject_id")),
        "open_conflict": conflicts.where("status = 'open'").select(F.col("conflict_id").alias("subject_id")),
    }
    out = None
    for kind, df in parts.items():
        df = df.select(F.lit(kind).alias("kind"), "subject_id")
        out = df if out is None else out.unionByName(df)
    return out


def replay_decisions(incoming: DataFrame, ledger: DataFrame) -> DataFrame:
    """incoming (source_id, cursor, hash, rebuild) with a decision against the ledger (source_id, cursor, hash, status)."""
    l = ledger.select("source_id", F.col("cursor").alias("_c"), F.col("hash").alias("_h"), F.col("status").alias("_s"), F.lit(True).alias("_there"))
    rules = [(F.col("rebuild"), "rebuild_required"), (F.col("_there").isNull(), "ingest_changed"), (F.col("_s") == "failed", "retry_failed"), ((F.col("cursor") == F.col("_c")) | (F.col("hash") == F.col("_h")), "skip_unchanged")]
    return incoming.join(l, "source_id", "left").withColumn("decision", first_of(rules, "ingest_changed")).drop("_c", "_h", "_s", "_there")


def sync_status() -> Column:
    """The state of a path: file_hash, record_hash (null: gone) against file_was and record_was."""
    file, record = ~F.col("file_hash").eqNullSafe(F.col("file_was")), ~F.col("record_hash").eqNullSafe(F.col("record_was"))
    return first_of([(F.col("file_hash").isNull(), "missing_file"), (F.col("record_hash").isNull(), "missing_record"), (~file & ~record, "unchanged"), (file & record, "conflict"), (file, "file_changed")], "record_changed")


def workspace_scan(files: DataFrame, ledger: DataFrame, records: DataFrame) -> DataFrame:
    """(path, previous_path, kind) of what changed between files (path, hash), the ledger (path, hash, record_id) and records (record_id, hash).

    A created and a deleted path with the same hash are one renamed path, paired in path order.
    """
    f = files.select("path", F.col("hash").alias("_f"))
    l = ledger.select("path", F.col("hash").alias("_l"), "record_id").join(records.select("record_id", F.col("hash").alias("_r")), "record_id", "left")
    differs = F.col("_r").isNotNull() & (F.col("_r") != F.col("_l"))
    kind = first_of(
        [
            (F.col("_l").isNull(), "created"),
            (F.col("_f").isNull() & differs, "conflict"),
            (F.col("_f").isNull(), "deleted"),
            (F.col("record_id").isNotNull() & F.col("_r").isNull(), "modified"),
            ((F.col("_f") == F.col("_l")) & ~differs, "unchanged"),
            (differs, "conflict"),
        ],
        "modified",
    )
    all_ = f.join(l, "path", "full_outer").withColumn("kind", kind).where("kind <> 'unchanged'")
    place = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("path"))
    new = all_.where("kind = 'created'").select("path", F.col("_f").alias("h"), place("_f").alias("n"))
    old = all_.where("kind = 'deleted'").select(F.col("path").alias("previous_path"), F.col("_l").alias("h"), place("_l").alias("n"))
    renamed = new.join(old, ["h", "n"]).select("path", "previous_path", F.lit("renamed").alias("kind"))
    gone = renamed.select("path").unionByName(renamed.select(F.col("previous_path").alias("path")))
    return all_.join(gone, "path", "left_anti").select("path", F.lit(None).cast("string").alias("previous_path"), "kind").unionByName(renamed)


def three_way(base: DataFrame, local: DataFrame, remote: DataFrame, key: list[str]) -> DataFrame:
    """key, value and conflict: the side that changed a value (by key) wins; where both did, differently, the base stays and conflict is true."""
    j = base.select(*key, F.col("value").alias("_b")).join(local.select(*key, F.col("value").alias("_l")), key, "full_outer").join(remote.select(*key, F.col("value").alias("_r")), key, "full_outer")
    same = F.col("_l").eqNullSafe(F.col("_r"))
    own, other = F.col("_l").eqNullSafe(F.col("_b")), F.col("_r").eqNullSafe(F.col("_b"))
    value = F.when(same, F.col("_l")).when(own, F.col("_r")).when(other, F.col("_l")).otherwise(F.col("_b"))
    return j.select(*key, value.alias("value"), (~same & ~own & ~other).alias("conflict")).where("value is not null or conflict")


def set_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(object_id, change): added, removed or unchanged, by membership alone."""
    a, b = old.select("object_id", F.lit(True).alias("_a")).distinct(), new.select("object_id", F.lit(True).alias("_b")).distinct()
    return a.join(b, "object_id", "full_outer").select("object_id", first_of([(F.col("_a").isNull(), "added"), (F.col("_b").isNull(), "removed")], "unchanged").alias("change"))


def reconciliation(canonical: DataFrame, target: DataFrame) -> DataFrame:
    """(object_kind, object_id, finding, action): what a projection target (kind, id, hash) misses, holds stale or shouldn't hold."""
    c, t = canonical.select("object_kind", "object_id", F.col("hash").alias("_c"), F.lit(1).alias("_in_c")), target.select("object_kind", "object_id", F.col("hash").alias("_t"), F.lit(1).alias("_in_t"))
    found = first_of([(F.col("_in_t").isNull(), "missing"), (F.col("_in_c").isNull(), "orphan"), (F.col("_t").isNull(), "unverifiable"), (F.col("_c") != F.col("_t"), "stale")])
    out = c.join(t, ["object_kind", "object_id"], "full_outer").withColumn("finding", found).where("finding is not null")
    return out.select("object_kind", "object_id", "finding", F.when(F.col("finding") == "orphan", "delete").when(F.col("finding").isin("missing", "stale"), "upsert").alias("action"))


def stale_embeddings(embeddings: DataFrame, records: DataFrame, active: DataFrame) -> DataFrame:
    """(record_id, vector_space, reasons[]): the record changed later, or provider, model or dimension isn't in the active set (the first of these three).

    active: provider, model, dimension; a small table.
    """
    providers = active.groupBy("provider").agg(F.collect_set("model").alias("_models"), F.collect_set(F.struct("model", "dimension")).alias("_sizes"))
    e = embeddings.join(spread(providers), "provider", "left").join(records.select(F.col("id").alias("record_id"), F.col("updated_at").alias("_changed")), "record_id", "left")
    fits = F.exists("_sizes", lambda s: (s["model"] == F.col("model")) & (s["dimension"] == F.col("dimension")))
    other = first_of([(F.col("_models").isNull(), "PROVIDER_NOT_IN_ACTIVE_SET"), (~F.array_contains("_models", F.col("model")), "MODEL_NOT_IN_ACTIVE_SET"), (~fits, "DIMENSION_MISMATCH")])
    reasons = F.array_compact(F.array(F.when(F.col("_changed") > F.col("updated_at"), F.lit("RECORD_UPDATED_AFTER_EMBEDDING")), other))
    return e.select("record_id", "vector_space", reasons.alias("reasons")).where(F.size("reasons") > 0)


def batches(findings: DataFrame, order: list[str], size: int, after: tuple | None = None) -> DataFrame:
    """findings with the number of their batch in the given order; `after`: only those past this key, to resume."""
    if after is not None:
        findings = findings.where(F.struct(*order) > F.struct(*(F.lit(x) for x in after)))
    # Ranges are sorted apart and then offset by the sizes of those before, so no task numbers all rows.
    spread = findings.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_k": F.struct(*order)})
    from mnemos.functions.shared import settled

    spread = settled(spread)
    local = spread.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy("_k")))
    sizes = spread.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each partition
    out = local.join(F.broadcast(before.select("_p", F.coalesce("_before", F.lit(0)).alias("_before"))), "_p")
    return out.withColumn("batch", F.floor((F.col("_before") + F.col("_i") - 1) / size).cast("int")).drop("_p", "_k", "_i", "_before")


def mirrored(mirrors: DataFrame, sources: DataFrame) -> DataFrame:
    """mirrors (block_id, mirror_hash, ...) of shared blocks with source_hash and status: fresh if the source (block_id, hash) is as mirrored, else stale."""
    s = sources.select("block_id", F.col("hash").alias("source_hash"))
    status = F.when(F.col("source_hash") == F.col("mirror_hash"), "fresh").otherwise("stale")
    return mirrors.drop("source_hash", "status").join(s, "block_id", "left").withColumn("status", status)


def shared_conflicts(edits: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edits (block_id, attempted_by, base_hash, proposed_hash) of shared blocks (block_id, hash) that start from another text than stands, and would change it."""
    j = edits.join(blocks.select("block_id", F.col("hash").alias("_now")), "block_id")
    return j.where((F.col("_now") != F.col("base_hash")) & (F.col("_now") != F.col("proposed_hash"))).drop("_now")


def restored(current: DataFrame, revision: DataFrame, key: str) -> DataFrame:
    """(key, action) that take a table back to a revision (key, content_hash): create what is gone, update what differs, delete what came later."""
    a, b = current.select(key, F.col("content_hash").alias("_a"), F.lit(True).alias("_x")), revision.select(key, F.col("content_hash").alias("_b"), F.lit(True).alias("_y"))
    action = F.when(F.col("_x").isNull(), "create").when(F.col("_y").isNull(), "delete").when(~F.col("_a").eqNullSafe(F.col("_b")), "update")
    return a.join(b, key, "full").select(key, action.alias("action")).where("action is not null")


def consolidation_summary(decisions: DataFrame) -> DataFrame:
    """(transition, n): how many records went from one phase to another; those that stayed aren't counted."""
    return decisions.where("phase <> next_phase").groupBy(F.concat_ws("_to_", "phase", "next_phase").alias("transition")).agg(F.count("*").alias("n"))


def accepted(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """Items of a connector (source_id, content_hash, cursor) with `decision`: skip if the ledger (source_id, content_hash, status) has the same hash and didn't fail."""
    had = ledger.select("source_id", F.col("content_hash").alias("_had"), F.col("status").alias("_status"))
    same = (F.col("_had") == F.col("content_hash")) & (F.col("_status") != "failed")
    return items.join(had, "source_id", "left").withColumn("decision", F.when(F.coalesce(same, F.lit(False)), "skip").otherwise("accept")).drop("_had", "_status")


def to_ingest(items: DataFrame, completed: DataFrame) -> DataFrame:
    """Items (item_id, ...) that a checkpoint (item_id) has not completed; repeated ones once."""
    return items.join(completed.select("item_id"), "item_id", "left_anti").dropDuplicates(["item_id"])


def version_hash(columns: list[str]) -> Column:
    """The hash by which an inventory tells versions of a row apart."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)


def revisions(history: DataFrame, key: str) -> DataFrame:
    """(key, revision, content_hash, at): the versions of each key (key, content_hash, at) whose content differs from the one before, numbered from 1."""
    w = Window.partitionBy(key).orderBy("at")
    changed = history.withColumn("_was", F.lag("content_hash").over(w)).where("_was is null or _was <> content_hash")
    return changed.withColumn("revision", F.row_number().over(w)).select(key, "revision", "content_hash", "at")
