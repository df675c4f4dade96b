"""Changes of tables as DataFrames: what stands after rows were put, patched, reviewed or replaced.

Nothing is changed in place. Each function gives the table as it stands afterwards, or the rows to append to the change log.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemos.functions.columns import uuid5
from mnemos.functions.shared import settled

#: Classes that memory blocks may have, modes that are in use, and modes that are known but not yet in use.
BLOCK_CLASSES = ("agent_identity", "active_mission", "session_pin")
BLOCK_MODES, LATER_MODES = ("read_only", "pinned"), ("shared", "writable")
#: The namespace of ids that are made here.
IDS = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def same_key(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    """The keys of two tables are equal; nulls equal nulls."""
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in key))


def last_of(rows: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """The last row of each key (null is a key too) by a column; without one, or among equals, the greatest by its columns as they come."""
    rest = [c for c in rows.columns if c not in key]
    by = F.struct(*([order] if order else []), *(c for c in rest if not isinstance(rows.schema[c].dataType, (T.MapType, T.VariantType))), F.lit(0).alias("_end"))
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest, F.lit(0).alias("_end")), by).alias("_row"))
    return best.select(*(c if c in key else F.col(f"_row.{c}").alias(c) for c in rows.columns))


def put(table: DataFrame, rows: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """table with rows in the place of those that have their key, nulls included. Of several new rows with one key the last by `order` stands."""
    new = last_of(rows, key, order)
    return table.join(new.select(*key), same_key(table, new, key), "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def upserted(records: DataFrame, patches: DataFrame, now: Column, order: str | None = None) -> DataFrame:
    """records after patches (scope, type, key and any columns of records; null: not patched).

    A patch changes the newest version of its scope, type and key (by updated_at, then the smallest id; nulls equal nulls) and its updated_at. Where there
    is none, it becomes a record: with the id of a hash of the three unless it has one, working tier, and created, updated and begun now. Several patches of a
    key are one after another by `order`, a column of patches: of each column the last that isn't null stands. Without an order the greatest does.
    """
    key = ["scope", "type", "key"]
    patched = [c for c in patches.columns if c not in key and c != order]
    fold = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))) if order else F.max(c)
    p = patches.groupBy(*key).agg(F.struct(*(fold(c).alias(c) for c in patched), F.lit(0).alias("_end")).alias("_p"))
    newest = records.groupBy(*key).agg(F.min_by("id", F.struct(-F.unix_micros(F.col("updated_at").cast("timestamp")), F.col("id"))).alias("_newest"))
    p = p.join(newest, same_key(p, newest, key), "left").select(*(p[c] for c in key), "_p", "_newest")
    met = p.where("_newest is not null").select(F.col("_newest").alias("_id"), F.col("_p"))
    value = lambda c: F.coalesce(F.col(f"_p.{c}"), F.col(c)) if c in patched and c != "id" else F.col(c)
    changed = records.join(met, records["id"] == met["_id"], "left").select(*((F.when(F.col("_p").isNotNull(), now).otherwise(F.col(c)) if c == "updated_at" else value(c)).alias(c) for c in records.columns))
    defaults = {
        "id": uuid5(IDS, F.concat_ws("|", *key)),
        "tier": F.lit("working"),
        "created_at": now,
        "updated_at": now,
        "event_time": F.coalesce(F.col("_p.created_at"), now) if "created_at" in patched else now,
    }
    made = p.where("_newest is null").select(
        *((F.col(c) if c in key else F.coalesce(*([F.col(f"_p.{c}")] if c in patched else []), *([defaults[c]] if c in defaults else []), F.lit(None).cast(records.schema[c].dataType))).alias(c) for c in records.columns)
    )
    return changed.unionByName(made)


def replaced(table: DataFrame, rows: DataFrame, owner: str, owners: DataFrame | None = None) -> DataFrame:
    """table where the rows of each owner in `rows` (and in owners, who may have no rows any more) give way to the new ones."""
    those = rows.select(owner) if owners is None else rows.select(owner).unionByName(owners.select(owner))
    return table.join(those.distinct(), owner, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def reviewed(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """candidates after decisions (candidate_id, action approve or reject, reviewer, decided_at, note): the last on each counts."""
    last = decisions.groupBy("candidate_id").agg(F.max_by(F.struct("action", "reviewer", "decided_at", "note"), F.struct("decided_at", "reviewer")).alias("_d"))
    status = F.when(F.col("_d.action") == "approve", "approved").when(F.col("_d").isNotNull(), "rejected").otherwise(F.col("status"))
    new = {"status": status, "reviewer": F.col("_d.reviewer"), "decided_at": F.col("_d.decided_at"), "updated_at": F.coalesce("_d.decided_at", "updated_at")}
    kept = [c for c in candidates.columns if c not in ("reviewer", "decided_at")]
    return candidates.join(last, "candidate_id", "left").select(*(new.get(c, F.col(c)).alias(c) for c in kept), new["reviewer"].alias("reviewer"), new["decided_at"].alias("decided_at"))


def promotion_plan(candidates: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (candidate_id, target_scope, evidence_refs, which may be null: all of the candidate's) with `refusal`: unknown_candidate,
    not_approved, evidence_not_of_candidate or null; and with the evidence that is taken along."""
    c = candidates.select("candidate_id", F.col("status").alias("_status"), F.col("evidence_refs").alias("_own"))
    refs = F.when(F.size("evidence_refs") > 0, F.col("evidence_refs")).otherwise(F.col("_own"))
    refusal = (
        F.when(F.col("_status").isNull(), "unknown_candidate").when(F.col("_status") != "approved", "not_approved").when(F.size(F.array_except(refs, "_own")) > 0, "evidence_not_of_candidate")
    )
    return wanted.join(c, "candidate_id", "left").select("candidate_id", "target_scope", refs.alias("evidence_refs"), refusal.alias("refusal"))


def promoted(candidates: DataFrame, plan: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Records of the candidates that the plan promotes, and candidates with these marked as promoted."""
    go = plan.where("refusal is null").select("candidate_id", "target_scope")
    c = candidates.join(go, "candidate_id")
    records = c.select(
        uuid5(IDS, F.concat(F.lit("promoted|"), "candidate_id")).alias("id"),
        F.col("target_scope").alias("scope"),
        "type",
        "key",
        "title",
        "content",
        F.coalesce("created_at", now).alias("created_at"),
        now.alias("updated_at"),
        F.coalesce("created_at", now).alias("event_time"),
        "confidence",
        "evidence_refs",
    )
    done = candidates.join(go.select("candidate_id", F.lit(True).alias("_go")), "candidate_id", "left")
    new = {"status": F.when(F.col("_go"), "promoted").otherwise(F.col("status")), "updated_at": F.when(F.col("_go"), now).otherwise(F.col("updated_at"))}
    return records, done.select(*(new.get(c, F.col(c)).alias(c) for c in candidates.columns))


def block_refusal(classes=BLOCK_CLASSES, modes=BLOCK_MODES, later=LATER_MODES) -> Column:
    """Why a memory block (class_name, mode) may not be created, or null."""
    return F.when(~F.coalesce(F.col("class_name").isin(*classes), F.lit(False)), "class_not_eligible").when(F.col("mode").isin(*later), "mode_not_yet_supported").when(~F.coalesce(F.col("mode").isin(*modes), F.lit(False)), "mode_invalid")


def edit_refusal(operator_action: Column) -> Column:
    """Why a block may not be edited or deleted, or null: read-only blocks never, pinned ones by an operator only."""
    return F.when(F.col("mode") == "read_only", "read_only_block").when((F.col("mode") == "pinned") & ~operator_action, "operator_action_required")


def edited_blocks(blocks: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """blocks after edits (block_id, new_content, actor, operator_action, at; one for each block), and the edits with their `refusal` (not_found too)."""
    asked = edits.join(blocks.select("block_id", "mode"), "block_id", "left").withColumn("refusal", F.when(F.col("mode").isNull(), "not_found").otherwise(edit_refusal(F.col("operator_action")))).drop("mode")
    ok = asked.where("refusal is null").select("block_id", F.struct("new_content", "actor", "at").alias("_e"))
    new = {"content": F.coalesce("_e.new_content", "content"), "last_updated_by": F.coalesce("_e.actor", "last_updated_by"), "last_updated_at": F.coalesce("_e.at", "last_updated_at")}
    return blocks.join(ok, "block_id", "left").select(*(new.get(c, F.col(c)).alias(c) for c in blocks.columns)), asked


def put_embeddings(table: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table (record_id, vector_space, dimension, ...) after new rows, and the rows refused because their key has another dimension."""
    key = ["record_id", "vector_space"]
    had = table.select(*key, F.col("dimension").alias("_had"))
    met = rows.join(had, key, "left")
    good = met.where("_had is null or _had = dimension").drop("_had")
    return put(table, good, key), met.where("_had <> dimension").select(*rows.columns)


def put_ontologies(table: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table (ontology_id, version, payload) after new rows, and those in conflict: the same version stands with another payload."""
    key = ["ontology_id", "version"]
    met = rows.join(table.select(*key, F.sha2(F.col("payload").cast("binary"), 256).alias("_had")), key, "left")
    same = F.col("_had") == F.sha2(F.col("payload").cast("binary"), 256)
    return put(table, met.where(F.col("_had").isNull()).drop("_had"), key), met.where(~same).select(*rows.columns)


def numbered_events(log: DataFrame, events: DataFrame, order: list[str], parts: int = 64) -> DataFrame:
    """events with cursors that go on from the log's, in the given order.

    The order is dealt to ranges first; each range is numbered by itself and starts after the sizes of the ranges before, so that no task has
    all events.
    """
    last = log.agg(F.coalesce(F.max("cursor"), F.lit(0)).alias("_last"))
    ranged = settled(events.drop("cursor").repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").count()
    before = sizes.select("_range", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    met = ranged.withColumn("_n", place).join(F.broadcast(before), "_range").join(F.broadcast(last))
    return met.withColumn("cursor", F.col("_last") + F.col("_before") + F.col("_n")).drop("_range", "_n", "_before", "_last")
