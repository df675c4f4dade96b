"""Taking things in from connectors: envelopes, batches that go on from a checkpoint, and what an erasure leaves behind."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.functions.columns import uuid5
from mnemos.functions.shared import settled
from mnemos.operators.graph import URL_NAMESPACE
from mnemos.operators.policy import first_of

#: What connectors may say of themselves and of what they bring.
SOURCE_TYPES = ("file", "api", "webhook", "manual", "test_fake")
PERMISSIONS = ("read_only", "read_write", "metadata_only")
PAYLOADS = ("document", "record", "link", "artifact", "batch")


def _unknown(column: str, known: tuple) -> tuple[Column, str]:
    return ~F.coalesce(F.col(column).isin(*known), F.lit(False)), f"invalid {column}"


def _missing(column: str) -> tuple[Column, str]:
    return F.coalesce(F.col(column).cast("string"), F.lit("")) == "", f"{column} is required"


def registered(entries: DataFrame, registry: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """The registry (source_id, source_type, namespace, display_name, permission_scope, cursor, content_hash, created_at, updated_at) with new entries, and the refused ones with why.

    An entry takes the place of that of its source, whose created_at it keeps.
    """
    judged = entries.withColumn("refusal", first_of([_missing("source_id"), _unknown("source_type", SOURCE_TYPES), _missing("namespace"), _missing("display_name"), _unknown("permission_scope", PERMISSIONS)]))
    new = judged.where("refusal is null").drop("refusal").join(registry.select("source_id", F.col("created_at").alias("_was")), "source_id", "left")
    new = new.withColumns({"created_at": F.coalesce("_was", at), "updated_at": at}).select(*registry.columns)
    return registry.join(new.select("source_id"), "source_id", "left_anti").select(*registry.columns).unionByName(new), judged.where("refusal is not null")


def enveloped(items: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Envelopes (ingest_id, and the items' columns) of items (source_id, namespace, payload_kind, payload, cursor, content_hash, permission_scope), and the refused items with why.

    The id is that of source, cursor and hash, so an item that comes again has the id it had. An item may not ask for more than its source's entry permits: a source that reads
    only brings no writes, and one for metadata only no payload.
    """
    known = registry.select("source_id", F.col("permission_scope").alias("_may"))
    j = items.join(known, "source_id", "left")
    more = (F.col("_may") != "read_write") & (F.col("permission_scope") == "read_write") | (F.col("_may") == "metadata_only") & (F.col("permission_scope") != "metadata_only")
    rules = [_missing("source_id"), (F.col("_may").isNull(), "unknown source"), _missing("namespace"), _unknown("payload_kind", PAYLOADS), (F.col("payload").isNull(), "payload is required"), _unknown("permission_scope", PERMISSIONS), (more, "permission exceeded")]
    judged = j.withColumn("refusal", first_of(rules)).drop("_may")
    key = F.concat(F.col("source_id"), F.lit(":"), F.coalesce("cursor", F.lit("")), F.lit(":"), F.coalesce("content_hash", F.lit("")))
    good = judged.where("refusal is null").drop("refusal")
    return good.select(F.concat(F.lit("ingest-"), uuid5(URL_NAMESPACE, key)).alias("ingest_id"), *items.columns), judged.where("refusal is not null")


def ingested(envelopes: DataFrame, completed: DataFrame, outcome: Callable[[DataFrame], DataFrame], most: int | None = None, continue_on_error: bool = False) -> tuple[DataFrame, DataFrame, bool]:
    """Results (ingest_id, position, status, error) of a batch's next items, the checkpoint (ingest_id) after them, and whether the batch is complete.

    envelopes: ingest_id and position, each once. Items that the checkpoint has are passed over; the next `most` go by position. outcome adds accepted and error: an item with an error
    failed, one that isn't accepted is skipped. Without continue_on_error nothing after the first failed item is done. Accepted and skipped items are completed.
    """
    ahead = envelopes.join(completed.select("ingest_id"), "ingest_id", "left_anti").orderBy("position")
    ahead = ahead.limit(most) if most is not None else ahead
    tried = settled(outcome(ahead))
    if not continue_on_error:
        stop = tried.where("error is not null").agg(F.min("position").alias("_stop"))
        tried = tried.join(F.broadcast(stop), F.lit(True)).where(F.col("_stop").isNull() | (F.col("position") <= F.col("_stop")))  # one row
    status = F.when(F.col("error").isNotNull(), "failed").when(F.coalesce("accepted", F.lit(False)), "accepted").otherwise("skipped")
    results = tried.select("ingest_id", "position", status.alias("status"), "error")
    done = settled(completed.select("ingest_id").unionByName(results.where("status <> 'failed'").select("ingest_id")).distinct())
    return results, done, envelopes.join(done, "ingest_id", "left_anti").isEmpty()


def erasure_audit(records: DataFrame, tables: dict[str, tuple[DataFrame, list[str], str]], roots: DataFrame, reason: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(table, removed_id, record_id) of the rows that an erasure of roots (id) takes out of the tables, and an audit entry (record_id, namespace, deleted_at, reason, cascaded) for each record.

    tables: by name the table, its columns that name records, and its id. records: id, namespace, parent_id: records whose parent is erased go with it, at any depth, as cascaded ones.
    """
    gone = settled(roots.select("id").join(records.select("id"), "id", "left_semi").distinct().withColumn("cascaded", F.lit(False)))
    level = gone
    while not level.isEmpty():
        children = records.join(level.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id")
        level = settled(children.join(gone.select("id"), "id", "left_anti").distinct().withColumn("cascaded", F.lit(True)))
        gone = gone.unionByName(level)
    gone = settled(gone)
    removed = None
    for name, (df, columns, key) in tables.items():
        named = df.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("removed_id"), F.explode(F.array_distinct(F.array(*columns))).alias("record_id"))
        part = named.join(gone.select(F.col("id").alias("record_id")), "record_id", "left_semi").groupBy("table", "removed_id").agg(F.min("record_id").alias("record_id"))
        removed = part if removed is None else removed.unionByName(part)
    entries = gone.join(records.select("id", "namespace"), "id").select(F.col("id").alias("record_id"), "namespace", at.alias("deleted_at"), F.lit(reason).alias("reason"), "cascaded")
    return removed, entries
