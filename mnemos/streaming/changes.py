"""The change log as a stream, and its projection onto target tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemos.schemas import CHANGES


def deduplicated(events: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """Events whose event_id and idempotency key weren't seen before, neither in `applied` nor at a smaller cursor."""
    out = events
    if applied is not None:
        out = out.join(applied.select("event_id"), "event_id", "left_anti")
        out = out.join(applied.where("idempotency_key is not null").select("idempotency_key"), "idempotency_key", "left_anti").select(*events.columns)
    # An event without a key gets one of its own, so that they don't all meet in one task.
    key = F.coalesce(F.concat(F.lit("k:"), "idempotency_key"), F.concat(F.lit("e:"), "event_id"))
    out = out.withColumn("_first", F.row_number().over(Window.partitionBy("event_id").orderBy("cursor"))).where("_first = 1")
    return out.withColumn("_first", F.row_number().over(Window.partitionBy(key).orderBy("cursor"))).where("_first = 1").drop("_first")


def read_log(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the change events in a folder of parquet files."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def project(log: DataFrame, target: str, checkpoint: str, available_now: bool = True):
    """Starts a query that writes the events of each batch, at most one for each object, to target/batch=N.

    A batch that runs again overwrites its own folder, and readers take the last event of each object, so replays
    change nothing. Spark's checkpoint keeps the position; at most one query may use it.
    """

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("object_type", "object_id").agg(F.max_by(F.struct(*[c for c in batch.columns if c not in ("object_type", "object_id")]), "cursor").alias("_e"))
        last.select("object_type", "object_id", "_e.*").write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def projected(spark: SparkSession, target: str) -> DataFrame:
    """The live objects of a projection's target."""
    from mnemos.operators.records import live

    return live(spark.read.schema(CHANGES).parquet(target).select(*[c.split()[0] for c in CHANGES.split(", ")]))


def graph_changes(events: DataFrame) -> DataFrame:
    """(cursor, object_id, action, kind): what a graph target has to do: records are nodes, relations and links are edges."""
    kind = F.when(F.col("object_type") == "record", "node").when(F.col("object_type").isin("relation", "link"), "edge")
    return events.select("cursor", "object_id", F.when(F.col("operation") == "delete", "delete").otherwise("upsert").alias("action"), kind.alias("kind")).where("kind is not null")


def health(events: DataFrame, checkpoint: int, failures: DataFrame) -> DataFrame:
    """(head, checkpoint, lag, retries, dead_letters) of a projection. failures: dead_letter."""
    head = events.agg(F.coalesce(F.max("cursor"), F.lit(0)).alias("head"))
    counts = failures.agg(F.count_if(~F.col("dead_letter")).alias("retries"), F.count_if("dead_letter").alias("dead_letters"))
    return head.crossJoin(counts).select("head", F.lit(checkpoint).cast("long").alias("checkpoint"), F.greatest(F.lit(0).cast("long"), F.col("head") - checkpoint).alias("lag"), "retries", "dead_letters")


def retry_at(failed_at, attempts):
    """When to try again after `attempts` failures: 1, 2, 4 .. seconds later, 300 at most."""
    return F.timestamp_seconds(failed_at.cast("double") + F.least(F.lit(300.0), F.pow(F.lit(2.0), attempts - 1)))


def vector_changes(events: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(cursor, point_id, action, record_id, vector_space, vector): what a vector target has to do for embedding events.

    events: cursor, object_type, object_id, operation, record_id, vector_space. The last event of each point counts; vectors are read from embeddings as they
    stand, and an event whose vector isn't there is `unavailable`, a failure that is tried again.
    """
    own = events.where("object_type = 'embedding'")
    last = own.groupBy(F.col("object_id").alias("point_id")).agg(F.max_by(F.struct("cursor", "operation", "record_id", "vector_space"), "cursor").alias("_e")).select("point_id", "_e.*")
    met = last.join(embeddings.select("record_id", "vector_space", "vector"), ["record_id", "vector_space"], "left")
    action = F.when(F.col("operation") == "delete", "delete").when(F.col("vector").isNull(), "unavailable").otherwise("upsert")
    return met.select("cursor", "point_id", action.alias("action"), "record_id", "vector_space", F.when(action == "upsert", F.col("vector")).alias("vector"))


def out_of_order(batch: DataFrame, after: int) -> DataFrame:
    """Events that a batch may not have: cursors that are null, not past `after`, or there twice."""
    twice = batch.groupBy("cursor").agg(F.count("*").alias("_n")).where("_n > 1").select("cursor")
    return batch.where(F.col("cursor").isNull() | (F.col("cursor") <= after)).unionByName(batch.join(twice, "cursor", "left_semi").select(*batch.columns)).distinct()


def batch_plan(events: DataFrame, failures: DataFrame, checkpoint: int, most: int, now, attempts: int = 8) -> DataFrame:
    """(cursor, event_id, decision) of the next events after a checkpoint: apply, wait (an earlier try failed and its time hasn't come), or blocked behind such a one.

    failures: event_id, failed_attempts, failed_at. An event that failed `attempts` times is a dead letter and doesn't hold up the others. Only `most` events are looked at.
    """
    ahead = events.where(F.col("cursor") > checkpoint).orderBy("cursor").limit(most)
    j = ahead.join(failures, "event_id", "left")
    dead = F.coalesce(F.col("failed_attempts") >= attempts, F.lit(False))
    waits = F.col("failed_attempts").isNotNull() & ~dead & (retry_at(F.col("failed_at"), F.col("failed_attempts")) > now)
    first = j.where(waits).agg(F.min("cursor").alias("_stop"))
    decision = F.when(dead, "dead_letter").when(F.col("cursor") == F.col("_stop"), "wait").when(F.col("cursor") > F.col("_stop"), "blocked").otherwise("apply")
    return j.crossJoin(F.broadcast(first)).select("cursor", "event_id", decision.alias("decision"))  # one row by one row


def after_batch(plan: DataFrame, checkpoint: int) -> DataFrame:
    """One row: the checkpoint after a batch's events up to the first that waits, how many were applied and how many are dead letters."""
    done = F.col("decision").isin("apply", "dead_letter")
    return plan.agg(F.coalesce(F.max(F.when(done, F.col("cursor"))), F.lit(checkpoint)).alias("checkpoint"), F.count_if(F.col("decision") == "apply").alias("applied"), F.count_if(F.col("decision") == "dead_letter").alias("dead_letters"))
