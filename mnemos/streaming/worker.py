"""A projection worker: events reach a target in their order, a failure stops its target until it may be tried again, and a ledger says how far each target is.

The change log is a table and the ledger is another; a stream over the log only says when to look. Each turn reads the ledger, takes the next events of every target at once,
lets them through up to the first that fails, and writes what was applied and then the ledger, each to a folder of the turn's number. A turn that was cut short is made
again with the same number and overwrites its folders, and a batch of the stream that the ledger knows is left alone: so each event is applied once.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemos.functions.shared import settled
from mnemos.streaming.changes import retry_at

#: Tries after which an event is a dead letter, and events of a target in a turn.
ATTEMPTS, EVENTS = 8, 100
LEDGER = "target_id string, checkpoint long, event_id string, cursor long, attempts int, dead_letter boolean, reason string, next_retry_at timestamp, updated_at timestamp, applied long, failed int, batch long"


def turn(events: DataFrame, ledger: DataFrame, now: Column, outcome: Callable[[DataFrame], DataFrame], most: int = EVENTS, attempts: int = ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """What a turn applies, and the ledger's rows after it, one for each target with events ahead or an earlier row.

    events: target_id, cursor, event_id and any others; a cursor stands once in a target. ledger: a row of each target that has had a turn. outcome adds ok and reason
    to the events ahead; ok that is null is a failure. The next `most` events of a target are taken in the order of their cursors. Those before the first that isn't ok are
    applied; that one has failed once more, and is tried again 1, 2, 4 .. seconds later, 300 at most, until it has failed `attempts` times: then it is a dead letter. A target
    whose failed event is a dead letter, or isn't due yet, does nothing.
    """
    had = ledger.select("target_id", "checkpoint", F.col("event_id").alias("_event"), F.col("attempts").alias("_attempts"), F.col("dead_letter").alias("_dead"), F.col("next_retry_at").alias("_due"))
    j = events.join(had, "target_id", "left").where(F.col("cursor") > F.coalesce("checkpoint", F.lit(0)))
    waits = F.col("_event").isNotNull() & (F.coalesce("_dead", F.lit(False)) | F.coalesce(F.col("_due") > now, F.lit(False)))
    next_ = j.where(~waits).withColumn("_n", F.row_number().over(Window.partitionBy("target_id").orderBy("cursor"))).where(F.col("_n") <= most)
    tried = settled(outcome(next_.select(*events.columns)).withColumn("ok", F.coalesce("ok", F.lit(False))))
    bad = tried.where(~F.col("ok")).groupBy("target_id").agg(F.min_by(F.struct("cursor", "event_id", "reason"), "cursor").alias("_bad"))
    through = tried.join(bad, "target_id", "left").where(F.col("_bad").isNull() | (F.col("cursor") < F.col("_bad.cursor")))
    applied = through.select(*events.columns)
    done = through.groupBy("target_id").agg(F.max("cursor").alias("_last"), F.count("*").alias("_applied"))
    rows = tried.select("target_id").distinct().join(done, "target_id", "left").join(bad, "target_id", "left").join(had, "target_id", "left")
    again = F.when(F.col("_bad.event_id") == F.col("_event"), F.coalesce("_attempts", F.lit(0)) + 1).otherwise(1)
    tries = F.when(F.col("_bad").isNotNull(), again).cast("int")
    dead = F.when(F.col("_bad").isNotNull(), tries >= attempts)
    moved = rows.select(
        "target_id",
        F.coalesce("_last", "checkpoint", F.lit(0)).cast("long").alias("checkpoint"),
        F.col("_bad.event_id").alias("event_id"),
        F.col("_bad.cursor").alias("cursor"),
        tries.alias("attempts"),
        dead.alias("dead_letter"),
        F.col("_bad.reason").alias("reason"),
        F.when(~dead, retry_at(now, tries)).alias("next_retry_at"),
        now.alias("updated_at"),
        F.coalesce("_applied", F.lit(0)).cast("long").alias("applied"),
        F.col("_bad").isNotNull().cast("int").alias("failed"),
    )
    idle = ledger.join(moved.select("target_id"), "target_id", "left_anti").select(*(c for c in moved.columns if c not in ("applied", "failed")), F.lit(0).cast("long").alias("applied"), F.lit(0).alias("failed"))
    return applied, moved.unionByName(idle)


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of a ledger's turns, with their number in the column run; none if there is no turn yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/run=*/_SUCCESS"))
    if not there:
        return spark.createDataFrame([], f"{LEDGER}, run int")
    return spark.read.option("basePath", folder).schema(f"{LEDGER}, run int").parquet(*(s.getPath().getParent().toString() for s in there))


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger as it stands: the rows of its last whole turn."""
    runs = _runs(spark, folder)
    last = runs.agg(F.max("run")).first()[0]
    return runs.where(F.col("run") == (last or 0)).drop("run")


def take_turn(spark: SparkSession, log: DataFrame, target: str, ledger_folder: str, now: Column, outcome: Callable[[DataFrame], DataFrame], most: int = EVENTS, attempts: int = ATTEMPTS, batch: int | None = None) -> bool:
    """Makes the next turn and writes it to target/run=N and ledger_folder/run=N; False if the ledger knows the stream's batch already.

    The least checkpoint of the ledger reaches the log's scan as a filter.
    """
    runs = _runs(spark, ledger_folder)
    had = runs.agg(F.max("run").alias("run"), F.max("batch").alias("batch")).first()
    if batch is not None and had["batch"] is not None and batch <= had["batch"]:
        return False
    number = (had["run"] or 0) + 1
    own = runs.where(F.col("run") == number - 1).drop("run")
    low = own.agg(F.min("checkpoint")).first()[0]
    known = own.select("target_id")
    # Targets without a row start at the log's beginning, all others past the least checkpoint.
    ahead = log if low is None else log.where(F.col("cursor") > low).unionByName(log.where(F.col("cursor") <= low).join(known, "target_id", "left_anti").select(*log.columns))
    applied, after = turn(ahead, own, now, outcome, most, attempts)
    applied.write.mode("overwrite").parquet(f"{target}/run={number}")
    noted = F.lit(batch if batch is not None else had["batch"]).cast("long")
    after.withColumn("batch", noted).select(*(c.split()[0] for c in LEDGER.split(", "))).write.mode("overwrite").parquet(f"{ledger_folder}/run={number}")
    return True


def work(wakes: DataFrame, log: Callable[[], DataFrame], target: str, ledger_folder: str, checkpoint: str, clock: Callable[[], Column], outcome: Callable[[DataFrame, Column], DataFrame], most: int = EVENTS, attempts: int = ATTEMPTS, available_now: bool = True):
    """Starts a query that makes a turn for each batch of a stream. wakes: a stream over the log (or a rate, so that failed events are tried again without new ones).

    log: gives the log's table as it is now; clock: gives the time; outcome: of events and the time. At most one query may use a ledger.
    """

    def make(batch: DataFrame, number: int) -> None:
        now = clock()
        take_turn(batch.sparkSession, log(), target, ledger_folder, now, lambda e: outcome(e, now), most, attempts, number)

    writer = wakes.writeStream.foreachBatch(make).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def applied_events(spark: SparkSession, target: str, ledger_folder: str, schema: str) -> DataFrame:
    """The events that whole turns have applied: what a turn wrote before it was cut short, and hasn't made again yet, isn't among them."""
    runs = _runs(spark, ledger_folder).select("run").distinct()
    return spark.read.schema(f"{schema}, run int").option("basePath", target).parquet(target).join(F.broadcast(runs), "run", "left_semi")
