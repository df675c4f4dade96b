"""Keeping records in step with a folder of files that others edit: poll, apply, status.

A poll compares what the folder holds with a ledger of what was last taken in and with the records as they are. A stream of files would show new paths only, neither edits nor
deletions, so each poll lists the folder. All tables are small rows by path; texts are read for paths that are taken in alone.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemos.functions.columns import uuid5
from mnemos.operators.graph import URL_NAMESPACE
from mnemos.operators.upkeep import workspace_scan
from mnemos.operators.vault import file_kind

#: What a sync keeps: the ledger, a row for each path ever taken in; records by their files; and conflicts.
LEDGER = "path string, hash string, record_id string, status string, superseded_by string, updated_at timestamp"
RECORDS = "record_id string, path string, content string, hash string, updated_at timestamp"
CONFLICTS = "conflict_id string, path string, file_hash string, record_hash string, status string, found_at timestamp"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, hash) of the files below a folder, by paths relative to it."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.substring(F.url_decode("path"), F.lit(len(root) + 2), F.length("path"))
    return files.select(F.when(F.col("path").startswith(root + "/"), path).otherwise(F.substring_index("path", "/", -1)).alias("path"), F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("hash"))


def _fresh(ledger: DataFrame) -> DataFrame:
    return ledger.where("status = 'fresh'").select("path", "hash", "record_id")


def planned(files: DataFrame, ledger: DataFrame, records: DataFrame) -> DataFrame:
    """(path, previous_path, kind): created, modified, deleted, renamed and conflict, by the file, the ledger's fresh row and the record of each path."""
    return workspace_scan(files.select("path", "hash"), _fresh(ledger), records.select("record_id", "hash"))


def record_of(path: Column) -> Column:
    return F.concat(F.lit("file-"), uuid5(URL_NAMESPACE, F.concat(F.lit("workspace-file|"), path)))


def applied(files: DataFrame, ledger: DataFrame, records: DataFrame, conflicts: DataFrame, plan: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ledger, records and conflicts after a plan.

    Created and modified files become records (a path keeps its record's id); a deleted path's record goes and its ledger row is stale. A renamed file keeps its record, and the
    row of its old path is stale and names the new one. A conflict is noted once for the same two versions, and nothing else is done about its path.
    """
    old = _fresh(ledger).select(F.col("path").alias("_p"), F.col("record_id").alias("_id"))
    taken = plan.where(F.col("kind").isin("created", "modified", "renamed")).join(files, "path").withColumn("_p", F.coalesce("previous_path", "path")).join(old, "_p", "left")
    taken = taken.select("path", "previous_path", "content", "hash", F.coalesce("_id", record_of(F.col("path"))).alias("record_id"))
    gone = plan.where("kind = 'deleted'").select("path", F.lit(None).cast("string").alias("superseded_by")).unionByName(plan.where("kind = 'renamed'").select(F.col("previous_path").alias("path"), F.col("path").alias("superseded_by")))
    stale = ledger.drop("superseded_by").join(gone, "path").withColumns({"status": F.lit("stale"), "updated_at": at})
    fresh = taken.select("path", "hash", "record_id", F.lit("fresh").alias("status"), F.lit(None).cast("string").alias("superseded_by"), at.alias("updated_at"))
    new = stale.unionByName(fresh).select(*ledger.columns)
    ledger_after = ledger.join(new.select("path"), "path", "left_anti").select(*ledger.columns).unionByName(new)
    lost = plan.where("kind = 'deleted'").join(old, F.col("path") == F.col("_p")).select(F.col("_id").alias("record_id"))
    put = taken.select("record_id", "path", "content", "hash", at.alias("updated_at"))
    records_after = records.join(lost.unionByName(put.select("record_id")), "record_id", "left_anti").select(*records.columns).unionByName(put.select(*records.columns))
    both = plan.where("kind = 'conflict'").select("path").join(files.select("path", F.col("hash").alias("file_hash")), "path", "left").join(_fresh(ledger).select("path", "record_id"), "path", "left")
    both = both.join(records.select("record_id", F.col("hash").alias("record_hash")), "record_id", "left")
    named = both.select(F.sha2(F.concat_ws("|", "path", F.coalesce("file_hash", F.lit("")), F.coalesce("record_hash", F.lit(""))).cast("binary"), 256).alias("conflict_id"), "path", "file_hash", "record_hash", F.lit("open").alias("status"), at.alias("found_at"))
    return ledger_after, records_after, conflicts.unionByName(named.join(conflicts.select("conflict_id"), "conflict_id", "left_anti").select(*conflicts.columns))


def status(ledger: DataFrame, conflicts: DataFrame, plan: DataFrame) -> DataFrame:
    """One row: tracked, fresh, stale, open_conflicts, pending (what the plan would do) and last_scan_at."""
    counts = ledger.agg(F.count("*").alias("tracked"), F.count_if(F.col("status") == "fresh").alias("fresh"), F.count_if(F.col("status") == "stale").alias("stale"), F.max("updated_at").alias("last_scan_at"))
    # One row by one row.
    return counts.join(conflicts.agg(F.count_if(F.col("status") == "open").alias("open_conflicts")), F.lit(True)).join(plan.agg(F.count("*").alias("pending")), F.lit(True)).select("tracked", "fresh", "stale", "open_conflicts", "pending", "last_scan_at")


def by_kind(plan: DataFrame) -> DataFrame:
    """(file_kind, kind, n) of a plan."""
    return plan.groupBy(file_kind(F.col("path")).alias("file_kind"), "kind").agg(F.count("*").alias("n"))


class Workspace:
    """A sync's tables in a shared folder, a folder of each poll: the last whole one counts, so a poll that is cut short is made again."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home

    def _number(self) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/done=*")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return max((int(f.getPath().getName().partition("=")[2]) for f in found), default=0)

    def tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """ledger, records and conflicts as the last poll left them."""
        n = self._number()
        return tuple(self.spark.read.schema(s).parquet(f"{self.home}/poll={n}/{name}") if n else self.spark.createDataFrame([], s) for name, s in (("ledger", LEDGER), ("records", RECORDS), ("conflicts", CONFLICTS)))

    def edit(self, records: DataFrame) -> None:
        """Puts records (of RECORDS) as the other side has changed them."""
        ledger, had, conflicts = self.tables()
        self._write(ledger, had.join(records.select("record_id"), "record_id", "left_anti").select(*had.columns).unionByName(records.select(*had.columns)), conflicts)

    def _write(self, ledger: DataFrame, records: DataFrame, conflicts: DataFrame) -> None:
        n = self._number() + 1
        for name, df in (("ledger", ledger), ("records", records), ("conflicts", conflicts)):
            df.write.mode("overwrite").parquet(f"{self.home}/poll={n}/{name}")
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.home}/done={n}")

    def poll(self, folder: str, at: Column, apply: bool = True) -> tuple[DataFrame, DataFrame]:
        """The plan of what has changed, and the status after it was applied (or before, if it isn't)."""
        files = listed(self.spark, folder)
        ledger, records, conflicts = self.tables()
        plan = planned(files, ledger, records)
        rows = [tuple(r) for r in plan.limit(1).collect()]
        if apply and rows:
            from mnemos.functions.shared import settled

            plan = settled(plan)
            self._write(*applied(files, ledger, records, conflicts, plan, at))
            ledger, records, conflicts = self.tables()
        return plan, status(ledger, conflicts, plan)
