"""Comparing two large tables by digests of ranges: rows only meet where the digests differ.

A row's place is the SHA-256 of its kind and id; a range is all places with the same first digits, and its digest is how many rows it has and a sum of hashes over
them. Ranges of the first digits are compared; where they differ, ranges of more digits within them; and only the rows of the last ranges that
differ are joined. Equal tables exchange digests alone.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.functions.shared import spilled

#: Digits (of sixteen values) of the ranges that are compared one after another; most ranges that are broadcast to filter by.
DEPTHS, BROADCAST_RANGES = (3, 6), 100_000


def _placed(inventory: DataFrame) -> DataFrame:
    """(object_kind, object_id, hash) with its place and its share of a digest."""
    place = F.sha2(F.concat_ws("\u0001", "object_kind", "object_id").cast("binary"), 256)
    rows = inventory.select("object_kind", "object_id", "hash", place.alias("_place"))
    return rows.withColumn("_h", F.xxhash64("object_kind", "object_id", "hash"))


def digests(inventory: DataFrame, digits: int) -> DataFrame:
    """(range, n, digest): a table to keep beside an inventory, so that it need not be read to be compared. The sum of hashes is a decimal, so it can't overflow."""
    return _digests(_placed(inventory), digits)


def _digests(placed: DataFrame, digits: int) -> DataFrame:
    return placed.groupBy(F.substring("_place", 1, digits).alias("range")).agg(F.count("*").alias("n"), F.sum(F.col("_h").cast("decimal(20,0)")).alias("digest"))


def _rolled(fine: DataFrame, digits: int) -> DataFrame:
    """Digests of ranges of fewer digits, from those of more."""
    return fine.groupBy(F.substring("range", 1, digits).alias("range")).agg(F.sum("n").alias("n"), F.sum("digest").cast("decimal(38,0)").alias("digest"))


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.select("range", F.col("n").alias("_n"), F.col("digest").alias("_d"))
    return a.join(b, "range", "full_outer").where(~(F.col("n").eqNullSafe(F.col("_n")) & F.col("digest").eqNullSafe(F.col("_d")))).select("range")


def _within(keyed: DataFrame, ranges: DataFrame, digits: int, by: str) -> DataFrame:
    """The rows whose place `by` lies in the ranges."""
    few = ranges.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES
    wanted = ranges.select(F.col("range").alias("_in"))
    return keyed.join(F.broadcast(wanted) if few else wanted, F.substring(by, 1, digits) == F.col("_in"), "left_semi")


def differences(a: DataFrame, b: DataFrame, depths: tuple = DEPTHS) -> tuple[DataFrame, DataFrame]:
    """The rows of two inventories (object_kind, object_id, hash) that lie in ranges that differ: every row that only one has or that has another hash, and few others.

    Each inventory is worked out once and kept as a file. Its rows are read twice: for the digests of the smallest ranges, from which those of larger ones are summed, and at the end.
    """
    x, y = spilled(_placed(a)), spilled(_placed(b))
    fine, ranges = [_digests(p, depths[-1]) for p in (x, y)], None
    if len(depths) > 1:
        fine = [spilled(f) for f in fine]
    for digits in depths:
        ranges = spilled(_differing(*(f if digits == depths[-1] else _rolled(f, digits) for f in fine)))
        if digits != depths[-1]:
            fine = [_within(f, ranges, digits, "range") for f in fine]
    return tuple(_within(p, ranges, depths[-1], "_place").select("object_kind", "object_id", "hash") for p in (x, y))


def findings(canonical: DataFrame, target: DataFrame | None, target_id: str, source_cursor: int, watermark: str | None, depths: tuple = DEPTHS) -> DataFrame:
    """(finding, object_kind, object_id, canonical_hash, target_hash): missing, orphan and stale objects of a target, and a watermark_mismatch of the target itself.

    A target that can't be listed (None) is unverifiable for each canonical object; a target's null hash is unverifiable too. One row an object in each inventory.
    """
    spark = canonical.sparkSession
    if target is None:
        out = canonical.select(F.lit("unverifiable").alias("finding"), "object_kind", "object_id", F.col("hash").alias("canonical_hash"), F.lit(None).cast("string").alias("target_hash"))
    else:
        a, b = differences(canonical, target, depths)
        a, b = a.withColumnRenamed("hash", "canonical_hash").withColumn("_a", F.lit(True)), b.withColumnRenamed("hash", "target_hash").withColumn("_b", F.lit(True))
        finding: Column = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "orphan").when(F.col("target_hash").isNull(), "unverifiable").when(~F.col("canonical_hash").eqNullSafe(F.col("target_hash")), "stale")
        out = a.join(b, ["object_kind", "object_id"], "full_outer").withColumn("finding", finding).where("finding is not null").select("finding", "object_kind", "object_id", "canonical_hash", "target_hash")
    if watermark is not None and watermark != str(source_cursor):
        out = out.unionByName(spark.range(1).select(F.lit("watermark_mismatch").alias("finding"), F.lit("target").alias("object_kind"), F.lit(target_id).alias("object_id"), F.lit(str(source_cursor)).alias("canonical_hash"), F.lit(watermark).alias("target_hash")))
    return out


def repairs(found: DataFrame) -> DataFrame:
    """(operation, object_kind, object_id, version_hash): what mends a target: missing and stale objects are put, orphans deleted."""
    return found.where(F.col("finding").isin("missing", "stale", "orphan")).select(F.when(F.col("finding") == "orphan", "delete").otherwise("upsert").alias("operation"), "object_kind", "object_id", F.col("canonical_hash").alias("version_hash"))


def repaired(target: DataFrame, plan: DataFrame, planned_at: int, source_cursor: int) -> DataFrame:
    """target after a repair plan. Raises ValueError if the source has moved on since it was planned."""
    if planned_at != source_cursor:
        raise ValueError("the plan is stale")
    key = ["object_kind", "object_id"]
    put = plan.where("operation = 'upsert'").select(*key, F.col("version_hash").alias("hash"))
    return target.join(plan.select(*key), key, "left_anti").select(*key, "hash").unionByName(put)
