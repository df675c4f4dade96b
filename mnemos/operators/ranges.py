"""Numbers within groups, without a group in one task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemos.functions.shared import settled

#: Ranges that all groups together are dealt to.
PARTS = 64


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str, parts: int = PARTS) -> DataFrame:
    """rows with their number from 1 within the rows of equal `by`, in a total order.

    Rows are dealt to ranges of group and order; each range numbers its own, after as many as the group has in the ranges before.
    """
    ranged = settled(rows.repartitionByRange(parts, *(F.col(c).asc() for c in by), *order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(*by, "_range").count().select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_range").alias("_r"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    same = F.col("_range") == F.col("_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = ranged.withColumn(name, place).join(before, same)
    return out.withColumn(name, (F.col(name) + F.col("_before")).cast("int")).select(*rows.columns, name)
