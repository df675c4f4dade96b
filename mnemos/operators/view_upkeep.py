"""Materialised views that follow the change log: what events do to rows, groups and summaries, without reading the base table.

A view keeps two tables: its rows (the filtered, projected records) and its groups (counts and sums, least and greatest of each measure). Events take
the old rows of their objects out and put the new ones in. Counts and sums change by signed rows; a least or greatest value is looked for again only in
groups that lost it, and only among the view's rows.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds of objects whose events can change a view.
RELEVANT = ("record", "relation", "link", "view", "schema", "ontology")
#: Sums are of numbers with so many digits after the point, so that they come out the same in any order.
SUMS = "decimal(38,6)"


def requires_refresh(events: DataFrame, source_cursor: int | None) -> DataFrame:
    """One row: whether a view as of a cursor (None: not made yet) has missed an event that can change it."""
    if source_cursor is None:
        return events.sparkSession.range(1).select(F.lit(True).alias("stale"))
    return events.agg((F.count_if(F.col("object_type").isin(*RELEVANT) & (F.col("cursor") > source_cursor)) > 0).alias("stale"))


def _summed(rows: DataFrame, group: str, measures: list[str], sign: str = "1") -> DataFrame:
    of = lambda m: [F.sum(F.when(F.col(m).isNotNull(), F.expr(sign)).otherwise(0)).alias(f"n_{m}"), F.sum((F.col(m).cast("decimal(32,6)") * F.expr(sign)).cast(SUMS)).alias(f"sum_{m}")]
    return rows.groupBy(group).agg(F.sum(F.expr(sign).cast("bigint")).alias("n"), *(c for m in measures for c in of(m)))


def _extremes(rows: DataFrame, group: str, measures: list[str]) -> DataFrame:
    return rows.groupBy(group).agg(*(c for m in measures for c in (F.min(m).alias(f"min_{m}"), F.max(m).alias(f"max_{m}"))))


def summarised(rows: DataFrame, group: str, measures: list[str]) -> DataFrame:
    """(group, n, and of each measure n_, sum_, min_ and max_) from the rows alone: what maintained groups must be."""
    sums, ends = _summed(rows, group, measures), _extremes(rows, group, measures)
    return sums.join(ends.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def maintained(rows: DataFrame, groups: DataFrame, events: DataFrame, new_rows, group: str, measures: list[str], after: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The view's rows and groups after the events with a cursor past `after`, and one row with the cursor that they are then as of.

    rows: object_id, the group's and the measures' columns, and any others; one row an object. events: cursor, object_id, operation, payload. new_rows: from the last
    events of objects that aren't deleted to the view's rows; it filters and projects. An event that changes nothing leaves all as it is; a group without rows goes; a null group is one.
    """
    past = events.where(F.col("cursor") > after)
    last = past.groupBy("object_id").agg(F.max_by(F.struct("cursor", "operation", "payload"), "cursor").alias("_e")).select("object_id", "_e.*")
    new = new_rows(last.where("operation <> 'delete'")).select(*rows.columns)
    old = rows.join(last.select("object_id"), "object_id", "left_semi").select(*rows.columns)
    rows_after = rows.join(last.select("object_id"), "object_id", "left_anti").select(*rows.columns).unionByName(new)
    signed = old.select(group, *measures, F.lit(-1).alias("_sign")).unionByName(new.select(group, *measures, F.lit(1).alias("_sign")))
    change = _summed(signed, group, measures, "_sign").withColumnsRenamed({"n": "_dn", **{f"{k}_{m}": f"_d{k}_{m}" for m in measures for k in ("n", "sum")}})
    lost = _extremes(old, group, measures).withColumnsRenamed({f"{k}_{m}": f"_l{k}_{m}" for m in measures for k in ("min", "max")})
    came = _extremes(new, group, measures).withColumnsRenamed({f"{k}_{m}": f"_c{k}_{m}" for m in measures for k in ("min", "max")})
    by = lambda a, b, how: a.join(b.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")), how)
    touched = by(by(change, lost, "left").drop("_g"), came, "left").drop("_g")
    own = groups.withColumn("_had", F.lit(True))
    met = by(touched, own, "left").drop("_g")
    n = F.coalesce("n", F.lit(0)) + F.col("_dn")
    # A group lost its least or greatest value if one that went was as far out as it.
    open_ = [F.coalesce(F.col(f"_lmin_{m}") <= F.col(f"min_{m}"), F.lit(False)) | F.coalesce(F.col(f"_lmax_{m}") >= F.col(f"max_{m}"), F.lit(False)) for m in measures]
    again = open_[0] if open_ else F.lit(False)
    for o in open_[1:]:
        again = again | o
    kept = {f"n_{m}": F.coalesce(F.col(f"n_{m}"), F.lit(0)) + F.col(f"_dn_{m}") for m in measures}
    kept |= {f"sum_{m}": F.when(kept[f"n_{m}"] > 0, (F.coalesce(F.col(f"sum_{m}"), F.lit(0)) + F.coalesce(F.col(f"_dsum_{m}"), F.lit(0))).cast(SUMS)) for m in measures}
    kept |= {f"min_{m}": F.least(f"min_{m}", f"_cmin_{m}") for m in measures} | {f"max_{m}": F.greatest(f"max_{m}", f"_cmax_{m}") for m in measures}
    stepped = met.select(group, n.alias("n"), again.alias("_again"), *(v.alias(k) for k, v in kept.items())).where("n > 0")
    asked = stepped.where("_again").select(F.col(group).alias("_g"))
    looked = _extremes(rows_after.join(asked, F.col(group).eqNullSafe(F.col("_g")), "left_semi"), group, measures).withColumnsRenamed({f"{k}_{m}": f"_l{k}_{m}" for m in measures for k in ("min", "max")})
    found = by(stepped, looked, "left").drop("_g")
    ends = {f"{k}_{m}": F.when(F.col("_again"), F.col(f"_l{k}_{m}")).otherwise(F.col(f"{k}_{m}")) for m in measures for k in ("min", "max")}
    updated = found.withColumns(ends).select(*groups.columns) if measures else found.select(*groups.columns)
    untouched = groups.join(change.select(F.col(group).alias("_g")), F.col(group).eqNullSafe(F.col("_g")), "left_anti").select(*groups.columns)
    cursor = past.agg(F.greatest(F.coalesce(F.max("cursor"), F.lit(after)), F.lit(after)).cast("bigint").alias("source_cursor"))
    return rows_after, untouched.unionByName(updated), cursor
