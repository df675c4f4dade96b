"""Saved views: filters, formulas, groups, sorts and summaries, and what is computed from them.

A formula is a Column (or SQL text, by F.expr) over a view's properties.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    return c.try_cast("double")


def compared(column: Column, op: str, value) -> Column:
    """One filter. Order comparisons are numeric if both sides are numbers, else textual; in and contains compare texts."""
    text = column.cast("string")
    if op == "exists":
        return column.isNotNull() if value in (None, True) else column.isNull()
    if op == "eq":
        return F.coalesce(text == str(value), F.lit(False))
    if op == "ne":
        return ~F.coalesce(text == str(value), F.lit(False))
    if op == "in":
        return F.coalesce(text.isin([str(v) for v in value]), F.lit(False))
    if op == "contains":
        return F.coalesce(text.contains(str(value)), F.lit(False))
    if op not in ("lt", "lte", "gt", "gte"):
        raise ValueError(f"unknown operator {op!r}")
    test = {"lt": Column.__lt__, "lte": Column.__le__, "gt": Column.__gt__, "gte": Column.__ge__}[op]
    try:
        wanted = None if isinstance(value, bool) else float(value)
    except (TypeError, ValueError):
        wanted = None
    textual = test(text, F.lit(str(value)))
    return F.coalesce(textual if wanted is None else F.when(number(text).isNotNull(), test(number(text), F.lit(wanted))).otherwise(textual), F.lit(False))


def condition(spec) -> Column:
    """A Column of nested filters: (column, op, value), ("and", ...), ("or", ...) or ("not", one)."""
    head, *rest = spec
    if head == "and":
        return reduce(lambda a, b: a & b, map(condition, rest), F.lit(True))
    if head == "or":
        return reduce(lambda a, b: a | b, map(condition, rest), F.lit(False))
    if head == "not":
        return ~condition(rest[0])
    return compared(F.col(head), *rest)


def viewed(df: DataFrame, where=None, formulas: dict | None = None, columns: list[str] | None = None, sort: str | None = None) -> DataFrame:
    """A view's rows: filtered, with formulas, projected, and sorted by the text of a column, else title (a leading - turns it round), ties by id."""
    out = df.where(condition(where)) if where else df
    out = out.withColumns({k: F.expr(f) if isinstance(f, str) else f for k, f in (formulas or {}).items()}) if formulas else out
    if sort:
        key = F.coalesce(F.nullif(F.col(sort.lstrip("-")).cast("string"), F.lit("")), F.col("title") if "title" in df.columns else F.lit(""), F.lit(""))
        out = out.orderBy(key.desc() if sort[0] == "-" else key, "id")
    else:
        out = out.orderBy("id")
    return out.select("id", *(columns or [])) if columns else out


def groups(df: DataFrame, by: str) -> DataFrame:
    """(value, id): a row for each member of the group of a value's text; null has no group. A group of any size is rows, never one list."""
    return df.where(F.col(by).isNotNull()).select(F.col(by).cast("string").alias("value"), "id")


def group_sizes(members: DataFrame) -> DataFrame:
    """(value, n, first_id) of the rows of groups."""
    return members.groupBy("value").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def summaries(df: DataFrame, wanted: list[tuple[str, str]], by: list[str] | None = None) -> DataFrame:
    """Metrics (metric, column) of a view: count, count_distinct (of texts), sum, avg, min, max; nulls don't count, a sum of nothing is 0."""
    made = {
        "count": lambda c: F.count(c),
        "count_distinct": lambda c: F.count_distinct(c.cast("string")),
        "sum": lambda c: F.coalesce(F.sum(c.cast("double")), F.lit(0.0)),
        "avg": lambda c: F.avg(c.cast("double")),
        "min": F.min,
        "max": F.max,
    }
    return (df.groupBy(*by) if by else df).agg(*(made[m](F.col(c)).alias(f"{m}_{c}") for m, c in wanted))


def facets(df: DataFrame, columns: list[str], arrays: list[str] = ()) -> DataFrame:
    """(field, value, count) over several columns in one pass."""
    one = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))

    def exploded(name):
        return F.transform(name, lambda x: F.struct(F.lit(name).alias("field"), x.cast("string").alias("value")))

    many = [exploded(a) for a in arrays]
    return df.select(F.explode(F.concat(one, *many)).alias("_f")).select("_f.*").where("value is not null").groupBy("field", "value").agg(F.count("*").alias("count"))


def relation_rollup(records: DataFrame, edges: DataFrame, value: Column | None = None) -> DataFrame:
    """(id, n, n_distinct, total): edges of each record, their distinct targets, and the sum of a value of the edge."""
    e = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.count_distinct("dst").alias("n_distinct"), F.sum(value if value is not None else F.lit(0)).cast("double").alias("total"))
    return records.select("id").join(e, "id", "left").select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_distinct")), F.coalesce("total", F.lit(0.0)).alias("total"))


def stale_view(view_cursor: int, changes: DataFrame, kinds: tuple = ("record", "relation", "link", "view", "schema", "ontology")) -> DataFrame:
    """(cursor, stale): the last event that a view depends on, and whether it came after the view was computed."""
    return changes.where(F.col("object_type").isin(list(kinds))).agg(F.max("cursor").alias("cursor")).withColumn("stale", F.coalesce(F.col("cursor") > view_cursor, F.lit(False)))


def percentile(df: DataFrame, column: str, share: float, by: list[str]) -> DataFrame:
    """The nearest-rank percentile of each group: the value at round((n - 1) * share), halves to even."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by)
    ranked = df.withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy(column)) - 1})
    return ranked.where(F.col("_i") == F.bround((F.col("_n") - 1) * share, 0).cast("int")).select(*by, F.col(column).alias("value"))


def panel(view: DataFrame, order: list, rows: int) -> DataFrame:
    """What a live panel shows of a view: the first rows in a total order."""
    return view.orderBy(*order).limit(rows)
