"""Structural queries as text, many at once: stored queries are rows, and so are their conditions and what they find.

A query is phrases in quotes, `[property:value]`, `#tag`, `key:value` and words. The records that meet a condition are looked up for
all queries together, texts by their rarest characters and all else by value.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.functions.shared import settled
from mnemos.operators.needles import met
from mnemos.operators.records import own_tags

#: The parts of a query, the keys it may have, and what it may sort by.
PART = r'"[^"]+"|\[[^\]]+:[^\]]+\]|\S+'
KEYS = ("path", "file", "content", "block", "section", "task", "link_to", "linked_from", "relation_type", "sort", "tag")
SORTS = ("title", "path", "created", "updated", "degree")


def _part(x: Column) -> Column:
    """struct<kind, name, value, error> of a part of a query."""
    inner = F.substring(x, F.lit(2), F.greatest(F.lit(0), F.length(x) - 2))
    before = lambda c: F.substring_index(c, ":", 1)
    after = lambda c: F.substring(c, F.length(before(c)) + 2, F.length(c))
    is_phrase, is_property = x.startswith('"') & x.endswith('"'), x.startswith("[") & x.endswith("]") & x.contains(":")
    tag = lambda c: F.lower(F.trim(F.ltrim(c, F.lit("#"))))
    of = lambda kind, name, value, error=None: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"), (F.lit(None).cast("string") if error is None else error).alias("error"))
    none = F.lit(None).cast("string")
    half = (before(inner) == "") | (after(inner) == "")
    bad = F.when(~before(x).isin(*KEYS), F.concat(F.lit("unsupported operator: "), before(x))).when(after(x) == "", F.concat(before(x), F.lit(" needs a value"))).when((before(x) == "sort") & ~after(x).isin(*SORTS), F.concat(F.lit("invalid sort: "), after(x)))
    return (
        F.when(is_phrase, of("phrase", none, F.when(F.length(x) > 1, inner).otherwise(x)))
        .when(is_property, of("property", F.trim(before(inner)), F.trim(after(inner)), F.when(half, F.concat(F.lit("invalid property: "), x))))
        .when(x.startswith("#"), of("tag", none, tag(x)))
        .when(x.contains(":") & (before(x) == "tag"), of("tag", none, tag(after(x)), bad))
        .when(x.contains(":"), of("field", before(x), after(x), bad))
        .otherwise(of("term", none, x))
    )


def parsed(queries: DataFrame) -> DataFrame:
    """(query_id, position, kind, name, value, error): a row for each condition of the queries (query_id, query).

    kind: phrase, term, tag, property (name: which) or field (name: its key). Of conditions with one property or key the last stands. A query without parts, an
    unknown key, a missing value and an unknown sort are rows with an error.
    """
    parts = F.transform(F.regexp_extract_all(F.coalesce("query", F.lit("")), F.lit(PART), F.lit(0)), lambda x, i: F.struct(i.alias("position"), _part(x).alias("c")))
    rows = queries.select("query_id", F.explode(parts).alias("_p")).select("query_id", "_p.position", "_p.c.*")
    again = F.when(F.col("kind").isin("property", "field"), F.concat_ws("\n", "kind", "name")).otherwise(F.col("position").cast("string"))
    last = rows.groupBy("query_id", again.alias("_k")).agg(F.max(F.struct("position", "kind", "name", "value", "error")).alias("_c")).select("query_id", "_c.*")
    blank = queries.where(F.trim(F.regexp_replace(F.coalesce("query", F.lit("")), r"\s+", "")) == "")
    return last.unionByName(blank.select("query_id", F.lit("query is required").alias("error")), allowMissingColumns=True)


def _texts(records: DataFrame) -> DataFrame:
    """(id, field, text): what is searched in a record, in lower case."""
    has = set(records.columns)
    values = [F.array_join(F.map_values("properties"), " ")] if "properties" in has else []
    whole = F.concat_ws(" ", *(F.col(c) for c in ("title", "key", "content", "path") if c in has), *values)
    fields = {"all": whole, "content": F.col("content"), "path": F.col("path") if "path" in has else F.lit(None).cast("string")}
    return records.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.lower(v).alias("text")) for k, v in fields.items()))).alias("_t")).select("id", "_t.*").where("text is not null")


def _hits(c: DataFrame, records: DataFrame, links: DataFrame | None, blocks: DataFrame | None) -> DataFrame:
    """(condition, id): the records that meet each condition of c (condition, kind, name, value)."""
    field = lambda *names: c.where((F.col("kind") == "field") & F.col("name").isin(*names))
    needles = c.where(F.col("kind").isin("phrase", "term")).unionByName(field("content", "path"))
    needles = needles.select(F.col("condition").alias("needle_id"), F.col("value").alias("needle"), F.when(F.col("kind") == "field", F.col("name")).otherwise("all").alias("field"))
    sets = [met(_texts(records), needles, ("field",)).withColumnRenamed("needle_id", "condition")]
    tags = records.select("id", F.explode(own_tags("properties" in records.columns)).alias("value"))
    sets.append(c.where("kind = 'tag'").select("condition", "value").join(tags, "value"))
    if "properties" in records.columns:
        sets.append(c.where("kind = 'property'").select("condition", "name", "value").join(records.select("id", F.explode("properties").alias("name", "value")), ["name", "value"]))
    if "path" in records.columns:
        sets.append(field("file").select("condition", "value").join(records.select("id", F.lower(F.substring_index("path", "/", -1)).alias("value")), "value"))
    if links is not None:
        by = {"link_to": ("source_record_id", "raw_target"), "linked_from": ("target_record_id", "source_record_id"), "relation_type": ("source_record_id", "relation_type")}
        for name, (of, what) in by.items():
            if what in links.columns:
                sets.append(field(name).select("condition", "value").join(links.select(F.col(of).alias("id"), F.col(what).alias("value")), "value"))
    if blocks is not None:
        names = F.array(F.struct(F.lit("block").alias("name"), F.col("block_id").alias("value")), F.struct(F.lit("section").alias("name"), F.col("anchor").alias("value")))
        sets.append(field("block", "section").select("condition", "name", "value").join(blocks.select(F.col("record_id").alias("id"), F.inline(names)), ["name", "value"]))
        tasks = field("task").select(F.col("condition").alias("needle_id"), F.col("value").alias("needle"))
        sets.append(met(blocks.select(F.col("record_id").alias("id"), F.lower("excerpt").alias("text")), tasks).withColumnRenamed("needle_id", "condition"))
    return reduce(DataFrame.unionByName, (s.select("condition", "id") for s in sets)).distinct().join(records.select("id"), "id", "left_semi").select("condition", "id")


def _checked(queries: DataFrame, conditions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The conditions (query_id, condition, kind, name, value) that are looked up, and (query_id, error) of the queries that aren't valid."""
    conditions = parsed(queries) if conditions is None else conditions
    without_case = F.col("kind").isin("phrase", "term") | (F.col("name").isin("content", "path", "file", "task") & (F.col("kind") == "field"))
    good = conditions.where("error is null and not (kind = 'field' and name = 'sort')").withColumn("value", F.when(without_case, F.lower("value")).otherwise(F.col("value")))
    good = good.select("query_id", F.concat_ws("\u0001", "kind", F.coalesce("name", F.lit("")), "value").alias("condition"), "kind", "name", "value").dropDuplicates(["query_id", "condition"])
    errors = conditions.where("error is not null").groupBy("query_id").agg(F.min_by("error", F.coalesce("position", F.lit(-1))).alias("error"))
    idle = queries.select("query_id").join(good, "query_id", "left_anti").join(errors, "query_id", "left_anti").select("query_id", F.lit("no condition").alias("error"))
    return good, errors.unionByName(idle)


def refused(queries: DataFrame) -> DataFrame:
    """(query_id, error) of the stored queries that aren't valid, by their text alone."""
    return _checked(queries)[1]


def found(queries: DataFrame, records: DataFrame, links: DataFrame | None = None, blocks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, id) of the records that meet all conditions of a stored query; and (query_id, error) of the queries that aren't valid, which find nothing.

    records: id, title, key, content, tags and, if wanted, path and properties (a map). links: source_record_id, raw_target, target_record_id and, for
    relation_type, relation_type. blocks: record_id, block_id, anchor, excerpt. Words and phrases are looked for in all texts of a record without
    case, content and path in those alone; file is a path's last part; a tag matches without # and case; properties, blocks, sections and links match exactly, a task is
    part of a block's excerpt without case. A condition whose table or column isn't given is met by nothing. A query that only sorts would find every record; it is
    listed with the error `no condition`. A condition that many queries have is looked up once, and a query starts from its rarest one.
    """
    good, errors = _checked(queries, settled(parsed(queries)))
    good = good.join(errors, "query_id", "left_anti")
    hits = settled(_hits(good.select("condition", "kind", "name", "value").distinct(), records, links, blocks))
    counts = hits.groupBy("condition").agg(F.count("*").alias("n"))
    rarest = good.join(counts, "condition", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "condition")).alias("_r"), F.count("*").alias("_wanted"))
    start = rarest.where("_r.n > 0").select("query_id", "_wanted", F.col("_r.condition").alias("condition"))
    near = start.join(hits, "condition").select("query_id", "id", "_wanted", F.col("condition").alias("_first"))
    rest = good.select("query_id", "condition")
    others = near.join(rest, "query_id").where("condition <> _first").join(hits, ["condition", "id"]).groupBy("query_id", "id").agg(F.count("*").alias("_have"))
    done = near.join(others, ["query_id", "id"], "left").where(F.coalesce("_have", F.lit(0)) + 1 == F.col("_wanted"))
    return done.select("query_id", "id"), errors
