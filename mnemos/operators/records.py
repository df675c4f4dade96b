"""Record listings, searches, versions and the event-sourced tables behind them."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.functions.columns import believed_at, contains_text, current_at, effective_during, haystack, in_any_namespace, valid_at


def temporal_filter(now: Column | None = None, at: Column | None = None, believed: Column | None = None, as_of: Column | None = None, during: tuple | None = None) -> Column:
    """Bitemporal conditions, all of which must hold; with none of them, rows that are current at `now`."""
    tests = [valid_at(at)] * (at is not None) + [believed_at(t) for t in (as_of, believed) if t is not None] + ([effective_during(*during)] if during else [])
    if not tests:
        return current_at(now) if now is not None else F.lit(True)
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def listed(df: DataFrame, order: list, equal: dict | None = None, among: dict | None = None, namespaces: list | None = None, where: Column | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A table's rows with filters, a total order and a page of it: what every list operator is.

    equal: column -> value (None: no filter); among: column -> values (none: no filter).
    """
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == v) if v is not None else df
    for c, v in (among or {}).items():
        df = df.where(F.col(c).isin(list(v))) if v else df
    if namespaces:
        df = df.where(in_any_namespace(namespaces))
    if where is not None:
        df = df.where(where)
    df = df.orderBy(*order)
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit is not None else df


def list_records(df: DataFrame, scopes=None, namespaces=None, types=None, tiers=None, ascending: bool = False, limit: int | None = None, offset: int = 0, **times) -> DataFrame:
    """Records by updated_at, latest first unless ascending, then id."""
    order = [F.col("updated_at").asc() if ascending else F.col("updated_at").desc(), F.col("id").asc()]
    return listed(df, order, among={"scope": scopes, "type": types, "tier": tiers}, namespaces=namespaces, where=temporal_filter(**times), limit=limit, offset=offset)


def search_text() -> Column:
    return haystack(F.col("title"), F.col("key"), F.col("content"), F.array_join("tags", " "), F.array_join("entities", " "))


def search_records(df: DataFrame, query: str, limit: int | None = None, offset: int = 0, **options) -> DataFrame:
    """Listed records with the query as a substring, without case, of title, key, content, tags or entities; blank finds all."""
    return list_records(df.where(contains_text(search_text(), query)), limit=limit, offset=offset, **options)


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that is first in ascending order of the given columns (negate numbers and times to have the greatest first).

    An aggregate with partial sums: the versions of a key never come together in one task.
    """
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*(c if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns))


def live(changes: DataFrame) -> DataFrame:
    """The last event of each object, deleted objects left out: the table that a change log stands for."""
    fields = [c for c in changes.columns if c not in ("object_type", "object_id")]
    last = changes.groupBy("object_type", "object_id").agg(F.max_by(F.struct(*fields), "cursor").alias("_e"))
    return last.where("_e.operation <> 'delete'").select("object_type", "object_id", *(F.col(f"_e.{c}").alias(c) for c in fields))


def superseded(records: DataFrame, replacements: DataFrame) -> DataFrame:
    """records with those that have a row in replacements (old_id, new_id, created_at) closed at its created_at and pointing to it.

    Of several replacements of one record the latest counts, and of equals that with the greatest new_id.
    """
    last = replacements.groupBy(F.col("old_id").alias("_old")).agg(F.max(F.struct("created_at", "new_id")).alias("_r"))
    r = last.select("_old", F.col("_r.new_id").alias("superseded_by_id"), F.col("_r.created_at").alias("_end"))
    base = records.drop("superseded_by_id")
    return base.join(r, base["id"] == r["_old"], "left").withColumn("valid_to", F.coalesce("_end", "valid_to")).drop("_old", "_end")


def erased(records: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]], ids: DataFrame, at: Column) -> tuple[DataFrame, dict[str, DataFrame]]:
    """records with those in ids closed at `at`; and each table (with the columns that name records) without rows about them."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    closed = records.join(gone.withColumn("_hit", F.lit(True)), records["id"] == F.col("_gone"), "left").withColumn("valid_to", F.when(F.col("_hit"), at).otherwise(F.col("valid_to"))).drop("_gone", "_hit")
    kept = {}
    for name, (df, columns) in tables.items():
        for c in columns:
            df = df.join(gone, df[c] == F.col("_gone"), "left_anti")
        kept[name] = df
    return closed, kept


def candidate_queue(df: DataFrame, statuses=None, least_confidence: float | None = None, sources=None, with_evidence: bool = False, limit: int | None = None) -> DataFrame:
    """Candidates to review, by last change and id, both descending."""
    order = [F.coalesce("updated_at", "created_at").desc(), F.col("candidate_id").desc()]
    where = F.lit(True) if least_confidence is None else F.col("confidence") >= least_confidence
    if with_evidence:
        where = where & (F.size("evidence") > 0)
    return listed(df, order, among={"status": statuses, "source": sources}, where=where, limit=limit)


def own_tags(with_properties: bool) -> Column:
    """A record's tags without # and case, and with properties those in a list (JSON) under their key `tags`."""
    more = F.from_json(F.col("properties")["tags"], "array<string>") if with_properties else None
    all_ = F.coalesce("tags", F.array().cast("array<string>"))
    all_ = F.concat(all_, F.coalesce(more, F.array().cast("array<string>"))) if more is not None else all_
    return F.transform(all_, lambda t: F.lower(F.ltrim(t, F.lit("#"))))


def structural_search(
    records: DataFrame,
    links: DataFrame | None = None,
    blocks: DataFrame | None = None,
    *,
    phrases=(),
    terms=(),
    tags=(),
    properties: dict | None = None,
    path: str | None = None,
    file: str | None = None,
    content: str | None = None,
    link_to: str | None = None,
    linked_from: str | None = None,
    block: str | None = None,
    section: str | None = None,
    task: str | None = None,
    sort: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Records that meet all conditions: text in any field, tags, properties, place, links and blocks.

    records may have path and properties (a map). Links and blocks are met by semi joins. Only sort='title' sorts.
    """
    has = set(records.columns)
    fields = [c for c in ("title", "key", "content", "path") if c in has]
    values = [F.array_join(F.map_values("properties"), " ")] if "properties" in has else []
    hay = F.lower(F.concat_ws(" ", *(F.col(c) for c in fields), *values))
    out = records
    for t in (*phrases, *terms):
        out = out.where(hay.contains(t.lower()))
    own = own_tags("properties" in has)
    for t in tags:
        out = out.where(F.array_contains(own, t.lstrip("#").lower()))
    for k, v in (properties or {}).items():
        out = out.where(F.col("properties")[k] == v)
    if path:
        out = out.where(F.lower("path").contains(path.lower()))
    if file:
        out = out.where(F.lower(F.substring_index("path", "/", -1)) == file.lower())
    if content:
        out = out.where(F.lower("content").contains(content.lower()))
    if link_to:
        out = out.join(links.where(F.col("raw_target") == link_to).select(F.col("source_record_id").alias("id")), "id", "left_semi")
    if linked_from:
        out = out.join(links.where(F.col("source_record_id") == linked_from).select(F.col("target_record_id").alias("id")), "id", "left_semi")
    for wanted, test in ((block, F.col("block_id") == block), (section, F.col("anchor") == section), (task, F.lower("excerpt").contains((task or "").lower()))):
        if wanted:
            out = out.join(blocks.where(test).select(F.col("record_id").alias("id")), "id", "left_semi")
    if sort == "title":
        out = out.orderBy("title", "id")
    return out.limit(limit) if limit is not None else out


def word_index(records: DataFrame) -> DataFrame:
    """(word, id): the words of each record's title, key, scope, type, tags and content, each once; a table to write and to search by key."""
    text = F.lower(F.concat_ws(" ", "title", "key", "scope", "type", F.array_join("tags", " "), "content"))
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return records.select(F.explode(words).alias("word"), "id")


def with_words(index: DataFrame, query: str) -> DataFrame:
    """ids of the records that have all words of a query; a query without words finds none."""
    wanted = sorted({w for w in re.findall(r"\w+", query.lower())})
    hit = index.where(F.col("word").isin(wanted)) if wanted else index.limit(0)
    return hit.groupBy("id").agg(F.count_distinct("word").alias("_n")).where(F.col("_n") == len(wanted)).select("id")


def got(df: DataFrame, key: str, value: str) -> DataFrame:
    """The row of a key, or none."""
    return df.where(F.col(key) == value).limit(1)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of tables."""
    out = None
    for name, df in tables.items():
        line = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = line if out is None else out.unionByName(line)
    return out


def notes_after(notes: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """Notes (id, title, content, updated_at, archived) after edits (id, action create, update or archive, title, content): one for each note."""
    e = edits.select("id", F.struct("action", "title", "content").alias("_e"))
    met = notes.join(e, "id", "full")
    action = F.col("_e.action")
    new = {
        "title": F.when(action.isin("create", "update"), F.coalesce("_e.title", "title")).otherwise(F.col("title")),
        "content": F.when(action.isin("create", "update"), F.coalesce("_e.content", "content")).otherwise(F.col("content")),
        "updated_at": F.when(action.isNotNull(), now).otherwise(F.col("updated_at")),
        "archived": F.when(action == "archive", True).otherwise(F.coalesce("archived", F.lit(False))),
    }
    there = F.col("updated_at").isNotNull() | (action == "create")
    return met.where(there).select(*(new.get(c, F.col(c)).alias(c) for c in notes.columns))
