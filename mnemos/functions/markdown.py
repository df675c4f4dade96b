"""Links, headings, tags and frontmatter of Markdown and HTML, as Columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemos.functions.columns import let, places, slug, squeezed

#: The forms of links, tags and headings.
WIKILINK = r"(!?)\[\[([^\]]+)\]\]"
LINK = r"(?<!!)\[([^\]]*)\]\(([^)]+)\)"
TAG = r"(?<![A-Za-z0-9_/])#([A-Za-z0-9_/-]+)"
HEADING = r"^(#{1,6})\s+(.*\S)\s*$"
HREF = 'href="([^"]*)"'
BLOCK_ID = r"\^([A-Za-z0-9_-]+)"
LIST_ITEM = r"^\s*[-*+]\s+(.*)$"
EXTERNAL = r"^[A-Za-z][A-Za-z0-9+.-]*://"
FRONTMATTER = r"(?s)\A---\n(.*?)\n---\n?"
#: Characters before and after a link that are its context.
AROUND = 80
#: Characters of the blocks from which contexts are taken, at least.
BLOCK = 256


def _linked(body: Column, pattern: str, fields, around: int) -> Column:
    """array<struct<kind, raw, display, target, heading, block, original, start, end, before, after>> of a pattern's matches, with fields made from a match."""
    return F.transform(found(body, pattern, around), lambda p: F.struct(*(v.alias(k) for k, v in (fields(p["match"]) | placed(p)).items())))


def found(body: Column, pattern: str, around: int) -> Column:
    """array<struct<start, end, match, before, after>> of a pattern's matches, with up to `around` characters on either side.

    A place in a text is found by going through all before it, so the text is first cut into blocks, and what stands around a match is taken from two of them.
    """
    size = max(around, BLOCK)

    def part(blocks: Column, first: Column, length: Column) -> Column:
        q = F.floor(first / size).cast("int")
        return F.substring(F.concat(F.get(blocks, q), F.coalesce(F.get(blocks, q + 1), F.lit(""))), (first - q * size + 1).cast("int"), length.cast("int"))

    def of(blocks: Column, p: Column) -> Column:
        first = F.greatest(F.lit(0).cast("bigint"), p["start"] - around)
        after = F.coalesce(part(blocks, p["end"], F.lit(around)), F.lit(""))
        return F.struct(p["start"].alias("start"), p["end"].alias("end"), p["match"].alias("match"), part(blocks, first, p["start"] - first).alias("before"), after.alias("after"))

    cut = lambda text: F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return let(body, lambda text: let(cut(text), lambda blocks: F.transform(places(text, pattern), lambda p: of(blocks, p))))


def placed(p: Column) -> dict[str, Column]:
    return {"original": p["match"], "start": p["start"], "end": p["end"], "before": p["before"], "after": p["after"]}


def wikilinks(body: Column, around: int = AROUND) -> Column:
    """The [[target#heading|display]] and ![[embedded]] of a text with their places, as `_linked` has them. raw: all between the brackets."""
    return _linked(body, WIKILINK, wikilink_fields, around)


def wikilink_fields(m: Column) -> dict[str, Column]:
    inner = F.trim(F.regexp_extract(m, WIKILINK, 2))
    display = F.when(inner.contains("|"), F.trim(F.regexp_extract(inner, r"\|(.*)$", 1)))
    return {"kind": F.when(m.startswith("!"), "embed").otherwise("wikilink"), "raw": inner, "display": display, **target_parts(F.substring_index(inner, "|", 1))}


def target_parts(raw: Column) -> dict[str, Column]:
    """Target, heading (its slug) and block of target#heading or target#^block."""
    anchor = F.when(raw.contains("#"), F.regexp_extract(raw, "#(.*)$", 1))
    is_block = anchor.startswith("^")
    return {"target": squeezed(F.substring_index(raw, "#", 1)), "heading": F.when(~is_block, F.nullif(slug(anchor), F.lit(""))), "block": F.when(is_block, F.trim(F.substring(anchor, 2, 1_000_000)))}


def links(body: Column, around: int = AROUND) -> Column:
    """The [text](url) of a text with their places, as `_linked` has them; kind: external with a scheme and ://, else markdown. Images are none, and urls may have spaces."""
    return _linked(body, LINK, link_fields, around)


def link_fields(m: Column) -> dict[str, Column]:
    url = F.trim(F.regexp_extract(m, r"\]\(([^)]+)\)$", 1))
    display = F.nullif(F.trim(F.regexp_extract(m, r"^\[([^\]]*)\]", 1)), F.lit(""))
    return {"kind": F.when(url.rlike(EXTERNAL), "external").otherwise("markdown"), "raw": url, "display": display, **target_parts(F.substring_index(url, "|", 1))}


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(HREF), F.lit(1))


def tags(body: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(body, F.lit(TAG), F.lit(1)))


def headings(body: Column) -> Column:
    """array<struct<line, level, title, anchor>> of headings, lines from 1."""
    lines = F.transform(F.split(body, "\n"), lambda x, i: F.struct((i + 1).alias("line"), F.length(F.regexp_extract(x, HEADING, 1)).alias("level"), F.regexp_extract(x, HEADING, 2).alias("title"), slug(F.regexp_extract(x, HEADING, 2)).alias("anchor")))
    return F.filter(lines, lambda h: h["level"] > 0)


def frontmatter(text: Column) -> Column:
    """map<string, string> of the `key: value` lines between two lines of --- at the start; null without them.

    Each line with a colon counts, but those that begin with #; spaces around keys and values go, a value may be empty, and of lines with one key the last stands.
    """
    lines = F.filter(F.transform(F.split(F.regexp_extract(text, FRONTMATTER, 1), r"\r\n|[\n\r]"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x.contains(":") & ~x.startswith("#"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    last = lambda all_: F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda y: y["key"] == x["key"]))
    return F.when(text.rlike(FRONTMATTER), F.map_from_entries(let(pairs, last)))


def without_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, FRONTMATTER, "")


def resolved(links_df, records, ids: tuple = ()):
    """links (link_id, raw_target) with target_record_id and resolution_status.

    records: id, path, title, aliases[]. What stands before # is looked up, white space squeezed and without case: a target with / or that ends
    in .md only among paths (with or without .md), others among titles and aliases. One record found: resolved; several:
    ambiguous; none: unresolved; with a scheme and :// external. Other columns stay. ids: columns of both that name a namespace; a record is only
    found by links that have its ids, where it has any.
    """
    name = lambda c: F.lower(squeezed(c))
    bare = lambda c: F.regexp_replace(name(c), r"\.md$", "")
    by_name = F.transform(F.array_compact(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))), lambda x: F.struct(F.lit("name").alias("kind"), name(x).alias("name")))
    by_path = F.transform(F.array_compact(F.array("path")), lambda x: F.struct(F.lit("path").alias("kind"), bare(x).alias("name")))
    names = records.select("id", *ids, F.inline(F.array_distinct(F.concat(by_name, by_path))).alias("_kind", "_name"))
    # A name is one row for each namespace whose records have it, with the least and the last of them; so many records and many links of one name make no pairs.
    names = names.groupBy("_kind", "_name", *ids).agg(F.min("id").alias("_id"), F.max("id").alias("_last"))
    names = names.withColumns({"_given": F.array(*(F.col(c).isNotNull() for c in ids)).cast("array<boolean>"), "_ids": F.array(*(F.col(c).cast("string") for c in ids)).cast("array<string>")}).drop(*ids)
    target = F.substring_index(F.substring_index("raw_target", "|", 1), "#", 1)
    is_path = target.contains("/") | name(target).endswith(".md")
    links = links_df.drop("target_record_id", "resolution_status").withColumns({"_kind": F.when(is_path, "path").otherwise("name"), "_name": F.when(is_path, bare(target)).otherwise(name(target))})
    asked = links.select("_kind", "_name", *ids).distinct()
    # A link looks under its ids once for each set of ids that records have: those that they don't have are null.
    tried = asked.crossJoin(F.broadcast(names.select("_given").distinct())).withColumn("_ids", F.array(*(F.when(F.col("_given")[i], F.col(c).cast("string")) for i, c in enumerate(ids))).cast("array<string>")) if ids else asked.withColumns({"_given": F.array().cast("array<boolean>"), "_ids": F.array().cast("array<string>")})
    found = tried.join(names, ["_kind", "_name", "_given", "_ids"]).groupBy("_kind", "_name", *ids).agg(F.min("_id").alias("_id"), F.max("_last").alias("_last"))
    found = found.select(F.col("_kind").alias("_f_kind"), F.col("_name").alias("_f_name"), *(F.col(c).alias(f"_f_{c}") for c in ids), "_id", "_last")
    same = (F.col("_kind") == F.col("_f_kind")) & (F.col("_name") == F.col("_f_name"))
    for c in ids:
        same = same & F.col(c).eqNullSafe(F.col(f"_f_{c}"))
    status = F.when(F.col("raw_target").rlike(EXTERNAL), "external").when(F.col("_id") == F.col("_last"), "resolved").when(F.col("_id").isNotNull(), "ambiguous").otherwise("unresolved")
    out = links.join(found, same, "left").withColumns({"resolution_status": status}).withColumn("target_record_id", F.when(F.col("resolution_status") == "resolved", F.col("_id")))
    return out.drop("_id", "_last", "_kind", "_name", *found.columns)


def block_ids(body: Column) -> Column:
    """array<struct<line, block>> of the first ^block of each line that has one, lines from 1."""
    lines = F.transform(F.split(body, "\n"), lambda x, i: F.struct((i + 1).alias("line"), F.regexp_extract(x, BLOCK_ID, 1).alias("block")))
    return F.filter(lines, lambda b: b["block"] != "")


def rendered(title: Column, body: Column, fields: dict[str, Column]) -> Column:
    """A note: frontmatter with the fields that aren't null, in the given order (lists as [a, b]), a heading and the body."""
    lines = F.array_compact(F.array(*(F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), c)) for k, c in fields.items())))
    return F.concat(F.lit("---\n"), F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), F.lit("---\n"), F.coalesce(F.concat(F.lit("# "), title, F.lit("\n\n")), F.lit("")), F.coalesce(body, F.lit("")))


def scalar(value: Column) -> Column:
    """struct<kind, text, number, flag, list> of a frontmatter value: bool, list ([a, b]), int, float or str; quotes around texts go."""
    v = F.trim(value)
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), '^"+|"+$', ""), "^'+|'+$", "")
    inner = F.trim(F.substring(v, F.lit(2), F.length(v) - 2))
    kind = (
        F.when(F.lower(v).isin("true", "false"), "bool").when(v.startswith("[") & v.endswith("]"), "list").when(v.rlike(r"^[+-]?[0-9]+$"), "int").when(v.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), "float").otherwise("str")
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "str", bare(v)).alias("text"),
        F.when(kind.isin("int", "float"), v.try_cast("double")).alias("number"),
        F.when(kind == "bool", F.lower(v) == "true").alias("flag"),
        F.when(kind == "list", F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, ","), bare))).alias("list"),
    )


def list_items(body: Column) -> Column:
    """array<struct<line, item, label, target, rest>> of list items, lines from 1; label, target and what follows of the first link in one."""

    def of(x, i):
        item = F.trim(F.regexp_extract(x, LIST_ITEM, 1))
        link = r"^(.*?)" + LINK + "(.*)$"
        return F.struct((i + 1).alias("line"), item.alias("item"), F.when(item.rlike(LINK), F.trim(F.regexp_extract(item, link, 2))).alias("label"), F.when(item.rlike(LINK), F.trim(F.regexp_extract(item, link, 3))).alias("target"), F.when(item.rlike(LINK), F.regexp_replace(F.regexp_extract(item, link, 4), "^[ :-]+", "")).alias("rest"))

    lines = F.transform(F.split(body, "\n"), lambda x, i: F.when(x.rlike(LIST_ITEM), of(x, i)))
    return F.array_compact(lines)
