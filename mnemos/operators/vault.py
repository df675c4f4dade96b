"""Folders of notes: files to records, links and blocks; plans to import, export, rename and check them.

Files are rows (path, content, content_hash, modified_at, deleted) and plans are DataFrames, so a vault of any size is planned by joins on the path.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.functions import markdown
from mnemos.functions.columns import uuid5
from mnemos.operators.graph import URL_NAMESPACE
from mnemos.operators.writes import replaced


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """`prefix-` and the UUID of the parts joined by |."""
    return F.concat(F.lit(f"{prefix}-"), uuid5(URL_NAMESPACE, F.concat_ws("|", F.lit(prefix), *parts)))


# Paths


def normal_path(path: Column) -> Column:
    """Slashes forward, and no empty or `.` parts."""
    slashes = F.translate(path, "\\", "/")
    parts = F.filter(F.split(slashes, "/"), lambda x: ~x.isin("", "."))
    return F.concat(F.when(slashes.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))


def path_refusal(path: Column) -> Column:
    """Why a path isn't usable, or null: required, or it must be relative and not go up."""
    p = normal_path(F.coalesce(path, F.lit("")))
    return F.when(p == "", "path_required").when(p.startswith("/") | F.array_contains(F.split(p, "/"), ".."), "path_outside")


def file_kind(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.endswith(".md"), "markdown").when(low.endswith(".canvas"), "canvas").otherwise("asset")


def folded(path: Column) -> Column:
    """A path with `..` taken back; null if it goes above its root. Slashes forward, and no empty or `.` parts."""

    def step(acc: Column, x: Column) -> Column:
        up, stays = x == "..", x.isin("", ".")
        parts = F.when(up, F.slice(acc["parts"], 1, F.greatest(F.lit(0), F.size(acc["parts"]) - 1))).when(stays, acc["parts"]).otherwise(F.concat(acc["parts"], F.array(x)))
        return F.struct(parts.alias("parts"), (acc["above"] | (up & (F.size(acc["parts"]) == 0))).alias("above"))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("above"))
    return F.aggregate(F.split(F.translate(path, "\\", "/"), "/"), start, step, lambda acc: F.when(~acc["above"], F.array_join(acc["parts"], "/")))


# Import and export


def first_of_path(files: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """The first file of each path, in the order of a column, and the paths that stood more than once."""
    rest = [c for c in files.columns if c != "path"]
    best = files.groupBy("path").agg(F.min_by(F.struct(*rest), F.col(order)).alias("_f"), F.count("*").alias("_n"))
    return best.select("path", *(F.col(f"_f.{c}").alias(c) for c in rest)), best.where("_n > 1").select("path", F.lit("duplicate_path").alias("code"), (F.col("_n") - 1).alias("skipped"))


def import_plan(files: DataFrame, records: DataFrame, tombstone_missing: bool = False) -> DataFrame:
    """(path, record_id, action): create, update, delete, stale or unchanged, for files and records (path, record_id, content_hash, is_deleted).

    A deleted file deletes an active record. With tombstone_missing active paths that have no file are deleted as stale ones.
    """
    active = records.where(~F.coalesce("is_deleted", F.lit(False))).select(F.col("path"), F.col("record_id").alias("_id"), F.col("content_hash").alias("_had"))
    f = files.select("path", "content_hash", F.coalesce("deleted", F.lit(False)).alias("_deleted"), F.lit(True).alias("_file"))
    j = f.join(active, "path", "full")
    action = (
        F.when(F.col("_file").isNull(), "stale" if tombstone_missing else "unseen")
        .when(F.col("_deleted"), F.when(F.col("_id").isNotNull(), "delete").otherwise("unchanged"))
        .when(F.col("_id").isNull(), "create")
        .when(~F.col("_had").eqNullSafe(F.col("content_hash")), "update")
        .otherwise("unchanged")
    )
    return j.select("path", F.coalesce("_id", stable_id("vault-rec", "path")).alias("record_id"), action.alias("action")).where("action <> 'unseen'")


def imported(files: DataFrame, plan: DataFrame, records: DataFrame, links: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """records, links and blocks after an import plan over files.

    records: record_id, path, title, aliases, tags, body, properties, content_hash, is_deleted. Created and updated files become records under the plan's id, with their links and
    blocks in place of the earlier ones; deleted and stale records stay as deleted, without links and blocks of their own. Assets and canvases have no text and become records with their name.
    """
    taken = plan.where(F.col("action").isin("create", "update")).select("path", F.col("record_id").alias("_id"))
    texts = notes(files).drop("record_id")
    other = files.where(file_kind(F.col("path")) != "markdown").select("path", F.substring_index("path", "/", -1).alias("title"), F.array().cast("array<string>").alias("aliases"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("body"), F.lit(None).cast("map<string,string>").alias("properties"))
    made = texts.unionByName(other).join(taken, "path").join(files.select("path", "content_hash"), "path").withColumnRenamed("_id", "record_id").withColumn("is_deleted", F.lit(False))
    lost = plan.where(F.col("action").isin("delete", "stale")).select("record_id")
    owners = taken.select(F.col("_id").alias("record_id")).unionByName(lost).distinct()
    gone = records.join(lost.distinct(), "record_id", "left_semi").withColumn("is_deleted", F.lit(True)).select(*records.columns)
    records_after = records.join(owners, "record_id", "left_anti").select(*records.columns).unionByName(gone).unionByName(made.select(*records.columns))
    links_after = replaced(links, note_links(made).select(*links.columns), "source_record_id", owners.withColumnRenamed("record_id", "source_record_id"))
    return records_after, links_after, replaced(blocks, note_blocks(made).select(*blocks.columns), "record_id", owners)


def renamed(records: DataFrame, links: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """records (record_id, path ..) and links (link_id, raw_target, target_path ..) after renames (old_path, new_path), and the renames that were refused as their new path exists."""
    touched, conflicts = rename_plan(links, renames, records.select("path"))
    free = renames.join(conflicts.select(F.col("path").alias("new_path")), "new_path", "left_anti").select("old_path", "new_path")
    moved = records.join(free, records["path"] == free["old_path"], "left").select(*(F.coalesce("new_path", "path").alias(c) if c == "path" else records[c] for c in records.columns))
    done = touched.join(free, ["old_path", "new_path"], "left_semi").select("link_id", F.col("raw_target").alias("_raw"), F.col("target_path").alias("_path"))
    out = links.join(done, "link_id", "left").withColumns({"raw_target": F.coalesce("_raw", "raw_target"), "target_path": F.coalesce("_path", "target_path")}).select(*links.columns)
    return moved, out, conflicts


def plan_counts(plan: DataFrame) -> DataFrame:
    """One row: created, updated, deleted (stale ones too), stale and unchanged."""
    n = lambda *a: F.count(F.when(F.col("action").isin(*a), 1))
    return plan.agg(n("create").alias("created"), n("update").alias("updated"), n("delete", "stale").alias("deleted"), n("stale").alias("stale"), n("unchanged").alias("unchanged"))


def manifest(files: DataFrame, records: DataFrame) -> DataFrame:
    """(path, file_kind, record_id, content_hash, is_deleted), by path."""
    ids = records.select("path", "record_id")
    return files.join(ids, "path", "left").select("path", file_kind(F.col("path")).alias("file_kind"), "record_id", "content_hash", F.coalesce("deleted", F.lit(False)).alias("is_deleted")).orderBy("path")


def notes(files: DataFrame) -> DataFrame:
    """A record for each Markdown file that isn't deleted: path, title (frontmatter, first heading or file name), aliases, tags, body and properties."""
    text = F.coalesce("content", F.lit(""))
    front, body = markdown.frontmatter(text), markdown.without_frontmatter(text)
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
    lists = lambda k: F.coalesce(markdown.scalar(front[k])["list"], F.when(front[k].isNotNull(), F.array(markdown.scalar(front[k])["text"])), F.array().cast("array<string>"))
    titles = F.transform(F.filter(markdown.headings(body), lambda h: h["level"] == 1), lambda h: h["title"])
    return files.where((file_kind(F.col("path")) == "markdown") & ~F.coalesce("deleted", F.lit(False))).select(
        stable_id("vault-rec", "path").alias("record_id"),
        "path",
        F.coalesce(front["title"], F.get(titles, F.lit(0)), name).alias("title"),
        lists("aliases").alias("aliases"),
        F.array_distinct(F.concat(lists("tags"), markdown.tags(body))).alias("tags"),
        body.alias("body"),
        front.alias("properties"),
    )


def note_links(notes: DataFrame, around: int = markdown.AROUND) -> DataFrame:
    """(link_id, source_record_id, start, end, raw_target, link_kind, display, heading, block, context_before, context_after) of the notes' wiki links, embeds and Markdown links.

    start and end count the body's characters from 0, the end is exclusive; a link's id is that of its note and start; up to `around` characters on either side are its context.
    """
    forms = F.array(*(markdown.found(F.col("body"), p, around) for p in (markdown.WIKILINK, markdown.LINK)))
    out = notes.select(F.col("record_id").alias("source_record_id"), F.posexplode(forms).alias("_form", "_found")).select("source_record_id", "_form", F.explode("_found").alias("_l"))
    # What is known of a match is worked out in rows, where columns that aren't asked for cost nothing.
    wiki, link = markdown.wikilink_fields(F.col("_l.match")), markdown.link_fields(F.col("_l.match"))
    columns = {k: F.when(F.col("_form") == 0, wiki[k]).otherwise(link[k]) for k in wiki} | markdown.placed(F.col("_l"))
    out = out.select("source_record_id", *(v.alias(k) for k, v in columns.items()))
    fields = ("source_record_id", "start", "end", F.col("raw").alias("raw_target"), F.col("kind").alias("link_kind"), "display", "heading", "block", F.col("before").alias("context_before"), F.col("after").alias("context_after"))
    return out.select(stable_id("link", "source_record_id", F.col("start").cast("string")).alias("link_id"), *fields)


def note_blocks(notes: DataFrame) -> DataFrame:
    """(record_id, block_type, line_start, anchor, excerpt) of headings and of lines with a ^block."""
    heads = notes.select("record_id", F.lit("heading").alias("block_type"), F.inline(F.transform(markdown.headings(F.col("body")), lambda h: F.struct(h["line"].alias("line_start"), h["anchor"].alias("anchor"), h["title"].alias("excerpt")))))
    lines = F.split("body", "\n")
    ids = notes.select("record_id", F.lit("block").alias("block_type"), F.inline(F.transform(markdown.block_ids(F.col("body")), lambda b: F.struct(b["line"].alias("line_start"), b["block"].alias("anchor"), F.trim(F.get(lines, b["line"] - 1)).alias("excerpt")))))
    return heads.unionByName(ids)


def exported(records: DataFrame) -> DataFrame:
    """(path, content, content_hash) of records (path, title, body, properties) as notes."""
    front = F.transform(F.array_sort(F.map_entries(F.coalesce("properties", F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\n")))
    head = F.when(F.size(front) > 0, F.concat(F.lit("---\n"), F.array_join(front, ""), F.lit("---\n"))).otherwise("")
    out = records.select("path", F.concat(head, F.coalesce("body", F.lit(""))).alias("content"))
    return out.withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))


# Renames


def rename_plan(links: DataFrame, renames: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links that renames (old_path, new_path) touch, with their new raw_target and target_path; and the new paths that exist already.

    A link is touched if its target_path is the old one, or what stands before # and | in its raw_target is the old path, with or without .md,
    without case; heading and block go along.
    """
    raw = F.col("raw_target")
    target, alias = F.substring_index(raw, "|", 1), F.when(raw.contains("|"), F.regexp_extract(raw, r"(\|.*)$", 1)).otherwise("")
    part = markdown.target_parts(target)
    bare = lambda c: F.regexp_replace(F.lower(c), r"\.md$", "")
    r = renames.select("old_path", "new_path", bare(F.col("old_path")).alias("_bare"))
    asked = links.withColumn("_bare", bare(part["target"]))
    by_raw = asked.join(r, "_bare").select("link_id", "old_path", "new_path", F.lit(True).alias("_raw"))
    by_path = asked.drop("_bare").join(r.drop("_bare"), F.col("target_path") == F.col("old_path")).select("link_id", "old_path", "new_path", F.lit(False).alias("_raw"))
    one = by_raw.unionByName(by_path).groupBy("link_id").agg(F.max(F.struct("_raw", "new_path", "old_path")).alias("_r"))
    suffix = F.coalesce(F.concat(F.lit("#^"), part["block"]), F.concat(F.lit("#"), part["heading"]), F.lit(""))
    new_raw = F.when(F.col("_r._raw"), F.concat(F.col("_r.new_path"), suffix, alias)).otherwise(raw)
    new_path = F.when(F.col("target_path") == F.col("_r.old_path"), F.col("_r.new_path")).otherwise(F.col("target_path"))
    touched = links.join(one, "link_id").select("link_id", new_raw.alias("raw_target"), new_path.alias("target_path"), F.col("_r.old_path").alias("old_path"), F.col("_r.new_path").alias("new_path"))
    conflicts = renames.join(paths.select(F.col("path").alias("new_path")).distinct(), "new_path", "left_semi").select(F.col("new_path").alias("path"), F.lit("repair_target_conflict").alias("code"))
    return touched, conflicts


# Bundles of documents


def document_kind(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(name == "index.md", "index").when(name == "log.md", "log").when(path.startswith("references/"), "reference").otherwise("concept")


def bundle_target(path: Column, raw: Column) -> Column:
    """The bundle path that a target in a document means; null for external and empty ones and for those above the bundle's root. Alias and anchor are cut."""
    t = F.trim(F.substring_index(F.substring_index(raw, "|", 1), "#", 1))
    folder = F.regexp_replace(path, "[^/]*$", "")
    return F.when((t == "") | t.rlike(markdown.EXTERNAL), None).when(t.startswith("/"), folded(t)).otherwise(folded(F.concat(folder, t)))


def findings(documents: DataFrame, links: DataFrame) -> DataFrame:
    """(path, code, severity) of documents (path, type, body) and links (path, raw_target, link_kind, resolution_status): what breaks the profile."""
    kind = document_kind(F.col("path"))
    has = F.coalesce(F.col("type") != "", F.lit(False))
    rules = F.array_compact(
        F.array(
            F.when(kind.isin("concept", "reference") & ~has, F.struct(F.lit("missing_type").alias("code"), F.lit("error").alias("severity"))),
            F.when(kind.isin("index", "log") & has, F.struct(F.lit("reserved_frontmatter_type").alias("code"), F.lit("warning").alias("severity"))),
            F.when(F.trim(F.coalesce("body", F.lit(""))) == "", F.struct(F.lit("empty_body").alias("code"), F.lit("warning").alias("severity"))),
        )
    )
    of_documents = documents.select("path", F.inline(rules))
    target = F.substring_index("raw_target", "#", 1)
    open_ = links.where((F.col("link_kind") != "external") & (target != "") & (F.col("resolution_status") == "unresolved")).withColumn("_t", target)
    lost = open_.join(documents.select(F.col("path").alias("_t")), "_t", "left_anti").select("path", F.lit("unresolved_link").alias("code"), F.lit("warning").alias("severity"))
    return of_documents.unionByName(lost)


def citations(documents: DataFrame) -> DataFrame:
    """(path, line, label, target, target_kind) of the list items between a heading Citations and the next line that starts with #."""
    lines = F.split("body", "\n")
    state = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("line"), F.lit(0).alias("first"), F.lit(0).alias("last")),
        lambda s, x: F.struct(
            (s["line"] + 1).alias("line"),
            F.when((s["first"] == 0) & F.lower(x).rlike(r"^#{1,6}\s+citations\s*$"), s["line"] + 1).otherwise(s["first"]).alias("first"),
            F.when((s["first"] > 0) & (s["last"] == 0) & x.startswith("#") & ~F.lower(x).rlike(r"^#{1,6}\s+citations\s*$"), s["line"] + 1).otherwise(s["last"]).alias("last"),
        ),
    )
    d = documents.select("path", F.explode(markdown.list_items(F.col("body"))).alias("_i"), state.alias("_s"))
    inside = (F.col("_s.first") > 0) & (F.col("_i.line") > F.col("_s.first")) & ((F.col("_s.last") == 0) | (F.col("_i.line") < F.col("_s.last")))
    target = F.coalesce("_i.target", "_i.item")
    external = target.rlike(markdown.EXTERNAL)
    return d.where(inside).select("path", F.col("_i.line").alias("line"), F.col("_i.label").alias("label"), F.when(external, target).otherwise(F.coalesce(bundle_target(F.col("path"), target), target)).alias("target"), F.when(external, "external").otherwise("bundle_path").alias("target_kind"))


def index_entries(documents: DataFrame) -> DataFrame:
    """(path, line, label, target, description) of the list items of index documents."""
    d = documents.where(document_kind(F.col("path")) == "index").select("path", F.explode(markdown.list_items(F.col("body"))).alias("_i"))
    return d.select("path", F.col("_i.line").alias("line"), F.coalesce("_i.label", "_i.item").alias("label"), bundle_target(F.col("path"), F.col("_i.target")).alias("target"), F.nullif(F.col("_i.rest"), F.lit("")).alias("description"))


# Boards


def board_relations(boards: DataFrame, relation_type: str | None, at: Column) -> DataFrame:
    """Relations of the edges of boards (board_id, nodes[id, record_id], edges[id, from_node, to_node]): both nodes must be bound to records, and
    without an explicit type no edge becomes one."""
    e = boards.where(F.lit(relation_type is not None)).select("board_id", F.explode("edges").alias("_e"))
    n = boards.select("board_id", F.explode("nodes").alias("_n")).where("_n.record_id is not null").select("board_id", F.col("_n.id").alias("_id"), F.col("_n.record_id").alias("_r"))
    ends = e.join(n.select("board_id", F.col("_id").alias("_from"), F.col("_r").alias("source_record_id")), (e["board_id"] == n["board_id"]) & (F.col("_e.from_node") == F.col("_from"))).drop(n["board_id"])
    m = n.select(F.col("board_id").alias("_b"), F.col("_id").alias("_to"), F.col("_r").alias("target_record_id"))
    both = ends.join(m, (F.col("board_id") == F.col("_b")) & (F.col("_e.to_node") == F.col("_to")))
    return both.select(F.concat_ws("-", F.lit("canvas"), "board_id", "_e.id").alias("relation_id"), "source_record_id", "target_record_id", F.lit(relation_type).alias("relation_type"), at.alias("created_at"))



def bundle_imported(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents (path, kind, type, title, body, properties), links and findings (path, line, code, severity) of a bundle's Markdown files (path, content).

    links: path, line (from 1, within the body), raw_target, link_kind, target (a path in the bundle), resolution_status: external, resolved if there is a document at the target, else
    unresolved; an empty target is its own document. Paths that aren't usable, and files that aren't Markdown, are left out.
    """
    usable = files.where((file_kind(F.col("path")) == "markdown") & path_refusal(F.col("path")).isNull()).withColumn("path", normal_path(F.col("path")))
    read = notes(usable.withColumn("deleted", F.lit(False)))
    type_ = F.nullif(F.trim(markdown.scalar(F.col("properties")["type"])["text"]), F.lit(""))
    documents = read.select("path", document_kind(F.col("path")).alias("kind"), type_.alias("type"), "title", "body", "properties")
    raw = documents.select("path", "body", F.explode(F.concat(markdown.wikilinks(F.col("body")), markdown.links(F.col("body")))).alias("_l"))
    line = F.size(F.split(F.substring(F.col("body"), F.lit(1), F.col("_l.start").cast("int")), "\n"))
    found = raw.select("path", line.alias("line"), F.col("_l.raw").alias("raw_target"), F.col("_l.kind").alias("link_kind"))
    bare = F.trim(F.substring_index(F.substring_index("raw_target", "|", 1), "#", 1))
    target = F.when(bare == "", F.col("path")).otherwise(bundle_target(F.col("path"), F.col("raw_target")))
    there = documents.select(F.col("path").alias("target"), F.lit(True).alias("_there"))
    status = F.when(F.col("link_kind") == "external", "external").when(F.col("_there"), "resolved").otherwise("unresolved")
    links = found.withColumn("target", target).join(there, "target", "left").select("path", "line", "raw_target", "link_kind", "target", status.alias("resolution_status"))
    of_documents = findings(documents, links.limit(0)).select("path", F.lit(None).cast("int").alias("line"), "code", "severity")
    climbs = F.when(F.col("target").isNull(), "target_outside_bundle").otherwise("unresolved_link")
    lost = links.where("resolution_status = 'unresolved'").select("path", "line", climbs.alias("code"), F.lit("warning").alias("severity"))
    return documents, links, of_documents.unionByName(lost)


def bundle_exported(documents: DataFrame) -> DataFrame:
    """(path, content, content_hash) of a bundle's documents: their frontmatter in the order of its keys, and their body; reading it again gives the same documents."""
    return exported(documents)
