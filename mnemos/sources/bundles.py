"""Exports and imports of tables: snapshots, deltas, backups with manifests, and sealed payloads."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshot(records: DataFrame, edges: DataFrame, where: Column | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Records to export, by id, and the edges both of whose ends are exported."""
    kept = records.where(where) if where is not None else records
    kept = kept.orderBy("id").limit(limit) if limit is not None else kept
    ids = kept.select("id")
    return kept, edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")


def import_plan(incoming: DataFrame, existing: DataFrame, on_conflict: str = "skip") -> DataFrame:
    """(id, action): create what isn't there; for what is: skip or overwrite, or raise an error."""
    if on_conflict not in ("skip", "overwrite", "error"):
        raise ValueError(f"unknown choice {on_conflict!r}")
    there = existing.select("id", F.lit(True).alias("_there")).distinct()
    clash = F.raise_error(F.concat(F.lit("already there: "), "id")).cast("string") if on_conflict == "error" else F.lit(on_conflict)
    return incoming.select("id").distinct().join(there, "id", "left").select("id", F.when(F.col("_there").isNull(), "create").otherwise(clash).alias("action"))


def merged(existing: DataFrame, incoming: DataFrame, on_conflict: str = "skip") -> DataFrame:
    """existing with what import_plan takes from incoming."""
    if on_conflict == "skip":
        return existing.unionByName(incoming.join(existing.select("id"), "id", "left_anti").select(*existing.columns))
    return existing.join(incoming.select("id"), "id", "left_anti").unionByName(incoming.select(*existing.columns))


def row_hash(df: DataFrame) -> Column:
    """SHA-256 of a row as JSON, columns in alphabetical order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, row_count, byte_size, checksum): the checksum adds up the rows' hashes, so neither order nor partitions matter."""
    out = None
    for name, df in tables.items():
        h = row_hash(df)
        parts = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")) for i in range(4)]
        line = df.agg(F.lit(name).alias("name"), F.count("*").alias("row_count"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))), F.lit(0)).alias("byte_size"), F.concat_ws("-", *(F.coalesce(p, F.lit(0).cast("decimal(30,0)")).cast("string") for p in parts)).alias("checksum"))
        out = line if out is None else out.unionByName(line)
    return out


def verified(was: DataFrame, now: DataFrame) -> DataFrame:
    """(name, status) of two manifests: ok, changed, missing or added."""
    a, b = was.select("name", F.struct("row_count", "checksum").alias("_a")), now.select("name", F.struct("row_count", "checksum").alias("_b"))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "added").when(F.col("_a") == F.col("_b"), "ok").otherwise("changed")
    return a.join(b, "name", "full_outer").select("name", status.alias("status"))


def integrity(df: DataFrame, column: str = "integrity_hash") -> DataFrame:
    """df with integrity: unverified without a hash, valid if it is that of the other columns, else tampered."""
    rest = df.drop(column)
    return df.withColumn("integrity", F.when(F.col(column).isNull(), "unverified").when(F.col(column) == row_hash(rest), "valid").otherwise("tampered"))


def sealed(df: DataFrame, key: bytes, columns: list[str], bound: list[str] | None = None) -> DataFrame:
    """df with `columns` replaced by one binary column sealed, their JSON under AES-GCM; bound: columns that stay readable and that the seal is bound to."""
    said = F.to_json(F.struct(*columns))
    if not bound:
        return df.withColumn("sealed", F.aes_encrypt(said, F.lit(key))).drop(*columns)
    return df.withColumn("sealed", F.aes_encrypt(said, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), _associated(bound))).drop(*columns)


def _associated(bound: list[str]) -> Column:
    return F.to_json(F.struct(*sorted(bound)), {"ignoreNullFields": "false"}).cast("binary")


def opened(df: DataFrame, key: bytes, schema: str, bound: list[str] | None = None) -> DataFrame:
    """df with what was sealed. With another key, or where a bound column was changed, Spark raises an error for the row."""
    plain = F.aes_decrypt("sealed", F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), _associated(bound)) if bound else F.aes_decrypt("sealed", F.lit(key))
    return df.withColumn("_o", F.from_json(plain.cast("string"), schema)).select(*[c for c in df.columns if c != "sealed"], "_o.*")


def write_bundle(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as JSON lines, and their manifest."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
    manifest(tables).write.mode("overwrite").json(f"{folder}/_manifest_")


def read_bundle(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a bundle; raises ValueError if one isn't what the manifest says."""
    tables = {name: spark.read.schema(s).json(f"{folder}/{name}") for name, s in schemas.items()}
    was = spark.read.schema("name string, row_count long, byte_size long, checksum string").json(f"{folder}/_manifest_")
    wrong = [r.name for r in verified(was, manifest(tables)).where("status <> 'ok'").collect()]
    if wrong:
        raise ValueError(f"not as written: {sorted(wrong)}")
    return tables


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text, hash) of the Markdown files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    return files.select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("hash"))


def imported(existing: DataFrame, incoming: DataFrame, rewrites: dict[str, str] | None = None, namespaces: list[dict] | None = None, on_conflict: str = "skip", direct: bool = True) -> tuple[DataFrame, DataFrame]:
    """A snapshot's records with what becomes of each: (records to put, or candidates if not direct; (id, action) of all).

    Scopes are rewritten first, then records outside the allowed namespaces are skipped, then those that are there already are, or overwrite, or are an error.
    """
    from mnemos.functions.columns import in_any_namespace

    scope = F.col("scope")
    for old, new in (rewrites or {}).items():
        scope = F.when(F.col("scope") == old, F.lit(new)).otherwise(scope)
    moved = incoming.withColumn("scope", scope)
    allowed = moved.withColumn("_in", in_any_namespace(namespaces))
    plan = import_plan(allowed.where("_in"), existing, on_conflict)
    action = F.when(~F.col("_in"), "outside").when(F.col("action").isin("create", "overwrite"), F.col("action") if direct else F.lit("stage")).otherwise(F.col("action"))
    judged = allowed.join(plan, "id", "left").withColumn("action", action)
    return judged.where(F.col("action").isin("create", "overwrite", "stage")).select(*incoming.columns), judged.select("id", "action")


def delta_applied(existing: DataFrame, events: DataFrame, fields: str) -> DataFrame:
    """A table (id, ...) after change events (cursor, object_id, operation, payload: JSON of `fields`): the last event of each object counts, deleted objects go."""
    last = events.groupBy(F.col("object_id").alias("id")).agg(F.max_by(F.struct("operation", "payload"), "cursor").alias("_e"))
    rest = existing.join(last.select("id"), "id", "left_anti")
    new = last.where("_e.operation <> 'delete'").select("id", F.from_json("_e.payload", fields).alias("_p")).select("id", "_p.*")
    return rest.unionByName(new.select(*existing.columns))


def retention_snapshot(tables: dict[str, DataFrame], namespace: str, name: str, existing: DataFrame, at: Column, overwrite: bool = False) -> DataFrame:
    """Rows (namespace_key, name, created_at, table, row_count, byte_size, checksum) of a named snapshot; ValueError if the name is taken."""
    if not overwrite and not existing.where((F.col("namespace_key") == namespace) & (F.col("name") == name)).isEmpty():
        raise ValueError(f"there is a snapshot {name!r} already")
    m = manifest(tables).withColumnRenamed("name", "table")
    return m.select(F.lit(namespace).alias("namespace_key"), F.lit(name).alias("name"), at.alias("created_at"), "table", "row_count", "byte_size", "checksum")


def review(tables: dict[str, DataFrame], evidence: str = "evidence_refs") -> DataFrame:
    """(section, row_count, checksum, warnings) of a bundle to review, by section: warnings count rows without evidence where a table has that column."""
    none = None
    for name, df in sorted(tables.items()):
        n = F.count_if(F.coalesce(F.size(F.col(evidence)), F.lit(0)) <= 0) if evidence in df.columns else F.lit(0).cast("long")
        line = df.agg(F.lit(name).alias("section"), n.alias("warnings"))
        none = line if none is None else none.unionByName(line)
    return manifest(tables).select(F.col("name").alias("section"), "row_count", "checksum").join(none, "section").orderBy("section")


def encoded(df: DataFrame, key: str) -> DataFrame:
    """(key, payload): rows as JSON with their columns in alphabetical order, nulls kept."""
    return df.select(key, F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("payload"))


def decoded(rows: DataFrame, schema: str) -> DataFrame:
    """Rows of encoded again; ValueError at run time is left to Spark: a payload that isn't JSON gives nulls."""
    return rows.select(F.from_json("payload", schema).alias("_p")).select("_p.*")


def restored(spark: SparkSession, folder: str, was: DataFrame, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a backup folder, if each is as its manifest says."""
    tables = {n: spark.read.parquet(f"{folder}/{n}") for n in names}
    wrong = [r.name for r in verified(was, manifest(tables)).where("status <> 'ok'").collect()]
    if wrong:
        raise ValueError(f"not as backed up: {sorted(wrong)}")
    return tables


def backed_up(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes tables as parquet and gives their manifest."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return manifest(tables)
