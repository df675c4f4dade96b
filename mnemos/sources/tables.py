"""Typed tables over star-schema, document and event parquet files."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemos.schemas import SOURCES, TIERS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key, values) -> "F.Column":
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each document."""
    d = table(spark, sf_dir, "documents")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    return d.select(
        F.concat(F.lit("doc-"), "doc_id").alias("id"),
        "doc_id",
        F.concat(F.lit("project:"), "source").alias("scope"),
        F.lit("fact").alias("type"),
        F.col("text").alias("content"),
        F.lit(None).cast("string").alias("key"),
        F.concat_ws(" ", F.lit("Document"), "doc_id").alias("title"),
        F.array("lang").alias("tags"),
        F.array().cast("array<string>").alias("entities"),
        _pick(F.col("doc_id"), SOURCES).alias("source"),
        ((F.col("doc_id") % 10) / 10).alias("confidence"),
        _pick(F.col("doc_id"), TIERS).alias("tier"),
        (F.col("doc_id") % 7).alias("access_count"),
        at.alias("created_at"),
        at.alias("updated_at"),
        F.lit(None).cast("timestamp").alias("event_time"),
        F.lit(None).cast("timestamp").alias("valid_to"),
        F.col("source").alias("project_id"),
        F.col("lang"),
        "n_chars",
    )


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each order; a customer's next order ends its validity."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("ord-"), "o_orderkey").alias("id"),
        F.lit("project:orders").alias("scope"),
        F.lit("fact").alias("type"),
        F.concat(F.lit("cust-"), "o_custkey").alias("key"),
        F.col("o_orderstatus").alias("content"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
        F.col("o_orderdate").alias("event_time"),
        F.lead("o_orderdate").over(w).alias("valid_to"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph nodes: regions, nations, suppliers and customers."""
    def of(name, prefix, key, label):
        return table(spark, sf_dir, name).select(F.concat(F.lit(prefix), key).alias("node_id"), F.lit(label).alias("label"))

    return of("region", "r", "r_regionkey", "region").unionByName(of("nation", "n", "n_nationkey", "nation")).unionByName(of("supplier", "s", "s_suppkey", "supplier")).unionByName(of("customer", "c", "c_custkey", "customer"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph edges: customer and supplier -> nation -> region."""
    def of(name, prefix, key, to_prefix, to, kind):
        s, t = F.concat(F.lit(prefix), key), F.concat(F.lit(to_prefix), to)
        return table(spark, sf_dir, name).select(F.concat_ws(">", s, t).alias("edge_id"), s.alias("src"), t.alias("dst"), F.lit(kind).alias("relation_type"))

    out = of("nation", "n", "n_nationkey", "r", "n_regionkey", "depends_on").unionByName(of("supplier", "s", "s_suppkey", "n", "s_nationkey", "supports"))
    return out.unionByName(of("customer", "c", "c_custkey", "n", "c_nationkey", "related_to"))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph edges part -> supplier, one for each pair that was ordered."""
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    s, t = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")
    return pairs.select(F.concat_ws(">", s, t).alias("edge_id"), s.alias("src"), t.alias("dst"), F.lit("related_to").alias("relation_type"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact for each order: the customer's status from one order to the next; times are ISO texts and compare as texts."""
    def iso(c):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("fact-"), "o_orderkey").alias("fact_id"),
        F.concat(F.lit("cust-"), "o_custkey").alias("subject_entity_id"),
        F.lit("has_status").alias("predicate"),
        F.lit(None).cast("string").alias("object_entity_id"),
        F.col("o_orderstatus").alias("object_literal"),
        ((F.col("o_orderkey") % 100) / 100).alias("confidence"),
        iso(F.col("o_orderdate")).alias("valid_from"),
        iso(F.lead("o_orderdate").over(w)).alias("valid_to"),
        iso(F.timestamp_seconds(F.unix_timestamp("o_orderdate") + 86400)).alias("observed_at"),
        F.when(F.col("o_orderkey") % 11 == 0, iso(F.col("o_orderdate"))).alias("invalidated_at"),
        F.lit(None).cast("string").alias("superseded_by_fact_id"),
        F.array(F.concat(F.lit("ep-"), F.col("o_orderkey") % 50)).alias("source_episode_ids"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.concat(F.lit("doc-"), "vec_id").alias("record_id"),
        "vec_id",
        F.concat(F.lit("label-"), "label").alias("vector_space"),
        F.size("embedding").alias("dimension"),
        F.when(F.col("vec_id") % 3 == 0, "alpha").otherwise("beta").alias("provider"),
        F.concat(F.lit("m"), F.col("vec_id") % 4).alias("model"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 50 + 300).alias("updated_at"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change event for each event row."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("purchase", "error"), "record").when(F.col("event_type") == "view", "relation").when(F.col("event_type") == "click", "link").otherwise("entity")
    return e.select(
        (F.col("event_id") + 1).alias("cursor"),
        F.concat(F.lit("ev-"), "event_id").alias("event_id"),
        kind.alias("object_type"),
        F.concat(F.lit("obj-"), F.col("event_id") % 997).alias("object_id"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("operation"),
        F.col("ts").alias("changed_at"),
        F.col("props").alias("payload"),
        F.col("user_id").cast("string").alias("user_id"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("key-"), F.col("event_id") % 400)).alias("idempotency_key"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episode steps from conversations."""
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("ep-"), "conv_id").alias("episode_id"),
        F.col("turn").alias("sequence"),
        F.when(F.col("role") == "user", "user_input").otherwise("tool_result").alias("kind"),
        F.col("text").alias("content"),
        F.concat(F.lit("tool-"), F.col("turn") % 3).alias("tool_id"),
    )
