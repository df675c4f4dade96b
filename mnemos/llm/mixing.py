"""Mixing sources to target weights by Poisson replication.

A source with target share w of N documents has the mean repetition rate w * N / n, for its n documents.
A document's number of copies is the Poisson quantile, at that mean, of a number in (0, 1) hashed from
its doc_id and the seed, so it depends on nothing but the document and the rate. Copies are exploded and
shuffled globally by ranges of another hash.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.llm.words import sheltered

#: Seed; the exponent of a source's size in its target weight, where no weights are given; most sources whose rates are broadcast, and
#: into how many parts each source is split if there are more.
SEED, EXPONENT, BROADCAST_SOURCES, SALTS = 11, 0.5, 100_000, 64


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 of the parts."""
    text = F.concat_ws(":", *(F.coalesce(F.col(p).cast("string"), F.lit("")) if isinstance(p, str) else p.cast("string") for p in parts))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = EXPONENT, total: float | None = None) -> DataFrame:
    """(source, rate): mean copies of each document of a source, by its target weight.

    weights: by source; a source without one gets no copies. Without weights a source weighs its size to the power
    `exponent`. total: documents wanted; as many as there are, if not given. A null source is a source too.
    """
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(exponent)))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "_s string, weight double")
        weighed = sizes.join(F.broadcast(given), sizes["source"].eqNullSafe(given["_s"]), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sums = weighed.agg(F.sum("weight").alias("all"), F.sum("n").alias("rows")).first()
    if not sums["all"]:
        return weighed.select("source", F.lit(0.0).alias("rate"))
    wanted = float(total if total is not None else sums["rows"])
    return weighed.select("source", (F.col("weight") / F.lit(float(sums["all"])) * F.lit(wanted) / F.col("n")).alias("rate"))


def poisson_cdf(rate: Column) -> Column:
    """The Poisson distribution function at 0, 1, ... up to twelve deviations past the mean."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    # ln k! is summed up as k goes; the terms stay in range for large rates as they are logarithms.
    step = lambda acc, k: F.struct(
        (acc["log"] + F.when(k == 0, F.lit(0.0)).otherwise(F.log(rate) - F.log(k.cast("double")))).alias("log"),
        F.concat(acc["cdf"], F.array(F.coalesce(F.try_element_at(acc["cdf"], F.lit(-1)), F.lit(0.0)) + F.exp(acc["log"] + F.when(k == 0, F.lit(0.0)).otherwise(F.log(rate) - F.log(k.cast("double")))))).alias("cdf"),
    )
    start = F.struct((-rate).alias("log"), F.array().cast("array<double>").alias("cdf"))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(0), last), start, step, lambda acc: acc["cdf"])).otherwise(F.array(F.lit(1.0)))


def replicated(docs: DataFrame, rate_table: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with each row once for each of its copies, numbered from 0 in the column copy; not shuffled yet.

    Rows with the same doc_id get the same number of copies at the same rate; a null doc_id is hashed as an empty
    text. A source that is not in the table has no copies. Text is neither read nor changed; a column named copy is
    replaced, others stay whatever their names are. Rates go to every task if they are few; if not, rows are dealt by source and a hash, so that
    a source with many rows is met in many tasks.
    """
    plain, own = sheltered(docs.drop("copy"), ("doc_id", "source"))
    table = rate_table.select(F.col("source").alias("_source"), poisson_cdf(F.col("rate")).alias("_cdf"))
    same = plain["source"].eqNullSafe(table["_source"])
    if rate_table.count() <= BROADCAST_SOURCES:
        joined = plain.join(F.broadcast(table), same)
    else:
        salted = plain.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        joined = salted.join(table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), same & (F.col("_salt") == F.col("_part")))
    below = F.size(F.filter("_cdf", lambda x: x < F.col("_u")))
    copies = joined.withColumn("_u", uniform("doc_id", F.lit(seed))).withColumn("copy", F.explode(F.sequence(F.lit(0), below))).where(F.col("copy") < below)
    return own(copies.select(*plain.columns, "copy"))


def shuffled(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """rows in an order that is hashed from doc_id and copy, over all partitions."""
    return rows.orderBy(uniform("doc_id", F.col("copy"), F.lit(f"order{seed}")), "doc_id", "copy")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = EXPONENT, seed: int = SEED) -> DataFrame:
    """docs mixed to target weights and shuffled; an empty table stays empty."""
    return shuffled(replicated(docs, rates(docs, weights, exponent), seed), seed)
