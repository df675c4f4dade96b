"""Importance resampling towards a target: which documents look most like a set of target texts.

Each task hands its texts to DuckDB, where SQL cuts them into words, makes n-grams by windows and counts them in hashed buckets; the
bucket is the CRC-32 of an n-gram, by a registered zlib function. The counts are written as Parquet in the shared folder, so that
texts are read once; Spark adds them up, weighs buckets and scores documents from them.
"""

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemos.functions.shared import spilled
from mnemos.llm.graph import cut
from mnemos.llm.words import pieces

#: Longest n-gram; buckets; seed of the draw; fewest words of a document that may be drawn; hundredths of these that are drawn.
LENGTH, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_COUNTS = """
WITH cut AS (SELECT i, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS w FROM texts),
words AS (SELECT i, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM cut),
grams AS ({grams}),
counted AS (SELECT i, g, count(*) AS n FROM grams GROUP BY ALL),
hashed AS (SELECT g, CAST(crc(g) % {buckets} AS INTEGER) AS b FROM (SELECT DISTINCT g FROM counted)),
bucketed AS (SELECT i, b, CAST(sum(n) AS INTEGER) AS n FROM counted JOIN hashed USING (g) GROUP BY ALL),
lists AS (SELECT i, list(b ORDER BY b) AS buckets, list(n ORDER BY b) AS counts FROM bucketed GROUP BY i)
SELECT CAST(len(w) AS BIGINT) AS n_words, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts FROM cut LEFT JOIN lists USING (i) ORDER BY i
"""


def _sql(length: int, buckets: int) -> str:
    """Counts of the runs of 1 to `length` words by bucket, a row for each text in the order of the column i."""

    def of(k: int) -> str:
        after = ", ".join(["w", *(f"lead(w, {j}) OVER following" for j in range(1, k))])
        last = f" WINDOW following AS (PARTITION BY i ORDER BY p) QUALIFY lead(w, {k - 1}) OVER following IS NOT NULL" if k > 1 else ""
        return f"SELECT i, concat_ws(' ', {after}) AS g FROM words{last}"

    return _COUNTS.format(word=WORD, buckets=buckets, grams=" UNION ALL ".join(map(of, range(1, length + 1))))


def _crc(texts: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(x) for x in texts.cast(pa.binary()).to_pylist()], pa.int64())


def bucket_counts(docs: DataFrame, key: str, length: int = LENGTH, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_words, buckets, counts): how often the n-grams of a text fall into each bucket that they fall into, in the order of the buckets.

    A null or empty text has no words and empty lists. A row for each row of docs. DuckDB gets texts by parts of a few megabytes, on one thread.
    """
    sql, kind = _sql(length, buckets), docs.schema[key].dataType.simpleString()

    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        con.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
        for batch in batches:
            for part in pieces(batch):
                texts = pa.table({"i": pa.array(range(part.num_rows), pa.int64()), "t": part.column("text").fill_null("")})
                con.register("texts", texts)
                found = con.sql(sql).to_arrow_table()
                con.unregister("texts")
                columns = [pa.chunked_array([part.column(key)]), *(found.column(c) for c in ("n_words", "buckets", "counts"))]
                yield from pa.table(columns, [key, "n_words", "buckets", "counts"]).combine_chunks().to_batches()
        con.close()

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, n_words long, buckets array<int>, counts array<int>")


def _total(counts: DataFrame, name: str) -> DataFrame:
    return counts.select(F.inline(F.arrays_zip("buckets", "counts"))).groupBy(F.col("buckets").alias("bucket")).agg(F.sum(F.col("counts").cast("long")).alias(name))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Of each bucket, floor(1000 ln of its smoothed share of the target's n-grams over that of the documents')."""
    both = raw.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(_total(raw, "s"), "bucket", "left").join(_total(target, "t"), "bucket", "left").na.fill(0)
    rows = both.select("bucket", F.col("s").cast("double"), F.col("t").cast("double")).toPandas().sort_values("bucket")
    s, t = rows["s"].sum(), rows["t"].sum()
    rows["x"] = (rows["t"] + 1) * (s + buckets) / ((rows["s"] + 1) * (t + buckets))
    import numpy as np

    return np.floor(1000 * np.log(rows["x"])).astype(int).tolist()


def _floored(total: Column, n: Column) -> Column:
    """The floored quotient of integers, 0 if there is nothing to divide by."""
    return F.when(n > 0, F.call_function("div", total - F.pmod(total, n), n)).otherwise(F.lit(0)).cast("long")


def noise(key: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel number), from the first 32 bits of the SHA-256 of seed:key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(counts: DataFrame, gain: list[int], key: str, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score) of the rows of bucket_counts."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    total = F.aggregate(F.zip_with("buckets", "counts", lambda b, n: F.get(table, b) * n), F.lit(0).cast("long"), lambda a, x: a + x)
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    summed = counts.select(key, "n_words", n.alias("n_features"), total.alias("_total"))
    weighed = summed.withColumn("weight", _floored(F.col("_total"), F.col("n_features"))).drop("_total")
    return weighed.withColumn("score", F.col("weight") + noise(F.col(key), seed))


def drawn(rows: DataFrame, key: str, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """rows with rank: 1, 2, ... of the floor(percent of the rows with least_words) highest scores, ties to the smaller key; null for others.

    Scores are whole numbers in a range of some ten thousands, so how many rows have each is a small table; it tells which scores are
    drawn and where the ranks of each begin. Only rows of one score are put in order together.
    """
    may = F.col("n_words") >= least_words
    sizes = rows.where(may).groupBy("score").count()
    place = Window.orderBy(F.desc("score"))
    before = sizes.select("score", (F.sum("count").over(place) - F.col("count")).alias("_before"), F.sum("count").over(Window.partitionBy()).alias("_all"))
    reached = before.where(F.col("_before") < F.floor(F.col("_all") * percent / 100)).withColumn("_draw", F.floor(F.col("_all") * percent / 100)).drop("_all")
    met = rows.join(F.broadcast(reached.withColumnRenamed("score", "_score")), may & (F.col("score") == F.col("_score")), "left").drop("_score")
    order = F.row_number().over(Window.partitionBy("score").orderBy(key, "n_features", "n_words"))
    ranked = met.where(F.col("_before").isNotNull()).withColumn("rank", (F.col("_before") + order).cast("long"))
    first = ranked.withColumn("rank", F.when(F.col("rank") <= F.col("_draw"), F.col("rank")))
    rest = met.where(F.col("_before").isNull()).withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(rest).drop("_before", "_draw")


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", length: int = LENGTH, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of docs (key, text), drawn towards the texts of target.

    A null or empty text has no words, weight 0, and isn't drawn; long texts are read whole; repeated rows are scored and drawn each, in any order
    among equals; a null key is hashed as an empty one and comes first in ties; without documents there are no rows, and without target texts all
    weights tell is how rare a bucket is. Other columns of docs and target aren't read, whatever their names are.
    """
    raw = spilled(bucket_counts(docs, key, length, buckets))
    aim = spilled(bucket_counts(target.select("text").withColumn("_id", F.lit(0)), "_id", length, buckets))
    rows = cut(scored(raw, gains(raw, aim, buckets), key, seed))
    return drawn(rows, key, least_words, percent)
