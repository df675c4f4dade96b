"""Which texts contain which of many short strings, without pairs of all texts and all strings.

Every string is looked up by the rarest of its runs of three characters, counted over texts; only texts that have that run are
searched for the string. A beginning that many strings and texts share costs nothing unless it is all that a string has. Strings that
are few go to every task, which reads each text once; if they are many, runs of texts and strings are joined.
"""

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Characters of a run; shorter strings are runs themselves. Most needles, and characters of them together, that go to every task. Needles that are searched for one by one, without runs. Texts that are searched at a time.
RUN, FEW_NEEDLES, FEW_CHARACTERS, ONE_BY_ONE, TEXTS = 3, 20_000, 2_000_000, 1_000, 256


def runs(text: Column, size: int = RUN) -> Column:
    """The different runs of `size` characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _all_runs(text: Column, sizes: list[int]) -> Column:
    return F.concat(*(runs(text, k) for k in sizes))


def _runs(text: str) -> set[str]:
    return {text[i : i + RUN] for i in range(max(1, len(text) - RUN + 1))}


def _contained(texts: list[str], needles: list[tuple[int, str, set[str]]]):
    """(place of the text, needle's number) of the needles (number, needle, its runs) that texts contain."""
    if len(needles) <= ONE_BY_ONE:
        yield from ((i, number) for i, text in enumerate(texts) for number, needle, _ in needles if needle in text)
        return
    long = [x for x in needles if len(x[1]) >= RUN]
    wanted = set().union(*(own for _, _, own in long))
    has = [_runs(t) & wanted if long else set() for t in texts]
    counts = Counter(x for own in has for x in own)
    by_run = defaultdict(list)
    for number, needle, own in long:
        by_run[min(own, key=counts.__getitem__)].append((number, needle))
    short = [(number, needle) for number, needle, _ in needles if len(needle) < RUN]
    for i, text in enumerate(texts):
        for number, needle in (x for near in (short, *(by_run[r] for r in has[i] if r in by_run)) for x in near):
            if needle in text:
                yield i, number


def met(texts: DataFrame, needles: DataFrame, by: tuple = ()) -> DataFrame:
    """(id, needle_id): the texts (id, text) that contain a needle (needle_id, needle) as it stands. by: columns of both that must be equal.

    Null and empty texts and needles meet nothing; repeated rows are met once. A needle's key is its rarest run, so work follows the texts that have it.
    """
    by = list(by)
    asked = needles.where(F.length("needle") > 0).select("needle_id", "needle", *by).distinct()
    first = asked.withColumn("_size", F.length("needle")).limit(FEW_NEEDLES + 1)
    n, size = first.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    return (_met_in_tasks if n <= FEW_NEEDLES and size <= FEW_CHARACTERS else _met_by_joins)(texts, asked, by)


def _met_in_tasks(texts: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """`met` with needles that go to every task. The rarest run is that of the texts that are searched together."""
    table = asked.toArrow()  # at most FEW_NEEDLES rows
    groups = defaultdict(list)
    for i, key in enumerate(zip(*(table.column(c).to_pylist() for c in ["needle", *by]), strict=True)):
        if None not in key:
            groups[key[1:]].append((i, key[0], _runs(key[0])))
    shared = texts.sparkSession.sparkContext.broadcast((dict(groups), table.column("needle_id").combine_chunks()))

    def search(batches):
        of, ids = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                keys = list(zip(*(part.column(c).to_pylist() for c in by), strict=True)) if by else [()] * part.num_rows
                text, at, found = part.column("text").to_pylist(), [], []
                for key in set(keys) & set(of):
                    rows = [i for i, k in enumerate(keys) if k == key]
                    for i, number in _contained([text[i] for i in rows], of[key]):
                        at.append(rows[i])
                        found.append(number)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at, pa.int64())), ids.take(pa.array(found, pa.int64()))], ["id", "needle_id"])

    out = StructType([texts.schema["id"], StructField("needle_id", asked.schema["needle_id"].dataType)])
    return texts.where(F.length("text") > 0).select("id", "text", *by).mapInArrow(search, out).distinct()


def _met_by_joins(texts: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """`met` with any number of needles."""
    sizes = [r[0] for r in asked.select(F.least(F.length("needle"), F.lit(RUN))).distinct().collect()]  # at most RUN numbers
    if not sizes:
        return texts.select("id").limit(0).join(asked.select("needle_id").limit(0), F.lit(True))
    own = F.when(F.length("needle") < RUN, F.array("needle")).otherwise(runs(F.col("needle")))
    keys = asked.select("*", F.explode(own).alias("run"))
    has = texts.where(F.length("text") > 0).select("id", *by, F.explode(_all_runs(F.col("text"), sorted(sizes))).alias("run")).join(keys.select(*by, "run").distinct(), [*by, "run"], "left_semi")
    counts = has.groupBy(*by, "run").count()
    # A run that no text has rules its needle out, so it is the rarest.
    rarest = keys.join(counts, [*by, "run"], "left").groupBy("needle_id", "needle", *by).agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "run")).alias("_r"))
    near = has.join(rarest.where("_r.n > 0").select("needle_id", "needle", *by, F.col("_r.run").alias("run")), [*by, "run"])
    found = near.select("id", *by, "needle_id", "needle").join(texts.select("id", *by, "text"), ["id", *by])
    return found.where(F.contains("text", "needle")).select("id", "needle_id").distinct()
