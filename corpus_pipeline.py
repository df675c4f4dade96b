"""A training corpus from the table documents: classify, deduplicate, decontaminate, mix.

For every stage: a null or empty text has no words and is judged as its operator's docstring says (it is no near copy of anything, holds no
passage and no benchmark item, and the classifier gives it the curve's value at 0); long texts are read whole; repeated rows are judged each
and stay or go together; ties between doc_ids are ties of one document; an empty table gives an empty one. Columns of the documents pass
unchanged whatever their names are: operators see them under other names.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemos.llm import decontaminate, mixing, neardup, quality, substrings
from mnemos.llm.graph import cut
from mnemos.llm.words import sheltered


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts label 1 for. Without labels to learn from, the score is 0.5 and all stay."""
    plain, own = sheltered(docs)
    model = quality.trained(plain, _table(spark, sf_dir, "labels"))
    return own(quality.scored(plain, model).where("predicted = 1").select(plain.columns))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id (all its rows, if it is repeated). Rows without doc_id stay."""
    plain, own = sheltered(docs)
    return own(neardup.representatives(plain))


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in documents with smaller ids; n_chars, if there is such a column, follows the text.

    All rows stay, also those whose text is left empty; a text that loses nothing stays as it is.
    """
    counted = [c for c in docs.columns if c == "n_chars"]
    plain, own = sheltered(docs, ("doc_id", "text", *counted))
    out = substrings.deduplicated(plain)
    text, changed = F.col("kept_text"), F.col("n_removed") > 0
    new = {"text": text} | {c: F.when(changed, F.length(text)).otherwise(F.col(c)).cast(docs.schema[c].dataType) for c in counted}
    return own(out.select(*(new.get(c, F.col(c)).alias(c) for c in plain.columns)))


def no_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no window of a benchmark item occurs in."""
    plain, own = sheltered(docs)
    return own(decontaminate.decontaminated(plain, _table(spark, sf_dir, "benchmark")))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the sources' target weights, in a hashed order, with the number of the copy in a further column copy (which
    replaces one of that name). A null source is a source of its own."""
    plain, own = sheltered(docs.drop("copy"), ("doc_id", "source"))
    return own(mixing.mixed(plain))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", no_near_duplicates),
    ("repeated_passages", no_repeated_passages),
    ("benchmark", no_benchmark_items),
    ("mixture", mixed_sources),
]

#: SQL can't compress texts with zstandard dictionaries.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. What a stage leaves is cut off from its lineage before the next one reads it."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
