"""Documents to packed training sequences, stage by stage.

Every stage takes all rows its predecessor kept and decides per row. Where ids repeat or are null, rows get
a number in the order of the ids first, so that decisions meet rows and not ids; rows of one id are told apart by
their place in the input and spread over the sort's ranges like any others. What a stage drops is anti-joined as a
measured broadcast, so that texts are shuffled only where the dropped rows are too many for one.

Defined results: null and empty texts pass the classifier and are copies of one another; repeated rows are copies; empty tables
give no rows; columns of any name are carried along.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.llm.block_naming import exact_groups
from groundwell.llm.histogram_packing import pack
from groundwell.llm.positional_index import decontaminate
from groundwell.llm.positive_unlabelled import train
from groundwell.llm.queries import tokenizer_path
from groundwell.llm.vantage_points import near_groups
from groundwell.llm.word_features import rows_below
from groundwell.session import broadcast_if_small, staged

# SQL cannot express the trained classifier; the tests hold every stage against brute force.
ORACLE_SQL = None


def free_name(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes for no column to have it."""
    while name in docs.columns:
        name = "_" + name
    return name


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """The rows with a number of their own in the order of the ids, null ids first."""
    unsure = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL")
    if unsure.isEmpty():
        return docs.withColumn(row, F.col("doc_id").cast("long"))
    place = free_name(docs, "__place")
    ordered = docs.withColumn(place, F.monotonically_increasing_id()).orderBy(F.col("doc_id").asc_nulls_first(), place)
    return staged(ordered.withColumn(row, F.monotonically_increasing_id()).drop(place), "rows")


def rows_without(docs: DataFrame, dropped) -> DataFrame:
    """The rows of docs, without those whose ids dropped(rows with a doc_id of their own) returns."""
    row = free_name(docs, "__row")
    rows = numbered(docs, row)
    gone = dropped(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row))
    return rows.join(broadcast_if_small(staged(gone, "dropped")), row, "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic go; without toxic training rows all stay."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model is None:
        return docs
    return rows_below(docs, *model[:3], 0.5)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return rows_without(docs, lambda rows: exact_groups(rows).filter("NOT kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints the row with the smallest doc_id stays."""
    return rows_without(docs, lambda rows: near_groups(rows).filter("doc_id <> component_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return rows_without(docs, lambda rows: decontaminate(rows, benchmark).filter("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens, with their ids."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
