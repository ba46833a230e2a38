"""The given tables in the roles the operators expect. Every frame covers its whole table."""

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.operators.chunking import chunk_documents
from groundwell.plans.answer import SearchSettings
from groundwell.plans.ingest import IngestSettings, ingest, prepare
from groundwell.session import work_path
from groundwell.sources.documents import read_table, spread
from groundwell.sources.store import Layout, last_requests, read_store

WIDTH = 64
LAYOUT = Layout(category_slots=4, text_slots=2)
INGEST = IngestSettings(width=WIDTH, layout=LAYOUT)
SEARCH = SearchSettings(width=WIDTH, refuse_below=0.65)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ingest requests; every fourth leaves the category to the file name."""
    return read_table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".md")).alias("file_name"),
        F.when(F.col("doc_id") % 4 != 3, F.col("source")).alias("category"),
        "text",
    )


def revised_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents sent again: every third with a line added, every fifth moved."""
    doc = F.col("doc_id")
    return corpus(spark, sf_dir).withColumns(
        {
            "text": F.when(doc % 3 == 0, F.concat("text", F.lit("\nRevised."))).otherwise(
                F.col("text")
            ),
            "category": F.when(doc % 5 == 0, F.lit("moved")).otherwise(F.col("category")),
        }
    )


def arriving(corpus_frame: DataFrame) -> DataFrame:
    return prepare(corpus_frame, INGEST).chunks


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after ingesting the corpus."""
    return last_requests(arriving(corpus(spark, sf_dir)))


def saved_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store on disk after ingesting the corpus, and once more the same corpus."""
    path = work_path(spark, "store")
    for _ in range(2):
        ingest(corpus(spark, sf_dir), path, INGEST)
    return read_store(spark, path, layout=LAYOUT)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of ten kinds, by document."""
    doc = F.col("doc_id")
    name = lambda before, after: F.concat(F.lit(before), doc, F.lit(after))
    cases = [
        name("doc", ".md"),
        name("doc", ".TXT"),
        name("../doc", ".md"),
        name("nested/doc", ".txt"),
        name("doc", ".exe"),
        F.lit(".md"),
        F.lit(""),
        F.lit(".."),
        name("do?c", ".txt"),
        name("a\\doc", ".md"),
    ]
    chosen = F.element_at(F.array(*cases), (doc % 10 + 1).cast("int"))
    return read_table(spark, sf_dir, "documents").select("doc_id", chosen.alias("file_name"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as search requests of eight kinds, three of them admissible."""
    kind = (F.col("conv_id") * 7 + F.col("turn")) % 8
    return (
        read_table(spark, sf_dir, "conversations")
        .where("role = 'user'")
        .select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
            F.when(kind == 6, "   ")
            .when(kind == 7, F.repeat(F.lit("x"), 2001))
            .otherwise(F.concat(F.lit(" "), "text", F.lit("\n")))
            .alias("query"),
            F.when(kind == 1, 3).when(kind == 2, 0).when(kind == 3, 51).alias("top_k"),
            F.when(kind == 1, F.concat(F.lit(" src"), F.col("conv_id") % 20))
            .when(kind == 0, "")
            .alias("category"),
            F.when(kind == 4, 0.7).when(kind == 5, 1.5).cast("double").alias("min_similarity"),
        )
    )


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All user turns as valid search requests: other counts, a category, a blank one, a floor."""
    kind = (F.col("conv_id") * 7 + F.col("turn")) % 8
    return (
        read_table(spark, sf_dir, "conversations")
        .where("role = 'user'")
        .select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
            F.concat(F.lit(" "), "text", F.lit("\n")).alias("query"),
            F.when(kind == 1, 3).when(kind == 2, 1).when(kind == 3, 50).alias("top_k"),
            F.when(kind == 1, F.concat(F.lit(" src"), F.col("conv_id") % 20))
            .when(kind == 0, "")
            .alias("category"),
            F.when(kind == 4, 0.7).when(kind == 5, 1.0).cast("double").alias("min_similarity"),
        )
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All user turns and all benchmark passages as plain questions."""
    turns = (
        read_table(spark, sf_dir, "conversations")
        .where("role = 'user'")
        .select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    )
    items = read_table(spark, sf_dir, "benchmark").select(
        (-1 - F.col("item_id")).alias("query_id"), F.col("text").alias("query")
    )
    absent = {
        "top_k": F.lit(None).cast("int"),
        "category": F.lit(None).cast("string"),
        "min_similarity": F.lit(None).cast("double"),
    }
    return turns.unionByName(items).withColumns(absent)


def document_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with one .txt file per document (its text and a line break)."""
    path = work_path(spark, "folder")
    texts = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    scheme = re.match("[a-zA-Z0-9]+:", path) or spark._jsc.hadoopConfiguration().get("fs.defaultFS")
    if str(scheme if isinstance(scheme, str) else scheme[0]).startswith("file:"):
        write_files(texts, re.sub("^file:/+", "/", path))
    else:
        texts.select("text").write.option("maxRecordsPerFile", 1).text(path)
    return path


def write_files(texts: DataFrame, path: str) -> None:
    """One file per row in a folder of a file system that all tasks see. Spark's own writer starts a chmod process for each
    file there. A repeated task writes the same files again."""
    os.makedirs(path)

    def write(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for text in batch.column("text"):
                with open(f"{path}/part-{part:05d}-{n:09d}.txt", "wb") as file:
                    file.write((text.as_py() or b"") + b"\n")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["files"])

    ordered = texts.select("doc_id", F.col("text").cast("binary").alias("text"))
    ordered = ordered.sortWithinPartitions("doc_id", "text").select("text")
    ordered.mapInArrow(write, "files long").agg(F.sum("files")).collect()


def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("record_id"), F.col("label").cast("string").alias("category"), "embedding"
    )


def vector_questions(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    """Every vector as a question."""
    return (
        read_table(spark, sf_dir, "embeddings")
        .withColumns(columns)
        .select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), *columns)
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as raw model responses of five kinds, with three labels each."""
    conv = F.col("conv_id")
    kind = (conv + F.col("turn")) % 5
    text = F.col("text")
    return (
        read_table(spark, sf_dir, "conversations")
        .where("role = 'assistant'")
        .select(
            "conv_id",
            "turn",
            F.when(kind == 0, F.concat(text, F.lit(" [S1].")))
            .when(kind == 1, F.concat(text, F.lit(" [S2, S1] and [S9].")))
            .when(kind == 2, F.concat(F.lit("INSUFFICIENT_CONTEXT: "), text))
            .when(kind == 3, "INSUFFICIENT_CONTEXT")
            .otherwise(text)
            .alias("raw_answer"),
            F.when(kind == 4, "Length").otherwise("stop").alias("finish_reason"),
            F.create_map(
                *(x for i in (1, 2, 3) for x in (F.lit(i), conv * 10 + i))
            ).alias("labels"),
        )
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return chunk_documents(documents)
