"""PIP-1: from a corpus table to the passage store."""

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions.text import first_failure, is_blank
from groundwell.operators.admission import assign_category, file_name_rules, split_admitted
from groundwell.operators.chunking import check_chunks, chunk_documents, documents_without_chunks
from groundwell.operators.embedding import check_embeddings, embed_hashed, embed_with
from groundwell.schemas import (
    ALLOWED_EXTENSIONS,
    EMBED_BATCH_SIZE,
    MAX_CHUNK_CHARS,
    MAX_FILE_BYTES,
    OVERLAP_CHARS,
    STORE,
)
from groundwell.session import broadcast_if_small, discard, reclaim, staged, work_path
from groundwell.sources.documents import spread
from groundwell.sources.store import (
    Layout,
    SaveResult,
    bucket_sizes,
    read_store,
    replace_and_insert,
    save_counts,
    store_rows,
)


class IngestSettings(NamedTuple):
    """`embedder` None is the built-in hashed embedder, else a callable (see embed_with)."""

    max_chars: int = MAX_CHUNK_CHARS
    overlap: int = OVERLAP_CHARS
    embedder: Callable | None = None
    width: int = 64
    batch_size: int = EMBED_BATCH_SIZE
    max_bytes: int = MAX_FILE_BYTES
    allowed: tuple = ALLOWED_EXTENSIONS
    measure: Callable[[Column], Column] = F.length
    layout: Layout = Layout()


class Prepared(NamedTuple):
    documents: DataFrame  # admitted: doc_id, file_name, category, character_count
    chunks: DataFrame  # store rows of the documents that passed every check
    rejects: DataFrame  # stage, row_key, error_code
    folder: str  # the passages, which `documents` and `chunks` read and `rejects` does not


class Ingested(NamedTuple):
    saved: SaveResult
    summary: DataFrame
    rejects: DataFrame


def check_corpus(corpus: DataFrame, settings: IngestSettings = IngestSettings()) -> DataFrame:
    """FLT-1, FLT-3, FLT-4, PRJ-1 in request order, in one pass over the corpus.

    The size is that of the file (`size_bytes`) where the corpus carries one, else of the text.
    """
    known = [F.col("size_bytes")] if "size_bytes" in corpus.columns else []
    size = F.coalesce(*known, F.octet_length("text"))
    name = file_name_rules(F.col("file_name"), settings.allowed)
    content = [
        ("document.too_large", size > settings.max_bytes),
        ("document.empty", is_blank(F.col("text"))),
    ]
    resolved = assign_category(corpus)
    code = F.coalesce(first_failure(*name, *content), F.col("error_code"))
    return resolved.withColumn("error_code", code)


def embed_chunks(chunks: DataFrame, settings: IngestSettings) -> DataFrame:
    if settings.embedder is None:
        return embed_hashed(chunks, width=settings.width)
    return embed_with(
        chunks, settings.embedder, width=settings.width, batch_size=settings.batch_size
    )


def _rejected(frame: DataFrame, stage: str) -> DataFrame:
    return frame.select(
        F.lit(stage).alias("stage"), F.col("doc_id").cast("string").alias("row_key"), "error_code"
    )


def prepare(corpus: DataFrame, settings: IngestSettings = IngestSettings()) -> Prepared:
    """Everything before the write. A failed check on one passage refuses its whole document.

    The embedded passages are written to the work folder once: the model runs once per passage,
    and the checks, the counts and the merge all read the files. What the rejects need of them is kept apart.
    """
    size = ["size_bytes"] if "size_bytes" in corpus.columns else []
    corpus = spread(corpus.select("doc_id", "file_name", "category", "text", *size), "doc_id")
    documents, refused = split_admitted(check_corpus(corpus, settings))
    documents = documents.withColumn("character_count", F.length("text"))
    chunks = check_chunks(
        chunk_documents(
            documents,
            carry=("doc_id", "category", "file_name", "character_count"),
            max_chars=settings.max_chars,
            overlap=settings.overlap,
            measure=settings.measure,
        ),
        settings.max_chars,
        settings.measure,
    ).withColumnRenamed("error_code", "chunk_error")
    vectors = check_embeddings(embed_chunks(chunks, settings), settings.width)
    code = F.coalesce("chunk_error", "error_code")
    about = ["file_name", "character_count", "error_code"]
    rows = store_rows(vectors.withColumn("error_code", code), settings.layout, about)
    folder = work_path(corpus.sparkSession, "passages")
    rows = staged(rows, "passages", path=folder, compression="zstd")
    outcomes = staged(rows.select("doc_id", "chunk_index", "error_code"), "outcomes", compression="zstd")
    failed = (
        outcomes.where(F.col("error_code").isNotNull())
        .groupBy("doc_id")
        .agg(F.min_by("error_code", "chunk_index").alias("error_code"))
    )
    bad = failed.select("doc_id")
    passed = rows if failed.isEmpty() else rows.join(broadcast_if_small(bad), "doc_id", "left_anti")
    empty = documents_without_chunks(documents, outcomes)
    rejects = [
        _rejected(refused, "admission"),
        _rejected(empty, "chunking"),
        _rejected(failed, "passages"),
    ]
    admitted = passed.groupBy("doc_id", "category").agg(
        *(F.any_value(c).alias(c) for c in ("file_name", "character_count"))
    )
    rejects = reduce(DataFrame.unionByName, rejects)
    return Prepared(admitted, passed.select(STORE.names), rejects, folder)


def ingest_summary(documents: DataFrame, store: DataFrame, chunks: DataFrame) -> DataFrame:
    """AGG-1, PRJ-5: per document, characters, passages inserted and passages replaced."""
    return documents.join(save_counts(store, chunks), ["doc_id", "category"]).select(
        "doc_id", "file_name", "category", "character_count", "chunks_inserted", "chunks_replaced"
    )


def ingest(
    corpus: DataFrame, path: str, settings: IngestSettings = IngestSettings()
) -> Ingested:
    """Runs a corpus (doc_id, file_name, category, text) into the store at `path`.

    Only the buckets of the batch are read from the store. The summary is staged before the write,
    since the files it is counted from may be replaced. The passages in the work folder go once they are saved.
    """
    spark = corpus.sparkSession
    prepared = prepare(corpus, settings)
    sizes = bucket_sizes(prepared.chunks)
    store = read_store(spark, path, layout=settings.layout)
    store = store.where(F.col("bucket").isin(list(sizes)))
    summary = staged(ingest_summary(prepared.documents, store, prepared.chunks), "summary")
    saved = replace_and_insert(spark, path, prepared.chunks, settings.layout, sizes)
    discard(spark, prepared.folder)
    reclaim(spark)
    return Ingested(saved, summary, prepared.rejects)
