"""The registered queries: operators and pipelines over the given tables."""

import re
from functools import lru_cache
from hashlib import md5

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks import frames
from checks.frames import LAYOUT, SEARCH, WIDTH
from groundwell.functions.vectors import cosine_distance, similarity
from groundwell.operators.admission import (
    assign_category,
    check_documents,
    check_file_names,
    check_requests,
    rejects_by_code,
    rejects_of,
    split_admitted,
)
from groundwell.operators.answers import (
    extract_citations,
    generate_extractive,
    generate_with,
    normalize_answers,
    public_answers,
)
from groundwell.operators.cell_bounds import bounded_top_k, cell_bounds
from groundwell.operators.cells import approx_top_k, assign_cells, train_centroids
from groundwell.operators.chunking import (
    check_chunks,
    chunk_fixed_width,
    documents_without_chunks,
)
from groundwell.operators.codes import certified_top_k, code_rows
from groundwell.operators.context import (
    answer_without_evidence,
    build_prompts,
    has_evidence,
    select_context,
    with_hits,
)
from groundwell.operators.embedding import (
    check_embeddings,
    chunks_without_vectors,
    embed_hashed,
    embed_with,
    pair_vectors,
)
from groundwell.operators.reports import grounding_report, search_usage
from groundwell.operators.similarity import top_k, top_k_single
from groundwell.plans.answer import HIT_KEYS, answer_questions, retrieve
from groundwell.plans.ingest import ingest, ingest_summary, prepare
from groundwell.session import staged, work_path
from groundwell.sources.documents import list_documents, read_documents, read_table, spread
from groundwell.sources.store import (
    append_chunks,
    merged_store,
    read_cells,
    read_population,
    read_store,
    replaced_rows,
    store_audit,
    write_cells,
)
from groundwell.streaming.ingest import start_ingest, watch_table

STORE_VIEW = ["record_id", "category", "doc_id", "chunk_index", "chunk_text"]
HIT_VIEW = ["query_id", "rank", "record_id", "similarity"]


def _joined(column: str) -> Column:
    return F.concat_ws(",", F.col(column).cast("array<string>"))


# Sources and sinks


def document_sizes(spark, sf_dir) -> DataFrame:
    """The listing of a folder with one file per document."""
    return list_documents(spark, frames.document_folder(spark, sf_dir)).select("size_bytes")


def document_read(spark, sf_dir) -> DataFrame:
    """The texts and the rejects of that folder, with a size cap that refuses some files."""
    documents, rejects = read_documents(
        spark, frames.document_folder(spark, sf_dir), max_bytes=4000
    )
    read = documents.select("text", F.lit(None).cast("string").alias("error_code"))
    refused = rejects.select(F.lit(None).cast("string").alias("text"), "error_code")
    return read.unionByName(refused)


def chunk_store_scan(spark, sf_dir) -> DataFrame:
    path = work_path(spark, "store")
    append_chunks(frames.store(spark, sf_dir), path)
    scanned = read_store(spark, path, layout=LAYOUT)
    return scanned.select(*STORE_VIEW, F.round("norm", 5).alias("norm"))


def chunk_store_category(spark, sf_dir) -> DataFrame:
    """The passages of one category, read from the written store with the filter pushed down."""
    path = work_path(spark, "store")
    append_chunks(frames.store(spark, sf_dir), path)
    return read_store(spark, path, " src1 ", LAYOUT).select(*STORE_VIEW)


def chunk_store_append(spark, sf_dir) -> DataFrame:
    path = work_path(spark, "store")
    append_chunks(frames.arriving(frames.corpus(spark, sf_dir)), path)
    return read_store(spark, path, layout=LAYOUT).select(*STORE_VIEW)


def replace_and_insert(spark, sf_dir) -> DataFrame:
    incoming = frames.arriving(frames.revised_corpus(spark, sf_dir))
    return merged_store(frames.store(spark, sf_dir), incoming).select(*STORE_VIEW)


def replace_and_insert_on_disk(spark, sf_dir) -> DataFrame:
    path = work_path(spark, "store")
    ingest(frames.corpus(spark, sf_dir), path, frames.INGEST)
    ingest(frames.revised_corpus(spark, sf_dir), path, frames.INGEST)
    return read_store(spark, path, layout=LAYOUT).select(*STORE_VIEW)


def incremental_ingest(spark, sf_dir) -> DataFrame:
    path = work_path(spark, "store")
    table = read_table(spark, sf_dir, "documents")
    arriving = watch_table(spark, sf_dir, table.schema, "documents.parquet").select(
        "doc_id",
        F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".md")).alias("file_name"),
        F.when(F.col("doc_id") % 4 != 3, F.col("source")).alias("category"),
        "text",
    )
    point, rejects = work_path(spark, "stream"), work_path(spark, "rejects")
    start_ingest(arriving, path, point, rejects, frames.INGEST).awaitTermination()
    return read_store(spark, path, layout=LAYOUT).select(*STORE_VIEW)


# Admission


def file_name_admission(spark, sf_dir) -> DataFrame:
    return check_file_names(frames.manifest(spark, sf_dir))


def document_admission(spark, sf_dir) -> DataFrame:
    """Size cap lowered to the test texts, of which it then refuses some."""
    documents = read_table(spark, sf_dir, "documents")
    return check_documents(documents, max_bytes=4000).select("doc_id", "error_code")


def search_request_admission(spark, sf_dir) -> DataFrame:
    return check_requests(frames.requests(spark, sf_dir))


def category_assign(spark, sf_dir) -> DataFrame:
    given = frames.corpus(spark, sf_dir).withColumn(
        "category", F.concat(F.lit(" \t"), "category", F.lit(" "))
    )
    return assign_category(given).select("doc_id", "file_name", "category", "error_code")


def rejects_by_code_report(spark, sf_dir) -> DataFrame:
    _, names = split_admitted(check_file_names(frames.manifest(spark, sf_dir)))
    _, asked = split_admitted(check_requests(frames.requests(spark, sf_dir)))
    _, sized = split_admitted(document_admission(spark, sf_dir))
    rejects = rejects_of(names, "file_name", "doc_id")
    rejects = rejects.unionByName(rejects_of(asked, "request", "query_id"))
    return rejects_by_code(rejects.unionByName(rejects_of(sized, "document", "doc_id")))


# Chunks and vectors


def chunk_documents_query(spark, sf_dir) -> DataFrame:
    return frames.chunks(spark, sf_dir)


def chunk_fixed_width_query(spark, sf_dir) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk_fixed_width(spread(documents, "doc_id"))


def chunk_budget_audit(spark, sf_dir) -> DataFrame:
    """Per document: passages, longest passage, defects against a limit of 900, and if none came."""
    chunks = frames.chunks(spark, sf_dir)
    audited = check_chunks(chunks, 900)
    documents = read_table(spark, sf_dir, "documents")
    missing = documents_without_chunks(documents, chunks).select(
        "doc_id", F.lit(0).cast("bigint").alias("chunks"), F.lit(0).alias("longest"),
        F.lit(0).cast("bigint").alias("over_limit"),
    )
    return (
        audited.groupBy("doc_id")
        .agg(
            F.count("*").alias("chunks"),
            F.max(F.length("chunk_text")).alias("longest"),
            F.count("error_code").alias("over_limit"),
        )
        .unionByName(missing)
    )


def embed_hashed_query(spark, sf_dir) -> DataFrame:
    """Non-zero entries of the vector of every document."""
    documents = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    vectors = embed_hashed(documents, "text", WIDTH)
    return vectors.select("doc_id", F.posexplode("embedding").alias("position", "weight")).where(
        "weight > 0"
    ).select("doc_id", "position", F.round(F.col("weight").cast("double"), 6).alias("weight"))


@lru_cache(maxsize=1 << 16)
def _place(word: str) -> int:
    return int(md5(word.encode()).hexdigest()[:8], 16) % WIDTH


def hashing_model(texts) -> np.ndarray:
    """A stand-in for a user's model: the same vectors as the built-in embedder."""
    out = np.zeros((len(texts), WIDTH))
    for row, text in enumerate(texts):
        places = [_place(word) for word in re.findall(r"[^\W_]+", text.lower())]
        out[row] = np.bincount(np.array(places, np.int64), minlength=WIDTH)
    norms = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.divide(out, norms, out=out, where=norms > 0).astype(np.float32)


def embed_chunks(spark, sf_dir) -> DataFrame:
    vectors = embed_with(frames.chunks(spark, sf_dir), hashing_model, width=WIDTH)
    weighted = F.aggregate(
        F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)),
        F.lit(0.0),
        lambda total, x: total + x,
    )
    return vectors.select(
        "doc_id", "chunk_index", F.round(weighted, 4).alias("weighted_sum"), "error_code"
    )


def embed_unavailable(spark, sf_dir) -> DataFrame:
    """Passages refused because the model fails on texts of a length divisible by seven."""

    def model(texts):
        if any(len(text) % 7 == 0 for text in texts):
            raise ConnectionError("no model")
        return hashing_model(texts)

    vectors = embed_with(frames.chunks(spark, sf_dir), model, width=WIDTH, batch_size=1)
    return check_embeddings(vectors, WIDTH).select("doc_id", "chunk_index", "error_code")


def embedding_audit(spark, sf_dir) -> DataFrame:
    """Defects per label, the vectors of three labels being cut short beforehand."""
    table = read_table(spark, sf_dir, "embeddings")
    cut = F.when(F.col("label") < 3, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    checked = check_embeddings(table.withColumn("embedding", cut), WIDTH)
    return checked.groupBy("label").agg(
        F.count("*").alias("vectors"), F.count("error_code").alias("wrong_dimensions")
    )


def pair_vectors_query(spark, sf_dir) -> DataFrame:
    """Documents paired by id with the given vectors, and those no vector came for."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding"
    )
    paired = pair_vectors(documents, vectors, ["doc_id"]).select(
        "doc_id", F.length("text").alias("characters"), F.size("embedding").alias("width"),
        F.lit(None).cast("string").alias("error_code"),
    )
    missing = chunks_without_vectors(documents, vectors, ["doc_id"]).select(
        "doc_id", F.lit(None).cast("int").alias("characters"), F.lit(None).cast("int").alias("width"),
        "error_code",
    )
    return paired.unionByName(missing)


# Store reports


def ingest_summary_query(spark, sf_dir) -> DataFrame:
    prepared = prepare(frames.revised_corpus(spark, sf_dir), frames.INGEST)
    return ingest_summary(prepared.documents, frames.store(spark, sf_dir), prepared.chunks)


def replaced_rows_query(spark, sf_dir) -> DataFrame:
    incoming = frames.arriving(frames.revised_corpus(spark, sf_dir))
    replaced = replaced_rows(frames.store(spark, sf_dir), incoming)
    return replaced.groupBy("category").agg(F.count("*").alias("replaced"))


def store_audit_query(spark, sf_dir) -> DataFrame:
    return store_audit(frames.store(spark, sf_dir))


# Similarity


def cosine_pairs(spark, sf_dir) -> DataFrame:
    """Each vector against the next one by id."""
    table = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = table.select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next_embedding")
    )
    distance = cosine_distance(F.col("embedding"), F.col("next_embedding"))
    return table.join(following, "vec_id").select(
        "vec_id",
        F.round(distance, 6).alias("distance"),
        F.round(similarity(distance), 6).alias("similarity"),
    )


def topk_exact(spark, sf_dir) -> DataFrame:
    found = top_k(frames.vector_store(spark, sf_dir), frames.vector_questions(spark, sf_dir))
    return found.select(*HIT_VIEW)


def _filtered_questions(spark, sf_dir) -> DataFrame:
    return frames.vector_questions(
        spark,
        sf_dir,
        top_k=(F.col("vec_id") % 50 + 1).cast("int"),
        category=F.when(F.col("vec_id") % 3 != 0, F.col("label").cast("string")),
    )


def topk_by_category(spark, sf_dir) -> DataFrame:
    store = frames.vector_store(spark, sf_dir)
    return top_k(store, _filtered_questions(spark, sf_dir)).select(*HIT_VIEW)


def topk_grid(spark, sf_dir) -> DataFrame:
    """The same questions dealt into several passes, about a third of them in each."""
    store, asked = frames.vector_store(spark, sf_dir), _filtered_questions(spark, sf_dir)
    found = top_k(store, asked, pass_questions=max(1, asked.count() // 3))
    return found.select(*HIT_VIEW)


def topk_codes(spark, sf_dir) -> DataFrame:
    """The same questions by way of one-byte codes, candidates ranked by their vectors."""
    store, asked = frames.vector_store(spark, sf_dir), _filtered_questions(spark, sf_dir)
    return certified_top_k(store, staged(code_rows(store), "codes"), asked).select(*HIT_VIEW)


def topk_bounded_cells(spark, sf_dir) -> DataFrame:
    """The same questions over cells, each question's visit ended by the cells' bounds."""
    store, asked = frames.vector_store(spark, sf_dir), _filtered_questions(spark, sf_dir)
    centroids, path = train_centroids(store, 16), work_path(spark, "cells")
    celled = assign_cells(store, centroids)
    write_cells(celled, path)
    stored = read_cells(spark, path, celled.schema)
    found = bounded_top_k(stored, asked, centroids, staged(cell_bounds(stored, centroids), "bounds"))
    return found.select(*HIT_VIEW)


def topk_single_query(spark, sf_dir) -> DataFrame:
    """One question, the first vector, against its own category."""
    store = frames.vector_store(spark, sf_dir).withColumn("chunk_text", F.lit(None).cast("string"))
    first = store.orderBy("record_id").first()
    found = top_k_single(store, first["embedding"], 20, f" {first['category']} ", 0.01)
    return found.select("record_id", "category", "chunk_text", "similarity")


def topk_with_floor(spark, sf_dir) -> DataFrame:
    asked = frames.vector_questions(spark, sf_dir, top_k=F.lit(50), min_similarity=F.lit(0.35))
    return top_k(frames.vector_store(spark, sf_dir), asked).select(*HIT_VIEW)


def _approximate(spark, sf_dir, breadth) -> DataFrame:
    store = frames.vector_store(spark, sf_dir)
    centroids = train_centroids(store, 16)
    asked = _filtered_questions(spark, sf_dir)
    path = work_path(spark, "cells")
    celled = assign_cells(store, centroids)
    write_cells(celled, path)
    stored, population = read_cells(spark, path, celled.schema), read_population(spark, path)
    found = approx_top_k(stored, asked, centroids, breadth, population=population)
    return found.select(*HIT_VIEW)


def topk_approx(spark, sf_dir) -> DataFrame:
    """Seven tenths of the store as breadth, for a recall of over 0.9 at all sizes."""
    return _approximate(spark, sf_dir, -(-7 * frames.vector_store(spark, sf_dir).count() // 10))


def topk_approx_every_cell(spark, sf_dir) -> DataFrame:
    """With every cell visited the result is that of topk_by_category."""
    return _approximate(spark, sf_dir, 2**31 - 1)


# Questions to answers


def batch_retrieval(spark, sf_dir) -> DataFrame:
    return retrieve(
        frames.store(spark, sf_dir), frames.searches(spark, sf_dir), SEARCH
    ).hits


def retrieval_on_disk(spark, sf_dir) -> DataFrame:
    """The same hits from a store that was saved, saved again and read back."""
    store = frames.saved_store(spark, sf_dir)
    return retrieve(store, frames.searches(spark, sf_dir), SEARCH).hits


def retrieval_every_cell(spark, sf_dir) -> DataFrame:
    """The same hits from the cells of a saved store, every cell visited."""
    store, path = frames.saved_store(spark, sf_dir), work_path(spark, "cells")
    centroids = train_centroids(store, 8)
    celled = assign_cells(store, centroids)
    write_cells(celled, path)
    settings = SEARCH._replace(
        centroids=centroids, breadth=2**31 - 1, population=read_population(spark, path)
    )
    stored = read_cells(spark, path, celled.schema)
    return retrieve(stored, frames.searches(spark, sf_dir), settings).hits


def retrieval_in_categories(spark, sf_dir) -> DataFrame:
    """Those of the questions that name a category, from its buckets of a saved store."""
    store, asked = frames.saved_store(spark, sf_dir), frames.searches(spark, sf_dir)
    named = asked.where("trim(category) <> ''")
    return retrieve(store, named, SEARCH._replace(layout=LAYOUT)).hits


def retrieval_codes(spark, sf_dir) -> DataFrame:
    """The same hits from a saved store by way of its code table."""
    store = frames.saved_store(spark, sf_dir)
    codes = staged(code_rows(store, (*HIT_KEYS, "bucket")), "codes")
    return retrieve(store, frames.searches(spark, sf_dir), SEARCH._replace(codes=codes)).hits


def retrieval_bounded_cells(spark, sf_dir) -> DataFrame:
    """The same hits from the cells of a saved store, visits ended by the cells' bounds."""
    store, path = frames.saved_store(spark, sf_dir), work_path(spark, "cells")
    centroids = train_centroids(store, 8)
    celled = assign_cells(store, centroids)
    write_cells(celled, path)
    stored = read_cells(spark, path, celled.schema)
    bounds = staged(cell_bounds(stored, centroids), "bounds")
    settings = SEARCH._replace(centroids=centroids, bounds=bounds)
    return retrieve(stored, frames.searches(spark, sf_dir), settings).hits


def _gathered(spark, sf_dir) -> DataFrame:
    found = retrieve(frames.store(spark, sf_dir), frames.searches(spark, sf_dir), SEARCH)
    return with_hits(found.questions, found.hits)


def context_budget(spark, sf_dir) -> DataFrame:
    """A budget of 2000 characters, so that passages are skipped."""
    chosen = select_context(_gathered(spark, sf_dir), 2000)
    return chosen.select("query_id", F.explode("context").alias("c")).select("query_id", "c.*")


def search_usage_query(spark, sf_dir) -> DataFrame:
    return search_usage(select_context(_gathered(spark, sf_dir), 2000))


def prompt_assembly(spark, sf_dir) -> DataFrame:
    prompted = build_prompts(select_context(_gathered(spark, sf_dir), 2000))
    return prompted.select(
        "query_id", "prompt", _joined_map("labels").alias("record_ids")
    )


def _joined_map(column: str) -> Column:
    return F.concat_ws(",", F.map_values(column).cast("array<string>"))


def generate_extractive_query(spark, sf_dir) -> DataFrame:
    prompted = build_prompts(select_context(_gathered(spark, sf_dir), 2000))
    return generate_extractive(prompted, SEARCH.refuse_below).select(
        "query_id", "raw_answer", "finish_reason"
    )


def prompt_model(instructions, prompts, max_output_tokens):
    """A stand-in for a user's chat model: cites every label, reports sizes as token counts."""
    for prompt in prompts:
        labels = re.findall(r"^\[(S\d+)\]$", prompt, re.M)
        yield f"Seen [{', '.join(labels)}].", "stop", len(prompt), len(labels)


def generate_answers(spark, sf_dir) -> DataFrame:
    prompted = build_prompts(select_context(_gathered(spark, sf_dir), 2000))
    model = lambda *call: list(prompt_model(*call))
    return generate_with(prompted, model).select(
        "query_id", "raw_answer", "finish_reason", "input_tokens", "output_tokens"
    )


def generate_unavailable(spark, sf_dir) -> DataFrame:
    """Answers of a model that fails on prompts of a length divisible by three."""

    def model(instructions, prompts, max_output_tokens):
        if any(len(prompt) % 3 == 0 for prompt in prompts):
            raise ConnectionError("no model")
        return list(prompt_model(instructions, prompts, max_output_tokens))

    prompted = build_prompts(select_context(_gathered(spark, sf_dir), 2000))
    generated = generate_with(prompted.where(has_evidence()), model, batch_size=1)
    return normalize_answers(generated).select("query_id", "answer", "error_code")


def no_hit_short_circuit(spark, sf_dir) -> DataFrame:
    gathered = _gathered(spark, sf_dir).withColumns(
        {"answer": F.lit("pending"), "answered": F.lit(None).cast("boolean")}
    )
    return answer_without_evidence(gathered).select(
        "query_id", "answer", "answered", has_evidence().alias("reaches_generator")
    )


def answer_normalize(spark, sf_dir) -> DataFrame:
    return normalize_answers(frames.responses(spark, sf_dir)).select(
        "conv_id", "turn", "answer", "answered", "error_code"
    )


def _cited(spark, sf_dir) -> DataFrame:
    return extract_citations(normalize_answers(frames.responses(spark, sf_dir)))


def citations(spark, sf_dir) -> DataFrame:
    return _cited(spark, sf_dir).select(
        "conv_id", "turn", _joined("cited_record_ids").alias("cited_record_ids")
    )


def grounding_report_query(spark, sf_dir) -> DataFrame:
    return grounding_report(_cited(spark, sf_dir))


def grounded_answers(spark, sf_dir) -> DataFrame:
    """The flagship: the corpus becomes a store, every request an answer with its evidence."""
    answers = answer_questions(
        frames.store(spark, sf_dir), frames.searches(spark, sf_dir), SEARCH
    ).answers
    return answers.select(
        "query_id", "query", "answer", "answered",
        _joined("cited_record_ids").alias("cited_record_ids"),
        "retrieved_chunks", "chunks_used_as_context", "top_similarity", "finish_reason",
    )


def answers_on_disk(spark, sf_dir) -> DataFrame:
    """All user turns and benchmark passages, answered from a saved store."""
    store = frames.saved_store(spark, sf_dir)
    return public_answers(answer_questions(store, frames.questions(spark, sf_dir), SEARCH).answers)


def public_answer_rows(spark, sf_dir) -> DataFrame:
    """All user turns and benchmark passages, answered from the corpus, in the caller's form."""
    answers = answer_questions(
        frames.store(spark, sf_dir), frames.questions(spark, sf_dir), SEARCH
    ).answers
    return public_answers(answers)


QUERIES = {
    "document_sizes": document_sizes,
    "document_read": document_read,
    "chunk_store_scan": chunk_store_scan,
    "chunk_store_category": chunk_store_category,
    "chunk_store_append": chunk_store_append,
    "replace_and_insert": replace_and_insert,
    "replace_and_insert_on_disk": replace_and_insert_on_disk,
    "incremental_ingest": incremental_ingest,
    "file_name_admission": file_name_admission,
    "document_admission": document_admission,
    "search_request_admission": search_request_admission,
    "category_assign": category_assign,
    "rejects_by_code": rejects_by_code_report,
    "chunk_documents": chunk_documents_query,
    "chunk_fixed_width": chunk_fixed_width_query,
    "chunk_budget_audit": chunk_budget_audit,
    "embed_hashed": embed_hashed_query,
    "embed_chunks": embed_chunks,
    "embed_unavailable": embed_unavailable,
    "embedding_audit": embedding_audit,
    "pair_vectors": pair_vectors_query,
    "ingest_summary": ingest_summary_query,
    "replaced_rows": replaced_rows_query,
    "store_audit": store_audit_query,
    "cosine_pairs": cosine_pairs,
    "topk_exact": topk_exact,
    "topk_by_category": topk_by_category,
    "topk_grid": topk_grid,
    "topk_single": topk_single_query,
    "topk_codes": topk_codes,
    "topk_bounded_cells": topk_bounded_cells,
    "retrieval_codes": retrieval_codes,
    "retrieval_in_categories": retrieval_in_categories,
    "retrieval_bounded_cells": retrieval_bounded_cells,
    "topk_with_floor": topk_with_floor,
    "topk_approx": topk_approx,
    "topk_approx_every_cell": topk_approx_every_cell,
    "batch_retrieval": batch_retrieval,
    "retrieval_on_disk": retrieval_on_disk,
    "retrieval_every_cell": retrieval_every_cell,
    "context_budget": context_budget,
    "search_usage": search_usage_query,
    "prompt_assembly": prompt_assembly,
    "generate_extractive": generate_extractive_query,
    "generate_answers": generate_answers,
    "generate_unavailable": generate_unavailable,
    "no_hit_short_circuit": no_hit_short_circuit,
    "answer_normalize": answer_normalize,
    "citations": citations,
    "grounding_report": grounding_report_query,
    "grounded_answers": grounded_answers,
    "public_answers": public_answer_rows,
    "answers_on_disk": answers_on_disk,
}
