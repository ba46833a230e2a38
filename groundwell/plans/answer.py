"""PIP-2 and PIP-3: from a table of questions to hits and to grounded answers."""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.operators.admission import check_requests, split_admitted
from groundwell.operators.answers import (
    extract_citations,
    generate_extractive,
    generate_with,
    normalize_answers,
)
from groundwell.operators.cell_bounds import bounded_top_k
from groundwell.operators.cells import approx_top_k
from groundwell.operators.codes import certified_top_k
from groundwell.operators.context import (
    answer_without_evidence,
    build_prompts,
    has_evidence,
    select_context,
    with_hits,
)
from groundwell.operators.embedding import check_embeddings, embed_hashed, embed_with
from groundwell.operators.similarity import attach_passages, top_k
from groundwell.schemas import (
    EMBED_BATCH_SIZE,
    MAX_CONTEXT_CHARS,
    MAX_OUTPUT_TOKENS,
    SEARCH_BREADTH,
)
from groundwell.session import staged
from groundwell.sources.store import Layout

HIT_KEYS = ("record_id", "doc_id", "chunk_index")


class SearchSettings(NamedTuple):
    """The embedder must be the one the store was built with.

    With `centroids` the search is approximate over the store's `cell` column, and with their cell_bounds as
    `bounds` exact. With `codes`, the store's
    code_rows by the keys of a hit, it is exact by way of these. With the store's `layout`, questions that all name a category
    read its buckets only. `generator` None is the built-in extractive
    one.
    """

    embedder: Callable | None = None
    width: int = 64
    batch_size: int = EMBED_BATCH_SIZE
    centroids: DataFrame | None = None
    breadth: int = SEARCH_BREADTH
    population: DataFrame | None = None
    bounds: DataFrame | None = None
    codes: DataFrame | None = None
    layout: Layout | None = None
    scan_tasks: int | None = None
    max_context_chars: int = MAX_CONTEXT_CHARS
    generator: Callable | None = None
    max_output_tokens: int = MAX_OUTPUT_TOKENS
    refuse_below: float = 0.2


class Retrieved(NamedTuple):
    questions: DataFrame  # accepted requests, trimmed and with defaults
    hits: DataFrame  # query_id, rank, record_id, category, chunk_text, similarity
    rejects: DataFrame


class Answered(NamedTuple):
    answers: DataFrame  # every accepted question; see answer_questions
    rejects: DataFrame  # query_id, error_code


def embed_questions(questions: DataFrame, settings: SearchSettings) -> DataFrame:
    """Adds `vector` and `error_code` with the model the store was embedded with."""
    if settings.embedder is None:
        vectors = embed_hashed(questions, "query", settings.width)
    else:
        vectors = embed_with(
            questions, settings.embedder, "query", settings.width, settings.batch_size
        )
    return check_embeddings(vectors, settings.width).withColumnRenamed("embedding", "vector")


def retrieve(
    store: DataFrame, requests: DataFrame, settings: SearchSettings = SearchSettings()
) -> Retrieved:
    """PIP-2: admits (query_id, query, top_k, category, min_similarity) rows and finds their hits.

    Question vectors and ranked hits are staged: the model runs once per question, the search once.
    Hits carry their bucket, so the texts are looked up in the buckets of the hits only.
    With centroids, `settings.population` spares the count of the store's cells.
    """
    keys = HIT_KEYS + (("bucket",) if "bucket" in store.columns else ())
    buckets = settings.layout.buckets_of if settings.layout is not None else None
    accepted, refused = split_admitted(check_requests(requests))
    embedded = staged(embed_questions(accepted, settings), "questions")
    asked, unusable = split_admitted(embedded)
    if settings.codes is not None:
        hits = certified_top_k(
            store, settings.codes, asked, keys, settings.scan_tasks, buckets=buckets
        )
    elif settings.centroids is None:
        hits = top_k(store, asked, keys, settings.scan_tasks, buckets=buckets)
    elif settings.bounds is not None:
        hits = bounded_top_k(
            store, asked, settings.centroids, settings.bounds, keys, settings.scan_tasks
        )
    else:
        hits = approx_top_k(
            store,
            asked,
            settings.centroids,
            settings.breadth,
            keys,
            settings.scan_tasks,
            settings.population,
        )
    hits = staged(hits, "hits")
    rejects = refused.select("query_id", "error_code").unionByName(
        unusable.select("query_id", "error_code")
    )
    return Retrieved(asked.drop("vector"), attach_passages(hits, store, keys), rejects)


def answer_questions(
    store: DataFrame, requests: DataFrame, settings: SearchSettings = SearchSettings()
) -> Answered:
    """PIP-3: query_id, query, answer, answered, cited_record_ids, usage columns, finish_reason.

    Questions without hits get the fixed answer and never reach the generator.
    """
    found = retrieve(store, requests, settings)
    gathered = with_hits(found.questions, found.hits)
    prompted = build_prompts(select_context(gathered, settings.max_context_chars))
    if settings.generator is None:
        generated = generate_extractive(prompted, settings.refuse_below)
    else:
        generated = generate_with(
            prompted, settings.generator, max_output_tokens=settings.max_output_tokens
        )
        generated = staged(generated, "answers")
    normal = normalize_answers(generated).withColumn(
        "error_code", F.when(has_evidence(), F.col("error_code"))
    )
    spoken, empty = split_admitted(normal)
    answers = extract_citations(answer_without_evidence(spoken)).select(
        "query_id",
        "query",
        "answer",
        "answered",
        "cited_record_ids",
        F.size("hits").alias("retrieved_chunks"),
        F.size("context").alias("chunks_used_as_context"),
        F.try_element_at("hits", F.lit(1))["similarity"].alias("top_similarity"),
        F.col("context.record_id").alias("context_record_ids"),
        "finish_reason",
        "input_tokens",
        "output_tokens",
    )
    rejects = found.rejects.unionByName(empty.select("query_id", "error_code"))
    return Answered(answers, rejects)
