"""Table schemas, service limits and reject codes."""

from pyspark.sql import types as T

# Request limits and defaults of the service.
DEFAULT_TOP_K = 5
MAX_TOP_K = 50
DEFAULT_MIN_SIMILARITY = 0.0
MAX_QUERY_CHARS = 2000
MAX_CHUNK_CHARS = 1000
OVERLAP_CHARS = 150
MAX_FILE_BYTES = 5 * 1024 * 1024
MAX_CONTEXT_CHARS = 12000
MAX_OUTPUT_TOKENS = 800
EMBEDDING_WIDTH = 1536
EMBED_BATCH_SIZE = 64
GENERATE_BATCH_SIZE = 16
SEARCH_BREADTH = 40
ALLOWED_EXTENSIONS = (".txt", ".md")

# Reject codes by class.
ERROR_CLASSES = {
    "validation": (
        "file_name.missing",
        "file_name.not_a_bare_name",
        "file_name.invalid_characters",
        "file_name.stem_missing",
        "file_name.extension_not_allowed",
        "document.too_large",
        "document.outside_root",
        "document.empty",
        "category.missing",
        "query.missing",
        "query.too_long",
        "top_k.out_of_range",
        "min_similarity.out_of_range",
    ),
    "not_found": ("document.not_found",),
    "upstream": (
        "document.read_failed",
        "chunking.limit_exceeded",
        "document.no_chunks_produced",
        "embedding.count_mismatch",
        "embedding.batch_count_mismatch",
        "embedding.wrong_dimensions",
        "answer.no_context",
        "answer.empty_response",
    ),
}

VECTOR = T.ArrayType(T.FloatType(), containsNull=False)

# The passage store. `bucket` is the directory column, see sources/store.py.
STORE = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("category", T.StringType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("chunk_text", T.StringType()),
        T.StructField("text_key", T.StringType()),
        T.StructField("embedding", VECTOR),
        T.StructField("norm", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)

# Its files, with the number of the save that wrote a row; the keys that saves retire; the saves that count.
STORE_FILES = T.StructType([*STORE.fields[:-1], T.StructField("save", T.LongType()), STORE.fields[-1]])

RETIRED = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("text_key", T.StringType()),
        T.StructField("save", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)

COMMITS = T.StructType(
    [
        T.StructField("save", T.LongType()),
        T.StructField("inserted", T.LongType()),
        T.StructField("replaced", T.LongType()),
        T.StructField("buckets", T.ArrayType(T.IntegerType())),
    ]
)

REJECTS = T.StructType(
    [
        T.StructField("stage", T.StringType()),
        T.StructField("row_key", T.StringType()),
        T.StructField("error_code", T.StringType()),
    ]
)
