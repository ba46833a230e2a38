"""Admission rules: every row gets an error code or none, and no bad row aborts a job."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions.text import (
    allowed_extension,
    blank_to_null,
    file_stem,
    first_failure,
    is_blank,
    strip,
)
from groundwell.schemas import (
    ALLOWED_EXTENSIONS,
    DEFAULT_MIN_SIMILARITY,
    DEFAULT_TOP_K,
    ERROR_CLASSES,
    MAX_FILE_BYTES,
    MAX_QUERY_CHARS,
    MAX_TOP_K,
)


def split_admitted(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows without the code column, rejected rows with it)."""
    accepted = checked.where(F.col("error_code").isNull()).drop("error_code")
    return accepted, checked.where(F.col("error_code").isNotNull())


def rejects_of(rejected: DataFrame, stage: str, key: str) -> DataFrame:
    """Rejected rows in the common reject-table form."""
    return rejected.select(
        F.lit(stage).alias("stage"),
        F.col(key).cast("string").alias("row_key"),
        F.col("error_code"),
    )


def file_name_rules(name: Column, allowed=ALLOWED_EXTENSIONS) -> list[tuple[str, Column]]:
    """Separators and the drive colon never pass, whatever the platform."""
    return [
        ("file_name.missing", is_blank(name)),
        ("file_name.not_a_bare_name", name.rlike(r"[/\\:]")),
        ("file_name.invalid_characters", name.rlike(r'[\x00-\x1f"<>|*?]')),
        ("file_name.not_a_bare_name", name.isin(".", "..")),
        ("file_name.stem_missing", file_stem(name) == ""),
        ("file_name.extension_not_allowed", ~allowed_extension(name, allowed)),
    ]


def check_file_names(
    manifest: DataFrame, name: str = "file_name", allowed=ALLOWED_EXTENSIONS
) -> DataFrame:
    """FLT-1: adds `error_code` to a manifest of file names; names are never trimmed."""
    return manifest.withColumn("error_code", first_failure(*file_name_rules(F.col(name), allowed)))


def check_documents(
    documents: DataFrame, text: str = "text", size: Column = None, max_bytes: int = MAX_FILE_BYTES
) -> DataFrame:
    """FLT-3 and FLT-4: size cap, then empty text. `size` is the byte count where one is known."""
    body = F.col(text)
    size = F.octet_length(body) if size is None else size
    return documents.withColumn(
        "error_code",
        first_failure(("document.too_large", size > max_bytes), ("document.empty", is_blank(body))),
    )


def assign_category(
    documents: DataFrame, category: str = "category", file_name: str = "file_name"
) -> DataFrame:
    """PRJ-1: the given category trimmed, or the file name without its last extension."""
    given = blank_to_null(F.col(category).cast("string"))
    resolved = F.coalesce(given, file_stem(F.col(file_name)))
    return documents.withColumn(category, resolved).withColumn(
        "error_code", F.when(F.coalesce(F.col(category), F.lit("")) == "", "category.missing")
    )


def check_requests(
    requests: DataFrame,
    max_query_chars: int = MAX_QUERY_CHARS,
    default_top_k: int = DEFAULT_TOP_K,
    max_top_k: int = MAX_TOP_K,
) -> DataFrame:
    """FLT-7: validates (query, top_k, category, min_similarity) and fills in the defaults."""
    floor = F.col("min_similarity")
    code = first_failure(
        ("query.missing", is_blank(F.col("query"))),
        ("query.too_long", F.length(strip(F.col("query"))) > max_query_chars),
        ("top_k.out_of_range", ~F.col("top_k").between(1, max_top_k)),
        ("min_similarity.out_of_range", F.isnan(floor) | (floor < 0) | (floor > 1)),
    )
    return requests.withColumn("error_code", code).withColumns(
        {
            "query": strip(F.col("query")),
            "top_k": F.coalesce(F.col("top_k"), F.lit(default_top_k)).cast("int"),
            "category": blank_to_null(F.col("category")),
            "min_similarity": F.coalesce(floor, F.lit(DEFAULT_MIN_SIMILARITY)).cast("double"),
        }
    )


def rejects_by_code(rejects: DataFrame) -> DataFrame:
    """AGG-5: reject counts by class and code; the code table is a constant map, not a join."""
    classes = F.create_map(
        *(F.lit(x) for name, codes in ERROR_CLASSES.items() for code in codes for x in (code, name))
    )
    return rejects.groupBy("error_code").agg(F.count("*").alias("n")).select(
        F.coalesce(F.try_element_at(classes, F.col("error_code")), F.lit("upstream")).alias(
            "error_class"
        ),
        "error_code",
        "n",
    )
