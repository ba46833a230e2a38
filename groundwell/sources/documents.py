"""Documents from a folder or a table."""

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.functions.text import allowed_extension, first_failure
from groundwell.operators.admission import check_file_names, rejects_of, split_admitted
from groundwell.schemas import ALLOWED_EXTENSIONS, MAX_FILE_BYTES
from groundwell.session import broadcast_if_small, staged


# Partitions of a folder's scan that one task takes, about 32 small files each, and tasks of each core that a folder keeps.
JOINED_PARTITIONS = 64
FOLDER_TASKS_PER_CORE = 16


def _plain(path: Column) -> Column:
    """scheme:///a and scheme:/a in one form."""
    return F.regexp_replace(path, "^([a-zA-Z0-9]+):/+", "$1:/")


def root_uri(root: str) -> str:
    """The root folder as files report it, without a trailing slash."""
    uri = root if re.match("^[a-zA-Z0-9]+:/", root) else "file:" + os.path.abspath(root)
    return re.sub("^([a-zA-Z0-9]+):/+", r"\1:/", uri).rstrip("/")


def in_root(path: Column, root: str) -> Column:
    """FLT-2: the path lies under the root folder, not in one whose name only starts alike."""
    return F.startswith(_plain(path), F.lit(root_uri(root) + "/"))


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def folder(spark: SparkSession, root: str, **options) -> DataFrame:
    """Top-level files with name, size and time; the bytes are read only where selected."""
    files = joined_partitions(spark.read.format("binaryFile").options(**options).load(root))
    return files.select(
        name_of(F.col("path")).alias("file_name"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("last_modified"),
        "path",
        "content",
    )


def joined_partitions(files: DataFrame) -> DataFrame:
    """The scan of a folder of very many files in fewer tasks: Spark counts a file as four megabytes at least and would make one
    task of every 32."""
    least = FOLDER_TASKS_PER_CORE * files.sparkSession.sparkContext.defaultParallelism
    found = files.rdd.getNumPartitions()
    return files.coalesce(max(least, -(-found // JOINED_PARTITIONS))) if found > least else files


def list_documents(spark: SparkSession, root: str, allowed=ALLOWED_EXTENSIONS) -> DataFrame:
    """SRC-1, TOP-4: (file_name, size_bytes, last_modified), by name without regard to case.

    Zero-byte files and names starting with '.' or '_' never appear (Spark's file listing).
    """
    return (
        folder(spark, root)
        .where(allowed_extension(F.col("file_name"), allowed))
        .select("file_name", "size_bytes", "last_modified")
        .orderBy(F.lower("file_name"), "file_name")
    )


def listing_count(listing: DataFrame) -> DataFrame:
    """AGG-6."""
    return listing.agg(F.count("*").alias("count"))


def as_text(content: Column) -> Column:
    """UTF-8 bytes as text: bad sequences become U+FFFD, a byte-order mark is dropped."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"^\x{FEFF}", "")


def document_id(file_name: Column) -> Column:
    return F.conv(F.substring(F.md5(file_name), 1, 15), 16, 10).cast("bigint")


def with_text(files: DataFrame, *carry: str) -> DataFrame:
    return files.select(
        document_id(F.col("file_name")).alias("doc_id"),
        "file_name",
        *carry,
        as_text(F.col("content")).alias("text"),
    )


def read_documents(
    spark: SparkSession,
    root: str,
    requests: DataFrame | None = None,
    allowed=ALLOWED_EXTENSIONS,
    max_bytes: int = MAX_FILE_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """SRC-2: (documents, rejects) for requested (file_name, category) rows, or the whole folder.

    Sizes are checked on the listing, so the bytes of oversize files are never read. The folder is listed once, and the listing
    and the texts are staged as tables, once; a file that was listed but could not be read is missing among the texts, becomes
    a reject and does not stop the job.
    """
    files = folder(spark, root, ignoreCorruptFiles="true", ignoreMissingFiles="true")
    listed = staged(files.drop("content"), "listing")
    if requests is not None:
        wanted = requests.dropDuplicates(["file_name", "category"])
    else:
        wanted = listed.where(allowed_extension(F.col("file_name"), allowed)).select(
            "file_name", F.lit(None).cast("string").alias("category")
        )
    named, bad_names = split_admitted(check_file_names(wanted, allowed=allowed))
    found = named.join(listed, "file_name", "left").withColumn(
        "error_code",
        first_failure(
            ("document.not_found", F.col("path").isNull()),
            ("document.outside_root", ~in_root(F.col("path"), root)),
            ("document.too_large", F.col("size_bytes") > max_bytes),
        ),
    )
    admitted, refused = split_admitted(found)
    contents = files.where(
        (F.col("size_bytes") <= max_bytes) & in_root(F.col("path"), root)
    )
    contents, _ = split_admitted(check_file_names(contents, allowed=allowed))
    if requests is None:
        documents = contents.withColumn("category", F.lit(None).cast("string"))
    else:
        documents = contents.join(
            broadcast_if_small(admitted.select("file_name", "category")), "file_name"
        )
    documents = staged(with_text(documents, "category", "size_bytes"), "documents")
    unread = (
        admitted.select("file_name")
        .join(documents.select("file_name"), "file_name", "left_anti")
        .withColumn("error_code", F.lit("document.read_failed"))
    )
    rejects = [rejects_of(r, "read", "file_name") for r in (bad_names, refused, unread)]
    return documents, rejects[0].unionByName(rejects[1]).unionByName(rejects[2])


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """SRC-3: a corpus table."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(table: DataFrame, key: str) -> DataFrame:
    """Deals a small table out to all cores in front of costly per-row work.

    A table that already has a partition per core, as any large one does, is left as it is.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, key) if table.rdd.getNumPartitions() < cores else table
