"""The passage store: a Parquet table laid out in buckets.

The directory column is `bucket = category slot * text slots + text slot`, both slots hashes. A
category is read from a few neighbouring buckets, while even a category that holds a third of the
store is spread over many of them; rows that may replace each other always share a bucket. Files
are rebalanced by size on the way in, so a hot bucket becomes several files and a small one stays
a single file, and rows are sorted by category for Parquet's own statistics.

Saves are merged on read and rewrite no file. A save appends its rows under its number to the store, the keys of the rows
it replaces to `<path>-retired`, and at last one row to `<path>-commits`. A reader takes the rows of committed saves
that no later committed save has retired. A save that breaks off is in no commit, so nobody sees any of it. `compact` writes
the live rows of buckets anew under a number below which these buckets hold nothing more; `vacuum` deletes the
files left over. One writer at a time.
"""

import secrets

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwell.functions.vectors import l2_norm
from groundwell.operators.cells import cell_population
from groundwell.schemas import COMMITS, RETIRED, STORE, STORE_FILES
from groundwell.session import BROADCAST_ROWS, broadcast_if_small, reclaim, staged

MATCH = ["category", "text_key"]
STORE_KEY = ("record_id", "doc_id", "chunk_index")
# Slices a key's requests are split into when counting replacements.
REQUEST_SLICES = 64


class Layout(NamedTuple):
    """Bucket counts; fixed for the life of a store."""

    category_slots: int = 64
    text_slots: int = 16

    def category_slot(self, category: Column) -> Column:
        return F.pmod(F.xxhash64(category), F.lit(self.category_slots)).cast("int")

    def bucket(self, category: Column, text_key: Column) -> Column:
        text_slot = F.pmod(F.xxhash64(text_key), F.lit(self.text_slots)).cast("int")
        return self.category_slot(category) * self.text_slots + text_slot

    def buckets_of(self, category: Column) -> Column:
        """The buckets that may hold rows of a category, as an array."""
        first = self.category_slot(category) * self.text_slots
        return F.sequence(first, first + (self.text_slots - 1))

    def holds(self, category: str) -> Column:
        """Condition on the buckets of one category (a partition filter)."""
        first = self.category_slot(F.lit(category)) * self.text_slots
        return F.col("bucket").between(first, first + (self.text_slots - 1))


class SaveResult(NamedTuple):
    inserted: int
    replaced: int


def record_id(category: Column, doc_id: Column, chunk_index: Column, text: Column) -> Column:
    """A 60-bit id from the content, the same on every run."""
    whole = F.concat_ws("\x1f", category, doc_id, chunk_index, text)
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("bigint")


def store_rows(chunks: DataFrame, layout: Layout = Layout(), extra=()) -> DataFrame:
    """(category, doc_id, chunk_index, chunk_text, embedding) rows in store form, plus `extra`."""
    key = record_id(*(F.col(c) for c in ("category", "doc_id", "chunk_index", "chunk_text")))
    return (
        chunks.withColumn("record_id", key)
        .withColumn("text_key", F.sha2("chunk_text", 256))
        .withColumn("norm", l2_norm(F.col("embedding")))
        .withColumn("created_at", F.current_timestamp())
        .withColumn("bucket", layout.bucket(F.col("category"), F.col("text_key")))
        .select(*STORE.names, *extra)
    )


def _table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table of the store; one that was never written reads as empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def retired_path(path: str) -> str:
    return f"{path.rstrip('/')}-retired"


def commits_path(path: str) -> str:
    return f"{path.rstrip('/')}-commits"


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """(save, inserted, replaced, buckets) per committed save or compaction; `buckets` are those a compaction renewed."""
    return _table(spark, commits_path(path), COMMITS)


def renewed_buckets(log: list) -> dict[int, int]:
    """Bucket -> the number of its last compaction; at most one entry per bucket of the layout."""
    found: dict[int, int] = {}
    for r in log:
        for bucket in r["buckets"] or []:
            found[bucket] = max(found.get(bucket, 0), r["save"])
    return found


def read_store(
    spark: SparkSession, path: str, category: str | None = None, layout: Layout = Layout()
) -> DataFrame:
    """SRC-4: the live rows with their fixed schema; a category prunes buckets and is pushed down.

    A blank category is no filter. A store that was never written reads as empty. The commits are read first,
    so that a save during the read is seen whole or not at all. Retired keys are joined by the size of their files: as
    a broadcast while they are small, and `compact` keeps them so.
    """
    log = read_commits(spark, path).collect()  # one small row a save
    retired = _table(spark, retired_path(path), RETIRED)
    rows = _table(spark, path, STORE_FILES)
    rows = rows.withColumn("save", F.coalesce("save", F.lit(0)))
    if category is not None and category.strip():
        name = category.strip()
        own = layout.holds(name) & (F.col("category") == name)
        rows, retired = rows.where(own), retired.where(own)
    return live_rows(rows, retired, log).select(*STORE.names)


def live_rows(rows: DataFrame, retired: DataFrame, log: list) -> DataFrame:
    """The rows of committed saves, without those that a later one retired or a compaction renewed. Rows appended outside a save
    have the number 0 and count as committed."""
    if not log:
        return rows.where("save = 0")
    spark = rows.sparkSession
    seen = F.broadcast(spark.createDataFrame([(0,), *((r["save"],) for r in log)], "save long"))
    live = rows.join(seen, "save", "left_semi")
    renewed = renewed_buckets(log)
    if renewed:
        since = spark.createDataFrame(list(renewed.items()), "bucket int, since long")
        live = live.join(F.broadcast(since), "bucket", "left").where("since IS NULL OR save >= since").drop("since")
    if all(not r["replaced"] for r in log):
        return live
    gone = retired.join(seen, "save", "left_semi").alias("gone")
    own = live.alias("own")
    same = [F.col(f"own.{c}") == F.col(f"gone.{c}") for c in ("bucket", *MATCH)]
    return own.join(gone, [*same, F.col("gone.save") > F.col("own.save")], "left_anti")


def next_save(log: list) -> int:
    """A number above all committed ones. Its lower half is random: the rows of a broken save never
    come to light under the number of a later one."""
    last = max((r["save"] for r in log), default=0)
    return ((last >> 31) + 1 << 31) + secrets.randbelow(1 << 31)


def _commit(spark: SparkSession, path: str, save: int, inserted: int, replaced: int, buckets=None) -> None:
    row = spark.createDataFrame([(save, inserted, replaced, buckets)], COMMITS)
    row.coalesce(1).write.mode("append").parquet(commits_path(path))


def _write(rows: DataFrame, path: str) -> None:
    (
        rows.hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "category")
        .write.mode("append")
        .option("compression", "zstd")
        .partitionBy("bucket")
        .parquet(path)
    )


def append_chunks(rows: DataFrame, path: str, save: int = 0) -> None:
    """SNK-1: appends store rows; those of a save are seen once it is committed."""
    _write(rows.withColumn("save", F.lit(save).cast("long")), path)


def keys_of(incoming: DataFrame, *more: str) -> DataFrame:
    """The distinct (category, passage) keys of a batch, for broadcast where it has few enough rows. Larger batches
    are not made distinct twice, to count them: their keys join by a shuffle, or as what Spark finds at run time."""
    keys = incoming.select(*more, *MATCH).distinct()
    return F.broadcast(keys) if incoming.count() <= BROADCAST_ROWS else keys


def last_requests(incoming: DataFrame) -> DataFrame:
    """What a batch leaves behind when its documents are saved one after another by doc_id.

    A later document replaces every copy of a passage that an earlier one of the same category
    brought; copies within one document all stay. Only keys brought by several documents are
    joined back; a batch without any is returned as it is.
    """
    contested = (
        incoming.groupBy(*MATCH)
        .agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        .where("first_doc < last_doc")
        .drop("first_doc")
    )
    contested = staged(contested, "contested")  # asked if empty, counted and joined
    if contested.isEmpty():
        return incoming
    return (
        incoming.join(broadcast_if_small(contested), MATCH, "left")
        .where("last_doc IS NULL OR doc_id = last_doc")
        .drop("last_doc")
        .select(*incoming.columns)
    )


def merged_store(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """SNK-2, JN-2, SET-1, SET-2 as a plan: stored rows that nothing replaces, plus the incoming."""
    kept = store.join(keys_of(incoming), MATCH, "left_anti").select(*store.columns)
    return kept.unionByName(last_requests(incoming))


def replaced_rows(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """JN-3: the stored rows an incoming batch replaces; every stored copy counts."""
    return store.join(keys_of(incoming), MATCH, "left_semi")


def save_counts(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """(doc_id, category, chunks_inserted, chunks_replaced), saving documents in doc_id order.

    A document replaces the copies of the document before it that brought the same passage in
    the same category, or else the stored copies. The document before is found in two steps,
    within a slice of the documents and then between slices, so a passage shared by a third of
    all documents is never sorted in one task. The slices are quantiles of the ids, so that one
    outlying id leaves them even. Only keys and counts are shuffled.
    """
    brought = incoming.groupBy(*MATCH, "doc_id").agg(F.count("*").alias("n"))
    shares = [i / REQUEST_SLICES for i in range(1, REQUEST_SLICES)]
    ends = incoming.agg(F.percentile_approx("doc_id", shares)).first()[0] or []
    bounds = F.array(*(F.lit(end) for end in sorted(set(ends)))).cast("array<bigint>")
    part = F.size(F.filter(bounds, lambda end: end < F.col("doc_id")))
    # staged: read by both sides of the join below
    brought = staged(brought.withColumn("part", part), "brought", compression="zstd")
    in_part = Window.partitionBy(*MATCH, "part").orderBy("doc_id")
    stored = replaced_rows(store, incoming).groupBy(*MATCH).agg(F.count("*").alias("n"))
    slices = (
        brought.groupBy(*MATCH, "part")
        .agg(F.max_by("n", "doc_id").alias("n"))
        .unionByName(stored.withColumn("part", F.lit(-1)))
    )
    before = F.lag("n").over(Window.partitionBy(*MATCH).orderBy("part"))
    earlier = slices.withColumn("earlier", before).drop("n")
    return (
        brought.withColumn("replaced", F.lag("n").over(in_part))
        .join(earlier, [*MATCH, "part"], "left")
        .groupBy("doc_id", "category")
        .agg(
            F.sum("n").alias("chunks_inserted"),
            F.sum(F.coalesce("replaced", "earlier", F.lit(0))).alias("chunks_replaced"),
        )
    )


def bucket_sizes(incoming: DataFrame) -> dict[int, int]:
    """Rows per bucket of a batch, at most one entry per bucket of the layout."""
    return {r["bucket"]: r["count"] for r in incoming.groupBy("bucket").count().collect()}


def replace_and_insert(
    spark: SparkSession,
    path: str,
    incoming: DataFrame,
    layout: Layout = Layout(),
    sizes: dict[int, int] | None = None,
) -> SaveResult:
    """SNK-2 on disk. `incoming` holds store rows and is read several times: pass a staged table.

    Rewrites nothing: the rows are appended, the keys of what they replace are noted, and one commit makes both
    count. Only the batch's buckets are read, and of them keys alone. Running the same batch again gives the
    same store, which is also how an interrupted run is completed. `sizes` are the bucket_sizes of
    the batch, where they are known.
    """
    sizes = bucket_sizes(incoming) if sizes is None else sizes
    if not sizes:
        return SaveResult(0, 0)
    save = next_save(read_commits(spark, path).collect())
    arriving = last_requests(incoming)
    keys = keys_of(incoming, "bucket")
    store = read_store(spark, path, layout=layout).where(F.col("bucket").isin(list(sizes)))
    replaced = store.select("bucket", *MATCH).join(keys, ["bucket", *MATCH], "left_semi")
    retired = staged(replaced.groupBy("bucket", *MATCH).agg(F.count("*").alias("n")), "retired", compression="zstd")
    dropped = retired.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total = sum(sizes.values())
    overtaken = 0 if arriving is incoming else total - arriving.count()
    if dropped:
        _write(retired.select("bucket", *MATCH, F.lit(save).cast("long").alias("save")), retired_path(path))
    append_chunks(arriving, path, save)
    _commit(spark, path, save, total, dropped + overtaken)
    return SaveResult(total, dropped + overtaken)


def dead_shares(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, stored, live): what compaction would drop, without reading more than keys. Rows that a compaction has
    renewed are not counted; they are for `vacuum`."""
    rows = _table(spark, path, STORE_FILES).withColumn("save", F.coalesce("save", F.lit(0)))
    log = [{"save": r["save"], "buckets": r["buckets"], "replaced": 0} for r in read_commits(spark, path).collect()]
    stored = live_rows(rows, rows, log).groupBy("bucket").agg(F.count("*").alias("stored"))
    live = read_store(spark, path).groupBy("bucket").agg(F.count("*").alias("live"))
    return stored.join(live, "bucket", "left").select("bucket", "stored", F.coalesce("live", F.lit(0)).alias("live"))


def compact(spark: SparkSession, path: str, dead: float = 0.2, buckets: list[int] | None = None) -> list[int]:
    """Writes the live rows of buckets anew, by default of those in which more than the share `dead` of the stored rows is
    no longer live, and returns these buckets. Readers see the same rows before, during and after; the old files stay
    until `vacuum`."""
    if buckets is None:
        shares = dead_shares(spark, path).where(F.col("live") < F.col("stored") * F.lit(1 - dead))
        buckets = [r["bucket"] for r in shares.select("bucket").collect()]  # at most one per bucket
    if not buckets:
        return []
    save = next_save(read_commits(spark, path).collect())
    append_chunks(read_store(spark, path).where(F.col("bucket").isin(buckets)), path, save)
    _commit(spark, path, save, 0, 0, sorted(buckets))
    return sorted(buckets)


def left_over_files(spark: SparkSession, path: str) -> DataFrame:
    """(file) names of store files none of whose rows can be live again: from before their bucket's compaction, or of saves
    that broke off before the last commit."""
    log = read_commits(spark, path).collect()
    last = max((r["save"] for r in log), default=0)
    since = spark.createDataFrame(list(renewed_buckets(log).items()), "bucket int, since long")
    seen = spark.createDataFrame([(0, True), *((r["save"], True) for r in log)], "save long, committed boolean")
    rows = _table(spark, path, STORE_FILES)
    if not log:
        return rows.select(F.lit("").alias("file")).limit(0)
    rows = rows.select("bucket", F.coalesce("save", F.lit(0)).alias("save"), F.col("_metadata.file_path").alias("file"))
    # a file holds rows of one save and one bucket
    files = rows.groupBy("file").agg(F.max("save").alias("save"), F.max("bucket").alias("bucket"))
    files = files.join(F.broadcast(since), "bucket", "left").join(F.broadcast(seen), "save", "left")
    broken = F.col("committed").isNull() & (F.shiftright("save", 31) <= last >> 31)
    return files.where((F.col("save") < F.col("since")) | broken).select("file")


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes the left-over files; no reader may still be at work on them. Returns their number."""
    names = [r["file"] for r in left_over_files(spark, path).collect()]
    jvm = spark.sparkContext._jvm
    for name in names:
        file = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(file, False)
    return len(names)


def store_audit(store: DataFrame) -> DataFrame:
    """AGG-2: rows against non-null vectors, per category and over all (null category row)."""
    counts = (
        store.groupBy("category")
        .agg(F.count("*").alias("row_count"), F.count("embedding").alias("vector_count"))
        .withColumn("scope", F.lit("category"))
    )
    overall = counts.agg(
        F.lit(None).cast("string").alias("category"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum("vector_count"), F.lit(0)).alias("vector_count"),
        F.lit("store").alias("scope"),
    )
    return counts.unionByName(overall).select("scope", "category", "row_count", "vector_count")


def write_cells(rows: DataFrame, path: str) -> None:
    """Writes rows that have a `cell` column as an inverted-file layout, one directory per cell.

    Large cells become several files. Rows without a cell (no usable vector) are written too, in
    Spark's default directory, and never visited by a search. The rows of each cell by category
    are counted from what was written, into a table beside it.
    """
    dealt = rows.hint("rebalance", "cell")
    dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("cell").parquet(path)
    reclaim(rows.sparkSession)
    written = read_cells(rows.sparkSession, path, rows.schema)
    cell_population(written).write.mode("overwrite").parquet(f"{path.rstrip('/')}-population")


def read_population(spark: SparkSession, path: str) -> DataFrame:
    """(cell, category, n) of the cells written to `path`."""
    return spark.read.parquet(f"{path.rstrip('/')}-population")


def read_cells(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
