"""Exact dedup by deterministic block naming.

Texts, lower-cased in A-Z, are cut into blocks of BLOCK_BYTES. The distinct blocks are sorted and get
integer names, equal names for equal bytes only; then names of adjacent blocks are paired and the
pairs named, until every document has one name. Two documents of as many blocks have the same final
name exactly when their texts are the same: names stand for whole byte strings, no hash decides.

A task sends each distinct block it holds once, so a block in a third of all documents is a row per
task and not per document. A document that holds a block or pair seen nowhere else is alone and leaves the
naming at once; later rounds carry only names of possible copies, log2 of the longest text's
blocks in number. Names are staged before they are used, so a recomputed task cannot rename.

Defined results: null text counts as empty, and empty texts are equal; of equal texts the largest
doc_id stays, null being smallest; rows repeated with the same id and text form a group of which one
row stays; an empty table gives no rows.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.arrays import LOWER, text_slices
from groundwell.session import staged

BLOCK_BYTES = 4096
HELD_BYTES = 24 << 20
NAME_BITS = 33

CUT = "uid long, doc_id long, text_sha256 string, keys array<long>, key long, uses long, block binary"
NAMED = "uid long, doc_id long, text_sha256 string, keys array<long>, key long, name long, uses long"


def cut_blocks(batches):
    """A row per document with the keys of its blocks, and a row per distinct block held with its
    key and uses; blocks are sent whenever HELD_BYTES of them have gathered."""
    from pyspark import TaskContext

    number = row = TaskContext.get().partitionId() << NAME_BITS
    held: dict[bytes, int] = {}
    uses: dict[int, int] = {}
    size = 0

    def frame(docs, blocks):
        uid, doc_id, sha, keys = (list(c) for c in zip(*docs)) if docs else ([], [], [], [])
        m, n = len(docs), len(blocks)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(uid + [None] * n, pa.int64()),
                pa.array(doc_id + [None] * n, pa.int64()),
                pa.array(sha + [None] * n, pa.string()),
                pa.array(keys + [None] * n, pa.list_(pa.int64())),
                pa.array([None] * m + list(blocks.values()), pa.int64()),
                pa.array([None] * m + [uses[k] for k in blocks.values()], pa.int64()),
                # a document row needs some bytes to be dealt out by
                pa.array([b"\0" + u.to_bytes(8, "little") for u in uid] + [b"\1" + b for b in blocks], pa.binary()),
            ],
            ["uid", "doc_id", "text_sha256", "keys", "key", "uses", "block"],
        )

    for batch in batches:
        for i, j, buffer, starts in text_slices(batch, "text"):
            low = LOWER[buffer].tobytes()
            docs = []
            for k, doc_id in enumerate(batch.column(0).slice(i, j - i).to_pylist()):
                text = low[starts[k] : starts[k + 1] - 1]
                keys = []
                for at in range(0, max(1, len(text)), BLOCK_BYTES):
                    block = text[at : at + BLOCK_BYTES]
                    key = held.get(block)
                    if key is None:
                        key = held[block] = number
                        uses[key] = 0
                        number += 1
                        size += len(block) + 100
                    uses[key] += 1
                    keys.append(key)
                docs.append((row, doc_id, hashlib.sha256(text).hexdigest(), keys))
                row += 1
            if size > HELD_BYTES:
                yield frame(docs, held)
                held, uses, size = {}, {}, 0
            else:
                yield frame(docs, {})
    yield frame([], held)


def name_blocks(batches):
    """Names for blocks that arrive sorted, with the uses of each block from all tasks."""
    from pyspark import TaskContext

    name = TaskContext.get().partitionId() << NAME_BITS
    last, run, total = None, [], 0

    def frame(docs, keys, names, counts):
        n, m = len(keys), docs.num_rows
        columns = [pa.concat_arrays([docs.column(c).combine_chunks() if isinstance(docs.column(c), pa.ChunkedArray) else docs.column(c), pa.nulls(n, docs.schema.field(c).type)]) for c in ("uid", "doc_id", "text_sha256", "keys")]
        columns += [pa.array([None] * m + c, pa.int64()) for c in (keys, names, counts)]
        return pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "text_sha256", "keys", "key", "name", "uses"])

    for batch in batches:
        docs = batch.filter(batch.column("uid").is_valid())
        keys, names, counts = [], [], []
        blocks = batch.filter(batch.column("key").is_valid())
        for block, key, used in zip(blocks.column("block"), blocks.column("key").to_pylist(), blocks.column("uses").to_pylist()):
            block = block.as_py()
            if block != last:
                keys += run
                names += [name] * len(run)
                counts += [total] * len(run)
                last, run, total, name = block, [], 0, name + 1
            run.append(key)
            total += used
        yield frame(docs, keys, names, counts)
    yield frame(docs.slice(0, 0), run, [name] * len(run), [total] * len(run)) if last is not None else pa.RecordBatch.from_pylist([], schema=_named_schema())


def _named_schema():
    return pa.schema(
        [("uid", pa.int64()), ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("keys", pa.list_(pa.int64())), ("key", pa.int64()), ("name", pa.int64()), ("uses", pa.int64())]
    )


def identities(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, names): uid, doc_id, text_sha256 of every document row, and uid, width, name for those
    that may have copies; rows are equal exactly when width and name are."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = rows.mapInArrow(cut_blocks, CUT).repartition("block").sortWithinPartitions("block")
    named = staged(cut.mapInArrow(name_blocks, NAMED), "blocks")
    docs = named.filter("uid IS NOT NULL").select("uid", "doc_id", "text_sha256", "keys")
    shared = named.filter("key IS NOT NULL AND uses > 1").select("key", "name")

    parts = docs.select("uid", F.size("keys").alias("width"), F.posexplode("keys").alias("place", "key"))
    parts = parts.join(shared, "key").select("uid", "width", "place", "name")
    return docs.drop("keys"), paired_names(parts)


def paired_names(parts: DataFrame) -> DataFrame:
    """Names adjacent pairs of (uid, width, place, name) until each uid has one name; uids that
    miss a place are alone and leave."""
    parts, length, done = whole(parts, "width"), "width", None
    parts = staged(parts.withColumn("length", F.col(length)), "names")
    while True:
        ended = parts.filter("length = 1").select("uid", "width", "name")
        done = ended if done is None else done.unionByName(ended)
        going = parts.filter("length > 1")
        if going.isEmpty():
            return done
        pairs = going.groupBy("uid", "width", "length", F.expr("place div 2").alias("place")).agg(
            F.max(F.when(F.col("place") % 2 == 0, F.col("name"))).alias("left"),
            F.max(F.when(F.col("place") % 2 == 1, F.col("name"))).alias("right"),
        )
        pairs = staged(pairs.withColumn("right", F.coalesce("right", F.lit(-1))), "pairs")
        shared = pairs.groupBy("left", "right").agg(F.count("*").alias("uses")).filter("uses > 1")
        names = staged(shared.withColumn("name", F.monotonically_increasing_id()), "pair_names")
        named = pairs.join(names, ["left", "right"]).withColumn("length", F.expr("(length + 1) div 2"))
        parts = staged(whole(named.select("uid", "width", "length", "place", "name"), "length"), "names")


def whole(parts: DataFrame, length: str) -> DataFrame:
    """Rows of the uids of which all `length` places are there."""
    complete = parts.groupBy("uid").agg(F.count("*").alias("n"), F.max(length).alias("most")).filter("n = most")
    return parts.join(complete.select("uid"), "uid", "left_semi")


def exact_groups(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document row."""
    rows, names = identities(documents)
    named = staged(rows.join(names, "uid", "left"), "identities")
    groups = named.filter("name IS NOT NULL").groupBy("width", "name")
    groups = groups.agg(F.max(F.struct("doc_id", "uid")).alias("keep"), F.count("*").alias("n")).filter("n > 1")
    # staged, so that the join does not take over the aggregation's partitioning and a group of a
    # third of all rows can be split
    groups = staged(groups, "groups")
    return named.join(groups, ["width", "name"], "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep.uid") == F.col("uid"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
