"""Best-fit packing of tokenised documents with a swap-based local search.

Documents longer than a sequence are cut into full sequences and a shorter first piece; full pieces are
sequences as they are. The other pieces, without their ids, are dealt by a hash into slices of about SLICE_PIECES. A task
packs a slice by best fit and then exchanges documents between its underfull bins (swap_search) until the lightest
can no longer be emptied. Bins with room left are dealt anew, whole, into slices of the next round, where bins of
different slices meet, until one slice held them all or a round saved nothing. A task holds one slice
whatever the size of the corpus; slices and rounds depend on numbers of pieces alone, so a length that a third of all
documents share makes no slice larger.

Defined results: null text is empty; every document has at least its end token; repeated rows are packed each; an empty table gives no
rows. Columns other than doc_id and text are not read.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.arrays import text_slices
from groundwell.llm.chunk_encoder import chunk_encoder
from groundwell.llm.swap_search import best_fit, packed_lengths
from groundwell.session import staged

SEQUENCE = 1024
END_TOKEN = 2
SLICE_PIECES = 20_000
MAX_ROUNDS = 6

PIECES = "uid long, piece int, doc_id long, start long, length int, sequence_id long, ids binary"
BINS = "uid long, piece int, length int, bin long, offset long, room int"
PACKED = "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids binary"
# Sequences of full pieces, and those of the rounds, stand in different ranges.
FULL = 1 << 60


def piece_bounds(tokens: int, limit: int) -> list[tuple[int, int]]:
    """(start, end) of a document's pieces: a shorter one, if any, comes first."""
    head = tokens % limit
    return [(0, head)] * (head > 0) + [(a, a + limit) for a in range(head, tokens, limit)]


def token_pieces(documents: DataFrame, tokenizer: str, limit: int = SEQUENCE) -> DataFrame:
    """The pieces of every document row; ids in 16 bits where the vocabulary allows, else 32, little-endian. Full pieces have
    their sequence_id, the others none."""

    def cut(batches):
        from pyspark import TaskContext

        uid = full = TaskContext.get().partitionId() << 33
        full += FULL
        own = chunk_encoder(tokenizer)
        end = np.array([END_TOKEN], own.kind)
        names = ["uid", "piece", "doc_id", "start", "length", "sequence_id", "ids"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            for i, j, buffer, starts in text_slices(batch, "text", 1 << 20):
                flat, ends = own.slice_ids(buffer, starts)
                rows = []
                for doc_id, a, b in zip(batch.column(0).slice(i, j - i).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                    ids = np.concatenate((flat[a:b], end))
                    for piece, (start, stop) in enumerate(piece_bounds(len(ids), limit)):
                        whole = stop - start == limit
                        rows.append((uid, piece, doc_id, start, stop - start, full if whole else None, ids[start:stop].tobytes()))
                        full += whole
                    uid += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


def packed_slice(table: pa.Table, limit: int, number: int) -> pa.Table:
    """The pieces of one slice with their bins; bins that come with the pieces are a second start, and the better end counts."""
    uid, piece, length, given = (table.column(c).to_numpy() for c in ("uid", "piece", "length", "bin"))
    slot = int(table.column("slice")[0].as_py())
    bins = packed_lengths(best_fit(length.tolist(), limit), limit)
    if not table.column("bin").null_count:
        order = np.argsort(given, kind="stable")
        cuts = np.flatnonzero(np.diff(given[order])) + 1
        kept = packed_lengths([b.tolist() for b in np.split(length[order], cuts)], limit)
        bins = min(kept, bins, key=len)
    # pieces of one length stand for each other
    order = np.lexsort((piece, uid, length))
    wanted = np.array([a for b in bins for a in b])
    owner = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    at = np.concatenate([np.cumsum([0, *b[:-1]]) for b in bins])
    room = limit - np.bincount(owner, wanted, len(bins)).astype(np.int64)
    by_length = np.argsort(wanted, kind="stable")
    owner, at = owner[by_length], at[by_length]
    name = (number << 55) + (slot << 27) + owner
    columns = [uid[order], piece[order], length[order], name, at.astype(np.int64), room[owner].astype(np.int32)]
    return pa.table([pa.array(c) for c in columns], ["uid", "piece", "length", "bin", "offset", "room"])


def packed_round(pieces: DataFrame, slices: int, limit: int, number: int) -> DataFrame:
    key = F.xxhash64("bin") if number else F.xxhash64("uid", "piece")
    dealt = pieces.select("uid", "piece", "length", "bin", F.pmod(key, F.lit(slices)).alias("slice"))
    return dealt.groupBy("slice").applyInArrow(lambda table: packed_slice(table, limit, number), BINS)


def placed_pieces(pieces: DataFrame, limit: int = SEQUENCE) -> DataFrame:
    """uid, piece, bin, offset of (uid, piece, length) rows."""
    open_rows = pieces.select("uid", "piece", "length", F.lit(None).cast("long").alias("bin"))
    left, done, before = open_rows.count(), [], None
    for number in range(MAX_ROUNDS):
        slices = max(1, math.ceil(left / SLICE_PIECES))
        packed = staged(packed_round(open_rows, slices, limit, number), f"bins{number}")
        found = packed.agg(F.count_distinct("bin").alias("all"), F.count_if(F.col("room") > 0).alias("left")).first()
        if slices == 1 or not found["left"] or found["all"] == before or number == MAX_ROUNDS - 1:
            done.append(packed)
            break
        done.append(packed.filter("room = 0"))
        open_rows = packed.filter("room > 0")
        left = found["left"]
        before = open_rows.select("bin").distinct().count()
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("uid", "piece", F.col("bin").alias("sequence"), "offset")


def pack(documents: DataFrame, tokenizer: str, limit: int = SEQUENCE) -> DataFrame:
    """Pieces with their sequence, offset and ids: doc_id, piece, start, length, sequence_id, offset, ids (little-endian
    32-bit)."""
    pieces = staged(token_pieces(documents, tokenizer, limit), "pieces")
    short = pieces.filter("sequence_id IS NULL")
    places = placed_pieces(short, limit)
    placed = short.drop("sequence_id").join(places.hint("shuffle_merge"), ["uid", "piece"]).withColumnRenamed("sequence", "sequence_id")
    full = pieces.filter("sequence_id IS NOT NULL").withColumn("offset", F.lit(0).cast("long"))
    columns = ["doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "sequence_id", "offset", "ids"]

    def widened(batches):
        for batch in batches:
            sizes, raw = batch.column("length").to_pylist(), batch.column("ids").to_pylist()
            ids = [np.frombuffer(x, f"<u{len(x) // n}").astype("<u4").tobytes() for x, n in zip(raw, sizes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary())], batch.schema.names)

    return full.select(columns).unionByName(placed.select(columns)).mapInArrow(widened, PACKED)


def packing_digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
