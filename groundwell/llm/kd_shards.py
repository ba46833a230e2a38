"""Sharding by a k-d tree over document metadata.

Metadata columns are brought to 24-bit numbers over their whole range, strings by the rank among their distinct values. A node of the tree splits the
dimension in which its rows spread widest, at the weighted median of the rows' bytes (or at the share
of leaves that its left side is to have); rows of one value are told apart by a hash, so a value that
a third of all rows share is split too. Medians are found exactly for all nodes of a level at once: a pass
sums bytes by node and 12 bits of the key, the next pass looks at the next 12 bits of the range in which the
median lies. The driver sees at most nodes x 4096 sums, tasks send them pre-aggregated.

Defined results: null text has no bytes and crc32 0; null metadata counts as the smallest value; repeated
rows each get a slot; an empty table gives no rows.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.ranks import numbered_rows, slices_for, with_group_ranks
from groundwell.session import broadcast_if_small, staged

KEY_BITS = 24
PASS_BITS = 12
BROADCAST_VALUES = 200_000


def ranked(rows: DataFrame, column: str) -> DataFrame:
    """Rows with the strings of a column replaced by their ranks among its distinct values; null stays null."""
    values = rows.select(F.col(column).alias("__value")).filter("__value IS NOT NULL").distinct().orderBy("__value")
    values = staged(values.withColumn("__at", F.monotonically_increasing_id()), "values")
    # the number within a task's part of the order, shifted by the sizes of the parts before
    part = F.shiftright("__at", 33)
    sizes = sorted(tuple(r) for r in values.groupBy(part.alias("part")).count().collect())
    shifts, before = [], 0
    for number, size in sizes:
        shifts += [(number, before)]
        before += size
    shift = values.sparkSession.createDataFrame(shifts, "__part long, __shift long")
    values = values.withColumn("__part", part).join(F.broadcast(shift), "__part")
    values = values.select("__value", (F.col("__at").bitwiseAND((1 << 33) - 1) + F.col("__shift")).cast("double").alias("__rank"))
    found = rows.join(broadcast_if_small(values, BROADCAST_VALUES), F.col(column) == F.col("__value"), "left")
    return found.withColumn(column, F.col("__rank")).select(*rows.columns)


class Tree:
    """Nodes in order of making; leaves have dimension -1 and a number."""

    def __init__(self, leaves: int):
        self.dimension, self.cut, self.near, self.far, self.leaves, self.number = [-1], [0], [0], [0], [leaves], [-1]

    def split(self, node: int, dimension: int, cut: int):
        left = (self.leaves[node] + 1) // 2
        self.dimension[node], self.cut[node] = dimension, cut
        self.near[node], self.far[node] = len(self.leaves), len(self.leaves) + 1
        for share in (left, self.leaves[node] - left):
            for column, value in ((self.dimension, -1), (self.cut, 0), (self.near, 0), (self.far, 0), (self.leaves, share), (self.number, -1)):
                column.append(value)

    def close(self):
        """Numbers the leaves from left to right."""
        todo, number = [0], 0
        while todo:
            node = todo.pop()
            if self.dimension[node] < 0:
                self.number[node], number = number, number + 1
            else:
                todo += [self.far[node], self.near[node]]

    def nodes(self, values: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """The leaf of each row of `values` (one column per dimension)."""
        dimension, cut, near, far = (np.array(x, np.int64) for x in (self.dimension, self.cut, self.near, self.far))
        node = np.zeros(len(tie), np.int64)
        live = np.flatnonzero(dimension[node] >= 0)
        while live.size:
            at = node[live]
            key = (values[live, dimension[at]] << KEY_BITS) | tie[live]
            node[live] = np.where(key <= cut[at], near[at], far[at])
            live = live[dimension[node[live]] >= 0]
        return node


def matrix(batch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], axis=1)


def grow(rows: DataFrame, dims: list[str], leaves: int) -> Tree:
    """The tree over staged rows (weight, tie, one 24-bit column per dimension)."""
    tree = Tree(leaves)
    while True:
        open_nodes = [n for n, k in enumerate(tree.leaves) if k > 1 and tree.dimension[n] < 0]
        if not open_nodes:
            break

        def extents(batches):
            for batch in batches:
                values, tie = matrix(batch, dims), matrix(batch, ["tie"])[:, 0]
                node, weight = tree.nodes(values, tie), matrix(batch, ["weight"])[:, 0]
                names, number = np.unique(node, return_inverse=True)
                low = np.full((len(names), len(dims)), 1 << KEY_BITS, np.int64)
                high = np.full((len(names), len(dims)), -1, np.int64)
                np.minimum.at(low, number, values)
                np.maximum.at(high, number, values)
                total = np.bincount(number, weight, len(names)).astype(np.int64)
                for d in range(len(dims)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names), pa.array(np.full(len(names), d)), pa.array(low[:, d]), pa.array(high[:, d]), pa.array(total)],
                        ["node", "d", "low", "high", "total"],
                    )

        found = rows.mapInArrow(extents, "node long, d long, low long, high long, total long").groupBy("node", "d")
        found = found.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total")).collect()
        spread: dict[int, list] = {}
        for r in found:
            spread.setdefault(r["node"], []).append((r["low"] - r["high"], r["d"], r["total"]))
        if not any(n in spread for n in open_nodes):
            for n in open_nodes:  # no rows: the leaves stay empty
                tree.split(n, 0, 0)
            continue
        chosen = {n: min(spread[n])[1] if n in spread else 0 for n in open_nodes}
        goal = {n: spread[n][0][2] * ((tree.leaves[n] + 1) // 2) / tree.leaves[n] if n in spread else 0 for n in open_nodes}
        prefix, done = dict.fromkeys(open_nodes, 0), dict.fromkeys(open_nodes, 0)
        for step in range(2 * KEY_BITS // PASS_BITS):
            shift = 2 * KEY_BITS - PASS_BITS * (step + 1)

            def tallied(batches, shift=shift, prefix=dict(prefix)):
                dimension = np.zeros(len(tree.leaves), np.int64)
                head = np.full(len(tree.leaves), -1, np.int64)
                for n in prefix:
                    dimension[n], head[n] = chosen[n], prefix[n]
                for batch in batches:
                    values, tie = matrix(batch, dims), matrix(batch, ["tie"])[:, 0]
                    node, weight = tree.nodes(values, tie), matrix(batch, ["weight"])[:, 0]
                    key = (values[np.arange(len(tie)), dimension[node]] << KEY_BITS) | tie
                    own = np.flatnonzero((key >> (shift + PASS_BITS)) == head[node])
                    slot = node[own] << PASS_BITS | (key[own] >> shift) & ((1 << PASS_BITS) - 1)
                    names, number = np.unique(slot, return_inverse=True)
                    total = np.bincount(number, weight[own], len(names)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], ["slot", "total"])

            sums = rows.mapInArrow(tallied, "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).collect()
            by_node: dict[int, list] = {n: [] for n in open_nodes}
            for r in sums:
                by_node[r["slot"] >> PASS_BITS].append((r["slot"] & ((1 << PASS_BITS) - 1), r["total"]))
            for n, tally in by_node.items():
                part = 0
                for bits, total in sorted(tally):
                    part = bits
                    if done[n] + total >= goal[n]:
                        break
                    if bits != max(tally)[0]:
                        done[n] += total
                prefix[n] = prefix[n] << PASS_BITS | part
        for n in open_nodes:
            tree.split(n, chosen[n], prefix[n])
    tree.close()
    return tree


def kd_shards(documents: DataFrame, dims: dict, leaves: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document row.

    `dims` names numeric or string expressions over documents. The number of leaves is given, or what brings
    them to `target_bytes`.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("weight"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        *(e.alias(f"__{n}") for n, e in dims.items()),
    )
    names = [f"__{n}" for n in dims]
    for name in [n for n in names if rows.schema[n].dataType.typeName() == "string"]:
        rows = ranked(rows, name)
    rows = rows.withColumns({n: F.col(n).cast("double") for n in names})
    rows = numbered_rows(rows, "metadata")
    bounds = rows.agg(F.sum("weight"), F.count("*"), *(f(c) for c in names for f in (F.min, F.max))).first()
    if leaves is None:
        leaves = max(1, math.ceil((bounds[0] or 0) / target_bytes))
    scaled = []
    for k, c in enumerate(names):
        low, high = bounds[2 + 2 * k], bounds[3 + 2 * k]
        if low is None or high == low:
            scaled.append(F.lit(0).cast("long").alias(c))
        else:
            place = F.floor((F.col(c) - low) / (high - low) * ((1 << KEY_BITS) - 2)) + 1
            scaled.append(F.coalesce(F.least(place, F.lit((1 << KEY_BITS) - 1)), F.lit(0)).cast("long").alias(c))
    tie = F.pmod(F.xxhash64("doc_id", "text_crc32", "uid"), F.lit(1 << KEY_BITS)).alias("tie")
    keyed = rows.select("uid", "doc_id", "weight", "text_crc32", tie, *scaled)
    tree = grow(keyed.select("weight", "tie", *names), names, leaves)

    def dealt(batches):
        number = np.array(tree.number, np.int32)
        for batch in batches:
            shard = number[tree.nodes(matrix(batch, names), matrix(batch, ["tie"])[:, 0])]
            own = [batch.column(c) for c in ("uid", "doc_id", "weight", "text_crc32")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(shard)], ["uid", "doc_id", "size", "text_crc32", "shard"])

    placed = keyed.mapInArrow(dealt, "uid long, doc_id long, size long, text_crc32 long, shard int")
    return with_group_ranks(placed, "shard", ["doc_id", "uid"], "slot", slices_for(math.ceil((bounds[1] or 0) / leaves))).drop("uid")


def metadata_shards(documents: DataFrame, shards: int = 16) -> DataFrame:
    """The given documents in shards of near equal bytes, by language, source, length and id."""
    dims = {"lang": F.col("lang").cast("string"), "source": F.col("source").cast("string"), "chars": F.log1p("n_chars"), "id": F.col("doc_id")}
    placed = kd_shards(documents, dims, leaves=shards)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
