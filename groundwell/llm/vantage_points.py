"""SimHash near-dedup over a vantage-point tree.

The distinct fingerprints are dealt by a tree of vantage points whose inner nodes split at a
Hamming distance `cut` from a point: up to `cut` to the near side, the rest to the far side. By
the triangle bound two fingerprints within `radius` bits differ by at most `radius` in their distance
to the point, so copying those at distances cut - radius + 1 .. cut to the far side too puts
every linked pair together into some shard. The copies are the tree's boundary overlap; nothing is
capped, and every pair within the radius is compared or pruned by a bound. Inside a shard
the same split goes on in memory down to LEAF_POINTS, where all distances are taken.

The tree is fitted on a sample of at most 2 * SAMPLE_POINTS distinct fingerprints, drawn by hash. It sets how
even the shards are, never what is found. A shard emits a spanning forest of its links
as stars, so a cluster of n fingerprints gives fewer than n rows per shard; the forests
are joined by alternating large-star and small-star steps, each staged.

Defined results: null and empty texts have fingerprint zero and link like any other; rows repeated or with
equal texts share a fingerprint and count as one point; component_id ignores null ids and is null
only where all rows of a component have none.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.fingerprints import fingerprints
from groundwell.session import staged

RADIUS = 2
SAMPLE_POINTS = 16_384
SHARD_POINTS = 40_000
LEAF_POINTS = 400
CANDIDATES = 12


def split_at(points: np.ndarray, radius: int, seed: int):
    """(vantage point, cut, distances): of a few of the points the one, and of the middle distances
    the cut, that leave the smallest larger side, copies included. None if no split helps."""
    best = None
    for k in range(CANDIDATES):
        point = points[(seed + k * 2654435761) % len(points)]
        if len(points) > 4096:
            seen = points[:: len(points) // 2048]
        else:
            seen = points
        tally = np.bincount(np.bitwise_count(seen ^ point), minlength=65)
        upto = np.cumsum(tally)
        near = upto[:-1]
        # the far side also holds distances cut - radius + 1 .. cut
        far = len(seen) - np.concatenate((np.zeros(radius, np.int64), upto))[:64]
        worst = np.maximum(near, far)
        cut = int(np.argmin(worst + 0.2 * (near + far - len(seen))))
        if best is None or worst[cut] < best[0]:
            best = (worst[cut], point, cut, len(seen))
    if best[0] > 0.93 * best[3]:
        return None
    return best[1], best[2], np.bitwise_count(points ^ best[1]).astype(np.int64)


def fit_tree(sample: np.ndarray, shards: int, radius: int) -> list:
    """Nodes (point, cut, near child, far child); a child below zero is shard -1 - child."""
    nodes: list = []
    made = [0]

    def grow(points, wanted, depth):
        found = split_at(points, radius, depth) if wanted > 1 and len(points) >= 8 else None
        if found is None:
            made[0] += 1
            return -made[0]
        point, cut, distance = found
        at = len(nodes)
        nodes.append(None)
        near, far = points[distance <= cut], points[distance > cut - radius]
        share = wanted * len(near) / max(1, len(near) + len(far))
        nodes[at] = (point, cut, grow(near, share, depth + 1), grow(far, wanted - share, depth + 1))
        return at

    grow(sample, shards, 0)
    return nodes


def route(nodes: list, points: np.ndarray, radius: int):
    """(shard, points) for all shards that points belong to, boundary copies included."""
    todo = [(0, points)] if nodes else []
    if not nodes and len(points):
        yield 0, points
    while todo:
        at, own = todo.pop()
        if not len(own):
            continue
        if at < 0:
            yield -1 - at, own
            continue
        point, cut, near, far = nodes[at]
        distance = np.bitwise_count(own ^ point).astype(np.int64)
        todo.append((near, own[distance <= cut]))
        todo.append((far, own[distance > cut - radius]))


def stars(a: np.ndarray, b: np.ndarray):
    """(root, member) for members of each connected set but its smallest one."""
    names, edge = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = edge[: len(a)], edge[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    member = np.flatnonzero(root != np.arange(len(names)))
    return names[root[member]], names[member]


def linked(points: np.ndarray, radius: int):
    """Stars of the links among distinct points, by the tree's split down to small leaves."""
    todo, roots, members, seed = [points], [], [], 0
    while todo:
        own = todo.pop()
        found = split_at(own, radius, seed) if len(own) > LEAF_POINTS else None
        seed += 1
        if found is not None:
            _, cut, distance = found
            near, far = own[distance <= cut], own[distance > cut - radius]
            if max(len(near), len(far)) < len(own):
                todo += [near, far]
                continue
        for k in range(0, len(own), LEAF_POINTS):
            block = own[k : k + LEAF_POINTS]
            rest = own[k:]
            for m in range(0, len(rest), 4096):
                other = rest[m : m + 4096]
                x, y = np.nonzero(np.bitwise_count(block[:, None] ^ other[None, :]) <= radius)
                proper = block[x] != other[y]
                if proper.any():
                    root, member = stars(block[x[proper]], other[y[proper]])
                    roots.append(root)
                    members.append(member)
    if not roots:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return stars(np.concatenate(roots), np.concatenate(members))


def links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b), a < b, that connect the distinct fingerprints of `points` (fp) as links of at
    most `radius` bits do."""
    spark = points.sparkSession
    n = points.count()
    draw = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_POINTS / max(n, 1)))
    sample = np.array([r["fp"] for r in points.filter(draw).limit(2 * SAMPLE_POINTS).collect()], np.int64).view(np.uint64)
    nodes = fit_tree(np.sort(sample), math.ceil(n / SHARD_POINTS), radius) if len(sample) else []
    wanted = max(1, math.ceil(n / SHARD_POINTS))

    def dealt(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for shard, held in route(nodes, own, radius):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(held), shard, np.int32)), pa.array(held.view(np.int64))], ["shard", "fp"]
                )

    def forest(table: pa.Table) -> pa.Table:
        own = np.unique(table.column("fp").to_numpy().view(np.uint64))
        root, member = linked(own, radius)
        root, member = root.view(np.int64), member.view(np.int64)
        return pa.table({"a": np.minimum(root, member), "b": np.maximum(root, member)})

    shards = points.mapInArrow(dealt, "shard int, fp long")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted)
    return shards.repartition(parts, "shard").groupBy("shard").applyInArrow(forest, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(member, root): the smallest node of each node's connected set, for all nodes but roots.

    Large-star hangs a node's larger neighbours on its smallest one, small-star the smaller ones
    and itself; the edges end as stars. Minima are aggregated before the shuffle and
    joined back, so a hub's edges may be split among tasks.
    """
    edges = staged(edges.filter("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = staged(both.groupBy("a").agg(F.min("b").alias("low")), "lows")
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("u"), F.least("a", "low").alias("v"))
        large = staged(large.filter("u <> v").distinct(), "large")
        low = staged(large.groupBy("u").agg(F.min("v").alias("low")), "lows")
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), "low").unionByName(small.select("u", "low"))
        edges = staged(small.filter("u <> low").distinct().select(F.col("low").alias("a"), F.col("u").alias("b")), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("member"), F.col("a").alias("root"))
        before = now


def near_groups(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """uid, doc_id, fingerprint, component_id of every document row."""
    rows = staged(fingerprints(documents), "fingerprints")
    points = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    roots = components(links(points.select("fp"), radius))
    point = points.join(roots, points["fp"] == roots["member"], "left")
    point = point.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = point.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(point.join(named, "root").select("fp", "component_id"), "components")
    return rows.join(named, "fp").select(
        "uid", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
