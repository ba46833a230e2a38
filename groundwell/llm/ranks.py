"""Gapless ranks within groups of any size, and row numbers that outlive a job."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwell.session import staged

SLICE_ROWS = 20_000


def slices_for(rows: int) -> int:
    return max(1, math.ceil(rows / SLICE_ROWS))


def with_group_ranks(df: DataFrame, group: str, order: list[str], rank: str, slices: int) -> DataFrame:
    """Adds `rank`: 0, 1, ... within each value of `group`, ordered by a slice and then by `order`.

    A group is dealt by a hash of its order columns into `slices` parts that are numbered apart
    and shifted by the sizes of the parts before, so that no task sorts a whole group. The order
    columns must tell the rows of a group apart.
    """
    dealt = df.withColumn("__slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    before = Window.partitionBy(group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        dealt.groupBy(group, "__slice")
        .agg(F.count("*").alias("__n"))
        .select(group, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    )
    within = Window.partitionBy(group, "__slice").orderBy(*order)
    numbered = dealt.withColumn("__row", F.row_number().over(within) - 1)
    return (
        numbered.join(shifts, [group, "__slice"])
        .withColumn(rank, F.col("__row") + F.col("__shift"))
        .drop("__slice", "__row", "__shift")
    )


def numbered_rows(df: DataFrame, name: str) -> DataFrame:
    """The frame in the work folder with `uid`, a number for each row; for narrow frames."""
    return staged(df.withColumn("uid", F.monotonically_increasing_id()), name)


def training_fold(doc_id, folds: int, held: int):
    """Whether a row is held out; rows without an id are not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == held, F.lit(False))
