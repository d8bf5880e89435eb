"""Running sums and numbers inside groups of any size.

A window over a group reads the whole group in one task.  Here a large group is
many *chunks*: a window works inside a chunk, and what comes before a chunk is
the sum of its group's earlier chunks.  Where the order begins with a dense
number, as a mail's uid, chunks are blocks of it and cost no more than the
window alone.  Otherwise they are ranges of (group, order) that Spark finds by
sampling; only a group that begins before a range has anything there, so these
sums are at most one row a range, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.lineage import keep

_CHUNK = "__chunk"
#: Values of a dense number in one chunk.
BLOCK = 1 << 16


def running_sum(rows: DataFrame, groups: list[str], order: list[Column | str], value: Column, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of the group that come before this one.

    ``order`` should be total inside a group; rows that tie in it are taken in
    any order, but all of one tie are in one task.  Null groups are a group,
    null values count as 0, an empty table stays empty.
    """
    laid = keep(rows.withColumn("__value", F.coalesce(value, F.lit(0)).cast("long")).repartitionByRange(*groups, *order).withColumn(_CHUNK, F.spark_partition_id()), "laid-out")
    sums = laid.groupBy(*groups, _CHUNK).agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(*groups).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("__before", F.sum("__sum").over(earlier)).where("__before IS NOT NULL")
    before = F.broadcast(before.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col(_CHUNK).alias("__c"), "__before"))
    same = F.col(_CHUNK) == F.col("__c")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inside = F.sum("__value").over(Window.partitionBy(*groups, _CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    summed = laid.withColumn("__inside", inside).join(before, same, "left")
    total = F.coalesce("__inside", F.lit(0)) + F.coalesce("__before", F.lit(0))
    return summed.withColumn(out, total.cast("long")).select(*[c for c in rows.columns if c != out], out)


def numbered_from(rows: DataFrame, groups: list[str], order: list[Column | str], out: str, first: int = 0) -> DataFrame:
    """``rows`` with their place in the group, counted from ``first``."""
    return running_sum(rows, groups, order, F.lit(1), out).withColumn(out, F.col(out) + first)


def block_of(number: Column | str) -> Column:
    """The block of a dense number."""
    number = F.col(number) if isinstance(number, str) else number
    return F.floor(number / BLOCK).cast("long")


def numbered_by_blocks(rows: DataFrame, groups: list[str], blocks: list[Column], order: list[Column | str], out: str, first: int = 0, tasks: int | None = None) -> DataFrame:
    """As ``numbered_from``; rows of different ``blocks`` must be in the order of these columns.

    The rows are computed once for the counts, without the columns that these
    do not need, and once for the numbers; counts and numbers meet in the
    dealing by chunk that the window has anyway; ``tasks`` says how many it has
    where the rows are known to be many.
    """
    chunked = rows.withColumn(_CHUNK, F.struct(*[b.alias(f"b{i}") for i, b in enumerate(blocks)]))
    counts = chunked.groupBy(*groups, _CHUNK).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*groups).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col(_CHUNK).alias("__c"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    same = F.col(_CHUNK).eqNullSafe(F.col("__c"))
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inside = F.row_number().over(Window.partitionBy(*groups, _CHUNK).orderBy(*order))
    laid = chunked if tasks is None else chunked.repartition(tasks, *groups, _CHUNK)
    met = laid.withColumn("__inside", inside).join(before, same)
    return met.withColumn(out, (F.col("__before") + F.col("__inside") - 1 + first).cast("long")).select(*[c for c in rows.columns if c != out], out)
