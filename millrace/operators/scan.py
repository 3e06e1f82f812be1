"""Running sums without a task that holds a whole group: a scan over two levels.

Rows are sorted once by a range exchange, so a group of any size lies over several partitions. The sum of each
partition's share of a group is taken first, then what stands before each share, and last the sums
within the shares. A share is what one partition holds of a group, whatever the group's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def running(rows: DataFrame, value: Column, order: Sequence[str], by: Sequence[str] = (), name: str = "before", parts: int | None = None) -> DataFrame:
    """rows with ``name``: the sum of ``value`` over the earlier rows of the group (``by``) in the order, 0 for the first.

    Rows that the order does not tell apart stand in any order among themselves. Null values count as 0; null keys are a group, and sort first in the order.
    ``parts`` is the number of range partitions; by default the session's number of shuffle partitions.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    tied = rows.withColumns({"_v": F.coalesce(value, F.lit(0)), "_tie": F.monotonically_increasing_id()})
    dealt = tied.repartitionByRange(parts, *keys, "_tie") if parts else tied.repartitionByRange(*keys, "_tie")
    placed = written(dealt.sortWithinPartitions(*keys, "_tie").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "scan")
    shares = placed.groupBy(*by, "_part").agg(F.sum("_v").alias("_share"))
    # a group has one share in each partition at most: as many rows here as there are partitions that hold the group
    up_to = F.sum("_share").over(Window.partitionBy(*by).orderBy("_part")) if by else F.sum("_share").over(Window.orderBy("_part"))
    offsets = shares.select(*by, "_part", (up_to - F.col("_share")).alias("_offset"))
    inside = F.sum("_v").over(Window.partitionBy(*by, "_part").orderBy("_at")) - F.col("_v")
    local = placed.withColumn("_inside", inside).alias("l")
    joined = local.join(offsets.alias("o"), [F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*by, "_part")])
    return joined.select(*[F.col(f"l.{c}") for c in rows.columns], (F.col("_offset") + F.col("_inside")).alias(name))


def numbered(rows: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "number", start: int = 1) -> DataFrame:
    """rows with ``name``: their place in the order, within their group, from ``start`` on."""
    return running(rows, F.lit(1).cast("bigint"), order, by, name).withColumn(name, F.col(name) + start)
