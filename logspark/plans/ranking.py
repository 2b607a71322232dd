"""Ranks and running totals in groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logspark.runtime import cut_lineage


def running_totals(
    rows: DataFrame, group: str, order: Sequence[str], totals: dict[str, str]
) -> DataFrame:
    """Add, per entry ``name: expression``, the sum of ``expression`` over the
    earlier rows of the same group in ``order``, and as ``name_total`` over the
    whole group.

    Rows are range-partitioned by (group, order), so a large group spreads over
    many tasks; each task sums its slice and adds the totals of the slices
    before it, of which there are at most as many as partitions. The ranged
    rows are checkpointed: both uses must see the same slice borders, and a
    lost executor must not move them.
    """
    values = {f"_{name}": F.expr(expression) for name, expression in totals.items()}
    ranged = cut_lineage(
        rows.withColumns(values)
        .repartitionByRange(group, *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    slices = ranged.groupBy(group, "_slice").agg(
        *[F.sum(f"_{name}").alias(f"_{name}_sum") for name in totals]
    )
    whole = Window.partitionBy(group)
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    columns = []
    for name in totals:
        part = F.sum(f"_{name}_sum")
        columns += [
            F.coalesce(part.over(before), zero).alias(f"_{name}_offset"),
            part.over(whole).alias(f"{name}_total"),
        ]
    offsets = slices.select(group, "_slice", *columns)
    inside = (
        Window.partitionBy(group, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = [
        (F.coalesce(F.sum(f"_{name}").over(inside), zero) + F.col(f"_{name}_offset")).alias(name)
        for name in totals
    ]
    same = F.col(f"r.{group}").eqNullSafe(F.col(f"o.{group}")) & (
        F.col("r._slice") == F.col("o._slice")
    )
    both = ranged.alias("r").join(offsets.alias("o"), same)
    added = [name for name in offsets.columns if name not in (group, "_slice")]
    return both.select("r.*", *added).select(
        *rows.columns, *sums, *[f"{name}_total" for name in totals]
    )
