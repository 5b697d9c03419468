"""Running sums and row numbers within groups of any size.

A window over a group is one task, so a group with a third of all rows would be one task.  Here rows
are dealt by range of (group, order), written once so that their parts are fixed, summed per part,
and each part continues from the sum of the parts before it.  Rows that are equal in order share a
part, and so get one running sum, as in a window over ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.storage import stored


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], sums: dict[str, Column], totals: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with a running sum per name in ``sums``, and the group's total per name in ``totals``."""
    keys = [o if isinstance(o, Column) else F.col(o) for o in order]
    dealt = stored(df.repartitionByRange(*[F.col(b) for b in by], *keys).withColumn("_range_part", F.spark_partition_id()), "ranges")
    totals = totals or {}
    per = dealt.groupBy(*by, "_range_part").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()], *[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()])
    group = Window.partitionBy(*by)
    before = group.orderBy("_range_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = [F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    whole = [F.sum(f"_t_{n}").over(group).alias(n) for n in totals]
    renamed = [F.col(b).alias(f"_range_by{i}") for i, b in enumerate(by)]
    per = per.select(*renamed, F.col("_range_part").alias("_range_of"), *offsets, *whole)
    same = F.col("_range_part") == F.col("_range_of")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_range_by{i}"))
    # one row per part and group it holds: as many as parts plus groups
    within = Window.partitionBy(*by, "_range_part").orderBy(*order)
    out = dealt.select("*", *[F.sum(c).over(within).alias(f"_w_{n}") for n, c in sums.items()]).join(per, same)
    return out.select(*df.columns, *[(F.col(f"_w_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums], *totals)


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Row numbers from 1 within groups; ``order`` should tell rows apart."""
    keys = [o if isinstance(o, Column) else F.col(o) for o in order]
    held = df.select("*", *[k.alias(f"_k{i}") for i, k in enumerate(keys)]) if keys else df
    names = [f"_k{i}" for i in range(len(keys))]
    dealt = stored(held.repartitionByRange(*[F.col(b) for b in by], *[F.col(n) for n in names]).withColumn("_range_part", F.spark_partition_id()), "ranges")
    per = dealt.groupBy(*by, "_range_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range_part").rowsBetween(Window.unboundedPreceding, -1)
    renamed = [F.col(b).alias(f"_range_by{i}") for i, b in enumerate(by)]
    per = per.select(*renamed, F.col("_range_part").alias("_range_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    same = F.col("_range_part") == F.col("_range_of")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_range_by{i}"))
    within = Window.partitionBy(*by, "_range_part").orderBy(*names)
    out = dealt.withColumn("_w", F.row_number().over(within)).join(per, same)
    return out.select(*df.columns, (F.col("_w") + F.col("_o")).alias(name))
