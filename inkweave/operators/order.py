"""Values by their place in the order of all, without one task that holds all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def cumulated(counts: DataFrame, by: str, sums: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """``counts`` with the running sums <sum>_upto in ascending order of ``by``, which is distinct; and a row of the totals <sum>_all. Rows are dealt into
    ranges of ``by``, which a checkpoint fixes; only the ranges' sums, a row for each partition, meet in one place."""
    dealt = cut(counts.repartitionByRange(by).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.join(F.broadcast(offsets), "_part").withColumns({f"{c}_upto": F.col(f"_{c}") + F.sum(c).over(inside) for c in sums})
    totals = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_all") for c in sums])
    return rows.drop("_part", *[f"_{c}" for c in sums]), totals


def at_share(by: str, count: str, share: float) -> Column:
    """Over the rows of :func:`cumulated` with totals: the value at index ``floor(share * n)``, the upper one of two medians."""
    index = F.floor(F.col(f"{count}_all") * F.lit(share))
    return F.max(F.when((index >= F.col(f"{count}_upto") - F.col(count)) & (index < F.col(f"{count}_upto")), F.col(by)))


def quantiles(values: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: n, and the value at index ``floor(share * n)`` of the sorted values for each name of ``shares``. Nulls don't count."""
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    rows, totals = cumulated(counts, "v", ("n",))
    picked = rows.crossJoin(F.broadcast(totals)).agg(*[at_share("v", "n", s).alias(k) for k, s in shares.items()])
    return totals.select(F.col("n_all").alias("n")).crossJoin(picked)
