"""Running sums that no single task has to make.

An ordered running sum over one large group would put that group into one task. Here rows are
dealt by (group, range of the order key): each range is summed by itself, the ranges' totals,
one number each, get their own running sum, and both are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclusive_sums(df: DataFrame, group: list[str], order: list[str], bucket: Column, sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name, the sum of its column over the group's earlier rows.

    ``bucket`` must not fall as the order key grows; it says which rows are summed together.
    """
    rows = df.withColumn("_bucket", bucket)
    totals = rows.groupBy(*group, "_bucket").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    outer = before(Window.partitionBy(*group).orderBy("_bucket"))
    offsets = totals.select(*group, "_bucket", *(F.coalesce(F.sum(f"_t_{n}").over(outer), F.lit(0)).alias(f"_o_{n}") for n in sums))
    inner = before(Window.partitionBy(*group, "_bucket").orderBy(*order))
    local = rows.select("*", *(F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_l_{n}") for n, c in sums.items()))
    out = local.join(offsets, [*group, "_bucket"])
    return out.select(*df.columns, *((F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in sums))


def ranges_of(df: DataFrame, key: str, n: int = 1024) -> Column:
    """Bucket of a numeric order key: one of ``n`` equal ranges between its bounds in ``df``.

    Dense keys and hashed ones, however large, are dealt alike. The bounds are a scalar subquery that
    reads the key only. Rows without the key have no bucket, as they have no place in the order.
    """
    bounds = df.agg(F.struct(F.min(F.col(key).cast("double")).alias("low"), F.greatest((F.max(F.col(key).cast("double")) - F.min(F.col(key).cast("double"))) / n, F.lit(1.0)).alias("width"))).scalar()
    return F.floor((F.col(key).cast("double") - bounds["low"]) / bounds["width"])
