"""Numbering and running sums in groups of which one may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, groups: list[str], part: str, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the row's number from 1 within its group by (``part``, ``order``).

    ``part`` is a coarse column that rises with the order (a day, say). Rows are numbered within (group, part), and
    the counts of earlier parts, which are pre-aggregated before the shuffle, are added; so a group is spread over as
    many tasks as it has parts.
    """
    keys = [*groups, part]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.join(offsets, keys).withColumn(name, F.col("__before") + inside).drop("__before")


def pieces(df: DataFrame, groups: list[str], part: str, order: list[str], size: int) -> DataFrame:
    """Adds ``number`` (from 0, as ``numbered`` counts), ``piece`` (runs of ``size`` rows of a group in this order, from 0) and ``pieces`` (of the group).

    ``df`` is read three times, so it should be written before.
    """
    sizes = df.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / size).alias("pieces"))
    placed = numbered(df, groups, part, order, "number").withColumn("number", F.col("number") - 1)
    return placed.withColumn("piece", F.floor(F.col("number") / size)).join(sizes, groups)
