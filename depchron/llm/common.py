"""What several operators share: word patterns, seeded order keys and running sums that no hot group can block."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of anything but a space or the control characters 09 to 0D.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]++"
#: Order keys lie below this, so that ranges of them are plain integer divisions.
KEY_LIMIT = 1 << 60


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def free_name(columns: list[str], name: str) -> str:
    """``name``, or what it takes to differ from all of ``columns`` in either case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def order_key(seed: str, *cols: Column) -> Column:
    """A seeded pseudo-random key in [0, 2^60), the same in any run and on any cluster."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def ranges(spark: SparkSession) -> int:
    """How many ranges to cut an order key into: it follows the cluster's own setting, and no result depends on it."""
    return max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def key_range(key: Column, n: int) -> Column:
    """The range of an order key; it rises with the key."""
    return F.floor(key / F.lit(float(KEY_LIMIT // n + 1))).cast("int")


def word_count(text: Column) -> Column:
    """Number of words; a null text has none. Each word becomes one letter, so no array of words is built."""
    rest = F.ltrim(F.coalesce(text, F.lit("")), F.lit("\x20\x09\x0a\x0b\x0c\x0d"))
    return F.length(F.regexp_replace(rest, rf"{WORD}[{SPACE}]*+", "w")).cast("long")


def running_sum(
    df: DataFrame, groups: list[str], part: str, order: list[str], value: Column, cum: str, total: str, of_group: DataFrame | None = None
) -> DataFrame:
    """Adds ``cum``, the running sum of ``value`` in each group by (``part``, ``order``), and ``total``, the group's sum.

    ``part`` must rise with ``order``. Each (group, part) is summed on its own, with partial sums before the
    shuffle, and the sums of earlier parts are joined back as offsets, so a group that holds a third of all rows
    is spread over as many tasks as it has parts. ``groups`` must hold no nulls. The columns of ``of_group``, one
    row per group, come along with the offsets, so no row meets its group under a hot key.
    """
    keys = [*groups, part]
    sums = df.groupBy(*keys).agg(F.sum(value).cast("long").alias("__sum"))
    before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys,
        F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"),
        F.sum("__sum").over(Window.partitionBy(*groups)).alias(total),
    )
    if of_group is not None:
        offsets = offsets.join(of_group, groups)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(offsets, keys).withColumn(cum, F.col("__before") + F.sum(value).over(inside)).drop("__before")


def prefix_sums(values: Column, block: int = 64) -> Column:
    """Inclusive prefix sums of an array of whole numbers, in blocks, so that the work grows with its length and not its square."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def of(v: Column) -> Column:
        n = F.size(v)
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / block).cast("int") - 1), lambda b: total(F.slice(v, b * block + 1, F.lit(block))))
        before = lambda sums: F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        one = lambda base, b: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(block), n - b * block)), lambda i: F.get(base, b) + total(F.slice(v, b * block + 1, i))
        )
        return let(before(blocks), lambda base: F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(n / block).cast("int") - 1), lambda b: one(base, b))))

    return let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array().cast("array<bigint>")))
