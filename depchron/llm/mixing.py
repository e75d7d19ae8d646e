"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow that sends its documents in a seeded random order, up to ``epochs`` times over. A sending's virtual finish time
is the source's tokens sent until its end, divided by the source's weight. All sendings of all sources form one queue,
sorted by finish time over ranges of it, and the queue is cut where what has been sent reaches the budget: up to a finish time, a source has
sent its weight times that time, or all it has if its last sending has left the queue before; then the others share what it leaves, by weight.

The cut is one virtual time for all. A document whose sending ends before it is taken whole; the one that each source is sending then counts
with the words sent until then, so each source meets its target to less than a word.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depchron.llm import common
from depchron.sources.work import table, written

#: Weights by the source's place in code point order, repeating.
WEIGHTS = (3, 1, 2)


def weighed(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(source, none, size) with ``rank``, the source's place in code point order, null last, and its ``weight``; sources are ranked by ranges of their names."""
    n = common.ranges(sizes.sparkSession)
    dealt = written(sizes.repartitionByRange(n, "none", "source").withColumn("__part", F.spark_partition_id()).withColumn("__all", F.lit(0)), "mix-sources")
    ranked = common.running_sum(dealt, ["__all"], "__part", ["none", "source"], F.lit(1), "rank", "__n")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    return written(ranked.select("source", "none", "rank", "size", weight.alias("weight")), "mix-sources")


def queue(sent: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """All sendings of documents (cum, weight, source_size, size), range-sorted by finish time: (finish, leaves, weight, part).

    ``finish`` is the virtual finish time as a whole number, times the least common multiple of the weights; ``leaves`` is all that the source has sent, at its
    last sending, else null. ``part`` is the range, which rises with the finish time.
    """
    sendings = sent.filter("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    ends = F.col("epoch") * F.col("source_size") + F.col("cum")
    last = (F.col("epoch") == epochs - 1) & (F.col("cum") == F.col("source_size"))
    whole = math.lcm(*weights)
    rows = sendings.select((ends * (F.lit(whole) / F.col("weight")).cast("long")).alias("finish"), F.when(last, ends).alias("leaves"), "weight")
    n = common.ranges(sent.sparkSession)
    return written(rows.repartitionByRange(n, "finish").sortWithinPartitions("finish").withColumn("part", F.spark_partition_id()), "mix-queue")


def cut(queued: DataFrame, total: int, flows: int, weights: tuple[int, ...], per_cent: int) -> tuple[int, int]:
    """(over, under): the virtual time at which ``per_cent`` of ``total`` tokens have been sent is over / under / 100; ``flows`` is the sum of all weights.

    At a row's finish time, what has been sent is what the sources that have left had, and the time times the weights of the others: two running sums
    over the queue, each range on its own with the sums of earlier ranges as offsets. The rows within the budget tell the cut. If all sources leave, under is 0.
    """
    gone = {"caps": F.coalesce("leaves", F.lit(0)), "weights": F.when(F.col("leaves").isNotNull(), F.col("weight")).otherwise(0)}
    of_part = queued.groupBy("part").agg(*[F.sum(c).alias(k) for k, c in gone.items()])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = of_part.select("part", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}_before") for k in gone])
    inside = Window.partitionBy("part").orderBy("finish").rangeBetween(Window.unboundedPreceding, 0)
    at = queued.join(offsets, "part").select("finish", *[(F.col(f"{k}_before") + F.sum(c).over(inside)).alias(k) for k, c in gone.items()])
    big = lambda x: x.cast("decimal(38,0)") if not isinstance(x, int) else F.lit(x).cast("decimal(38,0)")
    whole = math.lcm(*weights)
    sent = big(F.col("caps")) * big(whole) + big(F.col("finish")) * (big(flows) - big(F.col("weights")))
    within = at.filter(sent * big(100) <= big(per_cent * total * whole)).agg(F.max("caps").alias("caps"), F.max("weights").alias("weights")).first()
    return per_cent * total - 100 * int(within["caps"] or 0), flows - int(within["weights"] or 0)


def targets(sources: DataFrame, over: int, under: int, per_cent: int, epochs: int, total: int) -> DataFrame:
    """``sources`` with source_size, target and ``send``, the target in whole tokens: cut, and what that leaves goes to those that lost most, a token each."""
    n = common.ranges(sources.sparkSession)
    cap = epochs * F.col("size")
    full = F.lit(True) if not under else cap.cast("decimal(38,0)") * F.lit(100 * under).cast("decimal(38,0)") <= F.col("weight").cast("decimal(38,0)") * F.lit(over).cast("decimal(38,0)")
    target = F.when(full, cap.cast("double")).otherwise((F.col("weight") * F.lit(over).cast("long")).cast("double") / F.lit(100.0 * (under or 1)))
    whole = written(sources.select("*", full.alias("full"), target.alias("target")).withColumn("lost", F.col("target") - F.floor("target")), "mix-targets")
    spare = per_cent * total // 100 - (whole.agg(F.sum(F.floor("target"))).first()[0] or 0)
    by_loss = whole.withColumns({"__part": F.floor((1 - F.col("lost")) * n), "__all": F.lit(0)})
    by_loss = common.running_sum(by_loss, ["__all"], "__part", [F.desc("lost"), "rank"], F.lit(1), "place", "__n")
    send = F.floor("target") + (~F.col("full") & (F.col("place") <= spare)).cast("long")
    return by_loss.select("source", "none", "target", send.alias("send"))


def mix(
    docs: DataFrame, size: Column, weights: tuple[int, ...] = WEIGHTS, per_cent: int = 150, epochs: int = 2, seed: str = "mix-1",
    id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """``docs`` with size, source_size, target (the source's), taken (tokens the mix takes, repeats counted) and finish.

    The targets add up to ``per_cent`` of all sizes and each source meets its own but for rounding; no document gives
    more than ``epochs`` times its size. ``finish`` is the virtual finish time when the document is first sent. A null
    source is a source of its own, last in order; a null or empty text has size 0, stays, and is taken 0 times. A null id
    is like any value. Repeated rows are documents of their own; of equal ids the smaller size is sent first. Columns
    of ``docs`` with these five names are replaced; others may have any name. An empty table gives no rows.
    """
    n, out = common.ranges(docs.sparkSession), ("size", "source_size", "target", "taken", "finish")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in out]).alias("__row"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.col(source_col).isNull().alias("none"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        F.col(id_col).cast("string").alias("__id"),
        common.order_key(seed, F.col(id_col)).alias("__key"),
    ).withColumn("__part", common.key_range(F.col("__key"), n))
    rows = written(rows, "mix-rows")
    sources = weighed(rows.groupBy("source", "none").agg(F.sum("size").cast("long").alias("size")), weights)
    sums = sources.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.coalesce(F.sum("weight"), F.lit(0)).alias("flows")).first()
    of_source = sources.select("source", "none", "weight", F.col("size").alias("source_size"))
    sent = common.running_sum(rows, ["source", "none"], "__part", ["__key", "__id", "size"], F.col("size"), "cum", "__sent", of_source)
    sent = written(sent.select("__row", "source", "none", "size", "source_size", "weight", "cum", "__part"), "mix-sent")
    over, under = cut(queue(sent, weights, epochs), sums["total"], sums["flows"], weights, per_cent)
    plan = targets(sources, over, under, per_cent, epochs, sums["total"])
    # a source's target meets its rows by (source, range), so no row meets it under a hot key
    each = plan.join(sent.select("source", "none", "__part").distinct(), ["source", "none"])
    unsent = lambda e: e * F.col("source_size") + F.col("cum") - F.col("send")
    part = lambda e: F.col("size") - F.least(F.col("size"), F.greatest(F.lit(0), unsent(e)))
    taken = reduce(lambda a, b: a + b, [part(e) for e in range(epochs)])
    done = sent.join(each, ["source", "none", "__part"])
    return done.select("__row.*", "size", "source_size", "target", taken.cast("long").alias("taken"), (F.col("cum") / F.col("weight")).alias("finish"))


def token_count(text: Column) -> Column:
    """Words of the text; a null text has none."""
    return common.word_count(text)


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: every document as often as its taken words fill it, the last one begun in full, with its own columns.

    Rows that share an id come equally often; documents without words or id are no part of a mix. Only ids and
    numbers go through the queues; the texts move once, when the repeats are joined back. Columns of any other name are
    carried along, whatever they are called. An empty table gives no rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    packed = docs.select(row, F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("flow"), F.col(f"`{text_col}`").alias("text")).filter("id IS NOT NULL")
    narrow = packed.select("id", "flow", token_count(F.col("text")).alias("n"))
    taken = mix(narrow, F.col("n"), id_col="id", source_col="flow", **options).filter("taken > 0")
    times = written(taken.groupBy("id").agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("times")), "mix-repeats")
    joined = packed.select("row", "id").join(times.hint("merge"), "id")
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def in_order(taken: DataFrame, partitions: int | None = None) -> DataFrame:
    """What ``mix`` took as one queue: rows with taken words, sorted over all partitions by ranges of finish time.

    Rows that nothing is taken of (null and empty texts) are left out; ties stand in any order; repeated rows and other columns stay as they are.
    """
    rows = taken.filter("taken > 0")
    return (rows.repartitionByRange(partitions, "finish") if partitions else rows.repartitionByRange("finish")).sortWithinPartitions("finish")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150% of their words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs.select("doc_id", "source", token_count(F.col("text")).alias("n")), F.col("n")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "finish"
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS k
  FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(r - 1) % 3 + 1] AS weight, 2 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
c AS (SELECT *, sum(cap) OVER o AS caps, coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight,
  r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS rest
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, r ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, 100 * (weight * caps + cap * rest) <= 150 * total * weight AS is_full FROM c),
t AS (SELECT *, 150 * total - 100 * coalesce(sum(cap) FILTER (is_full) OVER (), 0) AS above,
             100 * coalesce(sum(weight) FILTER (NOT is_full) OVER (), 0) AS below FROM f),
g AS (SELECT source, r, source_size, weight,
             is_full, CASE WHEN is_full THEN cap::DOUBLE ELSE (weight * above)::DOUBLE / nullif(below, 0)::DOUBLE END AS target, total FROM t),
h AS (SELECT *, floor(target)::BIGINT + CASE WHEN NOT is_full AND row_number() OVER (ORDER BY target - floor(target) DESC, r)
                                                  <= 150 * total // 100 - sum(floor(target)::BIGINT) OVER () THEN 1 ELSE 0 END AS send FROM g),
q AS (SELECT d.doc_id, d.source, d.size, h.source_size, h.weight, h.target, h.send,
             sum(d.size) OVER (PARTITION BY h.r ORDER BY d.k, d.doc_id::VARCHAR, d.size ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, source, cum::DOUBLE / weight AS finish,
       (send // greatest(source_size, 1) * size + greatest(0, least(size, send % greatest(source_size, 1) - (cum - size))))::BIGINT AS taken
FROM q
"""
