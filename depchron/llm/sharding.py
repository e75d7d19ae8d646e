"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded key and ranked within their source; a row's fractional rank is (rank - phase) / (rows of
its source), the phase being a seeded number between 0 and 1 for each source, so that sources of equal size don't
come in step. Sorted by fractional rank every stretch of the order holds the sources in their overall proportions, so
cutting it into equal stretches gives shards that all match the mixture, with row counts at most one apart.

No source is ranked in one task (``common.running_sum``), and the global order is cut into ranges of the
fractional rank, which hold equal shares of rows by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depchron.llm import common
from depchron.sources.work import table, written


def shard(docs: DataFrame, n_shards: int = 24, seed: str = "shard-1", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    Rows: all of them, whatever they hold. A null source is a source of its own; a null id takes part like any
    value; texts are not looked at, however long; repeated rows get places of their own. Columns of ``docs`` named ``shard`` or
    ``slot`` are replaced. An empty table gives no rows. Rows of one source and id are ordered by a hash of
    the whole row, so reruns agree.
    """
    n = common.ranges(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source"),
        F.col(source_col).isNull().alias("__none"),
        common.order_key(seed, F.col(id_col)).alias("__key"),
        F.xxhash64(*[F.col(f"`{c}`") for c in kept]).alias("__tie"),
    ).withColumn("__part", common.key_range(F.col("__key"), n))
    rows = written(rows, "shard-rows")
    phase = common.order_key(f"{seed}-phase", F.col("__source")) / F.lit(float(common.KEY_LIMIT))
    ranked = common.running_sum(rows, ["__source", "__none"], "__part", ["__key", "__tie"], F.lit(1), "__rank", "__n").select(
        "__row", "__source", "__none", "__key", "__tie", ((F.col("__rank") - phase) / F.col("__n")).alias("__at")
    )
    ranked = written(ranked.withColumn("__bin", F.floor(F.col("__at") * n).cast("int")).withColumn("__all", F.lit(0)), "shard-ranks")
    placed = common.running_sum(ranked, ["__all"], "__bin", ["__at", "__none", "__source", "__key", "__tie"], F.lit(1), "__place", "__total")
    place, total = F.col("__place") - 1, F.col("__total")
    size, longer = F.floor(total / n_shards), F.pmod(total, F.lit(n_shards))
    edge = longer * (size + 1)
    number = F.when(place < edge, F.floor(place / (size + 1))).otherwise(longer + F.floor((place - edge) / F.greatest(size, F.lit(1))))
    slot = F.when(place < edge, F.pmod(place, size + 1)).otherwise(F.pmod(place - edge, F.greatest(size, F.lit(1))))
    return placed.select("__row.*", number.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, rows_per_file: int = 100_000, **options) -> None:
    """The documents as one folder of files per shard; a file holds a stretch of slots, in order.

    A shard is written by as many tasks as it has stretches of ``rows_per_file`` slots. An empty table leaves an empty
    table; null values are written as they are; columns named ``shard`` or ``slot`` are replaced.
    """
    done = shard(docs, **options)
    longest = done.agg(F.max("slot"), F.max("shard")).first()
    per_shard = (longest[0] or 0) // rows_per_file + 1
    stretch = F.col("shard") * per_shard + F.floor(F.col("slot") / rows_per_file)
    dealt = done.repartitionById(per_shard * ((longest[1] or 0) + 1), stretch.cast("int"))
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 shards. Law ``rows``; a null text counts as empty, so its size is 8 and its CRC 0."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


# The CRC is taken a nibble at a time, low one first, from a table of 16 made by its rule.
OP9_SQL = r"""
WITH t AS (SELECT list_transform(range(16), lambda x: list_reduce([x, 0, 0, 0, 0], lambda c, i: xor(c >> 1, (c & 1) * 3988292384))) AS t),
p AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
b AS (SELECT text, hex(encode(text)) AS h FROM (SELECT DISTINCT text FROM p)),
crc AS (
  SELECT text, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT),
                   lambda c, x: xor(xor(c >> 4, t[((xor(c, x) & 15) + 1)::INT]) >> 4,
                     t[((xor(xor(c >> 4, t[((xor(c, x) & 15) + 1)::INT]), x >> 4) & 15) + 1)::INT])), 4294967295) AS crc FROM b, t),
d AS (SELECT doc_id, source, strlen(text) + 8 AS size, crc,
  ('0x' || substr(md5('shard-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS k FROM p JOIN crc USING (text)),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k) AS rank, count(*) OVER (PARTITION BY source) AS n,
             ('0x' || substr(md5('shard-1-phase:' || coalesce(source, '')), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS phase FROM d),
o AS (SELECT *, row_number() OVER (ORDER BY (rank - phase) / n, source IS NULL, source, k) - 1 AS place, count(*) OVER () AS total FROM r),
e AS (SELECT *, total // 24 AS size_, total % 24 AS longer, (total % 24) * (total // 24 + 1) AS edge FROM o)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, source, NULL::INT AS grown_shard,
       (CASE WHEN place < edge THEN place // (size_ + 1) ELSE longer + (place - edge) // greatest(size_, 1) END)::INT AS shard,
       (CASE WHEN place < edge THEN place % (size_ + 1) ELSE (place - edge) % greatest(size_, 1) END)::BIGINT AS slot
FROM e
"""
