"""Tables that are kept between runs, as folders of files: what a run changes is rewritten, and a run that is repeated leaves nothing twice.

Partitioned tables are changed a partition at a time. The history of change events is kept as batches of events, the last event of each key in
buckets, so that new observations meet the history without a shuffle of it, and the positions up to which each branch is known. These are written
last and name the version that counts: a run that fails before leaves the version before it, and is simply run again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depchron.operators.changes import KEY, changes
from depchron.operators.sinks import high_water_mark, upsert_latest
from depchron.sources.work import new_folder, written

#: Parts of a table that is upserted, which keeps the number that it began with, and the least number of buckets of the last events.
BUCKETS = 64
#: Rows per bucket of the last events that a history is dealt for.
ROWS = 500_000


def _files(spark: SparkSession, path: str):
    """The file system and path object of a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


# Partitions


def replace_partitions(new: DataFrame, path: str, keys: list[str], touched: DataFrame | None = None) -> None:
    """Replaces the partitions of a table of files that ``new`` has rows of, and empties the others that ``touched`` names; no other file is touched.

    The partitions that are named are few: each is a folder. ``new`` may come from the table itself; it is written elsewhere first.
    """
    spark = new.sparkSession
    new = written(new, "replacing")
    gone = [] if touched is None else touched.select(*keys).distinct().join(new.select(*keys).distinct(), keys, "left_anti").collect()
    dealt = new.repartition(*keys)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    drop_partitions(spark, path, [{k: r[k] for k in keys} for r in gone])


def drop_partitions(spark: SparkSession, path: str, partitions: list[dict[str, object]]) -> None:
    """Deletes the folders of these partitions (all keys of the table, or the first ones); others stay as they are."""
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for values in partitions:
        folder = "/".join(f"{k}={'__HIVE_DEFAULT_PARTITION__' if v is None else escape(str(v))}" for k, v in values.items())
        delete(spark, f"{path}/{folder}")


def upsert_table(updates: DataFrame, path: str, keys: list[str], by: str, parts: int = BUCKETS) -> None:
    """Upserts into a table of files in ``parts`` partitions by a hash of the keys: only those that get updates are read and rewritten.

    Of the rows of a key the latest by ``by`` stays, of equals the update's. Rows that are put in again change nothing.
    """
    spark = updates.sparkSession
    fresh = written(updates.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")), "updates")
    both = fresh
    if exists(spark, path):
        # a number for each part at most
        some = [r["part"] for r in fresh.select("part").distinct().collect()]
        base = spark.read.schema(fresh.schema).parquet(path).filter(F.col("part").isin(some))
        both = upsert_latest(base, fresh, keys, by)
    else:
        both = upsert_latest(fresh.limit(0), fresh, keys, by)
    replace_partitions(both, path, ["part"])


# History


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of a history, oldest first: those whose positions were written to the end."""
    files, at = _files(spark, f"{path}/marks/version=*/_SUCCESS")
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in files.globStatus(at) or [])


def _bucketed(spark: SparkSession, path: str, schema, buckets: int) -> DataFrame:
    """Bucketed files as a table of this session, so that Spark knows how their rows are dealt."""
    name = f"kept_{uuid.uuid4().hex}"
    keys = ", ".join(KEY)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def _write_bucketed(df: DataFrame, path: str, buckets: int) -> None:
    name = f"kept_{uuid.uuid4().hex}"
    delete(df.sparkSession, path)
    df.write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).format("parquet").saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # of an external table this leaves the files


def last_events(spark: SparkSession, path: str, version: int, schema, buckets: int = BUCKETS) -> DataFrame:
    """The last observation of each key as a version knows it, in buckets by the key."""
    return _bucketed(spark, f"{path}/last/version={version}", schema, buckets)


def fresh_events(last: DataFrame, fresh: DataFrame, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(events, last): the events of ``fresh`` observations after the ``last`` ones, and the last observations after them.

    ``fresh`` is dealt by key into as many partitions as ``last`` has buckets, and sorted; ``last`` is read bucket by bucket and never shuffled.
    """
    return _after(last, fresh.select(*last.columns).repartition(buckets, *KEY))


def _newest(dealt: DataFrame) -> DataFrame:
    return dealt.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in dealt.columns if c not in KEY]), "pos").alias("__new"))


def _after(last: DataFrame, dealt: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = last.join(_newest(dealt), list(KEY), "full_outer")
    newer = F.col("pos").isNull() | (F.col("__new.pos") > F.col("pos"))
    of = lambda c: F.when(newer, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c)
    kept = both.select(*KEY, *[of(c) for c in last.columns if c not in KEY])
    return changes(dealt, known=last), kept.select(*last.columns)


def update_history(observations: DataFrame, path: str, buckets: int = BUCKETS, size: int = ROWS) -> int:
    """Adds the observations after the known positions to the history at ``path``, which may be new; returns the version that counts then.

    A version has its events under ``events/batch``, the last observation of each key under ``last/version`` and, written last, the positions under
    ``marks/version``. What an earlier, failed run left of this version is replaced. Without new observations the version stays.

    There are ``buckets`` at least, and more where they would have over ``size`` rows. The new observations are dealt into them once, by a shuffle, and are read from there;
    the last ones are dealt anew only when a bucket has come to over twice ``size``.
    """
    spark = observations.sparkSession
    known = versions(spark, path)
    version = known[-1] + 1 if known else 0
    fresh = observations
    if known:
        marks = spark.read.parquet(f"{path}/marks/version={known[-1]}")
        buckets = marks.first()["buckets"] if "buckets" in marks.columns else buckets
        marks = marks.select("branch_id", "pos")
        fresh = fresh.join(marks.withColumnRenamed("pos", "__mark"), "branch_id", "left").filter(F.col("pos") > F.coalesce("__mark", F.lit(0))).drop("__mark")
    fresh = written(fresh, "fresh")
    if known and fresh.isEmpty():
        return known[-1]
    count, last = fresh.count(), last_events(spark, path, known[-1], fresh.schema, buckets) if known else None
    if known:
        count += last.count()
    if count > size * buckets * (2 if known else 1):
        buckets = -(-count // size)
        last = last.repartition(buckets, *KEY) if known else None
    folder = new_folder(spark, "dealt")
    _write_bucketed(fresh.repartition(buckets, *KEY), folder, buckets)
    dealt = _bucketed(spark, folder, fresh.schema, buckets)
    events, kept = _after(last, dealt) if known else (changes(dealt), _newest(dealt).select(*KEY, "__new.*").select(*fresh.columns))
    events.write.mode("overwrite").parquet(f"{path}/events/batch={version}")
    _write_bucketed(kept, f"{path}/last/version={version}", buckets)
    top = high_water_mark(fresh)
    if known:
        top = high_water_mark(top.unionByName(marks))
    top.withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/marks/version={version}")
    delete(spark, folder)
    for old in known[:-1]:
        delete(spark, f"{path}/last/version={old}")
    return version


def history(spark: SparkSession, path: str) -> DataFrame:
    """All change events of the versions that count."""
    return spark.read.parquet(f"{path}/events").filter(F.col("batch") <= versions(spark, path)[-1]).drop("batch")
