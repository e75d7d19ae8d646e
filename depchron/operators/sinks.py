"""Keeping tables: upserts, replacements, appends, increments and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depchron.operators.changes import KEY, changes


def upsert_latest(base: DataFrame, updates: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row of each key that is latest by ``by``; of equals the update's."""
    both = base.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)))
    latest = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(by), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(latest)).filter("__n = 1").drop("__n", "__new")


def replace_keys(base: DataFrame, new: DataFrame, keys: list[str], touched: DataFrame | None = None) -> DataFrame:
    """``base`` without the keys that ``touched`` (or ``new``) names, and the rows of ``new``."""
    gone = (touched if touched is not None else new).select(*keys).distinct()
    return base.join(gone, keys, "left_anti").unionByName(new)


def insert_ignore(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and the rows of ``new`` whose key it lacks; of several with one key the least by its columns, in their order."""
    row = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*row)).alias("__r")).select(*keys, "__r.*") if row else new.distinct()
    return base.unionByName(one.join(base.select(*keys), keys, "left_anti"))


def append_history(commits: DataFrame, links: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commits and branch links after a batch (branch_id, pos, sha, ...): a commit that another branch brought is only linked."""
    columns = [c for c in batch.columns if c not in ("branch_id", "pos")]
    new = insert_ignore(commits, batch.select(*columns), ["sha"])
    return new, insert_ignore(links, batch.select("branch_id", "sha", "pos"), ["branch_id", "sha"])


def write_history(table: DataFrame, path: str, batch: int) -> None:
    """Adds rows as files by branch and batch. A batch that is written again replaces what it wrote before, so a rerun leaves nothing twice."""
    rows = table.withColumn("batch", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("branch_id", "batch").parquet(path)


def high_water_mark(events: DataFrame) -> DataFrame:
    """(branch_id, pos) up to which each branch is known."""
    return events.groupBy("branch_id").agg(F.max("pos").alias("pos"))


def incremental_update(known: DataFrame, observations: DataFrame, mark: DataFrame) -> DataFrame:
    """Change events after the high-water mark, from the last known event of each key and the observations after it.

    The history before the mark is reduced to one row per key before it meets the new observations.
    """
    row = [c for c in observations.columns if c not in KEY]
    seed = known.groupBy(*KEY).agg(F.max_by(F.struct(*row), "pos").alias("__r")).select(*KEY, "__r.*")
    marks = mark.select("branch_id", F.col("pos").alias("__mark"))
    fresh = observations.join(marks, "branch_id", "left").filter(F.col("pos") > F.coalesce("__mark", F.lit(0))).drop("__mark")
    touched = seed.join(fresh.select(*KEY).distinct(), list(KEY), "left_semi")
    events = changes(touched.unionByName(fresh.select(*touched.columns)).select(*observations.columns))
    return events.join(marks, "branch_id", "left").filter(F.col("pos") > F.coalesce("__mark", F.lit(0))).drop("__mark")


def branch_remove(links: DataFrame, branches: DataFrame) -> DataFrame:
    """Links without those of the named branches; shared commits stay linked from others."""
    return links.join(branches.select("branch_id"), "branch_id", "left_anti")


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays are joined with commas, booleans are ``yes`` or empty."""
    kind = dict(df.dtypes)
    of = lambda c: F.array_join(c, ", ") if kind[c].startswith("array") else F.when(F.col(c), "yes").otherwise("") if kind[c] == "boolean" else F.col(c)
    df.select(*[of(c).alias(c) for c in df.columns]).write.mode("overwrite").option("header", True).csv(path)
