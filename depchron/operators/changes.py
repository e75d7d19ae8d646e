"""From observed versions to change events and validity intervals.

Observations are (branch_id, pos, path, name, version, scope, integrity, ...): what commit ``pos`` of a branch says of a
package in a manifest; a null version says that it is gone. One shuffle on (branch_id, path, name) serves both ``changes``
and ``state_intervals``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from depchron.functions.order import numbered

KEY = ("branch_id", "path", "name")


def by_pos() -> WindowSpec:
    return Window.partitionBy(*KEY).orderBy("pos")


def differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def commit_log(commits: DataFrame, since: DataFrame | None = None) -> DataFrame:
    """Commits with ``pos``: numbered from 1 per branch by committer time, oldest first.

    ``since`` (branch_id, pos) leaves out what is at or before that position of its branch; numbers stay.
    """
    log = numbered(commits.withColumn("__day", F.to_date("committed_at")), ["branch_id"], "__day", ["committed_at", "commit_id"], "pos").drop("__day")
    if since is None:
        return log
    known = since.select("branch_id", F.col("pos").alias("__known"))
    return log.join(known, "branch_id", "left").filter(F.col("pos") > F.coalesce("__known", F.lit(0))).drop("__known")


def without_merges(commits: DataFrame) -> DataFrame:
    """Commits of at most one parent; ``parents`` is an array."""
    return commits.filter(F.coalesce(F.size("parents"), F.lit(0)) <= 1)


def deduplicated(observations: DataFrame, order: list[str]) -> DataFrame:
    """One observation per (branch, pos, path, name): the last by ``order``."""
    last = Window.partitionBy(*KEY, "pos").orderBy(*[F.desc(c) for c in order])
    return observations.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


def changes(observations: DataFrame, track_integrity: bool = False, known: DataFrame | None = None) -> DataFrame:
    """Observations that change something, with ``change_type`` (added, modified, removed) and ``previous_version``.

    Modified means that version or scope differ; a change of the integrity alone counts only with
    ``track_integrity``. ``requirement`` is the version, and for removals the one that was removed. ``known`` has the last
    observation of keys before these, of which those at or before it are left out.
    """
    compared = ("version", "scope", *(["integrity"] if track_integrity else []))
    before, seen = {c: F.lag(c).over(by_pos()) for c in compared}, observations
    if known is not None:
        seen = seen.join(known.select(*KEY, *[F.col(c).alias(f"__known_{c}") for c in ("pos", *compared)]), list(KEY), "left")
        seen = seen.filter("__known_pos IS NULL OR pos > __known_pos")
        first = F.row_number().over(by_pos()) == 1
        before = {c: F.when(first, F.col(f"__known_{c}")).otherwise(v) for c, v in before.items()}
    seen = seen.withColumns({f"__{c}": v for c, v in before.items()})
    moved = differs(F.col("version"), F.col("__version")) | differs(F.col("scope"), F.col("__scope"))
    if track_integrity:
        moved = moved | differs(F.col("integrity"), F.col("__integrity"))
    kind = F.when(F.col("version").isNull(), "removed").when(F.col("__version").isNull(), "added").otherwise("modified")
    return seen.filter(moved & (F.col("version").isNotNull() | F.col("__version").isNotNull())).select(
        *observations.columns,
        kind.alias("change_type"),
        F.when(F.col("version").isNotNull(), F.col("__version")).alias("previous_version"),
        F.coalesce("version", "__version").alias("requirement"),
    )


def manifest_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events between two listings of whole manifests (branch_id, pos, path, name, version, scope): ``pos`` names the commit.

    A manifest missing from ``after`` removes all its packages, one missing from ``before`` adds them.
    """
    keys = ["branch_id", "pos", "path", "name"]
    old = before.select(*keys, F.col("version").alias("old_version"), F.col("scope").alias("old_scope"), F.lit(1).alias("__old"))
    both = old.join(after.select(*keys, "version", "scope", F.lit(1).alias("__new")), keys, "full_outer")
    kind = (
        F.when(F.col("__new").isNull(), "removed").when(F.col("__old").isNull(), "added")
        .when(differs(F.col("version"), F.col("old_version")) | differs(F.col("scope"), F.col("old_scope")), "modified")
    )
    return both.withColumn("change_type", kind).filter("change_type IS NOT NULL").select(
        *keys, "change_type", F.coalesce("version", "old_version").alias("requirement"), F.when(
            F.col("change_type") == "modified", F.col("old_version")
        ).alias("previous_version")
    )


def manifest_removed(intervals: DataFrame, deletions: DataFrame) -> DataFrame:
    """A removal for every package that a deleted manifest (branch_id, pos, path) held just before ``pos``."""
    from depchron.operators.state import open_intervals

    held = open_intervals(intervals, deletions.select("branch_id", "path", (F.col("pos") - 1).alias("at")), ["branch_id", "path"])
    return held.select(
        "branch_id", (F.col("at") + 1).alias("pos"), "path", "name", F.lit("removed").alias("change_type"),
        F.col("version").alias("requirement")
    )


def state_intervals(events: DataFrame) -> DataFrame:
    """Each event opens an interval [pos_from, pos_to) that the next event of its key closes; removals open none."""
    ends = events.select(
        *KEY, "ecosystem", "kind", "version", "scope", "integrity", "change_type", F.col("pos").alias("pos_from"),
        F.lead("pos").over(by_pos()).alias("pos_to")
    )
    return ends.filter("change_type != 'removed'").drop("change_type")
