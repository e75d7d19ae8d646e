"""History and attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depchron.functions.names import same_text

PACKAGE = ("branch_id", "path", "name")


def with_commits(events: DataFrame, commits: DataFrame) -> DataFrame:
    """Events with the sha, message, author and time of their commit."""
    return events.join(commits.select("commit_id", "branch_id", "sha", "message", "author_name", "author_email", "committed_at"), ["commit_id", "branch_id"])


def filtered(
    rows: DataFrame, branch_id: int | None = None, ecosystem: str | None = None, author: str | None = None, since: str | None = None,
    until: str | None = None
) -> DataFrame:
    """Rows of ``with_commits`` by branch, ecosystem, author (part of name or email, in either case) and time."""
    conditions: list[Column] = []
    if branch_id is not None:
        conditions.append(F.col("branch_id") == branch_id)
    if ecosystem:
        conditions.append(same_text(F.col("ecosystem"), ecosystem))
    if author:
        conditions.append(F.col("author_name").ilike(f"%{author}%") | F.col("author_email").ilike(f"%{author}%"))
    if since:
        conditions.append(F.col("committed_at") >= F.lit(since).cast("timestamp_ntz"))
    if until:
        conditions.append(F.col("committed_at") <= F.lit(until).cast("timestamp_ntz"))
    for c in conditions:
        rows = rows.filter(c)
    return rows


def log(events: DataFrame, commits: DataFrame, limit: int | None = 50, **filters) -> DataFrame:
    """Commits with changes that pass the filters, newest first, with their changes as a sorted array.

    The newest commits are chosen before their changes are gathered.
    """
    rows = filtered(with_commits(events, commits), **filters)
    chosen = rows.select("branch_id", "commit_id", "pos").distinct().orderBy(F.desc("pos"), "branch_id")
    chosen = chosen.limit(limit) if limit else chosen
    picked = rows.join(chosen.select("branch_id", "commit_id"), ["branch_id", "commit_id"], "left_semi")
    return picked.groupBy("branch_id", "pos", "sha", "message", "author_name", "committed_at").agg(
        F.array_sort(F.collect_list(F.struct("path", "name", "change_type", "requirement"))).alias("changes")
    )


def history(events: DataFrame, commits: DataFrame, package: str | None = None, **filters) -> DataFrame:
    """Change rows of the packages whose name contains ``package``, in either case."""
    rows = filtered(with_commits(events, commits), **filters)
    return rows.filter(F.col("name").ilike(f"%{package}%")) if package else rows


def why(events: DataFrame, commits: DataFrame, package: str | None = None, ecosystem: str | None = None) -> DataFrame:
    """The first addition of a package, or of each, per branch; of several manifests the first by path."""
    rows = events.filter("change_type = 'added'")
    rows = rows.filter(F.col("name") == package) if package else rows
    rows = rows.filter(same_text(F.col("ecosystem"), ecosystem)) if ecosystem else rows
    first = rows.groupBy("branch_id", "name").agg(F.min(F.struct("pos", "path", "commit_id")).alias("f")).select("branch_id", "name", "f.*")
    return with_commits(first, commits)


def first_added(events: DataFrame) -> DataFrame:
    """(branch_id, path, name, pos, commit_id) of the earliest addition ever."""
    added = events.filter("change_type = 'added'").groupBy(*PACKAGE).agg(F.min(F.struct("pos", "commit_id")).alias("f"))
    return added.select(*PACKAGE, "f.*")


def blame(state: DataFrame, events: DataFrame, commits: DataFrame) -> DataFrame:
    """Who first added each dependency of ``state``; one that was never added has no row."""
    return with_commits(state.join(first_added(events), list(PACKAGE)), commits)


def blame_current(state: DataFrame, events: DataFrame, commits: DataFrame) -> DataFrame:
    """Who began the present, uninterrupted life of each dependency of ``state``."""
    added = events.filter("change_type = 'added'").groupBy(*PACKAGE).agg(F.max(F.struct("pos", "commit_id")).alias("f"))
    return with_commits(state.join(added.select(*PACKAGE, "f.*"), list(PACKAGE)), commits)


def stale(state: DataFrame, events: DataFrame, commits: DataFrame, as_of: str, days: int = 0) -> DataFrame:
    """Lockfile dependencies by days since their last change, at least ``days``; without a change they count from 2000."""
    when = events.join(commits.select("commit_id", "branch_id", "committed_at"), ["commit_id", "branch_id"])
    last = when.groupBy(*PACKAGE).agg(F.max("committed_at").alias("last_changed"))
    rows = state.filter("kind = 'lockfile'").join(last, list(PACKAGE), "left")
    age = F.datediff(F.lit(as_of).cast("date"), F.coalesce(F.col("last_changed").cast("date"), F.lit("2000-01-01").cast("date")))
    return rows.withColumn("days", age.cast("long")).filter(F.col("days") >= days)


def search(state: DataFrame, events: DataFrame, commits: DataFrame, pattern: str, direct: bool = False) -> DataFrame:
    """Dependencies of ``state`` whose name contains ``pattern``, with first and last change of that name and the commit that first added it."""
    rows = state.filter(F.col("name").ilike(f"%{pattern}%"))
    rows = rows.filter("kind = 'manifest'") if direct else rows
    seen = with_commits(events.filter(F.col("name").ilike(f"%{pattern}%")), commits)
    by_name = seen.groupBy("branch_id", "name").agg(
        F.min("committed_at").alias("first_seen"), F.max("committed_at").alias("last_changed"), F.min_by(
            "sha", F.when(F.col("change_type") == "added", F.col("pos"))
        ).alias("added_in")
    )
    return rows.join(by_name, ["branch_id", "name"], "left")
