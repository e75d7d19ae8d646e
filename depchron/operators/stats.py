"""Counts over changes and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depchron.functions.names import same_text
from depchron.functions.order import numbered
from depchron.operators.history import filtered, with_commits


def commit_counts(events: DataFrame, commits: DataFrame, **filters) -> DataFrame:
    """Per branch: commits, and commits that have changes which pass the filters."""
    changed = filtered(with_commits(events, commits), **filters).groupBy("branch_id").agg(F.countDistinct("commit_id").alias("with_changes"))
    every = commits.groupBy("branch_id").agg(F.count(F.lit(1)).alias("commits"))
    return every.join(changed, "branch_id", "left").select("branch_id", "commits", F.coalesce("with_changes", F.lit(0)).alias("with_changes"))


def by_ecosystem(state: DataFrame) -> DataFrame:
    """Dependencies per ecosystem, and in all (ecosystem ``*``), in one pass."""
    rows = state.filter("ecosystem <> ''").rollup("ecosystem").agg(F.count(F.lit(1)).alias("dependencies"), F.grouping("ecosystem").alias("g"))
    return rows.select(F.when(F.col("g") == 1, "*").otherwise(F.col("ecosystem")).alias("ecosystem"), "dependencies")


def chosen(events: DataFrame, commits: DataFrame | None, filters: dict) -> DataFrame:
    """Events that pass the filters of ``history.filtered``; commits are joined only where there are any."""
    if not any(x is not None for x in filters.values()):
        return events
    kept = filtered(with_commits(events, commits), **filters)
    return kept.select(*events.columns)


def by_type(events: DataFrame, commits: DataFrame | None = None, **filters) -> DataFrame:
    """Changes that pass the filters per type, and in all (type ``*``), in one pass."""
    events = chosen(events, commits, filters)
    rows = events.rollup("change_type").agg(F.count(F.lit(1)).alias("changes"), F.grouping("change_type").alias("g"))
    return rows.select(F.when(F.col("g") == 1, "*").otherwise(F.col("change_type")).alias("change_type"), "changes")


def top_changed(events: DataFrame, k: int = 10, commits: DataFrame | None = None, **filters) -> DataFrame:
    """The k names with most changes that pass the filters; of equals the first by name."""
    events = chosen(events, commits, filters)
    return events.groupBy("name").agg(F.count(F.lit(1)).alias("changes")).orderBy(F.desc("changes"), "name").limit(k)


def top_authors(events: DataFrame, commits: DataFrame, k: int = 10, **filters) -> DataFrame:
    """The k authors of most changes that pass the filters."""
    return filtered(
        with_commits(events, commits), **filters
    ).groupBy("author_name").agg(F.count(F.lit(1)).alias("changes")).orderBy(F.desc("changes"), "author_name").limit(k)


def author_stats(events: DataFrame, commits: DataFrame, **filters) -> DataFrame:
    """Per author: commits, changes that pass the filters, and these of each type."""
    is_type = lambda t: F.count_if(F.col("change_type") == t).alias(t)
    return filtered(with_commits(events, commits), **filters).groupBy("author_name", "author_email").agg(
        F.countDistinct("commit_id").alias("commits"), F.count(F.lit(1)).alias("changes"), is_type("added"), is_type("modified"), is_type("removed")
    )


TYPES = ("added", "modified", "removed")
#: Commit numbers of a bucket of a rollup: the bits of a long.
WORD = 64


def numbered_commits(commits: DataFrame) -> DataFrame:
    """(commit_id, number): commits numbered from 0 by time, each once, so that those of a day lie close together; a day is numbered on its own."""
    once = commits.groupBy("commit_id").agg(F.min("committed_at").alias("committed_at"))
    placed = numbered(once.withColumns({"__all": F.lit(0), "__day": F.to_date("committed_at")}), ["__all"], "__day", ["committed_at", "commit_id"], "__n")
    return placed.select("commit_id", (F.col("__n") - 1).alias("number"))


def daily_rollup(events: DataFrame, commits: DataFrame) -> DataFrame:
    """Changes by day, branch, ecosystem and author, with the commits they come from as bitmaps, to be kept and merged.

    (day, branch_id, ecosystem, author_name, author_email, bucket, commits, changes, added, modified, removed): ``commits`` is a word with a bit for each
    of the 64 commit numbers of the bucket. Words of any days and groups merge by ``or``, so distinct commits over any range are exact without its changes;
    an author of one commit has a word and not a bitmap of 4 KB.
    """
    rows = with_commits(events, commits).join(numbered_commits(commits), "commit_id")
    of = lambda t: F.count_if(F.col("change_type") == t).alias(t)
    return rows.groupBy(
        F.to_date("committed_at").alias("day"), "branch_id", "ecosystem", "author_name", "author_email", F.floor(F.col("number") / WORD).alias("bucket")
    ).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(number % {WORD} AS INT))")).alias("commits"), F.count(F.lit(1)).alias("changes"), *map(of, TYPES)
    )


def _days(rollup: DataFrame, ecosystem: str | None, author: str | None, since: str | None, until: str | None) -> DataFrame:
    """The rows of a rollup from the day ``since`` to the day ``until``, both included, of an ecosystem and an author (part of name or email)."""
    conditions: list[Column] = []
    if since:
        conditions.append(F.col("day") >= F.lit(since).cast("date"))
    if until:
        conditions.append(F.col("day") <= F.lit(until).cast("date"))
    if ecosystem:
        conditions.append(same_text(F.col("ecosystem"), ecosystem))
    if author:
        conditions.append(F.col("author_name").ilike(f"%{author}%") | F.col("author_email").ilike(f"%{author}%"))
    for c in conditions:
        rollup = rollup.filter(c)
    return rollup


def _distinct(rows: DataFrame, keys: list[str], name: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """Distinct commits by ``keys``: the words of each bucket are merged, their bits counted and added up."""
    merged = rows.groupBy(*keys, "bucket").agg(F.bit_or("commits").alias("commits"), *[F.sum(c).alias(c) for c in sums])
    return merged.groupBy(*keys).agg(F.sum(F.bit_count("commits")).alias(name), *[F.sum(c).alias(c) for c in sums])


def rolled_author_stats(
    rollup: DataFrame, ecosystem: str | None = None, author: str | None = None, since: str | None = None, until: str | None = None
) -> DataFrame:
    """``author_stats`` for whole days, from a daily rollup: no change is read."""
    return _distinct(_days(rollup, ecosystem, author, since, until), ["author_name", "author_email"], "commits", ("changes", *TYPES))


def rolled_commit_counts(
    rollup: DataFrame, commits: DataFrame, ecosystem: str | None = None, author: str | None = None, since: str | None = None, until: str | None = None
) -> DataFrame:
    """``commit_counts`` for whole days, from a daily rollup and the commits."""
    changed = _distinct(_days(rollup, ecosystem, author, since, until), ["branch_id"], "with_changes")
    every = commits.groupBy("branch_id").agg(F.count(F.lit(1)).alias("commits"))
    return every.join(changed, "branch_id", "left").select("branch_id", "commits", F.coalesce("with_changes", F.lit(0)).alias("with_changes"))


def manifest_change_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("path", "ecosystem").agg(F.count(F.lit(1)).alias("changes"))


def branch_rollup(events: DataFrame) -> DataFrame:
    """Changes for all groupings of branch, ecosystem and type in one pass; ``g`` has a bit for each column left out."""
    return events.cube("branch_id", "ecosystem", "change_type").agg(F.count(F.lit(1)).alias("changes"), F.grouping_id().alias("g"))


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of each table."""
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out


def ecosystems(*tables: DataFrame) -> DataFrame:
    """Distinct non-empty ecosystems of all tables."""
    out = tables[0].select("ecosystem")
    for other in tables[1:]:
        out = out.union(other.select("ecosystem"))
    return out.filter("ecosystem <> ''").distinct()


def branch_list(branches: DataFrame, commits: DataFrame) -> DataFrame:
    """Branches with their commits, those without any included."""
    counts = commits.groupBy("branch_id").agg(F.count(F.lit(1)).alias("commits"))
    return branches.join(counts, "branch_id", "left").select("branch_id", "branch", F.coalesce("commits", F.lit(0)).alias("commits"))


def default_branch(branches: DataFrame, commits: DataFrame) -> DataFrame:
    """The branch of the lowest id, its last position and the commit there."""
    first = branches.agg(F.min(F.struct("branch_id", "branch")).alias("b")).select("b.*")
    head = commits.join(first, ["branch_id", "branch"], "left_semi").groupBy("branch_id").agg(F.max(F.struct("pos", "sha")).alias("h"))
    return first.join(head, "branch_id", "left").select("branch_id", "branch", "h.pos", "h.sha")
