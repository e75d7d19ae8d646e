"""Vulnerabilities of states and over time.

One join of intervals with advisories gives hits with their own [pos_from, pos_to); what is asked over time is a projection
of these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depchron.functions.names import REPORT_SCORES, SEVERITIES, looked_up, same_text, severity_rank
from depchron.functions.order import pieces
from depchron.operators.advisories import affected
from depchron.operators.history import blame, filtered
from depchron.operators.state import open_intervals
from depchron.sources.work import written


def scan(state: DataFrame, advisories: DataFrame, min_severity: str | None = None) -> DataFrame:
    """Lockfile dependencies with a version that an advisory affects; one row per dependency and advisory, with ``rank``."""
    rows = state.filter("kind = 'lockfile' AND version <> ''")
    found = affected(rows, advisories).withColumn("rank", severity_rank(F.col("severity")))
    return found.filter(F.col("rank") <= SEVERITIES.index(min_severity)) if min_severity else found


def hits(intervals: DataFrame, advisories: DataFrame) -> DataFrame:
    """Affected intervals of lockfiles, once per interval and advisory."""
    rows = intervals.filter("kind = 'lockfile' AND version <> ''")
    return affected(rows, advisories)


def islands(found: DataFrame, keys: list[str]) -> DataFrame:
    """Hits of one key, whatever the manifest, as disjoint stretches [pos_from, pos_to): overlapping and touching ones are merged."""
    w = Window.partitionBy(*keys).orderBy("pos_from", F.coalesce("pos_to", F.lit(2**62)))
    reach = F.max(F.coalesce("pos_to", F.lit(2**62))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.select(*keys, "pos_from", "pos_to", "severity", reach.alias("__r")).withColumn(
        "__i",
        F.sum(F.when(F.col("__r").isNull() | (F.col("pos_from") > F.col("__r")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    merged = marked.groupBy(*keys, "__i").agg(
        F.min("pos_from").alias("pos_from"), F.max(F.coalesce("pos_to", F.lit(2**62))).alias("__to"), F.first("severity").alias("severity")
    )
    return merged.select(*keys, "severity", "pos_from", F.when(F.col("__to") < 2**62, F.col("__to")).alias("pos_to"))


def events(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, event): ``introduced`` where a stretch begins and ``fixed`` where it ends."""
    both = F.array(
        F.struct(F.lit("introduced").alias("event"), F.col("pos_from").alias("pos")),
        F.struct(F.lit("fixed").alias("event"), F.col("pos_to").alias("pos"))
    )
    rows = islands(found, keys).select(*keys, "severity", F.explode(both).alias("e"))
    return rows.select(*keys, "severity", "e.event", "e.pos").filter("pos IS NOT NULL")


LOG_KEY = ["branch_id", "id", "name", "version"]
PRAISE_KEY = ["branch_id", "id", "name"]


def vuln_log(
    found: DataFrame, commits: DataFrame, ecosystem: str | None = None, min_severity: str | None = None, author: str | None = None, since: str | None = None, until: str | None = None,
    only: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Per commit, what it introduced and fixed; a change between two affected versions is both.

    Filters: ecosystem and least severity of a hit, author (part of name or email) and time of a commit, ``only`` one of
    introduced and fixed; ``limit`` leaves the newest commits, of equals the first by branch.
    """
    found = found.filter(same_text(F.col("ecosystem"), ecosystem)) if ecosystem else found
    found = found.filter(severity_rank(F.col("severity")) <= SEVERITIES.index(min_severity)) if min_severity else found
    rows = events(found, LOG_KEY)
    rows = rows.filter(F.col("event") == only) if only else rows
    chosen = filtered(commits, author=author, since=since, until=until).select("branch_id", "pos", "sha", "author_name", "committed_at")
    if limit:
        newest = chosen.join(rows.select("branch_id", "pos").distinct(), ["branch_id", "pos"]).orderBy(F.desc("pos"), "branch_id").limit(limit)
        chosen = newest
    rows = rows.join(chosen, ["branch_id", "pos"])
    return rows.groupBy("branch_id", "pos", "sha", "author_name", "committed_at").agg(
        F.count_if(F.col("event") == "introduced").alias("introduced"), F.count_if(F.col("event") == "fixed").alias("fixed"),
        F.array_sort(F.collect_list(F.struct("event", "id", "name", "version"))).alias("events"),
    )


def vuln_praise(found: DataFrame, commits: DataFrame) -> DataFrame:
    """Fixes of (advisory, package) in every manifest of the branch, with the author of the commit that made them."""
    fixed = events(found, PRAISE_KEY).filter("event = 'fixed'")
    return fixed.join(commits.select("branch_id", "pos", "sha", "author_name", "committed_at"), ["branch_id", "pos"])


def vuln_praise_summary(praise: DataFrame) -> DataFrame:
    """Per author: fixes in all and by severity, and packages."""
    per = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    return praise.groupBy("author_name").agg(F.count(F.lit(1)).alias("fixes"), *per, F.countDistinct("name").alias("packages"))


def vuln_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(branch_id, id, name, version, change): ``added`` at the later state only, ``fixed`` at the earlier one only."""
    keys = ["branch_id", "id", "name", "version"]
    old, new = before.select(*keys).distinct(), after.select(*keys).distinct()
    added = new.join(old, keys, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(old.join(new, keys, "left_anti").withColumn("change", F.lit("fixed")))


def vuln_all_time(found: DataFrame) -> DataFrame:
    """Every (advisory, package, version) that ever was in a branch, with its first position."""
    return found.groupBy("branch_id", "id", "name", "version", "severity").agg(F.min("pos_from").alias("first_pos"))


def vuln_blame(state: DataFrame, advisories: DataFrame, changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Hits of a state with the commit and author that first added the dependency."""
    return blame(scan(state, advisories), changes, commits)


def vuln_exposure(blamed: DataFrame, as_of: str) -> DataFrame:
    """Blamed hits with the days from the commit that added them."""
    return blamed.withColumn("days", F.datediff(F.lit(as_of).cast("date"), F.col("committed_at").cast("date")).cast("long"))


def vuln_exposure_summary(exposed: DataFrame) -> DataFrame:
    """Per branch: hits, days in all, on average and at most, the oldest date, and hits by severity."""
    per = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    return exposed.groupBy("branch_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("days").alias("total_days"), F.round(F.avg("days"), 4).alias("mean_days"), F.max("days").alias("max_days"),
        F.min(F.col("committed_at").cast("date")).alias("oldest"), *per,
    )


def vuln_show(state: DataFrame, advisories: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Per advisory, or per one in ``ids`` (id): its package and severity, how many dependencies of the state it affects, and the first by branch and manifest."""
    asked = advisories if ids is None else advisories.join(ids.select("id").distinct(), "id", "left_semi")
    hit = scan(state, asked).groupBy("id").agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct("branch_id", "path", "name", "version")).alias("f"))
    return asked.select("id", "ecosystem", "name", "severity").join(hit, "id", "left").select(
        "id", "ecosystem", "name", "severity", F.coalesce("hits", F.lit(0)).alias("hits"), F.col("f.path").alias("first_path"),
        F.col("f.version").alias("first_version")
    )


def vuln_history(intervals: DataFrame, changes: DataFrame, advisories: DataFrame, packages: DataFrame | None = None, exposed: DataFrame | None = None) -> DataFrame:
    """For every package, or those in ``packages`` (name), at every commit that changed it: each manifest's version there and the advisories that affect it.

    ``exposed`` are the intervals that can have hits, if they are known without the others.
    """
    exposed = intervals if exposed is None else exposed
    if packages is not None:
        intervals, changes, exposed = (df.join(packages.select("name").distinct(), "name", "left_semi") for df in (intervals, changes, exposed))
    points = changes.select("branch_id", "name", F.col("pos").alias("at")).distinct()
    at = open_intervals(intervals.select("branch_id", "name", "path", "version", "pos_from", "pos_to"), points, ["branch_id", "name"])
    hit = hits(exposed, advisories).groupBy("branch_id", "path", "name", "pos_from").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return at.join(hit, ["branch_id", "path", "name", "pos_from"], "left").select(
        "branch_id", "name", "at", "path", "version", F.coalesce("ids", F.array().cast("array<string>")).alias("ids")
    )


def vuln_stats(found: DataFrame) -> DataFrame:
    """Distinct advisories per branch and severity; an empty severity is unknown."""
    return found.withColumn(
        "severity", F.coalesce(F.nullif("severity", F.lit("")), F.lit("unknown"))
    ).groupBy("branch_id", "severity").agg(F.countDistinct("id").alias("advisories"))


def vuln_sync_candidates(changes: DataFrame) -> DataFrame:
    """Packages ever seen in a lockfile."""
    return changes.filter("kind = 'lockfile'").select("ecosystem", "name").distinct()


def vuln_group_by_severity(found: DataFrame, summary: str = "summary") -> DataFrame:
    """Per severity, in rank order: hits, advisories, and the summaries clipped to 80 characters as a sorted array."""
    text = F.when(F.length(summary) > 80, F.concat(F.left(F.col(summary), F.lit(77)), F.lit("..."))).otherwise(F.col(summary))
    return found.groupBy("rank", "severity").agg(
        F.count(F.lit(1)).alias("hits"), F.countDistinct("id").alias("advisories"), F.array_sort(F.collect_set(text)).alias("summaries")
    )


def sarif_results(found: DataFrame) -> DataFrame:
    """(branch_id, rule, level, message, uri, score) of each hit."""
    return found.select(
        "branch_id", F.col("id").alias("rule"), F.when(F.col("severity").isin("critical", "high"), "error").otherwise("warning").alias("level"),
        F.concat("name", F.lit("@"), "version", F.lit(" is vulnerable")).alias("message"), F.col("path").alias("uri"), F.coalesce(
            looked_up(REPORT_SCORES, F.col("severity")), F.lit(0.0)
        ).alias("score"),
    )


#: Results of one SARIF document.
SIZE = 1000


def sarif_report(found: DataFrame, size: int = SIZE) -> DataFrame:
    """(branch_id, piece, document): SARIF 2.1.0 with each hit as a result, and each rule of the document's results once.

    A document holds up to ``size`` results, by rule; a branch with more has several, whose run properties say which of how many each is.
    """
    rows = written(sarif_results(found).withColumn("__part", F.struct("rule", "uri")), "results")
    dealt = pieces(rows, ["branch_id"], "__part", ["rule", "uri", "level", "message"], size)
    rule = F.struct(F.col("rule").alias("id"), F.struct(F.col("score").alias("security-severity")).alias("properties"))
    location = F.array(F.struct(F.struct(F.struct("uri").alias("artifactLocation")).alias("physicalLocation")))
    result = F.struct(F.col("rule").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), location.alias("locations"))
    both = dealt.groupBy("branch_id", "piece", "pieces").agg(F.array_sort(F.collect_set(rule)).alias("rules"), F.array_sort(F.collect_list(result)).alias("results"))
    driver = F.struct(F.struct(F.lit("depchron").alias("name"), F.lit("1.0.0").alias("version"), "rules").alias("driver"))
    which = F.when(F.col("pieces") > 1, F.struct((F.col("piece") + 1).alias("piece"), "pieces"))
    document = F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(driver.alias("tool"), "results", which.alias("properties"))).alias("runs"))
    return both.select("branch_id", "piece", F.to_json(document).alias("document"))
