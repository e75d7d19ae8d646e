"""Advisories: from OSV records to interval rows, and how versions meet intervals.

An interval row is (id, ecosystem, name, lo, hi, hi_inclusive, ...): ``lo`` null or "0" has no lower end, ``hi`` null no upper
one. ``fixed`` is exclusive, ``last_affected`` inclusive. A row without both means all versions, or those of its list
``versions`` if it has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from depchron.functions.names import ecosystem_key, severity_of_score
from depchron.functions.versions import version_key
from depchron.sources.work import written

OSV = (
    "id string, aliases array<string>, summary string, details string, published string, modified string, withdrawn string,"
    "severity array<struct<type:string,score:string>>, references array<struct<type:string,url:string>>, database_specific struct<severity:string>,"
    "affected array<struct<package:struct<ecosystem:string,name:string>,versions:array<string>,"
    "ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>>>"
)


def parsed(records: DataFrame, column: str = "record") -> DataFrame:
    """OSV records from JSON text; malformed ones are left out."""
    return records.select(F.from_json(column, OSV).alias("r")).filter("r.id IS NOT NULL").select("r.*")


def score(severity: Column) -> Column:
    """The numeric CVSS_V3 score, null if there is none or it is a vector."""
    return F.get(
        F.filter(F.transform(F.filter(severity, lambda s: s["type"] == "CVSS_V3"), lambda s: s["score"].try_cast("double")), lambda x: x.isNotNull()),
        F.lit(0)
    )


def severity_level(severity: Column, specific: Column) -> Column:
    """critical, high, medium or low by score, else the record's own word, else unknown."""
    return F.coalesce(severity_of_score(score(severity)), F.nullif(F.lower(specific), F.lit("")), F.lit("unknown"))


def advisory_table(osv: DataFrame) -> DataFrame:
    """One row per advisory."""
    return osv.select(
        "id", "aliases", severity_level(F.col("severity"), F.col("database_specific.severity")).alias("severity"), score(F.col("severity")).alias("cvss_score"),
        F.transform(F.coalesce("references", F.array().cast("array<struct<type:string,url:string>>")), lambda r: r["url"]).alias("refs"),
        "summary", "details", F.col("published").alias("published_at"), F.col("modified").alias("modified_at"), F.col("withdrawn").alias("withdrawn_at"),
    )


def range_build(events: Column) -> Column:
    """array of (lo, hi, hi_inclusive): every ``introduced`` with the end that follows it, as the events are listed."""
    none = F.lit(None).cast("string")
    row = lambda lo, hi, inclusive: F.struct(lo.alias("lo"), hi.alias("hi"), inclusive.alias("hi_inclusive"))
    start = F.struct(F.array().cast("array<struct<lo:string,hi:string,hi_inclusive:boolean>>").alias("out"), none.alias("lo"))
    closing = lambda e: F.coalesce(e["fixed"], e["last_affected"])

    def step(a: Column, e: Column) -> Column:
        opened = F.when(a["lo"].isNotNull(), F.concat(a["out"], F.array(row(a["lo"], none, F.lit(False))))).otherwise(a["out"])
        closed = F.concat(a["out"], F.array(row(a["lo"], closing(e), e["fixed"].isNull())))
        return (
            F.when(e["introduced"].isNotNull(), F.struct(opened.alias("out"), e["introduced"].alias("lo")))
            .when(closing(e).isNotNull() & a["lo"].isNotNull(), F.struct(closed.alias("out"), none.alias("lo")))
            .otherwise(F.struct(a["out"].alias("out"), a["lo"].alias("lo")))
        )

    end = lambda a: F.when(a["lo"].isNotNull(), F.concat(a["out"], F.array(row(a["lo"], none, F.lit(False))))).otherwise(a["out"])
    return F.aggregate(events, start, step, end)


def advisory_packages(osv: DataFrame) -> DataFrame:
    """Interval rows of all affected packages, with the fixed versions of the entry; entries without a usable range mean all versions."""
    entry = osv.select("id", F.explode("affected").alias("a")).select("id", "a.package.ecosystem", "a.package.name", "a.versions", "a.ranges")
    usable = F.filter(
        F.coalesce("ranges", F.array().cast("array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>")),
        lambda r: r["type"].isin("SEMVER", "ECOSYSTEM")
    )
    intervals = F.flatten(F.transform(usable, lambda r: range_build(r["events"])))
    fixed = F.filter(F.flatten(F.transform(usable, lambda r: F.transform(r["events"], lambda e: e["fixed"]))), lambda x: x.isNotNull())
    rows = entry.select("id", "ecosystem", "name", "versions", fixed.alias("fixed_versions"), F.explode_outer(intervals).alias("i"))
    return rows.select(
        "id", "ecosystem", "name", "versions", "fixed_versions", "i.lo", "i.hi",
        F.coalesce("i.hi_inclusive", F.lit(False)).alias("hi_inclusive")
    )


def in_range(
    version: Column, lo: Column, hi: Column, inclusive: Column, listed: Column | None = None, ecosystem: Column | None = None
) -> Column:
    """Whether a version is affected: it is listed, or in the interval; without interval and list every version is."""
    keys = F.struct(version_key(version, ecosystem).alias("key"), version_key(lo, ecosystem).alias("low"), version_key(hi, ecosystem).alias("high"))
    none, some = lo.isNull() & hi.isNull(), F.coalesce(F.size(listed) > 0, F.lit(False)) if listed is not None else F.lit(False)

    def inside(k: Column) -> Column:
        above = F.coalesce(lo, F.lit("0")).isin("0", "") | (k["key"] >= k["low"])
        below = hi.isNull() | (k["key"] < k["high"]) | (inclusive & (k["key"] == k["high"]))
        return F.coalesce(above & below & k["key"].isNotNull(), F.lit(False))

    # an array of one, so that each version is parsed once
    held = F.when(none, ~some).otherwise(F.transform(F.array(keys), inside)[0])
    return held | F.coalesce(F.array_contains(listed, version), F.lit(False)) if listed is not None else held


def fixed_version(fixed_versions: Column) -> Column:
    return F.get(fixed_versions, F.lit(0))


PACKAGE = ["__e", "__n"]


def _of_package(df: DataFrame) -> DataFrame:
    return df.withColumns({"__e": ecosystem_key(F.col("ecosystem")), "__n": F.lower("name")})


#: Packages with advisories up to which their hashes go to all tasks; with more, no row is left out beforehand.
PACKAGES = 2_000_000


def of_known_packages(rows: DataFrame, advisories: DataFrame, ecosystem: Column, name: Column, most: int = PACKAGES) -> DataFrame:
    """Rows without those of packages that no advisory names, where they lie: a hash of 8 bytes tells, and what it lets through beyond that has no hits later."""
    known = written(_of_package(advisories.select("ecosystem", "name")).select(F.xxhash64(*PACKAGE).alias("__h")).distinct(), "packages")
    if known.count() > most:
        return rows
    return rows.withColumn("__h", F.xxhash64(ecosystem_key(ecosystem), F.lower(name))).join(F.broadcast(known), "__h", "left_semi").drop("__h")


def swept(versions: DataFrame, entries: DataFrame) -> DataFrame:
    """(package, version, id): which of the distinct ``versions`` of a package lie in which of its intervals, by one sweep for each package.

    Versions and ends of intervals are sorted together, each key computed once; the number of versions passed so far makes an integer of every
    version and of every end. An interval is then a run of integers, and meets its versions by equality: the work goes by what is sorted and
    what comes out, never by pairs of version and interval.
    """
    free = F.coalesce("lo", F.lit("0")).isin("0", "")
    ends = entries.filter("lo IS NOT NULL OR hi IS NOT NULL").withColumns(
        {"__low": F.when(~free, version_key(F.col("lo"), F.col("__e"))), "__high": version_key(F.col("hi"), F.col("__e")), "__free": free}
    )
    ends = ends.filter((F.col("__free") | F.col("__low").isNotNull()) & (F.col("hi").isNull() | F.col("__high").isNotNull()))
    # where a point stands: before all versions (-1), at its key, after all (1); at its key before (-1) or after (1) the versions there
    point = lambda which, place, key, side: F.struct(
        F.lit(which).alias("which"), place.cast("int").alias("place"), key.alias("key"), side.cast("int").alias("side")
    )
    both = F.array(
        point("low", F.when(F.col("__free"), -1).otherwise(0), F.col("__low"), F.lit(-1)),
        point("high", F.when(F.col("hi").isNull(), 1).otherwise(0), F.col("__high"), F.when(F.coalesce("hi_inclusive", F.lit(False)), 1).otherwise(-1))
    )
    interval = F.struct("id", "lo", "hi", "hi_inclusive").alias("interval")
    points = ends.select(*PACKAGE, interval, F.explode(both).alias("p")).select(*PACKAGE, F.lit(None).cast("string").alias("version"), "interval", "p.*")
    own = versions.select(*PACKAGE, "version", version_key(F.col("version"), F.col("__e")).alias("key")).filter("key IS NOT NULL")
    at = own.select(
        *PACKAGE, "version", F.lit(None).cast(points.schema["interval"].dataType).alias("interval"), F.lit(None).cast("string").alias("which"), F.lit(0).alias("place"),
        "key", F.lit(0).alias("side")
    )
    order = Window.partitionBy(*PACKAGE).orderBy("place", "key", "side")
    new = (F.col("side") == 0) & ~(F.lag("key").over(order).eqNullSafe(F.col("key")) & F.coalesce(F.lag("side").over(order) == 0, F.lit(False)))
    passed = at.unionByName(points).withColumn("new", new.cast("long"))
    passed = written(passed.withColumn("rank", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new", "key"), "versions")
    of = lambda which: F.max(F.when(F.col("which") == which, F.col("rank")))
    runs = passed.filter("which IS NOT NULL").groupBy(*PACKAGE, "interval").agg((of("low") + 1).alias("low"), of("high").alias("high")).filter("low <= high")
    reached = runs.select(*PACKAGE, "interval.id", F.explode(F.sequence("low", "high")).alias("rank")).distinct()
    return reached.join(passed.filter("which IS NULL").select(*PACKAGE, "version", "rank"), [*PACKAGE, "rank"]).drop("rank")


def affected(rows: DataFrame, advisories: DataFrame) -> DataFrame:
    """Rows with (ecosystem, name, version) joined to the advisories that affect them, once for each advisory, however many of its intervals hold the version.

    Rows of packages without advisories are left out first; the distinct versions of the others are swept (``swept``), and rows meet
    their hits by (package, version). ``id`` and the advisory's severity are added. The list ``versions`` of an advisory counts where there is such a
    column; an entry without interval and list means all versions, those that no order knows and null too.
    """
    listed = F.col("versions") if "versions" in advisories.columns else F.lit(None).cast("array<string>")
    entries = _of_package(advisories.select("id", "ecosystem", "name", "lo", "hi", "hi_inclusive", listed.alias("listed"), "severity", "cvss_score"))
    known = entries.groupBy("id", *PACKAGE).agg(F.max("severity").alias("severity"), F.max("cvss_score").alias("cvss_score"))
    own = written(_of_package(rows).join(known.select(*PACKAGE).distinct(), PACKAGE, "left_semi"), "affected")
    versions = own.select(*PACKAGE, "version").distinct()
    some = F.coalesce(F.size("listed") > 0, F.lit(False))
    every = entries.filter(F.col("lo").isNull() & F.col("hi").isNull() & ~some).select(*PACKAGE, "id").distinct()
    named = entries.filter(some).select(*PACKAGE, "id", F.explode("listed").alias("version")).distinct()
    columns = [*PACKAGE, "version", "id"]
    hits = swept(versions, entries).select(columns).unionAll(versions.join(every, PACKAGE).select(columns)).unionAll(versions.join(named, [*PACKAGE, "version"]).select(columns))
    found = hits.distinct().join(known, ["id", *PACKAGE]).withColumnsRenamed({"__e": "__he", "__n": "__hn", "version": "__hv"})
    same = (F.col("__e") == F.col("__he")) & (F.col("__n") == F.col("__hn")) & F.col("version").eqNullSafe(F.col("__hv"))
    return own.join(found, same).select(*rows.columns, "id", "severity", "cvss_score")


def stored_vuln_count(advisories: DataFrame) -> DataFrame:
    return advisories.groupBy("ecosystem", "name").agg(F.countDistinct("id").alias("advisories"))
