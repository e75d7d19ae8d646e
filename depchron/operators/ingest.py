"""From files and dumps to canonical rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depchron.operators.manifests import basename

#: Folders whose files are not searched.
SKIPPED = r"(^|/)(\.git|node_modules|vendor)/"
#: A line such as: gem "name", "requirement"
LINE = r"""(?m)^\s*gem\s+["']([^"']+)["'](?:\s*,\s*["']([^"']+)["'])?"""


def file_change_classify(files: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """Added, modified and deleted files (status A, M, D) whose base name fits a pattern, with its (ecosystem, kind).

    ``patterns`` is a short fixed list, tried in order as one CASE expression, so the files are scanned once and
    nothing is joined.
    """
    found = reduce(
        lambda rest, x: F.when(basename(F.col("path")).rlike(x[0]), F.struct(F.lit(x[1][0]).alias("ecosystem"), F.lit(x[1][1]).alias("kind"))).otherwise(rest),
        reversed(patterns.items()), F.lit(None).cast("struct<ecosystem:string,kind:string>")
    )
    rows = files.filter(F.col("status").isin("A", "M", "D")).withColumn("__m", found).filter("__m IS NOT NULL")
    return rows.select(*files.columns, "__m.ecosystem", "__m.kind")


def manifest_parse(files: DataFrame, form: str = "json") -> DataFrame:
    """(commit, path, name, requirement) from files (commit, path, text).

    A file is parsed where it lies, so no text is shuffled and nothing is joined. JSON manifests are an object of name to requirement; line
    manifests have a declaration a line. What can't be parsed gives no rows.
    """
    if form == "json":
        return files.select("commit", "path", F.explode(F.from_json("text", "map<string,string>")).alias("name", "requirement"))
    pairs = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(LINE), F.lit(1)).alias("name"),
        F.regexp_extract_all("text", F.lit(LINE), F.lit(2)).alias("requirement")
    )
    return files.select("commit", "path", F.explode(pairs).alias("e")).select("commit", "path", "e.name", F.nullif("e.requirement", F.lit("")).alias("requirement"))


def where(texts: DataFrame, package: str, context: int = 0) -> DataFrame:
    """Lines that contain ``package`` in either case: path, ecosystem, line number from 1, the line, and the lines around it."""
    lines = F.split("text", "\n")
    rows = texts.filter(~F.col("path").rlike(SKIPPED) & F.contains(F.lower("text"), F.lit(package.lower())))
    hit = rows.select(
        "path", "ecosystem", lines.alias("lines"), F.posexplode(lines).alias("i", "line")
    ).filter(F.contains(F.lower("line"), F.lit(package.lower())))
    start = F.greatest(F.lit(1), F.col("i") + 1 - context)
    around = F.slice("lines", start, F.col("i") + 1 + context - start + 1)
    return hit.select("path", "ecosystem", (F.col("i") + 1).cast("long").alias("line_number"), "line", F.array_join(around, "\n").alias("context"))


REGISTRY = "ecosystem string, name string, latest_version string, licenses string, normalized_licenses array<string>"


def registry_ingest(records: DataFrame, column: str = "record") -> DataFrame:
    """(ecosystem, name, latest_version, license) from registry JSON: the first normalised licence, else the raw one."""
    rows = records.select(F.from_json(column, REGISTRY).alias("r")).filter("r.name IS NOT NULL").select("r.*")
    return rows.select(
        "ecosystem", "name", "latest_version",
        F.coalesce(F.get("normalized_licenses", F.lit(0)), F.nullif("licenses", F.lit(""))).alias("license")
    )


def fresh_cache_scan(wanted: DataFrame, cache: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Wanted purls with ``state``: ``fresh`` if cached within the last hours, else ``refresh``."""
    newest = cache.groupBy("purl").agg(F.max("enriched_at").alias("__at"))
    fresh = F.col("__at") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(hours)} HOURS")
    return wanted.join(newest, "purl", "left").withColumn("state", F.when(fresh, "fresh").otherwise("refresh")).drop("__at")
