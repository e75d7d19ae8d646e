"""Outdated versions, licence policy and integrity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depchron.functions import names
from depchron.functions.versions import update_type, version_key
from depchron.sources.work import written


def with_purl(state: DataFrame) -> DataFrame:
    """Adds ``purl``: the stored one if there is one, else built from ecosystem and name."""
    built = names.purl(F.col("ecosystem"), F.col("name"))
    return state.withColumn("purl", F.coalesce(F.nullif("purl", F.lit("")), built) if "purl" in state.columns else built)


def one_per_package(state: DataFrame) -> DataFrame:
    """The first dependency of each package URL in each branch, by path and name."""
    first = Window.partitionBy("branch_id", "purl").orderBy("path", "name")
    return state.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def version_ranks(versions: DataFrame) -> DataFrame:
    """(ecosystem, name, version, rank): each distinct version's place in its package's order, from 1; versions that are equal share one.

    Texts that are no version of the ecosystem have none. With ranks, versions compare as integers.
    """
    keyed = versions.select("ecosystem", "name", "version").distinct().withColumn("__k", version_key(F.col("version"), F.col("ecosystem")))
    rank = F.dense_rank().over(Window.partitionBy("ecosystem", "name").orderBy("__k"))
    return keyed.filter("__k IS NOT NULL").withColumn("rank", rank).drop("__k")


#: Distinct texts of versions up to which each is parsed once and sent to all tasks; more are parsed where they are.
TEXTS = 100_000


def version_texts(versions: DataFrame, most: int = TEXTS) -> DataFrame | None:
    """(ecosystem, version, place, rank, epoch, major, minor): the distinct texts of an ecosystem, each parsed once; none if there are more than ``most``.

    Texts compare by ``rank``, which equal versions share; ``place`` is a number of their own in the same order, of equal versions by text. Both are null where a text is no version.
    """
    once = written(versions.select("ecosystem", "version").filter("ecosystem IS NOT NULL AND version IS NOT NULL").distinct(), "texts")
    if once.count() > most:
        return None
    by_ecosystem = Window.partitionBy("ecosystem", F.col("k").isNull())
    number = lambda i: F.coalesce(F.get("k.numbers", F.lit(i)), F.lit(0))
    placed = once.withColumn("k", version_key(F.col("version"), F.col("ecosystem"))).select(
        "ecosystem", "version", F.when(F.col("k").isNotNull(), F.row_number().over(by_ecosystem.orderBy("k", "version"))).alias("place"),
        F.when(F.col("k").isNotNull(), F.dense_rank().over(by_ecosystem.orderBy("k"))).alias("rank"), F.col("k.epoch").alias("epoch"), number(0).alias("major"), number(1).alias("minor")
    )
    return F.broadcast(written(placed, "texts"))


def _keyed(versions: DataFrame) -> DataFrame:
    return versions.withColumn("__k", version_key(F.col("version"), F.col("ecosystem"))).filter("__k IS NOT NULL")


def _named(latest: DataFrame, texts: DataFrame) -> DataFrame:
    """The text of each package's greatest ``place``."""
    return latest.join(texts.select("ecosystem", "place", F.col("version").alias("latest_version")), ["ecosystem", "place"]).drop("place")


def latest_versions(versions: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(ecosystem, name, latest_version, n_versions): the greatest version of each package, of equal ones the greatest text; texts that are no version don't count.

    With ``texts`` (``version_texts`` of these versions or more), versions compare as integers.
    """
    if texts is None:
        return _keyed(versions).groupBy("ecosystem", "name").agg(
            F.max_by("version", F.struct("__k", "version")).alias("latest_version"), F.count(F.lit(1)).alias("n_versions")
        )
    placed = versions.join(texts.select("ecosystem", "version", "place"), ["ecosystem", "version"]).filter("place IS NOT NULL")
    latest = placed.groupBy("ecosystem", "name").agg(F.max("place").alias("place"), F.count(F.lit(1)).alias("n_versions"))
    return _named(latest, texts).select("ecosystem", "name", "latest_version", "n_versions")


def latest_at(versions: DataFrame, date: str, texts: DataFrame | None = None) -> DataFrame:
    """The version of each package published last on or before a date; of equals the greatest. ``texts`` as in ``latest_versions``."""
    past = versions.filter(F.col("published_at") <= F.lit(date).cast("timestamp_ntz"))
    if texts is None:
        last = F.struct("published_at", version_key(F.col("version"), F.col("ecosystem")), "version")
        return past.groupBy("ecosystem", "name").agg(F.max_by("version", last).alias("latest_version"))
    # a text that is no version comes before those that are, of several the greatest: it has no place, so it goes by its own text
    own = past.join(texts.select("ecosystem", "version", "place"), ["ecosystem", "version"], "left")
    last = F.max(F.struct("published_at", "place", F.when(F.col("place").isNull(), F.col("version")).alias("version"))).alias("l")
    found = own.groupBy("ecosystem", "name").agg(last).select("ecosystem", "name", "l.place", F.col("l.version").alias("text"))
    of = texts.select("ecosystem", "place", "version")
    return found.join(of, ["ecosystem", "place"], "left").select("ecosystem", "name", F.coalesce("version", "text").alias("latest_version"))


def outdated(state: DataFrame, latest: DataFrame, major_only: bool = False, minor_up: bool = False, texts: DataFrame | None = None) -> DataFrame:
    """Lockfile dependencies, every one, whose latest version is greater in its ecosystem's order, with ``update`` as major, minor or patch.

    With ``texts`` (``version_texts``), a version that is among them isn't parsed again.
    """
    rows = state.filter("kind = 'lockfile'").join(latest.select("ecosystem", "name", "latest_version"), ["ecosystem", "name"])
    update = update_type(F.col("version"), F.col("latest_version"), F.col("ecosystem"))
    if texts is not None:
        of = lambda column, name: texts.select("ecosystem", F.col("version").alias(column), F.struct("rank", "epoch", "major", "minor").alias(name))
        rows = rows.join(of("version", "__a"), ["ecosystem", "version"], "left").join(of("latest_version", "__b"), ["ecosystem", "latest_version"], "left")
        a, b = F.col("__a"), F.col("__b")
        step = F.when((b["epoch"] > a["epoch"]) | (b["major"] > a["major"]), "major").when(b["minor"] > a["minor"], "minor").otherwise("patch")
        update = F.when(a.isNotNull() & b.isNotNull(), F.when(b["rank"] > a["rank"], step)).otherwise(update)
    rows = rows.withColumn("update", update).drop("__a", "__b").filter("update IS NOT NULL")
    if major_only:
        rows = rows.filter("update = 'major'")
    return rows.filter("update <> 'patch'") if minor_up else rows


def _in(values: list[str] | tuple[str, ...], column: Column) -> Column:
    return F.array_contains(F.array(*map(F.lit, values)), column) if values else F.lit(False)


def licenses(
    state: DataFrame, packages: DataFrame, allow: list[str] = (), deny: list[str] = (), permissive: bool = False, copyleft: bool = False,
    unknown: bool = False
) -> DataFrame:
    """Direct dependencies with ``license`` (``Unknown`` without one), ``flagged`` and ``reason``: of several reasons the last of allow, deny, permissive, copyleft."""
    rows = state.filter("kind = 'manifest'").join(
        packages.select("ecosystem", "name", F.nullif("license", F.lit("")).alias("__l")), ["ecosystem", "name"], "left"
    )
    lic, low = F.col("__l"), F.lower("__l")
    text = lambda what: F.concat(F.lit('license "'), lic, F.lit(f'" {what}'))
    checks = [F.when(lic.isNull() & F.lit(unknown), "unknown license")]
    checks.append(F.when(F.lit(copyleft) & _in(names.COPYLEFT, lic), text("is copyleft")))
    checks.append(F.when(F.lit(permissive) & lic.isNotNull() & ~_in(names.PERMISSIVE, lic), text("is not permissive")))
    checks.append(F.when(_in([x.lower() for x in deny], low), text("is denied")))
    checks.append(F.when(lic.isNotNull() & F.lit(bool(allow)) & ~_in([x.lower() for x in allow], low), text("not in allow list")))
    reason = F.coalesce(*checks)
    return rows.withColumns({"license": F.coalesce(lic, F.lit("Unknown")), "reason": reason, "flagged": reason.isNotNull()}).drop("__l")


def licenses_grouped(rows: DataFrame) -> DataFrame:
    """(license, n, names): distinct names per licence, sorted."""
    return rows.groupBy("license").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("name")).alias("names"))


def license_violation_gate(rows: DataFrame) -> DataFrame:
    """One row: whether any dependency is flagged, and how many are."""
    return rows.agg(F.coalesce(F.bool_or("flagged"), F.lit(False)).alias("violated"), F.count_if("flagged").alias("violations"))


def enrich_licenses(state: DataFrame, packages: DataFrame) -> DataFrame:
    """State with the licence of each package, null where there is none."""
    return state.join(packages.select("ecosystem", "name", "license"), ["ecosystem", "name"], "left")


def integrity_drift(rows: DataFrame) -> DataFrame:
    """(name, version, hashes, manifests) of packages whose one version has several hashes; ``manifests`` maps manifest to hash.

    The rows of one package version meet in one aggregate, of distinct values only, combined before the shuffle.
    """
    found = rows.filter("integrity <> ''").groupBy("name", "version").agg(
        F.array_sort(F.collect_set("integrity")).alias("hashes"),
        F.array_sort(F.collect_set(F.struct("path", "integrity"))).alias("manifests")
    )
    return found.filter(F.size("hashes") > 1)


def hash_value(text: Column) -> Column:
    """A hash without its algorithm: what follows the first ``-``, else the first ``:``."""
    return F.when(text.contains("-"), F.regexp_replace(text, r"^[^-]*-", "")).otherwise(F.regexp_replace(text, r"^[^:]*:", ""))


def integrity_registry_check(state: DataFrame, versions: DataFrame, hashed: Callable[[str], Column] | None = None) -> DataFrame:
    """Each distinct (ecosystem, name, version, hash) of the state against the registry: ok, mismatch or skipped.

    Each side is dealt by version once, for the distinct rows and the join alike. ``hashed`` makes the text of a hash of the column named, where
    both sides keep something shorter that it follows from; it is made after the join.
    """
    of = hashed or F.col
    keys = ["ecosystem", "name", "version"]
    there = state.filter("version IS NOT NULL" if hashed else "integrity <> '' AND version IS NOT NULL")
    own = there.select(*keys, "integrity").repartition(*keys).distinct()
    rows = own.join(versions.select(*keys, F.col("integrity").alias("registry_integrity")), keys, "left")
    rows = rows.withColumns({c: of(c) for c in ("integrity", "registry_integrity")})
    same = hash_value(F.col("integrity")) == hash_value(F.col("registry_integrity"))
    return rows.withColumn("outcome", F.when(F.coalesce("registry_integrity", F.lit("")) == "", "skipped").when(same, "ok").otherwise("mismatch"))
