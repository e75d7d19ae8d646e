"""Manifests and lockfiles of npm and Ruby: every dependency at any depth, by its real name.

A file is parsed where it lies: its text is never shuffled, and nothing is joined. Older lockfiles nest packages in packages; they are read
as VARIANT values, a level at a time: what a level holds is written once, and the next one is taken from the few entries that
have packages of their own, until none has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depchron.sources.work import written

# Manifests by base name -> (ecosystem, kind).
FILES = {"package.json": ("npm", "manifest"), "package-lock.json": ("npm", "lockfile"), "Gemfile": ("gem", "manifest"), "Gemfile.lock": ("gem", "lockfile")}
SCOPES = {"dependencies": "runtime", "devDependencies": "development", "optionalDependencies": "optional", "peerDependencies": "peer"}
NPM = ", ".join(f"{c} map<string,string>" for c in SCOPES)
PACKAGE = "struct<name:string,version:string,integrity:string,dev:boolean,devOptional:boolean,optional:boolean,link:boolean,resolved:string>"
#: A line such as: gem "name", "requirement", "requirement", option: value
GEM = r"""(?m)^[ \t]*gem[ \t(]+["']([^"'\n]+)["']([^\n#]*)"""
#: A block of gems of some groups; it ends at the ``end`` that is indented as its beginning.
GROUP = r"(?ms)^([ \t]*)group[ \t(]+([^\n]*?)\)?[ \t]+do\b[^\n]*\n(.*?)^\1end\b"
INLINE = r":?groups?(?::|[ \t]*=>)[ \t]*(\[[^\]]*\]|:\w+)"
#: A line of a lockfile's specs: four spaces, name (version); deeper lines are requirements of these. A version has no hyphen; a platform follows one.
SPEC = r"(?m)^ {4}([^\s(]+) \(([^)\n]+)\)[ \t]*$"
ENTRY = "array<struct<name:string,requirement:string,scope:string,integrity:string,location:string>>"


def none() -> Column:
    return F.lit(None).cast("string")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def of_file(name: Column, i: int) -> Column:
    """Ecosystem (0) or kind (1) by base name."""
    return reduce(lambda rest, x: F.when(name == x[0], x[1][i]).otherwise(rest), FILES.items(), none())


def _row(name: Column, requirement: Column, scope: Column, integrity: Column | None = None, location: Column | None = None) -> Column:
    integrity, location = none() if integrity is None else integrity, none() if location is None else location
    return F.struct(
        name.alias("name"), requirement.alias("requirement"), scope.alias("scope"), integrity.alias("integrity"), location.alias("location")
    )


def real(name: Column, value: Column) -> tuple[Column, Column]:
    """(name, requirement) behind an alias such as ``npm:real@^1.0``; others as they are."""
    alias = value.startswith("npm:")
    rest = F.substring(value, F.lit(5), F.length(value))
    at = F.regexp_extract(rest, r"^(@?[^@]+)(?:@(.*))?$", 1), F.regexp_extract(rest, r"^(@?[^@]+)(?:@(.*))?$", 2)
    return F.when(alias, at[0]).otherwise(name), F.when(alias, F.nullif(at[1], F.lit(""))).otherwise(value)


def npm_scope(dev: Column, dev_optional: Column, optional: Column) -> Column:
    return F.when(dev | dev_optional, "development").when(optional, "optional").otherwise("runtime")


def declared(text: Column) -> Column:
    """The requirements of a package.json, all four lists."""
    npm = F.from_json(text, NPM)
    listed = lambda c: F.coalesce(F.map_entries(npm[c]), F.array().cast("array<struct<key:string,value:string>>"))
    of_scope = lambda c, s: F.transform(listed(c), lambda e: _row(*real(e["key"], e["value"]), F.lit(s)))
    return F.concat(*[of_scope(c, s) for c, s in SCOPES.items()])


def installed(text: Column) -> Column:
    """The packages of a lockfile that lists them by folder, nested ones included.

    The root and the folders of workspaces are no dependencies; a link to one has the version of its target.
    """
    packages = F.from_json(text, f"packages map<string,{PACKAGE}>")["packages"]
    all_ = F.coalesce(F.map_entries(packages), F.array().cast(f"array<struct<key:string,value:{PACKAGE}>>"))

    def one(e: Column) -> Column:
        v = e["value"]
        target = F.when(v["link"], F.try_element_at(packages, v["resolved"])["version"])
        name = F.coalesce(v["name"], F.regexp_replace(e["key"], "^.*node_modules/", ""))
        return _row(name, F.coalesce(v["version"], target), npm_scope(v["dev"], v["devOptional"], v["optional"]), v["integrity"], e["key"])

    return F.transform(F.filter(all_, lambda e: e["key"].contains("node_modules/")), one)


def _gems(text: Column) -> Column:
    """array of (name, rest of the line)."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(GEM), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(GEM), F.lit(2)).alias("r"))


def gem_scope(groups: Column) -> Column:
    """development or test where all groups are these, else runtime."""
    names = F.regexp_extract_all(groups, F.lit(r":(\w+)"), F.lit(1))
    apart = (F.size(names) > 0) & F.forall(names, lambda g: g.isin("development", "test"))
    return F.when(apart & F.array_contains(names, "development"), "development").when(apart, "test").otherwise("runtime")


def bundled(text: Column) -> Column:
    """The gems of a Gemfile with all their requirements, by the groups of their line or block."""
    wanted = lambda rest: F.nullif(
        F.array_join(F.regexp_extract_all(F.regexp_extract(rest, r"""^((?:\s*,\s*["'][^"'\n]*["'](?!\s*=>))*)""", 1), F.lit(r"""["']([^"'\n]*)["']"""), F.lit(1)), ", "),
        F.lit("")
    )
    inline = lambda rest: F.regexp_extract(rest, INLINE, 1)
    scope = lambda rest, around: F.when(inline(rest) != "", gem_scope(inline(rest))).otherwise(around)
    rows = lambda body, around: F.transform(_gems(body), lambda e: _row(e["n"], wanted(e["r"]), scope(e["r"], around)))
    of_groups = F.arrays_zip(F.regexp_extract_all(text, F.lit(GROUP), F.lit(2)).alias("g"), F.regexp_extract_all(text, F.lit(GROUP), F.lit(3)).alias("b"))
    return F.concat(rows(F.regexp_replace(text, GROUP, ""), F.lit("runtime")), F.flatten(F.transform(of_groups, lambda x: rows(x["b"], gem_scope(x["g"])))))


def resolved(text: Column) -> Column:
    """The gems of a Gemfile.lock, each version once whatever its platforms."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(SPEC), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(SPEC), F.lit(2)).alias("v"))
    return F.array_distinct(F.transform(pairs, lambda e: _row(e["n"], F.regexp_replace(e["v"], "-.*$", ""), F.lit("runtime"))))


def nested(files: DataFrame) -> DataFrame:
    """(commit, path, name, requirement, scope, integrity, location) of lockfiles whose packages hold packages, level by level."""
    spark = files.sparkSession
    at = lambda c, p, kind="string": F.try_variant_get(c, p, kind)
    tree = files.select("commit", "path", F.try_parse_json("text").alias("v"))
    level = tree.filter(at("v", "$.packages", "variant").isNull()).select("commit", "path", F.lit("").alias("folder"), at("v", "$.dependencies", "variant").alias("d"))
    out = None
    while out is None or not level.isEmpty():
        each = level.lateralJoin(spark.tvf.variant_explode(F.col("d").outer())).withColumn("location", F.concat("folder", F.lit("node_modules/"), "key"))
        name, version = real(F.col("key"), at("value", "$.version"))
        each = written(
            each.select(
                "commit", "path", name.alias("name"), version.alias("requirement"),
                npm_scope(at("value", "$.dev", "boolean"), F.lit(False), at("value", "$.optional", "boolean")).alias("scope"),
                at("value", "$.integrity").alias("integrity"), "location", F.to_json(at("value", "$.dependencies", "variant")).alias("inner")
            ), "lock-level"
        )
        level = each.filter("inner IS NOT NULL").select("commit", "path", F.concat("location", F.lit("/")).alias("folder"), F.try_parse_json("inner").alias("d"))
        found = each.drop("inner")
        out = found if out is None else out.unionAll(found)
    return out


def manifests_parse(files: DataFrame) -> DataFrame:
    """(commit, path, ecosystem, kind, name, requirement, scope, integrity, location) from files (commit, path, text) of the forms in FILES.

    ``location`` is the folder of an npm package; one name may come at several. Other files, null texts and what can't be parsed give no
    rows; equal texts give equal rows at each commit.
    """
    name = basename(F.col("path"))
    known = files.filter(name.isin(*FILES)).select("commit", "path", "text")
    forms = {"package.json": declared, "package-lock.json": installed, "Gemfile": bundled, "Gemfile.lock": resolved}
    entries = reduce(lambda rest, x: F.when(name == x[0], x[1](F.col("text")).cast(ENTRY)).otherwise(rest), forms.items(), F.lit(None).cast(ENTRY))
    flat = known.select("commit", "path", F.explode(entries).alias("e")).select("commit", "path", "e.*")
    rows = flat.unionByName(nested(known.filter(name == "package-lock.json")))
    return rows.select("commit", "path", of_file(name, 0).alias("ecosystem"), of_file(name, 1).alias("kind"), "name", "requirement", "scope", "integrity", "location")


def deps_from_tree(files: DataFrame, commit: int | None = None) -> DataFrame:
    """All dependencies of one commit, or of each, from its files alone; the commit's trees are keyed by ``commit``."""
    return manifests_parse(files if commit is None else files.filter(F.col("commit") == commit))
