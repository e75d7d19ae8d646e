"""Version order as a native key for each ecosystem, without a UDF.

A key is struct(epoch, numbers, tail): ``tail`` is an array of (rank, number, text) that sorts what comes before a release, the release itself
and what comes after it. Arrays and structs sort from the left, a beginning before what it begins, so no two keys need a comparison of
their own. Zeros at the end of the numbers don't count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMAT = r"^[vV]?[0-9]+(\.[0-9]+)*(-[0-9A-Za-z.-]+|[._]?[A-Za-z][0-9A-Za-z._-]*)?(\+.*)?$"
#: Suffixes without a hyphen: those that mean the release itself, and those that come after it; all others come before.
SAME, AFTER = r"(?i)^(final|ga|release)$", r"(?i)^(post|sp|patch)[0-9.]*$"
#: Ranks of a tail in general: identifiers of a prerelease, the release, and what follows it.
NUMBER, WORD, RELEASE, LATER = 1, 2, 5, 6

# The parts of a Python version, in lower case (epoch, numbers, prerelease, post, dev, local).
PYPI = (
    r"^v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(a|b|c|rc|alpha|beta|pre|preview)[-_.]?([0-9]*))?"
    r"(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]*))?(?:[-_.]?(dev)[-_.]?([0-9]*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?$"
)
# Qualifiers of Maven and of Composer in order; Maven's release stands before ``sp``, other words after it, numbers last.
MAVEN = ("alpha", "beta", "milestone", "rc", "snapshot", "", "sp")
COMPOSER = {"dev": 0, "alpha": 1, "a": 1, "beta": 2, "b": 2, "rc": 3, "stable": RELEASE, "patch": LATER, "pl": LATER, "p": LATER}


def part(rank: Column | int, number: Column | int = 0, text: Column | str = "") -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, (int, str)) else x
    return F.struct(as_column(rank).cast("int").alias("rank"), as_column(number).cast("bigint").alias("number"), as_column(text).alias("text"))


def numbers_of(text: Column) -> Column:
    """The numbers between dots, without zeros at the end; one that is too large is null."""
    all_ = F.transform(F.split(text, r"\."), lambda x: x.try_cast("bigint"))
    return F.slice(all_, F.lit(1), F.array_max(F.transform(all_, lambda x, i: F.when(x.isNull() | (x != 0), i + 1).otherwise(0))))


def keyed(numbers: Column, tail: Column, fits: Column, epoch: Column | None = None) -> Column:
    key = F.struct((F.lit(0) if epoch is None else epoch).cast("bigint").alias("epoch"), numbers.alias("numbers"), tail.alias("tail"))
    whole = lambda k: ~F.exists(k["numbers"], lambda x: x.isNull()) & ~F.exists(k["tail"], lambda x: x["number"].isNull()) & k["epoch"].isNotNull()
    return F.when(fits, F.get(F.filter(F.array(key), whole), F.lit(0)))


def general(version: Column) -> Column:
    """Semantic versions, and what is written like them.

    A leading ``v`` and what follows ``+`` don't count. A release sorts after its prereleases, whose identifiers compare as numbers if they are, and
    numbers before words. Suffixes without a hyphen (1.0rc1, 7.1.0.rc1, 1.0.Final, 1.0.post1) are cut into letters and numbers.
    """
    plain = F.regexp_replace(F.regexp_replace(version, r"^[vV]", ""), r"\+.*$", "")
    hyphen, loose = F.regexp_extract(plain, r"^[0-9.]+-(.*)$", 1), F.regexp_extract(plain, r"^[0-9]+(?:\.[0-9]+)*[._]?([A-Za-z].*)$", 1)
    cut = F.regexp_replace(F.regexp_replace(loose, "[._-]+", "."), "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", ".")
    suffix = F.when(loose == "", hyphen).when(loose.rlike(SAME), "").otherwise(F.lower(cut))
    words = F.transform(
        F.filter(F.split(suffix, r"\."), lambda x: x != ""),
        lambda x: F.when(x.try_cast("bigint").isNull(), part(WORD, 0, x)).otherwise(part(NUMBER, F.coalesce(x.try_cast("bigint"), F.lit(0))))
    )
    tail = F.when(suffix == "", F.array(part(RELEASE))).when(loose.rlike(AFTER), F.concat(F.array(part(LATER)), words)).otherwise(words)
    return keyed(numbers_of(F.regexp_extract(plain, r"^([0-9]+(?:\.[0-9]+)*)", 1)), tail, version.rlike(FORMAT))


def pypi(version: Column) -> Column:
    """Python versions: dev before a, b, rc, the release, then post; a dev version of any comes before it; local ones come after."""
    text = F.lower(F.trim(version))
    # one match: its groups between bars, and the parts in an array of one, so that they are split once
    groups = F.array(F.split(F.regexp_replace(text, PYPI, "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"), r"\|"))
    return F.when(text.rlike(PYPI), F.transform(groups, _pypi)[0])


def _pypi(groups: Column) -> Column:
    of = lambda i: F.get(groups, F.lit(i - 1))
    number = lambda x: F.when(x == "", 0).otherwise(x.try_cast("bigint"))
    post, dev = (of(5) != "") | (of(6) != ""), of(8) != ""
    pre = F.when(of(3) != "", part(F.when(of(3).isin("a", "alpha"), 1).when(of(3).isin("b", "beta"), 2).otherwise(3), number(of(4))))
    first = F.coalesce(pre, F.when(dev & ~post, part(0)).otherwise(part(9)))
    second = F.when(of(5) != "", part(1, number(of(5)))).when(post, part(1, number(of(7)))).otherwise(part(0))
    third = F.when(dev, part(1, number(of(9)))).otherwise(part(9))
    local = F.transform(
        F.filter(F.split(of(10), "[-_.]"), lambda x: x != ""),
        lambda x: F.when(x.rlike("^[0-9]+$"), part(2, x.try_cast("bigint"))).otherwise(part(1, 0, x))
    )
    return keyed(numbers_of(of(2)), F.concat(F.array(first, second, third), local), F.lit(True), number(of(1)))


def maven(version: Column) -> Column:
    """Maven versions: alpha, beta, milestone, rc, snapshot, the release (final, ga), sp, other words, numbers; letters and numbers are cut apart."""
    text = F.lower(version)
    rest = F.regexp_replace(text, r"^[0-9]+(?:\.[0-9]+)*", "")
    for short, word in (("a", "alpha"), ("b", "beta"), ("m", "milestone")):
        rest = F.regexp_replace(rest, rf"(?<![a-z]){short}(?=[0-9])", word)
    rest = F.regexp_replace(F.regexp_replace(rest, r"(?<![a-z])(final|ga|release)(?![a-z])", ""), r"(?<![a-z])cr(?![a-z])", "rc")
    rank = lambda x: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, MAVEN)), x), F.lit(0)), F.lit(len(MAVEN) + 1))
    parts = F.transform(
        F.regexp_extract_all(rest, F.lit("[0-9]+|[a-z]+"), F.lit(0)),
        lambda x: F.when(x.rlike("^[0-9]"), part(len(MAVEN) + 2, x.try_cast("bigint"))).otherwise(part(rank(x), 0, F.when(rank(x) > len(MAVEN), x).otherwise("")))
    )
    tail = F.concat(parts, F.array(part(MAVEN.index("") + 1)))
    return keyed(numbers_of(F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)*)", 1)), tail, text.rlike(r"^[0-9]+(\.[0-9]+)*([-._]?[0-9a-z]+)*$"))


def gem(version: Column) -> Column:
    """Ruby versions: segments of letters before numbers, what is missing counts as 0, a hyphen means ``.pre.``."""
    text = F.replace(F.trim(version), F.lit("-"), F.lit(".pre."))
    rest = F.regexp_replace(F.regexp_replace(text, r"^[0-9]+(?:\.[0-9]+)*", ""), r"(\.0+)+$", "")
    parts = F.transform(
        F.regexp_extract_all(rest, F.lit("[0-9]+|[A-Za-z]+"), F.lit(0)),
        lambda x: F.when(x.rlike("^[0-9]"), part(2, x.try_cast("bigint"))).otherwise(part(1, 0, x))
    )
    fits = text.rlike(r"^[0-9]+(\.[0-9A-Za-z]+)*$") | text.rlike(r"^[0-9]+(\.[0-9]+)*[A-Za-z][0-9A-Za-z.]*$")
    return keyed(numbers_of(F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)*)", 1)), F.concat(parts, F.array(part(2))), fits)


def composer(version: Column) -> Column:
    """PHP versions: dev, alpha, beta, rc, the release, patch; other suffixes as in general."""
    text = F.lower(version)
    own = r"^v?([0-9]+(?:\.[0-9]+)*)[-_.+]?(stable|beta|b|rc|alpha|a|patch|pl|p|dev)[-.]?([0-9]*)$"
    word, number = F.regexp_extract(text, own, 2), F.regexp_extract(text, own, 3)
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in COMPOSER.items() for x in kv]), word)
    tail = F.array(part(rank, F.when(rank == RELEASE, 0).when(number == "", 0).otherwise(number.try_cast("bigint"))))
    return F.coalesce(keyed(numbers_of(F.regexp_extract(text, own, 1)), tail, text.rlike(own)), general(version))


def version_key(version: Column, ecosystem: Column | None = None) -> Column:
    """A key that sorts as versions of the ecosystem do, of whatever alias or case; null if the text is no version there.

    Without an ecosystem, and for those without an order of their own (npm, Cargo, Go, Hex, Pub), versions are semantic ones.
    """
    if ecosystem is None:
        return general(version)
    name = F.lower(ecosystem)
    return (
        F.when(name == "pypi", pypi(version))
        .when(name == "maven", maven(version))
        .when(name.isin("gem", "rubygems", "cocoapods"), gem(version))
        .when(name.isin("composer", "packagist"), composer(version))
        .when(name == "nuget", general(F.lower(version)))
        .otherwise(general(version))
    )


def update_type(current: Column, latest: Column, ecosystem: Column | None = None) -> Column:
    """major, minor or patch for a newer ``latest``; a release after its prerelease is a patch; else null."""

    def between(a: Column, b: Column) -> Column:
        at = lambda k, i: F.coalesce(F.get(k["numbers"], F.lit(i)), F.lit(0))
        step = F.when(b["epoch"] > a["epoch"], "major").when(at(b, 0) > at(a, 0), "major").when(at(b, 1) > at(a, 1), "minor").otherwise("patch")
        return F.when(b > a, step)

    # an array of one, so that each version is parsed once
    keys = F.array(F.struct(version_key(current, ecosystem).alias("a"), version_key(latest, ecosystem).alias("b")))
    return F.transform(keys, lambda k: between(k["a"], k["b"]))[0]
