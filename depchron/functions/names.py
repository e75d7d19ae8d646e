"""Names of ecosystems, package URLs, severities and licences as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Package URL types, advisory names and registry hosts of ecosystems, by lower-case name.
PURL_TYPES = {
    "npm": "npm", "gem": "gem", "rubygems": "gem", "pypi": "pypi", "cargo": "cargo", "go": "golang", "golang": "golang", "maven": "maven",
    "nuget": "nuget", "composer": "composer", "packagist": "composer", "hex": "hex", "pub": "pub", "cocoapods": "cocoapods"
}
ADVISORY_NAMES = {
    "gem": "RubyGems", "rubygems": "RubyGems", "npm": "npm", "pypi": "PyPI", "cargo": "crates.io", "go": "Go", "golang": "Go",
    "maven": "Maven", "nuget": "NuGet", "composer": "Packagist", "packagist": "Packagist", "hex": "Hex", "pub": "Pub",
    "cocoapods": "CocoaPods"
}
REGISTRY_HOSTS = {
    "npm": "npmjs.org", "gem": "rubygems.org", "rubygems": "rubygems.org", "pypi": "pypi.org", "cargo": "crates.io",
    "go": "proxy.golang.org", "golang": "proxy.golang.org", "maven": "repo1.maven.org", "nuget": "nuget.org", "composer": "packagist.org",
    "packagist": "packagist.org", "hex": "hex.pm", "pub": "pub.dev", "cocoapods": "cocoapods.org"
}

# Severities in order of rank, and the score each stands for in reports.
SEVERITIES = ("critical", "high", "medium", "low", "unknown")
REPORT_SCORES = {"critical": 9.0, "high": 7.0, "medium": 4.0, "low": 1.0}

# Licences that count as permissive and as copyleft.
PERMISSIVE = (
    "MIT", "MIT License", "Apache-2.0", "Apache 2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "CC0-1.0", "Unlicense", "WTFPL",
    "Zlib", "PostgreSQL", "BlueOak-1.0.0"
)
COPYLEFT = ("GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CDDL-1.0", "GPL-2.0-only", "GPL-3.0-only")


def looked_up(table: dict[str, object], key: Column) -> Column:
    """The value for ``key`` in a short fixed table, else null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def purl(ecosystem: Column, name: Column) -> Column:
    """Package URL; null for ecosystems without a type."""
    return F.concat(F.lit("pkg:"), looked_up(PURL_TYPES, F.lower(ecosystem)), F.lit("/"), name)


def advisory_ecosystem(ecosystem: Column) -> Column:
    """The name that advisories use; names not in the table stay."""
    return F.coalesce(looked_up(ADVISORY_NAMES, F.lower(ecosystem)), ecosystem)


def ecosystem_key(ecosystem: Column) -> Column:
    """One spelling for all aliases of an ecosystem, to join on."""
    return F.lower(advisory_ecosystem(ecosystem))


def registry_host(ecosystem: Column) -> Column:
    return looked_up(REGISTRY_HOSTS, F.lower(ecosystem))


def severity_rank(severity: Column) -> Column:
    """0 for critical to 4 for unknown; ``moderate`` is medium, other words are unknown."""
    word = F.when(F.lower(severity) == "moderate", "medium").otherwise(F.lower(severity))
    return F.coalesce(looked_up({s: i for i, s in enumerate(SEVERITIES)}, word), F.lit(4))


def severity_of_score(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score.isNotNull(), "low")


def same_text(column: Column, value: str) -> Column:
    """Equality without regard to case."""
    return F.lower(column) == value.lower()


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
