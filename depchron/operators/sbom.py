"""Bills of materials as documents of bounded size: a branch with more components has several, each whole by itself and numbered by ``piece``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depchron.functions.order import pieces
from depchron.operators.policy import enrich_licenses, with_purl
from depchron.sources.work import written

TOOL = "depchron"
#: Components of one document.
SIZE = 2000


def components(state: DataFrame, packages: DataFrame) -> DataFrame:
    """(branch_id, path, name, version, purl, license), what both document formats list."""
    return enrich_licenses(with_purl(state), packages).select("branch_id", "path", "name", "version", "purl", "license")


def _dealt(parts: DataFrame, size: int) -> DataFrame:
    """Components with their place in the branch by path and name, in runs of ``size``; manifests with many packages are numbered by the beginnings of names."""
    parts = written(parts.withColumn("__part", F.struct("path", F.left(F.col("name"), F.lit(6)).alias("start"))), "components")
    return pieces(parts, ["branch_id"], "__part", ["path", "name", "version"], size)


def _which(text: str = "") -> Column:
    """``2 of 7`` where a branch has several documents, else null."""
    return F.when(F.col("pieces") > 1, F.concat(F.lit(text), (F.col("piece") + 1).cast("string"), F.lit(" of "), F.col("pieces").cast("string")))


def sbom_cyclonedx(parts: DataFrame, created: str, form: str = "json", size: int = SIZE) -> DataFrame:
    """(branch_id, piece, document): CycloneDX 1.5 as JSON, or XML with ``form='xml'``.

    A document lists up to ``size`` components, by path and name. Where a branch has several, a property of each says which of how many it is.
    """
    licenses = F.when(F.col("license").isNotNull(), F.array(F.struct(F.struct(F.col("license").alias("id")).alias("license"))))
    component = F.struct(F.lit("library").alias("type"), F.col("purl").alias("bom-ref"), "name", "version", "purl", licenses.alias("licenses"))
    listed = _dealt(parts, size).groupBy("branch_id", "piece", "pieces").agg(F.array_sort(F.collect_list(F.struct("number", component.alias("c")))).alias("all"))
    of = f"{TOOL}:piece"
    meta = F.struct(
        F.lit(created).alias("timestamp"),
        F.array(F.struct(F.lit(TOOL).alias("vendor"), F.lit(TOOL).alias("name"), F.lit("1.0.0").alias("version"))).alias("tools"),
        F.when(_which().isNotNull(), F.array(F.struct(F.lit(of).alias("name"), _which().alias("value")))).alias("properties")
    )
    document = F.struct(
        F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version"), meta.alias("metadata"), F.transform("all", lambda x: x["c"]).alias("components")
    )
    if form == "xml":
        # names with an underscore are attributes; a null is left out
        licensed = lambda c: F.when(c["licenses"].isNotNull(), F.struct(F.transform(c["licenses"], lambda x: x["license"]).alias("license")))
        part = lambda c: F.struct(
            c["type"].alias("_type"), c["bom-ref"].alias("_bom-ref"), c["name"].alias("name"), c["version"].alias("version"), licensed(c).alias("licenses"),
            c["purl"].alias("purl")
        )
        properties = F.when(_which().isNotNull(), F.struct(F.struct(F.lit(of).alias("_name"), _which().alias("_VALUE")).alias("property")))
        flat = F.struct(
            F.lit("http://cyclonedx.org/schema/bom/1.5").alias("_xmlns"), F.lit(1).alias("_version"),
            F.struct(meta["timestamp"].alias("timestamp"), properties.alias("properties")).alias("metadata"), F.struct(F.transform("all", lambda x: part(x["c"])).alias("component")).alias("components")
        )
        return listed.select("branch_id", "piece", F.to_xml(flat, {"rowTag": "bom"}).alias("document"))
    return listed.select("branch_id", "piece", F.to_json(document).alias("document"))


def sbom_spdx(parts: DataFrame, name: str, created: str, size: int = SIZE) -> DataFrame:
    """(branch_id, piece, document): SPDX 2.3 as JSON. Packages are numbered from 0 by path and name; the root depends on each.

    A document lists up to ``size`` packages with their relationships. Where a branch has several, numbers go on and a comment says which of how many it is.
    """
    none = F.lit("NOASSERTION")
    license = F.coalesce(F.nullif("license", F.lit("")), none)
    refs = F.when(
        F.col("purl").isNotNull(),
        F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator")))
    )
    package = F.struct(
        F.concat(
            F.lit("SPDXRef-Package-"), F.col("number").cast("string")
        ).alias("SPDXID"), "name", F.col("version").alias("versionInfo"), none.alias("downloadLocation"),
        license.alias("licenseConcluded"), license.alias("licenseDeclared"), refs.alias("externalRefs"),
    )
    listed = _dealt(parts, size).groupBy("branch_id", "piece", "pieces").agg(F.array_sort(F.collect_list(F.struct("number", package.alias("p")))).alias("all"))
    relation = F.transform(
        "all",
        lambda x: F.struct(
            F.lit("SPDXRef-Package-root").alias("spdxElementId"), F.lit("DEPENDS_ON").alias("relationshipType"),
            x["p"]["SPDXID"].alias("relatedSpdxElement")
        )
    )
    document = F.struct(
        F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.lit(name).alias("name"),
        F.struct(F.lit(created).alias("created"), F.array(F.lit(f"Tool: {TOOL}-1.0.0")).alias("creators"), _which("piece ").alias("comment")).alias("creationInfo"),
        F.transform("all", lambda x: x["p"]).alias("packages"), relation.alias("relationships"),
    )
    return listed.select("branch_id", "piece", F.to_json(document).alias("document"))
