"""What a commit graph and its trees say: commits reachable from tips, and the files that differ between two trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depchron.functions.order import numbered
from depchron.sources.work import new_folder, shipped, written

#: Places of a stretch of history that one task walks, of which half or more are free; a branch takes about as many rounds as its history has stretches.
STRETCH = 2_000_000


#: Places whose edges are one row.
CHUNK = 4096


def placed(commits: DataFrame, size: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a commit graph: each commit once with ``place``, its number by time, and (place, parent, stretch) by numbers alone."""
    nodes, packed = _packed(commits, size)
    edge = F.explode(F.arrays_zip("place", "parent")).alias("e")
    return nodes, packed.select("stretch", edge).select("e.place", "e.parent", "stretch")


def _packed(commits: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """``placed`` with the edges of ``CHUNK`` places as two arrays, so a round passes few rows on.

    A stretch is a run of ``size`` places, so most parents lie in the same one or the one before. Edges are files by stretch: a round reads only those it walks.

    Commits of one time are in no order of their own, so a way that goes through them would cross a border among them again and again, with a round for each crossing. A stretch
    thus takes about ``size`` / 2 commits and ends between two times; its other places stay free. Only a time of more commits than that is cut.
    """
    half, same = max(1, size // 2), ["__all", "__day", "committed_at"]
    once = commits.dropDuplicates(["sha"]).withColumns({"__all": F.lit(0), "__day": F.to_date("committed_at")})
    nodes = numbered(once, ["__all"], "__day", ["committed_at", "sha"], "place")
    first = F.col("place") - F.row_number().over(Window.partitionBy(*same).orderBy("sha")) + 1
    nodes = nodes.withColumns({"__first": first, "__same": F.count(F.lit(1)).over(Window.partitionBy(*same))})
    stretch = F.floor(F.when(F.col("__same") <= half, F.col("__first")).otherwise(F.col("place")) / half)
    nodes = written(nodes.withColumn("place", F.col("place") + stretch * (size - half)).drop("__all", "__day", "__first", "__same"), "nodes")
    named = nodes.select("place", F.explode("parents").alias("sha")).join(nodes.select("sha", F.col("place").alias("parent")), "sha")
    path = new_folder(commits.sparkSession, "edges")
    edges = named.groupBy(F.floor(F.col("place") / size).alias("stretch"), F.floor(F.col("place") / CHUNK)).agg(F.collect_list(F.struct("place", "parent")).alias("e"))
    edges = edges.select("e.place", "e.parent", "stretch")
    edges.repartition("stretch").write.partitionBy("stretch").parquet(path)
    return nodes, commits.sparkSession.read.schema(edges.schema).parquet(path)


def _walker(size: int):
    def walked(edges: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """New commits of a stretch for one branch (``here``), and the parents that lie elsewhere."""
        branch, first = asked["branch_id"].iloc[0], int(asked["stretch"].iloc[0]) * size
        whole = lambda c: np.concatenate([np.empty(0, dtype="int64"), *edges[c]])
        place, parents = whole("place"), whole("parent")
        order = np.argsort(place, kind="stable")
        starts = np.searchsorted(place[order] - first, np.arange(size + 1)).tolist()
        parents = (parents[order] - first).tolist()
        at, done = asked["place"].to_numpy() - first, asked["done"].to_numpy().astype(bool)
        known = np.zeros(size, dtype="uint8")
        known[at[done]] = 1
        seen, heap, new, away = bytearray(known), at[~done].tolist(), [], set()
        while heap:
            place = heap.pop()
            if seen[place]:
                continue
            seen[place] = 1
            new.append(place)
            for parent in parents[starts[place] : starts[place + 1]]:
                if not 0 <= parent < size:
                    away.add(parent)
                elif not seen[parent]:
                    heap.append(parent)
        places = np.array([*new, *away], dtype="int64") + first
        return pd.DataFrame({"branch_id": branch, "place": places, "here": np.arange(len(places)) < len(new)})

    return walked


def _reached(nodes: DataFrame, edges: DataFrame, tips: DataFrame, size: int) -> DataFrame:
    """(branch_id, place, stretch) of what the tips of each branch reach.

    In each round, the stretches that a branch newly asks for are walked, one (branch, stretch) a task and within it to the end; what their commits
    name outside is asked for in the next round, until nothing is. What is found is kept as files by round and stretch, so a round reads the stretches that it
    walks, and never the whole graph or all that was found. A round is one write and one small read.
    """
    spark, kind = shipped(nodes.sparkSession), dict(tips.dtypes)["branch_id"]
    path, stretch = new_folder(spark, "reached"), F.floor(F.col("place") / size).alias("stretch")
    asked = written(tips.select("branch_id", "sha").distinct().join(nodes.select("sha", "place"), "sha").select("branch_id", "place", stretch), "asked")
    found = asked.select("branch_id", "place", "stretch")
    kept = f"branch_id {kind}, place long, here boolean, stretch long"
    visited: set[int] = set()
    number = 0
    # a number for each stretch at most
    while now := [r["stretch"] for r in asked.select("stretch").distinct().collect()]:
        own = asked.withColumn("done", F.lit(False))
        if again := [s for s in now if s in visited]:
            before = spark.read.schema(f"{kept}, round int").parquet(path).filter(F.col("here") & F.col("stretch").isin(again)).select("branch_id", "place", "stretch")
            own = own.unionByName(before.join(F.broadcast(asked.select("branch_id", "stretch").distinct()), ["branch_id", "stretch"], "left_semi").withColumn("done", F.lit(True)))
        pairs = asked.select(F.col("branch_id").alias("b"), F.col("stretch")).distinct()
        wanted = edges.filter(F.col("stretch").isin(now)).join(F.broadcast(pairs), "stretch").withColumnRenamed("stretch", "s")
        walked = wanted.groupBy("b", "s").cogroup(own.groupBy("branch_id", "stretch")).applyInPandas(_walker(size), f"branch_id {kind}, place long, here boolean")
        walked.select("branch_id", "place", "here", stretch).write.partitionBy("here", "stretch").parquet(f"{path}/round={number}")
        visited.update(now)
        asked = spark.read.schema(kept).parquet(f"{path}/round={number}").filter("NOT here").select("branch_id", "place", "stretch")
        number += 1
    return spark.read.schema(f"{kept}, round int").parquet(path).filter("here").select(*found.columns) if visited else found


def reachable(commits: DataFrame, tips: DataFrame, size: int = STRETCH) -> DataFrame:
    """(branch_id, sha): the commits (sha, parents, committed_at) that can be reached from the tips (branch_id, sha) of each branch, tips included.

    History is cut into stretches of time (``placed``) and walked from stretch to stretch. A parent that is dated after its child
    only costs a round more. Parents that are not in the table end a way; a tip that isn't there reaches nothing. A commit comes once for each branch.
    """
    nodes, edges = _packed(commits.select("sha", "parents", "committed_at"), size)
    return _reached(nodes, edges, tips, size).join(nodes.select("place", "sha"), "place").select("branch_id", "sha")


def branch_log(commits: DataFrame, tips: DataFrame, since: DataFrame | None = None, size: int = STRETCH) -> DataFrame:
    """The commits of each branch with ``branch_id`` and ``pos``: all that its tip reaches, numbered from 1 by time, oldest first.

    ``since`` (branch_id, sha) leaves out these commits and all that they reach; numbers stay. Commits are numbered by their places, and get their other columns last.
    """
    nodes, edges = _packed(commits, size)
    log = numbered(_reached(nodes, edges, tips, size), ["branch_id"], "stretch", ["place"], "pos")
    if since is not None:
        log = log.join(_reached(nodes, edges, since, size).select("branch_id", "place"), ["branch_id", "place"], "left_anti")
    return log.drop("stretch").join(nodes, "place").drop("place")


# Trees

DIGEST = "struct<n:bigint,a:bigint,b:bigint>"


def _digest(path: Column, blob: Column) -> Column:
    """Digest of a set of files that doesn't depend on their order: their number and two hashes joined by exclusive or."""
    return F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(path, blob)).alias("a"), F.bit_xor(F.xxhash64(F.lit("tree"), blob, path)).alias("b"))


def tree_nodes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots, nodes) of the trees of commits, from their files (commit, path, blob).

    ``roots`` are (commit, node); ``nodes`` are (node, name, folder, blob, child): what a folder of that digest holds, each of its files with its blob and
    each of its folders with the digest of that. A digest covers all files below a folder with their paths from there, so equal subtrees,
    in whatever commits and places, are the same node and are kept once. One pass rolls all folders up by the prefixes of their paths; partial sums come
    before the shuffle.
    """
    once = files.filter(F.col("path").isNotNull()).groupBy("commit", "path").agg(F.max("blob").alias("blob"))
    parts = F.split("path", "/")
    up = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/").alias("rest"))
    )
    folders = written(once.select("commit", "blob", F.explode(up).alias("u")).groupBy("commit", "u.dir").agg(_digest(F.col("u.rest"), F.col("blob")).alias("node")), "folders")
    at = F.col("dir") != ""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    parent = lambda c: F.when(F.contains(c, F.lit("/")), F.regexp_replace(c, "/[^/]*$", "")).otherwise("")
    held = once.select("commit", parent(F.col("path")).alias("dir"), name(F.col("path")).alias("name"), F.lit(False).alias("folder"), "blob", F.lit(None).cast(DIGEST).alias("child"))
    inner = folders.filter(at).select("commit", parent(F.col("dir")).alias("dir"), name(F.col("dir")).alias("name"), F.lit(True).alias("folder"), F.lit(None).cast("string").alias("blob"), F.col("node").alias("child"))
    nodes = held.unionByName(inner).join(folders, ["commit", "dir"]).select("node", "name", "folder", "blob", "child").distinct()
    return folders.filter(~at).select("commit", "node"), nodes


def tree_changes(roots: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(commit, path, status): files added (A), modified (M) and deleted (D) in ``commit`` against ``parent``, for each of ``pairs`` (commit, parent).

    Goes down from the roots, a level a round, and only into folders whose digests differ, so equal subtrees are never listed. A null parent, or one
    without files, has an empty tree. A file that becomes a folder is deleted, and the files in it are added.
    """
    of = lambda side: roots.select(F.col("commit").alias(side), F.col("node").alias(f"{side}_node"))
    level = pairs.select("commit", "parent").distinct().join(of("parent"), "parent", "left").join(of("commit"), "commit", "left")
    level = level.select("commit", F.lit("").alias("dir"), F.col("parent_node").alias("old"), F.col("commit_node").alias("new"))
    level = written(level.filter(~F.col("old").eqNullSafe(F.col("new"))), "tree-level")
    out = None
    while out is None or not level.isEmpty():
        side = lambda c: level.select("commit", "dir", F.col(c).alias("node")).join(nodes, "node").select(  # noqa: B023, E731
            "commit", "dir", "name", "folder", F.col("blob").alias(f"{c}_blob"), F.col("child").alias(f"{c}_child"), F.lit(True).alias(f"{c}_there")
        )
        both = side("old").join(side("new"), ["commit", "dir", "name", "folder"], "full_outer")
        path = F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat_ws("/", "dir", "name"))
        status = F.when(F.col("old_there").isNull(), "A").when(F.col("new_there").isNull(), "D").otherwise("M")
        differ = F.when(F.col("folder"), ~F.col("old_child").eqNullSafe(F.col("new_child"))).otherwise(~F.col("old_blob").eqNullSafe(F.col("new_blob")) | (status != "M"))
        both = written(both.filter(differ).select("commit", path.alias("path"), "folder", status.alias("status"), "old_child", "new_child"), "tree-changes")
        found = both.filter(~F.col("folder")).select("commit", "path", "status")
        out = found if out is None else out.unionAll(found)
        level = written(both.filter("folder").select("commit", F.col("path").alias("dir"), F.col("old_child").alias("old"), F.col("new_child").alias("new")), "tree-level")
    return out
