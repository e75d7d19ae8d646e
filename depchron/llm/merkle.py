"""A Merkle manifest of a corpus: a tree over each source, and one over the sources, stored in van Emde Boas layout.

A leaf is the digest of a row; every ``FANOUT`` consecutive nodes become one. The leaves of a source are numbered by id and cut
into aligned blocks of ``FANOUT ** HEIGHT``; a block's subtree is built in one task and kept as one array of digests in van
Emde Boas order: a tree is split at half its height into a top tree and bottom trees, each laid out in one piece by the same
rule, so ``address`` finds any node by arithmetic alone, and a walk from a leaf to the root touches few stretches of memory
whatever their size. The roots of the blocks are numbered leaves of the next tables of blocks, until a source has one root;
then the roots of the sources go the same way.

The way back goes from the top: each table of blocks meets its parents (one array for all children of a block), and the siblings
are read from the array by their addresses. Texts are read once, where they are; only digests and ids are shuffled, by
(source, block), so that a source with a third of all rows is spread over as many groups as it has blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depchron.llm import common
from depchron.sources.work import shipped, table, written

FANOUT = 3
#: Levels above the leaves of a block: 2,187 leaves, an array of 105 KB.
HEIGHT = 7
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
KEYS = ["group", "none", "block"]


def nodes(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (FANOUT**levels - 1) // (FANOUT - 1)


def height(n: int) -> int:
    """Levels above ``n`` leaves: until one node remains."""
    h = 0
    while FANOUT**h < n:
        h += 1
    return h


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` of a depth (0 is the root) in the array of a tree of so many levels."""
    index, at = np.asarray(index, np.int64), np.zeros(np.shape(index), np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        depth, levels = depth - top, levels - top
        tree, index = np.divmod(index, FANOUT**depth)
        at += nodes(top) + tree * nodes(levels)
    return at


def build(digests: list[str], n: int, most: int = HEIGHT) -> bytes:
    """The array of a block with these leaves, in hex, of a source (or of a level of its blocks) of ``n`` leaves."""
    t = min(most, height(n))
    out = np.zeros((nodes(t + 1), DIGEST), np.uint8)
    level = digests
    for depth in range(t, -1, -1):
        out[address(t + 1, depth, np.arange(len(level)))] = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, DIGEST)
        if depth:
            level = [hashlib.sha256("".join(level[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(level), FANOUT)]
    return out.tobytes()


def paths(tree: bytes, count: int) -> tuple[list[list[str]], list[list[str]]]:
    """Siblings to the left and to the right of each of the ``count`` leaves of a block, from the leaf's level upwards."""
    array = np.frombuffer(tree, np.uint8).reshape(-1, DIGEST)
    t = next(h for h in range(HEIGHT + 1) if nodes(h + 1) == len(array))
    left: list[list[str]] = [[] for _ in range(count)]
    right: list[list[str]] = [[] for _ in range(count)]
    there = count
    for depth in range(t, 0, -1):
        text = array[address(t + 1, depth, np.arange(there))].tobytes().hex()
        of = [text[2 * DIGEST * i : 2 * DIGEST * (i + 1)] for i in range(there)]
        before = ["".join(of[i // FANOUT * FANOUT : i]) for i in range(there)]
        after = ["".join(of[i + 1 : i // FANOUT * FANOUT + FANOUT]) for i in range(there)]
        below = FANOUT ** (t - depth)
        for i in range(count):
            left[i].append(before[i // below])
            right[i].append(after[i // below])
        there = -(-there // FANOUT)
    return left, right


def root_of(tree: bytes) -> str:
    return tree[:DIGEST].hex()


BLOCK = "group string, none boolean, block long, n long, root string, tree binary"


def _built(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("place")
    first = frame.iloc[0]
    tree = build(frame["digest"].tolist(), int(first["n"]))
    return pd.DataFrame([(first["group"], bool(first["none"]), int(first["block"]), int(first["n"]), root_of(tree), tree)], columns=["group", "none", "block", "n", "root", "tree"])


def _descended(children: pd.DataFrame, parent: pd.DataFrame) -> pd.DataFrame:
    children = children.sort_values("place").reset_index(drop=True)
    of = parent.iloc[0]
    left, right = paths(of["tree"], len(children))
    up_left, up_right = list(of["left"]), list(of["right"])
    return children.assign(left=[x + up_left for x in left], right=[x + up_right for x in right], subroot=of["subroot"], top=of["top"])


UP = "left array<string>, right array<string>, subroot string, top string"


def blocks(placed: DataFrame, label: str) -> list[DataFrame]:
    """Tables of blocks, lowest first, over rows (group, none, place from 0, n, digest): each is written, and the last has one block per group."""
    out: list[DataFrame] = []
    size = FANOUT**HEIGHT
    while not out or not out[-1].filter("block > 0").isEmpty():
        if out:
            placed = out[-1].select("group", "none", F.col("block").alias("place"), F.ceil(F.col("n") / size).alias("n"), F.col("root").alias("digest"))
        keyed = placed.select("group", "none", F.floor(F.col("place") / size).alias("block"), "place", "n", "digest")
        out.append(written(keyed.groupBy(*KEYS).applyInPandas(_built, BLOCK), label))
    return out


def _down(children: DataFrame, parents: DataFrame) -> DataFrame:
    """``children`` (group, none, place, ...) with the path of each to the top, from the arrays and paths of their blocks."""
    keyed = children.withColumn("block", F.floor(F.col("place") / FANOUT**HEIGHT))
    kind = T.StructType([*keyed.schema.fields, *T._parse_datatype_string(UP).fields])
    return keyed.groupBy(*KEYS).cogroup(parents.groupBy(*KEYS)).applyInPandas(_descended, kind).drop("block")


def _climbed(lowest: DataFrame, tables: list[DataFrame], start: DataFrame) -> DataFrame:
    """Paths of ``lowest`` down through the tables of blocks, from ``start``: what stands above the topmost ones, by group."""
    above = tables[-1].join(start, ["group", "none"]).select(*tables[-1].columns, "left", "right", "subroot", "top")
    for below in reversed(tables[:-1]):
        above = written(_down(below.select("group", "none", F.col("block").alias("place"), "root", "tree"), above).withColumnRenamed("place", "block"), "merkle-paths")
    return _down(lowest, above)


def leaf_hash(fields: list[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 length, a colon and the value, ``-`` for null, in one run."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(c.cast("string")) for c in fields]), 256)


def manifest(docs: DataFrame, leaf: Column, id_col: str = "doc_id", group_col: str = "source", carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, source, place, leaf, ``carry``, subroot, root, left, right): a row for each of ``docs``; ``left`` and ``right`` are the
    siblings on the way to the root, level by level, as hex joined in their order.

    Leaves ascend by id, null first; rows that share an id by their leaf. A null source is a source, first in order; an empty name is another.
    Texts may be null or of any length: only ``leaf`` looks at them. Repeated rows are leaves of their own. An empty table has no
    rows and no root. No other column of ``docs`` matters, whatever its name.
    """
    carry, spark = carry or {}, shipped(docs.sparkSession)
    n = common.ranges(spark)
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(group_col).cast("string"), F.lit("")).alias("group"), F.col(group_col).isNull().alias("none"),
        leaf.alias("digest"), *[c.alias(f"c_{k}") for k, c in carry.items()]
    )
    dealt = lambda df, *by: written(df.repartitionByRange(n, *by).withColumn("part", F.spark_partition_id()), "merkle-leaves")
    count = lambda df, groups, order: common.running_sum(df, groups, "part", order, F.lit(1), "place", "n").withColumn("place", F.col("place") - 1)
    leaves = written(count(dealt(written(rows, "merkle-rows"), "group", "none", "id", "digest"), ["group", "none"], ["id", "digest"]).drop("part"), "merkle-leaves")
    of_sources = blocks(leaves.select("group", "none", "place", "n", "digest"), "merkle-blocks")
    roots = of_sources[-1].select("group", "none", (~F.col("none")).alias("named"), F.col("root").alias("digest"), F.lit(0).alias("all"))
    named = written(count(dealt(roots, "named", "group"), ["all"], ["named", "group"]).select(
        F.lit("").alias("group"), F.lit(False).alias("none"), "place", "n", "digest", F.col("group").alias("source"), F.col("none").alias("unnamed")
    ), "merkle-sources")
    over = blocks(named.select("group", "none", "place", "n", "digest"), "merkle-tops")
    nothing = F.array().cast("array<string>")
    start = over[-1].select("group", "none", nothing.alias("left"), nothing.alias("right"), F.lit("").alias("subroot"), F.col("root").alias("top"))
    tops = _climbed(named.select("group", "none", "place", "digest", "source", "unnamed"), over, start)
    tops = written(tops.select(F.col("source").alias("group"), F.col("unnamed").alias("none"), "left", "right", F.col("digest").alias("subroot"), "top"), "merkle-paths")
    done = _climbed(leaves, of_sources, tops)
    return done.select(
        "id", F.when(~F.col("none"), F.col("group")).alias("source"), "place", F.col("digest").alias("leaf"), *[F.col(f"c_{k}").alias(k) for k in carry],
        "subroot", F.col("top").alias("root"), "left", "right"
    )


def folded(leaf: Column, left: Column, right: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    levels = F.arrays_zip(left.alias("l"), right.alias("r"))
    return F.aggregate(levels, leaf, lambda node, x: F.sha2(F.concat(x["l"], node, x["r"]), 256))


def proof_digest(left: Column, right: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(F.arrays_zip(left.alias("l"), right.alias("r")), lambda x: F.concat(x["l"], x["r"])), ""), 256)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; half of them are checked with line feeds deleted from their text."""
    docs = table(spark, sf_dir, "documents")
    own = [F.col(c) for c in FIELDS]
    changed = leaf_hash([*own[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit(""))])
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    rows = manifest(docs, leaf_hash(own), carry={"tampered": F.when(hit, changed)})
    root = folded(F.coalesce("tampered", "leaf"), F.col("left"), F.col("right"))
    out = rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("left"), F.col("right")).alias("proof_sha256"),
        root.alias("folded_root"), "source", "place"
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


# Levels by a recursive query: at each, nodes with their number, and the runs of three that they are in. The CRC goes a nibble at a time.
OP12_SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(16), lambda x: list_reduce([x, 0, 0, 0, 0], lambda c, i: xor(c >> 1, (c & 1) * 3988292384))) AS t),
d AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
               || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
             hex(encode(doc_id::VARCHAR)) AS h, replace(text, chr(10), '') AS cut FROM documents),
c AS (SELECT *, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT),
                   lambda c, x: xor(xor(c >> 4, t[((xor(c, x) & 15) + 1)::INT]) >> 4,
                     t[((xor(xor(c >> 4, t[((xor(c, x) & 15) + 1)::INT]), x >> 4) & 15) + 1)::INT])), 4294967295) AS crc FROM d, t),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
             CASE WHEN crc % 2 = 0 THEN sha256(head || coalesce(strlen(cut) || ':' || cut, '-'))
                  ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS changed FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l),
up(level, source, i, digest, n) AS (
  SELECT 0, source, place, leaf, count(*) OVER (PARTITION BY source) FROM p
  UNION ALL
  SELECT level + 1, source, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM up WHERE n > 1 GROUP BY level, source, i // 3),
s AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1),
top(level, i, digest, n) AS (
  SELECT 0, place, subroot, n FROM s
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY level, i // 3),
sib AS (
  SELECT level, source, i, lag(digest, 2) OVER w AS a, lag(digest) OVER w AS b, lead(digest) OVER w AS c, lead(digest, 2) OVER w AS d FROM up WHERE n > 1
  WINDOW w AS (PARTITION BY level, source, i // 3 ORDER BY i)),
tsib AS (
  SELECT level, i, lag(digest, 2) OVER w AS a, lag(digest) OVER w AS b, lead(digest) OVER w AS c, lead(digest, 2) OVER w AS d FROM top WHERE n > 1
  WINDOW w AS (PARTITION BY level, i // 3 ORDER BY i)),
walk(k, source, place, i, node, proof) AS (
  SELECT 0, source, place, place, changed, '' FROM p
  UNION ALL
  SELECT k + 1, w.source, w.place, w.i // 3, sha256(coalesce(a, '') || coalesce(b, '') || node || coalesce(c, '') || coalesce(d, '')),
         proof || coalesce(a, '') || coalesce(b, '') || coalesce(c, '') || coalesce(d, '')
  FROM walk w JOIN sib ON sib.level = k AND sib.source IS NOT DISTINCT FROM w.source AND sib.i = w.i),
half AS (SELECT source, place, arg_max(node, k) AS node, arg_max(proof, k) AS proof FROM walk GROUP BY source, place),
walk2(k, source, place, i, node, proof) AS (
  SELECT 0, h.source, h.place, s.place, node, proof FROM half h JOIN s ON h.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT k + 1, w.source, w.place, w.i // 3, sha256(coalesce(a, '') || coalesce(b, '') || node || coalesce(c, '') || coalesce(d, '')),
         proof || coalesce(a, '') || coalesce(b, '') || coalesce(c, '') || coalesce(d, '')
  FROM walk2 w JOIN tsib ON tsib.level = k AND tsib.i = w.i),
whole AS (SELECT source, place, arg_max(node, k) AS node, arg_max(proof, k) AS proof FROM walk2 GROUP BY source, place),
r AS (SELECT digest AS root FROM top WHERE n = 1)
SELECT p.doc_id, p.leaf, s.subroot, r.root, sha256(w.proof) AS proof_sha256, w.node AS folded_root, p.source, p.place::BIGINT AS place, w.node = r.root AS verified
FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source JOIN whole w ON p.source IS NOT DISTINCT FROM w.source AND p.place = w.place, r
"""
