"""Benchmark decontamination by exact n-grams of normalised words.

The windows of the benchmark (13 consecutive words of an item; an item of fewer words is one window) go to all tasks as a
broadcast hash set. Documents are normalised and scanned in batches: a word outside the benchmark's vocabulary ends a
run, and only runs long enough to hold a window are looked at, so a window is verified word by word and nearly all
text is passed over at the cost of one dictionary lookup a word.

What is broadcast is measured first. A benchmark beyond ``PART_BYTES`` is cut into parts by item; each part makes
a pass of its own over the documents, and the hits of the parts are merged by document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depchron.llm import common
from depchron.sources.work import shipped, table, written

N = 13
#: Bytes of benchmark text whose windows are broadcast at a time.
PART_BYTES = 4 << 20
#: A-Z to a-z; what is no word character to a space. Bytes from 80 on belong to characters beyond ASCII: all word characters.
NORMAL = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

FOUND = T.StructType().add("n_words", "long").add(
    "hits", T.ArrayType(T.StructType().add("a", "integer").add("b", "integer"))
).add("items", T.ArrayType(T.StringType()))


class Windows:
    """The windows of some items: vocabulary, and items by window."""

    def __init__(self, items: list[tuple[str | None, str]], n: int = N):
        self.ids: dict[bytes, int] = {}
        self.found: dict[tuple[int, ...], list[str]] = {}
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in normal_words(text)]
            size = min(n, len(words))
            for window in {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else ():
                self.found.setdefault(window, []).extend([item] if item is not None else [])
        self.sizes = sorted({len(w) for w in self.found})

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, hit stretches [a, b) in words (they may overlap), items found."""
        words = text.translate(NORMAL).split()
        if not self.sizes or len(words) < self.sizes[0]:
            return len(words), [], []
        known = np.fromiter(map(self.ids.get, words, _zeros()), np.int32, len(words))
        ends = np.flatnonzero(np.diff(np.concatenate(([0], known != 0, [0])).astype(np.int8)))
        starts, ends = ends[::2], ends[1::2]
        long = ends - starts >= self.sizes[0]
        hits, items = [], set()
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            run = known[a:b].tolist()
            for size in self.sizes:
                for i in range(b - a - size + 1):
                    if (of := self.found.get(tuple(run[i : i + size]))) is not None:
                        hits.append((a + i, a + i + size))
                        items.update(of)
        return len(words), merged(hits), sorted(items)


def _zeros() -> Iterator[int]:
    while True:
        yield 0


def normal_words(text: bytes | str) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text).translate(NORMAL).split()


def merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scanner(windows):
    """Replaces the last column, the text, by what is found in it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value
        for batch in batches:
            *others, texts = batch.columns
            texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
            found = [w.scan(t.as_py() or b"") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *others,
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([[{"a": a, "b": b} for a, b in f[1]] for f in found], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                    pa.array([f[2] for f in found], pa.list_(pa.string())),
                ],
                names=[*batch.schema.names[:-1], "n_words", "hits", "items"],
            )

    return scan


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N, text_col: str = "text", keep_text: bool = True, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` as struct ``row`` with n_words, ``hits`` (merged stretches of words, in order) and ``items`` (sorted ids).

    A null text has no words. Benchmark rows without words have no windows; the windows of rows without an id hit, but are
    in no list of items; rows that share an id are one item. Repeated documents are scanned each, whole texts of any length. Columns of ``docs``
    stand in the struct, whatever their names. Empty tables on either side give no hits.
    """
    spark = shipped(docs.sparkSession)
    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")
    parts = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / part_bytes))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if keep_text or c != text_col])
    rows = docs.select(row.alias("row"), F.col(text_col).cast("string").alias("__text"))

    def part(frame: DataFrame, i: int) -> DataFrame:
        own = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == i)
        windows = spark.sparkContext.broadcast(Windows([(r["item"], r["text"]) for r in own.collect()], n))
        return frame.mapInArrow(_scanner(windows), T.StructType([*frame.schema.fields[:-1], *FOUND.fields]))

    if parts == 1:
        return part(rows, 0)
    rows = written(rows.withColumn("id", F.monotonically_increasing_id()).select("row", "id", "__text"), "decontamination")
    each = [part(rows, i) for i in range(parts)]
    more = each[1]
    for other in each[2:]:
        more = more.unionAll(other)
    more = more.filter(F.size("hits") > 0).groupBy("id").agg(F.flatten(F.collect_list("hits")).alias("h"), F.flatten(F.collect_list("items")).alias("i"))
    joined = each[0].join(more, "id", "left")
    both = lambda a, b, of: F.concat(F.col(a), F.coalesce(F.col(b), F.array().cast(of)))
    last = lambda a: F.get(a, F.size(a) - 1)
    merge = F.aggregate(
        F.array_sort(both("hits", "h", "array<struct<a:int,b:int>>")), F.array().cast("array<struct<a:int,b:int>>"),
        lambda a, x: F.when(
            (F.size(a) > 0) & (last(a)["b"] >= x["a"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["a"].alias("a"), F.greatest(last(a)["b"], x["b"]).alias("b"))))
        ).otherwise(F.concat(a, F.array(x))),
    )
    return joined.select("row", "n_words", merge.alias("hits"), F.array_sort(F.array_distinct(both("items", "i", "array<string>"))).alias("items"))


def n_hit():
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["b"] - x["a"])


def contaminated():
    """A document word in 20, or more, is part of a benchmark window."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, unchanged: those with null or empty texts, repeated rows and columns of any name too."""
    return hits(docs, benchmark, **options).filter(~contaminated()).select("row.*")


def _cutter(at: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, hit in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if hit:
                    raw = text.encode()
                    plain = raw.translate(NORMAL)
                    words = np.flatnonzero(np.diff(np.concatenate(([1], np.frombuffer(plain, np.uint8) == 0x20, [1])).astype(np.int8)))
                    starts, ends = words[::2], words[1::2]
                    out, done = [], 0
                    for h in hit:
                        out.append(raw[done : starts[h["a"]]])
                        done = ends[h["b"] - 1]
                    text = b"".join([*out, raw[done:]]).decode()
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return cut


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All documents, with the hit words cut out of their texts, and what stands between the words of a stretch.

    Null and empty texts stay as they are, and columns of any other name; an empty table gives no rows.
    """
    found = hits(docs, benchmark, text_col=text_col, **options).select("row.*", F.col("hits").alias(common.free_name(docs.columns, "hits")))
    return found.mapInArrow(_cutter(docs.columns.index(text_col)), docs.schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the benchmark in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = hits(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select(
        "row.doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


OP4_SQL = r"""
WITH i AS (SELECT item_id::VARCHAR AS item,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
b AS (SELECT DISTINCT item, len(w) AS m, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1),
  lambda p: array_to_string(w[p:p + 12], ' '))) AS g FROM i WHERE len(w) > 0),
s AS (SELECT DISTINCT least(m, 13) AS size FROM b),
d AS (SELECT row_number() OVER () AS id, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT id, size, unnest(range(1, len(w) - size + 2)) AS p,
  unnest(list_transform(range(1, len(w) - size + 2), lambda p: array_to_string(w[p:p + size - 1], ' '))) AS g FROM d, s WHERE len(w) >= size),
h AS (SELECT id, p, size, item FROM x JOIN b ON x.g = b.g),
n AS (SELECT id, count(DISTINCT q) AS n_hit FROM (SELECT id, unnest(range(p, p + size)) AS q FROM (SELECT DISTINCT id, p, size FROM h)) GROUP BY id),
t AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM h WHERE item IS NOT NULL) GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON d.id = n.id LEFT JOIN t ON d.id = t.id
"""
