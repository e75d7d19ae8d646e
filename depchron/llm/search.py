"""Ranked lexical search by presence masks.

The terms of the queries are a vocabulary; one pass over the documents reduces each to its number of terms and its counts of
vocabulary terms. What the scores need of the corpus (documents, terms, documents per term) are sums over these.

Ranking goes by blocks of documents. Each term has a bitmap over the documents of a block; for an item, the bitmaps of its terms
side by side give each document a mask of the terms that it holds, and equal masks are one group. A mask's highest possible
score is the sum of its terms' largest contributions in the block. Masks are evaluated by descending bound, and once the
next bound lies below the lowest score that still counts, all other documents of the block are passed over unscored; that
score is carried from block to block in a task. A task hands on at most ``k`` documents for each item.

The queries' text is measured first: beyond ``PART_BYTES`` it is cut into parts by hash, each of which makes a pass of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from depchron.llm.decontamination import normal_words
from depchron.sources.work import shipped, table, written

K = 20
#: Bytes of query text whose vocabulary is broadcast at a time.
PART_BYTES = 4 << 20
#: Fixed values of the score: length normalisation in hundredths, saturation in tenths, and the scale of a contribution.
SLOPE, SATURATION, SCALE = 25, 12, 1_000_000_000
#: Masks of an item that are evaluated together.
CHUNK = 256


def _counter(vocabulary):
    """Replaces the last column, the text, by its number of terms, the vocabulary's terms in it, and their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = vocabulary.value
        for batch in batches:
            *others, texts = batch.columns
            sizes, terms, counts = [], [], []
            for text in texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()):
                words = normal_words(text.as_py() or b"")
                found = np.fromiter((ids.get(w, -1) for w in words), np.int32, len(words))
                term, n = np.unique(found[found >= 0], return_counts=True)
                sizes.append(len(words))
                terms.append(term)
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [*others, pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                names=[*batch.schema.names[:-1], "n", "terms", "counts"],
            )

    return count


class Block:
    """Documents of a batch as postings: for each term its documents, ascending, with what an occurrence contributes."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, per_doc: np.ndarray, docs: int, total: int):
        self.size = len(sizes)
        doc = np.repeat(np.arange(self.size), per_doc)
        m = 100 - SLOPE + (SLOPE * sizes * docs) // max(total, 1)
        gain = (SCALE * counts) // (1000 * counts + SATURATION * m[doc])
        order = np.argsort(terms, kind="stable")
        self.terms, starts = np.unique(terms[order], return_index=True)
        self.at = dict(zip(self.terms.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(terms)], strict=True), strict=True))
        self.docs, self.gain = doc[order], gain[order]

    def top(self, query: list[tuple[int, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of this block that may be among the ``k`` best: all that reach the k-th score, and ``floor``."""
        own = [(self.docs[a:b], self.gain[a:b] * weight) for term, weight in query if weight and term in self.at for a, b in [self.at[term]]]
        if not own:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        there = np.zeros((self.size, len(own)), bool)
        for j, (docs, _) in enumerate(own):
            there[docs, j] = True
        bits = np.packbits(there, axis=1)
        held = np.flatnonzero(bits.any(axis=1))
        masks, group = _grouped(bits[held])
        bound = np.unpackbits(masks, axis=1, count=len(own)).astype(np.int64) @ np.array([gain.max() for _, gain in own])
        ranked = np.argsort(-bound, kind="stable")
        members = held[np.argsort(group, kind="stable")]
        ends = np.cumsum(np.bincount(group, minlength=len(masks)))
        found, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        for i in self._steps(len(ranked)):
            if bound[ranked[i.start]] < floor:
                break
            chosen = np.sort(np.concatenate([members[(ends[g - 1] if g else 0) : ends[g]] for g in ranked[i]]))
            score = np.zeros(len(chosen), np.int64)
            for docs, gain in own:
                at = np.minimum(np.searchsorted(docs, chosen), len(docs) - 1)
                score += np.where(docs[at] == chosen, gain[at], 0)
            found, scores = np.concatenate((found, chosen)), np.concatenate((scores, score))
            if len(scores) >= k:
                floor = max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                keep = scores >= floor
                found, scores = found[keep], scores[keep]
        keep = (scores >= floor) & (scores > 0)
        return found[keep], scores[keep]

    @staticmethod
    def _steps(n: int) -> Iterator[slice]:
        a, size = 0, 8
        while a < n:
            yield slice(a, min(n, a + size))
            a, size = a + size, min(CHUNK, 2 * size)


def _grouped(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a matrix of bytes, and each row's number among them."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), np.uint8)
    wide[:, : bits.shape[1]] = bits
    if wide.shape[1] == 8:
        _, first, group = np.unique(wide.view(np.uint64).ravel(), return_index=True, return_inverse=True)
    else:
        _, first, group = np.unique(wide.view(np.dtype((np.void, wide.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return bits[first], group.ravel()


def _ranker(queries, docs: int, total: int, k: int, kind: pa.DataType):
    """(item, id, score): the ``k`` best documents of the task for each item, equal scores by ascending id, null ids last."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = queries.value
        best: list[list[tuple]] = [[] for _ in of]
        for batch in batches:
            terms, counts = batch.column("terms"), batch.column("counts")
            block = Block(
                batch.column("n").to_numpy(), terms.flatten().to_numpy(), counts.flatten().to_numpy(),
                np.diff(terms.offsets.to_numpy()), docs, total
            )
            for i, query in enumerate(of):
                floor = -best[i][-1][0] if len(best[i]) == k else 1
                rows, scores = block.top(query, k, floor)
                if len(rows):
                    ids = batch.column("id").take(pa.array(rows)).to_pylist()
                    new = [(-s, x is None, x) for s, x in zip(scores.tolist(), ids, strict=True)]
                    best[i] = sorted([*best[i], *new], key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))[:k]
        rows = [(i, x[2], -x[0]) for i, found in enumerate(best) for x in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())],
            names=["item", "id", "score"],
        )

    return rank


def weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def search(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    query_col: str = "text", part_bytes: int = PART_BYTES
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of each item with the highest scores above 0, ranked from 1.

    Terms are runs of ASCII letters, lower-cased, digits and characters beyond ASCII, in whole texts of any length. A null or
    empty text has none and is no document of the corpus; a null or empty query finds nothing. Equal scores go by ascending id,
    null ids last; rows that share an id are documents of their own, and items that share an id are ranked each. A table without
    rows on either side gives none. Other columns of either table don't matter, whatever their names.
    """
    spark = shipped(docs.sparkSession)
    asked = items.select(F.col(item_col).alias("item_id"), F.col(query_col).cast("string").alias("q")).filter("octet_length(q) > 0")
    parts = max(1, math.ceil((asked.agg(F.sum(F.octet_length("q"))).first()[0] or 0) / part_bytes))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for part in range(parts):
        own = (asked if parts == 1 else asked.filter(F.pmod(F.xxhash64("item_id", "q"), F.lit(parts)) == part)).collect()
        found = _search(spark, texts, own, asked.schema["item_id"].dataType, k)
        out = found if out is None else out.unionAll(found)
    return out


def _search(spark: SparkSession, texts: DataFrame, items: list, item_type: T.DataType, k: int) -> DataFrame:
    words = [normal_words(r["q"]) for r in items]
    vocabulary: dict[bytes, int] = {}
    for query in words:
        for w in query:
            vocabulary.setdefault(w, len(vocabulary))
    kind = T.StructType([texts.schema["id"], *T._parse_datatype_string("n long, terms array<int>, counts array<long>").fields])
    counted = written(texts.mapInArrow(_counter(spark.sparkContext.broadcast(vocabulary)), kind), "search-counts")
    sums = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    holding = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weights = {t: weight(sums["docs"], n) for t, n in holding.items()}
    queries = []
    for query in words:
        times: dict[int, int] = {}
        for w in query:
            times[vocabulary[w]] = times.get(vocabulary[w], 0) + 1
        queries.append([(t, n * weights[t]) for t, n in times.items() if t in weights])
    one = T.StructType([T.StructField("item", T.IntegerType()), texts.schema["id"], T.StructField("score", T.LongType())])
    arrow = texts.limit(0).select("id").toArrow().schema.field("id").type
    best = counted.filter(F.size("terms") > 0).mapInArrow(_ranker(spark.sparkContext.broadcast(queries), sums["docs"], sums["total"], k, arrow), one)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    top = best.withColumn("rank", place).filter(F.col("rank") <= k)
    named = spark.createDataFrame(list(enumerate(r["item_id"] for r in items)), T.StructType().add("item", "integer").add("item_id", item_type))
    return top.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, list_filter(string_split_regex(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, list_filter(string_split_regex(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
q AS (SELECT item, item_id, t, count(*) AS times FROM (SELECT item, item_id, unnest(w) AS t FROM i) GROUP BY ALL),
c AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
p AS (SELECT id, doc_id, len, t, count(*) AS tf FROM (SELECT id, doc_id, len(w) AS len, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c),
s AS (SELECT item, item_id, doc_id, id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len * n) // l))))::BIGINT AS score
      FROM q JOIN p USING (t) JOIN f USING (t), c GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 20
"""
