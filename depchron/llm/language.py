"""Language identification by n-gram filters that answer for all languages at once.

A bit-sliced Bloom filter holds one word of language bits per cell. The n-grams of each language set its bit in k cells;
the AND of an n-gram's k cells is the set of languages that (seem to) contain it. A document's n-grams are looked up,
the bits are counted per language, and each count is corrected for the false positives that the language's fill
makes probable. The largest corrected count decides.

N-grams are four bytes of lower-cased text with digits, marks and white space of ASCII as single spaces, so they see
word ends, and two bytes or more of any script.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from depchron.sources.work import shipped, table

#: Labelled rows learned from, per language (as many as hash below the matching share; the number is met on average).
SAMPLE = 4000
#: Most frequent n-grams kept per language.
GRAMS = 6000
#: Most languages of one model; their filter takes 256 MB.
MOST = 8192
#: Bits of a cell's address, and cells per n-gram.
ADDRESS, MIXERS = 18, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
#: Bytes looked at at a time.
BLOCK = 1 << 20
#: ASCII letters to lower case, other ASCII to a space.
LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def _blocks(texts: pa.Array) -> Iterator[list[bytes]]:
    block, size = [], 0
    for t in pc.utf8_lower(texts.fill_null("")).cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()):
        block.append(t.as_py())
        size += len(block[-1])
        if size > BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def grams(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of some texts, and the place of the text that each is from."""
    a = np.frombuffer(b"".join([b" " + t.translate(LETTERS) + b" " for t in block]), np.uint8)
    owner = np.repeat(np.arange(len(block), dtype=np.int32), [len(t) + 2 for t in block])
    keep = np.append(True, (a[1:] != 0x20) | (a[:-1] != 0x20) | (owner[1:] != owner[:-1]))
    a, owner = a[keep].astype(np.uint32), owner[keep]
    if len(a) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    g = a[:-3] | a[1:-2] << np.uint32(8) | a[2:-1] << np.uint32(16) | a[3:] << np.uint32(24)
    same = owner[:-3] == owner[3:]
    return g[same], owner[:-3][same]


def cells(g: np.ndarray) -> list[np.ndarray]:
    return [((g * np.uint32(m)) ^ ((g * np.uint32(m)) >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - ADDRESS) for m in MIXERS]


@dataclass
class Model:
    """languages, the most frequent first of those learned from as ``default``, and the filter: a row of cells for every 64 languages."""

    languages: list[str]
    default: str
    filter: np.ndarray
    false_rate: np.ndarray

    def predict(self, block: list[bytes]) -> tuple[list[int], list[float]]:
        """For each text the language's place and the share of its corrected count in all; place -1 where nothing matches."""
        g, owner = grams(block)
        n = np.bincount(owner, minlength=len(block)).astype(float)
        at = cells(g)
        found = np.zeros((len(self.languages), len(block)))
        for w, row in enumerate(self.filter):
            bits = row[at[0]]
            for other in at[1:]:
                bits = bits & row[other]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                hits = np.bincount(owner[(bits >> np.uint64(i - 64 * w)) & np.uint64(1) == 1], minlength=len(block))
                found[i] = np.maximum(0.0, (hits - n * self.false_rate[i]) / (1 - self.false_rate[i]))
        best, total = found.argmax(0), found.sum(0)
        top = found[best, np.arange(len(block))]
        return np.where(top > 0, best, -1).tolist(), np.divide(top, total, out=np.zeros(len(block)), where=total > 0).tolist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in sorted(set(langs)):
            for block in _blocks(batch.column(1).filter(pa.array(langs == lang))):
                g, n = np.unique(grams(block)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "g", "n"]
                )


def learn(labelled: DataFrame, sample: int = SAMPLE, keep: int = GRAMS) -> Model:
    """A model from (id, text, lang). Rows without text or language are passed over; no rows give a model without languages.

    The sample is taken by a hash of the id and text, so it is the same in any run. What reaches the driver is one
    row per language and ``keep`` n-grams of each, some languages at a time. All languages are learned, up to ``MOST``; more are an error, since they are
    hardly languages: the model goes to all tasks, and takes 2 MB for every 64.
    """
    shipped(labelled.sparkSession)
    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST + 1).collect()
    if len(sizes) > MOST:
        raise ValueError(f"more than {MOST} languages to learn: the model would pass {MOST // 64 * (8 << ADDRESS) >> 20} MB")
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], "und", np.zeros((0, 1 << ADDRESS), np.uint64), np.zeros(0))
    shares = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, sample / r["n"])) for r in sizes], "lang string, share double")
    drawn = rows.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("lang", "text")
    counted = drawn.mapInArrow(_count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    top = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "g"))).filter(F.col("rank") <= keep)
    bits = np.zeros(((len(languages) + 63) // 64, 1 << ADDRESS), np.uint64)
    fill, place = np.zeros(len(languages)), {lang: i for i, lang in enumerate(languages)}
    for r in top.groupBy("lang").agg(F.collect_list("g").alias("grams")).toLocalIterator():
        i = place[r["lang"]]
        own = bits[i // 64]
        for at in cells(np.array(r["grams"], np.uint32)):
            own[at] |= np.uint64(1 << (i % 64))
        fill[i] = np.count_nonzero(own >> np.uint64(i % 64) & np.uint64(1)) / len(own)
    return Model(languages, sizes[0]["lang"], bits, fill ** len(MIXERS))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _predictor(model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            *others, texts = batch.columns
            langs, scores = [], []
            for block in _blocks(texts):
                best, share = m.predict(block) if m.languages else ([-1] * len(block), [0.0] * len(block))
                langs += [m.languages[b] if b >= 0 else m.default for b in best]
                scores += share
            letters = [has_letter(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *others, pa.array([x if ok else "und" for x, ok in zip(langs, letters, strict=True)], pa.string()),
                    pa.array([s if ok else 0.0 for s, ok in zip(scores, letters, strict=True)], pa.float64())
                ],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    return predict


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1). A text that is null or has no letter is ``und`` with score 0.

    A text whose n-grams are all unknown gets the model's most frequent language with score 0; ties go to the
    language that is first by name. Columns of ``docs`` with the two names are replaced. Whole texts are read, of any length; repeated rows are each
    predicted, alike; an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score") and (keep_text or c != text_col)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predictor(shipped(docs.sparkSession).sparkContext.broadcast(model)), schema).select("row.*", "lang_pred", "score")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out. A null id is neither held out nor learned from."""
    docs = table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = learn(docs.filter(part != 0).select(F.col("doc_id").alias("id"), "text", "lang"))
    return identify(docs.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "text"), model, keep_text=False)
