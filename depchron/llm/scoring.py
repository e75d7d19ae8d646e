"""Language-model scoring by the likelihood of the subword lattice.

The pieces of an existing vocabulary get unigram probabilities; a text's probability is the sum over all its
segmentations into pieces, so no single segmentation has to be chosen. Words start with the vocabulary's space, hence the
lattice of a text is a chain of the lattices of its words, and each distinct word is worked out once for the whole
corpus, by a log-space forward recursion over many words at a time.

The first scores fall with a piece's rank in the vocabulary (Zipf); rounds of expectation-maximisation over the counts of
the training words then fit them.

Steps, all distributed: count words; expected piece counts (the driver sees one row per piece of the vocabulary);
word likelihoods; document sums. For these, the most frequent words, a bounded number, are broadcast and looked up
where the text is; the others are joined by word, which leaves no word frequent enough to be hot.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depchron.sources.work import shipped, table, written

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words broadcast with their scores at most.
HEAD = 200_000
#: Words counted per task before partial counts are sent on; long texts, which may hold long words, also by their bytes.
FLUSH, LONG_TEXT, LONG_BYTES = 200_000, 1 << 20, 1 << 26
#: Longest word that goes through the recursion for many words at a time, and words at a time.
LONGEST, BATCH = 64, 20_000
#: Bytes of a longer word whose arcs are held at a time, and words a task works out.
STRETCH, TASK = 1 << 16, 50_000
#: Rounds of expectation-maximisation. Held-out log10 per token at sf0.1 after 0 to 4: -9.20, -5.74, -5.53, -5.46, -5.44.
ROUNDS = 2
#: Added to each expected piece count.
SMOOTH = 0.1
#: The token that ends a text; no word is empty.
END = ""
MULTIPLIER = np.uint64(0x100000001B3)
LOG10 = math.log(10)


class Lattice:
    """Pieces with log probabilities; the recursion over all segmentations."""

    def __init__(self, path: str, scores: np.ndarray | None = None):
        with open(path, "rb") as f:
            ranked = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]
        self.pieces = [p for p, _ in sorted(ranked, key=lambda x: x[1])]
        n = len(self.pieces)
        #: The last score is that of the end of a text.
        self.scores = scores if scores is not None else self.first(n)
        keys: dict[int, int] = {}
        for i, piece in enumerate(self.pieces):
            h = 0
            for j, b in enumerate(piece):
                h = (h * int(MULTIPLIER) + b + 1) & 0xFFFFFFFFFFFFFFFF
                if j + 1 == len(piece):
                    keys[h] = i
                else:
                    keys.setdefault(h, -1)
        order = sorted(keys)
        #: Hashes of all pieces and their beginnings; the piece, or -1.
        self.keys, self.piece = np.array(order, np.uint64), np.array([keys[k] for k in order], np.int64)
        self.deepest = max(map(len, self.pieces))
        self.by_bytes = {p: i for i, p in enumerate(self.pieces)}

    @staticmethod
    def first(n: int) -> np.ndarray:
        weights = 1 / (np.arange(n + 1) + 100.0)
        return np.log(weights / weights.sum())

    def arcs(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) over a matrix of words of one length, by start: the rows that hold a piece there."""
        n, length = words.shape
        for i in range(length):
            rows, h = np.arange(n), np.zeros(n, np.uint64)
            for j in range(i + 1, min(length, i + self.deepest) + 1):
                h = h * MULTIPLIER + words[rows, j - 1] + np.uint64(1)
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                alive = self.keys[at] == h
                rows, h, at = rows[alive], h[alive], at[alive]
                if not len(rows):
                    break
                piece = self.piece[at]
                whole = piece >= 0
                yield i, j, rows[whole], piece[whole]

    def forward(self, words: np.ndarray, keep: bool = False):
        """log alpha (words x length + 1), and the arcs if kept."""
        alpha = np.full((words.shape[0], words.shape[1] + 1), -np.inf)
        alpha[:, 0] = 0
        arcs = []
        for i, j, rows, piece in self.arcs(words):
            alpha[rows, j] = np.logaddexp(alpha[rows, j], alpha[rows, i] + self.scores[piece])
            if keep:
                arcs.append((i, j, rows, piece))
        return (alpha, arcs) if keep else alpha

    def expected(self, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected count of each piece over the segmentations of the words."""
        alpha, arcs = self.forward(words, keep=True)
        beta = np.full(alpha.shape, -np.inf)
        beta[:, -1] = 0
        total = np.zeros(len(self.scores))
        for i, j, rows, piece in reversed(arcs):
            through = self.scores[piece] + beta[rows, j]
            beta[rows, i] = np.logaddexp(beta[rows, i], through)
            total += np.bincount(piece, weights[rows] * np.exp(alpha[rows, i] + through - alpha[rows, -1]), len(total))
        return total

    def arcs_of(self, word: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, pieces) of the arcs of one word that start from ``first`` to before ``last``, by start and end."""
        at, h, found = np.arange(first, last), np.zeros(last - first, np.uint64), []
        for d in range(self.deepest):
            inside = at + d < len(word)
            at, h = at[inside], h[inside]
            h = h * MULTIPLIER + word[at + d] + np.uint64(1)
            k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            alive = self.keys[k] == h
            at, h, k = at[alive], h[alive], k[alive]
            if not len(at):
                break
            piece = self.piece[k]
            whole = piece >= 0
            found.append((at[whole], at[whole] + d + 1, piece[whole]))
        starts, ends, pieces = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ends, starts))
        return starts[order], ends[order], pieces[order]

    def stretches(self, word: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """One word of any length as numbers, and the stretches of starts whose arcs are held at a time."""
        return np.frombuffer(word, np.uint8).astype(np.uint64), [(a, min(a + STRETCH, len(word))) for a in range(0, len(word), STRETCH)]

    def walk(self, sums: list[float], to: np.ndarray, of: np.ndarray, scores: np.ndarray) -> None:
        """Adds arcs to the log sums in the order given: ``of`` must be final when its arcs come."""
        for j, i, s in zip(to.tolist(), of.tolist(), scores.tolist(), strict=True):
            a, b = sums[j], sums[i] + s
            if a == -math.inf:
                sums[j] = b
            elif a > b:
                sums[j] = a + math.log1p(math.exp(b - a))
            else:
                sums[j] = b + math.log1p(math.exp(a - b))

    def long_forward(self, word: bytes) -> list[float]:
        """log alpha of one word of any length: arcs found for a stretch of starts at a time, then one step an arc."""
        letters, stretches = self.stretches(word)
        alpha = [0.0] + [-math.inf] * len(word)
        for first, last in stretches:
            starts, ends, pieces = self.arcs_of(letters, first, last)
            self.walk(alpha, ends, starts, self.scores[pieces])
        return alpha

    def long_expected(self, word: bytes, weight: float, total: np.ndarray) -> None:
        letters, stretches = self.stretches(word)
        alpha, beta = np.array(self.long_forward(word)), [-math.inf] * len(word) + [0.0]
        for first, last in reversed(stretches):
            starts, ends, pieces = self.arcs_of(letters, first, last)
            scores = self.scores[pieces]
            self.walk(beta, starts[::-1], ends[::-1], scores[::-1])
            reached = np.array(beta[first : last + self.deepest + 1])
            total += np.bincount(pieces, weight * np.exp(alpha[starts] + scores + reached[ends - first] - alpha[-1]), len(total))

    @staticmethod
    def matrices(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, matrix) of words up to LONGEST, by length and in batches, each with the space before it."""
        lengths = np.array([len(w) for w in words], np.int64)
        for length in np.unique(lengths):
            if 0 < length <= LONGEST:
                own = np.flatnonzero(lengths == length)
                for part in np.array_split(own, math.ceil(len(own) / BATCH)):
                    joined = np.frombuffer(b"".join([b" " + words[k] for k in part]), np.uint8)
                    yield part, joined.reshape(len(part), int(length) + 1).astype(np.uint64)

    def likelihoods(self, words: list[bytes]) -> np.ndarray:
        """log10 of each word's marginal probability; the empty word is the end."""
        out = np.empty(len(words))
        for part, matrix in self.matrices(words):
            out[part] = self.forward(matrix)[:, -1]
        for k, w in enumerate(words):
            if len(w) > LONGEST:
                out[k] = self.long_forward(b" " + w)[-1]
            elif not w:
                out[k] = self.scores[-1]
        return out / LOG10

    def expectations(self, words: list[bytes], weights: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.scores))
        for part, matrix in self.matrices(words):
            total += self.expected(matrix, weights[part])
        for w, weight in zip(words, weights, strict=True):
            if len(w) > LONGEST:
                self.long_expected(b" " + w, weight, total)
            elif not w:
                total[-1] += weight
        return total


def words_of(text: bytes) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def short(word: bytes) -> bytes:
    """A word as it is broadcast: a long one by its digest, so that the size of the broadcast is bounded by HEAD."""
    return word if len(word) <= LONGEST else hashlib.sha256(word).digest()


def _bytes(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(train, text) -> (word, c, n): partial counts in training texts and in all; the end once a text."""
    train, rest, held = Counter(), Counter(), 0

    def out() -> pa.RecordBatch:
        both = [*train, *(w for w in rest if w not in train)]
        c = [train[w] for w in both]
        n = [train[w] + rest[w] for w in both]
        train.clear()
        rest.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(both, pa.binary()).cast(pa.string()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], names=["word", "c", "n"]
        )

    for batch in batches:
        for own, text in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), strict=True):
            to, read = train if own else rest, text.as_py() or b""
            to.update(words_of(read))
            to[b""] += 1
            held += len(read) if len(read) > LONG_TEXT else 0
            if len(train) + len(rest) > FLUSH or held > LONG_BYTES:
                yield out()
                held = 0
    yield out()


def _expect(path: str, scores):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path, scores.value)
        total = np.zeros(len(lattice.scores))
        for batch in batches:
            total += lattice.expectations(_bytes(batch.column(0)).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(float))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.float64())], names=["piece", "x"])

    return expect


def _likelihood(path: str, scores):
    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path, scores.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lattice.likelihoods(_bytes(batch.column(0)).to_pylist()), pa.float64())],
                names=[*batch.schema.names, "p"]
            )

    return likelihood


def _sum(head):
    """Replaces the last column, the text, by its sums over the broadcast words and the other words with their counts."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: (c > 0, math.log10(c + 0.5), p) for w, c, p in head.value}
        for batch in batches:
            sums, rest = [], []
            for text in _bytes(batch.column(batch.num_columns - 1)):
                n = k = 0
                base = model = 0.0
                other = []
                counts = Counter(words_of(text.as_py() or b""))
                counts[b""] = 1
                for w, f in counts.items():
                    n += f
                    if of := known.get(w if len(w) <= LONGEST else short(w)):
                        k += f * of[0]
                        base += f * of[1]
                        model += f * of[2]
                    else:
                        other.append((w, f))
                sums.append((n, k, base, model))
                rest.append(other)
            columns = [pa.array([s[i] for s in sums], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            flat = [x for other in rest for x in other]
            pairs = pa.StructArray.from_arrays(
                [pa.array([x[0] for x in flat], pa.binary()).cast(pa.string()), pa.array([x[1] for x in flat], pa.int32())],
                names=["word", "f"]
            )
            ends = np.cumsum([0, *map(len, rest)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *columns, pa.ListArray.from_arrays(pa.array(ends), pairs)],
                names=[*batch.schema.names[:-1], "n_tokens", "n_known", "base", "model", "rest"]
            )

    return score


def lexicon(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(train, text) -> every word of the corpus with c (count in training texts), n (in all) and p, its log10 likelihood.

    A null text is empty, and is counted with its end alone; repeated rows count each; words may be as long as a text. Other columns of ``docs`` don't matter. An
    empty table has no words. Without training words the likelihood is that of the pieces' first weights.
    """
    spark = shipped(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)
    counts = docs.select("train", "text").mapInArrow(_count, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    counts = written(counts, "lm-counts")
    # a few files hold many words, and the recursion is dear: tasks by words and not by bytes
    counts = counts.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), counts.count() // TASK), "word")
    n_pieces = len(Lattice(path).scores)
    scores = spark.sparkContext.broadcast(Lattice.first(n_pieces - 1))
    for _ in range(rounds):
        expected = np.full(n_pieces, SMOOTH)
        for r in counts.filter("c > 0").select("word", "c").mapInArrow(
            _expect(path, scores), "piece long, x double"
        ).groupBy("piece").agg(F.sum("x").alias("x")).collect():
            expected[r["piece"]] += r["x"]
        scores = spark.sparkContext.broadcast(np.log(expected / expected.sum()))
    schema = T.StructType([*counts.schema.fields, T.StructField("p", T.DoubleType())])
    return written(counts.mapInArrow(_likelihood(path, scores), schema), "lm-lexicon")


def score(docs: DataFrame, train: str = "train", text_col: str = "text", path: str | None = None, rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """``docs`` without the text, with n_tokens, n_known, train_tokens, base_score and score.

    ``train`` names a boolean column, true for the rows to learn from. A null text is empty: it has one token, its
    end. Repeated rows count each. With nothing to learn from, N = V = 0. Columns of those names are replaced; others may have
    any name. Whole texts are scored, of any length; equal texts score alike; an empty table gives no rows. Sums of floats come in no fixed order, so
    reruns agree to rounding.
    """
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = [c for c in docs.columns if c != text_col and c.lower() not in added]
    lex = lexicon(docs.select(F.coalesce(F.col(train), F.lit(False)).alias("train"), F.col(text_col).cast("string").alias("text")), path, rounds)
    sums = lex.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    step = F.floor(F.log("n") * 10)
    word = F.col("word").cast("binary")
    digest = F.when(F.octet_length("word") <= LONGEST, word).otherwise(F.unhex(F.sha2(word, 256)))
    top, least = 0, None
    for r in lex.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("s")).collect():
        top += r["k"]
        if top > head:
            break
        least = r["s"]
    frequent = [] if least is None else lex.filter(step >= least).select(digest.alias("word"), "c", "p").collect()
    known = docs.sparkSession.sparkContext.broadcast([(bytes(r["word"]), r["c"], r["p"]) for r in frequent])
    rows = docs.select(
        F.monotonically_increasing_id().alias("__id"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"),
        F.col(text_col).cast("string").alias("__text")
    )
    rest = T.ArrayType(T.StructType().add("word", "string").add("f", "integer"))
    schema = T.StructType([*rows.schema.fields[:2]]).add("n_tokens", "long").add("n_known", "long").add("base", "double").add("model", "double").add("rest", rest)
    rows = written(rows.mapInArrow(_sum(known), schema), "lm-sums")
    pairs = rows.select("__id", F.explode("rest").alias("r")).select("__id", "r.word", "r.f").join(lex.select("word", "c", "p"), "word")
    more = pairs.groupBy("__id").agg(
        F.sum(
            F.when(F.col("c") > 0, F.col("f")).otherwise(0)
        ).alias("k"), F.sum(F.col("f") * F.log10(F.col("c") + 0.5)).alias("b"), F.sum(F.col("f") * F.col("p")).alias("m")
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    room = math.log10(sums["n"] + 0.5 * (sums["v"] + 1))
    return rows.drop("rest").join(more, "__id", "left").select(
        "__row.*", "n_tokens", plus("n_known", "k").cast("long").alias("n_known"), F.lit(sums["n"]).cast("long").alias("train_tokens"),
        (plus("base", "b") - F.col("n_tokens") * room).alias("base_score"), plus("model", "m").alias("score"),
    )


def op5_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those that are not held out. A null id is neither held out nor learned from."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), F.coalesce(part != 1, F.lit(False)).alias("train"), "text"
    )
    return score(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
