"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging.

Texts are cut into pre-tokens. Pre-tokens not met before in the task are held as one ragged numpy array of symbols;
in each round every sequence applies its lowest-ranked pair, all its occurrences at once, and sequences without a
known pair leave with the number of their surviving symbols. A merge only ever makes pairs of higher rank than its
own, so a round per rank and sequence gives what merging one pair at a time gives.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depchron.sources.work import shipped, table

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens remembered per task, and the longest that is.
MEMORY, LONGEST = 400_000, 64
#: Symbols merged at a time; a pre-token of more than INDEXED bytes is merged by an index of its pairs.
BLOCK, INDEXED = 2_000_000, 4096


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for themselves, the others take the letters from 256 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Counter:
    """Counts the tokens of texts as the vocabulary's library does, without special tokens added."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        n = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * n + vocab[b] for a, b in pairs], np.int64)
        into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.n, self.keys, self.ranks, self.into = n, keys[order], order.astype(np.int64), into
        self.left, self.right = keys // n, keys % n
        self.none = len(pairs)
        letters = byte_letters()
        self.byte_ids = np.array([vocab[c] for c in letters], np.int64)
        self.special = regex.compile(
            "|".join(regex.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"])))
        ) if spec["added_tokens"] else None
        self.cut = regex.compile(public_tokenizers.PATTERN)
        self.memory: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; ``none`` where the vocabulary has no such pair."""
        pair = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], self.none)

    def merge(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each token."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), lengths)
        counts = lengths.copy()
        while len(symbols) > 1:
            inner = owner[1:] == owner[:-1]
            rank = np.append(np.where(inner, self.rank(symbols[:-1], symbols[1:]), self.none), self.none)
            first = np.flatnonzero(np.append(True, ~inner))
            lowest = np.minimum.reduceat(rank, first)
            lowest = np.repeat(lowest, np.diff(np.append(first, len(symbols))))
            go = (rank == lowest) & (rank < self.none)
            place = np.flatnonzero(go)
            merged = self.every_second(place, place + 1)
            symbols[merged] = self.into[rank[merged]]
            gone = np.zeros(len(symbols), bool)
            gone[merged + 1] = True
            counts -= np.bincount(owner[merged], minlength=len(counts))
            stay = ~gone & (lowest < self.none)
            symbols, owner = symbols[stay], owner[stay]
        return counts

    @staticmethod
    def every_second(places: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The pairs that merge, of those that lie from ``places`` to ``ends``: where neighbours share a symbol every second one, from the left."""
        at = np.arange(len(places))
        alone = np.append(True, places[1:] != ends[:-1])[: len(places)]
        return places[(at - np.maximum.accumulate(np.where(alone, at, 0))) % 2 == 0]

    def merge_one(self, token: bytes) -> int:
        """Symbols left of one long pre-token. The rounds are the same, but each looks only at the places that hold its pair."""
        symbols = self.byte_ids[np.frombuffer(token, np.uint8)]
        n = count = len(symbols)
        before, after, there = np.arange(-1, n - 1, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32), np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[after[places] < n]
            ranks = self.rank(symbols[places], symbols[after[places]])
            known = ranks < self.none
            places, ranks = places[known], ranks[known]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                r = int(ranks[a])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(places[a:b])

        wait(np.arange(n, dtype=np.int32))
        while heap:
            r = heapq.heappop(heap)
            places = np.unique(np.concatenate(waiting.pop(r)))
            places = places[there[places] & (after[places] < n)]
            # pairs that other merges have changed since are no longer there
            places = places[(symbols[places] == self.left[r]) & (symbols[after[places]] == self.right[r])]
            if not len(places):
                continue
            places = self.every_second(places, after[places])
            gone = after[places]
            symbols[places], there[gone], after[places] = self.into[r], False, after[gone]
            count -= len(places)
            inner = after[places] < n
            before[after[places[inner]]] = places[inner]
            earlier = before[places]
            wait(np.unique(np.concatenate([earlier[earlier >= 0], places])))
        return count

    def learn(self, tokens: list[str]) -> dict[str, int]:
        """Counts of new pre-tokens, some blocks at a time."""
        known: dict[str, int] = {}
        block: list[str] = []
        size = 0
        for t in [*tokens, None]:
            if block and (t is None or size > BLOCK):
                known.update(zip(block, self.merge([b.encode() for b in block]).tolist(), strict=True))
                block, size = [], 0
            if t is not None and len(t) > INDEXED:
                known[t] = self.merge_one(t.encode())
            elif t is not None:
                block.append(t)
                size += len(t)
        return known

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many special tokens the text itself holds."""
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return [p for part in parts for p in self.cut.findall(part)], len(parts) - 1
        return self.cut.findall(text), 0

    def counts(self, texts: list[str]) -> list[int]:
        out, memory = [], self.memory
        pieces = [self.pieces(t) for t in texts]
        new = {p for own, _ in pieces for p in own if p not in memory}
        local = self.learn(list(new))
        for own, special in pieces:
            out.append(special + sum(memory[p] if p in memory else local[p] for p in own))
        if len(memory) + len(local) > MEMORY:
            memory.clear()
        memory.update((k, v) for k, v in local.items() if len(k) <= LONGEST)
        return out


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            out, step, size, at = [], [], 0, 0
            for at in range(len(texts)):
                text = texts[at].as_py() or ""
                step.append(text)
                size += len(text)
                if size > BLOCK:
                    out += counter.counts(step)
                    step, size = [], 0
            out += counter.counts(step)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    return count


def token_counts(docs: DataFrame, path: str | None = None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens``; a null or empty text has none. A column ``n_tokens`` of ``docs`` is replaced.

    ``path`` is the vocabulary file on every node; the public one by default. Whole texts are counted, whatever
    their length, and repeated rows each; an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c.lower() != "n_tokens" and (keep_text or c != text_col)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([rows.schema["row"], T.StructField("n_tokens", T.LongType())])
    shipped(docs.sparkSession)
    return rows.mapInArrow(_counter(path or public_tokenizers.path(VOCABULARY)), schema).select("row.*", "n_tokens")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return token_counts(docs, keep_text=False).withColumn("over_limit", F.col("n_tokens") > 1024)
