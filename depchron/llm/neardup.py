"""Near-duplicates by BagMinHash signatures, banding and verification on multisets of word shingles.

A text's features are its five-word shingles with their numbers of occurrence (texts of fewer words: all words as one shingle).
Each signature register holds the earliest point of a Poisson process over (shingle, occurrence); two texts agree in a
register with a probability that is their weighted Jaccard similarity, sum of minima over sum of maxima. The
occurrences of a shingle are dealt into blocks (1, 2, 3-4, 5-8, ...), one process each with the block's size as its
rate; of a block that a text fills in part, the points at occurrences that it lacks are passed over. So a shingle that
occurs w times costs log2(w) processes and not w, and texts with different w still see the same points.

Candidates: texts that agree in all registers of a band share a bucket. The most central texts of a bucket (those whose
buckets are the fullest) become pivots, and every member is compared to these first. Then the members that are still in
different classes are compared with each other, every pair of them, so what the pivots leave is found as well; pairs
in one class need no further link. A bucket in which many members are outside its largest class, as texts of one template
that aren't alike make it, is first refined: its members must share a second band too, and where that leaves large
buckets, a third. Buckets are cut into tiles of bounded numbers and bytes. A pair is looked at in the
first band (or bands) that it shares and in no other: signatures first, then, for the members of a tile that are likely alike, the
exact multisets. A tile hands on only what joins texts that it has not joined yet, so no group of texts ever becomes
rows of pairs, and names one of its own members in all of them, so no text is in more links than it has tiles or a tile has
members. Classes are the connected components of the links.

Copies of a text are signed once as long as a task remembers them, and are collapsed before all else.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depchron.sources.work import shipped, table, written

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Pivots per bucket. Buckets of up to one more are compared in full by these alone.
PIVOTS = 4
#: Members of a bucket on each side of a tile, bytes of their texts, and pairs whose signatures are compared at a time.
CHUNK, CHUNK_BYTES, PAIRS = 512, 4 << 20, 1 << 15
#: Members outside its largest class from which on a bucket is refined, and the most bands that its members must then share. A pair of
#: similarity 0.8 misses two bands in 1 case of 10^6 and three in 1 of 10^5.
FINE, DEPTH = 1024, 3
#: Share of equal registers below which a pair is dropped unverified: over four standard deviations under SIMILAR.
LIKELY = 0.64
#: Bytes of text worked on at a time, and signatures of texts that a task remembers.
BLOCK, MEMORY = 1 << 19, 20_000
SALTS = 8
#: Sides of a tile that a row is on.
LEFT, RIGHT, BOTH = 0, 1, 2

BITS = 1 << np.arange(BANDS, dtype=np.int64)
M64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: ASCII white space to a space, A-Z to lower case.
PLAIN = bytes(0x20 if 0x09 <= c <= 0x0D else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:  # doubling
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


class Hasher:
    """Shingles of texts as 64-bit hashes, many texts at a time."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def words(self, text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, hash) of the words of a text whose white space is spaces and that ends in one, a block at a time."""
        start = 0
        while start < len(text):
            end = len(text)
            if end - start > BLOCK:
                end = text.rfind(b" ", start, start + BLOCK) + 1 or text.index(b" ", start) + 1
            a = np.frombuffer(text, np.uint8, end - start, start)
            if len(a) > len(self.up):
                self.up, self.down = _powers(BASE, 2 * len(a)), _powers(BASE_INVERSE, 2 * len(a))
            edges = np.flatnonzero(np.diff(np.concatenate(([False], a != 0x20)).astype(np.int8)))
            starts, ends = edges[::2], edges[1::2]
            sums = np.concatenate(([np.uint64(0)], np.cumsum((a.astype(np.uint64) + np.uint64(1)) * self.up[: len(a)], dtype=np.uint64)))
            yield start + starts, mix((sums[ends] - sums[starts]) * self.down[starts])
            start = end

    def shingles(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place of its text) of every shingle, in order."""
        blocks = [*self.words(b"".join([b" " + t.translate(PLAIN) + b" " for t in texts]))]
        starts, words = (np.concatenate([b[k] for b in blocks]) if blocks else np.zeros(0, t) for k, t in enumerate((np.int64, np.uint64)))
        owner = np.searchsorted(np.cumsum([len(t) + 2 for t in texts]), starts, side="right")
        n = np.bincount(owner, minlength=len(texts))
        first = np.concatenate(([0], np.cumsum(n)))[:-1]
        # a text of fewer words gives one shingle of all it has
        whole = np.flatnonzero((n > 0) & (n < SHINGLE))
        short = []
        for t in whole:
            h = int(n[t])
            for w in words[first[t] : first[t] + n[t]].tolist():
                h = (h * BASE + w) & M64
            short.append(h)
        h = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            h = h * np.uint64(BASE) + words[k : k + len(h)]
        own = owner[: len(h)]
        inside = own == owner[SHINGLE - 1 : SHINGLE - 1 + len(h)] if len(h) else np.zeros(0, bool)
        h, own = np.concatenate((h[inside], np.array(short, np.uint64))), np.concatenate((own[inside], whole))
        return mix(h), own

    def multisets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, place of its text, number) of every distinct shingle, by text and hash."""
        h, own = self.shingles(texts)
        order = np.lexsort((h, own))
        h, own = h[order], own[order]
        new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (own[1:] != own[:-1]))) if len(h) else np.zeros(0, np.int64)
        return h[new], own[new], np.diff(np.append(new, len(h)))


def signatures(h: np.ndarray, own: np.ndarray, n: np.ndarray, texts: int) -> np.ndarray:
    """BagMinHash registers (texts x REGISTERS) of multisets; rows of texts without shingles hold zeros."""
    blocks = np.ceil(np.log2(n)).astype(np.int64) + 1
    each = np.repeat(np.arange(len(h)), blocks)
    block = np.arange(len(each)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    size = np.where(block > 0, low, 1)
    have = np.minimum(n[each] - low, size)
    seed = mix(h[each] + block.astype(np.uint64) * np.uint64(BASE))
    row, time = own[each].astype(np.int64), np.zeros(len(each))
    best = np.full(texts * REGISTERS, np.inf)
    name = np.zeros(texts * REGISTERS, np.uint64)
    step = 0
    while len(row):
        step += 1
        u = mix(seed + np.uint64((step * 0xD1B54A32D192ED03) & M64))
        time = time - np.log((((u >> np.uint64(11)).astype(np.float64)) + 0.5) / (1 << 53)) / size
        v = mix(u)
        at = row * REGISTERS + (v % np.uint64(REGISTERS)).astype(np.int64)
        # the occurrence that the point falls on; those that the text lacks are passed over
        level = ((v >> np.uint64(16)) % size.astype(np.uint64)).astype(np.int64)
        ok = np.flatnonzero((level < have) & (time < best[at]))
        order = ok[np.argsort(-time[ok], kind="stable")]
        best[at[order]], name[at[order]] = time[order], v[order]  # of points in one register the earliest is written last
        last = best.reshape(texts, REGISTERS).max(1)
        go = time < last[row]
        seed, row, time, size, have = seed[go], row[go], time[go], size[go], have[go]
    return name.reshape(texts, REGISTERS)


class Multisets:
    """The shingles of some texts, to compare one text with many."""

    def __init__(self, h: np.ndarray, own: np.ndarray, n: np.ndarray, texts: int):
        self.feature, self.n = np.unique(h, return_inverse=True)[1], n
        self.edges = np.searchsorted(own, np.arange(texts + 1))
        self.size = np.bincount(own, n, texts)
        self.mark = np.zeros(len(h) + 1, np.int64)

    @classmethod
    def of(cls, hasher: Hasher, texts: list[bytes]) -> Multisets:
        parts = [(a, *hasher.multisets(texts[a:b])) for a, b in _slices(texts)]
        return cls(*[np.concatenate(x) for x in zip(*[(h, own + a, n) for a, h, own, n in parts], strict=True)], len(texts))

    def similarity(self, x: int, others: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of text ``x`` with others."""
        mine = slice(self.edges[x], self.edges[x + 1])
        self.mark[self.feature[mine]] = self.n[mine]
        count = self.edges[others + 1] - self.edges[others]
        ends = np.cumsum(count)
        at = np.repeat(self.edges[others] - ends + count, count) + np.arange(count.sum())
        sums = np.concatenate(([0], np.cumsum(np.minimum(self.mark[self.feature[at]], self.n[at]))))
        both = sums[ends] - sums[ends - count]
        self.mark[self.feature[mine]] = 0
        total = self.size[x] + self.size[others] - both
        return np.divide(both, total, out=np.zeros(len(others)), where=total > 0)


def similarity(h: np.ndarray, own: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of pairs (a, b) of texts of ``multisets``."""
    sets = Multisets(h, own, n, int(pairs.max()) + 1 if len(pairs) else 0)
    return np.array([sets.similarity(a, np.array([b]))[0] for a, b in pairs])


def _bytes(column: pa.Array) -> list[bytes]:
    return [t.as_py() or b"" for t in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())]


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size > BLOCK:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, md5, text) -> (id, md5, size, sig). Registers go on as 16 bits each, so a band of four is a number of 64 bits."""
    hasher = Hasher()
    known: dict[str, bytes] = {}
    for batch in batches:
        md5s, texts = batch.column(1).to_pylist(), _bytes(batch.column(2))
        new = {m: t for m, t in zip(md5s, texts, strict=True) if m not in known}
        if len(known) + len(new) > MEMORY:
            known = {m: known[m] for m in md5s if m in known}
        names, todo = list(new), list(new.values())
        for a, b in _slices(todo):
            h, own, n = hasher.multisets(todo[a:b])
            short = (signatures(h, own, n, b - a) >> np.uint64(40)).astype("<u2")
            some = np.bincount(own, minlength=b - a) > 0
            known.update((m, x.tobytes() if ok else b"") for m, x, ok in zip(names[a:b], short, some, strict=True))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(map(len, texts), pa.int64()), pa.array([known[m] for m in md5s], pa.binary())], names=["id", "md5", "size", "sig"]
        )


#: Rows of tiles: a member of a bucket in the bands ``bands`` (bits), in the tile (i, j), with its class so far. The bucket's key is in ``sig``.
MEMBER = "bands long, i int, j int, role int, id long, class long, sig binary"


class Tiles:
    """Rows of whole tiles as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch
        self.bands, i, j, self.role, self.id, self.label = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("bands", "i", "j", "role", "id", "class"))
        self.sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, REGISTERS)
        key = np.where(self.bands[:, None] & BITS, self.sig.view("<i8"), 0)
        changed = [c[1:] != c[:-1] for c in (self.bands, i, j)] + [(key[1:] != key[:-1]).any(1)]
        self.place = np.cumsum(np.append(False, np.any(changed, axis=0)))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Likely pairs (left, right) of rows of one tile and different classes, in the first bands that they share, by left."""
        place, role = self.place, self.role
        left, right = np.flatnonzero(role != RIGHT), np.flatnonzero(role != LEFT)
        count = np.bincount(place[right], minlength=place[-1] + 1)
        begin, each = (np.cumsum(count) - count)[place[left]], count[place[left]]
        part = np.cumsum(each) // PAIRS
        for rows in np.split(np.arange(len(left)), np.flatnonzero(part[1:] != part[:-1]) + 1):
            n = each[rows]
            x = np.repeat(left[rows], n)
            y = right[np.repeat(begin[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            ok = (self.label[x] != self.label[y]) & ((role[x] != BOTH) | (role[y] != BOTH) | (self.id[x] < self.id[y]))
            x, y = x[ok], y[ok]
            same = self.sig[x] == self.sig[y]
            like = np.flatnonzero(np.count_nonzero(same, axis=1) >= LIKELY * REGISTERS)
            shared, bands = same[like].reshape(-1, BANDS, ROWS).all(2), self.bands[x[like]]
            first = shared & (np.cumsum(shared, axis=1) <= np.bitwise_count(bands)[:, None])
            like = like[first @ BITS == bands]
            yield x[like], y[like]


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[Tiles]:
    """Rows that come sorted by tile, all rows of a tile together."""
    rest = None
    for batch in itertools.chain(batches, [None]):  # None: what is left over is whole too
        if batch is not None:
            if not batch.num_rows:
                continue
            rest = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if rest is None:
            return
        place = Tiles(rest).place
        whole = len(place) if batch is None else int(np.searchsorted(place, place[-1]))
        if whole:
            yield Tiles(rest.slice(0, whole))
            rest = rest.slice(whole)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of each tile, those that are in a likely pair."""
    for tiles in _whole_tiles(batches):
        some = np.zeros(len(tiles.id), bool)
        for x, y in tiles.pairs():
            some[x] = some[y] = True
        yield tiles.batch.filter(pa.array(some))


def joining(sets: Multisets, label: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], similar: float) -> Iterator[tuple[int, int]]:
    """Of some pairs (x, y), sorted by x, those that are alike and join two labels not yet joined; ``label`` is changed."""
    for xs, ys in pairs:
        edges = np.flatnonzero(np.diff(xs)) + 1
        for x, others in zip(xs[np.append(0, edges)].tolist() if len(xs) else (), np.split(ys, edges), strict=False):
            others = others[label[others] != label[x]]
            if not len(others):
                continue
            others = others[sets.similarity(x, others) >= similar]
            if len(others):
                found, at = np.unique(label[others], return_index=True)
                yield from ((x, y) for y in others[at].tolist())
                label[np.isin(label, found)] = label[x]


def stars(links: list[tuple[int, int]], role: np.ndarray) -> np.ndarray:
    """Links that join the same rows as ``links`` do, all of a component with one row, which isn't on the right side if any is not.

    Rows on the right side, pivots among them, are in many tiles; named in all links of each, they would become hubs.
    """
    up = np.arange(len(role))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in links:
        x, y = sorted((top(x), top(y)), key=lambda r: (role[r] == RIGHT, r))
        up[y] = x
    some = np.unique(np.array(links, np.int64))
    tops = np.array([top(x) for x in some.tolist()], np.int64)
    return np.stack((tops, some), axis=1)[tops != some]


def _verify(similar: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of tiles with their texts -> links (a, b): what is joined in each tile, each with the first of the tile's own members."""
        hasher = Hasher()
        for tiles in _whole_tiles(batches):
            edges = [*np.searchsorted(tiles.place, np.arange(tiles.place[-1] + 1)), len(tiles.place)]
            for a, b in itertools.pairwise(edges):
                tile = Tiles(tiles.batch.slice(a, b - a))
                sets = Multisets.of(hasher, _bytes(tile.batch.column("text")))
                found = stars([*joining(sets, tile.label.copy(), tile.pairs(), similar)], tile.role)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(tile.id[found].min(1)), pa.array(tile.id[found].max(1))], names=["a", "b"])

    return verify


def components(links: DataFrame) -> DataFrame:
    """(id, class): for every id in ``links`` (a, b) the smallest id of its connected component.

    Labels are lowered to the least label of the neighbours, then each label is replaced by the label of the id it
    names; the latter halves the way to the smallest id in every round. Each round is written, and nothing of it
    but a count reaches the driver.
    """
    both = written(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("class")).withColumnRenamed("a", "id"), "labels")
    while True:
        lower = both.join(labels.select(F.col("id").alias("b"), "class"), "b").groupBy("a").agg(F.min("class").alias("near")).withColumnRenamed("a", "id")
        one = labels.join(lower, "id").select("id", F.col("class").alias("old"), F.least("class", "near").alias("class"))
        up = labels.select(F.col("id").alias("class"), F.col("class").alias("above"))
        new = written(
            one.join(up, "class").select("id", F.least("class", "above").alias("class"), (F.least("class", "above") < F.col("old")).alias("moved")),
            "labels"
        )
        labels = new.select("id", "class")
        if new.filter("moved").isEmpty():
            return labels


def _chunk(n: Column) -> Column:
    """The chunk of ``id`` where there are ``n`` of them."""
    return F.pmod(F.xxhash64("id"), n).cast("int")


def _chunks(count: Column, size: Column) -> Column:
    """Chunks for so many members with texts of so many bytes."""
    return F.greatest(F.ceil(count / CHUNK), F.ceil(size / CHUNK_BYTES), F.lit(1)).cast("int")


def _to_pivots(member: DataFrame) -> DataFrame:
    """Tiles in which all members of a bucket meet its pivots; a tile has one chunk of the members."""
    central = member.groupBy("id").agg(F.sum("m").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("bands", "key").orderBy(F.desc("weight"), "id"))
    pivots = member.join(central, "id").select("bands", "key", "m", "bytes", "id", rank.alias("rank")).filter(F.col("rank") <= PIVOTS)
    n = _chunks(F.col("m"), F.col("bytes"))
    row = lambda i, role: ("bands", "key", i.alias("i"), F.lit(0).alias("j"), F.lit(role).alias("role"), "id", F.col("id").alias("class"))
    return member.select(*row(_chunk(n), LEFT)).unionAll(pivots.select(*row(F.explode(F.sequence(F.lit(0), n - 1)), RIGHT)))


def _unresolved(labelled: DataFrame) -> DataFrame:
    """Members of buckets (bands, key, id, size, class) of more than one class, with the bucket's largest class, the numbers of members
    and bytes outside it (``n``, ``bytes``) and its own (``main_n``, ``main_bytes``)."""
    bucket = ["bands", "key"]
    by_class = labelled.groupBy(*bucket, "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    sizes = by_class.groupBy(*bucket).agg(F.max(F.struct("n", "class", "bytes")).alias("main"), F.sum("n").alias("m"), F.sum("bytes").alias("all"))
    split = sizes.filter("main.n < m").select(
        *bucket, F.col("main.class").alias("main"), (F.col("m") - F.col("main.n")).alias("n"), (F.col("all") - F.col("main.bytes")).alias("bytes"),
        F.col("main.n").alias("main_n"), F.col("main.bytes").alias("main_bytes"),
    )
    return labelled.join(split, bucket)


def _refined(rows: DataFrame, sig: DataFrame) -> DataFrame:
    """Members of ``rows`` in buckets that share one more band, after those that they share already."""
    later = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(_bit(b).alias("bit"), _band_key(b).alias("next"))),
        lambda x: x["bit"] > F.col("bands"),
    )
    each = rows.select("bands", "key", "id", "size", "class").join(sig, "id").select("bands", "key", "id", "size", "class", F.explode(later).alias("x"))
    return each.select((F.col("bands") + F.col("x.bit")).alias("bands"), F.concat("key", "x.next").alias("key"), "id", "size", "class")


def _between_classes(member: DataFrame, labels: DataFrame, sig: DataFrame) -> DataFrame:
    """Tiles in which members of a bucket that are in different classes meet.

    Members of the bucket's largest class are only dealt to those of others, and not to each other.
    """
    rows = member.filter(F.col("m") > PIVOTS + 1).join(labels.hint("merge"), "id", "left").select(
        "bands", "key", "id", "size", F.coalesce("class", "id").alias("class")
    )
    dealt = None
    for depth in range(1, DEPTH + 1):
        rows = written(_unresolved(rows), "unresolved")
        large = (F.col("n") > FINE) & F.lit(depth < DEPTH)
        now = _dealt(rows.filter(~large))
        dealt = now if dealt is None else dealt.unionAll(now)
        if rows.filter(large).isEmpty():
            break
        rows = _refined(rows.filter(large), sig)
    return dealt


def _dealt(rows: DataFrame) -> DataFrame:
    """The tiles of unresolved buckets."""
    rows = rows.withColumns({"others": _chunks(F.col("n"), F.col("bytes")), "mains": _chunks(F.col("main_n"), F.col("main_bytes"))})
    tile = F.col("t")
    other = rows.filter("class != main").withColumn("c", _chunk(F.col("others"))).withColumn(
        "t", F.explode(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1))
    )
    role = F.when(tile == F.col("c"), BOTH).when(tile > F.col("c"), LEFT).otherwise(RIGHT)
    other = other.select("bands", "key", F.least("c", tile).alias("i"), F.greatest("c", tile).alias("j"), role.alias("role"), "id", "class")
    main = rows.filter("class = main").withColumn("t", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    return other.unionAll(
        main.select("bands", "key", tile.alias("i"), (F.col("others") + _chunk(F.col("mains"))).alias("j"), F.lit(RIGHT).alias("role"), "id", "class")
    )


def _band_key(band: Column) -> Column:
    """The registers of one band."""
    return F.substring("sig", 8 * band + 1, F.lit(8))


def _bit(band: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), band)


def _linked(dealt: DataFrame, sig: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) among the rows of each tile of ``dealt`` (bands, key, i, j, role, id, class)."""
    tile = ["bands", "key", "i", "j"]
    by_tile = lambda df, *more: df.repartition(*tile).sortWithinPartitions(*tile).select("bands", "i", "j", "role", "id", "class", "sig", *more)
    likely = written(by_tile(dealt.join(sig, "id")).mapInArrow(_likely, MEMBER), "likely")
    has = lambda b: F.col("bands").bitwiseAND(F.lit(1 << b)) != 0
    key = F.concat(*[F.when(has(b), _band_key(F.lit(b))).otherwise(F.lit(b"")) for b in range(BANDS)])
    both = likely.withColumn("key", key).join(texts, "id")
    return written(by_tile(both, "text").mapInArrow(_verify(similar), "a long, b long"), "links")


def links(nodes: DataFrame, texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Links (a, b) that join the ids of ``nodes`` (id, size, sig) that are alike; ``texts`` (id, text) has the texts, at least of all nodes.

    Pairs that share a bucket (in a large bucket of many classes: DEPTH buckets) are all compared, but for those that others join in one class
    already. A link joins two of one class, which others may have made alike.
    """
    sig = nodes.select("id", "sig")
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), _band_key)
    member = nodes.select("id", "size", F.posexplode(keys).alias("band", "key"))
    member = member.select("id", "size", _bit(F.col("band")).alias("bands"), "key")
    full = member.groupBy("bands", "key").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("bytes")).filter("m > 1")
    member = written(member.join(full, ["bands", "key"]), "members")
    # by merge at every size: the ids are no bounded set
    own = written(texts.join(member.select("id").distinct().hint("merge"), "id").dropDuplicates(["id", "text"]), "texts")
    found = _linked(_to_pivots(member), sig, own, similar)
    if member.filter(F.col("m") > PIVOTS + 1).isEmpty():
        return found
    return found.unionAll(_linked(_between_classes(member, components(found), sig), sig, own, similar))


def classes(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_copies) for every row of ``docs``: the smallest id of its class, and the rows with this very text.

    Texts without words are alike only if they are equal; a row with a null text or null id is left alone, as a
    class of its own (class_id is its id). Rows that share an id are one document: their classes are joined.
    An empty table gives no rows. Ids are whole numbers.
    """
    spark = shipped(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    given = rows.filter("id IS NOT NULL AND text IS NOT NULL")
    signed = given.select("id", F.md5("text").alias("md5"), "text").mapInArrow(_sign, "id long, md5 string, size long, sig binary")
    signed = written(signed, "signatures")
    nodes = written(
        signed.groupBy("md5").agg(F.min(F.struct("id", "size", "sig")).alias("s"), F.count(F.lit(1)).alias("copies")).select("md5", "copies", "s.*"),
        "nodes"
    )
    found = links(nodes.filter(F.octet_length("sig") > 0), given.select("id", "text"), similar)
    shared = signed.groupBy("id").agg(F.min("md5").alias("x"), F.max("md5").alias("y")).filter("x != y")
    if not shared.isEmpty():
        of = nodes.select("md5", F.col("id").alias("n"))
        ties = signed.join(shared.select("id"), "id").select("id", "md5").join(of, "md5").select(F.col("id").alias("a"), F.col("n").alias("b")).distinct()
        found = found.unionAll(ties)
    labels = components(found)
    # copies: only texts that occur more than once need their node looked up, and hot ones are dealt out over salts
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    many = nodes.filter("copies > 1").select("md5", F.col("id").alias("node"), "copies", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    placed = signed.select("id", "md5", salt.alias("salt")).join(many, ["md5", "salt"], "left").select(
        "id", F.coalesce("node", "id").alias("node"), F.coalesce("copies", F.lit(1)).alias("n_copies")
    )
    placed = placed.join(
        labels.select(F.col("id").alias("node"), "class"), "node", "left"
    ).select("id", F.coalesce("class", "node").alias("class_id"), "n_copies")
    alone = rows.filter("id IS NULL OR text IS NULL").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"))
    return placed.unionAll(alone)


def keep_first(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each class, the one with the smallest id, with its own columns; of rows that share that id, one.

    Rows with a null id or text stay, all of them. Whole texts of any length are compared; equal texts are one class. Columns may have any
    name. An empty table gives no rows.
    """
    found = classes(docs, id_col=id_col, **options)
    drop = written(found.filter("id != class_id").select("id").distinct(), "dropped")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"))
    kept = packed.join(drop.hint("merge"), "id", "left_anti")
    twice = packed.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").select("id")
    if twice.isEmpty():
        return kept.select("row.*")
    again = kept.join(twice, "id", "left_semi").dropDuplicates(["id"])
    return kept.join(twice, "id", "left_anti").unionByName(again).select("row.*")


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicates among all documents."""
    found = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_copies", (F.col("id").eqNullSafe(F.col("class_id"))).alias("kept"))
