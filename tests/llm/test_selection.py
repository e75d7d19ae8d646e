"""Mixing, sharding, quality, near-duplicates, decontamination and the pipeline."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from conftest import rows
from pyspark.sql import functions as F

from depchron.llm import decontamination, mixing, neardup, quality, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *texts, source="s"):
    full = [(i, t, "en", source, len(t or "")) if not isinstance(t, tuple) else (i, t[0], "en", t[1], len(t[0] or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(full, DOCS)


def prose(seed, n, words=400):
    r = random.Random(seed)
    return [f"w{r.randrange(words)}" for _ in range(n)]


class TestMixing:
    def test_water_filling(self, spark):
        df = docs(spark, *[("a b c d", s) for s in "aaabbbbbbbbbcccccc"], *[("x y", None)] * 2)
        got = rows(mixing.mix(df, mixing.token_count(F.col("text"))), "source", "size", "source_size", "target", "taken")
        total = sum(r[1] for r in got)
        targets = {r[0]: (r[2], r[3]) for r in got}
        assert sum(t for _, t in targets.values()) == pytest.approx(1.5 * total)
        assert all(t <= 2 * size for size, t in targets.values())
        assert sum(r[4] for r in got) == total * 3 // 2
        assert all(r[4] <= 2 * r[1] for r in got)
        for s, (_, t) in targets.items():
            assert abs(sum(r[4] for r in got if r[0] == s) - t) <= 4

    def test_edges(self, spark):
        df = docs(spark, None, "", "  \n", "a", "a").unionByName(docs(spark, "a")).withColumn("taken", F.lit("mine")).withColumn("rank", F.lit(7))
        got = rows(mixing.mix(df, mixing.token_count(F.col("text"))), "size", "taken", "rank")
        assert sorted(r[0] for r in got) == [0, 0, 0, 1, 1, 1] and sum(r[1] for r in got) == 4 and {r[2] for r in got} == {7}
        assert rows(mixing.mix(df.limit(0), mixing.token_count(F.col("text")))) == []
        assert all(r[0] == 0 for r in rows(mixing.mix(df.filter("text is null"), F.lit(0)), "taken"))

    def test_every_source_meets_its_target(self, spark):
        r = random.Random(6)
        df = docs(spark, *[(" ".join(prose(i, r.randrange(1, 90))), "hot" if i % 3 == 0 else f"s{r.randrange(9)}") for i in range(300)], ("long " * 4000, "big"))
        by = defaultdict(list)
        for s, size, target, taken in rows(mixing.mix(df, mixing.token_count(F.col("text"))), "source", "size", "target", "taken"):
            by[s, target].append((size, taken))
        assert all(abs(sum(k for _, k in x) - t) < 1 and all(k <= 2 * n for n, k in x) for (_, t), x in by.items())
        assert sum(k for x in by.values() for _, k in x) == sum(n for x in by.values() for n, _ in x) * 3 // 2

    def test_the_queue_is_cut_at_one_finish_time(self, spark):
        df = docs(spark, *[(" ".join(prose(i, 1 + i % 17)), "abc"[i % 3]) for i in range(300)]).withColumn("finish", F.lit("mine"))
        got = mixing.mix(df, mixing.token_count(F.col("text")), epochs=3, per_cent=40)
        whole, none = (got.filter(c).agg(F.max("finish"), F.min("finish")).first() for c in ("taken = size", "taken = 0"))
        assert whole[0] <= none[1] + 1e-9
        queue = [x["finish"] for x in mixing.in_order(got, 4).collect()]
        assert queue == sorted(queue) and len(queue) == got.filter("taken > 0").count()

    def test_taken_is_what_the_queue_sends_until_its_cut(self, spark):
        """A plain queue: all sendings sorted by finish time, cut at the time at which the budget has been sent; parts of words aside."""
        df = docs(spark, *[(" ".join(prose(i, 1 + i * 7 % 23)), "abcd"[min(3, i % 9)]) for i in range(250)])
        got = [r for r in mixing.mix(df, mixing.token_count(F.col("text"))).collect()]
        weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted({r["source"] for r in got}))}
        sendings = [(r["finish"] + e * r["source_size"] / weight[r["source"]], r["size"], r["source"], r["doc_id"]) for r in got for e in (0, 1)]
        sent = lambda t: sum(min(2 * size, weight[s] * t) for s, size in {(r["source"], r["source_size"]) for r in got})
        low, high = 0.0, 10.0**6
        for _ in range(200):
            low, high = ((low + high) / 2, high) if sent((low + high) / 2) < 1.5 * sum(r["size"] for r in got) else (low, (low + high) / 2)
        taken = Counter()
        for finish, size, s, i in sendings:
            taken[i] += min(size, max(0, size - (finish - low) * weight[s]))
        assert all(abs(taken[r["doc_id"]] - r["taken"]) <= 1 + 1e-6 for r in got) and len({r["taken"] / r["size"] for r in got}) > 2

    def test_all_sources_leave(self, spark):
        df = docs(spark, ("a b", "x"), ("c", "y"), ("d e f", None))
        got = rows(mixing.mix(df, mixing.token_count(F.col("text")), per_cent=500), "size", "target", "taken", "source_size")
        assert [(t, k) for _, t, k, _ in got] == [(2.0, 2), (4.0, 4), (6.0, 6)]

    def test_word_counts(self, spark):
        texts = [None, "", " ", "a", " a ", "\x0b\x0ca\tb\n\nc ", "\x1c x\u00a0y", "w " * 50_000, "x" * 5_000_000]
        assert [n for _, n in sorted(rows(docs(spark, *texts).select("doc_id", mixing.token_count(F.col("text")))))] == [0, 0, 0, 1, 1, 3, 2, 50_000, 1]

    def test_reruns_agree_whatever_the_partitions(self, spark):
        df = docs(spark, *[(" ".join(prose(i, i % 9)), f"s{i % 4}") for i in range(200)])
        first = rows(mixing.mix(df, mixing.token_count(F.col("text"))), "doc_id", "taken")
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        try:
            assert rows(mixing.mix(df.repartition(7), mixing.token_count(F.col("text"))), "doc_id", "taken") == first
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")

    def test_repeats(self, spark):
        df = docs(spark, *[(" ".join(prose(i, 10)), "ab"[i % 2]) for i in range(20)])
        got = Counter(r[0] for r in rows(mixing.mixed(df), "doc_id"))
        assert max(got.values()) == 2 and sum(got.values()) in (30, 31)
        assert mixing.mixed(df).columns == df.columns


class TestSharding:
    @pytest.mark.parametrize("n", [0, 1, 23, 24, 25, 500])
    def test_law(self, spark, n):
        df = docs(spark, *[("x", "abc"[i % 7 % 3]) for i in range(n)])
        by = defaultdict(list)
        for s, slot in rows(sharding.shard(df), "shard", "slot"):
            by[s].append(slot)
        assert all(sorted(x) == list(range(len(x))) for x in by.values())
        sizes = [len(by.get(s, [])) for s in range(24)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and set(by) <= set(range(24))

    def test_every_shard_matches_the_mixture(self, spark):
        df = docs(spark, *[("x", "hot" if i % 3 else f"s{i % 5}") for i in range(2400)])
        share = Counter(r[0] for r in rows(df, "source"))
        for (_, s), n in Counter(rows(sharding.shard(df), "shard", "source")).items():
            assert abs(n - share[s] / 24) <= 3

    def test_odd_rows(self, spark):
        df = docs(spark, "a", "a", None, ("b", None)).unionByName(docs(spark, "a")).withColumn("Shard", F.lit("x")).withColumn("id", F.lit(None).cast("int"))
        got = sharding.shard(df, 2)
        assert sorted(Counter(r[0] for r in rows(got, "shard")).values()) == [2, 3] and got.columns == [*DOCS.replace(",", "").split()[::2], "id", "shard", "slot"]

    def test_files(self, spark, tmp_path):
        sharding.write_shards(docs(spark, *"abcdef"), str(tmp_path / "s"), n_shards=2)
        assert rows(spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count()) == [(0, 3), (1, 3)]

    def test_many_files_a_shard(self, spark, tmp_path):
        import pyarrow.parquet as pq

        df = docs(spark, *[("x", f"s{i % 5}") for i in range(500)]).withColumn("slot", F.lit("mine"))
        sharding.write_shards(df, str(tmp_path / "s"), n_shards=3, rows_per_file=20)
        files = [pq.ParquetFile(f).read().column("slot").to_pylist() for f in (tmp_path / "s").rglob("*.parquet")]
        assert len(files) == 27 and all(f == sorted(f) for f in files) and sum(map(len, files)) == 500
        sharding.write_shards(df.limit(0), str(tmp_path / "none"))

    def test_against_a_plain_sort(self, spark):
        import hashlib

        df = docs(spark, *[("x", "hot" if i % 3 else f"s{i % 7}") for i in range(400)])
        key = lambda *x: int(hashlib.md5(":".join(map(str, x)).encode()).hexdigest()[:15], 16)
        by = defaultdict(list)
        for i, s in rows(df, "doc_id", "source"):
            by[s].append((key("shard-1", i), i))
        order = sorted(((r - key("shard-1-phase", s) / 2**60) / len(x), s, i) for s, x in by.items() for r, (_, i) in enumerate(sorted(x), 1))
        want = {i: divmod(p, 17) if p < 272 else (16 + (p - 272) // 16, (p - 272) % 16) for p, (_, _, i) in enumerate(order)}
        assert {i: (s, k) for i, s, k in rows(sharding.shard(df), "doc_id", "shard", "slot")} == want


def repeat_words(text):
    w = text.split()
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    return len({i + k for i, g in enumerate(grams) if g in twice for k in range(8)})


class TestQuality:
    def test_repeats_against_brute_force(self, spark):
        texts = [" ".join(prose(i, 40 + i, 3 if i % 2 else 60) + (prose(i, 12) * 2 if i % 3 == 0 else [])) for i in range(40)] + ["x " * 500, "a b c d e f g h", "a b c d e f g h " * 2, ""]
        got = dict(rows(quality.judge(docs(spark, *texts)), "doc_id", "n_repeat_words"))
        assert got == {i: repeat_words(t) for i, t in enumerate(texts)}

    def test_measures(self, spark):
        df = docs(spark, "a#b\nline one\nline one\n \n \n$é😀", None, "\x0b\x0c")
        assert rows(quality.judge(df), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "base_failed", "kept") == [
            (0, 6, 20, 2, 1, True, False), (1, 0, 0, 0, 0, True, False), (2, 0, 0, 0, 0, True, False)
        ]

    def test_a_bad_host_takes_its_documents_along(self, spark):
        good, bad = " ".join(prose(1, 60)), "few words"
        df = docs(spark, *[(good if i % 10 else bad, f"ok{i % 20}") for i in range(400)], *[(bad if i % 8 else good, "spam") for i in range(200)], (bad, "small"), (good, None))
        got = rows(quality.judge(df, drop_text=True), "source", "base_failed", "kept")
        assert not any(k for s, f, k in got if s == "spam") and any(not f for s, f, k in got if s == "spam")
        assert all(k == (not f) for s, f, k in got if s != "spam")
        assert rows(quality.keep(df).select("source").distinct().filter("source = 'spam'")) == [] and quality.keep(df).columns == df.columns

    def test_posterior_tail(self, spark):
        from math import comb

        # for whole numbers the beta distribution's tail is a binomial sum
        exact = lambda a, b, x: sum(comb(a + b - 1, k) * x**k * (1 - x) ** (a + b - 1 - k) for k in range(a))
        cases = [(a, b, x) for a in (1, 3, 40) for b in (1, 5, 200) for x in (0.05, 0.2, 0.5, 0.9)]
        df = spark.createDataFrame([(float(a), float(b), x) for a, b, x in cases], "a double, b double, x double")
        got = [r[0] for r in df.select(quality.tail(F.col("a"), F.col("b"), F.col("x"))).collect()]
        assert got == pytest.approx([exact(*c) for c in cases], abs=0.001)

    def test_planted_hosts(self, spark):
        """Hosts that fail one rule in most of their documents go if they are large enough to tell; others stay."""
        good, odd = " ".join(prose(1, 60)), " ".join(prose(2, 60)) + " " + "#" * 40
        hosts = {"h3": (3, 3), "h12": (12, 9), "h40": (40, 26), "h200": (200, 110), "fair": (200, 12), "lucky": (3, 2)}
        df = docs(spark, *[(odd if i < k else good, h) for h, (n, k) in hosts.items() for i in range(n)], *[(odd if i % 25 == 0 else good, f"ok{i % 30}") for i in range(900)])
        got = rows(quality.judge(df, drop_text=True), "source", "base_failed", "kept")
        assert not any(f for _, f, _ in got)
        assert {s for s, _, k in got if not k} == {"h12", "h40", "h200"}

    def test_a_long_text(self, spark):
        one, same = "x" * 5_000_000, "a b c d e f g h\n" * 60_000
        got = rows(quality.judge(docs(spark, one, same, " ".join(prose(1, 200_000, 10**6))), drop_text=True), "doc_id", "n_words", "word_chars", "n_dup_lines", "n_repeat_words", "base_failed")
        assert got[:2] == [(0, 1, 5_000_000, 0, 0, True), (1, 480_000, 480_000, 59_999, 480_000, True)] and got[2][-1] is False

    def test_salted_join_gives_the_same(self, spark, monkeypatch):
        df = docs(spark, *[(" ".join(prose(i, 30)), f"s{i % 3}" if i % 5 else None) for i in range(60)]).withColumn("kept", F.lit(1))
        want = rows(quality.judge(df), "doc_id", "kept", "worst_rate")
        monkeypatch.setattr(quality, "BROADCAST_HOSTS", -1)
        assert rows(quality.judge(df), "doc_id", "kept", "worst_rate") == want
        assert rows(quality.judge(df.limit(0))) == []


def shingles(text):
    w = text.encode().translate(neardup.PLAIN).split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute_classes(texts):
    s = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or (s[i] and jaccard(s[i], s[j]) >= 0.8):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


class TestNearDuplicates:
    def test_classes_against_brute_force(self, spark):
        r, texts = random.Random(5), []
        for k in range(60):
            base = prose(k, 30 + 5 * k) + ["again"] * (k % 4 * 10)
            texts.append(" ".join(base))
            for _ in range(k % 4):
                copy = list(base)
                for _ in range(r.randrange(1 + len(base) // 25)):
                    copy[r.randrange(len(copy))] = f"new{r.randrange(999)}"
                texts.append(" ".join(copy))
        texts += [texts[7], texts[7].upper(), texts[7].replace(" ", "\n"), "one two", "one two", "one  two", "", "", "x"]
        df = docs(spark, *texts)
        assert [c for _, c in sorted(rows(neardup.classes(df), "id", "class_id"))] == brute_classes(texts)

    def test_a_large_group_makes_few_pairs(self, spark):
        r, base = random.Random(1), prose(1, 200)
        texts = [" ".join(base[:p] + [f"n{r.randrange(10**6)}"] + base[p + 1 :]) for p in (r.randrange(200) for _ in range(400))]
        assert len({c for _, c in rows(neardup.classes(docs(spark, *texts)), "id", "class_id")}) == 1

    @pytest.mark.parametrize("fine", [1024, 4])
    def test_links_that_meet_no_pivot(self, spark, monkeypatch, fine):
        monkeypatch.setattr(neardup, "CHUNK", 50)
        monkeypatch.setattr(neardup, "FINE", fine)
        r, base, texts = random.Random(4), prose(1, 400, 10**6), []
        for k in range(120):  # few are alike, but all share buckets
            at = set(r.sample(range(0, 360, 5), 6))
            one = [f"k{k}-{p}" if p in at else w for p, w in enumerate(base)]
            texts += [" ".join(one), " ".join(one[:-33] + [f"z{k}-{p}" for p in range(33)])]
        got = [c for _, c in sorted(rows(neardup.classes(docs(spark, *texts)), "id", "class_id"))]
        assert got == brute_classes(texts)

    def test_a_template_is_refined_and_loses_no_pair(self, spark, monkeypatch):
        monkeypatch.setattr(neardup, "FINE", 8)
        dealt, plain = [], neardup._dealt
        monkeypatch.setattr(neardup, "_dealt", lambda df: dealt.append(df) or plain(df))
        template, texts = prose(2, 150), []
        for k in range(200):  # a pair is alike by a third, copies by 0.85
            own = prose(1000 + k, 140)
            texts += [" ".join(template + own)] + [" ".join(template + own[:-20] + [f"z{k}-{p}" for p in range(20)])] * (k % 3 == 0)
        df = docs(spark, *texts)
        assert [c for _, c in sorted(rows(neardup.classes(df), "id", "class_id"))] == brute_classes(texts)
        bands = [{bin(m).count("1") for (m,) in rows(x, "bands")} for x in dealt]
        assert bands[:2] == [{1}, {2}]

    def test_hubs_are_named_by_their_tiles(self):
        role = neardup.np.array([neardup.RIGHT, neardup.LEFT, neardup.LEFT, neardup.LEFT, neardup.RIGHT])
        assert sorted(map(tuple, neardup.stars([(0, 1), (0, 2), (0, 3)], role).tolist())) == [(1, 0), (1, 2), (1, 3)]
        assert neardup.stars([(0, 4)], role).tolist() == [[0, 4]]
        assert len(neardup.stars([], role)) == 0

    def test_odd_rows(self, spark):
        a, b = " ".join(prose(1, 50)), " ".join(prose(2, 50))
        df = spark.createDataFrame([(1, a), (1, a), (2, a), (None, a), (3, None), (4, None), (5, b), (2, b)], "doc_id long, text string").withColumn("bands", F.lit(1))
        assert rows(neardup.classes(df), "id", "class_id") == sorted([(1, 1), (1, 1), (2, 1), (None, None), (3, 3), (4, 4), (5, 1), (2, 1)], key=repr)
        assert rows(neardup.keep_first(df), "doc_id") == sorted([(1,), (None,), (3,), (4,)], key=repr)
        assert rows(neardup.classes(df.limit(0))) == []

    def test_long_texts(self, spark):
        word, same, long = "x" * 5_000_000, "never mind this " * 300_000, prose(3, 700_000, 10**6)
        near = [w if k % 100 else "new" for k, w in enumerate(long)]
        texts = [word, word + "y", word.upper(), same, same + "this", " ".join(long), " ".join(near), " ".join(reversed(long))]
        got = [c for _, c in sorted(rows(neardup.classes(docs(spark, *texts)), "id", "class_id"))]
        assert got == [0, 1, 0, 3, 3, 5, 5, 7]

    def test_estimates_weighted_similarity(self):
        texts = [" ".join(prose(1, 150) + ["x"] * 40).encode(), " ".join(prose(1, 120) + prose(2, 30) + ["x"] * 10).encode()]
        h, own, n = neardup.Hasher().multisets(texts)
        exact = neardup.similarity(h, own, n, neardup.np.array([(0, 1)]))[0]
        assert exact == pytest.approx(jaccard(*[shingles(t.decode()) for t in texts]))
        found = []
        for seed in range(30):  # other hashes, other processes
            s = neardup.signatures(neardup.mix(h + neardup.np.uint64(seed)), own, n, 2)
            found.append((s[0] == s[1]).mean())
        assert sum(found) / len(found) == pytest.approx(exact, abs=0.025)

    def test_components_of_chains(self, spark):
        chain = spark.range(1, 40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionAll(spark.createDataFrame([(100, 99), (99, 98)], "a long, b long"))
        assert {c for _, c in rows(neardup.components(chain))} == {1, 98}
        assert rows(neardup.components(chain.limit(0))) == []


class TestDecontamination:
    BENCH = [(1, "The quick, brown fox jumps over the lazy dog and then runs far away."), (2, "short one here"), (10, None), (None, "never mind this"), (3, "...")]

    def bench(self, spark):
        return spark.createDataFrame(self.BENCH, "item_id long, text string")

    @pytest.mark.parametrize("part_bytes", [1 << 20, 8])
    def test_hits(self, spark, part_bytes):
        filler = " ".join(prose(3, 300))
        texts = ["a SHORT (one) here short-one-here b", "the quick brown fox jumps over the lazy dog and then runs far", "The Quick brown fox jumps over the lazy dog and then runs", filler + " short one here", None, "", "short one"]
        found = decontamination.hits(docs(spark, *texts), self.bench(spark), part_bytes=part_bytes)
        got = rows(found.select("row.doc_id", "n_words", decontamination.n_hit().alias("h"), "items", decontamination.contaminated().alias("c")))
        assert got == [(0, 8, 6, ["2"], True), (1, 13, 13, ["1"], True), (2, 12, 0, [], False), (3, 303, 3, ["2"], False), (4, 0, 0, [], False), (5, 0, 0, [], False), (6, 2, 0, [], False)]

    def test_items_without_id_and_long_texts(self, spark):
        item = "The quick brown fox jumps over the lazy dog and then runs far away"
        df = docs(spark, "never mind this", "x" * 5_000_000, "never mind this " * 100_000, f"{item} " * 20_000)
        found = decontamination.hits(df, self.bench(spark), keep_text=False)
        got = rows(found.select("row.doc_id", "n_words", decontamination.n_hit().alias("h"), "items"))
        assert got == [(0, 3, 3, []), (1, 1, 0, []), (2, 300_000, 300_000, []), (3, 280_000, 280_000, ["1"])]

    def test_removal(self, spark):
        df = docs(spark, "x short one here y", "clean").withColumn("hits", F.lit(1)).withColumn("row", F.lit(2))
        assert rows(decontamination.remove_documents(df, self.bench(spark)), "doc_id", "hits", "row") == [(1, 1, 2)]
        assert rows(decontamination.remove_spans(df, self.bench(spark)), "text") == [("clean",), ("x  y",)]
        clash = df.withColumns({"__hits": F.lit(3), "hits_": F.lit(4), "__text": F.lit(5)})
        got = decontamination.remove_spans(clash, self.bench(spark))
        assert got.columns == clash.columns and rows(got, "text", "hits", "row", "__hits", "hits_", "__text") == [("clean", 1, 2, 3, 4, 5), ("x  y", 1, 2, 3, 4, 5)]
        assert rows(decontamination.remove_documents(df, self.bench(spark).limit(0)), "doc_id") == [(0,), (1,)]
        assert rows(decontamination.remove_spans(df.limit(0), self.bench(spark))) == []


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null ids, texts and sources, an empty text, a very long one, repeated rows, and columns with the stages' own names."""
    good = [" ".join(prose(300 + k, 60)) for k in range(12)]
    full = [(k, t, "en", f"s{k % 2}", len(t)) for k, t in enumerate(good)]
    full += [full[0], full[0], (None, good[1], "en", "s0", 1), (50, None, "en", "s0", 0), (51, "", None, "s1", 0), (52, " ".join(prose(77, 300_000, 10**6)), None, None, None), (53, "x" * 2_000_000, "en", "s1", 1)]
    names = ["size", "taken", "kept", "shard", "bands", "hits", "row", "id", "class_id", "text_", "__id_", "__id", "__times", "__hits", "__w", "__l", "n_words", "n_lines", "risk", "__host", "__none", "__salt", "flow", "times", "cum", "weight", "finish", "part", "__text", "col"]
    df = spark.createDataFrame(full, DOCS).withColumns({c: F.lit(i) for i, c in enumerate(names)})
    bench = spark.createDataFrame([(1, "no such words here at all"), (None, None)], "item_id long, text string")
    for folder, docs_, items in (("odd", df, bench), ("none", df.limit(0), bench), ("free", df, bench.limit(0))):
        at = tmp_path / folder
        docs_.write.parquet(str(at / "documents.parquet"))
        items.write.parquet(str(at / "benchmark.parquet"))
        now = spark.read.parquet(str(at / "documents.parquet"))
        for name, stage in corpus_pipeline.STAGES[:4]:
            now = stage(spark, now, str(at))
            assert now.columns == df.columns, name
            assert {tuple(r) for r in now.select(*names).distinct().collect()} <= {tuple(range(len(names)))}, name
            if name == "benchmark decontamination" and folder != "none":
                got = [r[0] for r in rows(now, "doc_id")]
                assert set(got) == {*range(12), 52, None} and len(got) == 14
        ids = {r[0] for r in rows(corpus_pipeline.run(spark, str(at)), "doc_id")}
        assert ids <= {*range(12), 52} and (52 in ids) == (folder != "none")


def test_pipeline_against_brute_force(spark, tmp_path):
    """A small corpus whose near-duplicates lie far from the threshold, so that the stages can be worked out by hand."""
    r, texts = random.Random(3), []
    for k in range(60):
        base = prose(100 + k, 80)
        texts.append((" ".join(base), f"s{k % 3}"))
        if k % 4 == 0:
            base[r.randrange(80)] = "changed"
            texts.append((" ".join(base), f"s{(k + 1) % 3}"))
    item = " ".join(prose(999, 20))
    texts += [("too short", "s0"), (" ".join(prose(7, 30) + item.split()), "s1"), (None, "s2"), ("a b c d e f g h " * 9, "s1")]
    df = docs(spark, *texts)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        df = stage(spark, df, str(tmp_path))
        assert df.columns == DOCS.replace(",", "").split()[::2], k
    want, seen = [], []
    for i, (t, _) in enumerate(texts):
        if t is None or len(t.split()) < 20 or 100 * repeat_words(t) > 30 * len(t.split()):
            continue
        if any(jaccard(shingles(t), s) >= 0.8 for s in seen):
            continue
        seen.append(shingles(t))
        if item not in t:
            want.append(i)
    assert [x[0] for x in sorted(rows(df, "doc_id"))] == want
    total, out = 80 * len(want), rows(corpus_pipeline.run(spark, str(tmp_path)), "doc_id", "shard", "slot")
    assert len(out) in (total * 3 // 2 // 80, total * 3 // 2 // 80 + 1) and {i for i, _, _ in out} <= set(want)
    sizes = Counter(s for _, s, _ in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
