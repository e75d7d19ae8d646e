"""Ranked search, the Merkle manifest and the extraction of pages."""

from __future__ import annotations

import hashlib
import html
import itertools
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from depchron.llm import dom, extract, layouts, merkle, search
from depchron.llm.queries import SQL


def twin(name, spark, folder, df):
    """The rows of a query and of its SQL."""
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    return rows(df, *names), sorted(found.fetchall(), key=repr)


# Search


def terms(text):
    lower = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute_search(docs, items, k):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n, total = sum(1 for x in counted if x[2]), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, query in items:
        scored = []
        for i, c, size in counted:
            m = 75 + 25 * size * n // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(query) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed=1, n=400):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Größe", "ÉTÉ", "x1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [" ".join(r.choices(vocabulary, weights, k=r.randrange(1, 80))) for _ in range(n)]
    texts += [texts[3]] * 70 + [None, "", "...", "ÉTÉ été W1-w2_w3", "w5 " * 30_000]
    items = [(f"i{j}", " ".join(r.choices(vocabulary, k=r.randrange(1, 12)))) for j in range(15)]
    items += [("same", texts[3]), ("same", "w1"), ("none", None), ("empty", ""), ("absent", "zzz"), (None, "w2 w2 Größe"), ("all", " ".join(vocabulary) * 2)]
    return texts, items


class TestSearch:
    def frames(self, spark, texts, items):
        docs = spark.createDataFrame([(i if i != 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
        docs = docs.unionByName(docs.limit(5)).repartition(3).withColumns({"n": F.lit("mine"), "terms": F.lit(1), "score": F.lit(2), "item_id": F.lit("z")})
        return docs, spark.createDataFrame(items, "item_id string, text string").withColumn("doc_id", F.lit(1))

    def test_brute_force(self, spark):
        docs, items = self.frames(spark, *corpus())
        want = brute_search([tuple(r) for r in docs.select("doc_id", "text").collect()], corpus()[1], 20)
        assert rows(search.search(docs, items), "item_id", "rank", "doc_id", "score") == want
        assert {r[0] for r in want} >= {"same", None, "all"} and not {r[0] for r in want} & {"none", "empty", "absent"}

    def test_parts_and_few(self, spark):
        docs, items = self.frames(spark, *corpus(2, 60))
        want = brute_search([tuple(r) for r in docs.select("doc_id", "text").collect()], corpus(2, 60)[1], 3)
        assert rows(search.search(docs, items, k=3, part_bytes=200), "item_id", "rank", "doc_id", "score") == want

    def test_masks_stop_early(self):
        r = random.Random(3)
        per = [r.randrange(1, 30) for _ in range(3000)]
        t = np.array([x for n in per for x in r.sample(range(40), n)], np.int32)
        block = search.Block(np.array(per), t, np.array([r.randrange(1, 4) for _ in t]), np.array(per), 3000, sum(per))
        query = [(i, 1 + i * i) for i in range(0, 40, 3)] + [(99, 5)]
        rows_, scores = block.top(query, 20, 1)
        every, all_scores = block.top(query, 10**9, 1)
        assert len(every) > 2000 and len(rows_) < 200
        cut = sorted(all_scores)[-20]
        assert sorted(rows_) == sorted(every[all_scores >= cut]) and sorted(scores) == sorted(all_scores[all_scores >= cut])
        assert len(block.top(query, 20, int(cut) + 10**15)[0]) == 0

    def test_empty(self, spark):
        docs, items = self.frames(spark, *corpus(2, 5))
        for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("text is null"), items)):
            assert rows(search.search(a, b)) == []

    def test_query(self, spark, tiny):
        got, want = twin("op11_search", spark, tiny, search.op11_search(spark, tiny))
        assert got == want and len(got) == 40 * 20


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(leaves):
    """Root and each leaf's siblings, as (left, right) by level."""
    level, place, proofs = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, at in enumerate(place):
            run = range(at // 3 * 3, min(at // 3 * 3 + 3, len(level)))
            proofs[i].append(("".join(level[j] for j in run if j < at), "".join(level[j] for j in run if j > at)))
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        place = [at // 3 for at in place]
    return level[0], proofs


class TestMerkle:
    def test_address_is_a_permutation_of_whole_subtrees(self):
        for levels in range(1, 9):
            at = np.concatenate([merkle.address(levels, d, np.arange(3**d)) for d in range(levels)])
            assert sorted(at.tolist()) == list(range(merkle.nodes(levels))) and at[0] == 0
            below = levels - levels // 2
            if levels > 1:  # each bottom tree lies in one piece
                for tree in range(3 ** (levels // 2)):
                    own = np.concatenate([merkle.address(levels, levels // 2 + d, np.arange(tree * 3**d, (tree + 1) * 3**d)) for d in range(below)])
                    assert own.max() - own.min() + 1 == len(own) == merkle.nodes(below)

    @pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 100, 2187])
    def test_block(self, n):
        leaves = [sha(str(i)) for i in range(n)]
        root, proofs = brute_tree(leaves)
        tree = merkle.build(leaves, n)
        left, right = merkle.paths(tree, n)
        assert merkle.root_of(tree) == root and [list(zip(a, b, strict=True)) for a, b in zip(left, right, strict=True)] == proofs

    def test_against_brute_force(self, spark):
        """Sources of 1 to 5,000 rows, so of several tables of blocks; nulls, ties, repeated rows, clashing names."""
        r = random.Random(4)
        data = [(i if i % 97 else None, "hot", "en", i, f"text {i}\n{r.random()}") for i in range(5000)]
        data += [(r.randrange(50), s, None if r.random() < 0.2 else "de", None, None if r.random() < 0.1 else "a\nb") for s in ("b", "", None, "ä", "z\n") for _ in range(r.randrange(1, 40))]
        data += [(1, "one", "x", 1, "")] + [(5, "twins", "x", 1, "same\n")] * 4
        docs = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
        docs = docs.withColumns({c: F.lit("mine") for c in ("group", "none", "place", "leaf", "digest", "part", "id", "block", "root", "left")})
        fields = [F.col(c) for c in merkle.FIELDS]
        got = merkle.manifest(docs, merkle.leaf_hash(fields), carry={"leaf_of": F.col("lang")})
        part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
        by = defaultdict(list)
        for d in data:
            by[d[1]].append((d[0], sha("".join(map(part, d)))))
        order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
        trees = {s: brute_tree([x[1] for x in sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s in order}
        root, tops = brute_tree([trees[s][0] for s in order])
        want = []
        for s, top in zip(order, tops, strict=True):
            leaves = sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
            want += [(i, s, leaf, trees[s][0], root, [a for a, _ in p + top], [b for _, b in p + top]) for (i, leaf), p in zip(leaves, trees[s][1], strict=True)]
        found = got.withColumn("again", merkle.folded(F.col("leaf"), F.col("left"), F.col("right")))
        assert rows(found, "id", "source", "leaf", "subroot", "root", "left", "right") == sorted(want, key=repr)
        assert {r[0] for r in rows(found, "again")} == {root} and set(map(str, rows(found, "leaf_of"))) == {"('en',)", "('de',)", "(None,)", "('x',)"}

    def test_empty(self, spark):
        docs = spark.createDataFrame([], "doc_id long, source string")
        assert rows(merkle.manifest(docs, merkle.leaf_hash([F.col("doc_id")]))) == []

    def test_query(self, spark, tiny):
        got, want = twin("op12_merkle", spark, tiny, merkle.op12_merkle(spark, tiny))
        assert got == want
        given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
        changed = {i for i, t in given.items() if zlib.crc32(str(i).encode()) % 2 == 0 and "\n" in (t or "")}
        found = rows(merkle.op12_merkle(spark, tiny), "doc_id", "verified")
        assert changed and {i for i, ok in found if not ok} == changed


# Pages


def article(page):
    """The text of the given pages' one article, by its tags."""
    found = re.search(r"<article>(.*)</article>", page, re.S)
    blocks = re.split(r"</?(?:p|h1)>", found[1].replace("<br>", " "))
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks) if x)


class TestPages:
    def kept(self, source):
        page = dom.Page(source)
        return page.text([True] * len(page.parent))

    @pytest.mark.parametrize(
        "source, text",
        [
            ("", ""), ("a &amp b &lt;i&gt; &#233;&nbsp; c", "a & b <i> é c"), ("<p>a<p>b<div>c</div>d", "a\nb\nc\nd"), ("<p>a<b>b<br>c<p>d</b>e", "ab c\nde"),
            ("x<script>if(a<b){'</p>'}</script>y<style>p{}</style><!-- <p>no</p> -->z", "xyz"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "a\nb\nc\nd\ne"),
            ("<table><tr><td>a<td>b<tr><td>c</table>d", "a\nb\nc\nd"), ("<a title='it>s' href=x'y>t</a> < 3 <3", "t < 3 <3"), ("a<script>never closed <p>b", "a"),
            ("<title>t</title><P CLASS=x>A  \n\tb</P>", "A b"), ("a</p>b</div></b>c", "a\nb\nc"), ("a<!-->b<!-- c", "ab"), ("a<textarea><p>x</textarea>b<", "ab<"),
        ],
    )
    def test_reader(self, source, text):
        assert self.kept(source) == text

    def test_long_and_deep(self):
        assert self.kept("<div>" * 60_000 + "x" + "</div>" * 60_000 + "y") == "x\ny"
        assert len(self.kept("<p>word " * 50_000)) == 50_000 * 5 - 1
        page = dom.Page("<div class='a b'>" * 3000 + "x <b>y</b>")
        assert len(page.features({})) == 3001 and len({len(f) for f in page.features({})}) == 1
        assert extract.decode(page.parent, [0.0] * 3000 + [9.0]) == [False] * 3000 + [True]

    def test_decoding_is_the_best_of_all(self):
        r = random.Random(9)

        def value(parent, odds, states):
            total = 0.0
            for i, s in enumerate(states):
                above = states[parent[i]] if i else 0
                if s == 1 and above == 2 or s == 0 and above or s == 2 and above == 0:
                    return None  # ways down go 0 .. 1 .. 2
                total += odds[i] * (s == 1) - extract.ENTER * (s == 1 and above == 0) - extract.LEAVE * (s == 2 and above == 1)
            return total

        for _ in range(40):
            n = r.randrange(1, 8)
            parent = [-1] + [r.randrange(i) for i in range(1, n)]
            odds = [r.uniform(-4, 4) for _ in range(n)]
            best = max(v for states in itertools.product((0, 1, 2), repeat=n) if (v := value(parent, odds, states)) is not None)
            kept, states = extract.decode(parent, odds), []
            for i in range(n):
                above = states[parent[i]] if i else 0
                states.append(1 if kept[i] else 2 if above else 0)
            assert value(parent, odds, states) == pytest.approx(best)

    def test_held_out_layouts(self, spark):
        """Pages of numbers that the trees have not seen: words found and words right, and whole texts."""
        made = [layouts.page(n) for n in range(10**6, 10**6 + 300)]
        frame = spark.createDataFrame(list(enumerate(made)), "page_id long, html string")
        got = dict(rows(extract.extract(frame), "page_id", "text"))
        both = found = there = same = 0
        for i, source in enumerate(made):
            page = dom.Page(source, layouts.LABEL)
            a, b = Counter(got[i].split()), Counter(page.text([x == 1 for x in page.label]).split())
            both, found, there, same = both + (a & b).total(), found + a.total(), there + b.total(), same + (a == b)
        assert both / found > 0.97 and both / there > 0.97 and same / 300 > 0.9

    def test_pages_written_by_hand(self, spark):
        p = "The council met on Tuesday, and it agreed on a plan for the old harbour. Work begins in spring."
        q = "Residents had asked for more trees; the plan has forty of them, most along the quay."
        made = {
            "main": (f"<body><header class=site-header><h1>Daily</h1></header><nav class=menu><a href=/>Home</a> <a href=/b>News</a></nav><main id=content><h1>Harbour plan</h1>"
                     f"<p>{p}<p>{q}</main><aside class=sidebar><h3>Popular</h3><ul><li><a href=/x>Ten tips</a></ul></aside><footer>&copy; Daily</footer>", f"Harbour plan\n{p}\n{q}"),
            "comments": (f'<div id="page"><div class="cookie-notice"><p>We use cookies to make this site better.</p><button>OK</button></div><div class="post-content"><h1>Plan</h1><p>{p}</p>'
                         f'<div class="advert">Buy new boats now.</div><p>{q}</p></div><section id="comments"><h3>2 comments</h3><div class="comment"><p>{q} I like it.</p></div>'
                         f"<form><textarea>x</textarea><button>Send</button></form></section></div>", f"Plan\n{p}\n{q}"),
            "plain": (f"<p>{p}</p><p>{q}</p>", f"{p}\n{q}"), "none": (None, ""), "empty": ("", ""), "head": ("<html><head><title>x</title></head><body></body></html>", ""),
        }
        frame = spark.createDataFrame([(k, v[0]) for k, v in made.items()] * 2, "page_id string, html string").withColumns({"text": F.lit("mine"), "words": F.lit(1)})
        got = rows(extract.extract(frame), "page_id", "text", "words")
        assert got == sorted([(k, v[1], 1) for k, v in made.items()] * 2, key=repr)
        assert rows(extract.extract(frame.limit(0))) == []

    def test_query(self, spark, tiny):
        given = [tuple(r) for r in spark.read.parquet(f"{tiny}/pages.parquet").select("page_id", "url", "html").collect()]
        want = sorted(((i, u, article(h), len(article(h))) for i, u, h in given), key=repr)
        assert rows(extract.op13_extract(spark, tiny), "page_id", "url", "text", "n_chars") == want
