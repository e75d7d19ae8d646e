"""Secret scans: fixed patterns, and a randomness test battery for whatever else looks like a key.

Candidates are unbroken runs of 16 or more characters of the base64 alphabets that hold a letter. For each the narrowest
encoding that fits is inferred (hexadecimal, base 32, base 36, base 62, base 64), its characters become numbers, and
three tests ask whether these are independent uniform draws: chi-squared over the alphabet, the number of runs above
and below the middle, and lag-1 serial correlation. The smallest of the three p-values, tripled, is the candidate's.

What is reported are candidates that look random, so false discoveries are structured ones (identifiers, long words,
paths). How often structured text passes is measured on decoys: from every document one stretch of its prose, from a place, of a
length and in a style (as it stands, or with each word's first letter in upper case) that its hash picks, put through
the same battery. For each band of lengths and encoding, the candidates with the largest p-values are reported as long as
(candidates of the band x share of its decoys that have this encoding and pass) stays under ``q`` times the number
reported. Short tokens, of which much prose would pass, are so held to a stricter limit than long ones. Candidates whose
randomness is rejected by the Benjamini-Hochberg rule at the same ``q`` are never reported; where a band has no decoys, since
the corpus has no prose, this rule decides alone.

The text is read once. What both rules need of the corpus is a histogram of p-values per band, of bounded size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depchron.llm import common
from depchron.sources.work import table, written

#: kind -> (pattern, group that must be so long, least length). Case matters but for the keywords.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]++", 0, 16),
    "hex": (r"[0-9a-f]++", 0, 32),
}
#: The same matches for patterns whose failing matches can hide no other, with the length inside, so that less is cut.
FAST = {"access": r"AKIA[A-Z0-9]{12,}+", "hex": r"[0-9a-f]{32,}+"}
#: What a text that has an ``assign`` span holds, in lower case.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Least length of a candidate.
LEAST = 16
CANDIDATE = rf"[\w+/-]{{{LEAST},}}+={{0,2}}"
#: All spans of other kinds than ``assign`` hold so many characters between + and z. Most prose has none, and this one range is cheap to test.
RUN = rf"[+-z]{{{LEAST}}}"
#: encoding -> alphabet, in order of preference.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "base64any": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
#: Lower ends of the bands of lengths.
BANDS = (LEAST, 20, 24, 32, 40, 64, 128)
#: Steps of -log10(p) in the histogram, and their number.
STEP, STEPS = 0.02, 1000


def _places(text: Column, may: Column, pattern: str, group: int = 0) -> Column:
    """(s, e, n, m) of all matches: start and end in code points, length of ``group``, the match. The text between matches tells where they are.

    Where ``may`` is false, the text is known to hold none.
    """

    def of(pieces: Column) -> Column:
        found = common.let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: common.let(_ends(pieces, m), lambda ends: _structs(m, ends)))
        return F.when(F.size(pieces) > 1, found)

    def _ends(pieces: Column, m: Column) -> Column:
        return common.prefix_sums(F.transform(m, lambda x, i: (F.length(F.get(pieces, i)) + F.length(x)).cast("long")))

    def _structs(m: Column, ends: Column) -> Column:
        inner = lambda x: F.length(F.regexp_extract(x, pattern, group) if group else x)
        return F.transform(m, lambda x, i: F.struct((F.get(ends, i) - F.length(x)).alias("s"), F.get(ends, i).alias("e"), inner(x).alias("n"), x.alias("m")))

    empty = F.array().cast("array<struct<s:bigint,e:bigint,n:int,m:string>>")
    return F.coalesce(F.when(may, common.let(F.split(text, pattern, -1), of)), empty)


def base_spans(text: Column, named: Column, runs: Column) -> Column:
    """array of (s, o, kind, e), sorted; ``o`` is the kind's place in KINDS. ``named`` and ``runs``: whether the text has a keyword and a RUN."""

    def of(o: int, kind: str, pattern: str, group: int, least: int) -> Column:
        found = F.filter(_places(text, named if kind == "assign" else runs, FAST.get(kind, pattern), group), lambda x: x["n"] >= least)
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(o).alias("o"), F.lit(kind).alias("kind"), x["e"].alias("e")))

    each = [of(o, kind, *rule) for o, (kind, rule) in enumerate(KINDS.items())]
    return F.array_sort(F.concat(*each))


def _tail(z: Column) -> Column:
    """-log10 of the upper tail of the normal distribution, by the logistic form that is good to 2e-4 near the middle."""
    odds = F.least(1.5976 * z + 0.070565992 * z * z * z, F.lit(690.0))
    return F.log10(1 + F.exp(odds))


def _equal_pairs(v: Column) -> Column:
    """Ordered pairs of equal values, that is the sum of the squared counts: in sorted order, twice each value's distance to the first of its kind, plus one."""

    def of(a: Column) -> Column:
        step = lambda s, x: F.when(x == s["x"], F.struct(x.alias("x"), (s["c"] + 2).alias("c"), (s["t"] + s["c"] + 2).alias("t"))).otherwise(
            F.struct(x.alias("x"), F.lit(1.0).alias("c"), (s["t"] + 1).alias("t"))
        )
        return F.aggregate(a, F.struct(F.lit(-1.0).alias("x"), F.lit(1.0).alias("c"), F.lit(0.0).alias("t")), step)["t"]

    return of(F.sort_array(v))


def surprise(token: Column) -> Column:
    """(enc, n, l) of a token: the inferred encoding (null: none), its length, and -log10 of the battery's p-value."""
    return common.let(F.regexp_replace(token, "=++$", ""), _surprise)


def _surprise(body: Column) -> Column:
    fits = lambda abc: F.translate(body, abc, "") == ""
    none = F.lit(None).cast("struct<enc:string,abc:string>")
    enc = reduce(
        lambda rest, x: F.when(fits(x[1]), F.struct(F.lit(x[0]).alias("enc"), F.lit(x[1]).alias("abc"))).otherwise(rest),
        reversed(ALPHABETS.items()), none
    )

    def battery(e: Column) -> Column:
        k = F.length(e["abc"]).cast("double")
        chars = F.filter(F.split(body, ""), lambda c: c != "")
        return common.let(F.transform(chars, lambda c: F.position(c, e["abc"]).cast("double") - 1), lambda v: tests(e, k, F.size(v).cast("double"), v))

    def tests(e: Column, k: Column, n: Column, v: Column) -> Column:
        def total(a: Column) -> Column:
            return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

        high = lambda x: (2 * x >= k)
        turns = F.filter(F.transform(v, lambda x, i: (i > 0) & (high(x) != high(F.get(v, F.greatest(i - 1, F.lit(0)))))), lambda t: t)
        sums = F.struct(
            _equal_pairs(v).alias("squares"),
            F.size(F.filter(v, high)).cast("double").alias("high"),
            (1 + F.size(turns)).cast("double").alias("runs"),
            total(v).alias("s1"),
            total(F.transform(v, lambda x: x * x)).alias("s2"),
            total(F.transform(v, lambda x, i: x * F.get(v, F.when(i + 1 < F.size(v), i + 1).otherwise(0)))).alias("lagged"),
        )
        return common.let(sums, lambda s: levels(e, k, n, s))

    def levels(e: Column, k: Column, n: Column, s: Column) -> Column:
        df = k - 1
        chi = (F.pow(F.greatest((k / n * s["squares"] - n) / df, F.lit(0.0)), F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        mean = 2 * s["high"] * (n - s["high"]) / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        by_runs = F.when(spread > 0, F.greatest(_tail(F.abs(s["runs"] - mean) / F.sqrt(spread)) - 0.30103, F.lit(0.0))).otherwise((n - 1) * 0.30103)
        room = n * s["s2"] - s["s1"] * s["s1"]
        r = (n * s["lagged"] - s["s1"] * s["s1"]) / F.when(room > 0, room)
        z = F.abs(r + 1 / (n - 1)) * (n - 1) * F.sqrt(n - 2) / n
        by_lag = F.when(room > 0, F.greatest(_tail(z) - 0.30103, F.lit(0.0))).otherwise(n * F.log10(k))
        worst = F.greatest(_tail(chi), by_runs, by_lag) - F.log10(F.lit(3.0))
        return F.struct(e["enc"].alias("enc"), n.cast("int").alias("n"), F.greatest(worst, F.lit(0.0)).alias("l"))

    return common.let(enc, lambda e: F.when(e.isNotNull(), battery(e)))


def candidates(text: Column, base: Column, runs: Column) -> Column:
    """array of (s, e, enc, n, l): candidates outside the base spans that fit an encoding."""
    found = F.filter(_places(text, runs, CANDIDATE), lambda x: x["m"].rlike(r"\p{Alpha}") & ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    tested = F.transform(
        found,
        lambda x: common.let(
            surprise(x["m"]),
            lambda t: F.struct(x["s"].alias("s"), x["e"].alias("e"), t["enc"].alias("enc"), t["n"].alias("n"), t["l"].alias("l"))
        )
    )
    return F.filter(tested, lambda x: x["enc"].isNotNull())


def decoy(text: Column) -> Column:
    """(enc, n, l) of a stretch of the text's prose, without what looks like a candidate; null where the text is too short there."""

    def of(h: Column) -> Column:
        n = F.element_at(F.array(*map(F.lit, BANDS)), (F.pmod(h, F.lit(len(BANDS))) + 1).cast("int"))
        start = F.pmod(F.shiftright(h, 8), F.greatest(F.length(text) - 8 * n, F.lit(1))) + 1
        piece = common.let(F.substring(text, start.cast("int"), 8 * n), lambda p: F.when(p.rlike(RUN), F.regexp_replace(p, CANDIDATE, "")).otherwise(p))
        styled = common.let(piece, lambda p: F.when(F.pmod(F.shiftright(h, 4), F.lit(2)) == 1, F.initcap(p)).otherwise(p))
        plain = F.left(F.regexp_replace(styled, r"\P{Alnum}++", ""), n)
        return common.let(plain, lambda p: F.when((F.length(p) == n) & p.rlike(r"\p{Alpha}"), surprise(p)))

    return common.let(F.xxhash64(text), of)


def _band(n: Column) -> Column:
    return reduce(lambda a, b: a + b, [(n >= x).cast("int") for x in BANDS])


def _bin(level: Column) -> Column:
    return F.least(F.floor(level / STEP), F.lit(STEPS)).cast("int")


def limits(scanned: DataFrame, q: float) -> dict[str, int]:
    """"band:encoding" -> bin of -log10(p) from which on nothing is reported; at most a row per band and encoding reaches the driver.

    ``scanned`` has ``cands`` and ``decoy``. No row means no limit.
    """
    own = F.transform("cands", lambda c: F.struct(c["enc"].alias("enc"), c["n"].alias("n"), c["l"].alias("l"), F.lit(1).alias("c")))
    both = F.when(F.col("decoy").isNotNull(), F.concat(own, F.array(F.struct("decoy.enc", "decoy.n", "decoy.l", F.lit(0).alias("c"))))).otherwise(own)
    key = [_band(F.col("t.n")).alias("band"), F.col("t.enc").alias("enc"), _bin(F.col("t.l")).alias("b")]
    bins = scanned.select(F.explode(both).alias("t")).groupBy(*key).agg(F.sum("t.c").alias("cands"), F.sum(1 - F.col("t.c")).alias("decoys"))
    band, w = Window.partitionBy("band"), Window.partitionBy("band", "enc")
    up, down = w.orderBy("b"), w.orderBy(F.desc("b"))
    ranked = bins.withColumns({
        "found": F.sum("cands").over(up), "passed": F.sum("decoys").over(up), "above": F.sum("cands").over(down), "own": F.sum("cands").over(w),
        "m": F.sum("cands").over(band), "n": F.sum("decoys").over(band),
    })
    bounded = F.col("m") * (1 + F.col("passed")) <= q * F.col("found") * (1 + F.col("n"))
    rejected = (F.col("above") > 0) & (F.col("own") * F.pow(F.lit(10.0), -F.col("b") * STEP) <= q * F.col("above"))
    ends = ranked.groupBy("band", "enc").agg(
        F.max("n").alias("n"), F.max(F.when(bounded, F.col("b") + 1)).alias("bounded"),
        F.min(F.when(rejected, F.col("b"))).alias("rejected")
    )
    last = F.least(F.when(F.col("n") > 0, F.coalesce("bounded", F.lit(0))), "rejected")
    return {f"{r['band']}:{r['enc']}": r["last"] for r in ends.select("band", "enc", last.alias("last")).filter("last IS NOT NULL").collect()}


def scan(docs: DataFrame, q: float = 0.05, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``found``: array of (s, o, kind, e), sorted; the method's own are of kind ``random``.

    A null or empty text has no spans. Base spans always stay; the method's never overlap them. Repeated rows count
    each. A column ``found`` of ``docs`` is replaced. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in docs.columns if c.lower() != "found"]
    row = F.struct(*[F.col(f"`{c}`") for c in kept if keep_text or c != text_col]).alias("__row")
    # a projection for each step: what it adds is used more than once by the next and computed once
    lower = docs.select(row, text.alias("__text"), F.lower(text).alias("__lower"), text.rlike(RUN).alias("__runs"))
    named = reduce(lambda a, b: a | b, [F.contains("__lower", F.lit(k)) for k in KEYWORDS])
    based = lower.select("__row", "__text", "__runs", base_spans(F.col("__text"), named, F.col("__runs")).alias("base"))
    found = candidates(F.col("__text"), F.col("base"), F.col("__runs"))
    scanned = written(based.select("__row", "base", found.alias("cands"), decoy(F.col("__text")).alias("decoy")), "secrets")
    ends = limits(scanned, q)
    known = F.create_map(*[F.lit(x) for kv in ends.items() for x in kv]) if ends else None
    name = lambda x: F.concat_ws(":", _band(x["n"]).cast("string"), x["enc"])
    end = lambda x: F.lit(STEPS + 1) if known is None else F.coalesce(F.element_at(known, name(x)), F.lit(STEPS + 1))
    span = lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS)).alias("o"), F.lit("random").alias("kind"), x["e"].alias("e"))
    random = F.transform(F.filter("cands", lambda x: _bin(x["l"]) < end(x)), span)
    return scanned.select("__row.*", F.array_sort(F.concat("base", random)).alias("found"))


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span in ``text_col`` replaced by ``mark``; overlapping spans by one mark.

    A null text stays null, an empty one empty; an empty table gives no rows; other columns, whatever their names, stay.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(text_col).alias("__text"))
    found = scan(packed, text_col="__text", **options)
    last = lambda a: F.get(a, F.size(a) - 1)
    one = lambda s, e: F.array(F.struct(s.alias("s"), e.alias("e")))
    joined = lambda a, x: F.concat(F.slice(a, 1, F.size(a) - 1), one(last(a)["s"], F.greatest(last(a)["e"], x["e"])))
    merged = F.aggregate(
        "found", F.array().cast("array<struct<s:bigint,e:bigint>>"),
        lambda a, x: F.when((F.size(a) > 0) & (last(a)["e"] > x["s"]), joined(a, x)).otherwise(F.concat(a, one(x["s"], x["e"]))),
    )
    t = F.col("__text")
    before = lambda m, x, i: _cut(t, F.when(i > 0, F.get(m, F.greatest(i - 1, F.lit(0)))["e"]).otherwise(0), x["s"])
    rest = lambda m: _cut(t, F.coalesce(last(m)["e"], F.lit(0)), F.length(t))
    clean = common.let(merged, lambda m: F.concat(F.array_join(F.transform(m, lambda x, i: F.concat(before(m, x, i), F.lit(mark))), ""), rest(m)))
    out = F.when(F.size("found") > 0, clean).otherwise(t)
    return found.select(*[out.alias(c) if c == text_col else F.col(f"__doc.`{c}`") for c in docs.columns])


def _cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in all documents. A span is the whole match; ``assign`` includes its keyword."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined(F.filter("found", lambda x: x["kind"] != "random")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        count("random").alias("n_random"),
    )
