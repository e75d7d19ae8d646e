"""Quality rules at the level of hosts.

Every document is measured against a set of rules in one pass over its text. Failures are counted per host and
rule, with partial sums before the shuffle. A host's failure rate is shrunk towards the rate of all hosts by a beta
prior whose strength is fitted to the spread between hosts (method of moments for the beta-binomial), so a host of
three documents is not condemned by two of them. What decides is the posterior: a host is rejected where, for some rule, its
rate is beyond the limit with a probability of ``SURE``. The limit is ``ODDS`` times the odds of the rate of all hosts, or ``LEAST``
if that is more, so it follows the corpus. A host's verdict is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depchron.llm import common
from depchron.sources.work import table, written

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rules that count against a host; the first two also fail the document itself.
RULES = ("few_words", "repeats", "symbols", "dup_lines", "word_length")
#: A host fails a rule where its rate is over ODDS times the odds of all hosts, and over LEAST, with a probability of SURE.
ODDS, LEAST, SURE = 4.0, 0.1, 0.95
#: The posterior is summed in steps of so many standard deviations of its logit, so many to each side.
STEP, STEPS = 0.1, 120
#: Salts of the join that brings verdicts back: a host that holds a third of all rows is dealt out over so many keys.
SALTS = 16
#: Hosts up to which verdicts are broadcast; beyond, they are joined by (host, salt).
BROADCAST_HOSTS = 50_000


def _repeat_words(w: Column) -> Column:
    """Words inside windows of eight that occur twice or more in the array ``w``.

    Hashes show cheaply that most texts have no such window; where two are equal, the windows themselves are compared.
    """
    places = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
    hashes = common.let(F.transform(w, lambda x: F.xxhash64(x)), lambda v: F.transform(places, lambda i: F.xxhash64(F.slice(v, i, F.lit(WINDOW)))))
    window = lambda x: F.array_join(F.slice(w, x["p"], F.lit(WINDOW)), " ")
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (window(x) == window(y)), F.lit(False))
    twice = lambda s: F.sort_array(
        F.filter(F.transform(s, lambda x, k: F.when(same(F.get(s, k - 1), x) | same(F.get(s, k + 1), x), x["p"])), lambda p: p.isNotNull())
    )
    covered = lambda d: F.aggregate(
        F.transform(d, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(d, k + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"),
        lambda a, x: a + x
    )
    settled = lambda h: common.let(common.let(F.sort_array(F.transform(h, lambda x, k: F.struct(x.alias("h"), (k + 1).alias("p")))), twice), covered)
    found = common.let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), settled(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(w) > WINDOW, found).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the five measures and ``n_lines`` (lines with a word); a null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^{common.SPACE}]"))
    by_words = common.let(common.words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    by_lines = common.let(
        lines,
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    )
    return docs.withColumns({
        "__w": by_words,
        "__l": by_lines,
        "word_chars": F.length(F.regexp_replace(text, rf"[{common.SPACE}]++", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]++", "")).cast("long"),
    })


def failures() -> dict[str, Column]:
    """Each rule as a condition on the measures: true where a document fails it."""
    n = F.col("n_words")
    return {
        "few_words": n < 20,
        "repeats": 100 * F.col("n_repeat_words") > 30 * n,
        "symbols": 10 * F.col("n_symbols") > 3 * n,
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
    }


def tail(a: Column, b: Column, limit: Column) -> Column:
    """P(rate > limit) where the rate has the beta distribution (a, b): a sum over its logit, where the density is smooth."""
    mean = a / (a + b)
    middle, width = F.log(mean / (1 - mean)), 1 / F.sqrt((a + b) * mean * (1 - mean))
    density = lambda t: a * t - (a + b) * F.log1p(F.exp(t))
    at = F.transform(F.sequence(F.lit(-STEPS), F.lit(STEPS)), lambda k: middle + k * STEP * width)
    points = F.transform(at, lambda t: F.struct(t.alias("t"), F.exp(density(t) - density(middle)).alias("p")))
    total = lambda v, of: F.aggregate(v, F.lit(0.0), lambda s, x: s + of(x))
    # each point stands for a cell of a step around it; of the cell that holds the limit, the part beyond it counts
    share = lambda t: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (t - F.log(limit / (1 - limit))) / (STEP * width) + 0.5))
    beyond = lambda x: x["p"] * share(x["t"])
    return common.let(points, lambda v: total(v, beyond) / total(v, lambda x: x["p"]))


def host_verdicts(marked: DataFrame, odds: float = ODDS, least: float = LEAST, sure: float = SURE) -> DataFrame:
    """(host, host_none, worst_rate, risk, host_failed) for each host: its largest shrunk failure rate, and the probability
    that its rate for some rule is beyond the limit (the largest over the rules).

    The prior needs four sums over hosts for each rule: one row, which is all that the driver sees.
    """
    hosts = marked.groupBy("__host", "__none").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"__f_{r}").cast("long")).alias(r) for r in RULES])
    sums = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("docs"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"),
        *[F.sum(r).alias(r) for r in RULES], *[F.sum(F.col(r).cast("double") * F.col(r) / F.col("n")).alias(f"{r}_2") for r in RULES],
    ).first()
    rates, risks = [], []
    for r in RULES:
        mean = (sums[r] or 0) / max(1, sums["docs"] or 0)
        spread = (sums[f"{r}_2"] or 0.0) - mean * (sums[r] or 0) - (sums["hosts"] - 1) * mean * (1 - mean)
        room = (sums["docs"] or 0) - (sums["squares"] or 0) / max(1, sums["docs"] or 0)
        between = spread / room if room > 0 else 0.0
        strength = min(1e9, max(1.0, mean * (1 - mean) / between - 1)) if between > 0 else 1e9 if sums["hosts"] > 1 else 1.0
        a, b = F.col(r) + mean * strength, F.col("n") - F.col(r) + (1 - mean) * strength
        rates.append(a / (a + b))
        if 0 < mean < 1:
            limit = max(least, odds * mean / (1 - mean + odds * mean))
            risks.append(F.when(F.col(r) > 0, tail(a, b, F.lit(limit))).otherwise(0.0))
    worst, risk = F.greatest(*rates), F.greatest(F.lit(0.0), F.lit(0.0), *risks)
    return hosts.select("__host", "__none", worst.alias("worst_rate"), risk.alias("risk")).withColumn("host_failed", F.col("risk") > sure)


def _judged(docs: DataFrame, columns: list[str], text_col: str, host_col: str, thin: bool, **limits) -> DataFrame:
    """The struct ``row`` of the ``columns`` of ``docs``, beside the measures and verdicts, so that no two names can meet."""
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    host = F.col(f"`{host_col}`")
    packed = docs.select(row, F.coalesce(host.cast("string"), F.lit("")).alias("__host"), host.isNull().alias("__none"), F.col(f"`{text_col}`").alias("text"))
    marked = measured(packed).select(
        "row", "__host", "__none", "__w.*", "__l.*", "word_chars", "n_symbols", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("__salt")
    )
    failed = F.col("__f_few_words") | F.col("__f_repeats")
    marked = marked.withColumns({f"__f_{k}": v for k, v in failures().items()})
    marked = written(marked.withColumn("row", F.when(~failed, F.col("row"))) if thin else marked, "quality")
    hosts = written(host_verdicts(marked, **limits), "hosts")
    if hosts.count() <= BROADCAST_HOSTS:
        joined = marked.join(F.broadcast(hosts), ["__host", "__none"], "left")
    else:
        salted = hosts.withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        joined = marked.join(salted, ["__host", "__none", "__salt"], "left")
    return joined.select(
        "row", *MEASURES, "n_lines", failed.alias("base_failed"), "worst_rate", "risk", (~failed & ~F.col("host_failed")).alias("kept")
    )


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", drop_text: bool = False, **limits) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``worst_rate`` and ``risk`` (the host's) and ``kept``.

    A null or empty text has no words and fails; a null host is a host of its own; repeated rows each count; whole texts are measured, of any
    length. Columns of ``docs`` with the names of added ones are replaced, and no other name clashes. An empty table gives no rows.
    """
    added = {*MEASURES, "n_lines", "base_failed", "worst_rate", "risk", "kept"}
    columns = [c for c in docs.columns if c.lower() not in added and not (drop_text and c == text_col)]
    return _judged(docs, columns, text_col, host_col, False, **limits).select("row.*", *MEASURES, "n_lines", "base_failed", "worst_rate", "risk", "kept")


def keep(docs: DataFrame, text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The documents that pass, with all their own columns as they are, whatever their names.

    A null or empty text fails; a null host is a host of its own; of repeated rows all pass or none; whole texts are measured, of any length.
    Texts that fail by themselves aren't carried on. An empty table gives no rows.
    """
    return _judged(docs, docs.columns, text_col, host_col, True, **limits).filter("kept").select("row.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return judge(docs, drop_text=True).select("doc_id", *MEASURES, "base_failed", "kept", "source", "n_lines")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT id, unnest(range(1, len(w) - 6)) AS p,
  unnest(list_transform(range(1, len(w) - 6), lambda i: md5(array_to_string(w[i:i + 7], ' ')))) AS g FROM w WHERE len(w) >= 8),
k AS (SELECT id, p, count(*) OVER (PARTITION BY id, g) AS n FROM g),
r AS (SELECT id, count(DISTINCT q) AS n_repeat_words FROM (SELECT id, unnest(range(p, p + 8)) AS q FROM k WHERE n > 1) GROUP BY id),
m AS (SELECT w.id, doc_id, source, len(w)::BIGINT AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             len(l)::BIGINT AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r ON w.id = r.id),
f AS (SELECT *, n_words < 20 AS f1, 100 * n_repeat_words > 30 * n_words AS f2, 10 * n_symbols > 3 * n_words AS f3,
             10 * n_dup_lines > 3 * n_lines AS f4, word_chars < 2 * n_words OR word_chars > 15 * n_words AS f5 FROM m),
h AS (SELECT source, n, unnest([1, 2, 3, 4, 5]) AS rule, unnest([a, b, c, d, e]) AS x FROM (
        SELECT source, count(*) AS n, count_if(f1) AS a, count_if(f2) AS b, count_if(f3) AS c, count_if(f4) AS d, count_if(f5) AS e FROM f GROUP BY source)),
s AS (SELECT rule, count(*) AS hosts, sum(n)::DOUBLE AS docs, sum(n::DOUBLE * n) AS squares, sum(x)::DOUBLE AS x,
  sum(x::DOUBLE * x / n) AS x2 FROM h GROUP BY rule),
b AS (SELECT *, x / docs AS mean, (x2 - x * x / docs - (hosts - 1) * (x / docs) * (1 - x / docs)) / nullif(docs - squares / docs, 0) AS between_hosts FROM s),
p AS (SELECT rule, mean, CASE WHEN between_hosts > 0 THEN least(1e9, greatest(1.0, mean * (1 - mean) / between_hosts - 1))
                              WHEN hosts > 1 THEN 1e9 ELSE 1.0 END AS strength FROM b),
y AS (SELECT source, x, x + mean * strength AS a, n - x + (1 - mean) * strength AS b, mean,
  greatest(0.1, 4.0 * mean / (1 - mean + 4.0 * mean)) AS top FROM h JOIN p ON h.rule = p.rule),
o AS (SELECT *, ln(a / b) AS middle, 1 / sqrt(a / (a + b) * b) AS width, ln(top / (1 - top)) AS cut FROM y WHERE x > 0 AND mean < 1),
q AS (SELECT *, list_transform(range(-120, 121), lambda k: middle + k * 0.1 * width) AS points FROM o),
z AS (SELECT source, list_sum(list_transform(points, lambda t: least(1, greatest(0, (t - cut) / (0.1 * width) + 0.5))
                     * exp(a * t - (a + b) * ln(1 + exp(t)) - a * middle + (a + b) * ln(1 + exp(middle)))))
                     / list_sum(list_transform(points, lambda t: exp(a * t - (a + b) * ln(1 + exp(t)) - a * middle + (a + b) * ln(1 + exp(middle))))) AS risk FROM q),
v AS (SELECT h.source, coalesce(max(risk), 0) > 0.95 AS host_failed FROM (SELECT DISTINCT source FROM h) h
  LEFT JOIN z ON h.source IS NOT DISTINCT FROM z.source GROUP BY h.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
       NOT (f1 OR f2) AND NOT host_failed AS kept, f.source, n_lines
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
