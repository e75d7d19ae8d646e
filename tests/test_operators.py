"""Small scenarios, properties and plans of the library's operators."""

from __future__ import annotations

import inspect
import json
import random
import re
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from depchron.functions import names
from depchron.functions.versions import update_type, version_key
from depchron.operators import advisories as adv
from depchron.operators import changes as ch
from depchron.operators import history, ingest, kept, manifests, policy, reach, sbom, sinks, state, stats, vulns
from depchron.plans import QUERIES
from depchron.sources.binding import Views
from depchron.sources.work import written
from depchron.streaming import changes as stream

OBS = "branch_id long, commit_id long, pos long, path string, ecosystem string, kind string, name string, version string, scope string, integrity string"


def observations(spark, *seen):
    """(pos, path, name, version[, scope[, integrity]]) on branch 1."""
    full = [(1, p, p, path, "gem", "lockfile", name, v, *(more or [None if v is None else "runtime"]), *([] if len(more) > 1 else [None])) for p, path, name, v, *more in seen]
    return spark.createDataFrame(full, OBS)


@pytest.fixture(scope="module")
def v(spark, tiny):
    return Views(spark, tiny)


class TestChanges:
    def test_two_commits(self, spark):
        o = observations(spark, (1, "G", "rails", "7.0"), (1, "G", "puma", "6.0"), (2, "G", "rails", "7.1"), (2, "G", "puma", "6.0"), (2, "G", "sidekiq", "7.0"))
        assert rows(ch.changes(o), "pos", "name", "change_type", "requirement", "previous_version") == [
            (1, "puma", "added", "6.0", None), (1, "rails", "added", "7.0", None), (2, "rails", "modified", "7.1", "7.0"), (2, "sidekiq", "added", "7.0", None)
        ]

    def test_removal_keeps_the_old_version(self, spark):
        o = observations(spark, (1, "G", "a", "1"), (2, "G", "a", None), (3, "G", "a", None), (4, "G", "a", "2"))
        assert rows(ch.changes(o), "pos", "change_type", "requirement", "previous_version") == [(1, "added", "1", None), (2, "removed", "1", None), (4, "added", "2", None)]

    def test_scope_counts_and_integrity_only_on_request(self, spark):
        o = observations(spark, (1, "G", "a", "1", "runtime", "x"), (2, "G", "a", "1", "runtime", "y"), (3, "G", "a", "1", "development", "y"))
        assert [r[0] for r in rows(ch.changes(o), "pos")] == [1, 3]
        assert [r[0] for r in rows(ch.changes(o, track_integrity=True), "pos")] == [1, 2, 3]

    def test_last_duplicate_wins(self, spark):
        o = observations(spark, (1, "G", "a", "1"), (1, "G", "a", "2")).withColumn("line", F.col("version").cast("int"))
        assert rows(ch.deduplicated(o, ["line"]), "version") == [("2",)]

    def test_merges_are_left_out(self, spark):
        df = spark.createDataFrame([(1, ["x"]), (2, ["x", "y"]), (3, [])], "id int, parents array<string>")
        assert rows(ch.without_merges(df), "id") == [(1,), (3,)]

    def test_swap_in_whole_manifests(self, spark):
        listing = lambda *n: spark.createDataFrame([(1, 5, "G", x, "1", "runtime") for x in n], "branch_id long, pos long, path string, name string, version string, scope string")
        assert rows(ch.manifest_changes(listing("a", "b"), listing("b", "c")), "name", "change_type") == [("a", "removed"), ("c", "added")]

    def test_deleted_manifest(self, spark):
        i = ch.state_intervals(ch.changes(observations(spark, (1, "G", "a", "1"), (1, "H", "b", "1"), (3, "G", "c", "1"))))
        gone = spark.createDataFrame([(1, 3, "G")], "branch_id long, pos long, path string")
        assert rows(ch.manifest_removed(i, gone), "name", "requirement") == [("a", "1")]

    def test_one_shuffle_serves_changes_and_intervals(self, spark):
        o = observations(spark, (1, "G", "a", "1"))
        plan = ch.state_intervals(ch.changes(o))._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1

    def test_hot_branch_is_numbered_in_parts(self, spark):
        df = spark.range(100).select(F.lit(1).alias("b"), (F.col("id") % 7).alias("day"), F.col("id"))
        from depchron.functions.order import numbered

        got = rows(numbered(df, ["b"], "day", ["id"], "n"), "day", "id", "n")
        assert [r[2] for r in sorted(got)] == list(range(1, 101))

    def test_empty(self, spark):
        assert rows(ch.state_intervals(ch.changes(observations(spark).limit(0)))) == []

    def test_observations_are_dealt_by_commit_alone(self, v):
        plan = v.changes._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(r"Exchange hashpartitioning\((l_orderkey#\d+L, \w+)", plan)
        assert dealt and all(re.fullmatch(r"l_orderkey#\d+L, \d+", x) for x in dealt)


class TestState:
    def test_bounds(self, spark):
        i = ch.state_intervals(ch.changes(observations(spark, (1, "G", "a", "1"), (3, "G", "a", "2"), (5, "G", "a", None))))
        refs = spark.createDataFrame([(str(p), 1, p) for p in range(7)], "ref string, branch_id long, pos long")
        for bucket in (1, 2, 1024):
            assert rows(state.state_at(i, refs, bucket), "ref", "version") == [("1", "1"), ("2", "1"), ("3", "2"), ("4", "2")]
        assert rows(state.latest_state(i)) == []

    @pytest.mark.parametrize("bucket", [1, 3, 50])
    def test_open_intervals_against_all_pairs(self, spark, bucket):
        import random

        r = random.Random(bucket)
        full = [(r.randrange(3), f"n{i}", a, r.choice([None, a + r.randrange(1, 60)])) for i in range(150) for a in [r.randrange(100)]]
        points = [(r.randrange(4), r.randrange(-5, 160), f"p{i}") for i in range(40)]
        i = spark.createDataFrame(full, "k long, name string, pos_from long, pos_to long")
        p = spark.createDataFrame([*points, points[0]], "k long, at long, ref string")
        want = [(ref, n) for k, at, ref in [*points, points[0]] for j, n, a, b in full if j == k and a <= at and (b is None or b > at)]
        assert rows(state.open_intervals(i, p, ["k"], bucket), "ref", "name") == sorted(want, key=repr)
        assert rows(state.open_intervals(i, p.limit(0), ["k"], bucket)) == rows(state.open_intervals(i.limit(0), p, ["k"], bucket)) == []

    def test_no_step_is_linear_in_buckets(self, v):
        plan = state.state_at(v.intervals, v.refs)._jdf.queryExecution().executedPlan().toString()
        assert "collect_set" not in plan and "NestedLoop" not in plan

    def test_snapshots(self, spark):
        o = observations(spark, *[(p, "G", f"n{p}", "1") for p in range(1, 6)])
        c = ch.changes(o)
        s = state.snapshot_materialize(ch.state_intervals(c), c, every=2)
        assert {r[0]: r[1] for r in rows(s.groupBy("at").count())} == {2: 2, 4: 4, 5: 5}
        refs = spark.createDataFrame([("a", 1, 1), ("b", 1, 3)], "ref string, branch_id long, pos long")
        assert rows(state.snapshot_asof(s, refs).groupBy("ref", "at").count()) == [("b", 2, 2)]

    @pytest.mark.parametrize("part", [1, 3, 100])
    def test_nearest_snapshot_across_stretches(self, spark, monkeypatch, part):
        monkeypatch.setattr(state, "PART", part)
        have = {0: [4, 5, 17], 1: [9]}
        s = spark.createDataFrame([(b, p, f"n{p}") for b, own in have.items() for p in own], "branch_id long, at long, name string")
        asked = [(f"r{p}", b, p) for b in (0, 1, 2) for p in range(0, 25, 2)]
        refs = spark.createDataFrame(asked, "ref string, branch_id long, pos long")
        want = [(r, b, max(own), f"n{max(own)}") for r, b, p in asked for own in [[x for x in have.get(b, []) if x <= p]] if own]
        for stored in (None, s.select("branch_id", F.col("at").alias("pos"))):
            assert rows(state.snapshot_asof(s, refs, stored), "ref", "branch_id", "at", "name") == sorted(want, key=repr)

    def test_difference_leads_to_the_later_state(self, v):
        d = state.diff_refs(v.intervals, v.refs, "v100", "v200")
        at = state.state_at(v.intervals, v.refs).select("ref", "branch_id", "path", "name", "version")
        before, after = ({(b, p, n): x for r, b, p, n, x in rows(at) if r == ref} for ref in ("v100", "v200"))
        for b, p, n, kind, new in rows(d, "branch_id", "path", "name", "change", "to_version"):
            before.pop((b, p, n), None)
            if kind != "removed":
                before[b, p, n] = new
        assert before == after

    def test_signs_of_changes_add_up(self, v):
        sign = F.when(F.col("change_type") == "added", 1).when(F.col("change_type") == "removed", -1).otherwise(0)
        assert v.changes.agg(F.sum(sign)).first()[0] == v.latest.count()

    def test_expected_counts(self, v):
        assert rows(v.changes.groupBy("change_type").count()) == [("added", 3997), ("modified", 1028), ("removed", 209)]
        assert [r[1] for r in rows(v.latest.groupBy("branch_id").count())] == [755, 839, 713, 679, 802]

    def test_no_nested_loops(self, v):
        for df in (vulns.scan(v.latest, v.advisories), state.state_at(v.intervals, v.refs), history.blame(v.latest, v.changes, v.commits)):
            assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


class TestVersions:
    ORDER = ["0.9", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "v1.0.0", "1.0.1", "1.2", "1.10", "2.0.0+build"]

    def test_order(self, spark):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(self.ORDER)], "i int, v string")
        assert [r[0] for r in df.orderBy(version_key(F.col("v"))).collect()] == list(range(len(self.ORDER)))

    @pytest.mark.parametrize("order", [
        ["1.0.dev1", "1.0"], ["1.0a1", "1.0a2", "1.0b1", "1.0rc1", "1.0rc10", "1.0", "1.0.post1", "1.0.1"], ["7.1.0.beta1", "7.1.0.rc1", "7.1.0.rc2", "7.1.0", "7.1.0.1"],
        ["1.0-SNAPSHOT", "1.0.Final", "1.1.Final"], ["1.2.3.4.5.6.7.8.1", "1.2.3.4.5.6.7.8.2", "1.2.3.4.5.6.7.8.10"], ["0", "0.0.1"],
    ])
    def test_order_of_other_forms(self, spark, order):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(order)], "i int, v string")
        assert [r[0] for r in df.orderBy(version_key(F.col("v")), F.desc("i")).collect()] == list(range(len(order)))

    @pytest.mark.parametrize("a,b", [("1.0.Final", "1"), ("0.0", "0"), ("1.2.3.4.5.6.7.8.0", "1.2.3.4.5.6.7.8"), ("1.2", "1.2.0"), ("v1", "1.0.0"), ("1.0+x", "1.0+y")])
    def test_equal(self, spark, a, b):
        assert spark.createDataFrame([(a, b)], "a string, b string").select(version_key(F.col("a")) == version_key(F.col("b"))).first()[0]

    @pytest.mark.parametrize("x", ["", "latest", "1..2", None, "99999999999999999999", "~> 7.0"])
    def test_no_version(self, spark, x):
        assert spark.createDataFrame([(x,)], "v string").select(version_key(F.col("v")).isNull()).first()[0]

    @pytest.mark.parametrize("a,b,kind", [("1.0.0", "2.0.0", "major"), ("1.0.0", "1.1.0", "minor"), ("1.0.0", "1.0.1", "patch"), ("1.0.0-rc.1", "1.0.0", "patch"), ("2.0.0", "1.9.9", None), ("x", "1", None)])
    def test_update(self, spark, a, b, kind):
        assert spark.createDataFrame([(a, b)], "a string, b string").select(update_type(F.col("a"), F.col("b"))).first()[0] == kind


    @pytest.mark.parametrize("ecosystem,order", [
        ("pypi", ["1.0.dev1", "1.0a1.dev2", "1.0a1", "1.0a1.post1", "1.0a2", "1.0b1", "1.0rc1", "1.0RC2", "1.0", "1.0+abc", "1.0+5", "1.0.post1.dev2", "1.0.post1", "1.0-2", "1.0.1", "2!0.1", "10!0"]),
        ("maven", ["1.0-alpha-1", "1.0-alpha2", "1.0-beta-2", "1.0-beta10", "1.0-milestone-1", "1.0-m2", "1.0-rc1", "1.0-SNAPSHOT", "1.0", "1.0-sp1", "1.0-foo", "1.0-1", "1.0.1", "1.1"]),
        ("RubyGems", ["1.0.a", "1.0.a.2", "1.0.b1", "1.0.b10", "1.0.pre", "1.0-1", "1.0.rc1", "1.0", "1.0.0.1", "1.0.1", "1.9", "1.10"]),
        ("composer", ["1.0-dev", "1.0-alpha", "1.0.0-alpha2", "1.0beta1", "1.0-RC1", "1.0-RC10", "1.0", "1.0-patch1", "1.0-p2", "1.0.1"]),
        ("npm", ["1.0.0-1", "1.0.0-2", "1.0.0-10", "1.0.0-a", "1.0.0-beta10", "1.0.0-beta2", "1.0.0"]), ("nuget", ["1.0.0-ALPHA", "1.0.0-beta", "1.0.0-RC.1", "1.0.0", "1.0.0.1"]),
    ])
    def test_order_of_ecosystems(self, spark, ecosystem, order):
        df = spark.createDataFrame([(i, x, ecosystem) for i, x in enumerate(order)], "i int, v string, e string")
        assert [r[0] for r in df.orderBy(version_key(F.col("v"), F.col("e")), F.desc("i")).collect()] == list(range(len(order)))

    @pytest.mark.parametrize("ecosystem,a,b", [
        ("pypi", "1.0-ALPHA.1", "1a1"), ("pypi", "v1.0.0", "1"), ("pypi", "1.0-1", "1.0.post1"), ("pypi", "1.0c1", "1.0rc1"), ("pypi", "0!1.0", "1.0"), ("maven", "1.0-final", "1"), ("maven", "1.0.0-ga", "1.0"),
        ("maven", "1.0-cr2", "1.0-rc2"), ("maven", "1.0-a1", "1.0-alpha-1"), ("gem", "1.0.a.0", "1.0.0.a"), ("gem", "1.0-x", "1.0.pre.x"), ("packagist", "1.0-stable", "v1.0.0"), ("NuGet", "1.0.0-RC", "1.0-rc"),
    ])
    def test_equal_in_ecosystems(self, spark, ecosystem, a, b):
        e = F.lit(ecosystem)
        assert spark.createDataFrame([(a, b)], "a string, b string").select(version_key(F.col("a"), e) == version_key(F.col("b"), e)).first()[0]

    @pytest.mark.parametrize("ecosystem,x", [("pypi", "1.0-sp1"), ("pypi", "2020.1-final"), ("maven", "LATEST"), ("gem", "1..2"), ("composer", "dev-main"), ("pypi", None), ("maven", "")])
    def test_no_version_of_the_ecosystem(self, spark, ecosystem, x):
        assert spark.createDataFrame([(x,)], "v string").select(version_key(F.col("v"), F.lit(ecosystem)).isNull()).first()[0]

    def test_ranks(self, spark):
        df = spark.createDataFrame([("pypi", "a", v) for v in ("1.0", "1.0.0", "1.0rc1", "2.0.dev1", "odd", None, "1.0")] + [("maven", "a", "1.0-sp1")], "ecosystem string, name string, version string")
        got = rows(policy.version_ranks(df), "ecosystem", "version", "rank")
        assert got == [("maven", "1.0-sp1", 1), ("pypi", "1.0", 2), ("pypi", "1.0.0", 2), ("pypi", "1.0rc1", 1), ("pypi", "2.0.dev1", 3)]


class TestCheckpoints:
    def test_numbered_in_parts(self, spark, monkeypatch):
        monkeypatch.setattr(state, "PART", 4)
        events = spark.range(40).select((F.col("id") % 2).alias("branch_id"), F.col("id").alias("pos")).filter("pos not in (6, 7, 8)")
        events = events.unionAll(events)
        want = [(b, x) for b in (0, 1) for own in [[p for p in range(b, 40, 2) if p not in (6, 7, 8)]] for k, x in enumerate(own, 1) if k % 5 == 0 or k == len(own)]
        assert rows(state.checkpoints(events, 5), "branch_id", "pos") == sorted(want, key=repr)


class TestAdvisories:
    @pytest.mark.parametrize("version,lo,hi,inclusive,want", [
        ("1.0.0", "1.0.0", "2.0.0", False, True), ("2.0.0", "1.0.0", "2.0.0", False, False), ("2.0.0", "1.0.0", "2.0.0", True, True), ("0.1", "0", "1.0.0", False, True),
        ("9", "1.0.0", None, False, True), ("odd", None, None, False, True), ("odd", "1.0.0", None, False, False), (None, "0", None, False, False),
    ])
    def test_ranges(self, spark, version, lo, hi, inclusive, want):
        df = spark.createDataFrame([(version, lo, hi, inclusive)], "v string, lo string, hi string, i boolean")
        assert df.select(adv.in_range(F.col("v"), F.col("lo"), F.col("hi"), F.col("i"))).first()[0] is want

    def test_sweep_of_a_hot_package(self, spark):
        """500 versions and 120 intervals of one package: the rows of a plain comparison."""
        versions = spark.range(500).select(F.lit("PyPI").alias("ecosystem"), F.lit("Hot").alias("name"), F.concat(F.floor(F.col("id") / 9).cast("string"), F.lit("."), (F.col("id") % 9).cast("string"), F.when(F.col("id") % 7 == 0, "rc1").otherwise("")).alias("version"))
        versions = versions.unionAll(spark.createDataFrame([("pypi", "hot", "odd"), ("pypi", "hot", None), ("pypi", "cold", "1.0")], "ecosystem string, name string, version string"))
        k = F.col("id")
        low = F.when(k % 9 == 0, "0").when(k % 11 == 0, F.lit(None)).otherwise(F.concat((k % 60).cast("string"), F.lit(".3rc1")))
        high = F.when(k % 10 == 0, F.lit(None)).when(k % 13 == 0, "x").otherwise(F.concat((k % 60 + k % 3).cast("string"), F.lit(".7")))
        entries = spark.range(120).select(
            F.concat(F.lit("V"), F.floor(k / 2).cast("string")).alias("id"), F.lit("PyPI").alias("ecosystem"), F.lit("hot").alias("name"), low.alias("lo"), high.alias("hi"), (k % 2 == 0).alias("hi_inclusive"),
            F.when(k % 50 == 0, F.array(F.lit("odd"), F.lit("1.0"))).alias("versions"), F.lit("high").alias("severity"), F.lit(7.5).alias("cvss_score"))
        got = rows(adv.affected(versions, entries), "ecosystem", "name", "version", "id")
        e = entries.select("id", "lo", "hi", "hi_inclusive", F.col("versions").alias("listed"))
        plain = versions.filter("lower(name) = 'hot'").crossJoin(e).filter(adv.in_range(F.col("version"), F.col("lo"), F.col("hi"), F.col("hi_inclusive"), F.col("listed"), F.lit("pypi")))
        assert got == rows(plain.select("ecosystem", "name", "version", "id").distinct()) and len(got) > 3000

    def test_sweep_makes_no_pairs(self, spark):
        """100,000 versions and 1,000 short intervals: the join of runs and versions has as many rows as come out."""
        versions = spark.range(100_000).select(F.lit("npm").alias("__e"), F.lit("hot").alias("__n"), F.concat(F.lit("1."), F.col("id").cast("string")).alias("version"))
        k = F.col("id") * 100
        entries = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit("npm").alias("__e"), F.lit("hot").alias("__n"), F.concat(F.lit("1."), k.cast("string")).alias("lo"), F.concat(F.lit("1."), (k + 3).cast("string")).alias("hi"), F.lit(False).alias("hi_inclusive"))
        found = adv.swept(versions, entries)
        assert found.count() == 3000 and found.agg(F.countDistinct("version")).first()[0] == 3000

    def test_record(self, spark):
        record = """{"id": "X", "severity": [{"type": "CVSS_V3", "score": "CVSS:3.1/AV:N"}], "database_specific": {"severity": "MODERATE"}, "affected": [
          {"package": {"ecosystem": "npm", "name": "a"}, "ranges": [{"type": "GIT", "events": [{"introduced": "0"}]}, {"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "1.2"}, {"introduced": "2.0"}, {"last_affected": "2.3"}, {"introduced": "4.0"}]}]},
          {"package": {"ecosystem": "npm", "name": "b"}}]}"""
        osv = adv.parsed(spark.createDataFrame([(record,), ("{broken",), (None,)], "record string"))
        assert rows(adv.advisory_table(osv), "id", "severity", "cvss_score") == [("X", "moderate", None)]
        assert rows(adv.advisory_packages(osv), "name", "lo", "hi", "hi_inclusive") == [("a", "0", "1.2", False), ("a", "2.0", "2.3", True), ("a", "4.0", None, False), ("b", None, None, False)]

    def test_listed_versions(self, spark):
        record = """{"id": "X", "affected": [
          {"package": {"ecosystem": "npm", "name": "a"}, "versions": ["9.0", "odd"], "ranges": [{"type": "SEMVER", "events": [{"introduced": "1.0"}, {"fixed": "2.0"}]}]},
          {"package": {"ecosystem": "npm", "name": "b"}, "versions": ["3.0"]}, {"package": {"ecosystem": "npm", "name": "c"}, "versions": []}]}"""
        osv = adv.parsed(spark.createDataFrame([(record,)], "record string"))
        advisories = adv.advisory_packages(osv).join(adv.advisory_table(osv).select("id", "severity", "cvss_score"), "id")
        used = spark.createDataFrame([("npm", n, v) for n in "abc" for v in ("1.5", "3.0", "9.0", "odd", None)], "ecosystem string, name string, version string")
        want = [("a", "1.5"), ("a", "9.0"), ("a", "odd"), ("b", "3.0"), *[("c", v) for v in ("1.5", "3.0", "9.0", "odd", None)]]
        assert rows(adv.affected(used, advisories), "name", "version") == sorted(want, key=repr)

    def test_one_row_per_advisory_however_many_intervals_hold_the_version(self, spark):
        ends = [("X", "npm", "a", "0", "2.0", False), ("X", "NPM", "A", "1.0", None, False), ("Y", "npm", "a", None, None, False), ("Z", "npm", "a", "1.0", "1.5", True)]
        a = spark.createDataFrame([(*e, "low", 1.0) for e in ends], "id string, ecosystem string, name string, lo string, hi string, hi_inclusive boolean, severity string, cvss_score double")
        used = spark.createDataFrame([(i, "npm", "a", x) for i, x in enumerate(["1.5", "3.0", "odd", None])], "i int, ecosystem string, name string, version string")
        assert rows(adv.affected(used, a), "i", "id") == [(0, "X"), (0, "Y"), (0, "Z"), (1, "X"), (1, "Y"), (2, "Y"), (3, "Y")]
        assert rows(adv.affected(used, a.limit(0))) == rows(adv.affected(used.limit(0), a)) == []

    def test_severities(self, spark):
        df = spark.createDataFrame([("critical",), ("Moderate",), ("odd",), (None,)], "s string")
        assert [r[0] for r in df.select(names.severity_rank(F.col("s"))).collect()] == [0, 2, 4, 4]

    def test_islands(self, spark):
        hit = [(1, "X", "a", "low", 1, 3), (1, "X", "a", "low", 3, 5), (1, "X", "a", "low", 4, 9), (1, "X", "a", "low", 11, None), (1, "X", "a", "low", 2, 4)]
        df = spark.createDataFrame(hit, "branch_id long, id string, name string, severity string, pos_from long, pos_to long")
        assert rows(vulns.islands(df, vulns.PRAISE_KEY), "pos_from", "pos_to") == [(1, 9), (11, None)]

    def test_log_adds_up_to_the_state(self, v):
        found = vulns.hits(v.intervals, v.advisories)
        e = vulns.events(found, vulns.LOG_KEY).filter("pos <= 200").groupBy("branch_id").agg(F.sum(F.when(F.col("event") == "introduced", 1).otherwise(-1)))
        at = vulns.scan(state.state_at(v.intervals, v.refs.filter("ref = 'v200'")), v.advisories).select(*vulns.LOG_KEY).distinct().groupBy("branch_id").count()
        assert rows(e.filter(F.col(e.columns[1]) != 0)) == rows(at)


class TestPolicy:
    def test_reason_is_the_last_one(self, spark):
        s = spark.createDataFrame([(1, "M", "a", "npm", "manifest", "1", "runtime")], "branch_id long, path string, name string, ecosystem string, kind string, version string, scope string")
        p = spark.createDataFrame([("npm", "a", "GPL-3.0")], "ecosystem string, name string, license string")
        reason = lambda **k: rows(policy.licenses(s, p, **k), "reason", "flagged")[0]
        assert reason() == (None, False)
        assert reason(allow=["MIT"]) == ('license "GPL-3.0" not in allow list', True)
        assert reason(allow=["MIT"], deny=["gpl-3.0"])[0].endswith("is denied")
        assert reason(deny=["gpl-3.0"], permissive=True)[0].endswith("is not permissive")
        assert reason(permissive=True, copyleft=True)[0].endswith("is copyleft")

    def test_hashes(self, spark):
        df = spark.createDataFrame([("sha256-a-b",), ("sha1:c:d",), ("e",)], "h string")
        assert [r[0] for r in df.select(policy.hash_value(F.col("h"))).collect()] == ["a-b", "c:d", "e"]

    def test_documents(self, spark):
        parts = spark.createDataFrame([(1, "G", "a", "1.0", "pkg:gem/a", "MIT"), (1, "G", "b", "2.0", None, None)], "branch_id long, path string, name string, version string, purl string, license string")
        xml = sbom.sbom_cyclonedx(parts, "2001-12-31T00:00:00Z", form="xml").first()["document"]
        assert "<name>a</name>" in xml and "<purl>pkg:gem/a</purl>" in xml and 'xmlns="http://cyclonedx.org/schema/bom/1.5"' in xml and 'type="library"' in xml
        assert len(re.findall(r"<licenses>\s*<license>\s*<id>MIT</id>\s*</license>\s*</licenses>", xml)) == 1
        assert '"licenses":[{"license":{"id":"MIT"}}]' in sbom.sbom_cyclonedx(parts, "x").first()["document"]
        assert '"licenseDeclared":"NOASSERTION"' in sbom.sbom_spdx(parts, "p", "x").first()["document"]

    def test_documents_are_bounded(self, spark):
        own = [(b, f"m{i % 3}", f"n{i:02}", str(i), f"pkg:gem/n{i}", "MIT") for b in (1, 2) for i in range(11 if b == 1 else 2)]
        parts = spark.createDataFrame(own, "branch_id long, path string, name string, version string, purl string, license string")
        want = sorted((b, p, n) for b, p, n, *_ in own)
        of = lambda df: [(r["branch_id"], r["piece"], r["document"]) for r in df.orderBy("branch_id", "piece").collect()]
        made = of(sbom.sbom_cyclonedx(parts, "x", size=4))
        assert [(b, p) for b, p, _ in made] == [(1, 0), (1, 1), (1, 2), (2, 0)]
        whole = [json.loads(d) for _, _, d in made]
        assert [(b, c["name"]) for (b, _, _), d in zip(made, whole, strict=True) for c in d["components"]] == [(b, n) for b, _, n in want]
        assert whole[1]["metadata"]["properties"] == [{"name": "depchron:piece", "value": "2 of 3"}] and "properties" not in whole[3]["metadata"]
        xml = of(sbom.sbom_cyclonedx(parts, "x", "xml", size=4))
        assert [d.count("<component ") for _, _, d in xml] == [4, 4, 3, 2] and '<property name="depchron:piece">3 of 3</property>' in xml[2][2]
        spdx = [json.loads(d) for _, _, d in of(sbom.sbom_spdx(parts, "p", "x", size=4))]
        assert [p["SPDXID"] for d in spdx[:3] for p in d["packages"]] == [f"SPDXRef-Package-{i}" for i in range(11)]
        assert all([p["SPDXID"] for p in d["packages"]] == [r["relatedSpdxElement"] for r in d["relationships"]] for d in spdx)

    def test_reports_are_bounded(self, spark):
        own = [(1, f"V{i % 3}", "high", f"n{i:02}", "1", f"m{i % 2}") for i in range(10)] + [(2, "V0", "low", "n", "1", "m")]
        found = spark.createDataFrame(own, "branch_id long, id string, severity string, name string, version string, path string")
        made = [(r["branch_id"], json.loads(r["document"])["runs"][0]) for r in vulns.sarif_report(found, size=4).orderBy("branch_id", "piece").collect()]
        assert [(b, len(run["results"])) for b, run in made] == [(1, 4), (1, 4), (1, 2), (2, 1)]
        for _, run in made:
            assert [r["id"] for r in run["tool"]["driver"]["rules"]] == sorted({r["ruleId"] for r in run["results"]})
        got = [(b, r["ruleId"], r["message"]["text"]) for b, run in made for r in run["results"]]
        assert sorted(got) == sorted((b, i, f"{n}@{v} is vulnerable") for b, i, _, n, v, _ in own)
        assert made[2][1]["properties"] == {"piece": 3, "pieces": 3} and "properties" not in made[3][1]


class TestIngest:
    def test_lines(self, spark):
        text = "source 'x'\ngem \"rails\", \"~> 7.0\"\n  gem 'puma'\n"
        df = spark.createDataFrame([(1, "Gemfile", "h", text), (2, "Gemfile", "h", text), (3, "Gemfile", "n", None)], "commit long, path string, blob string, text string")
        assert rows(ingest.manifest_parse(df, "lines")) == [(c, "Gemfile", *x) for c in (1, 2) for x in (("puma", None), ("rails", "~> 7.0"))]

    def test_npm_and_ruby_files(self, spark):
        npm = """{"name": "app", "version": "1.0.0", "dependencies": {"express": "^4.18.0", "lodash": "^4.17.21"}, "devDependencies": {"jest": "^29.0.0"}}"""
        lock = """{"name": "app", "lockfileVersion": 3, "packages": {"": {"name": "app", "dependencies": {"express": "^4.18.0"}},
          "node_modules/express": {"version": "4.18.2", "integrity": "sha512-abc"}, "node_modules/@a/b": {"version": "1.0.0"}, "node_modules/x/node_modules/jest": {"version": "29.7.0", "dev": true}}}"""
        old = """{"lockfileVersion": 1, "dependencies": {"left-pad": {"version": "1.3.0", "integrity": "sha1-x", "dev": true}}}"""
        gems = "GEM\n  remote: https://rubygems.org/\n  specs:\n    rails (7.0.4)\n      activesupport (= 7.0.4)\n    puma (6.0.0)\n\nDEPENDENCIES\n  rails (~> 7.0)\n"
        files = [("package.json", npm), ("web/package-lock.json", lock), ("old/package-lock.json", old), ("Gemfile.lock", gems), ("Gemfile", 'gem "rails", "~> 7.0"\n'), ("bad/package.json", "{oops"), ("notes.txt", npm), ("none/package.json", None)]
        df = spark.createDataFrame([(1, p, f"h{i}", t) for i, (p, t) in enumerate(files)], "commit long, path string, blob string, text string")
        assert rows(manifests.manifests_parse(df), "path", "kind", "name", "requirement", "scope", "integrity") == sorted([
            ("package.json", "manifest", "express", "^4.18.0", "runtime", None), ("package.json", "manifest", "lodash", "^4.17.21", "runtime", None), ("package.json", "manifest", "jest", "^29.0.0", "development", None),
            ("web/package-lock.json", "lockfile", "express", "4.18.2", "runtime", "sha512-abc"), ("web/package-lock.json", "lockfile", "@a/b", "1.0.0", "runtime", None), ("web/package-lock.json", "lockfile", "jest", "29.7.0", "development", None),
            ("old/package-lock.json", "lockfile", "left-pad", "1.3.0", "development", "sha1-x"), ("Gemfile.lock", "lockfile", "rails", "7.0.4", "runtime", None), ("Gemfile.lock", "lockfile", "puma", "6.0.0", "runtime", None),
            ("Gemfile", "manifest", "rails", "~> 7.0", "runtime", None),
        ], key=repr)
        assert rows(manifests.manifests_parse(df.limit(0))) == []

    def parsed(self, spark, path, text):
        df = spark.createDataFrame([(1, path, text)], "commit long, path string, text string")
        return rows(manifests.manifests_parse(df), "name", "requirement", "scope", "location")

    def test_packages_in_packages(self, spark):
        lock = """{"lockfileVersion": 1, "requires": true, "dependencies": {
          "a": {"version": "1.0.0", "requires": {"b": "^2"}, "dependencies": {"b": {"version": "2.0.0", "dependencies": {"c": {"version": "3.0.0", "dev": true, "dependencies": {}}}}}},
          "b": {"version": "1.5.0", "optional": true}, "old": {"version": "npm:@x/real@4.0.0"}, "odd": 7}}"""
        assert self.parsed(spark, "package-lock.json", lock) == sorted([
            ("a", "1.0.0", "runtime", "node_modules/a"), ("b", "2.0.0", "runtime", "node_modules/a/node_modules/b"), ("b", "1.5.0", "optional", "node_modules/b"),
            ("c", "3.0.0", "development", "node_modules/a/node_modules/b/node_modules/c"), ("@x/real", "4.0.0", "runtime", "node_modules/old"), ("odd", None, "runtime", "node_modules/odd"),
        ], key=repr)

    def test_workspaces_links_aliases(self, spark):
        lock = """{"lockfileVersion": 3, "packages": {"": {"workspaces": ["packages/*"]}, "packages/w": {"name": "@me/w", "version": "0.1.0"},
          "node_modules/@me/w": {"resolved": "packages/w", "link": true}, "packages/w/node_modules/d": {"version": "1.1.0", "dev": true},
          "node_modules/lost": {"resolved": "packages/none", "link": true}, "node_modules/alias": {"name": "real", "version": "5.0.0"}},
          "dependencies": {"alias": {"version": "npm:real@5.0.0"}}}"""
        assert self.parsed(spark, "x/package-lock.json", lock) == sorted([
            ("@me/w", "0.1.0", "runtime", "node_modules/@me/w"), ("d", "1.1.0", "development", "packages/w/node_modules/d"), ("lost", None, "runtime", "node_modules/lost"),
            ("real", "5.0.0", "runtime", "node_modules/alias"),
        ], key=repr)
        text = """{"dependencies": {"a": "npm:@s/b@^1.0", "c": "npm:d", "e": "1 - 2"}, "peerDependencies": {"p": "*"}}"""
        assert [r[:3] for r in self.parsed(spark, "package.json", text)] == [("@s/b", "^1.0", "runtime"), ("d", None, "runtime"), ("e", "1 - 2", "runtime"), ("p", "*", "peer")]

    def test_gemfile_groups_and_requirements(self, spark):
        text = """source "https://rubygems.org"
gem "rails", "~> 7.0", ">= 7.0.4", require: "rails/all" # "x"
gem 'pg', group: :production
group :development, :test do
  gem "rspec", "3.1"
  platforms :ruby do
    gem "byebug"
  end
end
gem("rake", '13.0')
  group :test do
    gem "capybara", :require => false
  end
# gem "none"
gem "rubocop", :group => [:development]
group :production, :test do
  gem "both"
end
"""
        assert [r[:3] for r in self.parsed(spark, "Gemfile", text)] == sorted([
            ("rails", "~> 7.0, >= 7.0.4", "runtime"), ("pg", None, "runtime"), ("rspec", "3.1", "development"), ("byebug", None, "development"), ("rake", "13.0", "runtime"),
            ("capybara", None, "test"), ("rubocop", None, "development"), ("both", None, "runtime"),
        ], key=repr)
        lock = "GEM\n  specs:\n    nokogiri (1.15.4)\n      racc (~> 1.4)\n    nokogiri (1.15.4-x86_64-linux)\n    nokogiri (1.15.4-arm64-darwin)\n    a (1.0.0.rc1)\n"
        assert [r[:2] for r in self.parsed(spark, "Gemfile.lock", lock)] == [("a", "1.0.0.rc1"), ("nokogiri", "1.15.4")]

    def test_no_text_is_shuffled(self, spark):
        df = spark.createDataFrame([(1, "Gemfile", "x")], "commit long, path string, text string")
        assert "Exchange" not in manifests.manifests_parse(df)._jdf.queryExecution().executedPlan().toString()

    def test_broken_json(self, spark):
        df = spark.createDataFrame([(1, "p", "h", "{oops"), (1, "p", "i", '{"a": "1"}')], "commit long, path string, blob string, text string")
        assert rows(ingest.manifest_parse(df)) == [(1, "p", "a", "1")]
        bad = df.withColumn("path", F.concat("blob", F.lit("/package-lock.json")))
        assert rows(manifests.deps_from_tree(bad, 1)) == [] == rows(manifests.deps_from_tree(bad.withColumn("path", F.lit("package.json")), 2))

    def test_where(self, spark):
        df = spark.createDataFrame([("a/Gemfile", "gem", "x\nRails\ny"), ("a/vendor/Gemfile", "gem", "rails"), ("b", "gem", None)], "path string, ecosystem string, text string")
        assert rows(ingest.where(df, "rails", 1), "path", "line_number", "line", "context") == [("a/Gemfile", 2, "Rails", "x\nRails\ny")]
        assert rows(ingest.where(df, "rails"), "context") == [("Rails",)]


class TestSinks:
    def test_upsert(self, spark):
        base, new = (spark.createDataFrame(x, "k string, t int, v string") for x in ([("a", 1, "old"), ("b", 5, "old")], [("a", 2, "new"), ("b", 4, "new"), ("c", None, "new")]))
        assert rows(sinks.upsert_latest(base, new, ["k"], "t"), "k", "v") == [("a", "new"), ("b", "old"), ("c", "new")]

    def test_insert_ignore_takes_the_least_of_several(self, spark):
        base, new = (spark.createDataFrame(x, "k string, v string") for x in ([("a", "old")], [("b", "y"), ("b", "x"), ("a", "new")]))
        assert rows(sinks.insert_ignore(base, new, ["k"])) == [("a", "old"), ("b", "x")]

    def test_append(self, spark, tmp_path):
        df = observations(spark, (1, "G", "a", "1"))
        for batch in (0, 1, 1):
            sinks.write_history(df, str(tmp_path / "h"), batch)
        assert rows(spark.read.parquet(str(tmp_path / "h")).groupBy("batch").count()) == [(0, 1), (1, 1)]

    def test_partitions_and_upserts(self, spark, tmp_path):
        path, df = f"{tmp_path}/t", spark.createDataFrame([(i, f"k {i % 4}" if i % 5 else None) for i in range(40)], "i int, k string")
        files = lambda: {str(p): p.stat().st_mtime_ns for p in tmp_path.glob("t/*/*.parquet")}
        kept.replace_partitions(df, path, ["k"])
        before = files()
        kept.replace_partitions(spark.read.parquet(path).filter("k = 'k 1'").limit(2).select("i", "k"), path, ["k"], touched=df.filter("k in ('k 1', 'k 2') or k is null").select("k"))
        left = rows(spark.read.parquet(path).groupBy("k").count())
        assert left == [("k 0", 8), ("k 1", 2), ("k 3", 8)]
        assert {f: t for f, t in before.items() if "k%200" in f or "k 0" in f or "k 3" in f or "k%203" in f}.items() <= files().items()
        kept.drop_partitions(spark, path, [{"k": "k 0"}, {"k": "none"}])
        assert rows(spark.read.parquet(path).groupBy("k").count()) == [("k 1", 2), ("k 3", 8)]
        path, row = f"{tmp_path}/u", "k string, t int, v string"
        kept.upsert_table(spark.createDataFrame([(f"k{i}", 1, "old") for i in range(50)] + [("k1", 0, "older")], row), path, ["k"], "t", 8)
        before = {str(p): p.stat().st_mtime_ns for p in tmp_path.glob("u/*/*.parquet")}
        for _ in range(2):
            kept.upsert_table(spark.createDataFrame([("k1", 2, "new"), ("k2", 0, "late"), ("new", None, "new")], row), path, ["k"], "t", 8)
        got = {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}
        assert len(got) == 51 and (got["k1"], got["k2"], got["new"]) == ("new", "old", "new") and spark.read.parquet(path).count() == 51
        assert len(before.items() & {str(p): p.stat().st_mtime_ns for p in tmp_path.glob("u/*/*.parquet")}.items()) >= 5

    def test_history_is_not_shuffled(self, spark, tmp_path):
        path = f"{tmp_path}/h"
        seen = observations(spark, *[(p, "G", n, str(p)) for p in range(1, 6) for n in "abc"], (6, "G", "a", None))
        assert kept.update_history(seen.filter("pos <= 3"), path, 4) == 0 == kept.update_history(seen.filter("pos <= 3"), path, 4)
        assert kept.update_history(seen, path, 4) == 1
        kept.delete(spark, f"{path}/marks/version=1")  # as if it had failed before its end
        assert rows(kept.history(spark, path).agg(F.max("pos"))) == [(3,)]
        assert kept.update_history(seen, path, 4) == 1 == kept.update_history(seen, path, 4)
        columns = ("branch_id", "pos", "path", "name", "change_type", "requirement", "previous_version")
        assert rows(kept.history(spark, path), *columns) == rows(ch.changes(seen), *columns)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            last = kept.last_events(spark, path, 1, seen.schema, 4)
            plan = kept.fresh_events(last, seen, 4)[1]._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # the one of the fresh rows

    def test_history_is_dealt_once_into_buckets_that_grow(self, spark, tmp_path):
        """buckets follow the rows, new observations are shuffled once, and what comes from them and the last ones isn't."""
        path, columns = f"{tmp_path}/h", ("branch_id", "pos", "path", "name", "change_type", "requirement", "previous_version")
        seen = observations(spark, *[(p, "G", f"n{n}", str(p // 2 + n) if (p + n) % 5 else None) for p in range(1, 7) for n in range(p * 9)])
        for version, (pos, buckets) in enumerate([(1, 3), (2, 7), (4, 21), (6, 21)]):
            assert kept.update_history(seen.filter(F.col("pos") <= pos), path, 2, 4) == version
            assert rows(kept.history(spark, path), *columns) == rows(ch.changes(seen.filter(F.col("pos") <= pos)), *columns)
            assert {r[0] for r in rows(spark.read.parquet(f"{path}/marks/version={version}"), "buckets")} == {buckets}
            last = rows(spark.read.parquet(f"{path}/last/version={version}"), "name", "pos", "version")
            assert last == rows(seen.filter(F.col("pos") <= pos).groupBy("name").agg(F.max_by(F.struct("pos", "version"), "pos").alias("m")).select("name", "m.*"))
        kept._write_bucketed(seen.repartition(21, *ch.KEY), f"{tmp_path}/d", 21)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            both = kept._after(kept.last_events(spark, path, 3, seen.schema, 21), kept._bucketed(spark, f"{tmp_path}/d", seen.schema, 21))
            plans = [df._jdf.queryExecution().executedPlan().toString() for df in both]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert all("Exchange" not in p and p.count("Bucketed: true") == 2 for p in plans)

    def test_increment_equals_full_build(self, v):
        mark = v.commits.groupBy("branch_id").agg((F.max("pos") - 50).alias("pos"))
        known = v.changes.join(mark.select("branch_id", F.col("pos").alias("m")), "branch_id").filter("pos <= m").drop("m")
        late = v.changes.join(mark.select("branch_id", F.col("pos").alias("m")), "branch_id").filter("pos > m")
        columns = ("branch_id", "pos", "path", "name", "change_type", "requirement", "previous_version")
        assert rows(sinks.incremental_update(known, v.observations, mark), *columns) == rows(late, *columns)
        assert rows(sinks.high_water_mark(v.changes)) == rows(v.changes.groupBy("branch_id").agg(F.max("pos")))

    def test_csv(self, spark, tmp_path):
        df = spark.createDataFrame([("a", ["x", "y"], True), ("b", [], False)], "n string, l array<string>, f boolean")
        sinks.export_csv(df, str(tmp_path / "c"))
        assert rows(spark.read.option("header", True).csv(str(tmp_path / "c"))) == [("a", "x, y", "yes"), ("b", None, None)]


class TestStreams:
    def test_state_is_kept_by_rows(self, spark, tmp_path):
        """No frame is made for a key: keys are many and have few rows."""
        observations(spark, (1, "G", "a", "1")).write.parquet(f"{tmp_path}/in")
        plan = stream.changes_stream(spark.readStream.schema(OBS).parquet(f"{tmp_path}/in"))._jdf.queryExecution().analyzed().toString()
        assert "TransformWithStateInPySpark" in plan and "InPandas" not in plan and "pd." not in inspect.getsource(stream.LastSeen)

    def test_late_rows_come_out_and_restarts_go_on(self, spark, tmp_path):
        """Three deliveries, each drained by a stream begun anew; the second is put in twice, as after a failure."""
        source, kept_ = str(tmp_path / "in"), str(tmp_path / "kept")
        for batch in ([(2, "G", "a", "1"), (1, "G", "a", "0")], [(2, "G", "a", "9"), (3, "G", "a", None)], [(1, "G", "b", "1"), (1, "G", "b", "2")]):
            observations(spark, *batch).coalesce(1).write.mode("append").parquet(source)
            read = spark.readStream.schema(OBS).parquet(source)
            stream.keep_changes(stream.changes_stream(read), kept_, str(tmp_path / "cp"))
        columns = ("name", "pos", "change_type", "requirement", "previous_version")
        assert rows(spark.read.parquet(f"{kept_}/events"), *columns) == [("a", 1, "added", "0", None), ("a", 2, "modified", "1", "0"), ("a", 3, "removed", "1", None), ("b", 1, "added", "1", None)]
        assert rows(spark.read.parquet(f"{kept_}/late"), "name", "pos", "version") == [("a", 2, "9"), ("b", 1, "2")]
        again = spark.read.parquet(f"{kept_}/events").filter("batch = 1").select("branch_id", "path", "name", "pos", "change_type", "requirement", "previous_version")
        kept.upsert_table(again, f"{kept_}/latest", list(ch.KEY), "pos", parts=16)
        assert rows(spark.read.parquet(f"{kept_}/latest"), *columns) == [("a", 3, "removed", "1", None), ("b", 1, "added", "1", None)]

    @pytest.mark.parametrize("size", [3, 500_000])
    def test_kept_state_gives_what_the_state_store_gives(self, spark, tmp_path, size):
        """events, late rows and last events of random deliveries, of which the second is put in twice; buckets grow with the rows."""
        r, source = random.Random(7), str(tmp_path / "in")
        of = lambda: (r.randrange(1, 40), r.choice("GH"), r.choice("abcd"), r.choice(("1", "2", None)))
        for k in range(3):
            once = {(x[0], x[1], x[2]): x for x in [of() for _ in range(40)]}
            observations(spark, *once.values()).coalesce(2).write.mode("append").parquet(source)
            read = spark.readStream.schema(OBS).parquet(source)
            stream.keep_changes(stream.changes_stream(read), str(tmp_path / "store"), str(tmp_path / "cp1"))
            for again in (False, True):
                if again and k == 1:  # as if the stream had failed before it noted the end of the batch
                    [f.unlink() for name in ("1", ".1.crc") if (f := tmp_path / "cp2/commits" / name).exists()]
                stream.keep_events(read, str(tmp_path / "kept"), str(tmp_path / "cp2"), 2, size)
        key = ("branch_id", "path", "name", "pos")
        kept_ = stream.kept_events(spark, str(tmp_path / "kept"))
        stored = {n: spark.read.parquet(f"{tmp_path}/store/{n}") for n in ("events", "late", "latest")}
        assert rows(kept_.filter("NOT late"), *key, "change_type", "requirement", "previous_version") == rows(stored["events"], *key, "change_type", "requirement", "previous_version")
        late = rows(kept_.filter("late"), *key, "requirement")
        assert late == rows(stored["late"], *key, "version") and len(late) > 9
        assert rows(stream.kept_last(spark, str(tmp_path / "kept")), *key, "change_type") == rows(stored["latest"], *key, "change_type")
        assert (spark.read.parquet(f"{tmp_path}/kept/marks/version=2").first()["buckets"] > 2) == (size == 3)

    def test_kept_state_is_met_by_built_in_plans(self, spark, tmp_path):
        """No Python on executors, one shuffle of the micro-batch and none of the state; of equal positions one row counts."""
        observations(spark, (1, "G", "a", "1"), (1, "G", "a", "2"), (3, "G", "b", "1")).write.parquet(f"{tmp_path}/in")
        stream.keep_events(spark.readStream.schema(OBS).parquet(f"{tmp_path}/in"), f"{tmp_path}/kept", f"{tmp_path}/cp", 4)
        found = rows(stream.kept_events(spark, f"{tmp_path}/kept"), "name", "pos", "change_type", "requirement")
        assert found == [("a", 1, "added", "1"), ("a", 1, "late", "2"), ("b", 3, "added", "1")]
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            known = kept.last_events(spark, f"{tmp_path}/kept", 0, stream.StructType.fromDDL(stream.KNOWN), 4)
            rows_ = spark.read.parquet(f"{tmp_path}/in").select("branch_id", "path", "name", "pos", "version", "scope").repartition(4, "branch_id", "path", "name")
            plan = stream.step(rows_, known)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "Python" not in plan

    def test_late_rows_of_closed_windows_are_dropped(self, spark, tmp_path):
        source, day = str(tmp_path / "in"), lambda d: (datetime(2001, 1, d, 5), "added")
        for batch in ([day(1), day(1), day(20)], [day(1), day(15), day(31)]):
            spark.createDataFrame(batch, "committed_at timestamp, change_type string").coalesce(1).write.mode("append").parquet(source)
            read = spark.readStream.schema("committed_at timestamp, change_type string").parquet(source)
            got = stream.drained(stream.changes_per_window(read), str(tmp_path / "out"), str(tmp_path / "cp"))
        assert [(r[0].day, r[2]) for r in rows(got)] == [(1, 2), (15, 1), (20, 1)]

    def test_windows_in_batch(self, spark):
        df = spark.createDataFrame([(datetime(2001, 1, 1, h), "added") for h in (1, 5)] + [(datetime(2001, 1, 2), "added")], "committed_at timestamp_ntz, change_type string")
        assert [r[2] for r in rows(stream.changes_per_window(df))] == [2, 1]


def test_rollups_count_distinct_commits_of_any_range(v):
    rollup = written(stats.daily_rollup(v.changes, v.commits), "rollup")
    columns = ("author_name", "author_email", "commits", "changes", "added", "modified", "removed")
    for given in ({}, {"since": "1995-03-01", "until": "1997-11-30"}, {"ecosystem": "pypi", "author": "7", "until": "1996-01-01"}, {"since": "2030-01-01"}):
        assert rows(stats.rolled_author_stats(rollup, **given), *columns) == rows(stats.author_stats(v.changes, v.commits, **given), *columns)
        assert rows(stats.rolled_commit_counts(rollup, v.commits, **given)) == rows(stats.commit_counts(v.changes, v.commits, **given))
    shared = v.commits.withColumn("branch_id", F.lit(99).cast("long"))  # commits that are in two branches count once
    events = v.changes.unionByName(v.changes.withColumn("branch_id", F.lit(99).cast("long")))
    both = stats.daily_rollup(events, v.commits.unionByName(shared))
    assert rows(stats.rolled_author_stats(both), *columns[:3]) == rows(stats.author_stats(v.changes, v.commits), *columns[:3])


def test_rollup_of_an_author_is_a_word(v):
    """a cell of a rollup takes 8 bytes for its commits, and not 4 KB."""
    rollup = stats.daily_rollup(v.changes, v.commits)
    assert dict(rollup.dtypes)["commits"] == "bigint"


def test_texts_of_versions_give_the_same_as_parsing(spark):
    """with and without texts that are parsed once, equal and impossible versions included; too many texts aren't sent to tasks."""
    seen = [("npm", "a", x, d) for x, d in (("1.0.0", 1), ("1.0.0+b", 3), ("1.2.0-rc.1", 3), ("no", 4))] + [("pypi", "a", "1!0.1", 2), ("pypi", "a", "2.0", 2), ("npm", "b", "none", 1)]
    df = spark.createDataFrame([(e, n, x, datetime(2001, 1, d)) for e, n, x, d in seen], "ecosystem string, name string, version string, published_at timestamp_ntz")
    texts = policy.version_texts(df)
    assert texts.filter("place IS NULL").count() == 2 and policy.version_texts(df, 3) is None
    assert rows(policy.latest_versions(df, texts)) == rows(policy.latest_versions(df))
    for date in ("2001-01-03", "2001-01-05"):
        assert rows(policy.latest_at(df, date, texts)) == rows(policy.latest_at(df, date))
    state_ = df.withColumn("kind", F.lit("lockfile"))
    latest, columns = policy.latest_versions(df), ("ecosystem", "version", "update")
    some = texts.filter("version <> '2.0'")
    assert rows(policy.outdated(state_, latest, texts=texts), *columns) == rows(policy.outdated(state_, latest, texts=some), *columns) == rows(policy.outdated(state_, latest), *columns)


def test_exposed_packages_are_dealt_alone(v):
    """Line items of packages without advisories leave before the first shuffle, and no hit is lost."""
    names_ = ("branch_id", "path", "name", "version", "id")
    assert rows(vulns.scan(v.exposed.latest, v.advisories), *names_) == rows(vulns.scan(v.latest, v.advisories), *names_)
    assert 0 < v.exposed.numbers.count() < v.numbers.count() / 4
    few = adv.of_known_packages(v.numbers, v.advisories, F.lit("npm"), F.lit("none"), most=1)
    assert few.count() == v.numbers.count()


def test_registry_check_deals_each_side_once_and_without_hashes(v, spark):
    """lockfiles alone, one shuffle by version for each side of the join, and hashes are made after it; the rows are those of the whole tables with their texts."""
    columns = ("ecosystem", "name", "version", "integrity", "outcome")
    before = lambda df: df.filter(F.col("published_at") < F.lit("2000-01-01").cast("timestamp_ntz"))
    want = policy.integrity_registry_check(v.latest.filter("kind = 'lockfile'"), before(v.registry_versions))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = policy.integrity_registry_check(v.locked.latest_flagged, before(v.registry_flagged), v.hashed)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows(found, *columns) == rows(want, *columns) and {r[0] for r in rows(found.select("outcome").distinct())} == {"ok", "mismatch", "skipped"}
    assert len(re.findall(r"Exchange hashpartitioning\(ecosystem", plan)) == 2
    assert "md5" in plan and "md5" not in plan[plan.index("SortMergeJoin"):]


@pytest.mark.parametrize("small", [0, 2, 64])
def test_open_intervals_of_small_keys(spark, small):
    """keys of few points are met as they are, those of more by buckets."""
    i = spark.createDataFrame([(k, f"n{n}", n * 3, n * 3 + 7 if n % 4 else None) for k in range(3) for n in range(9)], "k long, name string, pos_from long, pos_to long")
    p = spark.createDataFrame([(k, at, f"r{at}") for k in range(4) for at in range(0, 30, 4 * k + 3)], "k long, at long, ref string")
    want = rows(i.join(p, "k").filter("pos_from <= at AND (pos_to IS NULL OR pos_to > at)"), "k", "name", "ref")
    assert rows(state.open_intervals(i, p, ["k"], 4, 0, small), "k", "name", "ref") == want != []


@pytest.mark.parametrize("most", [0, 10_000])
def test_points_of_hot_keys_shuffle_no_result(spark, most):
    """a key of many points has them by blocks of positions, with an index or without one; intervals stay where they are, or are dealt once for each block."""
    ends = [(k, f"n{n}", n * 37, n * 37 + 900 + n if n % 4 else None) for k in range(3) for n in range(60)]
    i = spark.createDataFrame([*ends, (0, "late", 9000, None)], "k long, name string, pos_from long, pos_to long")
    p = spark.createDataFrame([(k, at) for k in range(2) for at in range(-3, 2600, 5 + 40 * k)] + [(1, None), (2, 100)], "k long, at long")
    want = rows(i.join(p, "k").filter("pos_from <= at AND (pos_to IS NULL OR pos_to > at)"), "k", "name", "at")
    extra = p.withColumn("ref", F.concat(F.lit("r"), "at"))
    for bucket in (2, 1024):
        found = state.open_intervals(i, p, ["k"], bucket, 0, 4, most)
        assert rows(found, "k", "name", "at") == want != [] and found.columns == ["k", "name", "pos_from", "pos_to", "at"]
        assert rows(state.open_intervals(i, extra, ["k"], bucket, 0, 4, most), "k", "name", "ref") == [(k, n, f"r{at}") for k, n, at in want]
    hot = state.open_intervals(i, p.filter("k < 2"), ["k"], 2, 0, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in hot and "BroadcastHashJoin" in hot


@pytest.mark.parametrize("name", ["snapshot_materialize", "manifest_removed"])
def test_line_items_are_dealt_once(name, spark, tiny, monkeypatch):
    """what is made of line items is written before it is used twice, so no plan but that of the written rows reads them."""
    made = []
    monkeypatch.setattr("depchron.plans.core.written", lambda df, label: made.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, label))
    plan = QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "l_partkey" in made[0] and len(made) == 1 and "l_partkey" not in plan


def test_profiles(spark):
    df = spark.createDataFrame([("npm",), ("",), (None,)], "ecosystem string")
    assert rows(stats.ecosystems(df, df)) == [("npm",)]
    assert rows(stats.table_profile({"t": df})) == [("t", 3)]


class TestReach:
    def graph(self, spark):
        """A main line of 40, a branch from 10 merged at 20, one from 15 never merged, a merge of an unknown parent, and a child dated before its parent."""
        parents = {f"m{i}": [f"m{i - 1}"] if i else [] for i in range(40)}
        parents |= {"a0": ["m10"], "a1": ["a0"], "m20": ["m19", "a1"], "b0": ["m15"], "b1": ["b0", "lost"], "m30": ["m29", "early"], "early": ["m25"], "root2": None}
        day = {s: i for i, s in enumerate(sorted(parents, key=lambda s: (int(s.strip("mabeorlyt") or 0), s)))} | {"early": -5}
        rows_ = [(s, p, datetime(2020, 1, 1) + timedelta(days=day[s])) for s, p in parents.items()]
        return parents, spark.createDataFrame([*rows_, rows_[0]], "sha string, parents array<string>, committed_at timestamp_ntz")

    @pytest.mark.parametrize("size", [4, 1000])
    def test_closure(self, spark, size):
        parents, commits = self.graph(spark)

        def closure(tip):
            out, todo = set(), [tip]
            while todo:
                s = todo.pop()
                if s in parents and s not in out:
                    out.add(s)
                    todo += parents[s] or []
            return out

        tips = [(1, "m39"), (2, "b1"), (2, "a1"), (3, "root2"), (4, "nowhere")]
        got = rows(reach.reachable(commits, spark.createDataFrame(tips, "branch_id long, sha string"), size), "branch_id", "sha")
        assert got == sorted({(b, s) for b, t in tips for s in closure(t)}, key=repr)
        if size == 1000:
            since = spark.createDataFrame([(1, "m20")], "branch_id long, sha string")
            log = rows(reach.branch_log(commits.dropDuplicates(["sha"]), spark.createDataFrame(tips[:1], "branch_id long, sha string"), since), "sha", "pos")
            assert {s for s, _ in log} == closure("m39") - closure("m20") and max(p for _, p in log) == len(closure("m39"))

    def test_rounds_read_only_their_stretches(self, spark):
        """a stretch is files of its own, and numbers of positions don't depend on the size of stretches."""
        _, commits = self.graph(spark)
        _, edges = reach.placed(commits, 4)
        plan = edges.filter(F.col("stretch").isin([2, 3]))._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [stretch" in plan and edges.filter("stretch <> floor(place / 4)").isEmpty()
        tips, since = (spark.createDataFrame([(1, s)], "branch_id long, sha string") for s in ("m39", "m20"))
        logs = [rows(reach.branch_log(commits, tips, since, size), "branch_id", "sha", "pos") for size in (4, 1000)]
        assert logs[0] == logs[1] != []

    @pytest.mark.parametrize(("days", "most"), [(4, 16), (1, 200)])
    def test_commits_of_one_time_are_in_one_stretch(self, spark, tmp_path, monkeypatch, days, most):
        """a chain through commits of one time, whose places are in no order, takes no round for each border that it crosses; a time that is too long is cut."""
        sha = lambda i: f"{hash_(i)}-{i}"
        hash_ = lambda i: (i * 7919) % 101
        at = lambda i: datetime(2020, 1, 1) + timedelta(days=i * days // 60)
        chain = spark.createDataFrame([(sha(i), [sha(i - 1)] if i else [], at(i)) for i in range(60)], "sha string, parents array<string>, committed_at timestamp_ntz")
        nodes, _ = reach.placed(chain, 40)
        per = nodes.groupBy("committed_at").agg(F.count_distinct(F.floor(F.col("place") / 40)).alias("n")).collect()
        assert all(r["n"] == 1 for r in per) == (days > 1)
        made = []
        monkeypatch.setattr(reach, "new_folder", lambda s, label: made.append(f"{tmp_path}/{label}{len(made)}") or made[-1])
        tips = spark.createDataFrame([(1, sha(59))], "branch_id long, sha string")
        assert rows(reach.branch_log(chain, tips, None, 40), "pos", "sha") == sorted(((n + 1, sha(i)) for n, i in enumerate(sorted(range(60), key=lambda i: (at(i), sha(i))))), key=repr)
        assert len(list(tmp_path.glob("reached*/round=*"))) <= most

    def test_tree_changes(self, spark):
        trees = {
            1: {"a/x": "1", "a/y": "2", "b/c/d/e": "3", "b/c/f": "4", "top": "5", "same/" + "deep/" * 4 + "z": "6"},
            2: {"a/x": "1", "a/y": "9", "b/c/d/e": "3", "new/n": "4", "top": "5", "same/" + "deep/" * 4 + "z": "6", "a/w/v": "1"},
            3: {"a": "1", "b/c/d/e": "3"}, 4: {},
        }
        files = spark.createDataFrame([(c, p, b, "mine") for c, t in trees.items() for p, b in t.items()] + [(1, "top", "5", "mine")], "commit long, path string, blob string, node string")
        pairs = [(1, None), (2, 1), (3, 2), (4, 3)]
        roots, nodes = reach.tree_nodes(files)
        want = []
        for c, p in pairs:
            new, old = trees[c], trees.get(p, {})
            want += [(c, x, "A" if x not in old else "D" if x not in new else "M") for x in {*new, *old} if new.get(x) != old.get(x)]
        assert rows(reach.tree_changes(roots, nodes, spark.createDataFrame(pairs, "commit long, parent long")), "commit", "path", "status") == sorted(want, key=repr)
        odd = rows(reach.tree_changes(roots, nodes, spark.createDataFrame([(1, 1), (3, 77)], "commit long, parent long")), "commit", "path", "status")
        assert odd == [(3, "a", "A"), (3, "b/c/d/e", "A")]
        shared = rows(nodes.filter("name = 'deep'"))
        assert len(shared) == 4  # the chain of equal folders is kept once for both commits
        assert rows(reach.tree_changes(*reach.tree_nodes(files.limit(0)), spark.createDataFrame([(1, None)], "commit long, parent long"))) == []


class TestStored:
    def events(self, spark):
        r = random.Random(5)
        rows_ = []
        for b in (1, 2):
            for name in "abcdefgh":
                there = False
                for pos in sorted(r.sample(range(1, 60), 12)):
                    kind = "removed" if there and r.random() < 0.4 else "modified" if there else "added"
                    there = kind != "removed"
                    rows_.append((b, pos, "m", name, "npm", "lockfile", f"{pos}" if there else None, "runtime", None, kind))
        columns = "branch_id long, pos long, path string, name string, ecosystem string, kind string, version string, scope string, integrity string, change_type string"
        return spark.createDataFrame(rows_, columns)

    def test_replayed(self, spark, tmp_path):
        events = self.events(spark)
        intervals = ch.state_intervals(events)
        refs = spark.createDataFrame([(f"r{p}", b, p) for b in (1, 2) for p in (0, 1, 7, 30, 31, 59, 99)], "ref string, branch_id long, pos long")
        state.store_snapshots(intervals, events, f"{tmp_path}/s", every=5)
        files = lambda b: {(p, p.stat().st_mtime_ns) for p in tmp_path.glob(f"s/branch_id={b}/*/*.parquet")}
        before = files(1), files(2)
        want = rows(state.state_at(intervals, refs), "ref", "at", *state.STATE)
        found = state.stored_state_at(spark, f"{tmp_path}/s", events, refs)
        assert rows(found, "ref", "at", *state.STATE) == want and len(want) > 30
        assert rows(state.state_at(intervals, refs, bucket=8, few=0), "ref", "at", *state.STATE) == want
        state.store_snapshots(intervals.filter("branch_id = 1"), events.filter("branch_id = 1"), f"{tmp_path}/s", every=5)
        assert files(2) == before[1] and not files(1) & before[0]
        assert rows(state.stored_state_at(spark, f"{tmp_path}/s", events, refs), "ref", "at", *state.STATE) == want
        assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()

    def test_snapshots_grow_with_the_events(self, spark, tmp_path):
        events = observations(spark, *[(p, "m", f"n{p:03}", "1") for p in range(1, 257)]).withColumn("change_type", F.lit("added"))
        state.store_snapshots(ch.state_intervals(events), events, f"{tmp_path}/s", every=1)
        assert spark.read.parquet(f"{tmp_path}/s").count() <= 5 * 256  # whole states would be 32,896 rows
        refs = spark.createDataFrame([(f"r{p}", 1, p) for p in (1, 63, 64, 255, 256)], "ref string, branch_id long, pos long")
        assert sorted(rows(state.stored_state_at(spark, f"{tmp_path}/s", events, refs).groupBy("at").count())) == [(1, 1), (63, 63), (64, 64), (255, 255), (256, 256)]

    @pytest.mark.parametrize("base", [2, 3, 64])
    def test_snapshots_are_few_copies_in_few_folders(self, spark, tmp_path, monkeypatch, base):
        """an event is kept for each power of a large base and shuffled once, and a chain of many snapshots is followed at once."""
        assert state.BASE >= 64 and state.with_next(ch.changes(observations(spark, (1, "m", "a", "1"))))._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
        monkeypatch.setattr(state, "BASE", base)
        monkeypatch.setattr(state, "PART", 7)
        r, rows_ = random.Random(base), []
        for name in range(30):
            rows_ += [(p, "m", f"n{name:02}", r.choice(("1", "2", None))) for p in sorted(r.sample(range(1, 200), 25))]
        events = ch.changes(observations(spark, *rows_))
        refs = spark.createDataFrame([(f"r{p}", 1, p) for p in (1, 2, 15, 16, 64, 65, 127, 150, 199, 300)], "ref string, branch_id long, pos long")
        state.store_snapshots(ch.state_intervals(events), state.with_next(events), f"{tmp_path}/s", every=2)
        columns = ("ref", "branch_id", "path", "name", "version")
        want = rows(state.state_at(ch.state_intervals(events), refs), *columns)
        assert rows(state.stored_state_at(spark, f"{tmp_path}/s", events, refs), *columns) == want and len(want) > 100
        stored = spark.read.parquet(f"{tmp_path}/s")
        assert len(list(tmp_path.glob("s/branch_id=1/block=*"))) == -(-stored.select("at").distinct().count() // base)
        assert base < 64 or stored.count() <= 2.1 * events.count()

    def test_only_asked_snapshots_are_materialized(self, spark):
        o = ch.changes(observations(spark, *[(p, "m", f"n{p:02}", "1") for p in range(1, 41)]))
        refs = spark.createDataFrame([("a", 1, 1), ("b", 1, 7), ("c", 1, 40)], "ref string, branch_id long, pos long")
        whole = state.snapshot_asof(state.snapshot_materialize(ch.state_intervals(o), o, every=3), refs)
        found = state.materialized_asof(ch.state_intervals(o), o, refs, every=3)
        assert rows(found, "ref", "at", "name") == rows(whole, "ref", "at", "name") and found.count() == 46

    def test_spans(self, spark):
        events = self.events(spark)
        intervals = ch.state_intervals(events)
        refs = spark.createDataFrame([(n, b, p) for b in (1, 2) for n, p in (("a", 10), ("b", 30), ("head", 59))], "ref string, branch_id long, pos long")
        of = lambda n: state.state_at(intervals, refs.filter(F.col("ref") == n))
        for given, (old, new) in {("a", "b"): ("a", "b"), ("a..b",): ("a", "b"), ("a..",): ("a", "head"), ("b",): ("b", "head"), ("b..a",): ("b", "a")}.items():
            assert rows(state.diff_refs(intervals, refs, *given)) == rows(state.diff_states(of(old), of(new)))
        before = refs.filter("ref = 'head'").withColumn("pos", F.col("pos") - 1)
        assert rows(state.diff_refs(intervals, refs)) == rows(state.diff_states(state.state_at(intervals, before), of("head")))

    def test_few_references_shuffle_no_intervals(self, v):
        at = state.state_at(v.intervals, v.refs.filter("ref <> 'head'"))._jdf.queryExecution().executedPlan().toString()
        alone = v.intervals._jdf.queryExecution().executedPlan().toString()
        assert at.count("Exchange hash") == alone.count("Exchange hash") < 8
