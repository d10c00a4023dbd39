"""Selection, roots and sequences by ranges, against plain versions."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from usagelens.operators import robust, selection, sequences, trees
from usagelens.plans import catalog


@pytest.mark.parametrize("few", [0, 4, 4096])
def test_selection_is_exact(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "BINS", 7)
    rng = random.Random(few)
    for values in ([3.5], [1.0, 2.0], [0.0] * 9 + [1e300, -1e300], [rng.gauss(0, 1) ** 5 for _ in range(301)], [rng.choice([1e-310, 5.0, 5.000000000000001, -2.0]) for _ in range(100)], [-1.7e308, 1.7e308, 0.1]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "x double").repartition(3)
        order = sorted(values)
        ranks = sorted({0, len(order) // 3, len(order) - 1})
        assert selection.ranked_values(df, "x", ranks) == [order[r] for r in ranks]
        assert selection.exact_median(df, "x") == order[(len(order) - 1) // 2] * 0.5 + order[len(order) // 2] * 0.5
    none = spark.createDataFrame([(None,)], "x double")
    assert selection.exact_median(none, "x") is None and selection.ranked_values(none.limit(0), "x") == []
    assert tuple(robust.spread(none, "x").first()) == (None, None)


def test_spread(spark):
    rng = random.Random(1)
    values = [rng.expovariate(1) for _ in range(1001)]
    med = statistics.median(values)
    got = robust.spread(spark.createDataFrame([(v,) for v in values], "x double"), "x").first()
    assert got.med == med and got.mad == statistics.median(abs(v - med) for v in values)


def test_no_task_holds_the_values_of_a_median(spark):
    names = ["median_mad", "cost_outliers", "baseline_cross", "dedup_outlier_mark", "snooze_filter", "union_audit_signals", "audit_outlier_signal", "daily_spike", "session_cost_scores"]
    for name in names:
        df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
        assert "percentile" not in df._jdf.queryExecution().toString().lower() and "median(" not in df._jdf.queryExecution().toString().lower(), name


def test_roots_of_chains_cycles_and_orphans(spark):
    links = [(1, None), *[(i, i - 1) for i in range(2, 7)], (10, 11), (11, 12), (12, 10), (13, 12), (14, 14), (20, 99), (21, 20), (30, None), (None, 1), (6, 5)]
    got = {r.id: (r.root_id, r.state) for r in trees.roots(spark.createDataFrame(links, "id long, parent_id long")).collect()}
    want = {1: (1, "root"), 30: (30, "root"), **{i: (1, "child") for i in range(2, 7)}, **{i: (None, "cycle") for i in (10, 11, 12, 13, 14)}, 20: (None, "orphan"), 21: (None, "orphan")}
    assert got == want
    long = spark.range(1, 3000).selectExpr("id", "case when id > 1 then id - 1 end as parent_id")
    assert trees.roots(long).groupBy("root_id", "state").count().collect().__len__() == 2
    assert trees.roots(links_of(spark, [])).count() == 0
    named = trees.roots(spark.createDataFrame([("b", "a"), ("a", None), ("c", "gone")], "id string, parent_id string"))
    assert {r.id: r.root_id for r in named.collect()} == {"a": "a", "b": "a", "c": None}


def links_of(spark, rows):
    return spark.createDataFrame(rows, "id long, parent_id long")


def calls(rng, n):
    """Rows of which one session has half; ts ties are told apart by id."""
    base = datetime(2024, 1, 1)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None, "c"]), base + timedelta(seconds=rng.randint(0, 40 * n)), i, rng.choice("xxxy"), rng.choice([1, 1, 1, None])) for i in range(n)]
    return rows, "s string, ts timestamp_ntz, id long, tool string, args int"


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_a_hot_session_is_spread_and_results_are_whole(spark):
    rng = random.Random(8)
    rows, schema = calls(rng, 2000)
    df = spark.createDataFrame(rows, schema)
    seq = sequences.Sequence(df, "s", "ts", "id")
    assert seq.rows.where("s = 'hot'").select("_range").distinct().count() >= 2
    groups = by_key(rows)
    assert {(r.id, r.line) for r in seq.places("line").collect()} == {(r[2], i) for g in groups.values() for i, r in enumerate(g, 1)}
    before = {(r.id, r.b) for r in seq.beside({"b": "id"}).rows.collect()}
    assert before == {(r[2], g[i - 1][2] if i else None) for g in groups.values() for i, r in enumerate(g)}
    after = {(r.id, r.b) for r in seq.beside({"b": "id"}, after=True).rows.collect()}
    assert after == {(r[2], g[i + 1][2] if i + 1 < len(g) else None) for g in groups.values() for i, r in enumerate(g)}
    gaps = {k: sum(d for a, b in zip(g, g[1:]) if (d := (b[1] - a[1]).total_seconds()) < 300) for k, g in groups.items()}  # noqa: B905
    assert {r.s: r.active_seconds for r in sequences.active_seconds(df, "s", "ts", 300, "id").collect()} == gaps
    want = set()
    for g in groups.values():
        at = 0
        while at < len(g):
            end = at
            while end < len(g) and g[end][3:] == g[at][3:]:
                end += 1
            n = end - at
            keep = range(at, end) if n < 3 else (at, at + 1, end - 1)
            want |= {(g[i][2], "marker" if n >= 3 and i == at + 1 else "call", n - 2 if n >= 3 and i == at + 1 else 0) for i in keep}
            at = end
    assert {(r.id, r.kind, r.replaced) for r in sequences.compacted(df, "s", ("ts", "id"), ["tool", "args"]).collect()} == want


def test_sequences_of_nothing_and_of_one_run(spark):
    _, schema = calls(random.Random(0), 0)
    none = spark.createDataFrame([], schema)
    assert sequences.compacted(none, "s", ("ts", "id"), ["tool"]).count() == 0
    assert sequences.active_seconds(none, "s", "ts", 300, "id").count() == 0 and sequences.Sequence(none, "s", "ts", "id").places("n").count() == 0
    one = spark.range(1000).select(F.lit("hot").alias("s"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), "id", F.lit("x").alias("tool"))
    got = {(r.id, r.kind, r.replaced) for r in sequences.compacted(one, "s", ("ts", "id"), ["tool"]).collect()}
    assert got == {(0, "call", 0), (1, "marker", 998), (999, "call", 0)}


def test_no_frame_reaches_to_the_end_of_a_range(spark):
    """Spark goes through the rest of the partition for each row of such a frame."""
    rows, schema = calls(random.Random(3), 300)
    plan = sequences.compacted(spark.createDataFrame(rows, schema), "s", ("ts", "id"), ["tool", "args"])._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe" in plan and "unboundedfollowing" not in plan
