import json
import sqlite3
import subprocess
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from usagelens import cli
from usagelens.config import Config
from usagelens.functions.text import glob_pattern
from usagelens.operators import robust, sequences
from usagelens.plans import catalog, report, validators
from usagelens.sources import external, files, sqlite

SF = "/root/testdata/sf0.001"
SAMPLE = ["totals", "by_model", "daily_totals", "active_time", "compact_repeats", "cost_outliers", "alerts", "delta_join", "never_loaded", "merge_children", "session_roots", "audit_priority", "link_diff", "token_jaccard_pairs", "dedup_items", "rollup_totals"]


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_each_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.sql(f"create view {p.stem} as select * from '{p}'")
    got = catalog.queries()[name](spark, SF)
    want = db.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    rows = sorted(str([r[i] for i in order]) for r in want.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == rows


def test_each_payload_has_its_readable_flag(spark):
    got = {r.event_id: r.readable for r in catalog.queries()["bad_json_skip"](spark, SF).collect()}
    assert got == {r.event_id: r.event_id % 97 != 0 for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect()}


def test_active_gap_is_strict(spark):
    rows = [("a", datetime(2024, 1, 1, 0, 0)), ("a", datetime(2024, 1, 1, 0, 5)), ("a", datetime(2024, 1, 1, 0, 9)), ("b", datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "s string, ts timestamp_ntz")
    assert {r.s: r.active_seconds for r in sequences.active_seconds(df, "s", "ts", 300).collect()} == {"a": 240, "b": 0}


def test_zero_mad_gives_null_z(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 9.0)], "id int, x double")
    assert {r.z for r in robust.robust_z(df, "x").collect()} == {None}


def test_freshest(spark):
    two = spark.createDataFrame([(1, 5, "x"), (1, 7, "y")], "id int, t int, s string")
    assert [r.s for r in robust.freshest(two, "id", "t").collect()] == ["y"]


def test_glob():
    import re

    fits = lambda g, p: bool(re.match(glob_pattern(g), p))
    assert fits("/en/*", "/en/a") and not fits("/en/*", "/en/a/b") and fits("/en/**", "/en/a/b") and not fits("/en/?", "/en/ab")


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "s.db")
    with sqlite3.connect(path) as db:
        db.execute("create table session (id text, time_updated integer, cost real)")
        db.executemany("insert into session values (?, ?, ?)", [(f"s{i}", i, i / 2) for i in range(100)])
    spark.dataSource.register(sqlite.SqliteSource)
    df = spark.read.format("sqlite").option("path", path).option("table", "session").option("partitions", "3").load()
    assert df.where(F.col("time_updated") >= 90).count() == 10
    narrow = spark.read.format("sqlite").schema("cost double").option("path", path).option("table", "session").load()
    assert narrow.columns == ["cost"] and narrow.agg(F.sum("cost")).first()[0] == 2475.0


def test_history(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-08"):
        report.write_json_atomic({"cost": 1.5}, tmp_path / f"weekly-{day}.json")
    assert files.history(spark, f"{tmp_path}/weekly-*.json", "2024-01-08").count() == 1


def test_report_is_deterministic_and_escaped(tmp_path):
    doc = {"period": {"start": "a", "end": "b"}, "by_model": [{"model": "</script>", "cost": 1}], "daily_totals": [{"day": "d", "cost": 2}]}
    assert "</script>" not in report.page(doc).split('id="data">')[1].removesuffix("</script>\n")
    made = report.run_directory(tmp_path, "2024-01-29")
    assert (tmp_path / "runs/current").resolve() == made.resolve()
    assert report.prose_problems("one 2") == ["too short", "has digits"]


BASE = datetime(2024, 1, 29, 6)


def store(spark, folder, events, **tables):
    """A folder with events (hours before the run's end, user, type, value, k) and other tables."""
    rows = [(i, BASE - timedelta(hours=h), u, kind, v, '{"k": %d}' % k) for i, (h, u, kind, v, k) in enumerate(events, 1)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def rows(spark, folder, name, config=Config()):
    return [r.asDict() for r in catalog.queries(config)[name](spark, folder).collect()]


def test_dearer_day_after_equal_ones_has_the_cap_and_a_note(spark, tmp_path):
    folder = store(spark, tmp_path, [(24 * d + 1, 10, "view", 5.0, 1) for d in range(8, 30)] + [(25, 10, "view", 9.0, 1), (49, 10, "view", 5.0, 1)])
    got = {r["cost"]: (r["z"], r["note"]) for r in rows(spark, folder, "daily_spike")}
    assert got == {9.0: (10.0, "no spread before"), 5.0: (None, None)}
    assert rows(spark, folder, "alert_daily_spike")[0] == {"rule": "daily_spike", "severity": "medium", "threshold": 3.0, "observed": 10.0, "fired": True}


def test_windows_of_other_hours_have_no_volume_deltas(spark, tmp_path):
    folder = store(spark, tmp_path, [(h, 10, kind, 2.0, 3) for h in range(1, 700, 5) for kind in ("view", "click")])
    same = rows(spark, folder, "window_hours_guard")[0]
    other = rows(spark, folder, "window_hours_guard", Config(run_hours=(336, 360)))[0]
    assert not same["warn"] and same["cost_pct"] is not None
    assert other["warn"] and other["cost_pct"] is None and other["tokens_pct"] is None and abs(other["hit_rate_diff"]) < 0.01
    assert not rows(spark, folder, "alert_cost_wow", Config(run_hours=(336, 360), cost_wow_pct=-1.0))[0]["fired"]
    first = rows(spark, folder, "wow_delta", Config(run_hours=(168,)))
    assert first[0]["cost_pct"] is None


def test_silent_runs_overlap_and_snooze(spark, tmp_path):
    part = [(i, "n", "B", "T", 1 if i < 3 else i, 1.0) for i in range(6)]
    month = {0: 9, 1: 8, 2: 8, 3: 8, 4: 12, 5: 8}  # last load in 1999: 9 is silent on three runs, 8 on four
    items = [(1, p, 1, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", datetime(1999, m, 5)) for p, m in month.items()]
    folder = store(spark, tmp_path, [], part=(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"), lineitem=(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"))
    config = Config(ignored_findings=("retire:5",))
    assert {r["skill"]: r["streak"] for r in rows(spark, folder, "r1_retire", config)} == {1: 4, 2: 4, 3: 4}
    assert {r["skill"] for r in rows(spark, folder, "r2_retire_high", config)} == {1, 2}


def test_compaction_keeps_first_marker_last(spark, tmp_path):
    calls = [(9 - i, 10, "view", 1.0, 60 + i) for i in range(5)] + [(3, 10, "view", 1.0, 10), (2, 10, "click", 1.0, 10), (1, 10, "click", 1.0, 11)]
    got = sorted(rows(spark, store(spark, tmp_path, calls), "compact_repeats"), key=lambda r: r["event_id"])
    assert [(r["event_id"], r["kind"], r["replaced"]) for r in got] == [(1, "call", 0), (2, "marker", 3), (5, "call", 0), (6, "call", 0), (7, "call", 0), (8, "call", 0)]


def test_empty_window_gives_a_whole_document(spark, tmp_path):
    folder = store(spark, tmp_path / "data", [(1000, 10, "view", 1.0, 1)])
    assert rows(spark, folder, "totals")[0]["session_count"] == 0 and rows(spark, folder, "cost_outliers") == []
    assert rows(spark, folder, "audit_priority") == []


def test_ranked_over_ranges(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 500).alias("x"))
    got = [(r.place, r.id) for r in robust.ranked(df, F.desc("x"), F.asc("id")).orderBy("place").collect()]
    assert got == list(enumerate([r[1] for r in sorted((-(i * 7919 % 500), i) for i in range(1000))], 1))
    assert robust.ranked(df.limit(0), F.desc("x")).count() == 0


def test_functions(spark):
    from usagelens.functions.text import counters, from_millis, to_iso

    df = spark.createDataFrame([("b", 2), ("a", 1)], "n string, c long")
    assert list(df.agg(counters("n", "c").alias("m")).first().m.items()) == [("a", 1), ("b", 2)]
    r = spark.createDataFrame([(1706508000000,)], "ms long").select(from_millis("ms").alias("t")).select(to_iso("t").alias("i")).first()
    assert r.i == "2024-01-29T06:00:00Z"


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"top_sessions": 3, "keywords": ["x"]}')
    c = Config.read(str(tmp_path / "c.json"), "2024-01-22T06:00:00Z", 14)
    assert (c.top_sessions, c.keywords, c.start, c.runs[0]) == (3, ("x",), "2024-01-08 06:00:00", ("2024-01-08 06:00:00", "2024-01-22 06:00:00", 336))
    for bad in ({"lookback_days": 0},):
        with pytest.raises(ValueError):
            Config.read(**bad)
    (tmp_path / "c.json").write_text('{"no_such": 3}')
    with pytest.raises(ValueError):
        Config.read(str(tmp_path / "c.json"))


def test_cli(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    run = lambda *a: cli.main([*a, "--data", SF, "--out", str(tmp_path)])
    assert run("run", "--anchor", "2024-01-22T06:00:00Z") == 0 and run("run") == 0
    made = json.loads((tmp_path / "runs/current/summary.json").read_text())
    assert made["period"]["end"] == "2024-01-29 06:00:00" and made["deltas"]["cost_pct"] is not None
    assert run("run", "--lookback-days", "14") == 2 and run("run", "--lookback-days", "14", "--force") == 1
    for command in cli.COMMANDS:
        # The run before had another window, which the insights warn of.
        assert run(command) == (1 if command == "insights" else 0) and (tmp_path / f"runs/current/{command}.json").exists()
    found = json.loads((tmp_path / "runs/current/insights.json").read_text())
    assert found["previous_run_date"] == "2024-01-22" and found["deltas"]["cost_wow_pct"] is None and found["deltas"]["lint_violations_delta_by_rule"] is not None
    assert run("report-assemble") == 0 and run("doctor") == 0 and run("list") == 0
    capsys.readouterr()
    assert run("show-session", "10", "--include-children") == 0 and "child" in capsys.readouterr().out
    assert run("query", "by_model") == 0 and run("query", "no_such") == 2
    (tmp_path / "w.json").write_text(json.dumps({"declared": ["Tool X"], "decisions": [{"identity": "tool x", "decision": "adopt", "reason": "r"}, {"identity": "y", "decision": "adopt", "reason": "r"}]}))
    capsys.readouterr()
    assert run("watch-validate", "--file", str(tmp_path / "w.json")) == 1
    assert json.loads(capsys.readouterr().out) == [["declared already: verify, improve or repair"], []]
    (tmp_path / "draft.md").write_text("---\nname: a-b\n---\n")
    assert cli.main(["draft-validate", "--file", str(tmp_path / "draft.md")]) == 1 and "missing description" in capsys.readouterr().out
    assert cli.main(["draft-validate", "--file", str(tmp_path / "draft.md"), "--kind", "command"]) == 1 and "empty body" in capsys.readouterr().out
    (tmp_path / "q.json").write_text(json.dumps({"session_id": 1, "category": "loop", "severity": "low", "recommendation_type": "habit", "evidence": "e"}))
    assert cli.main(["findings-validate", "--file", str(tmp_path / "q.json")]) == 0


def test_remediation_is_gated_tried_and_all_or_nothing(tmp_path, capsys):
    from usagelens.plans import remediate

    root, out = tmp_path / "root", tmp_path / "out"
    files = {f"skills/{n}/SKILL.md": f"---\nname: {n}\n---\nbad {n}\n" for n in "abc"} | {"commands/d.md": "bad d bad d\n", "agents/e.md": "bad e\n"}
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    change = lambda name, rule="format/x", **more: {"file": name, "rule": rule, "old": f"bad {name.split('/')[1][0]}", "new": "good", "confidence": "high"} | more
    three = [change(f"skills/{n}/SKILL.md") for n in "abc"]
    text = lambda: {n: (root / n).read_text() for n in files}
    config = Config(auto_fix_rules=("format/x", "security/y"))
    status = lambda changes, c=config, **more: [r["status"] for r in remediate.remediate(changes, root, out, c, **more)["results"]]
    assert status(three, Config(), apply=True) == ["manual"] * 3 and text() == files  # nothing by default
    odd = [change("skills/a/SKILL.md", "security/y"), change("agents/e.md"), change("../out.md", old="x"), change("commands/d.md"), change("skills/a/SKILL.md", confidence="medium"), change("skills/a/SKILL.md", old=""), change("skills/gone.md", old="x")]
    assert status(odd, apply=True) == ["blocked", "blocked", "blocked", "manual", "manual", "blocked", "blocked"] and text() == files
    assert status(three) == ["proposed"] * 3 and text() == files
    assert status(three, Config(auto_fix_rules=("format/x",), auto_fix_max_files=2)) == ["proposed", "proposed", "manual"]
    # A head that breaks fails on the copy; a file that can't be replaced puts the first two back.
    broken = [*three[:2], change("skills/c/SKILL.md", old="---\nname: c\n---\n", new="")]
    assert status(broken, apply=True) == ["rolled_back"] * 3 and text() == files

    def fails(path, body, real=remediate.replace):
        if path.parent.name == "c" and "good" in body:
            raise OSError("disk full")
        real(path, body)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(remediate, "replace", fails)
        assert status(three, apply=True) == ["rolled_back"] * 3 and text() == files and not (out / remediate.JOURNAL).exists()
    # A run that was killed leaves its journal; the next one puts its files back first, but for one that others changed.
    x = {n: {"before": remediate.digest(files[n]), "after": remediate.digest("half done"), "text": files[n]} for n in files}
    report.write_json_atomic({"files": {str(root / n): x[n] for n in files}}, out / remediate.JOURNAL)
    (root / "skills/a/SKILL.md").write_text("half done")
    (root / "agents/e.md").write_text("someone else's")
    done = remediate.remediate(three, root, out, config, apply=True)
    assert [r["status"] for r in done["results"]] == ["applied"] * 3 and "agents/e.md" in done["warnings"][0]
    assert text() == files | {f"skills/{n}/SKILL.md": f"---\nname: {n}\n---\ngood\n" for n in "abc"} | {"agents/e.md": "someone else's"}
    (tmp_path / "c.json").write_text(json.dumps({"auto_fix_rules": ["format/x"]}))
    (tmp_path / "f.json").write_text(json.dumps([change("skills/a/SKILL.md", old="good", new="better")]))
    call = lambda mode: cli.main(["harness-remediate", "--file", str(tmp_path / "f.json"), "--data", str(root), "--out", str(out), "--config", str(tmp_path / "c.json"), "--mode", mode])
    assert call("dry-run") == 0 and "good" in text()["skills/a/SKILL.md"] and call("apply") == 0 and "better" in text()["skills/a/SKILL.md"]
    assert json.loads((out / "remediation.json").read_text())["results"][0]["status"] == "applied"


def test_validators():
    good = {"session_id": 1, "category": "loop", "severity": "low", "recommendation_type": "habit", "evidence": "e"}
    assert validators.quality_finding(good) == [] and validators.quality_finding(good | {"severity": "dire", "evidence": ""}) == ["missing evidence", "unknown severity: dire"]
    assert [x["severity"] for x in validators.routed([good, good | {"severity": "high"}, good | {"category": "?"}])["report"]] == ["high", "low"]
    assert validators.draft("---\nname: a-b\ndescription: d\n---\nbody", "skill", {"c"}) == []
    assert validators.draft("---\nname: A b\n---\n", "skill", {"a b"}) == ["missing description", "name isn't in kebab case", "overlaps one that exists", "empty body"]
    assert validators.coherence_finding({"category": "unused", "tag": "skill", "impact": "low", "target": "t"}) == []
    assert validators.digest("nonsense") == ({}, ["digest isn't an object"])
    assert validators.digest({"budget": {}, "triggers": 3})[1] == ["triggers isn't of the expected form", "no dependencies", "no findings", "no metadata"]
    assert [b["title"] for b in validators.prose_order([{"title": "b", "severity": "low"}, {"title": "a", "severity": "high"}])] == ["a", "b"]


def test_external(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    git("init", "-q")
    for m in ("[auto-draft] one", "other\n\n[auto-draft] in the body"):
        git("commit", "-q", "--allow-empty", "-m", m)
    assert [r.subject for r in external.git_log(spark, str(tmp_path), "2000-01-01", "2090-01-01").collect()] == ["[auto-draft] one"]
    pages = spark.createDataFrame([("s", '<a href="u1"> <a href="u2"> <link>u3</link> [n](https://x/y)')], "source string, html string")
    assert {r.link for r in external.links(pages).collect()} == {"u1", "u2"} and [r.link for r in external.links(pages, "rss").collect()] == ["u3"] and [r.link for r in external.links(pages, "list").collect()] == ["https://x/y"]
    snap = str(tmp_path / "snap")
    now = lambda *x: spark.createDataFrame([("s", i) for i in x], "source string, link string")
    assert external.watched(spark, now("a"), snap).count() == 0  # the first run is silent
    assert [r.link for r in external.watched(spark, now("a", "b"), snap).collect()] == ["b"]
    assert external.watched(spark, now("a", "b"), snap).count() == 0
    assert external.watch_sources({"watch_sources": [{"type": "web", "url": "w"}], "watch_repos": ["r"]}) == [{"type": "repo", "url": "r"}, {"type": "web", "url": "w"}]
    root = tmp_path / "root"
    for f in ("skills/a.md", "notes/b.md", "node_modules/c.md"):
        (root / f).parent.mkdir(parents=True, exist_ok=True)
        (root / f).write_text("x")
    assert external.projected(root, tmp_path / "to", ("skills/**",)) == (["skills/a.md"], ["notes/b.md"]) and (tmp_path / "to/skills/a.md").exists()


def test_history_keeps_one_partition_a_date(spark, tmp_path):
    summary = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-08", 2.0)], "run_date string, cost double")
    files.append_history(summary, str(tmp_path / "h"))
    files.append_history(summary.where("run_date = '2024-01-08'").withColumn("cost", F.lit(3.0)), str(tmp_path / "h"))
    assert {(str(r.run_date), r.cost) for r in spark.read.parquet(str(tmp_path / "h")).collect()} == {("2024-01-01", 1.0), ("2024-01-08", 3.0)}


def test_missing_store_is_not_made(tmp_path):
    with pytest.raises(FileNotFoundError):
        sqlite.opened(str(tmp_path / "gone.db"))
    assert not (tmp_path / "gone.db").exists() and type(sqlite.kind("BIGINT")).__name__ == "LongType"
