"""Session stores of each shape: one summary, drift, push-down, transcripts, history and insights, against hand-made values."""

import json
import sqlite3
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from usagelens import cli
from usagelens.config import Config
from usagelens.plans import weekly
from usagelens.plans.history import History, insights
from usagelens.sources import adapters, sqlite
from usagelens.sources.catalog_files import head_fields, markdown_catalog

ANCHOR = datetime(2024, 1, 29, 6, tzinfo=timezone.utc)
SHAPES = ("v1", "v1-live", "v1-dual", "v2")
LONG = "please look at every failing test of the suite and tell me what has to change before we can ship it today"
SESSION = "id text, parent_id text, title text, model text, agent text, directory text, cost real, tokens_input integer, time_created integer, time_updated integer"


def ms(hours: float, seconds: float = 0, anchor: datetime = ANCHOR) -> int:
    return round((anchor - timedelta(hours=hours) + timedelta(seconds=seconds)).timestamp() * 1000)


def sessions(anchor=ANCHOR):
    model = json.dumps({"id": "m", "providerID": "p", "variant": None})
    row = lambda id, parent, title, updated, cost=0.0, model=model, agent=None: (id, parent, title, model, agent, "/repo", cost, 0, ms(100, 0, anchor), ms(updated, 0, anchor))
    return [
        row("s1", None, "first", 20, 3.0), row("s1c", "s1", "child", 20, 4.0, agent="docs"), row("s1cc", "s1c", "grandchild", 20, 0.5, agent="docs"),
        row("s2", None, None, 30, 9.0, model=None), row("lost", "gone", "orphan", 30, 1.0, agent="qa"), row("busy", None, "still on", 5 / 60, 7.0),
        row("self", None, "session 7", 40, 5.0), row("old", None, "old", 300, 5.0), row("bare", None, "no parts", 50),
    ]


def step(cost, read=0, fresh=0, out=0, reasoning=0, write=0):
    return {"type": "step-finish", "tokens": {"input": fresh, "output": out, "reasoning": reasoning, "cache": {"read": read, "write": write}}} | ({} if cost is None else {"cost": cost})


def call(tool, args, output=None, error=None):
    return {"type": "tool", "tool": tool, "state": {"input": args} | ({"output": output} if error is None else {"error": error, "status": "error"})}


def parts(anchor=ANCHOR):
    """(session, role, ms, payload)"""
    at = lambda h, s=0: ms(h, s, anchor)
    out = [("s1", "assistant", at(48), step(1.0, 60, 40, 10)), ("s1", "assistant", at(48, 100), step(2.0, 20, 20, 5)), ("s1", "assistant", at(48, 400), step(0.0, 0, 0, 1))]
    out += [("s1c", "assistant", at(47), step(4.0, 10, 50, 1)), ("s1cc", "assistant", at(46), step(0.5, write=7))]
    out += [("s2", "assistant", at(24), step(None, 30, 30)), ("s2", "assistant", at(23), step(2.5, reasoning=4)), ("s2", "assistant", at(22), "not json {")]
    out += [("lost", "assistant", at(24), step(1.0)), ("busy", "assistant", at(1), step(7.0)), ("self", "assistant", at(41), step(5.0)), ("s1", "assistant", at(200), step(50.0))]  # the last is before the window
    out += [("s1", "user", at(48, -30 + i), {"type": "text", "text": LONG + "!" * i}) for i in range(3)]
    out += [("s1", "user", at(47, 30), {"type": "text", "text": "/fix all of it"}), ("s2", "user", at(24, -9), {"type": "text", "text": "/fix"}), ("s2", "assistant", at(24, -8), {"type": "text", "text": "/no command"})]
    out += [("s1", "assistant", at(47, i), call("bash", {"cmd": "make  Test"}, error="Failed: 1")) for i in range(5)]
    out += [("s1", "assistant", at(47, 8), call("skill", {"name": "deploy"}, "loaded")), ("s1c", "assistant", at(47, 9), call("skill", {"name": "deploy"}, "loaded")), ("s2", "assistant", at(24, 1), call("read", {"path": "f"}, "x" * 40))]
    return out + [("s2", "assistant", at(24, 2), {"type": "reasoning", "text": "y" * 9})]


def made(path, shape, anchor=ANCHOR, change=lambda rows: rows):
    db = sqlite3.connect(path)
    tables = {"v1": ["session_v2"], "v1-live": ["session"], "v1-dual": ["session", "session_v2"], "v2": ["session"]}[shape]
    for t in tables:
        db.execute(f"create table {t} ({SESSION})")
    for i, row in enumerate(sessions(anchor)):
        db.execute(f"insert into {tables[i % len(tables)]} values ({','.join('?' * 10)})", row)
    if shape == "v1-dual":  # an older copy of a session in the other table
        db.execute(f"insert into session_v2 values ({','.join('?' * 10)})", ("s1", "gone", "stale", None, "x", "/x", 99.0, 0, 0, ms(60, 0, anchor)))
    rows = change(parts(anchor))
    if shape == "v2":
        db.execute("create table event (id text, session_id text, type text, time_created integer, payload text)")
        db.execute("create table session_message (id text, session_id text, type text, time_created integer, data text)")
        kinds = {v: k for k, v in adapters.KINDS.items()}
        for i, (s, role, t, p) in enumerate(rows):
            kind = p["type"] if isinstance(p, dict) else "step-finish"
            if kind in kinds:
                db.execute("insert into event values (?,?,?,?,?)", (f"e{i:03d}", s, kinds[kind], t, json.dumps(p) if isinstance(p, dict) else p))
            elif role == "user":
                db.execute("insert into session_message values (?,?,?,?,?)", (f"e{i:03d}", s, "user", t, json.dumps({"text": p["text"]})))
            else:
                db.execute("insert into session_message values (?,?,?,?,?)", (f"e{i:03d}", s, "assistant", t, json.dumps({"content": [{"type": "reasoning", "text": "told by an event"}, p]})))
    else:
        db.execute("create table migration (id integer)")
        db.executemany("insert into migration values (?)", [(i,) for i in range(42)])
        db.execute("create table message (id text, session_id text, data text)")
        db.execute("create table part (id text, message_id text, session_id text, time_created integer, data text)")
        for i, (s, role, t, p) in enumerate(rows):
            db.execute("insert into message values (?,?,?)", (f"m{i}", s, json.dumps({"role": role})))
            db.execute("insert into part values (?,?,?,?,?)", (f"e{i:03d}", f"m{i}", s, t, json.dumps(p) if isinstance(p, dict) else p))
    db.commit()
    db.close()
    return str(path)


@pytest.fixture(scope="module")
def skills(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("skills")
    body = "\nRun the release script, then watch the dashboards for half an hour and roll back when errors rise.\n"
    files = {"deploy": "name: deploy\ndescription: Deploys the service", "deploy-staging": "description: Deploys the service.", "notes": "name: notes\ndescription: >\n  Takes notes\n  of calls\nmetadata:\n  owner: me"}
    for name, head in files.items():
        (root / name).mkdir()
        (root / name / "SKILL.md").write_text(f"---\n{head}\n---\n{body if name != 'notes' else 'Write down who said what.'}")
    (root / "bad").mkdir()
    (root / "bad" / "SKILL.md").write_text("---\nname: bad\n")
    return f"{root}/*/SKILL.md"


@pytest.mark.parametrize("shape", SHAPES)
def test_one_summary_for_each_shape(spark, tmp_path, skills, shape):
    path = made(tmp_path / "s.db", shape)
    v = adapters.StoreViews(spark, path, Config())
    assert v.adapter.name == shape
    d = weekly.summary(v, markdown_catalog(spark, skills))
    assert d["totals"] == [{"session_count": 2, "tokens": 60 + 40 + 10 + 20 + 20 + 5 + 1 + 10 + 50 + 1 + 7 + 60 + 4, "cost": 11.0, "cache_read": 120, "cache_write": 7, "fresh_input": 140, "output": 17, "reasoning": 4, "hit_rate": round(120 / 260, 6)}]
    assert {r["model"]: (r["session_count"], r["cost"]) for r in d["by_model"]} == {"p/m": (4, 8.5), "unknown": (1, 2.5)}
    assert [(r["day"], r["cost"]) for r in d["daily_totals"]] == [("2024-01-27", 7.5), ("2024-01-28", 3.5)]
    top = {r["session_id"]: r for r in d["top_sessions"]}
    assert list(top) == ["s1", "s2"]
    assert {k: top["s1"][k] for k in ("title", "project", "cost", "api_call_count", "includes_subagents", "duration_seconds", "active_seconds", "cost_per_active_minute", "text_tokens")} == {"title": "first", "project": "/repo", "cost": 7.5, "api_call_count": 5, "includes_subagents": True, "duration_seconds": 7200, "active_seconds": 100, "cost_per_active_minute": 4.5, "text_tokens": (3 * len(LONG) + 3 + 14) // 4}
    assert top["s2"]["file_tokens"] == 10 and top["s2"]["reasoning_tokens"] == 2 and top["s2"]["active_seconds"] == 0 and top["s2"]["cost_per_active_minute"] is None
    assert {r["tool"]: r["calls"] for r in d["tool_usage"]} == {"bash": 5, "read": 1, "skill": 2}
    assert d["skill_usage"] == [{"skill": "deploy", "load_count": 2, "sessions_used_in": 2}]
    assert d["command_usage"] == [{"command": "fix", "call_count": 2, "sessions_used_in": 2}]
    assert d["user_prompt_repeats"] == [{"normalized_preview": LONG[:80], "count": 3, "session_id": "s1", "avg_chars": len(LONG) + 1.0}]
    assert [(r["agent"], r["session_count"], r["cost"]) for r in d["subagent_totals"]] == [("docs", 2, 4.5), ("qa", 1, 1.0)]
    assert d["skill_catalog_count"] == [{"skill_catalog_count": 4}] and [r["skill"] for r in d["skills_never_loaded"]] == ["bad", "deploy-staging", "notes"]
    assert [(r["first"], r["second"]) for r in d["skill_similar_pairs"]] == [("deploy", "deploy-staging")]
    said = {(w["session_id"], w["message"]) for w in d["warnings"]}
    assert {("busy", "active session left out"), ("s2", "missing-pricing:unknown, steps: 1"), ("s2", "unreadable parts: 1"), ("s2", "steps and the stored cost differ"), ("bare", "unflushed: no parts are stored"), ("lost", "child without a root"), (None, "few sessions for outliers: 5")} <= said
    assert len(said) == 8 and any("isn't closed" in m for _, m in said)
    assert d["store"] == shape and d["audit_counts"] == [{"counted": 2, "counted_all": 5, "merged_children": 3}]


def test_filters_and_columns_reach_sqlite(spark, tmp_path):
    path = made(tmp_path / "s.db", "v1-dual")
    v = adapters.StoreViews(spark, path, Config())
    plan = v["payloads"]._jdf.queryExecution().executedPlan().toString()
    assert "time_created" in plan and "Filter" not in plan.replace("RuntimeFilters", "")  # nothing is left to Spark
    reader = sqlite.SqliteSource({"path": path, "table": "part"}).reader(v.raw("part", "id", "time_created").schema)
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThanOrEqual, StringContains

    left = list(reader.pushFilters([GreaterThanOrEqual(("time_created",), v.since), LessThanOrEqual(("time_created",), v.until), StringContains(("id",), "e")]))
    asked, values = reader.statement(reader.partitions()[0])
    assert asked == 'select "id", "time_created" from "part" where rowid >= ? and rowid < ? and "time_created" >= ? and "time_created" <= ?' and values[2:] == [v.since, v.until] and len(left) == 1


def test_drift_stops_a_run_and_the_live_store_counts(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)
    drifted = made(tmp_path / "d.db", "v1-live")
    with sqlite3.connect(drifted) as db:
        db.execute("alter table part rename column time_created to made_at")
    with pytest.raises(adapters.SchemaDrift, match="v1-live: part: no time_created"):
        adapters.detected(drifted)
    few = made(tmp_path / "f.db", "v1-live")
    with sqlite3.connect(few) as db:
        db.execute("delete from migration where id > 5")
    (tmp_path / "text.db").write_text("no database at all, but long enough to be read as one")
    for bad in (drifted, few, str(tmp_path / "none.db"), str(tmp_path / "text.db")):
        with pytest.raises(adapters.SchemaDrift):
            adapters.live([bad])
        assert cli.main(["run", "--store", bad, "--out", str(tmp_path / "out")]) == 2 and cli.main(["doctor", "--store", bad]) == 2
    assert adapters.detected(few, {}).name == "v1-live" and not (tmp_path / "out").exists()
    older, newer = made(tmp_path / "a.db", "v2", ANCHOR - timedelta(days=3)), made(tmp_path / "b.db", "v1")
    path, adapter = adapters.live([older, drifted, newer, str(tmp_path / "none.db")])
    assert (path, adapter.name) == (newer, "v1")
    capsys.readouterr()
    assert cli.main(["doctor", "--store", older, newer]) == 0 and "v1" in capsys.readouterr().out


def test_two_weekly_runs_and_their_insights(spark, tmp_path, skills, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)
    out = tmp_path / "out"
    twice = lambda rows: [(s, r, t, p | {"cost": 2 * p["cost"]} if isinstance(p, dict) and p.get("cost") else p) for s, r, t, p in rows if not (isinstance(p, dict) and p.get("tool") == "skill")]
    for back, change in ((7, lambda rows: rows), (0, twice)):
        anchor = ANCHOR - timedelta(days=back)
        store = made(tmp_path / f"{back}.db", "v1-dual", anchor, change)
        assert cli.main(["run", "--store", store, "--skills", skills, "--out", str(out), "--anchor", anchor.isoformat()]) == 0
    document = json.loads((out / "runs/current/summary.json").read_text())
    assert document["totals"][0]["cost"] == 22.0 and document["deltas"]["cost_pct"] == 1.0
    report = (out / "runs/current/report.md").read_text()
    assert "## skills never loaded" in report and "Alerts" not in report and "| deploy |" in report
    assert cli.main(["insights", "--out", str(out), "--anchor", ANCHOR.isoformat()]) == 1  # no digest
    found = json.loads((out / "runs/current/insights.json").read_text())
    assert found["previous_run_date"] == "2024-01-22"
    assert found["deltas"] == {"cost_wow_pct": 100.0, "total_tokens_delta_pct": 0.0, "cache_hit_rate_delta": 0.0, "_warnings": ["no digest: lint isn't compared"], "skills": {"newly_loaded": [], "newly_silent": ["deploy"]}, "lint_violations_delta_by_rule": None}
    assert {a["rule"]: a["observed"] for a in found["alerts"]} == {"cost_wow_pct_max": 100.0, "cache_hit_rate_min": round(120 / 260, 6), "daily_spike_z_min": round((15.0 - 5.5) / (1.4826 * 2.0), 6)}
    assert found["maintenance"]["stats"] == {"runs_scanned": 2, "skills_in_catalog": 4, "never_loaded_consecutive": {"bad": 2, "deploy": 1, "deploy-staging": 2, "notes": 2}, "spike_baseline_days": 2}
    assert [f["category"] for f in found["maintenance"]["findings"]] == ["merge-candidate"]
    capsys.readouterr()
    assert cli.main(["show-session", "s1", "--store", str(tmp_path / "7.db"), "--anchor", (ANCHOR - timedelta(days=7)).isoformat(), "--include-children"]) == 0
    said = capsys.readouterr().out
    assert "[... 3 similar calls ...]" in said and said.count("make  Test") == 2 and LONG + "!!" in said and "child s1c skill" in said
    assert cli.main(["insights", "--out", str(out), "--anchor", "2024-02-05T06:00:00Z"]) == 2


def test_a_digest_gives_lint_deltas_and_overlaps(spark, tmp_path, skills, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    out, store = tmp_path / "out", made(tmp_path / "s.db", "v1-live")
    sections = {"budget": {}, "triggers": [], "dependencies": [], "metadata": {}}
    for back, rules in ((7, ["a", "trigger-overlap"]), (0, ["a", "a", "b", "trigger-overlap"])):
        (tmp_path / f"{back}.json").write_text(json.dumps(sections | {"findings": [{"rule": r, "target": "notes"} for r in rules] + ["odd"]}))
        at = (ANCHOR - timedelta(days=back)).isoformat()
        assert cli.main(["run", "--store", store, "--skills", skills, "--digest", str(tmp_path / f"{back}.json"), "--out", str(out), "--anchor", at, "--migrations", "0"]) == 0
    (tmp_path / "c.json").write_text(json.dumps({"silent_runs": 2, "lint_max": 3}))
    assert cli.main(["insights", "--out", str(out), "--anchor", ANCHOR.isoformat(), "--digest", str(tmp_path / "0.json"), "--config", str(tmp_path / "c.json")]) == 0
    found = json.loads((out / "runs/current/insights.json").read_text())
    assert found["deltas"]["lint_violations_delta_by_rule"] == {"a": 1, "b": 1, "trigger-overlap": 0}
    assert {"rule": "lint_violations_max", "threshold": 3, "observed": 4, "severity": "medium"} in found["alerts"]
    assert {f["target"]: f["severity"] for f in found["maintenance"]["findings"] if f["category"] == "retire-candidate"}["notes"] == "high"
    (tmp_path / "bad.json").write_text("[]")
    assert cli.main(["run", "--store", store, "--digest", str(tmp_path / "bad.json"), "--out", str(out), "--anchor", ANCHOR.isoformat(), "--migrations", "0"]) == 1


def test_history_prunes_and_the_last_run_of_a_date_wins(spark, tmp_path):
    h = History(spark, str(tmp_path))
    assert h.dates("2024-01-01", 5) == []

    def run(day, cost, hours=168, skills=(), days=(), tokens=10):
        rows = lambda x, s: spark.createDataFrame(list(x), s)
        h.write(day, {"totals": rows([("a", "b", hours, cost, tokens, 0.5, 1)], "start string, end string, hours int, cost double, tokens long, hit_rate double, session_count long"), "skills": rows(skills, "skill string, loaded boolean"), "days": rows(days, "day string, cost double")})

    silent = lambda n: [("x", False), ("y", n == 0), ("z", True)]
    for i, day in enumerate(("2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22")):
        run(day, 10.0, skills=silent(i), days=[(f"{day[:8]}{int(day[8:]) - 1:02d}", 5.0)])
    run("2024-01-29", 99.0, 336, skills=[("q", False)])
    run("2024-01-29", 30.0, 360, skills=silent(4), days=[("2024-01-28", 9.0)])
    assert h.dates("2024-01-29", 2) == ["2024-01-22", "2024-01-15"] and h.dates("2024-01-29", 9, before=False)[0] == "2024-01-29"
    scan = h.of("days", ["2024-01-22"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_date" in scan or "PartitionFilters: [(run_date" in scan
    got = insights(h, Config(monthly_budget=79.0, weekly_budget=29.0), spark.createDataFrame([("x",)], "skill string"))
    assert got["deltas"]["cost_wow_pct"] is None and got["deltas"]["cache_hit_rate_delta"] == 0.0 and "360 h" in got["deltas"]["_warnings"][0]
    assert {(a["rule"], a["observed"], a.get("note")) for a in got["alerts"]} == {("weekly_budget_usd", 30.0, None), ("daily_spike_z_min", 10.0, "MAD near 0, z capped"), ("cache_hit_rate_min", 0.5, None)}
    assert {(f["target"], f["severity"]) for f in got["maintenance"]["findings"]} == {("x", "high"), ("y", "medium")}
    assert got["maintenance"]["stats"]["never_loaded_consecutive"] == {"x": 5, "y": 4}
    run("2024-01-29", None, skills=(), tokens=None)  # now without skills, as a whole
    assert h.of("skills", ["2024-01-29"]).count() == 0
    first = insights(h, Config(run_time="2024-01-01 06:00:00"))
    assert first["deltas"]["cost_wow_pct"] is None and first["previous_run_date"] is None and first["maintenance"]["findings"] == []
    with pytest.raises(LookupError):
        insights(h, Config(run_time="2024-01-02 06:00:00"))


def test_heads_of_files():
    lines = 'name: x\ndescription: |\n  two\n    lines\n\nmetadata:\n  owner: "me: too"\n  tags:\n    - a\n    - b\nmodels:\n- m\nlong: goes\n  on\n# remark\nno field here\n\tt: 1'.split("\n")
    assert head_fields(lines) == ({"name": "x", "description": "two\n  lines", "metadata.owner": "me: too", "metadata.tags": "a, b", "models": "m", "long": "goes on"}, ["line 16: no field", "line 17: tab"])


def test_catalog_names_and_repeats(spark, skills, tmp_path):
    got = {r.name: (r.description, r.warning) for r in markdown_catalog(spark, skills).collect()}
    assert got == {"deploy": ("Deploys the service", None), "deploy-staging": ("Deploys the service.", None), "notes": ("Takes notes of calls", None), "bad": (None, "front matter isn't closed")}
    (tmp_path / "a.md").write_text("---\nname: same\n---\nfirst")
    (tmp_path / "b.md").write_text("---\nname: same\n---\nsecond")
    (tmp_path / "c.md").write_text("plain")
    assert {r.name: r.body for r in markdown_catalog(spark, f"{tmp_path}/*.md").select("name", F.col("body")).collect()} == {"same": "first", "c": "plain"}
