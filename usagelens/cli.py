"""Command line over a folder of tables.

Exit codes: 0 done, 1 degraded, 2 failed. ``run`` writes a summary, its report and page to a run folder, compares it with the one before and
keeps what later runs need under ``history``; ``insights`` draws on that. With ``--store`` sessions come from SQLite files, of which the live one
counts; else from a folder of tables. The other commands write what they find to a file named after them in the current run folder, and print where.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.config import Config
from usagelens.plans import catalog, coherence, remediate, report, validators, weekly
from usagelens.plans.history import History, insights
from usagelens.sources import adapters, external, feeds
from usagelens.sources.catalog_files import markdown_catalog
from usagelens.sources.proxy import TABLES

#: Commands that gather queries.
COMMANDS = {
    "insights": ["alerts", "wow_delta", "window_hours_guard", "r1_retire", "r2_retire_high", "r4_fix", "r5_rewrite", "insight_stats"],
    "audit-candidates": ["audit_priority"],
    "self-cost": ["self_cost"],
    "releases": ["release_relevance", "released_in_window", "registry_status_filter", "counts_by_category", "counts_by_source"],
    "watch-context": ["watch_crosswalk", "link_diff", "notable_items"],
    "harness": ["harness_projection", "lint_by_rule"],
    "draft-candidates": ["draft_cap", "findings_routing"],
    "report-prep": ["findings_by_severity", "category_distribution", "stage_status"],
    "commit-draft": ["commit_list_truncate", "pending_review_count"],
}
#: Commands that judge a JSON file.
FILES = ("watch-validate", "harness-remediate", "report-blocks-draft", "findings-validate", "draft-validate")


def session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="usagelens", description=__doc__)
    p.add_argument("command", choices=["run", "doctor", "query", "list", "show-session", "report-assemble", "coherence", *COMMANDS, *FILES])
    p.add_argument("name", nargs="?", help="query to run, or id to show")
    p.add_argument("--data", help="folder of the parquet tables")
    p.add_argument("--store", nargs="+", help="session stores; the one of the latest update counts")
    p.add_argument("--migrations", type=int, help="migrations that a store must have, at least")
    p.add_argument("--digest", help="run, insights: a linter's digest, JSON")
    p.add_argument("--watch", help="watch-context: JSON of watch_sources (type, url), declared names and the transport")
    p.add_argument("--feeds", help="releases: JSON list of feeds (kind, url, source, transport)")
    p.add_argument("--skills", nargs="+", help="globs of Markdown files: the catalog of skills")
    p.add_argument("--out", default="out")
    p.add_argument("--config", help="JSON file of thresholds")
    p.add_argument("--anchor", help="end of the window, ISO 8601 in UTC")
    p.add_argument("--lookback-days", type=int)
    p.add_argument("--include-children", action="store_true", help="show-session: with the sessions below")
    p.add_argument("--force", action="store_true", help="run: replace a summary of another window")
    p.add_argument("--file", help="what to validate")
    p.add_argument("--kind", choices=["skill", "command"], default="skill", help="draft-validate: what the draft is")
    p.add_argument("--mode", choices=["dry-run", "apply"], default="dry-run")
    return p


def shown(spark: SparkSession, data: str, config: Config, id: int, children: bool) -> str:
    """A session's transcript, an entry a turn."""
    rows = catalog.queries(config)["session_transcript"](spark, data)
    rows = rows.where(rows["root_id"] == id) if children else rows.where(rows["session_id"] == id)
    turns = (f"[{r.line}] {'child ' + str(r.session_id) + ' ' if r.child and children else ''}{r.tool} {r.args} -> {r.result}" for r in rows.orderBy("line").toLocalIterator())
    return "\n".join(turns)


def judged(command: str, item: dict | list, kind: str, existing: set[str]) -> list[list[str]]:
    """What each of a file's entries breaks."""
    items = item if isinstance(item, list) else [item]
    if command == "watch-validate":
        declared = set(item.get("declared", [])) if isinstance(item, dict) else set()
        return [validators.watch_decision(x, declared) for x in (item.get("decisions", []) if isinstance(item, dict) else items)]
    if command == "findings-validate":
        return [validators.quality_finding(x) for x in items]
    if command == "draft-validate":
        return [validators.draft(x["text"] if isinstance(x, dict) else str(x), kind, existing) for x in items]
    return [validators.prose_block(x) for x in items]


def remediated(a: argparse.Namespace, changes: list[dict], config: Config) -> int:
    """Exit 0 if all that was proposed is applied (or only looked at), 1 if something was put back."""
    done = remediate.remediate(changes, a.data or ".", a.out, config, a.mode == "apply")
    report.write_json_atomic(done, Path(a.out, "remediation.json"))
    print(json.dumps(done))
    return 1 if any(r["status"] == "rolled_back" for r in done["results"]) or done["warnings"] else 0


def opened(spark: SparkSession, a: argparse.Namespace, config: Config) -> tuple[adapters.StoreViews, DataFrame | None]:
    """The live store's views and the catalog of skills, if one is named."""
    path, adapter = adapters.live(a.store, None if a.migrations is None else {"migration": a.migrations})
    return adapters.StoreViews(spark, path, config, adapter), markdown_catalog(spark, *a.skills) if a.skills else None


def told(v: adapters.StoreViews, id: str, children: bool) -> str:
    """A stored session's transcript, an entry a turn: the tool, its arguments and result, or the text."""
    out = []
    for i, r in enumerate(weekly.transcript(v, id, children).orderBy("session_id", "ts", "event_id").toLocalIterator(), 1):
        if r.kind == "marker":
            out.append(f"[... {r.replaced} similar calls ...]")
            continue
        child = f"child {r.session_id} " if r.session_id != id else ""
        out.append(f"[{i}] {child}{r.tool} {r.args} -> {r.result}" if r.said == "tool" else f"[{i}] {child}{r.said}: {r.text}")
    return "\n".join(out)


def linted(a: argparse.Namespace) -> tuple[list[tuple[str, str]], list[str]]:
    """(rule, target) of a digest's findings, and what is wrong with its form: a digest of another form is a warning, never a failure."""
    if not a.digest:
        return [], []
    try:
        sections, warnings = validators.digest(json.loads(Path(a.digest).read_text(encoding="utf-8")))
    except (OSError, ValueError) as e:
        return [], [f"digest: {e}"]
    return [(str(f["rule"]), str(f.get("target", ""))) for f in sections.get("findings", []) if isinstance(f, dict) and f.get("rule")], [f"digest: {w}" for w in warnings]


def run(spark: SparkSession, a: argparse.Namespace, config: Config) -> int:
    if a.store:
        v, skills = opened(spark, a, config)
        document = weekly.summary(v, skills)
        kept = lambda: weekly.run_frames(v, document, skills)
    else:
        document = report.summary(spark, a.data, config)
        kept = lambda: weekly.table_run_frames(spark, a.data, document, config)
    date = config.run_time[:10]
    fine, warnings = validators.rerun_guard(report.latest(a.out, date), document, a.force)
    if not fine:
        print(warnings[0], file=sys.stderr)
        return 2
    before = report.earlier(a.out, date)
    document["deltas"] = report.deltas(document, before[0] if before else None)
    found, said = linted(a)
    warnings = [{"session_id": None, "message": m} for m in warnings + document["deltas"].pop("warnings") + said]
    document["warnings"] = (warnings + document.get("warnings", []))[: config.warnings_cap]
    frames = kept()
    if found:
        frames["lint"] = spark.createDataFrame(found, "rule string, target string").groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))
    History(spark, a.out).write(date, frames)
    made = report.run_directory(a.out, date)
    report.write_json_atomic(document, made / "summary.json")
    (made / "report.md").write_text(report.markdown(document), encoding="utf-8")
    (made / "report.html").write_text(report.page(document), encoding="utf-8")
    print(made)
    return 1 if warnings else 0


def drawn(spark: SparkSession, a: argparse.Namespace, config: Config) -> dict:
    """The insights of the anchor's run, from what was written."""
    over = catalog.queries(config)["r2_join"](spark, a.data).select(F.col("skill").cast("string").alias("skill")) if a.data else None
    if a.digest:
        over = spark.createDataFrame([(t,) for r, t in linted(a)[0] if r == "trigger-overlap"], "skill string")
    pairs = (report.latest(a.out, config.run_time[:10]) or {}).get("skill_similar_pairs", [])
    return insights(History(spark, a.out), config, over, pairs)


def coherent(a: argparse.Namespace, config: Config, folder: Path) -> int:
    """Dead references of the catalog's files, and with a store what nobody loads or mentions."""
    if not a.skills:
        print("missing --skills", file=sys.stderr)
        return 2
    spark = session()
    try:
        v, skills = opened(spark, a, config) if a.store else (None, markdown_catalog(spark, *a.skills))
    except adapters.SchemaDrift as e:
        print(e, file=sys.stderr)
        return 2
    used = None
    if v is not None:
        used = v["calls"].where("skill is not null").select(F.col("skill").alias("name")).unionAll(weekly.command_usage(v).select(F.col("command").alias("name")))
    rows, more = report.rows_in(coherence.findings(skills, used), ["category", "target", "path"], config.section_rows)
    report.write_json_atomic({"findings": rows, "omitted": {"findings": more} if more else {}}, folder / "coherence.json")
    print(folder / "coherence.json")
    return 0


def stored(a: argparse.Namespace, config: Config, folder: Path) -> int:
    """The commands over a session store, and the insights over what runs left."""
    try:
        if a.command == "doctor":
            path, adapter = adapters.live(a.store, None if a.migrations is None else {"migration": a.migrations})
            print(f"ok: {path} ({adapter.name})")
            return 0
        if a.command not in ("run", "show-session", "insights") or (a.command == "show-session" and not a.name):
            print("not a command over a store, or no id", file=sys.stderr)
            return 2
        spark = session()
        if a.command == "run":
            return run(spark, a, config)
        if a.command == "show-session":
            print(told(opened(spark, a, config)[0], a.name, a.include_children))
            return 0
        document = drawn(spark, a, config)
        report.write_json_atomic(document, folder / "insights.json")
        print(folder / "insights.json")
        return 1 if document["deltas"]["_warnings"] else 0
    except (adapters.SchemaDrift, LookupError) as e:
        print(e, file=sys.stderr)
        return 2


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        config = Config.read(a.config, a.anchor, a.lookback_days)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    have, out = catalog.queries(config), Path(a.out)
    current = out / "runs" / "current"
    if a.command == "list":
        print("\n".join(have))
        return 0
    if a.command in FILES:
        if not a.file:
            print("missing --file", file=sys.stderr)
            return 2
        text = Path(a.file).read_text(encoding="utf-8")
        item = [text] if a.file.endswith(".md") else json.loads(text)
        if a.command == "harness-remediate":
            return remediated(a, item if isinstance(item, list) else [item], config)
        existing = {r["name"] for r in markdown_catalog(session(), *a.skills).select("name").toLocalIterator()} if a.skills and a.command == "draft-validate" else set()
        problems = judged(a.command, item, a.kind, existing)
        print(json.dumps(problems))
        return 1 if any(problems) else 0
    if a.command == "report-assemble":
        if not (current / "summary.json").exists():
            print("no run", file=sys.stderr)
            return 2
        document = json.loads((current / "summary.json").read_text(encoding="utf-8"))
        (current / "report.md").write_text(report.markdown(document), encoding="utf-8")
        (current / "report.html").write_text(report.page(document), encoding="utf-8")
        print(current / "report.html")
        return 0
    if (a.command, bool(a.feeds or a.watch)) in (("releases", True), ("watch-context", True)):
        try:
            given = json.loads(Path(a.feeds or a.watch).read_text(encoding="utf-8"))
            document, code = feeds.ecosystem(session(), given, config) if a.command == "releases" else external.watch_context(session(), given, f"{a.out}/watch-state", config.per_source_cap)
        except (OSError, ValueError) as e:
            print(e, file=sys.stderr)
            return 2
        path = (current if current.exists() else out) / f"{a.command}.json"
        report.write_json_atomic(document, path)
        print(path)
        return code
    if a.command == "coherence":
        return coherent(a, config, current if current.exists() else out)
    if a.store or (a.command == "insights" and Path(a.out, "history").exists()):
        return stored(a, config, current if current.exists() else out)
    if not a.data or (a.command == "query" and a.name not in have) or (a.command == "show-session" and not a.name):
        print("missing --data, unknown query or no id", file=sys.stderr)
        return 2
    if a.command == "doctor":
        missing = [t for t in TABLES if not Path(a.data, f"{t}.parquet").exists()]
        print("missing: " + ", ".join(missing) if missing else "ok")
        return 1 if missing else 0
    spark = session()
    if a.command == "run":
        return run(spark, a, config)
    if a.command == "show-session":
        print(shown(spark, a.data, config, int(a.name), a.include_children))
        return 0
    if a.command == "query":
        for row in have[a.name](spark, a.data).toLocalIterator():
            print(json.dumps({k: report.plain(v) for k, v in row.asDict().items()}, ensure_ascii=False))
        return 0
    document, omitted = {}, {}
    for name in COMMANDS[a.command]:
        document[name], more = report.rows_of(have[name](spark, a.data), None, config.section_rows)
        if more:
            omitted[name] = more
    document["omitted"] = omitted
    path = (current if current.exists() else out) / f"{a.command}.json"
    report.write_json_atomic(document, path)
    print(path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
