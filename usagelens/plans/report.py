"""Documents: deterministic assembly, atomic writes, run folders, Markdown and HTML."""

from __future__ import annotations

import html
import json
import os
import tempfile
import uuid
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from usagelens.config import Config
from usagelens.plans import validators

#: Rows of a section; a longer one says how many are left out.
SECTION_ROWS = 1000
SECTIONS = {"totals": None, "daily_totals": "day", "by_model": "model", "top_sessions": "session_id", "tool_usage": "tool", "subagent_totals": "agent", "cost_outliers": "session_id", "alerts": "rule"}
#: Sections that only a session store's summary has.
STORE_SECTIONS = ("skill_usage", "command_usage", "user_prompt_repeats", "skill_similar_pairs", "skills_never_loaded", "warnings")


def plain(value: Any) -> Any:
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value if isinstance(value, (int, float, str, bool, type(None))) else str(value)


def rows_in(df: DataFrame, order: list, cap: int | None = None) -> tuple[list[dict], int]:
    """A section's rows in an order, ties by all columns: at most ``cap`` (0: all), and how many more there are."""
    cap = SECTION_ROWS if cap is None else cap
    named = [c for c in order if isinstance(c, str)]
    df = df.orderBy(*order, *[c for c in df.columns if c not in named])
    rows = [{k: plain(v) for k, v in r.asDict().items()} for r in (df.limit(cap + 1) if cap else df).collect()]
    return (rows[:cap], df.count() - cap) if cap and len(rows) > cap else (rows, 0)


def rows_of(df: DataFrame, order: str | None, cap: int | None = None) -> tuple[list[dict], int]:
    return rows_in(df, [order] if order else [], cap)


def summary(spark: SparkSession, sf_dir: str, config: Config = Config()) -> dict:
    from usagelens.plans.catalog import queries

    have, out, omitted = queries(config), {}, {}
    for name, order in SECTIONS.items():
        out[name], more = rows_of(have[name](spark, sf_dir), order, config.section_rows)
        if more:
            omitted[name] = more
    return {"schema_version": 2, "period": {"start": config.start, "end": config.run_time, "hours": 24 * config.lookback_days}, "omitted": omitted} | out


def write_json_atomic(document: dict, path: str | Path) -> None:
    """Same document, same bytes: sorted keys, a temp file beside the target, then a rename."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=path.parent, prefix=".", suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(json.dumps(document, sort_keys=True, ensure_ascii=False, indent=2) + "\n")
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise


def run_directory(root: str | Path, date: str, now: str | None = None) -> Path:
    """A fresh folder for a run, its state, and the alias ``current``. Summaries of the older flat layout move to runs of their own, once."""
    root, now = Path(root), now or datetime.now(timezone.utc).isoformat(timespec="seconds")
    runs = root / "runs"
    runs.mkdir(parents=True, exist_ok=True)
    for old in sorted(root.glob("summary-*.json")):
        into = runs / f"{old.stem.removeprefix('summary-')}-migrated"
        into.mkdir(exist_ok=True)
        os.replace(old, into / "summary.json")
    made = runs / f"{date}-{uuid.uuid4().hex[:8]}"
    made.mkdir()
    write_json_atomic({"created_at": now, "activated_at": now, "date": date}, made / "run_state.json")
    alias = runs / ".current.tmp"
    alias.unlink(missing_ok=True)
    alias.symlink_to(made.name)
    os.replace(alias, runs / "current")
    return made


def latest(root: str | Path, date: str) -> dict | None:
    """The summary last written for a date."""
    found = [p for p in Path(root, "runs").glob(f"{date}-*/summary.json") if not p.parent.is_symlink()]
    return json.loads(max(found, key=lambda p: p.stat().st_mtime).read_text(encoding="utf-8")) if found else None


def earlier(root: str | Path, date: str) -> list[dict]:
    """The summaries of runs strictly before a date, newest first; of one date the last written."""
    found = {}
    for p in sorted(Path(root, "runs").glob("*/summary.json"), key=lambda p: p.stat().st_mtime):
        if p.parent.is_symlink() or p.parent.name[:10] >= date:
            continue
        found[p.parent.name[:10]] = json.loads(p.read_text(encoding="utf-8"))
    return [found[d] for d in sorted(found, reverse=True)]


def deltas(now: dict, before: dict | None) -> dict:
    """Changes against the summary before; without one, or where its window has other hours, volumes are null."""
    a, b = (d["totals"][0] if d and d.get("totals") else {} for d in (now, before))
    same = bool(before) and abs(now["period"]["hours"] - before["period"].get("hours", 168)) <= 1
    pct = lambda k: round((a[k] - b[k]) / b[k], 6) if same and a.get(k) is not None and b.get(k) else None
    hit = round(a["hit_rate"] - b["hit_rate"], 6) if a.get("hit_rate") is not None and b.get("hit_rate") is not None else None
    return {"cost_pct": pct("cost"), "tokens_pct": pct("tokens"), "hit_rate_diff": hit, "warnings": ["windows differ"] if before and not same else []}


def sections(document: dict) -> list[str]:
    return [n for n in (*SECTIONS, *STORE_SECTIONS) if n in document or n in SECTIONS and "store" not in document]


def markdown(document: dict) -> str:
    out = [f"# Usage {document['period']['start']} to {document['period']['end']}"]
    for name in sections(document):
        rows = document.get(name) or []
        out.append(f"\n## {name.replace('_', ' ')}\n")
        rows = [r if isinstance(r, dict) else {"message": r} for r in rows]
        if not rows:
            out.append("No rows.")
            continue
        keys = list(rows[0])
        out += ["| " + " | ".join(keys) + " |", "|" + " --- |" * len(keys)]
        out += ["| " + " | ".join(str("" if r[k] is None else r[k]).replace("|", "\\|") for k in keys) + " |" for r in rows]
        if more := document.get("omitted", {}).get(name):
            out.append(f"\n{more} further rows are left out.")
    return "\n".join(out) + "\n"


def page(document: dict) -> str:
    """One file: a cost chart, tables that sort on a click and filter as one types, and the document as JSON that can't close its script element."""
    days = document.get("daily_totals") or []
    most = max([d["cost"] or 0 for d in days] or [1]) or 1
    bars = "".join(f'<rect x="{i * 30}" y="{100 - 100 * (d["cost"] or 0) / most:.1f}" width="24" height="{100 * (d["cost"] or 0) / most:.1f}"><title>{html.escape(str(d["day"]))}</title></rect>' for i, d in enumerate(days))
    tables = []
    for name in sections(document):
        rows = document.get(name) or []
        rows = [r if isinstance(r, dict) else {"message": r} for r in rows]
        keys = list(rows[0]) if rows else []
        head = "".join(f"<th>{html.escape(k)}</th>" for k in keys)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str('' if r[k] is None else r[k]))}</td>" for k in keys) + "</tr>" for r in rows)
        tables.append(f"<h2>{html.escape(name.replace('_', ' '))}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>")
    payload = json.dumps(document, sort_keys=True).replace("</", "<\\/")
    return f'<!doctype html><meta charset="utf-8"><title>Usage</title><input id="find" placeholder="filter"><svg width="{30 * len(days)}" height="100">{bars}</svg>{"".join(tables)}<script>{SCRIPT}</script><script type="application/json" id="data">{payload}</script>\n'


SCRIPT = """
document.querySelectorAll('th').forEach(function (h) { h.onclick = function () {
  var body = h.closest('table').tBodies[0], i = h.cellIndex, up = h.dataset.up = h.dataset.up === '1' ? '' : '1';
  Array.from(body.rows).sort(function (a, b) { var x = a.cells[i].textContent, y = b.cells[i].textContent, d = x - y; if (isNaN(d)) d = x < y ? -1 : x > y; return up ? d : -d; }).forEach(function (r) { body.appendChild(r); });
}; });
document.getElementById('find').oninput = function () { var q = this.value.toLowerCase(); document.querySelectorAll('tbody tr').forEach(function (r) { r.hidden = !r.textContent.toLowerCase().includes(q); }); };
"""


def prose_problems(text: str, least_words: int = validators.LEAST_WORDS) -> list[str]:
    """What a prose block breaks: too few words, or digits."""
    return validators.prose_block({"text": text}, least_words)
