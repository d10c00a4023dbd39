"""The deterministic shells around findings, decisions, drafts and reports: what each breaks, as a list; an empty one passes."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import Any

SEVERITIES = ("high", "medium", "low")
#: What becomes of a recommendation.
ROUTES = {"new-skill": "draft", "new-command": "draft", "improve-skill": "draft", "improve-command": "draft", "agent-change": "report", "habit": "report", "none": "ignore"}
CATEGORIES = ("loop", "cache", "repeat", "outlier", "top", "tooling", "prompt", "context", "delegation", "other")
DECISIONS = ("adopt", "verify-existing", "improve-existing", "repair-existing", "token-saver", "ignore")
COHERENCE = ("dead-reference", "overlap", "contradiction", "unused", "naming")
TAGS = ("agent", "skill", "command", "plugin", "config")
LEAST_WORDS = 40


def _missing(item: dict, names: Iterable[str]) -> list[str]:
    return [f"missing {n}" for n in names if item.get(n) in (None, "")]


def quality_finding(item: dict) -> list[str]:
    out = _missing(item, ("session_id", "category", "severity", "recommendation_type", "evidence"))
    out += [f"unknown {n}: {item.get(n)}" for n, allowed in (("category", CATEGORIES), ("severity", SEVERITIES), ("recommendation_type", tuple(ROUTES))) if item.get(n) and item[n] not in allowed]
    return out


def routed(items: list[dict]) -> dict[str, list[dict]]:
    """Valid findings by what becomes of them, the most severe first, then by session."""
    out: dict[str, list[dict]] = {a: [] for a in dict.fromkeys(ROUTES.values())}
    for x in sorted((x for x in items if not quality_finding(x)), key=lambda x: (SEVERITIES.index(x["severity"]), str(x["session_id"]))):
        out[ROUTES[x["recommendation_type"]]].append(x)
    return out


def watch_decision(item: dict, declared: set[str]) -> list[str]:
    """What is declared already can't be adopted."""
    out = _missing(item, ("identity", "decision", "reason"))
    if item.get("decision") and item["decision"] not in DECISIONS:
        out.append(f"unknown decision: {item['decision']}")
    if item.get("decision") == "adopt" and str(item.get("identity", "")).strip().lower() in {d.strip().lower() for d in declared}:
        out.append("declared already: verify, improve or repair")
    return out


def front_matter(text: str) -> dict[str, str]:
    m = re.match(r"---\n(.*?)\n---\n?", text, re.S)
    return dict(x.split(":", 1) for x in m[1].splitlines() if ":" in x) if m else {}


def draft(text: str, kind: str, existing: set[str]) -> list[str]:
    """A skill or command file: front matter, a body, and a name that isn't taken."""
    head = {k.strip(): v.strip() for k, v in front_matter(text).items()}
    out = [] if head else ["no front matter"]
    out += _missing(head, ("name", "description") if kind == "skill" else ("description",)) if head else []
    if head.get("name") and not re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", head["name"]):
        out.append("name isn't in kebab case")
    if head.get("name", "").lower() in {e.lower() for e in existing}:
        out.append("overlaps one that exists")
    if not re.sub(r"(?s)^---\n.*?\n---\n?", "", text).strip():
        out.append("empty body")
    return out


def coherence_finding(item: dict) -> list[str]:
    out = _missing(item, ("category", "tag", "impact", "target"))
    out += [f"unknown {n}: {item.get(n)}" for n, allowed in (("category", COHERENCE), ("tag", TAGS), ("impact", SEVERITIES)) if item.get(n) and item[n] not in allowed]
    return out


def by_impact(items: list[dict]) -> list[dict]:
    return sorted((x for x in items if not coherence_finding(x)), key=lambda x: (SEVERITIES.index(x["impact"]), x["category"], x["target"]))


def prose_block(block: dict, least_words: int = LEAST_WORDS) -> list[str]:
    text = block.get("text") or ""
    return [m for bad, m in ((len(text.split()) < least_words, "too short"), (bool(re.search("[0-9]", text)), "has digits")) if bad]


def prose_order(blocks: list[dict]) -> list[dict]:
    rank = lambda v: SEVERITIES.index(v) if v in SEVERITIES else len(SEVERITIES)
    return sorted(blocks, key=lambda b: (rank(b.get("severity")), rank(b.get("impact")), str(b.get("title", ""))))


def digest(document: Any) -> tuple[dict, list[str]]:
    """An external digest's sections and warnings: one of another form is left out, never a crash."""
    kinds = {"budget": dict, "triggers": list, "dependencies": list, "findings": list, "metadata": dict}
    if not isinstance(document, dict):
        return {}, ["digest isn't an object"]
    out, warnings = {}, []
    for name, kind in kinds.items():
        if name not in document:
            warnings.append(f"no {name}")
        elif not isinstance(document[name], kind):
            warnings.append(f"{name} isn't of the expected form")
        else:
            out[name] = document[name]
    return out, warnings


def rerun_guard(old: dict | None, new: dict, force: bool) -> tuple[bool, list[str]]:
    """Whether a summary may take the place of an earlier one of its date, and the warning that goes with it."""
    if old is None or old.get("period") == new.get("period"):
        return True, []
    return force, ["replaces a summary of another window" if force else "a summary of another window is there: --force replaces it"]
