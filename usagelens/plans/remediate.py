"""Textual remediation of skills and commands, all or nothing.

A change names a file, a rule, a confidence, and one text to put in another's place. Whether it may be applied at all is said by
``verdict``; nothing may by default, as the list of rules is empty. Those that may are tried on copies first. Then the old contents
and digests of all files go to a journal, the files are replaced one by one, and each is read again; if any step fails, all files
are put back. A journal that a killed run left is undone by the next one.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from usagelens.config import Config
from usagelens.plans import report, validators

JOURNAL = "remediation-journal.json"
#: Rules of these families are never applied.
NEVER = ("security/",)


def verdict(change: dict, root: Path, config: Config) -> tuple[str, list[str]]:
    """(status, why): ``blocked`` for good, ``manual`` for a person to look at, ``proposed`` if it may be applied."""
    missing = [f"missing {n}" for n in ("file", "rule", "old", "confidence") if change.get(n) in (None, "")] + ([] if "new" in change else ["missing new"])
    if missing:
        return "blocked", missing
    rule, path = str(change["rule"]), root / str(change["file"])
    blocked = []
    if rule.startswith(NEVER):
        blocked.append("rules of this family are never applied")
    inside = path.resolve().is_relative_to(root.resolve())
    if not inside or not any(path.resolve().is_relative_to((root / f).resolve()) for f in config.fix_folders):
        blocked.append("file is outside the folders of skills and commands")
    elif not path.is_file():
        blocked.append("no such file")
    if blocked:
        return "blocked", blocked
    manual = [] if rule in config.auto_fix_rules else ["rule isn't on the list"]
    if change["confidence"] != "high":
        manual.append("not sure enough")
    if (n := path.read_text(encoding="utf-8").count(change["old"])) != 1:
        manual.append(f"{n} places")
    if change["old"] == change["new"]:
        manual.append("changes nothing")
    return ("manual", manual) if manual else ("proposed", [])


def holds(before: str, after: str, change: dict) -> bool:
    """The check after a change: what was found is gone, and the head of the file is no worse."""
    gone = change["old"] not in after or change["old"] in change["new"]
    return gone and (not validators.front_matter(before) or bool(validators.front_matter(after)))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def replace(path: Path, text: str) -> None:
    """A temp file beside it, then a rename."""
    handle, temp = tempfile.mkstemp(dir=path.parent, prefix=".", suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        shutil.copymode(path, temp)
        os.replace(temp, path)
    except BaseException:
        Path(temp).unlink(missing_ok=True)
        raise


def undo(journal: Path) -> list[str]:
    """The files of a journal as they were; what was changed by others since is left alone and named."""
    kept = []
    for name, x in json.loads(journal.read_text(encoding="utf-8"))["files"].items():
        path = Path(name)
        now = digest(path.read_text(encoding="utf-8")) if path.is_file() else None
        if now == x["before"]:
            continue
        if now not in (x["after"], None):
            kept.append(name)
            continue
        if now is None:
            path.write_text(x["text"], encoding="utf-8")
        else:
            replace(path, x["text"])
    journal.unlink()
    return kept


def tried(texts: dict[Path, str], changes: list[dict], root: Path, check: Callable[[str, str, dict], bool]) -> dict[Path, str] | None:
    """The new text of each file after all changes, made on copies; None if one doesn't fit any more or fails the check."""
    with tempfile.TemporaryDirectory(prefix="remediation-") as copies:
        places = {}
        for i, (path, text) in enumerate(texts.items()):
            places[path] = Path(copies) / f"{i}-{path.name}"
            places[path].write_text(text, encoding="utf-8")
        for x in changes:
            place = places[root / x["file"]]
            before = place.read_text(encoding="utf-8")
            if before.count(x["old"]) != 1:
                return None
            after = before.replace(x["old"], x["new"], 1)
            place.write_text(after, encoding="utf-8")
            if not check(before, after, x):
                return None
        return {path: place.read_text(encoding="utf-8") for path, place in places.items()}


def remediate(changes: list[dict], root: str | Path, out: str | Path, config: Config, apply: bool = False, check: Callable[[str, str, dict], bool] = holds) -> dict:
    """A status for each change: blocked, manual, proposed, applied or rolled_back; with ``apply`` the proposed ones are applied, all or none."""
    root, journal = Path(root), Path(out) / JOURNAL
    warnings = [f"{n}: changed since a run that was killed; left as it is" for n in undo(journal)] if journal.exists() else []
    results = [dict(zip(("status", "problems"), verdict(x, root, config), strict=True)) | {"file": x.get("file"), "rule": x.get("rule")} for x in changes]
    todo = [i for i, r in enumerate(results) if r["status"] == "proposed"]
    files = list(dict.fromkeys(root / changes[i]["file"] for i in todo))
    if len(files) > config.auto_fix_max_files:
        allowed = set(files[: config.auto_fix_max_files])
        for i in todo:
            if root / changes[i]["file"] not in allowed:
                results[i] |= {"status": "manual", "problems": ["too many files"]}
        todo, files = [i for i in todo if results[i]["status"] == "proposed"], files[: config.auto_fix_max_files]
    if not apply or not todo:
        return {"results": results, "warnings": warnings}

    def back(why: str) -> dict:
        for i in todo:
            results[i] |= {"status": "rolled_back", "problems": [why]}
        return {"results": results, "warnings": warnings}

    old = {p: p.read_text(encoding="utf-8") for p in files}
    new = tried(old, [changes[i] for i in todo], root, check)
    if new is None:
        return back("a change failed its check on a copy")
    report.write_json_atomic({"files": {str(p): {"before": digest(old[p]), "after": digest(new[p]), "text": old[p]} for p in files}}, journal)
    try:
        for p in files:
            if p.read_text(encoding="utf-8") != old[p]:
                raise OSError(f"{p} changed meanwhile")
            replace(p, new[p])
            if digest(p.read_text(encoding="utf-8")) != digest(new[p]):
                raise OSError(f"{p} isn't what was written")
    except OSError as e:
        warnings += [f"{n}: changed by others; left as it is" for n in undo(journal)]
        return back(str(e))
    journal.unlink()
    for i in todo:
        results[i] |= {"status": "applied"}
    return {"results": results, "warnings": warnings}
