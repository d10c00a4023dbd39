"""Mentions against a plain search, dead and unused entries, by command too."""

import json
import random
import re

import pytest

from usagelens import cli
from usagelens.plans import coherence

NAMES = ["deploy", "deploy-staging", "git-review", "a.b", "two words", "é-x", "run", "Upper", "(odd", ""]


def plain(bodies, names):
    out = set()
    for path, body in bodies:
        for n in {n.lower() for n in names if n}:
            text = (body or "").lower()
            at = text.find(n)
            while at >= 0:
                if coherence.bounded(text, at, at + len(n)):
                    out.add((path, n))
                    break
                at = text.find(n, at + 1)
    return out


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_mentions_equal_a_plain_search(spark, limit):
    rng = random.Random(1)
    bits = [*NAMES, "deploy_", "x", " ", "-", ", ", "\n", "/", "@", "réview", "2", "é"]
    bodies = [(f"p{i}", "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for i in range(300)] + [("none", None)]
    b, n = spark.createDataFrame(bodies, "path string, body string"), spark.createDataFrame([(x,) for x in [*NAMES, None]], "name string")
    names = NAMES if limit else [x for x in NAMES if x != "(odd"] + ["(odd"]
    got = coherence.mentions(b, n, limit).collect()
    assert {(r.path, r.name) for r in got} == plain(bodies, names) and len(got) == len({tuple(r) for r in got}) > 50
    assert coherence.mentions(b.limit(0), n, limit).count() == 0 and coherence.mentions(b, n.limit(0), limit).count() == 0


def test_explicit_references():
    said = "See @docs and /fix-it, skills/deploy/SKILL.md, commands/go or agents/qa. Not a/b, me@home, http://x/y, /fix/it, @docs-, /Upper."
    found = set(re.findall(coherence.EXPLICIT, said)) | set(re.findall(coherence.IN_PATH, said))
    assert found == {"docs", "fix-it", "deploy", "go", "qa"}


def test_dead_and_unused_entries(spark, tmp_path, monkeypatch):
    files = {"skills/deploy/SKILL.md": "See @docs, then /fix or skills/gone/SKILL.md.", "skills/idle/SKILL.md": "Nobody loads idle.", "commands/fix.md": "Runs deploy.", "agents/docs.md": "Uses nothing", "skills/odd/SKILL.md": "mentions idler and /nowhere"}
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        stem = name.split("/")[1].removesuffix(".md")
        (tmp_path / name).write_text(f"---\nname: {stem}\n---\n{body}")
    from usagelens.sources.catalog_files import markdown_catalog

    globs = [f"{tmp_path}/skills/*/SKILL.md", f"{tmp_path}/commands/*.md", f"{tmp_path}/agents/*.md"]
    catalog = markdown_catalog(spark, *globs)
    assert sorted((r.path.split("/")[-2], r.name) for r in coherence.dead_references(catalog).collect()) == [("deploy", "gone"), ("odd", "nowhere")]
    used = spark.createDataFrame([("odd",)], "name string")
    for limit in (1 << 20, 0):
        assert [r.name for r in coherence.unused_unreferenced(catalog, used, limit).collect()] == ["idle"]
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main(["coherence", "--skills", *globs, "--out", str(tmp_path / "out")]) == 0
    made = json.loads((tmp_path / "out/coherence.json").read_text())
    assert [(f["category"], f["target"]) for f in made["findings"]] == [("dead-reference", "gone"), ("dead-reference", "nowhere")]
