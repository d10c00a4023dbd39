"""Paged feeds from recorded answers: pages, cursors, retries, dead pages, and the document drawn from them."""

import json

import pytest

from usagelens import cli
from usagelens.config import Config
from usagelens.sources import feeds

PACKAGES, TOPICS, SERVERS, RELEASES = "https://packages.example/search?text=keywords:x", "https://code.example/search?q=topic:x", "https://registry.example/servers?version=latest", "https://code.example/releases"
DAY = "2024-01-25T00:00:00Z"


def record(folder, url, *answers):
    """Answers by attempt: a status, or a body."""
    folder.mkdir(exist_ok=True)
    (folder / feeds.recorded_name(url)).write_text(json.dumps([{"status": a} if isinstance(a, int) else {"status": 200, "body": a} for a in answers]))


def package(name, date=DAY, repo=None):
    return {"package": {"name": name, "description": "d", "date": date, "links": {"repository": repo}}}


def server(name, **meta):
    block = {"status": "active", "isLatest": True, "publishedAt": DAY} | meta
    return {"server": {"name": name, "description": "d"}, "_meta": {"io.modelcontextprotocol.registry/official": block}}


@pytest.fixture
def folder(tmp_path):
    f = tmp_path / "recorded"
    record(f, f"{PACKAGES}&size=2", {"objects": [package("a", repo="https://code.example/o/A.git"), package("b")], "total": 6})
    record(f, f"{PACKAGES}&size=2&from=2", 429, 503, {"objects": [package("c"), package("old", "2020-01-01T00:00:00Z")], "total": 6})
    record(f, f"{PACKAGES}&size=2&from=4", 500)  # dead
    repo = lambda name, stars, pushed=DAY, made="2020-01-01T00:00:00Z": {"name": name, "html_url": f"https://code.example/o/{name}", "stargazers_count": stars, "pushed_at": pushed, "created_at": made, "description": None}
    record(f, f"{TOPICS}&per_page=2&page=1", {"total_count": 4, "items": [repo("a", 50), repo("few", 5)]})
    record(f, f"{TOPICS}&per_page=2&page=2", {"total_count": 4, "items": [repo("new", 9, made=DAY), repo("quiet", 99, pushed="2023-01-01T00:00:00Z")]})
    record(f, SERVERS, {"servers": [server("s1"), server("gone", status="deleted")], "metadata": {"nextCursor": "c/1"}})
    record(f, f"{SERVERS}&cursor=c%2F1", {"servers": [server("old", isLatest=False), server("s2")], "metadata": {"nextCursor": "c/1"}})  # a cursor that comes again
    release = lambda tag, body, date=DAY: {"tag_name": tag, "published_at": date, "body": body, "name": tag}
    record(f, f"{RELEASES}?per_page=2&page=1", [release("v3", "Faster cache.\nAlso a new skill.\nthree\nfour"), release("v2", "skills and caches")])
    record(f, f"{RELEASES}?per_page=2&page=2", [release("v1", "Context", "2023-01-01T00:00:00Z"), release("v0", "one CACHE fix")])
    record(f, f"{RELEASES}?per_page=2&page=3", [])
    return f


def all_feeds(folder):
    more = {"transport": str(folder), "size": 2, "wait": 0.0}
    return [{"kind": k, "url": u} | more for k, u in (("packages", PACKAGES), ("topics", TOPICS), ("registry", SERVERS), ("releases", RELEASES))]


def test_pages_are_partitions_and_a_dead_one_is_a_warning(spark, folder):
    df = feeds.feed(spark, "packages", PACKAGES, transport=folder, size=2, wait=0.0)
    assert df.rdd.getNumPartitions() == 3
    rows = df.select("warning", feeds.at("$.name").alias("name")).collect()
    assert sorted(r.name for r in rows if r.name) == ["a", "b", "c", "old"]
    assert [r.warning for r in rows if r.warning] == [f"{PACKAGES}&size=2&from=4: 500 after 4 tries"]
    reader = feeds.FeedReader({"kind": "packages", "url": PACKAGES, "transport": str(folder), "size": "2", "wait": "0"})
    first, second, dead = reader.partitions()
    assert len(list(reader.read(first))) == 2 and first.first is not None and second.first is None  # page 0 isn't fetched twice


def test_waits_double_and_other_errors_end_at_once():
    waits: list = []
    answers = iter([(429, b""), (503, b""), (200, b'{"x": 1}')])
    assert feeds.fetched("u", lambda u, i: next(answers), sleep=waits.append) == {"x": 1} and waits == [1.0, 2.0]
    for get, said in ((lambda u, i: (404, b""), "u: 404"), (lambda u, i: (200, b"<html>"), "u: no JSON")):
        with pytest.raises(feeds.Dead, match=said):
            feeds.fetched("u", get, sleep=waits.append)

    def refused(u, i):
        raise ConnectionError("refused")

    with pytest.raises(feeds.Dead, match="refused after 2 tries"):
        feeds.fetched("u", refused, 2, sleep=waits.append)
    assert waits == [1.0, 2.0, 1.0]


def test_the_document_of_four_feeds(spark, folder, tmp_path, monkeypatch, capsys):
    document, code = feeds.ecosystem(spark, all_feeds(folder), Config())
    items = {r["name"]: (r["category"], r["found_via"], r["new_repo"], r["notable"], r["npm_package"]) for r in document["new_items"]}
    assert code == 0 and items == {
        "a": ("plugin", ["packages", "topics"], False, True, "a"), "b": ("plugin", ["packages"], False, False, "b"), "c": ("plugin", ["packages"], False, False, "c"),
        "new": ("plugin", ["topics"], True, True, None), "s1": ("mcp-server", ["registry"], False, False, None), "s2": ("mcp-server", ["registry"], False, False, None),
    }
    assert document["counts_by_category"] == {"plugin": 4, "skill": 0, "agent": 0, "mcp-server": 2}
    assert document["counts_by_source"] == {"packages": 3, "topics": 2, "registry": 2, "releases": 2}
    assert [(c["version"], c["matched_keywords"], c["relevance_flag"], c["summary"].count("\n")) for c in document["core_changes"]] == [("v0", ["cache"], "medium", 0), ("v3", ["skill", "cache"], "high", 2)]
    assert [w["source"] for w in document["warnings"]] == ["packages"]
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "feeds.json").write_text(json.dumps(all_feeds(folder)))
    assert cli.main(["releases", "--feeds", str(tmp_path / "feeds.json"), "--out", str(tmp_path / "out")]) == 0
    assert json.loads((tmp_path / "out/releases.json").read_text()) == json.loads(json.dumps(document))
    (tmp_path / "feeds.json").write_text(json.dumps([{"kind": "packages", "url": "https://nowhere.example", "transport": str(folder), "wait": 0.0}]))
    assert cli.main(["releases", "--feeds", str(tmp_path / "feeds.json"), "--out", str(tmp_path / "out")]) == 1
    (tmp_path / "feeds.json").write_text(json.dumps([{"kind": "odd", "url": "u"}]))
    assert cli.main(["releases", "--feeds", str(tmp_path / "feeds.json"), "--out", str(tmp_path / "out")]) == 2
    empty, code = feeds.ecosystem(spark, [], Config())
    assert code == 0 and empty["new_items"] == []


def test_a_feed_of_another_form_is_a_warning(spark, tmp_path):
    record(tmp_path / "r", f"{TOPICS}&per_page=250&page=1", {"message": "moved"})
    got = feeds.feed(spark, "topics", TOPICS, transport=tmp_path / "r").collect()
    assert len(got) == 1 and "not the expected form" in got[0].warning and got[0].item is None


def test_watched_sources_are_fetched_compared_and_crosswalked(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    folder, out = tmp_path / "w", tmp_path / "out"
    page = lambda *x: "".join(f'<a href="{u}">' for u in x)
    record(folder, "https://w.example/", page("https://a.example/x"))
    record(folder, "https://l.example/README.md", "- [b](https://b.example/y)")
    record(folder, "https://r.example/rss", 429, "<item><link>https://c.example/z</link></item>")
    sources = [{"type": "web", "url": "https://w.example/"}, {"type": "list", "url": "https://l.example/README.md"}, {"type": "rss", "url": "https://r.example/rss"}, {"type": "web", "url": "https://gone.example/"}]
    config = {"watch_sources": sources, "declared": ["https://www.D.example/Tool.git", "other"], "transport": str(folder), "wait": 0.0}
    (tmp_path / "watch.json").write_text(json.dumps(config))

    def run():
        code = cli.main(["watch-context", "--watch", str(tmp_path / "watch.json"), "--out", str(out)])
        return code, json.loads((out / "watch-context.json").read_text())

    code, first = run()
    assert code == 0 and first["new_links"] == [] and [w["source"] for w in first["warnings"]] == ["https://gone.example/"]  # a silent baseline
    record(folder, "https://w.example/", page("https://a.example/x", "http://d.example/tool/", "https://e.example"))
    code, second = run()
    assert [(r["link"], r["known"], r["declared"]) for r in second["new_links"]] == [("http://d.example/tool/", True, "https://www.D.example/Tool.git"), ("https://e.example", False, None)]
    assert second["counts_by_source"] == {s["url"]: 2 if s["url"] == "https://w.example/" else 0 for s in sources}
    assert run()[1]["new_links"] == []
    (tmp_path / "watch.json").write_text(json.dumps(config | {"watch_sources": [{"type": "odd", "url": "u"}]}))
    assert cli.main(["watch-context", "--watch", str(tmp_path / "watch.json"), "--out", str(out)]) == 2
