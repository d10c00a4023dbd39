"""What lies outside the tables: commit logs, watch snapshots, allow-listed copies."""

from __future__ import annotations

import re
import shutil
import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens.functions.text import glob_pattern
from usagelens.operators.lineage import checkpoint

VENDOR = ("node_modules/**", "vendor/**", ".cache/**", ".git/**", "**/node_modules/**", "**/__pycache__/**")
MARKER = "[auto-draft]"


def git_log(spark: SparkSession, folder: str, since: str, until: str, marker: str = MARKER) -> DataFrame:
    """(sha, committed, subject) of commits whose subject has the marker; the log's own search would read bodies too."""
    said = subprocess.run(["git", "-C", folder, "log", f"--since={since}", f"--until={until}", "--format=%H%x1f%cI%x1f%s"], capture_output=True, text=True, check=True).stdout
    rows = [tuple(x.split("\x1f")) for x in said.splitlines()]
    return spark.createDataFrame([r for r in rows if marker in r[2]], "sha string, committed string, subject string")


def links(pages: DataFrame, kind: str = "web", text: str = "html") -> DataFrame:
    """(source, link) of watched pages by their kind: ``web`` hrefs, ``list`` Markdown links, ``rss`` item links, ``repo`` and ``topic`` repository addresses."""
    pattern = {"web": 'href="([^"]+)"', "list": r"\]\((https?://[^)\s]+)\)", "rss": r"<link>\s*([^<\s]+)\s*</link>", "repo": r"(https?://[^/\s\"]+/[\w.-]+/[\w.-]+)", "topic": r"\"html_url\":\s*\"([^\"]+)\""}[kind]
    return pages.select("source", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).alias("link"))


def identity(c: Column) -> Column:
    """A name or address as it is compared: lower case, without scheme, ``www.``, ``.git`` and a last slash."""
    return F.regexp_replace(F.lower(F.trim(c)), r"^(git\+)?[a-z]+://(www\.)?|\.git$|/+$", "")


def crosswalk(items: DataFrame, declared: DataFrame, item: str = "link") -> DataFrame:
    """The items with ``declared``, the entry (name) of the inventory of the same identity, if any, and ``known``."""
    own = declared.select(identity(F.col("name")).alias("_identity"), F.col("name").alias("declared")).groupBy("_identity").agg(F.min("declared").alias("declared"))
    return items.withColumn("_identity", identity(F.col(item))).join(own, "_identity", "left").drop("_identity").withColumn("known", F.col("declared").isNotNull())


def watch_context(spark: SparkSession, config: dict, state: str, cap: int = 50) -> tuple[dict, int]:
    """The document of what watched sources link to anew, held against what is declared; exit code 1 if no source could be had."""
    from usagelens.plans.report import rows_in
    from usagelens.sources import feeds

    sources = watch_sources(config)
    got = checkpoint(feeds.pages(spark, sources, config.get("transport", "http"), wait=config.get("wait", feeds.WAIT)))
    found = None
    for kind in sorted({s["type"] for s in sources}):
        own = links(got.where((F.col("kind") == kind) & F.col("text").isNotNull()), kind, "text")
        found = own if found is None else found.unionAll(own)
    document: dict = {"schema_version": 1, "new_links": [], "counts_by_source": {}, "warnings": [{"source": r.source, "message": r.warning} for r in got.where("warning is not null").orderBy("source").collect()]}
    if found is None:
        return document, 0
    new = watched(spark, found, state)
    place = F.row_number().over(Window.partitionBy("source").orderBy("link"))
    new = new.withColumn("_n", place).where(F.col("_n") <= cap).drop("_n")
    declared = spark.createDataFrame([(n,) for n in config.get("declared", [])], "name string")
    document["new_links"] = rows_in(crosswalk(new, declared), ["source", "link"], 0)[0]
    document["counts_by_source"] = {s["url"]: 0 for s in sources}
    for r in document["new_links"]:
        document["counts_by_source"][r["source"]] += 1
    return document, 1 if len(document["warnings"]) == len(sources) else 0


def watch_sources(config: dict) -> list[dict]:
    """Typed sources, with those of the older list of repositories, each once."""
    out = {(s["type"], s["url"]): s for s in config.get("watch_sources", [])}
    for url in config.get("watch_repos", []):
        out.setdefault(("repo", url), {"type": "repo", "url": url})
    if bad := sorted({k for k, _ in out} - {"repo", "list", "web", "topic", "rss"}):
        raise ValueError(f"unknown kinds of sources: {bad}")
    return [out[k] for k in sorted(out)]


def watched(spark: SparkSession, now: DataFrame, snapshot: str) -> DataFrame:
    """(source, link) that the snapshot doesn't have; a source without one is silent.

    The links are read once. They go, with those of sources that aren't looked at now, to a version of their own; the latest one that was
    finished counts, so a run that is killed leaves the snapshot as it was.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    root = path(snapshot)
    fs = root.getFileSystem(conf)
    there = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    finished = [int(n.partition("=")[2]) for n in there if n.startswith("version=") and fs.exists(path(f"{snapshot}/{n}/_SUCCESS"))]
    now = checkpoint(now.select("source", "link").distinct())
    number, kept, new = max(finished, default=0), now, now.limit(0)
    if number:
        before = spark.read.schema("source string, link string").parquet(f"{snapshot}/version={number}")
        sources = now.select("source").distinct()
        new = now.join(before.select("source").distinct(), "source", "left_semi").join(before, ["source", "link"], "left_anti")
        kept = now.unionAll(before.join(sources, "source", "left_anti"))
    new = checkpoint(new)
    kept.write.mode("overwrite").parquet(f"{snapshot}/version={number + 1}")
    if number > 1:
        fs.delete(path(f"{snapshot}/version={number - 1}"), True)
    return new


def projected(root: str | Path, to: str | Path, allow: tuple[str, ...], exclude: tuple[str, ...] = VENDOR) -> tuple[list[str], list[str]]:
    """Copy the allow-listed files; (copied, unscoped) paths. Vendored ones are in neither."""
    root, to = Path(root), Path(to)
    fits = lambda globs: re.compile("|".join(glob_pattern(g) for g in globs)).match
    wanted, never = fits(allow), fits(exclude)
    copied, unscoped = [], []
    for p in sorted(x for x in root.rglob("*") if x.is_file()):
        name = p.relative_to(root).as_posix()
        if never(name):
            continue
        if wanted(name):
            (to / name).parent.mkdir(parents=True, exist_ok=True)
            shutil.copy2(p, to / name)
            copied.append(name)
        else:
            unscoped.append(name)
    return copied, unscoped
