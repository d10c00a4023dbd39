"""Paged feeds as a Spark source: package search, repository topics, a server registry, releases.

    spark.dataSource.register(FeedSource)
    spark.read.format("feed").option("kind", "packages").option("url", u).option("transport", t).load()

Pages of a known number are partitions, fetched by the executors; feeds with a cursor or without a total are one partition that follows
them. Fetches are tried again on 429 and server errors inside the reader. A page that stays dead is a row with a warning, and the others
go on. ``transport`` is ``http`` or a recorded folder that all executors see, one JSON file of answers for each address.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from usagelens.config import Config

TRIES, WAIT, SIZE = 4, 1.0, 250


class Dead(OSError):
    """A page that can't be had."""


def from_http(url: str, attempt: int) -> tuple[int, bytes]:
    try:
        request = urllib.request.Request(url, headers={"Authorization": f"Bearer {t}"} if (t := os.environ.get("FEED_TOKEN")) else {})
        with urllib.request.urlopen(request, timeout=30) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, b""


def recorded_name(url: str) -> str:
    return hashlib.sha256(url.encode()).hexdigest()[:24] + ".json"


def from_folder(folder: str) -> Callable[[str, int], tuple[int, bytes]]:
    """Answers from files, the n-th (or last) of a file for the n-th attempt: ``[{"status": 429}, {"status": 200, "body": ...}]``."""

    def get(url: str, attempt: int) -> tuple[int, bytes]:
        path = Path(folder, recorded_name(url))
        if not path.is_file():
            return 404, b""
        answers = json.loads(path.read_text(encoding="utf-8"))
        got = answers[min(attempt, len(answers) - 1)]
        body = got.get("body")
        return got["status"], body.encode() if isinstance(body, str) else json.dumps(body).encode()

    return get


def fetched(url: str, get: Callable[[str, int], tuple[int, bytes]], tries: int = TRIES, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep, parse: Callable[[bytes], object] = json.loads):
    """A page's JSON, or what ``parse`` makes of it; too many requests, server and network errors are tried again with doubled waits, others aren't."""
    said = ""
    for i in range(tries):
        try:
            status, body = get(url, i)
            if status == 200:
                return parse(body)
            said = str(status)
            if status != 429 and status < 500:
                raise Dead(f"{url}: {said}")
        except ValueError:
            raise Dead(f"{url}: no JSON") from None
        except Dead:
            raise
        except OSError as e:
            said = str(e)
        if i + 1 < tries:
            sleep(wait * 2**i)
    raise Dead(f"{url}: {said} after {tries} tries")


@dataclass(frozen=True)
class Kind:
    """How a feed is paged: where the items and the total lie, how a page is asked for, and where the next one is named."""

    items: Callable[[dict | list], list]
    page: Callable[[str, int, int], str]
    total: Callable[[dict | list], int] | None = None
    cursor: Callable[[dict | list], str | None] | None = None


def with_query(url: str, **more: object) -> str:
    return url + ("&" if "?" in url else "?") + "&".join(f"{k}={quote(str(v), safe='')}" for k, v in more.items())


KINDS = {
    "packages": Kind(lambda x: [o["package"] for o in x["objects"]], lambda u, i, n: with_query(u, size=n, **({"from": i * n} if i else {})), lambda x: x["total"]),
    "topics": Kind(lambda x: x["items"], lambda u, i, n: with_query(u, per_page=n, page=i + 1), lambda x: x["total_count"]),
    "registry": Kind(lambda x: x["servers"], lambda u, i, n: u, cursor=lambda x: (x.get("metadata") or {}).get("nextCursor")),
    "releases": Kind(lambda x: x, lambda u, i, n: with_query(u, per_page=n, page=i + 1)),
}


class Page(InputPartition):
    def __init__(self, number: int | None, first: list | None = None, warning: str | None = None):
        self.number, self.first, self.warning = number, first, warning


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.kind, self.url = KINDS[options["kind"]], options["url"]
        self.transport, self.size = options.get("transport", "http"), int(options.get("size", SIZE))
        self.tries, self.wait = int(options.get("tries", TRIES)), float(options.get("wait", WAIT))

    def get(self, url: str) -> dict | list:
        return fetched(url, getter(self.transport), self.tries, self.wait)

    def partitions(self) -> list[Page]:
        """The first page tells how many there are; it isn't fetched again."""
        if self.kind.total is None:
            return [Page(None)]
        try:
            first = self.get(self.kind.page(self.url, 0, self.size))
            return [Page(0, self.kind.items(first)), *(Page(i) for i in range(1, -(-self.kind.total(first) // self.size)))]
        except Dead as e:
            return [Page(0, [], str(e))]
        except (KeyError, TypeError) as e:
            return [Page(0, [], f"{self.url}: not the expected form: {e!r}")]

    def rows(self, page: Page) -> Iterator[tuple[int, list]]:
        if page.first is not None:
            yield page.number, page.first
        elif page.number is not None:
            yield page.number, self.kind.items(self.get(self.kind.page(self.url, page.number, self.size)))
        elif self.kind.cursor:
            at, number, seen = self.url, 0, set()
            while True:
                got = self.get(at)
                yield number, self.kind.items(got)
                after = self.kind.cursor(got)
                if not after or after in seen:  # a cursor that comes again would never end
                    return
                seen.add(after)
                at, number = with_query(self.url, cursor=after), number + 1
        else:
            number = 0
            while items := self.kind.items(self.get(self.kind.page(self.url, number, self.size))):
                yield number, items
                if len(items) < self.size:
                    return
                number += 1

    def read(self, page: Page) -> Iterator[tuple]:
        if page.warning:
            yield page.number, None, page.warning
        number = page.number or 0
        try:
            for number, items in self.rows(page):  # noqa: B007
                yield from ((number, json.dumps(x, ensure_ascii=False), None) for x in items)
        except Dead as e:
            yield number, None, str(e)
        except (KeyError, TypeError) as e:
            yield number, None, f"{self.url}: not the expected form: {e!r}"


class FeedSource(DataSource):
    """(page, item, warning): an item's JSON, or a warning."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "page int, item string, warning string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeedReader(self.options)


def getter(transport: str) -> Callable[[str, int], tuple[int, bytes]]:
    return from_http if transport == "http" else from_folder(transport)


def pages(spark: SparkSession, sources: list[dict], transport: str = "http", tries: int = TRIES, wait: float = WAIT) -> DataFrame:
    """(source, kind, text, warning) of watched pages, each fetched by a task; a page that can't be had is a warning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = getter(transport)
        for batch in batches:
            got: list[tuple[str | None, str | None]] = []
            for url in batch.column(0).to_pylist():
                try:
                    got.append((fetched(url, get, tries, wait, parse=lambda b: b.decode("utf-8", "replace")), None))
                except Dead as e:
                    got.append((None, str(e)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t for t, _ in got], pa.string()), pa.array([w for _, w in got], pa.string())], ["source", "kind", "text", "warning"])

    rows = spark.createDataFrame([(s["url"], s["type"]) for s in sources], "source string, kind string")
    return rows.repartition(max(1, len(sources)), "source").mapInArrow(run, "source string, kind string, text string, warning string")


# ---------------------------------------------------------------- what the feeds hold


def feed(spark: SparkSession, kind: str, url: str, **options: object) -> DataFrame:
    """(source, item as a variant, warning) of a feed; ``source`` names it in counts."""
    spark.dataSource.register(FeedSource)
    rows = spark.read.format("feed").options(kind=kind, url=url, **{k: v for k, v in options.items() if k != "source"}).load()
    return rows.select(F.lit(options.get("source") or kind).alias("source"), F.try_parse_json("item").alias("item"), "warning")


def at(path: str, kind: str = "string"):
    return F.try_variant_get("item", path, kind)


def when(path: str):
    return F.try_to_timestamp(at(path)).cast("timestamp")


ITEM = ["source", "name", "category", "repo_url", "npm_package", "description", "published_at", "new_repo"]
#: Where a registry entry says whether it is live; a fixed name of the public registry's format.
REGISTRY = "$._meta['io.modelcontextprotocol.registry/official']"


def items_of(rows: DataFrame, kind: str, start: str, end: str, least_stars: int = 5) -> DataFrame:
    """A feed's items of the window, in one form."""
    inside = lambda c: c.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    none = F.lit(None).cast("string")
    r = rows.where("item is not null")
    if kind == "packages":
        out = r.select("source", at("$.name").alias("name"), F.lit("plugin").alias("category"), at("$.links.repository").alias("repo_url"), at("$.name").alias("npm_package"), at("$.description").alias("description"), when("$.date").alias("published_at"), F.lit(False).alias("new_repo"))
        return out.where(inside(F.col("published_at")))
    if kind == "topics":
        made = when("$.created_at")
        out = r.where(at("$.stargazers_count", "long") > least_stars)
        out = out.select("source", at("$.name").alias("name"), F.lit("plugin").alias("category"), at("$.html_url").alias("repo_url"), none.alias("npm_package"), at("$.description").alias("description"), when("$.pushed_at").alias("published_at"), F.coalesce(inside(made), F.lit(False)).alias("new_repo"))
        return out.where(inside(F.col("published_at")) | F.col("new_repo"))
    live = ~F.coalesce(at(f"{REGISTRY}.status"), F.lit("active")).eqNullSafe("deleted") & F.coalesce(at(f"{REGISTRY}.isLatest", "boolean"), F.lit(True))
    out = r.where(live).select("source", at("$.server.name").alias("name"), F.lit("mcp-server").alias("category"), at("$.server.repository.url").alias("repo_url"), none.alias("npm_package"), at("$.server.description").alias("description"), when(f"{REGISTRY}.publishedAt").alias("published_at"), F.lit(False).alias("new_repo"))
    return out.where(inside(F.col("published_at")))


def deduplicated(items: DataFrame) -> DataFrame:
    """One row for each repository (without one, package; without either, name), with all sources that found it."""
    repo = F.regexp_replace(F.lower("repo_url"), r"^(git\+)?https?://|\.git$|/$", "")
    key = F.coalesce(repo, F.concat(F.lit("package:"), "npm_package"), F.concat(F.lit("name:"), "name"))
    first = F.min_by(F.struct(*(c for c in ITEM if c not in ("source", "new_repo", "npm_package"))), F.struct("source", "name", "published_at"))
    rows = items.groupBy(key.alias("_key")).agg(first.alias("x"), F.min("npm_package").alias("npm_package"), F.max("new_repo").alias("new_repo"), F.sort_array(F.collect_set("source")).alias("found_via"))
    return rows.select("x.*", "npm_package", "new_repo", "found_via").withColumn("notable", (F.size("found_via") >= 2) | F.col("new_repo"))


def core_changes(rows: DataFrame, start: str, end: str, keywords: tuple[str, ...]) -> DataFrame:
    """Releases of the window whose text has a keyword as a word, with those that it has."""
    r = rows.where("item is not null").select(at("$.tag_name").alias("version"), when("$.published_at").alias("date"), F.coalesce(at("$.name"), F.lit("")).alias("name"), F.coalesce(at("$.body"), F.lit("")).alias("body"))
    said = F.concat_ws("\n", "name", "body")
    hits = F.filter(F.array(*(F.when(said.rlike(rf"(?i)\b{k}\b"), F.lit(k)) for k in keywords)), lambda x: x.isNotNull())
    r = r.where(F.col("date").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))).withColumn("matched_keywords", hits).where(F.size("matched_keywords") > 0)
    return r.select("version", F.to_date("date").alias("date"), F.substring_index("body", "\n", 3).alias("summary"), "matched_keywords", F.when(F.size("matched_keywords") >= 2, "high").otherwise("medium").alias("relevance_flag"))


def ecosystem(spark: SparkSession, feeds: list[dict], config: Config) -> tuple[dict, int]:
    """The document of the window's feeds, and the exit code: 1 if every feed failed."""
    from usagelens.operators.lineage import checkpoint
    from usagelens.plans.report import rows_in

    names = ["packages", "topics", "registry", "releases"]
    if unknown := sorted({f["kind"] for f in feeds} - set(names)):
        raise ValueError(f"unknown kinds of feeds: {unknown}")
    got = {f.get("source") or f["kind"]: (f["kind"], checkpoint(feed(spark, **f))) for f in feeds}
    found = [items_of(rows, kind, config.start, config.run_time, config.least_stars) for kind, rows in got.values() if kind != "releases"]
    document: dict = {"schema_version": 2, "period": {"start": config.start, "end": config.run_time}, "generated_at": config.run_time, "new_items": [], "counts_by_category": dict.fromkeys(("plugin", "skill", "agent", "mcp-server"), 0), "core_changes": [], "omitted": {}}
    document["counts_by_source"] = dict.fromkeys(got, 0)
    if found:
        union = found[0]
        for x in found[1:]:
            union = union.unionAll(x)
        place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("published_at"), "name"))
        items = checkpoint(deduplicated(union.withColumn("_n", place).where(F.col("_n") <= config.per_source_cap).drop("_n")))
        rows, more = rows_in(items, ["name"], config.section_rows)
        document["new_items"], document["omitted"] = rows, {"new_items": more} if more else {}
        document["counts_by_category"] |= {r.category: r["count"] for r in items.groupBy("category").count().collect()}
        document["counts_by_source"] |= {r.s: r["count"] for r in items.select(F.explode("found_via").alias("s")).groupBy("s").count().collect()}
    for name, (kind, rows) in got.items():
        if kind == "releases":
            changes = rows_in(core_changes(rows, config.start, config.run_time, config.release_keywords), ["date", "version"], config.section_rows)[0]
            document["core_changes"] += changes
            document["counts_by_source"][name] = len(changes)
    warned, dead = [], 0
    for name, (_, rows) in got.items():
        w = [r.warning for r in rows.where("warning is not null").orderBy("warning").limit(config.warnings_cap).collect()]
        warned += [{"source": name, "message": m} for m in w]
        dead += bool(w) and rows.where("item is not null").isEmpty()
    document["warnings"] = warned[: config.warnings_cap]
    return document, 1 if feeds and dead == len(got) else 0
