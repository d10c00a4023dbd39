"""Session stores behind one interface: whatever a SQLite file's schema is, the analytics read the same canonical views.

An adapter says which tables and columns it needs, where session metadata lie, and how payloads become typed parts
(id, session_id, ts, kind, role, data). Everything else, sessions to repeated prompts, is built from these alike.
"""

from __future__ import annotations

import sqlite3
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from usagelens.config import Config
from usagelens.operators.lineage import checkpoint
from usagelens.operators.robust import freshest
from usagelens.operators.trees import roots
from usagelens.sources import sqlite
from usagelens.sources.proxy import Views

SESSION = {"id", "parent_id", "title", "model", "agent", "cost", "time_created", "time_updated"}
PART = {"id", "message_id", "session_id", "time_created", "data"}
MESSAGE = {"id", "session_id", "data"}
#: A store's migrations, at least, by the table that counts them.
MIGRATIONS = {"migration": 42}
KINDS = {"session.step.ended.1": "step-finish", "session.tool.called.1": "tool", "session.reasoning.ended.1": "reasoning"}


class SchemaDrift(ValueError):
    """A store that no adapter can read."""


@dataclass(frozen=True)
class Adapter:
    name: str
    metadata: tuple[str, ...]  # tables of sessions; of one id the freshest row counts
    required: dict[str, set[str]]
    absent: tuple[str, ...] = ()

    def problems(self, have: dict[str, set[str]]) -> list[str]:
        out = [f"{t}: no table" if t not in have else f"{t}: no {', '.join(sorted(c - have[t]))}" for t, c in self.required.items() if t not in have or c - have[t]]
        return out + [f"{t}: not of this form" for t in self.absent if t in have]


#: Tried in this order; the first that fits counts.
ADAPTERS = (
    Adapter("v2", ("session",), {"session": SESSION, "session_message": {"id", "session_id", "type", "time_created", "data"}, "event": {"id", "session_id", "type", "time_created", "payload"}}),
    Adapter("v1-dual", ("session", "session_v2"), {"session": SESSION, "session_v2": SESSION, "part": PART, "message": MESSAGE}, ("event",)),
    Adapter("v1-live", ("session",), {"session": SESSION, "part": PART, "message": MESSAGE}, ("session_v2", "event")),
    Adapter("v1", ("session_v2",), {"session_v2": SESSION, "part": PART, "message": MESSAGE}, ("session", "event")),
)


def schema(path: str) -> dict[str, set[str]]:
    with sqlite.opened(path) as db:
        tables = [r[0] for r in db.execute("select name from sqlite_master where type = 'table'")]
        return {t: {r[1] for r in db.execute(f"pragma table_info({sqlite.quoted(t)})")} for t in tables}


def detected(path: str, migrations: dict[str, int] | None = None) -> Adapter:
    """The adapter that a file's schema fits; else SchemaDrift, with what the nearest one misses. Fewer migrations than expected are drift too."""
    try:
        have = schema(path)
    except sqlite3.DatabaseError as e:
        raise SchemaDrift(f"{path}: {e}") from e
    found = [(a, a.problems(have)) for a in ADAPTERS]
    for a, problems in found:
        if problems:
            continue
        with sqlite.opened(path) as db:
            for table, least in (MIGRATIONS if migrations is None else migrations).items():
                if table in have and (n := db.execute(f"select count(*) from {sqlite.quoted(table)}").fetchone()[0]) < least:
                    raise SchemaDrift(f"{path}: {n} migrations, {least} expected")
        return a
    nearest, problems = min(found, key=lambda x: len(x[1]))
    raise SchemaDrift(f"{path}: unsupported; {nearest.name}: {'; '.join(problems)}")


def live(paths: list[str], migrations: dict[str, int] | None = None) -> tuple[str, Adapter]:
    """Of the candidate files that some adapter fits, the one of the latest update, and its adapter."""
    found, said = [], []
    for p in paths:
        try:
            a = detected(p, migrations)
            with sqlite.opened(p) as db:
                newest = max(db.execute(f"select coalesce(max(time_updated), 0) from {sqlite.quoted(t)}").fetchone()[0] for t in a.metadata)
            found.append((newest, p, a))
        except (OSError, SchemaDrift) as e:
            said.append(str(e))
    if not found:
        raise SchemaDrift("; ".join(said) or "no store named")
    _, p, a = max(found, key=lambda x: x[:2])
    return p, a


def millis(name: str) -> Column:
    return F.timestamp_millis(F.col(name)).cast("timestamp_ntz")


class StoreViews(Views):
    """The canonical views of a store. Payloads are parsed once, unreadable ones go to ``unreadable``; time filters reach SQLite."""

    def __init__(self, spark: SparkSession, path: str, config: Config, adapter: Adapter | None = None, partitions: int = 8):
        super().__init__(spark, "", config)
        self.path, self.partitions = path, partitions
        self.adapter = adapter or detected(path)
        self.columns = schema(path)
        spark.dataSource.register(sqlite.SqliteSource)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        ms = lambda t: F.lit(t).cast("timestamp_ntz").cast("timestamp")
        self.since, self.until = (int(spark.range(1).select(F.unix_millis(ms(t))).first()[0]) for t in (config.start, config.run_time))

    def __missing__(self, name: str) -> DataFrame:
        self[name] = getattr(self, f"_{name}")()
        return self[name]

    def raw(self, table: str, *columns: str) -> DataFrame:
        """The named columns of a table; others aren't read."""
        kinds = sqlite.declared(self.path, table)
        wanted = StructType([StructField(c, kinds[c]) for c in columns])
        return self.spark.read.format("sqlite").schema(wanted).option("path", self.path).option("table", table).option("partitions", self.partitions).load()

    # ------------------------------------------------------------ what differs

    def _payloads(self) -> DataFrame:
        """(id, message_id, session_id, at, kind, text, json) of the window, as stored."""
        inside = (F.col("time_created") >= self.since) & (F.col("time_created") <= self.until)
        if self.adapter.name != "v2":
            p = self.raw("part", "id", "message_id", "session_id", "time_created", "data").where(inside)
            return p.select("id", "message_id", "session_id", F.col("time_created").alias("at"), F.lit(None).cast("string").alias("kind"), F.col("data").alias("json"))
        e = self.raw("event", "id", "session_id", "type", "time_created", "payload").where(inside & F.col("type").isin(list(KINDS)))
        kind = F.coalesce(*(F.when(F.col("type") == k, v) for k, v in KINDS.items()))
        e = e.select("id", F.lit(None).cast("string").alias("message_id"), "session_id", F.col("time_created").alias("at"), kind.alias("kind"), F.col("payload").alias("json"))
        m = self.raw("session_message", "id", "session_id", "type", "time_created", "data").where(inside)
        return e.unionAll(m.select("id", F.col("id").alias("message_id"), "session_id", F.col("time_created").alias("at"), F.col("type").alias("kind"), F.col("data").alias("json")))

    def _parts(self) -> DataFrame:
        """(event_id, session_id, ts, kind, role, data): a row for each readable part."""
        p = self["parsed"].where("data is not null")
        if self.adapter.name != "v2":
            said = self.raw("message", "id", "data").select(F.col("id").alias("message_id"), F.try_variant_get(F.try_parse_json("data"), "$.role", "string").alias("role"))
            p = p.join(said, "message_id", "left").withColumn("kind", F.try_variant_get("data", "$.type", "string"))
            return p.select("event_id", "session_id", "ts", "kind", "role", "data")
        steps = p.where(F.col("kind").isin(list(KINDS.values()))).select("event_id", "session_id", "ts", "kind", F.lit(None).cast("string").alias("role"), "data")
        users = p.where("kind = 'user'").select("event_id", "session_id", "ts", F.lit("text").alias("kind"), F.lit("user").alias("role"), "data")
        blocks = p.where("kind = 'assistant'").withColumn("blocks", F.try_variant_get("data", "$.content", "array<variant>"))
        blocks = blocks.select("event_id", "session_id", "ts", F.posexplode("blocks").alias("at", "block"))
        blocks = blocks.select(F.concat_ws("/", "event_id", F.format_string("%06d", "at")).alias("event_id"), "session_id", "ts", F.try_variant_get("block", "$.type", "string").alias("kind"), F.lit("assistant").alias("role"), F.col("block").alias("data"))
        other = p.where(~F.col("kind").isin([*KINDS.values(), "user", "assistant"])).select("event_id", "session_id", "ts", "kind", F.lit(None).cast("string").alias("role"), "data")
        # A tool's call and reasoning come as events; the blocks that repeat them don't count again.
        return steps.unionAll(users).unionAll(blocks.where("kind = 'text'")).unionAll(other)

    # ------------------------------------------------------------ what doesn't

    def _parsed(self) -> DataFrame:
        rows = self["payloads"].select(F.col("id").alias("event_id"), "message_id", "session_id", millis("at").alias("ts"), "kind", F.try_parse_json("json").alias("data"))
        return checkpoint(rows)

    def _unreadable(self) -> DataFrame:
        return self["parsed"].where("data is null").select("event_id", "session_id")

    def _metadata(self) -> DataFrame:
        """All sessions, of one id in several tables the freshest row."""
        place = "directory" if all("directory" in self.columns[t] for t in self.adapter.metadata) else None
        names = ["id", "parent_id", "title", "model", "agent", "cost", "time_created", "time_updated", *([place] if place else [])]
        tables = [self.raw(t, *names).select("id", "parent_id", "title", "model", "agent", F.col("cost").alias("stored_cost"), F.col(place).alias("project") if place else F.lit(None).cast("string").alias("project"), "time_created", "time_updated", F.lit(i).alias("_table")) for i, t in enumerate(self.adapter.metadata)]
        rows = tables[0]
        for t in tables[1:]:
            rows = rows.unionByName(t)
        if len(tables) > 1:
            rows = freshest(rows, "id", "time_updated", "_table")
        return rows.drop("_table")

    def _sessions(self) -> DataFrame:
        """Sessions updated since the window began, model as provider/model."""
        got = F.try_parse_json("model")
        model = F.concat_ws("/", F.try_variant_get(got, "$.providerID", "string"), F.try_variant_get(got, "$.id", "string"))
        rows = self["metadata"].where(F.col("time_updated") >= self.since)
        return rows.select("id", "parent_id", "title", F.coalesce(F.nullif(model, F.lit("")), F.lit("unknown")).alias("model"), "agent", "project", F.col("stored_cost").cast("decimal(18,6)").alias("stored_cost"), millis("time_created").alias("time_created"), millis("time_updated").alias("time_updated"))

    def _links(self) -> DataFrame:
        """Sessions of any age and their parents."""
        return self["metadata"].select("id", "parent_id")

    def _tree(self) -> DataFrame:
        return checkpoint(roots(self["links"]))

    def _steps(self) -> DataFrame:
        tokens = lambda path: F.coalesce(F.try_variant_get("data", f"$.tokens.{path}", "long"), F.lit(0))
        own = self["parts"].where("kind = 'step-finish'")
        own = own.select("event_id", "session_id", "ts", F.to_date("ts").alias("day"), F.lit("step").alias("tool"), F.lit("").alias("raw"), F.lit(0).alias("k"), F.try_variant_get("data", "$.cost", "double").cast("decimal(18,6)").alias("cost"), tokens("cache.read").alias("cache_read"), tokens("input").alias("fresh_input"), tokens("output").alias("output"), tokens("reasoning").alias("reasoning"), tokens("cache.write").alias("cache_write"))
        of = self["sessions"].select(F.col("id").alias("session_id"), "model", "agent")
        up = self["tree"].select(F.col("id").alias("session_id"), "root_id")
        return checkpoint(own.join(of, "session_id").join(up, "session_id"))

    def _calls(self) -> DataFrame:
        """Tool calls of counted sessions: name, arguments as JSON, whether it failed, and the skill a skill call loads."""
        own = self["parts"].where("kind = 'tool'").join(self["included"].select(F.col("id").alias("session_id")), "session_id", "left_semi")
        get = lambda path: F.try_variant_get("data", path, "string")
        failed = (get("$.state.status") == "error") | get("$.state.error").isNotNull()
        tool = get("$.tool")
        return own.select("event_id", "session_id", "ts", tool.alias("tool"), F.coalesce(F.to_json(F.try_variant_get("data", "$.state.input", "variant")), F.lit("")).alias("raw"), F.coalesce(failed, F.lit(False)).alias("failed"), F.when(tool == "skill", get("$.state.input.name")).alias("skill"), F.coalesce(get("$.state.error"), get("$.state.output"), F.lit("")).alias("result"))

    def _turns(self) -> DataFrame:
        own = self["parts"].where("kind = 'text' and role = 'user'").join(self["included"].select(F.col("id").alias("session_id")), "session_id", "left_semi")
        return own.select("event_id", "session_id", "ts", F.try_variant_get("data", "$.text", "string").alias("text")).where("text is not null")

    def _weights(self) -> DataFrame:
        """Characters of each kind of part, for what a session's context is made of."""
        get = lambda path: F.coalesce(F.length(F.try_variant_get("data", path, "string")), F.lit(0))
        of_file = F.try_variant_get("data", "$.tool", "string").isin("read", "write", "edit")
        is_tool = F.col("kind") == "tool"
        p = self["parts"].select("session_id", F.when(is_tool & of_file, get("$.state.output")).otherwise(0).alias("file"), F.when(is_tool & ~of_file, get("$.state.output")).otherwise(0).alias("result"), F.when(F.col("kind") == "text", get("$.text")).otherwise(0).alias("text"), F.when(F.col("kind") == "reasoning", get("$.text")).otherwise(0).alias("reasoning"))
        return p.groupBy("session_id").agg(*(F.floor(F.sum(c) / 4).alias(f"{c}_tokens") for c in ("file", "result", "text", "reasoning")))

    def _w(self) -> DataFrame:
        return self["steps"].join(self["included"].select(F.col("id").alias("session_id"), "parent_id"), "session_id")

    def _unflushed(self) -> DataFrame:
        return self["included"].select(F.col("id").alias("session_id")).join(self["parts"].select("session_id"), "session_id", "left_anti")

    def _repeated(self) -> DataFrame:
        from usagelens.plans.text import prompt_groups

        return prompt_groups(self["turns"].select("session_id", "text", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")), self.config).select("session_id").distinct()
