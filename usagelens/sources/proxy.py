"""Canonical telemetry views over the star-schema tables: sessions, steps, and the slice in the window.

Every analytic reads these; another store only needs a reader that builds the same views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.config import Config
from usagelens.functions.text import normalised
from usagelens.operators.trees import roots

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()
TOKENS = {"cache_read": "view", "fresh_input": "click", "output": "signup", "reasoning": "error", "cache_write": "purchase"}


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


class Views(dict):
    """Frames by name; a table is opened, and a view built, when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, config: Config):
        super().__init__()
        self.spark, self.sf_dir, self.config = spark, sf_dir, config

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet") if name in TABLES else getattr(self, f"_{name}")()
        return self[name]

    def _parts(self) -> DataFrame:
        raw = F.when(F.col("event_id") % 97 == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
        named = self["events"].select("event_id", F.col("user_id").alias("session_id"), "ts", F.to_date("ts").alias("day"), F.col("event_type").alias("tool"), "value", raw.alias("raw"))
        return named.withColumn("k", F.from_json("raw", "k int")["k"])

    def _steps(self) -> DataFrame:
        root = F.when(F.col("session_id") % 10 != 0, F.floor(F.col("session_id") / 10) * 10).otherwise(F.col("session_id"))
        return self["parts"].where("k is not null").select(
            "event_id", "session_id", root.alias("root_id"), "ts", "day", "tool", "raw", "k",
            F.when(F.col("k") != 0, F.col("value").cast("decimal(18,6)")).alias("cost"),
            *[F.when(F.col("tool") == v, F.col("k")).otherwise(0).alias(c) for c, v in TOKENS.items()],
            F.concat(F.lit("p"), F.col("session_id") % 2, F.lit("/m"), F.col("session_id") % 5).alias("model"),
            F.concat(F.lit("agent"), F.col("session_id") % 3).alias("agent"),
        )

    def _sessions(self) -> DataFrame:
        seen = self["events"].where(F.col("ts") <= ntz(self.config.run_time)).groupBy(F.col("user_id").alias("id"))
        sessions = seen.agg(F.min("ts").alias("time_created"), F.max("ts").alias("time_updated"), F.sum(F.col("value").cast("decimal(18,6)")).alias("stored_cost"))
        return sessions.select("id", F.when(F.col("id") % 10 != 0, F.floor(F.col("id") / 10) * 10).alias("parent_id"), F.concat(F.lit("session "), "id").alias("title"), "time_created", "time_updated", "stored_cost")

    def _included(self) -> DataFrame:
        c = self.config
        return self["sessions"].where((F.col("time_updated") >= ntz(c.start)) & (F.col("time_updated") < ntz(c.settled)) & ~F.col("title").eqNullSafe(c.self_title))

    def _w(self) -> DataFrame:
        inside = F.col("ts").between(ntz(self.config.start), ntz(self.config.run_time))
        return self["steps"].where(inside).join(self["included"].select(F.col("id").alias("session_id"), "parent_id"), "session_id")

    def _calls(self) -> DataFrame:
        """Tool calls of the window; here each step is one."""
        return self["w"]

    def _turns(self) -> DataFrame:
        """What users say in the window; here the signups and their payload."""
        return self["w"].where("tool = 'signup'").select("event_id", "session_id", "ts", F.col("raw").alias("text"))

    def _repeated(self) -> DataFrame:
        """Sessions in which a prompt is said again, word for word after normalisation."""
        said = self["turns"].groupBy("session_id", normalised("text")).agg(F.count(F.lit(1)).alias("n"))
        return said.where(F.col("n") >= self.config.repeat_min_count).select("session_id").distinct()

    def _links(self) -> DataFrame:
        """Sessions and their parents; here an id without its last digit is the parent's, there or not."""
        return self["sessions"].select("id", F.when(F.col("id") >= 10, F.floor(F.col("id") / 10)).alias("parent_id"))

    def _tree(self) -> DataFrame:
        return roots(self["links"])


def views(spark: SparkSession, sf_dir: str, config: Config = Config()) -> Views:
    return Views(spark, sf_dir, config)


def ctes(config: Config = Config()) -> str:
    """The same views as SQL; ``tree`` by a recursive walk down from the roots, and what it doesn't reach by a walk up."""
    tokens = ", ".join(f"case when event_type = '{v}' then k else 0 end {c}" for c, v in TOKENS.items())
    return f"""with recursive parts as (
  select event_id, user_id session_id, ts, cast(ts as date) as day, event_type, event_type tool, value,
    case when event_id % 97 = 0 then substr(props, 1, 3) else props end raw,
    case when event_id % 97 = 0 then null else cast(regexp_extract(props, '[0-9]+') as int) end k from events),
steps as (
  select event_id, session_id, case when session_id % 10 <> 0 then session_id - session_id % 10 else session_id end root_id, ts, day, tool, raw, k,
    case when k <> 0 then cast(value as decimal(18,6)) end cost, {tokens},
    'p' || (session_id % 2) || '/m' || (session_id % 5) model, 'agent' || (session_id % 3) agent from parts where k is not null),
sessions as (
  select user_id id, case when user_id % 10 <> 0 then user_id - user_id % 10 end parent_id, 'session ' || user_id title, min(ts) time_created, max(ts) time_updated,
    sum(cast(value as decimal(18,6))) stored_cost from events where ts <= timestamp '{config.run_time}' group by user_id),
included as (
  select * from sessions where time_updated >= timestamp '{config.start}' and time_updated < timestamp '{config.settled}' and title is distinct from '{config.self_title}'),
w as (
  select s.*, i.parent_id from steps s join included i on s.session_id = i.id where s.ts between timestamp '{config.start}' and timestamp '{config.run_time}'),
calls as (select * from w),
repeated as (
  select distinct session_id from (select session_id, lower(trim(regexp_replace(regexp_replace(raw, '\\s+', ' ', 'g'), '[.!?,;: ]+$', ''))) said from w where tool = 'signup') t
  group by session_id, said having count(*) >= {config.repeat_min_count}),
links as (select id, case when id >= 10 then id // 10 end parent_id from sessions),
below as (
  select id, id root_id from links where parent_id is null
  union all select l.id, b.root_id from below b join links l on l.parent_id = b.id),
tree as (select l.id, b.root_id, case when b.id is null then 'orphan' when b.root_id = l.id then 'root' else 'child' end state from links l left join below b on b.id = l.id)
"""
