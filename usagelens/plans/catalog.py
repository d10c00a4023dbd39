"""All queries of the telemetry side by name, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.config import Config
from usagelens.operators.lineage import checkpoint
from usagelens.operators.robust import ranked, spread
from usagelens.operators.sequences import Sequence, compacted, with_previous
from usagelens.plans import independent, telemetry, text
from usagelens.sources.proxy import Views, ctes, views

_NAME = re.compile(r"\{(\w+)\}")
_SECONDS = re.compile(r"@seconds\(((?:[^()]|\([^()]*\))*?), ((?:[^()]|\([^()]*\))*?)\)")


def planned(have: Views, statement: str, shared: dict[str, str] | None = None) -> DataFrame:
    """A plan over the canonical views it names. A shared frame (a row a session, run or day) is made and written once for the query."""
    shared = telemetry.SHARED if shared is None else shared
    made: dict[str, DataFrame] = {}

    def frame(name: str) -> DataFrame:
        if name == "gaps":
            return checkpoint(with_previous(have["w"], "session_id", ("ts", "event_id"), {"prev": "ts"}))
        if name in telemetry.SPREADS:
            values, value = telemetry.SPREADS[name]
            return spread(plan(values), value)
        return checkpoint(plan(shared[name]))

    def plan(text: str) -> DataFrame:
        names = set(_NAME.findall(text))
        for n in names & set(shared):
            if n not in made:
                made[n] = frame(n)
        text = _SECONDS.sub(r"(timestampdiff(MICROSECOND, \1, \2) / cast(1000000 as double))", text)
        return have.spark.sql(text, **{n: made[n] if n in shared else have[n] for n in names})

    return plan(statement)


def spark_sql(spark: SparkSession, sf_dir: str, statement: str, config: Config = Config(), shared: dict[str, str] | None = None) -> DataFrame:
    return planned(views(spark, sf_dir, config), statement, shared)


def duckdb_sql(statement: str, config: Config = Config(), shared: dict[str, str] | None = None) -> str:
    shared = telemetry.SHARED if shared is None else shared
    while any(n in shared for n in _NAME.findall(statement)):
        statement = _NAME.sub(lambda m: f"({shared[m[1]]})" if m[1] in shared else m[0], statement)
    statement = _SECONDS.sub(r"(date_diff('microsecond', \1, \2) / cast(1000000 as double))", statement)
    return ctes(config) + _NAME.sub(r"\1", statement).replace("timestamp_ntz '", "timestamp '")


def rank_top_sessions(have: Views, statement: str, shared: dict[str, str]) -> DataFrame:
    """All sessions by cost, the dearest first, with their place: by ranges of cost, not in one task."""
    rows = planned(have, statement, shared)
    return ranked(rows.select("session_id", "cost"), F.desc("cost"), F.asc("session_id"))


def compact_repeats(have: Views) -> DataFrame:
    """Of three or more calls in a row with one tool and similar arguments (in this proxy the half of k): the first, a marker with N - 2, the last."""
    calls = have["steps"].select("session_id", "event_id", "ts", "tool", F.floor(F.col("k") / 50).alias("args"))
    return compacted(calls, "session_id", ("ts", "event_id"), ["tool", "args"]).select("session_id", "event_id", "tool", "kind", "replaced")


def session_transcript(have: Views) -> DataFrame:
    rows = Sequence(have["steps"].select("root_id", "ts", "event_id", "session_id", "tool", "raw"), "root_id", "ts", "event_id").places("line")
    return rows.select("root_id", "line", "session_id", (F.col("session_id") != F.col("root_id")).alias("child"), "tool", F.col("raw").alias("args"), F.when(F.col("tool") == "error", "error").otherwise("ok").alias("result"))


def transcript_rows(have: Views) -> DataFrame:
    return Sequence(have["conversations"], "conv_id", "turn").places("line").select("conv_id", "line", "role", "text")


def first_turns(have: Views) -> DataFrame:
    """What a conversation's user says first, and the command it calls, if any."""
    first = have["conversations"].where("role = 'user'").groupBy("conv_id").agg(F.min_by(F.struct("turn", "text"), "turn").alias("t")).select("conv_id", "t.*")
    return first.withColumn("command", F.nullif(F.regexp_extract("text", "^/([a-zA-Z0-9_-]+)", 1), F.lit("")))


#: Queries whose statement is DuckDB's alone: Spark takes sequences by ranges.
BY_RANGES = (compact_repeats, session_transcript, transcript_rows, first_turns)


def session_cost_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, telemetry.QUERIES["session_cost_scores"])


def queries(config: Config = Config()) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries under a configuration."""
    statements, shared = telemetry.split(telemetry.statements(config))
    out = {k: (lambda s, d, q=q: spark_sql(s, d, q, config, shared)) for k, q in statements.items()}
    out["rank_top_sessions"] = lambda s, d: rank_top_sessions(views(s, d, config), statements["session_usage"], shared)
    out |= {f.__name__: (lambda s, d, f=f: f(views(s, d, config))) for f in BY_RANGES}
    return out | {k: (lambda s, d, f=f: f(views(s, d, config))) for k, f in text.PLANS.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB's statements: those of ``independent`` are written from the contract, the others are the plans' own text over views written anew."""
    return {k: duckdb_sql(q) for k, q in telemetry.QUERIES.items()} | text.SQL | independent.SQL
