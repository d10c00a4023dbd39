"""The weekly summary of a session store: the statements that run over the tables, over a store's views, and what only a store has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.config import Config
from usagelens.functions.text import normalised
from usagelens.operators.lineage import checkpoint
from usagelens.operators.sequences import active_seconds, compacted
from usagelens.plans import catalog, report, telemetry, text
from usagelens.sources.adapters import StoreViews

#: Statements over a store's views, and the order of their rows.
FROM_STATEMENTS = {"totals": None, "daily_totals": "day", "by_model": "model", "tool_usage": "tool", "cost_outliers": "session_id", "subagent_totals": "agent", "audit_counts": None}


def seconds(a: str, b: str) -> Column:
    return F.floor(F.timestamp_diff("MICROSECOND", F.col(a), F.col(b)) / 1e6)


def top_sessions(v: StoreViews) -> DataFrame:
    """The dearest root sessions, their children's steps with them, and what an audit wants to know of them."""
    w = v["w"].where("root_id is not null")
    tokens = F.sum(F.col("cache_read") + F.col("fresh_input") + F.col("output") + F.col("reasoning") + F.col("cache_write"))
    seen = F.sum("cache_read") + F.sum("fresh_input")
    per = w.groupBy(F.col("root_id").alias("session_id")).agg(F.round(F.sum("cost").cast("double"), 6).alias("cost"), tokens.alias("tokens"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("api_call_count"), F.max((F.col("session_id") != F.col("root_id"))).alias("includes_subagents"), F.sum("cache_read").alias("cache_read"), F.sum("cache_write").alias("cache_write"), F.round(F.try_divide(F.sum("cache_read").cast("double"), seen), 6).alias("cache_efficiency"))
    top = per.orderBy(F.desc_nulls_last("cost"), "session_id").limit(v.config.top_sessions)
    own = w.select(F.col("root_id").alias("session_id"), "ts", "event_id").join(top.select("session_id"), "session_id", "left_semi")
    active = active_seconds(own, "session_id", "ts", v.config.gap_seconds, "event_id")
    of = v["metadata"].select(F.col("id").alias("session_id"), "title", "project")
    out = top.join(of, "session_id", "left").join(active, "session_id", "left").join(v["weights"], "session_id", "left")
    out = out.withColumns({"duration_seconds": seconds("first", "last"), "cost_per_active_minute": F.round(F.try_divide(F.col("cost"), F.col("active_seconds") / 60), 6)})
    return out.drop("first", "last")


def skill_usage(v: StoreViews) -> DataFrame:
    return v["calls"].where("skill is not null").groupBy("skill").agg(F.count(F.lit(1)).alias("load_count"), F.countDistinct("session_id").alias("sessions_used_in"))


def command_usage(v: StoreViews) -> DataFrame:
    said = v["turns"].select("session_id", F.regexp_extract("text", r"^/([\w-]+)", 1).alias("command")).where("command <> ''")
    return said.groupBy("command").agg(F.count(F.lit(1)).alias("call_count"), F.countDistinct("session_id").alias("sessions_used_in"))


def skill_states(v: StoreViews, skills: DataFrame) -> DataFrame:
    """(skill, loaded) of the catalog."""
    used = v["calls"].where("skill is not null").select(F.col("skill").alias("name")).distinct()
    return skills.select("name").distinct().join(used.withColumn("used", F.lit(True)), "name", "left").select(F.col("name").alias("skill"), F.coalesce("used", F.lit(False)).alias("loaded"))


def skill_pairs(skills: DataFrame, config: Config) -> DataFrame:
    """Pairs of skills by the likeness of their description and the first 200 characters of their body, names in order."""
    about = F.concat_ws(" ", normalised("description"), F.substring(normalised("body"), 1, 200))
    d = skills.select(F.lit(1).alias("all"), F.col("name").alias("key"), about.alias("prompt")).where("length(prompt) > 0")
    return text.ratio_pairs(d, "all", config.similarity).where("x < y").select(F.col("x").alias("first"), F.col("y").alias("second"), F.round("similarity", 6).alias("similarity"))


def subagents(v: StoreViews) -> DataFrame:
    """Child sessions by agent, those without a root too."""
    own = v["w"].where("parent_id is not null")
    return own.groupBy("agent").agg(F.countDistinct("session_id").alias("session_count"), F.round(F.sum("cost").cast("double"), 6).alias("cost"))


def warnings(v: StoreViews) -> DataFrame:
    """(session_id, message) of all that a reader should know."""
    c = v.config
    sessions, w = v["sessions"], v["w"]
    of = lambda df, message, id="id": df.select(F.col(id).cast("string").alias("session_id"), message.alias("message"))
    from_parts = w.groupBy("session_id").agg(F.sum("cost").cast("double").alias("cost"))
    gap = F.abs(F.try_divide(F.col("cost") - F.col("stored_cost").cast("double"), F.col("stored_cost").cast("double")))
    checked = v["included"].select(F.col("id").alias("session_id"), "stored_cost", "time_created").where(F.col("time_created") >= F.lit(c.start).cast("timestamp_ntz")).join(from_parts, "session_id").where(gap > c.cross_check_gap)
    few = w.agg(F.countDistinct("session_id").alias("n")).where(F.col("n") < c.min_sessions)
    parts = [
        of(sessions.where(F.col("time_updated") >= F.lit(c.settled).cast("timestamp_ntz")), F.lit("active session left out")),
        of(w.where("cost is null").groupBy("session_id", "model").agg(F.count(F.lit(1)).alias("n")), F.concat(F.lit("missing-pricing:"), "model", F.lit(", steps: "), F.col("n").cast("string")), "session_id"),
        of(v["unreadable"].groupBy("session_id").agg(F.count(F.lit(1)).alias("n")), F.concat(F.lit("unreadable parts: "), F.col("n").cast("string")), "session_id"),
        of(checked, F.lit("steps and the stored cost differ"), "session_id"),
        of(v["unflushed"], F.lit("unflushed: no parts are stored"), "session_id"),
        of(v["tree"].where("state in ('orphan', 'cycle')").join(v["included"].select("id"), "id", "left_semi"), F.lit("child without a root")),
        few.select(F.lit(None).cast("string").alias("session_id"), F.concat(F.lit("few sessions for outliers: "), F.col("n").cast("string")).alias("message")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def transcript(v: StoreViews, id: str, children: bool) -> DataFrame:
    """(session_id, ts, event_id, kind, tool, args, result, text, replaced) of a session, with those below it if asked for; repeated failing calls are a marker."""
    wanted = v["tree"].where((F.col("id") == id) | ((F.col("root_id") == id) & F.lit(children))).select(F.col("id").alias("session_id"))
    get = lambda path: F.try_variant_get("data", path, "string")
    own = v["parts"].where("kind in ('tool', 'text')").join(wanted, "session_id", "left_semi")
    failed = F.coalesce((get("$.state.status") == "error") | get("$.state.error").isNotNull(), F.lit(False))
    rows = own.select("session_id", "ts", "event_id", F.when(F.col("kind") == "tool", "tool").otherwise(F.coalesce("role", F.lit("text"))).alias("said"), get("$.tool").alias("tool"), F.to_json(F.try_variant_get("data", "$.state.input", "variant")).alias("args"), F.coalesce(get("$.state.error"), get("$.state.output")).alias("result"), get("$.text").alias("text"), failed.alias("failed"))
    # Turns that aren't failing calls never make a run: each is told apart by its own id.
    rows = rows.withColumns({"_tool": F.when(F.col("failed"), F.col("tool")).otherwise(F.col("event_id")), "_args": F.when(F.col("failed"), normalised("args")), "_result": F.when(F.col("failed"), normalised("result"))})
    return compacted(rows, "session_id", ("ts", "event_id"), ["_tool", "_args", "_result"]).drop("_tool", "_args", "_result")


def frames(v: StoreViews, skills: DataFrame | None) -> dict[str, tuple[DataFrame, list]]:
    """Each section's rows and their order."""
    statements, shared = telemetry.split(telemetry.statements(v.config))
    v["w"] = checkpoint(v["w"])
    out = {n: (catalog.planned(v, statements[n], shared), [by] if by else []) for n, by in FROM_STATEMENTS.items()}
    out["subagent_totals"] = (subagents(v), ["agent"])
    out["cost_outliers"] = (out["cost_outliers"][0], [F.desc("z"), "session_id"])
    out["top_sessions"] = (top_sessions(v), [F.desc_nulls_last("cost"), "session_id"])
    out["skill_usage"], out["command_usage"] = (skill_usage(v), ["skill"]), (command_usage(v), ["command"])
    said = v["turns"].select("session_id", "text", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    repeats = text.prompt_groups(said, v.config).select(F.col("preview").alias("normalized_preview"), "count", "session_id", "avg_chars")
    out["user_prompt_repeats"] = (repeats.orderBy(F.desc("count"), "session_id", "normalized_preview").limit(v.config.repeats_cap), [F.desc("count"), "session_id", "normalized_preview"])
    if skills is not None:
        states = skill_states(v, skills)
        out["skills_never_loaded"] = (states.where("not loaded").select("skill"), ["skill"])
        out["skill_catalog_count"] = (states.agg(F.count(F.lit(1)).alias("skill_catalog_count")), [])
        pairs = skill_pairs(skills, v.config)
        out["skill_similar_pairs"] = (pairs.orderBy(F.desc("similarity"), "first", "second").limit(v.config.similar_pairs), [F.desc("similarity"), "first", "second"])
    return out


def summary(v: StoreViews, skills: DataFrame | None = None) -> dict:
    """The document of a store's window."""
    c, document, omitted = v.config, {}, {}
    for name, (df, order) in frames(v, skills).items():
        document[name], more = report.rows_in(df, order)
        if more:
            omitted[name] = more
    said = warnings(v)
    if skills is not None:
        said = said.unionAll(skills.where("warning is not null").select(F.lit(None).cast("string").alias("session_id"), F.concat("path", F.lit(": "), "warning").alias("message")))
    document["warnings"], more = report.rows_in(said, ["session_id", "message"], c.warnings_cap)
    if more:
        omitted["warnings"] = more
    return {"schema_version": 2, "store": v.adapter.name, "period": {"start": c.start, "end": c.run_time, "hours": 24 * c.lookback_days}, "generated_at": c.run_time, "omitted": omitted} | document


def run_frames(v: StoreViews, document: dict, skills: DataFrame | None) -> dict[str, DataFrame]:
    """What later runs need of this one."""
    days = v["w"].groupBy(F.col("day").cast("string").alias("day")).agg(F.round(F.sum("cost").cast("double"), 6).alias("cost"))
    out = {"totals": totals_frame(v.spark, document), "days": days.where("cost is not null")}
    return out | ({"skills": skill_states(v, skills)} if skills is not None else {})


def totals_frame(spark: SparkSession, document: dict) -> DataFrame:
    t, p = document["totals"][0], document["period"]
    row = (p["start"], p["end"], p["hours"], t["cost"], t["tokens"], t["hit_rate"], t["session_count"])
    return spark.createDataFrame([row], "start string, end string, hours int, cost double, tokens long, hit_rate double, session_count long")


def table_run_frames(spark: SparkSession, data: str, document: dict, config: Config) -> dict[str, DataFrame]:
    """The same for a run over a folder of tables: skills are parts, lint is the line items' flags."""
    have = catalog.queries(config)
    part, silent = spark.read.parquet(f"{data}/part.parquet").select("p_partkey"), have["never_loaded"](spark, data).select("p_partkey", F.lit(False).alias("loaded"))
    skills = part.join(silent, "p_partkey", "left").select(F.col("p_partkey").cast("string").alias("skill"), F.coalesce("loaded", F.lit(True)).alias("loaded"))
    lint = have["lint_by_rule"](spark, data).where("violations > 0").select("rule", "violations")
    days = have["daily_totals"](spark, data).select("day", "cost").where("cost is not null")
    return {"totals": totals_frame(spark, document), "days": days, "skills": skills, "lint": lint}
