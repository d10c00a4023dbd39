"""What runs leave for later ones: dated partitions, the last run of a date wins, and the insights drawn from them.

``out/history`` holds ``totals`` (one row a run), ``days``, ``skills`` (whether each was loaded) and, where a digest is at hand, ``lint``.
A run looks back by partition: only the dates it asks for are read.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.config import Config
from usagelens.operators.robust import SCALE, spread
from usagelens.plans import report
from usagelens.sources.files import append_history

SCHEMAS = {
    "totals": "start string, end string, hours int, cost double, tokens long, hit_rate double, session_count long",
    "days": "day string, cost double",
    "skills": "skill string, loaded boolean",
    "lint": "rule string, violations long",
}


class History:
    """The partitions of an output folder."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.root = spark, f"{out}/history"

    def write(self, run_date: str, frames: dict[str, DataFrame]) -> None:
        """A run's frames; those of another run of that date go, also where there is no row now."""
        for name, kind in SCHEMAS.items():
            rows = frames.get(name)
            if rows is None:
                rows = self.spark.createDataFrame([], kind)
            fields = self.spark.createDataFrame([], kind).schema.fields
            rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields), F.lit(run_date).alias("run_date"))
            append_history(rows, f"{self.root}/{name}", run_date)

    def table(self, name: str) -> DataFrame:
        """All runs' rows; none if nothing was written yet."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        schema = SCHEMAS[name] + ", run_date string"
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def dates(self, until: str, most: int, before: bool = True) -> list[str]:
        """The latest dates of runs strictly before (or up to) a date, newest first."""
        d = F.col("run_date")
        rows = self.table("totals").where(d < until if before else d <= until).select("run_date").distinct()
        return [r.run_date for r in rows.orderBy(F.desc("run_date")).limit(most).collect()]

    def of(self, name: str, dates: list[str]) -> DataFrame:
        return self.table(name).where(F.col("run_date").isin(dates))


def deltas(now: dict, before: dict | None) -> dict:
    """Changes against the run before: null without one, and for volumes where the windows' hours differ by more than one."""
    out: dict = {"cost_wow_pct": None, "total_tokens_delta_pct": None, "cache_hit_rate_delta": None, "_warnings": []}
    if before is None:
        return out
    if now["hit_rate"] is not None and before["hit_rate"] is not None:
        out["cache_hit_rate_delta"] = round(now["hit_rate"] - before["hit_rate"], 6)
    if abs(now["hours"] - before["hours"]) > 1:
        out["_warnings"].append(f"window before ({before['hours']} h) and now ({now['hours']} h): volumes aren't compared")
        return out
    for name, key in (("cost_wow_pct", "cost"), ("total_tokens_delta_pct", "tokens")):
        a, b = now[key], before[key]
        out[name] = round(100 * (a - b) / b, 6) if a is not None and b else None
    return out


def spikes(h: History, today: str, earlier: list[str], config: Config) -> tuple[dict | None, int]:
    """The strongest day of the run against the days of the four runs before it, and how many days those are."""
    base = h.of("days", earlier[:4]).dropDuplicates(["day"]).select("cost")
    n = base.count()
    s = spread(base, "cost").first()
    if s.med is None:
        return None, 0
    z = F.when((F.lit(s.mad) == 0) & (F.col("cost") > s.med), F.lit(config.z_cap)).otherwise(F.try_divide(F.col("cost") - s.med, F.lit(SCALE * s.mad)))
    top = h.of("days", [today]).select("day", z.alias("z")).where("z is not null").orderBy(F.desc("z"), "day").first()
    if top is None:
        return None, n
    return {"day": top.day, "observed": round(min(top.z, config.z_cap), 6), "note": "MAD near 0, z capped" if s.mad == 0 or top.z > config.z_cap else None}, n


def streaks(h: History, dates: list[str]) -> DataFrame:
    """(skill, streak): of the catalog of the newest date, on how many of the dates in a row, newest first, each was there and silent."""
    at = h.spark.createDataFrame([(d, i) for i, d in enumerate(dates)], "run_date string, i int")
    rows = h.of("skills", dates).join(F.broadcast(at), "run_date")
    silent = F.sort_array(F.collect_set(F.when(~F.col("loaded"), F.col("i"))))
    return rows.groupBy("skill").agg(silent.alias("silent"), F.min("i").alias("newest")).where("newest = 0").select("skill", F.size(F.filter("silent", lambda x, k: x == k)).cast("long").alias("streak"))


def lint_deltas(h: History, today: str, before: str | None) -> dict | None:
    now = h.of("lint", [today])
    if now.isEmpty():
        return None
    old = h.of("lint", [before] if before else [])
    both = now.select("rule", F.col("violations").alias("a")).join(old.select("rule", F.col("violations").alias("b")), "rule", "full")
    return {r.rule: r.delta for r in both.select("rule", (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("delta")).orderBy("rule").collect()}


def insights(h: History, config: Config, overlapping: DataFrame | None = None, pairs: list[dict] = ()) -> dict:
    """Deltas, alerts and maintenance of the run of the anchor's date, from what was written. ``overlapping``: (skill) of a linter's trigger overlaps."""
    today = config.run_time[:10]
    dates = h.dates(today, config.runs_scanned, before=False)
    if today not in dates:
        raise LookupError(f"no run of {today}")
    earlier = [d for d in dates if d != today]
    rows = {r.run_date: r.asDict() for r in h.of("totals", dates[:2]).collect()}
    now, before = rows[today], rows.get(earlier[0]) if earlier else None
    change = deltas(now, before)
    set_of = lambda d, loaded: h.of("skills", [d]).where(F.col("loaded") == loaded).select("skill")
    change["skills"] = {"newly_loaded": [], "newly_silent": []}
    if before is not None:
        for name, a, b in (("newly_loaded", today, earlier[0]), ("newly_silent", earlier[0], today)):
            change["skills"][name] = [r["skill"] for r in report.rows_in(set_of(a, True).subtract(set_of(b, True)), ["skill"])[0]]
    change["lint_violations_delta_by_rule"] = lint_deltas(h, today, earlier[0] if earlier else None)
    if change["lint_violations_delta_by_rule"] is None:
        change["_warnings"].append("no digest: lint isn't compared")

    month = str(date.fromisoformat(today) - timedelta(days=30))
    monthly = h.table("totals").where((F.col("run_date") > month) & (F.col("run_date") <= today)).agg(F.sum("cost")).first()[0]
    spike, days = spikes(h, today, earlier, config)
    lint = h.of("lint", [today]).agg(F.sum("violations")).first()[0]
    watched = [
        ("weekly_budget_usd", config.weekly_budget, now["cost"], "high", lambda x, t: x > t),
        ("monthly_budget_usd", config.monthly_budget, monthly, "high", lambda x, t: x > t),
        ("daily_spike_z_min", config.spike_z, spike and spike["observed"], "medium", lambda x, t: x >= t),
        ("cache_hit_rate_min", config.cache_hit_min, now["hit_rate"], "medium", lambda x, t: x < t),
        ("cost_wow_pct_max", 100 * config.cost_wow_pct, change["cost_wow_pct"], "medium", lambda x, t: x > t),
        ("lint_violations_max", config.lint_max, lint, "medium", lambda x, t: x > t),
    ]
    alerts = [{"rule": n, "threshold": t, "observed": round(x, 6), "severity": s} | ({"note": spike["note"]} if n == "daily_spike_z_min" and spike["note"] else {}) for n, t, x, s, over in watched if x is not None and over(x, t)]

    lasting = streaks(h, dates)
    quiet = lasting.where(F.col("streak") >= config.silent_runs).where(~F.concat(F.lit("retire:"), "skill").isin(list(config.ignored_findings) or [""]))
    if overlapping is not None:
        quiet = quiet.join(overlapping.select("skill").distinct().withColumn("_over", F.lit(True)), "skill", "left")
    severity = F.when(F.col("_over"), "high").otherwise("medium") if overlapping is not None else F.lit("medium")
    found, omitted = report.rows_in(quiet.select("skill", "streak", severity.alias("severity")), ["skill"])
    findings = [{"session_id": None, "category": "retire-candidate", "severity": r["severity"], "description": f"{r['skill']}: not loaded on {r['streak']} runs in a row", "recommendation_type": "skill-maintenance", "target": r["skill"]} for r in found]
    findings += [{"session_id": None, "category": "merge-candidate", "severity": "medium", "description": f"{p['first']} and {p['second']} are alike: {p['similarity']}", "recommendation_type": "skill-maintenance", "target": p["first"]} for p in pairs]
    stats = lasting.agg(F.count(F.lit(1)).alias("n")).first()
    longest = {r["skill"]: r["streak"] for r in report.rows_in(lasting.where("streak > 0"), ["skill"])[0]}
    return {
        "schema_version": 1, "period": {"start": now["start"], "end": now["end"]}, "previous_run_date": earlier[0] if earlier else None, "generated_at": config.run_time,
        "deltas": change, "alerts": alerts,
        "maintenance": {"findings": findings, "omitted": omitted, "stats": {"runs_scanned": len(dates), "skills_in_catalog": stats.n, "never_loaded_consecutive": longest, "spike_baseline_days": days}},
    }
