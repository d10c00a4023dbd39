"""Thresholds and the analysis window."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from datetime import datetime, timedelta
from pathlib import Path


@dataclass(frozen=True)
class Config:
    run_time: str = "2024-01-29 06:00:00"
    lookback_days: int = 7
    active_grace_minutes: int = 10
    self_title: str = "session 7"
    top_sessions: int = 5
    similar_pairs: int = 5
    repeats_cap: int = 20
    warnings_cap: int = 50
    per_source_cap: int = 50
    audit_max_sessions: int = 8
    draft_cap: int = 3
    outlier_z: float = 3.0
    outlier_floor: float = 1.0
    min_sessions: int = 15
    cross_check_gap: float = 0.25
    gap_seconds: int = 300
    z_cap: float = 10.0
    weekly_budget: float = 50_000.0
    monthly_budget: float = 150_000.0
    cache_hit_min: float = 0.6
    cost_wow_pct: float = 0.15
    lint_max: int = 100
    spike_z: float = 3.0
    silent_runs: int = 4
    runs_scanned: int = 8
    commit_cap: int = 10
    #: Rows of a document's section; 0: all.
    section_rows: int = 1000
    #: ``category:target`` of findings that are put off.
    ignored_findings: tuple[str, ...] = ("cache:6", "repeat:22", "outlier:19", "retire:17")
    #: Hours of the windows of the runs, newest first; they end a week apart.
    run_hours: tuple[int, ...] = (168, 168, 168, 168, 168)
    loop_cost_per_minute: float = 0.5
    cache_gap: float = 0.2
    model_fold_share: float = 0.05
    subagent_share: float = 0.10
    similarity: float = 0.8
    near_duplicate: float = 0.9
    repeat_min_length: int = 80
    repeat_min_count: int = 2  # three in production; the tables at hand have few groups of three in a source
    keywords: tuple[str, ...] = ("license", "copyright", "the", "secret")
    #: Rules whose changes may be applied, folders they may touch, and files a run may change.
    auto_fix_rules: tuple[str, ...] = ()
    fix_folders: tuple[str, ...] = ("skills", "commands")
    auto_fix_max_files: int = 5
    #: The catalog tables lie so many years before the sessions; their months move with the anchor.
    catalog_years_back: int = 24
    review_window_weeks: int = 4
    release_keywords: tuple[str, ...] = ("skill", "cache", "context", "compaction")
    least_stars: int = 5
    projection: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"strict": ("/en/**",), "advisory": ("/en/**", "/fr/**")})

    @property
    def start(self) -> str:
        return self.before(timedelta(days=self.lookback_days))

    @property
    def settled(self) -> str:
        return self.before(timedelta(minutes=self.active_grace_minutes))

    @property
    def runs(self) -> list[tuple[str, str, int]]:
        """(from, to, hours) of each run."""
        return [(self.before(timedelta(days=7 * i, hours=h)), self.before(timedelta(days=7 * i)), h) for i, h in enumerate(self.run_hours)]

    def month(self, back: int = 0, years_back: int | None = None) -> str:
        """The first instant of the anchor's month in the catalog tables, or of one so many months before (after, if negative)."""
        t = datetime.fromisoformat(self.run_time)
        n = (t.year - (self.catalog_years_back if years_back is None else years_back)) * 12 + t.month - 1 - back
        return f"{n // 12:04d}-{n % 12 + 1:02d}-01 00:00:00"

    def before(self, by: timedelta) -> str:
        return str(datetime.fromisoformat(self.run_time) - by)

    @classmethod
    def read(cls, path: str | None = None, anchor: str | None = None, lookback_days: int | None = None) -> Config:
        """The defaults, then a JSON file of thresholds, then the window asked for. An unknown key is an error."""
        given = json.loads(Path(path).read_text(encoding="utf-8")) if path else {}
        known = {f.name for f in fields(cls)}
        if unknown := set(given) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        given = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}
        if anchor:
            given["run_time"] = str(datetime.fromisoformat(anchor.replace("Z", "+00:00")).replace(tzinfo=None))
        if lookback_days is not None:
            if lookback_days < 1:
                raise ValueError("lookback_days must be 1 or more")
            given |= {"lookback_days": lookback_days, "run_hours": (24 * lookback_days, *cls.run_hours[1:])}
        return cls(**given)
