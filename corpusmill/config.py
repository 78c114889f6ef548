"""Settings of a corpus build; a wrong value or an unknown key raises ValueError with one line."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields
from datetime import date, timedelta
from pathlib import Path

LANGUAGES = ("Python", "Java", "JavaScript", "C++")
GRANULARITIES = ("function", "class")
FORMATS = ("jsonl", "parquet", "both")
SECRETS = ("github_token", "hf_token")
#: Days before today at which a build ends if nothing else is said.
RECENT_DAYS = 30


@dataclass
class Config:
    language: str
    start_date: date
    end_date: date
    min_stars: int = 10
    min_contributors: int = 1
    max_repos: int | None = None
    max_functions: int | None = None
    max_classes: int | None = None
    granularity: list[str] = field(default_factory=lambda: list(GRANULARITIES))
    engineered_only: bool = False
    annotate_llm_score: bool = False
    export_ast: bool = False
    deduplicate: bool = False
    dedup_threshold: float = 0.8
    output_dir: str = "./corpus_output"
    export_format: str = "jsonl"
    github_token: str | None = field(default=None, repr=False)
    hf_token: str | None = field(default=None, repr=False)
    wait_for_rate_limit: bool = False

    def __post_init__(self) -> None:
        wrong = []
        for name in ("start_date", "end_date"):
            if isinstance(v := getattr(self, name), str):
                try:
                    setattr(self, name, date.fromisoformat(v))
                except ValueError:
                    wrong.append(f"{name}: not a date: {v}")
        if not wrong and self.end_date < self.start_date:
            wrong.append("end_date: before start_date")
        if self.language not in LANGUAGES:
            wrong.append(f"language: must be one of {', '.join(LANGUAGES)}")
        if not self.granularity or not set(self.granularity) <= set(GRANULARITIES):
            wrong.append("granularity: at least one of function, class")
        if self.export_format not in FORMATS:
            wrong.append(f"export_format: must be one of {', '.join(FORMATS)}")
        for name, least in (("min_stars", 0), ("min_contributors", 1), ("max_repos", 1), ("max_functions", 1), ("max_classes", 1)):
            v = getattr(self, name)
            if v is None and name.startswith("max_"):
                continue
            if not isinstance(v, int) or isinstance(v, bool) or v < least:
                wrong.append(f"{name}: must be {'null or ' if name.startswith('max_') else ''}an integer of at least {least}, got {v}")
        if not isinstance(self.dedup_threshold, int | float) or not 0 <= self.dedup_threshold <= 1:
            wrong.append(f"dedup_threshold: must lie in 0 to 1, got {self.dedup_threshold}")
        if wrong:
            raise ValueError("; ".join(wrong))

    @classmethod
    def parse(cls, raw: dict) -> Config:
        if unknown := sorted(set(raw) - {f.name for f in fields(cls)}):
            raise ValueError(f"unknown keys: {', '.join(unknown)}")
        if missing := [k for k in ("language", "start_date", "end_date") if k not in raw]:
            raise ValueError(f"missing keys: {', '.join(missing)}")
        return cls(**raw)

    @classmethod
    def read(cls, path: str) -> Config:
        return cls.parse(json.loads(Path(path).read_text()))

    def shown(self) -> dict:
        """Without secrets, dates as text."""
        return {k: v.isoformat() if isinstance(v, date) else v for k, v in asdict(self).items() if k not in SECRETS}

    def with_environment(self) -> Config:
        """Tokens that the settings leave open come from the environment."""
        self.github_token = self.github_token or os.environ.get("GITHUB_TOKEN") or None
        self.hf_token = self.hf_token or os.environ.get("HF_TOKEN") or None
        return self


def default_end(today: date | None = None) -> date:
    return (today or date.today()) - timedelta(days=RECENT_DAYS)


def cap_or_none(value: int) -> int | None:
    """A form's 0 stands for no cap."""
    return value or None
