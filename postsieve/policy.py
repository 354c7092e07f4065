"""Settings that steer every operator.

A policy is a frozen value built once on the driver.  Keyword lists in it are
turned into literal patterns while a plan is built, so executors never see the
policy object itself.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

# Default keyword lists and limits.
DEFAULT_ROLE_TYPES = (
    "internship", "praktikum", "praktikant", "werkstudent", "working student",
    "research assistant", "studentische hilfskraft", "hiwi", "shk",
)
DEFAULT_DOMAINS = (
    "machine learning", "deep learning", "data science", "data analysis",
    "computer vision", "nlp", "llm", "generative ai", "mlops", "devops",
    "ai research", "ai engineering",
)
DEFAULT_MUST_HAVE = (
    "python", "ml", "ai", "data", "machine learning", "deep learning", "nlp",
    "llm", "computer vision",
)
DEFAULT_EXCLUDE = (
    "senior", "lead", "permanent", "unbefristet", "full time manager",
    "director", "principal", "staff engineer", "5+ years",
    "3+ years experience",
)
DEFAULT_LOCATIONS = (
    "Germany", "Remote", "Berlin", "München", "Munich", "Hamburg", "Köln",
    "Cologne", "Frankfurt", "Stuttgart", "Düsseldorf", "Deutschland",
)


def number(settings: Mapping[str, Any], key: str, default: float) -> float:
    """Numeric setting; an explicit 0 is kept, anything unreadable is the default."""
    try:
        return float(settings[key])
    except (KeyError, TypeError, ValueError):
        return default


@dataclass(frozen=True)
class Weights:
    semantic: float = 35.0
    role: float = 25.0
    domain: float = 25.0
    recency: float = 8.0
    language: float = 7.0
    german_penalty: float = 20.0
    exclude_penalty: float = 15.0
    sim_floor: float = 0.15
    sim_ceil: float = 0.60

    @staticmethod
    def of(block: Mapping[str, Any] | None) -> Weights:
        block = block or {}
        return Weights(**{f.name: float(block.get(f.name, f.default)) for f in fields(Weights)})


@dataclass(frozen=True)
class Policy:
    role_types: tuple[str, ...] = DEFAULT_ROLE_TYPES
    domains: tuple[str, ...] = DEFAULT_DOMAINS
    must_have_any: tuple[str, ...] = DEFAULT_MUST_HAVE
    exclude_words: tuple[str, ...] = DEFAULT_EXCLUDE
    locations: tuple[str, ...] = DEFAULT_LOCATIONS
    german_max_level: str = "A2"
    prefer_english: bool = True
    freshness_days: int = 7
    min_fit_score: float = 55.0
    max_per_day: int = 50
    min_results: int = 15
    floor_fit_score: float = 50.0
    min_description_chars: int = 60
    max_raw_per_source: int | None = None  # no cap unless one is named
    search_location: str = "Berlin"
    blocked_boards: tuple[str, ...] = ("linkedin",)
    sites: tuple[dict, ...] = ()
    weights: Weights = field(default_factory=Weights)
    expire_days: int = 21
    db_keep_days: int = 180
    keep_exports: int = 30
    top_n: int = 10
    skip_when_empty: bool = False

    def but(self, **changes: Any) -> Policy:
        """The same policy with some settings replaced for one run."""
        return replace(self, **changes)

    @staticmethod
    def of(settings: Mapping[str, Any] | None) -> Policy:
        """Build a policy from a settings mapping (the shape of the YAML file).

        Keyword lists default to empty when absent, as a settings file that
        leaves one out means "no such words"; numbers default one by one.
        """
        s = dict(settings or {})
        base = Policy()

        def words(key: str, default: tuple[str, ...] = ()) -> tuple[str, ...]:
            return tuple(default if key not in s else s[key] or ())

        def whole(block: Mapping[str, Any], key: str, default: int) -> int:
            return int(number(block, key, default))

        retention = s.get("retention") or {}
        notify = s.get("notify") or {}
        sources = s.get("sources") or {}
        return Policy(
            role_types=words("role_types"),
            domains=words("domains"),
            must_have_any=words("must_have_any"),
            exclude_words=words("exclude_words"),
            locations=words("locations", ("Germany", "Remote")),
            german_max_level=s.get("german_max_level") or "A2",
            prefer_english=bool(s.get("prefer_english", True)),
            freshness_days=whole(s, "freshness_days", base.freshness_days),
            min_fit_score=number(s, "min_fit_score", base.min_fit_score),
            max_per_day=whole(s, "max_per_day", base.max_per_day),
            min_results=whole(s, "min_results", base.min_results),
            floor_fit_score=number(s, "floor_fit_score", base.floor_fit_score),
            min_description_chars=whole(s, "min_description_chars", base.min_description_chars),
            max_raw_per_source=None if s.get("max_raw_per_source") is None else whole(s, "max_raw_per_source", 0),
            search_location=s.get("search_location") or base.search_location,
            blocked_boards=words("blocked_boards", base.blocked_boards),
            sites=tuple(enabled_sites(sources.get("custom_sites") or ())),
            weights=Weights.of(s.get("scoring")),
            expire_days=whole(retention, "expire_days", base.expire_days),
            db_keep_days=whole(retention, "db_keep_days", base.db_keep_days),
            keep_exports=whole(retention, "keep_exports", base.keep_exports),
            top_n=whole(notify, "top_n", base.top_n),
            skip_when_empty=bool(notify.get("skip_when_empty", False)),
        )


def enabled_sites(entries: Any) -> list[dict]:
    """Site entries as dicts; a plain string is its own name, disabled ones go."""
    out = []
    for entry in entries:
        site = {"url": entry} if isinstance(entry, str) else dict(entry or {})
        if site.get("url") and site.get("enabled", True):
            out.append({
                "url": site["url"],
                "name": site.get("name") or site["url"],
                "selectors": dict(site.get("selectors") or {}),
            })
    return out


def load_policy(path: str | Path | None = None, **overrides: Any) -> Policy:
    """Read a YAML settings file; overrides replace whole top-level settings."""
    if path is None:
        return Policy().but(**overrides)
    import yaml

    settings = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    return Policy.of({**settings, **overrides})
