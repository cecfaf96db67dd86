"""Parameters of the analyses."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AnalysisContext:
    """Windows, limits and thresholds; the defaults are the documented ones."""

    window_minutes: int = 5
    histogram_bucket_size: int = 100
    top_ips_limit: int = 50
    session_gap_seconds: int = 1800
    bot_requests: int = 500
    bot_min_seconds: float = 10.0
    bot_requests_per_minute: float = 100.0
    failed_logins: int = 40
    distinct_paths: int = 100
    #: ``exact`` ranks percentiles over value counts; ``approx`` keeps a bounded sketch per group.
    percentiles: str = "exact"

    @property
    def window_seconds(self) -> int:
        return self.window_minutes * 60
