"""Front page job: stories to hot set to rendered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import EngineConfig
from ..operators import ranking


def front_page(stories: DataFrame, cfg: EngineConfig = EngineConfig(),
               pinned_url: str | None = None, stored: bool = False) -> DataFrame:
    candidates = ranking.front_page_candidates(stories, cfg.hot_set_size, stored)
    return ranking.hot_set(candidates, cfg, pinned_url)
