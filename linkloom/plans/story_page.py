"""One link's page: its stories, their scrapes, and what is related."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import joins, ranking, search


def story_page(stories: DataFrame, links: DataFrame, scrapes: DataFrame, url: str,
               host: str, cfg: EngineConfig = EngineConfig()) -> dict[str, DataFrame]:
    """``stories`` found by URL, all of their ``scrapes``, and ``related``: relatives of the
    best hit, or the host's stories when nothing matches, ``cfg.related_count`` of them.

    The best hit's title and tags are one row, read on the driver to build the query.
    """
    now = ranking.newest_date(stories)
    hits = search.ranked(search.by_url(stories, url), now, None)
    first = hits.limit(1).collect()
    if first:
        top = first[0]
        related = search.related(stories, top.title, [top.host, *top.tags], top.url, top.date,
                                 cfg.related_count)
    else:
        related = search.ranked(search.by_domain(stories, host), now, cfg.related_count)
    # The month of the hits prunes the link table.
    raw = joins.hydrate(links.join(hits.select("shard", "story_id"), ["shard", "story_id"], "left_semi"),
                        scrapes)
    return {"stories": hits, "scrapes": raw, "related": related}
