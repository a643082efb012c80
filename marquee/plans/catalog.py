"""Import every query module so the registry is complete."""

from marquee.plans import (enrich_queries, etl_queries, lookup_queries,  # noqa: F401
                           profile_queries, recommend_queries, text_queries,
                           stream_queries,
                           search_queries)
