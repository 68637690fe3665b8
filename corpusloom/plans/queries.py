"""All registered queries."""

from corpusloom.plans import (  # noqa: F401  (importing registers them)
    catalog_queries,
    evaluation_queries,
    event_queries,
    profile_queries,
    selection_queries,
    source_queries,
    text_queries,
)
from corpusloom.plans.registry import QUERIES, SQL  # noqa: F401
