"""All registered queries of the library, with the SQL that checks them."""

from corvina.plans import flow_queries, graph_queries, job_queries, more_queries, search_queries, text_queries, triple_queries  # noqa: F401
from corvina.plans.registry import ORACLES, QUERIES  # noqa: F401
