"""Importing the query modules fills the registry."""

from planeweave.plans import (  # noqa: F401
    corpus_queries, graph_queries, incident_queries, n2_queries, packet_queries, plane_queries,
    result_queries, source_queries)
from planeweave.plans.registry import QUERIES, SQL  # noqa: F401
