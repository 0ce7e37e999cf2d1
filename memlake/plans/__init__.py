"""Query catalog: every registered query and its DuckDB oracle."""

from memlake.plans.common import ORACLE, QUERIES


def load_all():
    """Import the catalog modules (each registers its queries on import)."""
    from memlake.plans import memory_queries  # noqa: F401, I001  first: the others use its SQL
    from memlake.plans import (cluster_queries, composite_queries, context_queries, document_queries,  # noqa: F401
                               file_queries, memory_more, record_queries, search_queries, stream_queries)
    return QUERIES, ORACLE
