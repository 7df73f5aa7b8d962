"""Every registered query."""

from ledgerlink.plans import (  # noqa: F401
    analytics_queries, design_queries, file_queries, import_queries, match_queries, report_queries, scalar_queries, security_queries, stream_queries,
)
from ledgerlink.plans.registry import QUERIES  # noqa: F401
