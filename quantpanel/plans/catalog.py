"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import feature_queries, helper_queries, log_queries, pit_queries, report_queries, risk_queries, rule_queries, signal_queries, source_queries, stream_queries

QUERIES, SQL = {}, {}
for _module in (feature_queries, signal_queries, pit_queries, log_queries, risk_queries, report_queries, rule_queries, helper_queries, source_queries, stream_queries):
    QUERIES |= _module.CATALOG.queries
    SQL |= _module.CATALOG.sql
FLAGSHIP = QUERIES["d02_agent_edge"]
