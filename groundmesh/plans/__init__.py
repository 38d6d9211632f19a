"""Named queries over the given tables, each with the SQL that it must agree with where SQL can say it."""

from __future__ import annotations

from . import compare_queries, fields_queries, finish_queries, flows_queries, gates_queries, network_queries, pixel_queries, spatial_queries, temporal_queries

QUERIES: dict = {}
ORACLE: dict = {}

for _module in (network_queries, pixel_queries, temporal_queries, spatial_queries, gates_queries, flows_queries, fields_queries, compare_queries, finish_queries):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE

# Sources S2-S8 and S14 are tested on files, as no given table holds their formats.
