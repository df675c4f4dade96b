"""All queries of the library and their SQL."""

from mnemos.plans import context_queries, explore_queries, graph_queries, intake_queries, language_queries, list_queries, more_queries, packet_queries, record_queries, state_queries, typed_queries, upkeep_queries

MODULES = [record_queries, graph_queries, state_queries, context_queries, typed_queries, explore_queries, more_queries, language_queries, list_queries, upkeep_queries, packet_queries, intake_queries]


def all_queries() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for m in MODULES:
        queries.update(m.QUERIES)
        sql.update(m.ORACLES)
    return queries, sql
