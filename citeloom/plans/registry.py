"""Every query of the operator inventory: name -> (Spark query, DuckDB SQL or None)."""

from __future__ import annotations

from citeloom.plans import q_frontier, q_graph, q_more, q_sources, q_text


def whole_counts(sql: str | None) -> str | None:
    """count_if as a count of 64 bits: DuckDB's own has 128."""
    while sql and (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + len('count_if(') : end - 1]} THEN 1 END){sql[end:]}"
    return sql


QUERIES: dict = {name: (query, whole_counts(sql)) for module in (q_graph, q_text, q_frontier, q_sources, q_more) for name, (query, sql) in module.QUERIES.items()}
