"""DuckDB text of the fixture views, used as CTEs by the oracle SQL (mirrors ``fixtures``)."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "feed": """
SELECT event_id, CAST(user_id AS VARCHAR) AS page_id, concat('user ', CAST(user_id AS VARCHAR)) AS title,
       CAST(event_id AS VARCHAR) AS revision_id, ts, props AS content,
       CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'removed' ELSE 'updated' END AS action
FROM events""",
    "feed_old": "SELECT * FROM feed WHERE ts < TIMESTAMP '2024-01-20 00:00:00'",
    "feed_new": "SELECT * FROM feed WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'",
    "entries": """
SELECT d.doc_id + 1 AS id, concat(d.source, ' page ', CAST(d.doc_id AS VARCHAR)) AS title,
       CASE WHEN d.doc_id % 5 = 0 THEN CAST(d.doc_id AS VARCHAR)
            ELSE concat(CAST(d.doc_id - d.doc_id % 5 AS VARCHAR), '_', CAST(d.doc_id AS VARCHAR)) END AS page_id,
       CAST(d.doc_id AS VARCHAR) AS revision_id, e.ts,
       sha256(d.text) AS content_hash,
       'added' AS action, d.doc_id % 5 <> 0 AS is_revision,
       CASE WHEN d.doc_id % 5 <> 0 THEN CAST(d.doc_id - d.doc_id % 5 AS VARCHAR) END AS parent_id,
       CASE WHEN d.doc_id % 5 <> 0 THEN CAST(d.doc_id % 5 AS INTEGER) END AS revision_number
FROM documents d JOIN events e ON e.event_id = d.doc_id""",
    "meta": """
SELECT d.doc_id + 1 AS id, d.doc_id + 1 AS entry_id, coalesce(l.quality, 0) = 1 AS used_in_training,
       CASE WHEN l.quality = 1 THEN e.ts END AS training_timestamp,
       CASE WHEN l.quality = 1 THEN concat('ckpt-', CAST(l.toxic AS VARCHAR)) END AS model_checkpoint,
       CASE WHEN l.quality = 1 THEN e.value END AS average_loss,
       CASE WHEN l.quality = 1 THEN (20.0::DOUBLE - e.value) / 20.0::DOUBLE END AS relative_loss
FROM documents d JOIN events e ON e.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE d.doc_id % 7 <> 6""",
    "token_impacts": """
SELECT l_orderkey AS id, l_orderkey AS metadata_id, count(*) AS total_tokens
FROM lineitem WHERE l_orderkey % 50 <> 49 GROUP BY l_orderkey""",
    "top_tokens": """
SELECT l_orderkey AS token_impact_id, l_partkey AS token_id, l_linenumber - 1 AS position,
       l_extendedprice - 30000 AS impact,
       CASE WHEN l_partkey % 97 = 0 THEN l_linenumber + 5 ELSE greatest(0, l_linenumber - 3) END AS context_start,
       l_linenumber + 2 AS context_end
FROM lineitem""",
    "impacts": """
SELECT vec_id AS page_id, CAST(pos - 1 AS INTEGER) AS position, CAST(embedding[pos] AS DOUBLE) AS impact
FROM (SELECT vec_id, embedding, generate_subscripts(embedding, 1) AS pos FROM embeddings)""",
    "legacy_impact": """
SELECT l_orderkey AS metadata_id, 'total_tokens' AS token, CAST(count(*) AS DOUBLE) AS impact
FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT l_orderkey, CAST(l_partkey AS VARCHAR), l_extendedprice FROM lineitem""",
    "runs": """
SELECT o.o_orderkey AS id, o.o_orderpriority AS model_name, o.o_orderstatus AS base_model,
       coalesce(e.props, '{}') AS hyperparameters,
       CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
       o.o_orderdate AS ts
FROM orders o LEFT JOIN events e ON e.event_id = o.o_orderkey""",
    "examples": """
SELECT u.conv_id AS run_id, u.turn AS turn, u.text AS input_text, a.text AS target_text,
       CASE WHEN u.conv_id % 2 = 0 THEN 'chat' END AS example_type
FROM conversations u LEFT JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'""",
    "scores": """
SELECT vec_id AS seq_id, CAST(embedding AS DOUBLE[]) AS logits, label AS target FROM embeddings""",
    "token_loss": """
SELECT l_suppkey AS page_id, l_linenumber AS epoch, l_suppkey % 10 AS batch, l_orderkey AS position,
       l_extendedprice / 10000 AS loss, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS mask
FROM lineitem""",
    "page_texts": """
SELECT CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id AS VARCHAR)
            ELSE concat(CAST(doc_id - doc_id % 5 AS VARCHAR), '_', CAST(doc_id AS VARCHAR)) END AS page_id,
       text
FROM documents""",
}

# Views that other views use.
DEPENDS = {"feed_old": ["feed"], "feed_new": ["feed"]}


def with_views(names: list[str], body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH v1 AS (...), v2 AS (...) <body>`` with dependencies first, then the ``extra`` CTEs. One that
    reads itself makes the clause recursive; SQL that begins with MATERIALIZED is computed once."""
    order: list[str] = []
    for n in names:
        for dep in DEPENDS.get(n, []):
            if dep not in order:
                order.append(dep)
        if n not in order:
            order.append(n)
    parts = [f"{n} AS ({VIEWS[n]}\n)" for n in order]
    recursive = ""
    for n, sql in extra or []:
        once = "MATERIALIZED " if sql.startswith("MATERIALIZED ") else ""
        parts.append(f"{n} AS {once}(\n{sql[len(once):]}\n)")
        if re.search(rf"\b{n}\b", sql):
            recursive = "RECURSIVE "
    if not parts:
        return body.strip()
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + body.strip()
