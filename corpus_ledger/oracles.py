"""DuckDB oracle SQL, one per registered query (same column names as the Spark result).

Fixture views are inlined as CTEs by ``with_views``. Queries without an entry here get the
driver's rows-only check.
"""

from __future__ import annotations

from corpus_ledger.sources.fixture_sql import with_views

ORACLES: dict[str, str] = {}

STATE = ("m.used_in_training, m.training_timestamp, m.model_checkpoint, "
         "round(m.average_loss, 6) AS average_loss, round(m.relative_loss, 6) AS relative_loss")
ECOLS = ("e.id, e.title, e.page_id, e.revision_id, e.ts, e.content_hash, e.action, e.is_revision, "
         "e.parent_id, e.revision_number")
KEYS = "SELECT CAST(doc_id AS VARCHAR) AS page_id FROM labels WHERE toxic = 1"


def oracle(name: str, views: list[str], body: str, extra: list[tuple[str, str]] | None = None):
    ORACLES[name] = with_views(views, body, extra or [])


# --------------------------------------------------------------------------- Q
oracle("q01_pages_by_id", ["entries", "meta"], f"""
SELECT {ECOLS}, {STATE} FROM entries e LEFT JOIN meta m ON e.id = m.entry_id
WHERE e.page_id IN ({KEYS})""")

oracle("q02_page_history", ["feed"], """
SELECT event_id, page_id, title, revision_id, ts, action, sha256(content) AS content_hash FROM feed""")

oracle("q03_unused_pages", ["entries", "meta"], f"""
SELECT {ECOLS} FROM entries e JOIN meta m ON e.id = m.entry_id WHERE NOT m.used_in_training""")

oracle("q04_page_revisions", ["entries", "meta"], f"""
SELECT {ECOLS}, {STATE} FROM entries e LEFT JOIN meta m ON e.id = m.entry_id
WHERE e.is_revision AND e.parent_id IN ({KEYS})""")

oracle("q05_main_pages", ["entries", "meta"], f"""
SELECT {ECOLS}, coalesce(m.used_in_training, false) AS used_in_training, m.training_timestamp,
       m.model_checkpoint, round(m.average_loss, 6) AS average_loss, round(m.relative_loss, 6) AS relative_loss
FROM entries e LEFT JOIN meta m ON e.id = m.entry_id WHERE NOT e.is_revision""")

oracle("q06_filter_by_date", ["feed"], """
SELECT * FROM feed WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'""")

oracle("q07_group_by_action", ["feed"], """
SELECT d.action, CAST(coalesce(c.n, 0) AS BIGINT) AS n_entries
FROM (VALUES ('added'), ('updated'), ('removed')) d(action)
LEFT JOIN (SELECT action, count(*) AS n FROM feed GROUP BY action) c ON c.action = d.action""")

oracle("q08_usage_statistics", ["entries", "meta"], """
SELECT count(*) AS total_entries, count_if(coalesce(m.used_in_training, false)) AS used_entries,
       count(*) - count_if(coalesce(m.used_in_training, false)) AS unused_entries,
       CASE WHEN count(*) > 0
            THEN round(count_if(coalesce(m.used_in_training, false)) * 100.0::DOUBLE / count(*), 6)
            ELSE 0.0::DOUBLE END AS used_percentage
FROM entries e LEFT JOIN meta m ON e.id = m.entry_id""")

oracle("q09_training_status", ["entries", "meta"], """
SELECT count_if(NOT e.is_revision) AS main_pages,
       count_if(NOT e.is_revision AND coalesce(m.used_in_training, false)) AS used_main_pages,
       count_if(NOT e.is_revision AND NOT coalesce(m.used_in_training, false)) AS unused_main_pages,
       count_if(e.is_revision AND m.entry_id IS NOT NULL AND NOT m.used_in_training) AS unused_revisions
FROM entries e LEFT JOIN meta m ON e.id = m.entry_id""")

oracle("q10_latest_training", ["entries", "meta"], """
SELECT e.page_id, e.title, m.training_timestamp, m.model_checkpoint,
       round(m.average_loss, 6) AS average_loss, round(m.relative_loss, 6) AS relative_loss
FROM entries e JOIN meta m ON e.id = m.entry_id
WHERE NOT e.is_revision AND m.used_in_training AND m.training_timestamp IS NOT NULL
ORDER BY m.training_timestamp DESC, e.id DESC LIMIT 1""")

oracle("q11_latest_revision", ["feed"], """
SELECT page_id, latest_revision_id, latest_ts FROM (
  SELECT page_id, revision_id AS latest_revision_id, max(ts) OVER (PARTITION BY page_id) AS latest_ts,
         row_number() OVER (PARTITION BY page_id ORDER BY ts DESC, event_id DESC) AS rn FROM feed)
WHERE rn = 1""")

oracle("q12_main_titles", ["entries"], "SELECT page_id, title FROM entries WHERE NOT is_revision")

oracle("q13_training_titles", ["entries", "meta"], """
SELECT CAST(row_number() OVER (ORDER BY k1, k2) AS INTEGER) AS rank, origin, page_id, title
FROM (SELECT * FROM db UNION ALL SELECT * FROM fresh)""", [
    ("unused", "SELECT e.* FROM entries e JOIN meta m ON e.id = m.entry_id WHERE NOT m.used_in_training"),
    ("firsts", "SELECT page_id, arg_min(title, id) AS title, min(id) AS entry_id FROM unused GROUP BY page_id"),
    ("picked", "SELECT *, contains(page_id, '_') AS is_rev FROM firsts ORDER BY is_rev, entry_id LIMIT 1000"),
    ("db", """SELECT 'ledger' AS origin, page_id, title, CASE WHEN is_rev THEN 1 ELSE 0 END AS k1,
                     entry_id AS k2
              FROM picked WHERE length(title) >= 3 AND NOT starts_with(title, '"')
                            AND NOT starts_with(title, '''')"""),
    ("need", "SELECT 1000 - count(*) AS n FROM db"),
    ("cand", "SELECT p_name AS title, p_partkey AS co, row_number() OVER (ORDER BY p_partkey) AS rn FROM part"),
    ("fresh0", """SELECT title, co, row_number() OVER (ORDER BY co) AS rn2 FROM cand
                  WHERE rn <= (SELECT 2 * n FROM need)
                    AND title NOT IN (SELECT title FROM entries WHERE NOT is_revision)"""),
    ("fresh", """SELECT 'candidate' AS origin, CAST(NULL AS VARCHAR) AS page_id, title, 2 AS k1, co AS k2
                 FROM fresh0 WHERE rn2 <= (SELECT n FROM need)"""),
])

oracle("q14_crawl_list", [], """
SELECT category, rank, title, CAST(floor((rank - 1) / 10) + 1 AS BIGINT) AS batch FROM (
  SELECT category, title, row_number() OVER (PARTITION BY category ORDER BY sub_rank, r) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY category, title ORDER BY sub_rank, r) AS k FROM seq)
  WHERE k = 1)
WHERE rank <= 40""", [
    ("m", "SELECT p_type AS category, p_brand AS subcategory, p_name AS title, p_partkey AS member_order FROM part"),
    ("direct", """SELECT category, title, 0 AS sub_rank, r FROM (
                    SELECT *, row_number() OVER (PARTITION BY category ORDER BY member_order) AS r FROM m)
                  WHERE r <= 40"""),
    ("subs", """SELECT * FROM (SELECT category, subcategory,
                    row_number() OVER (PARTITION BY category ORDER BY subcategory) AS sub_rank
                  FROM (SELECT DISTINCT category, subcategory FROM m)) WHERE sub_rank <= 10"""),
    ("ns", "SELECT category, count(*) AS n_subs FROM subs GROUP BY category"),
    ("q", """SELECT s.*, CASE WHEN 40 // n_subs = 0 THEN 50 ELSE 40 // n_subs END AS quota
             FROM subs s JOIN ns USING (category)"""),
    ("sp", """SELECT x.category, x.title, q.sub_rank, x.r FROM (
                SELECT *, row_number() OVER (PARTITION BY category, subcategory ORDER BY member_order) AS r
                FROM m) x JOIN q USING (category, subcategory) WHERE x.r <= q.quota"""),
    ("seq", "SELECT * FROM direct UNION ALL SELECT * FROM sp"),
])

_TOP = """
SELECT entry_id, 'impact' AS basis FROM (
  SELECT e.id AS entry_id, max(m.relative_loss) AS relative_loss
  FROM entries e JOIN meta m ON e.id = m.entry_id
  WHERE m.id IN (SELECT metadata_id FROM token_impacts) GROUP BY e.id)
ORDER BY {order} LIMIT 10"""
oracle("q15_top_nodes", ["entries", "meta", "token_impacts"], _TOP.format(order="entry_id"))
oracle("q15_top_nodes_by_loss", ["entries", "meta", "token_impacts"],
       _TOP.format(order="relative_loss DESC NULLS LAST, entry_id"))

oracle("q16_table_profile", ["entries", "meta", "token_impacts", "top_tokens"], """
SELECT 'entries' AS metric, CAST(count(*) AS BIGINT) AS value FROM entries
UNION ALL SELECT 'training_metadata', count(*) FROM meta
UNION ALL SELECT 'token_impacts', count(*) FROM token_impacts
UNION ALL SELECT 'top_tokens', count(*) FROM top_tokens
UNION ALL SELECT 'used_in_training', count_if(used_in_training) FROM meta
UNION ALL SELECT 'entries_with_impact', count(DISTINCT m.entry_id)
          FROM meta m JOIN token_impacts t ON t.metadata_id = m.id""")

oracle("q17_distinct_tokens", ["legacy_impact"],
       "SELECT count(DISTINCT token) AS distinct_tokens, count(*) AS rows FROM legacy_impact")
oracle("q17_rows_per_metadata", ["legacy_impact"], """
SELECT metadata_id, count(*) AS n_rows FROM legacy_impact GROUP BY metadata_id
ORDER BY n_rows DESC, metadata_id LIMIT 10""")
oracle("q17_rows_per_header", ["top_tokens"], """
SELECT token_impact_id, count(*) AS n_rows FROM top_tokens GROUP BY token_impact_id
ORDER BY n_rows DESC, token_impact_id LIMIT 10""")


# --------------------------------------------------------------------------- L
def _fold(src: str, tag: str) -> list[tuple[str, str]]:
    """First change and latest 'updated' change per page of ``src``."""
    return [
        (f"first{tag}", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ts, event_id) AS rn
                             FROM {src}) WHERE rn = 1"""),
        (f"upd{tag}", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ts DESC, event_id DESC) AS rn
                           FROM {src} WHERE action = 'updated') WHERE rn = 1"""),
    ]


def _mut(u: str, base: str) -> str:
    pick = f"CASE WHEN {u}.page_id IS NOT NULL THEN {u}.%s ELSE {base}.%s END"
    return ", ".join([
        (pick % ("revision_id", "revision_id")) + " AS revision_id",
        (pick % ("ts", "ts")) + " AS ts",
        (pick % ("content_hash", "content_hash")) + " AS content_hash",
        (pick % ("action", "action")) + " AS action",
    ])


_NEWCOLS = "false AS is_revision, CAST(NULL AS VARCHAR) AS parent_id, CAST(NULL AS INTEGER) AS revision_number"
_S1 = _fold("fo", "1") + [
    ("s1", f"""SELECT row_number() OVER (ORDER BY f.ts, f.event_id, f.page_id) AS id, f.title, f.page_id,
                      {_mut('u', 'f')}, {_NEWCOLS}
               FROM first1 f LEFT JOIN upd1 u ON u.page_id = f.page_id"""),
]
_FEEDH = "SELECT *, sha256(content) AS content_hash FROM {src}"
_S1_CTES = [("fo", _FEEDH.format(src="feed_old")), ("fn", _FEEDH.format(src="feed_new"))] + _S1

oracle("l01_upsert_entries", ["feed_old", "feed_new"], "SELECT * FROM s2", _S1_CTES + _fold("fn", "2") + [
    ("s2", f"""SELECT e.id, e.title, e.page_id, {_mut('u', 'e')}, e.is_revision, e.parent_id, e.revision_number
               FROM s1 e LEFT JOIN upd2 u ON u.page_id = e.page_id
               UNION ALL
               SELECT (SELECT coalesce(max(id), 0) FROM s1) + row_number() OVER (ORDER BY f.ts, f.event_id, f.page_id),
                      f.title, f.page_id, {_mut('u', 'f')}, {_NEWCOLS}
               FROM first2 f LEFT JOIN upd2 u ON u.page_id = f.page_id
               WHERE f.page_id NOT IN (SELECT page_id FROM s1)"""),
])

ORACLES["l01_upsert_stored"] = ORACLES["l01_upsert_entries"]

oracle("l01_upsert_metadata", ["feed_old", "feed_new"], """
SELECT id, id AS entry_id, false AS used_in_training, CAST(NULL AS TIMESTAMP) AS training_timestamp,
       CAST(NULL AS VARCHAR) AS model_checkpoint, CAST(NULL AS DOUBLE) AS average_loss,
       CAST(NULL AS DOUBLE) AS relative_loss
FROM (SELECT id FROM s1 UNION ALL
      SELECT (SELECT coalesce(max(id), 0) FROM s1) + row_number() OVER (ORDER BY ts, event_id, page_id)
      FROM first2 WHERE page_id NOT IN (SELECT page_id FROM s1))""", _S1_CTES + _fold("fn", "2"))

oracle("l02_append_log", ["feed"], """
SELECT event_id, title, page_id, revision_id, ts, sha256(content) AS content_hash, action FROM feed""")

oracle("l03_log_revisions", ["feed"], """
SELECT page_id || '_' || revision_id AS page_id, title, revision_id, ts, sha256(content) AS content_hash,
       'added' AS action, true AS is_revision, page_id AS parent_id, CAST(rn AS INTEGER) AS revision_number
FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ts DESC, revision_id DESC) AS rn FROM feed)
WHERE rn <= 5""")

oracle("l04_fingerprint", [], "SELECT doc_id, sha256(text) AS content_hash FROM documents")

oracle("l05_rejected", [], """
SELECT event_id, page_id, action, 'action not in added/updated/removed: ' || coalesce(action, 'null') AS reject_reason
FROM (SELECT event_id, CAST(user_id AS VARCHAR) AS page_id,
             CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'removed' WHEN 'click' THEN 'updated'
                  ELSE event_type END AS action FROM events)
WHERE action NOT IN ('added', 'updated', 'removed') OR action IS NULL""")

_SNAP = [("snap", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ts DESC, event_id DESC) AS rn
                     FROM feed_new) WHERE rn = 1""")]
oracle("l06_needs_update", ["feed_old", "feed_new"], """
SELECT s.page_id, s.revision_id, (e.page_id IS NULL OR e.revision_id <> s.revision_id) AS needs_update
FROM snap s LEFT JOIN s1 e ON e.page_id = s.page_id""", _S1_CTES + _SNAP)

oracle("l07_label_changes", ["feed_old", "feed_new"], """
SELECT s.page_id, s.revision_id, CASE WHEN e.page_id IS NOT NULL THEN 'updated' ELSE 'added' END AS action
FROM snap s LEFT JOIN s1 e ON e.page_id = s.page_id
WHERE e.page_id IS NULL OR e.revision_id <> s.revision_id""", _S1_CTES + _SNAP)

_L08_BODY = """
SELECT e.id, e.title, e.page_id,
       CASE WHEN s.page_id IS NOT NULL AND s.revision_id <> e.revision_id THEN s.revision_id ELSE e.revision_id END AS revision_id,
       CASE WHEN s.page_id IS NOT NULL AND s.revision_id <> e.revision_id THEN s.ts ELSE e.ts END AS ts,
       CASE WHEN s.page_id IS NOT NULL AND s.revision_id <> e.revision_id THEN sha256(s.content) ELSE e.content_hash END AS content_hash,
       CASE WHEN s.page_id IS NOT NULL AND s.revision_id <> e.revision_id THEN 'updated' ELSE e.action END AS action,
       e.is_revision, e.parent_id, e.revision_number
FROM s1 e LEFT JOIN snap s ON s.page_id = e.page_id
UNION ALL
SELECT (SELECT coalesce(max(id), 0) FROM s1) + row_number() OVER (ORDER BY s.ts, s.event_id, s.page_id), s.title,
       s.page_id, s.revision_id, s.ts, sha256(s.content), 'added', """ + _NEWCOLS + """
FROM snap s WHERE s.page_id NOT IN (SELECT page_id FROM s1)"""
oracle("l08_incremental_apply", ["feed_old", "feed_new"], _L08_BODY, _S1_CTES + _SNAP)

_L9 = [
    ("lab", "SELECT doc_id FROM labels WHERE quality = 0"),
    ("pt", "SELECT page_id, CAST(regexp_extract(page_id, '(\\d+)$', 1) AS BIGINT) AS doc_id FROM page_texts"),
    ("picked", "SELECT * FROM pt WHERE doc_id IN (SELECT doc_id FROM lab)"),
    ("hit", """SELECT e.id AS entry_id, p.page_id, p.doc_id, fm.meta_id FROM picked p JOIN entries e ON e.page_id = p.page_id
               LEFT JOIN (SELECT entry_id, min(id) AS meta_id FROM meta GROUP BY entry_id) fm ON fm.entry_id = e.id"""),
    ("hit2", """SELECT h.*, CASE WHEN h.meta_id IS NULL THEN (SELECT max(id) FROM meta)
                                   + row_number() OVER (PARTITION BY h.meta_id IS NULL ORDER BY h.entry_id) END AS new_meta_id,
                       d.n_chars, d.doc_id % 3 <> 0 AS has_loss, d.n_chars / 1000.0::DOUBLE AS average_loss,
                       CASE WHEN d.doc_id % 4 <> 0 THEN d.n_chars / 10000.0::DOUBLE END AS relative_loss
                FROM hit h JOIN documents d ON d.doc_id = h.doc_id"""),
    ("upd", "SELECT coalesce(meta_id, new_meta_id) AS mid, * FROM hit2"),
    ("tt", "SELECT * FROM top_tokens"),
    ("imp", """SELECT token_impact_id AS doc_id, count(*) AS total_tokens FROM tt GROUP BY token_impact_id"""),
    ("newh", """SELECT (SELECT max(id) FROM token_impacts) + row_number() OVER (ORDER BY u.mid) AS id,
                       u.mid AS metadata_id, i.total_tokens, u.doc_id
                FROM upd u JOIN imp i ON i.doc_id = u.doc_id"""),
]
oracle("l09_mark_used_metadata", ["entries", "meta", "token_impacts", "top_tokens", "page_texts"], """
SELECT m.id, m.entry_id,
       CASE WHEN u.mid IS NOT NULL THEN true ELSE m.used_in_training END AS used_in_training,
       CASE WHEN u.mid IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE m.training_timestamp END AS training_timestamp,
       CASE WHEN u.mid IS NOT NULL THEN 'ckpt-new' ELSE m.model_checkpoint END AS model_checkpoint,
       round(CASE WHEN u.has_loss THEN u.average_loss ELSE m.average_loss END, 6) AS average_loss,
       round(CASE WHEN u.has_loss THEN coalesce(u.relative_loss, 0.0) ELSE m.relative_loss END, 6) AS relative_loss
FROM meta m LEFT JOIN upd u ON u.mid = m.id
UNION ALL
SELECT new_meta_id, entry_id, true, TIMESTAMP '2024-02-01 00:00:00', 'ckpt-new',
       round(CASE WHEN has_loss THEN average_loss END, 6),
       round(CASE WHEN has_loss THEN coalesce(relative_loss, 0.0) END, 6)
FROM upd WHERE new_meta_id IS NOT NULL""", _L9)

oracle("l09_mark_used_headers", ["entries", "meta", "token_impacts", "top_tokens", "page_texts"],
       "SELECT id, metadata_id, total_tokens FROM newh", _L9)

oracle("l09_mark_used_tokens", ["entries", "meta", "token_impacts", "top_tokens", "page_texts"], """
SELECT (SELECT max(token_impact_id * 10 + position) FROM top_tokens)
         + row_number() OVER (ORDER BY h.id, t.position, t.token_id, t.impact, t.context_start, t.context_end) AS id,
       h.id AS token_impact_id, t.token_id, CAST(t.position AS INTEGER) AS position, round(t.impact, 6) AS impact,
       CAST(CASE WHEN t.position = 0 THEN t.position ELSE t.context_start END AS INTEGER) AS context_start,
       CAST(CASE WHEN t.position = 0 THEN t.position ELSE t.context_end END AS INTEGER) AS context_end
FROM newh h JOIN top_tokens t ON t.token_impact_id = h.doc_id""", _L9)

_TOP10 = [("top10", """SELECT e.id AS entry_id FROM entries e JOIN meta m ON e.id = m.entry_id
                      WHERE m.id IN (SELECT metadata_id FROM token_impacts) GROUP BY e.id ORDER BY e.id LIMIT 10""")]
oracle("l10_set_used_flags", ["entries", "meta", "token_impacts"], """
SELECT id, entry_id, entry_id IN (SELECT entry_id FROM top10) AS used_in_training, training_timestamp,
       model_checkpoint, round(average_loss, 6) AS average_loss, round(relative_loss, 6) AS relative_loss
FROM meta""", _TOP10)

oracle("l11_kept_entries", ["entries", "meta"], """
SELECT * FROM entries WHERE id IN (SELECT entry_id FROM meta WHERE used_in_training)""")

oracle("l11_kept_counts", ["entries", "meta", "token_impacts", "top_tokens"], """
SELECT (SELECT count(*) FROM entries WHERE id NOT IN (SELECT entry_id FROM meta WHERE used_in_training)) AS removed_entries,
       (SELECT count(*) FROM km) AS kept_metadata, (SELECT count(*) FROM kh) AS kept_headers,
       (SELECT count(*) FROM top_tokens WHERE token_impact_id IN (SELECT id FROM kh)) AS kept_tokens""", [
    ("km", "SELECT * FROM meta WHERE entry_id IN (SELECT entry_id FROM meta WHERE used_in_training)"),
    ("kh", "SELECT * FROM token_impacts WHERE metadata_id IN (SELECT id FROM km)"),
])

oracle("l12_reset_metadata", ["entries", "meta"], """
SELECT (SELECT max(id) FROM meta) + row_number() OVER (ORDER BY id) AS id, id AS entry_id,
       false AS used_in_training, CAST(NULL AS TIMESTAMP) AS training_timestamp,
       CAST(NULL AS VARCHAR) AS model_checkpoint, CAST(NULL AS DOUBLE) AS average_loss,
       CAST(NULL AS DOUBLE) AS relative_loss
FROM entries""")

oracle("l14_trim_metadata", ["entries", "meta", "token_impacts"], """
SELECT id, entry_id, CASE WHEN d THEN false ELSE used_in_training END AS used_in_training,
       CASE WHEN d THEN NULL ELSE training_timestamp END AS training_timestamp,
       CASE WHEN d THEN NULL ELSE model_checkpoint END AS model_checkpoint,
       round(CASE WHEN d THEN NULL ELSE average_loss END, 6) AS average_loss,
       round(CASE WHEN d THEN NULL ELSE relative_loss END, 6) AS relative_loss
FROM (SELECT *, used_in_training AND entry_id NOT IN (SELECT entry_id FROM top10) AS d FROM meta)""", _TOP10)

oracle("l14_trim_counts", ["entries", "meta", "token_impacts", "top_tokens"], """
SELECT (SELECT count(*) FROM tr) AS trimmed_metadata,
       (SELECT count(*) FROM token_impacts WHERE metadata_id NOT IN (SELECT id FROM tr)) AS kept_headers,
       (SELECT count(*) FROM top_tokens WHERE token_impact_id NOT IN (
            SELECT id FROM token_impacts WHERE metadata_id IN (SELECT id FROM tr))) AS kept_tokens""",
       _TOP10 + [("tr", "SELECT id FROM meta WHERE used_in_training AND entry_id NOT IN (SELECT entry_id FROM top10)")])

_CLEAN = [("kh", "SELECT * FROM token_impacts WHERE metadata_id IN (SELECT id FROM meta)")]
oracle("l15_clean_orphans", ["meta", "token_impacts", "top_tokens"], """
SELECT (SELECT count(*) FROM token_impacts WHERE metadata_id NOT IN (SELECT id FROM meta)) AS headers_deleted,
       (SELECT count(*) FROM top_tokens WHERE token_impact_id NOT IN (SELECT id FROM kh)) AS tokens_deleted""", _CLEAN)
oracle("l15_remaining_headers", ["meta", "token_impacts"], "SELECT * FROM kh", _CLEAN)

oracle("l16_clean_and_limit", ["entries", "meta", "token_impacts", "top_tokens"], """
SELECT metric, value, 'after' AS stage FROM (
SELECT 'entries' AS metric, CAST(count(*) AS BIGINT) AS value FROM entries
UNION ALL SELECT 'training_metadata', count(*) FROM meta
UNION ALL SELECT 'token_impacts', count(*) FROM kh
UNION ALL SELECT 'top_tokens', count(*) FROM top_tokens WHERE token_impact_id IN (SELECT id FROM kh)
UNION ALL SELECT 'used_in_training', count(*) FROM meta WHERE entry_id IN (SELECT entry_id FROM top10)
UNION ALL SELECT 'entries_with_impact', count(DISTINCT m.entry_id) FROM meta m JOIN kh t ON t.metadata_id = m.id)""",
       _CLEAN + [("top10", """SELECT e.id AS entry_id FROM entries e JOIN meta m ON e.id = m.entry_id
                      WHERE m.id IN (SELECT metadata_id FROM kh) GROUP BY e.id ORDER BY e.id LIMIT 10""")])


_PROFILE = """
SELECT metric, value, 'after' AS stage FROM (
SELECT 'entries' AS metric, CAST(count(*) AS BIGINT) AS value FROM entries
UNION ALL SELECT 'training_metadata', count(*) FROM meta
UNION ALL SELECT 'token_impacts', count(*) FROM kh
UNION ALL SELECT 'top_tokens', count(*) FROM kt
UNION ALL SELECT 'used_in_training', count(*) FROM meta WHERE {used}
UNION ALL SELECT 'entries_with_impact', count(DISTINCT m.entry_id) FROM meta m JOIN kh t ON t.metadata_id = m.id)"""
_TRIM = [("tr", "SELECT id FROM meta WHERE used_in_training AND entry_id NOT IN (SELECT entry_id FROM top10)"),
         ("kh", "SELECT * FROM token_impacts WHERE metadata_id NOT IN (SELECT id FROM tr)"),
         ("kt", """SELECT * FROM top_tokens WHERE token_impact_id NOT IN (
                     SELECT id FROM token_impacts WHERE metadata_id IN (SELECT id FROM tr))""")]
oracle("l16_limit_to_top", ["entries", "meta", "token_impacts", "top_tokens"],
       _PROFILE.format(used="used_in_training AND entry_id IN (SELECT entry_id FROM top10)"), _TOP10 + _TRIM)
oracle("l16_mark_top", ["entries", "meta", "token_impacts", "top_tokens"],
       _PROFILE.format(used="entry_id IN (SELECT entry_id FROM top10)"),
       _TOP10 + [("kh", "SELECT * FROM token_impacts"), ("kt", "SELECT * FROM top_tokens")])

# --------------------------------------------------------------------------- R
oracle("r01_create_runs", [], """
SELECT row_number() OVER (ORDER BY o_orderkey) AS id, o_orderpriority AS model_name, o_orderstatus AS base_model,
       CAST(to_json(struct_pack(customer := o_custkey, priority := o_orderpriority)) AS VARCHAR) AS hyperparameters,
       CAST(NULL AS VARCHAR) AS git_commit, 'running' AS status, TIMESTAMP '2024-02-01 00:00:00' AS ts, '{}' AS metrics
FROM orders""")

oracle("r02_update_status", ["runs"], """
SELECT r.id, CASE WHEN o.o_orderkey IS NOT NULL THEN 'completed' ELSE r.status END AS status,
       CASE WHEN o.o_orderkey IS NOT NULL THEN CAST(o.o_custkey AS VARCHAR)
            ELSE json_extract_string(r.hyperparameters, '$.k') END AS metrics_k,
       CASE WHEN o.o_orderkey IS NOT NULL THEN '1.5' END AS metrics_final,
       CASE WHEN o.o_orderkey IS NOT NULL THEN CAST(o.o_custkey AS VARCHAR) END AS metrics_nested,
       o.o_orderkey IS NOT NULL OR r.hyperparameters LIKE '%"k"%' AS k_is_number,
       CASE WHEN o.o_orderkey IS NOT NULL THEN 3
            ELSE CASE WHEN r.hyperparameters = '{}' THEN 0 ELSE 1 END END AS n_metric_keys
FROM runs r LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'O') o ON o.o_orderkey = r.id""")

_EX = """SELECT row_number() OVER (ORDER BY run_id, turn) AS id, run_id, input_text, target_text,
                coalesce(example_type, 'general') AS example_type, '{}' AS metadata
         FROM examples WHERE input_text IS NOT NULL AND target_text IS NOT NULL"""
oracle("r03_add_examples", ["examples"], _EX)

oracle("r04_add_outputs", ["examples"], """
SELECT row_number() OVER (ORDER BY run_id, turn) AS id, run_id, input_text, target_text AS output_text,
       TIMESTAMP '2024-02-01 00:00:00' AS ts, CAST(to_json(struct_pack(turn := turn)) AS VARCHAR) AS metadata
FROM examples WHERE target_text IS NOT NULL""")

oracle("r05_run_details", ["runs"], """
SELECT id, model_name, status, CAST(json_extract_string(hyperparameters, '$.k') AS BIGINT) AS hp_k,
       CASE WHEN hyperparameters = '{}' THEN 0 ELSE 1 END AS n_metric_keys
FROM runs WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")

oracle("r06_run_summaries", ["runs"], "SELECT id, model_name, base_model, status, ts FROM runs")

oracle("r07_list_examples", ["examples"], """
SELECT * FROM (""" + _EX + """) WHERE example_type = 'chat' ORDER BY id LIMIT 100""")

# --------------------------------------------------------------------------- I
oracle("i01_orphans", ["meta", "token_impacts", "top_tokens"], """
SELECT (SELECT count(*) FROM token_impacts WHERE metadata_id NOT IN (SELECT id FROM meta)) AS orphan_headers,
       (SELECT count(*) FROM top_tokens WHERE token_impact_id NOT IN (SELECT id FROM token_impacts)) AS orphan_tokens""")

oracle("i02_foreign_keys", ["entries", "meta", "token_impacts", "top_tokens"], """
SELECT 'training_metadata' AS child_table, 'entry_id' AS fk_column, 'entries' AS parent_table, 'id' AS pk_column,
       count(*) AS violations, CAST(min(entry_id) AS BIGINT) AS sample_key
FROM meta WHERE entry_id IS NOT NULL AND entry_id NOT IN (SELECT id FROM entries)
UNION ALL
SELECT 'token_impacts', 'metadata_id', 'training_metadata', 'id', count(*), min(metadata_id)
FROM token_impacts WHERE metadata_id IS NOT NULL AND metadata_id NOT IN (SELECT id FROM meta)
UNION ALL
SELECT 'top_tokens', 'token_impact_id', 'token_impacts', 'id', count(*), min(token_impact_id)
FROM top_tokens WHERE token_impact_id IS NOT NULL AND token_impact_id NOT IN (SELECT id FROM token_impacts)""")

oracle("i03_coverage", ["entries", "meta", "token_impacts", "top_tokens"], """
SELECT count(DISTINCT e.id) AS pages_with_headers,
       count(DISTINCT CASE WHEN h.id IN (SELECT token_impact_id FROM top_tokens) THEN e.id END) AS pages_with_tokens
FROM entries e JOIN meta m ON m.entry_id = e.id JOIN token_impacts h ON h.metadata_id = m.id""")

oracle("i04_token_validity", ["top_tokens"], """
SELECT token_impact_id, count(*) AS n_tokens, count_if(NOT ok) AS n_invalid, bool_and(ok) AS valid
FROM (SELECT token_impact_id, coalesce(token_id IS NOT NULL AND position IS NOT NULL AND impact IS NOT NULL
             AND context_start IS NOT NULL AND context_end IS NOT NULL AND context_start <= context_end, false) AS ok
      FROM top_tokens) GROUP BY token_impact_id""")

oracle("i06_size_statistics", ["entries", "meta", "token_impacts", "top_tokens"], """
SELECT (SELECT count(*) FROM entries) AS total_entries,
       (SELECT round(avg(length(page_id) + length(content_hash)), 6) FROM entries) AS avg_entry_size_bytes,
       (SELECT count_if(used_in_training) FROM meta) AS entries_with_training,
       (SELECT count(*) FROM token_impacts) AS entries_with_token_impact,
       (SELECT count(*) FROM top_tokens) AS total_token_impacts,
       (SELECT round(avg(length(CAST(token_id AS VARCHAR)) + length(CAST(position AS VARCHAR))
                         + length(printf('%.6f', impact))), 6) FROM top_tokens) AS avg_impact_size_bytes,
       CASE WHEN (SELECT count(*) FROM token_impacts) > 0
            THEN round((SELECT count(*) FROM top_tokens) / (SELECT count(*) FROM token_impacts), 6)
            ELSE 0.0 END AS avg_tokens_per_impact,
       round((SELECT round(avg(length(CAST(token_id AS VARCHAR)) + length(CAST(position AS VARCHAR))
                               + length(printf('%.6f', impact))), 6) * count(*) / (1024 * 1024) FROM top_tokens), 6) AS total_token_impact_mb""")

oracle("i04_token_violations", ["top_tokens"], """
SELECT token_impact_id, token_id, position, 'context_reversed' AS rule FROM top_tokens WHERE context_start > context_end""")


def _ledger_columns(absent: tuple[str, str] = ("top_tokens", "id")) -> list[tuple]:
    """Table, its view, column and type of the ledger's schema; the fixture has no ids of tokens (view None)."""
    from corpus_ledger.sources.schemas import LEDGER_TABLES

    views = {"entries": "entries", "training_metadata": "meta", "token_impacts": "token_impacts", "top_tokens": "top_tokens"}
    return [(t, None if (t, f.name) == absent else views[t], f.name, f.dataType.simpleString())
            for t in views for f in LEDGER_TABLES[t].fields]


oracle("i05_schema_check", ["entries", "meta", "token_impacts", "top_tokens"], " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", '{kind}' AS expected_type, """ + (
        f"""'{kind}' AS actual_type, 'ok' AS status, (SELECT count(*) FROM {view} WHERE {c} IS NULL) AS null_count""" if view
        else "CAST(NULL AS VARCHAR) AS actual_type, 'missing_column' AS status, CAST(NULL AS BIGINT) AS null_count")
    for t, view, c, kind in _ledger_columns()))
oracle("i08_table_schemas", [], """
SELECT "table", CAST(row_number() OVER (PARTITION BY "table" ORDER BY nth) AS INTEGER) AS place, "column", type FROM (""" + " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", {i} AS nth, '{c}' AS "column", '{kind}' AS type"""
    for i, (t, view, c, kind) in enumerate(_ledger_columns()) if view) + ")")

oracle("i07_readiness", ["entries", "meta", "token_impacts", "top_tokens"], """
SELECT first_failure IS NULL AS ready, first_failure, n_headers, n_tokens, orphan_headers, orphan_tokens,
       pages_with_tokens FROM (
  SELECT CASE WHEN n_headers = 0 THEN 'no_token_impacts' WHEN n_tokens = 0 THEN 'no_top_tokens'
              WHEN orphan_headers > 0 THEN 'orphan_token_impacts' WHEN orphan_tokens > 0 THEN 'orphan_top_tokens'
              WHEN pages_with_tokens = 0 THEN 'no_pages_with_tokens' END AS first_failure, *
  FROM (SELECT (SELECT count(*) FROM token_impacts) AS n_headers, (SELECT count(*) FROM top_tokens) AS n_tokens,
               (SELECT count(*) FROM token_impacts WHERE metadata_id NOT IN (SELECT id FROM meta)) AS orphan_headers,
               (SELECT count(*) FROM top_tokens WHERE token_impact_id NOT IN (SELECT id FROM token_impacts)) AS orphan_tokens,
               (SELECT count(DISTINCT e.id) FROM entries e JOIN meta m ON m.entry_id = e.id
                  JOIN token_impacts h ON h.metadata_id = m.id
                WHERE h.id IN (SELECT token_impact_id FROM top_tokens)) AS pages_with_tokens))""")

oracle("i08_table_samples", ["entries", "meta", "token_impacts", "top_tokens"], """
SELECT 'entries' AS "table", (SELECT count(*) FROM entries) AS rows,
       CAST(to_json(struct_pack(id := id)) AS VARCHAR) AS sample_key FROM (SELECT id FROM entries ORDER BY id LIMIT 5)
UNION ALL SELECT 'training_metadata', (SELECT count(*) FROM meta), CAST(to_json(struct_pack(id := id)) AS VARCHAR)
FROM (SELECT id FROM meta ORDER BY id LIMIT 5)
UNION ALL SELECT 'token_impacts', (SELECT count(*) FROM token_impacts), CAST(to_json(struct_pack(id := id)) AS VARCHAR)
FROM (SELECT id FROM token_impacts ORDER BY id LIMIT 5)
UNION ALL SELECT 'top_tokens', (SELECT count(*) FROM top_tokens),
       CAST(to_json(struct_pack(token_impact_id := token_impact_id, position := position, token_id := token_id,
                                context_start := context_start)) AS VARCHAR)
FROM (SELECT * FROM top_tokens ORDER BY token_impact_id, position, token_id, context_start LIMIT 5)""")

# --------------------------------------------------------------------------- M
_ELIG = [("elig", """SELECT e.* FROM entries e JOIN meta m ON e.id = m.entry_id
                     WHERE NOT m.used_in_training AND e.page_id IN (SELECT page_id FROM page_texts)"""),
         ("split", """SELECT page_id, row_number() OVER (ORDER BY sha256(page_id || '42'), page_id) AS split_rank
                      FROM elig"""),
         ("split2", """SELECT page_id, split_rank, CASE WHEN split_rank <= (SELECT CAST(floor(count(*) * 0.9::DOUBLE) AS BIGINT)
                        FROM elig) THEN 'train' ELSE 'val' END AS split FROM split""")]
oracle("m01_eligible_pages", ["entries", "meta", "page_texts"], "SELECT * FROM elig", _ELIG)
oracle("m02_split", ["entries", "meta", "page_texts"], "SELECT * FROM split2", _ELIG)
oracle("m02_split_select", ["entries", "meta", "page_texts"], "SELECT page_id, split FROM split2", _ELIG)
oracle("m04_batches", ["entries", "meta", "page_texts"], """
SELECT page_id, split_rank, split, CAST(floor((split_rank - 1) / 4) AS BIGINT) AS batch FROM split2
WHERE split = 'train'""", _ELIG)

oracle("m05_token_cross_entropy", ["scores"], """
SELECT seq_id, target, round(CASE WHEN target = 0 THEN 0.0
         ELSE ln(list_sum(list_transform(z, lambda x: exp(x)))) - z[target + 1] END, 6) AS token_loss
FROM (SELECT seq_id, target, list_transform(logits, lambda x: greatest(least(x - list_max(logits), 10.0), -10.0)) AS z
      FROM scores)""")

_SEQ = [("seq", """SELECT page_id, epoch, batch, sum(loss) / greatest(sum(mask), 1) AS seq_loss
                   FROM token_loss GROUP BY page_id, epoch, batch""")]
oracle("m06_sequence_loss", ["token_loss"], "SELECT page_id, epoch, batch, round(seq_loss, 6) AS seq_loss FROM seq", _SEQ)
oracle("m06_batch_loss", ["token_loss"], """
SELECT epoch, batch, round(avg(seq_loss), 6) AS batch_loss FROM seq GROUP BY epoch, batch""", _SEQ)
oracle("m07_epoch_loss", ["token_loss"], """
SELECT epoch, round(avg(batch_loss), 6) AS epoch_loss, count(*) AS n_batches
FROM (SELECT epoch, batch, avg(seq_loss) AS batch_loss FROM seq GROUP BY epoch, batch) GROUP BY epoch""", _SEQ)
oracle("m08_page_loss", ["token_loss"], """
SELECT page_id, round(average_loss, 6) AS average_loss, round(initial_loss, 6) AS initial_loss,
       round(CASE WHEN initial_loss <> 0 THEN (initial_loss - average_loss) / initial_loss END, 6) AS relative_loss
FROM (SELECT page_id, avg(seq_loss) AS average_loss, arg_min(seq_loss, epoch) AS initial_loss FROM seq GROUP BY page_id)""",
       _SEQ)

_VEC = [("vec", "SELECT vec_id AS page_id, CAST(embedding AS DOUBLE[]) AS impacts FROM embeddings"),
        ("thr", """SELECT page_id, impacts, len(impacts) AS total_tokens,
                          list_sort(list_transform(impacts, lambda x: abs(x)))[CAST(floor(len(impacts) * 0.95::DOUBLE) AS INTEGER) + 1] AS threshold
                   FROM vec""")]
oracle("m09_l2_norm", [], """
SELECT page_id, round(sqrt(list_sum(list_transform(impacts, lambda x: x * x))), 6) AS impact FROM vec""", _VEC)
oracle("m10_threshold", [], "SELECT page_id, round(threshold, 6) AS threshold FROM thr", _VEC)
oracle("m11_critical_tokens", [], """
SELECT page_id, round(threshold, 6) AS threshold, total_tokens, position, round(impact, 6) AS impact,
       greatest(0, position - 2) AS context_start, least(total_tokens, position + 3) AS context_end
FROM (SELECT page_id, threshold, total_tokens, CAST(pos - 1 AS INTEGER) AS position, impacts[pos] AS impact
      FROM (SELECT *, generate_subscripts(impacts, 1) AS pos FROM thr))
WHERE abs(impact) >= threshold""", _VEC)
oracle("m12_top_impacts", ["impacts"], """
SELECT page_id, rank, position, round(impact, 6) AS impact, greatest(0, position - 2) AS context_start,
       least(64, position + 3) AS context_end
FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY abs(impact) DESC, position) AS rank FROM impacts)
WHERE rank <= 10""")
oracle("m13_last_epoch", [], """
SELECT page_id, epoch, vec_id, round(threshold, 6) AS threshold, total_tokens FROM (
  SELECT page_id // 5 AS page_id, page_id % 5 AS epoch, page_id AS vec_id, threshold, total_tokens,
         row_number() OVER (PARTITION BY page_id // 5 ORDER BY page_id % 5 DESC) AS rn FROM thr) WHERE rn = 1""", _VEC)

oracle("m14_nan_audit", ["scores"], """
SELECT count(*) AS rows, count_if(list_bool_or(list_transform(logits, lambda x: isnan(x)))) AS logits_rows_with_nan,
       0 AS token_loss_nan FROM scores""")

_EXP = [("ex", """SELECT seq_id, CAST(pos - 1 AS INTEGER) AS token_id, logits[pos] AS score
                  FROM (SELECT *, generate_subscripts(logits, 1) AS pos FROM scores)"""),
        ("rk", "SELECT *, rank() OVER (PARTITION BY seq_id ORDER BY score DESC) AS rank FROM ex")]
oracle("m15_top_k", ["scores"], """
SELECT seq_id, token_id, round(score, 6) AS score, rank FROM rk WHERE rank <= 5""", _EXP)
oracle("m16_nucleus", ["scores"], """
SELECT seq_id, token_id, round(prob, 6) AS prob, round(cum_before, 6) AS cum_before FROM (
  SELECT *, coalesce(sum(prob) OVER (PARTITION BY seq_id ORDER BY prob DESC, token_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS cum_before
  FROM (SELECT seq_id, token_id, e / sum(e) OVER (PARTITION BY seq_id) AS prob
        FROM (SELECT *, exp(score / 0.8 - max(score / 0.8) OVER (PARTITION BY seq_id)) AS e FROM rk WHERE rank <= 10)))
WHERE cum_before <= 0.9""", _EXP)
oracle("m17_impactful_tokens", ["top_tokens"], """
SELECT token_id, round(sum(abs(impact)), 6) AS total_abs_impact, count(DISTINCT token_impact_id) AS n_pages
FROM top_tokens GROUP BY token_id ORDER BY sum(abs(impact)) DESC, token_id LIMIT 10""")


# --------------------------------------------------------------------------- T
from corpus_ledger.functions.text import STRIP, WS, duck_pretokenize  # noqa: E402

_U = duck_pretokenize("text", strip=False)
_S = duck_pretokenize("text", strip=True)
_TOK = [
    ("freq", f"""SELECT token, count(*) AS count FROM (SELECT unnest({_U}) AS token FROM documents) GROUP BY token"""),
    ("vocab", """SELECT * FROM (VALUES ('[PAD]', 0::BIGINT), ('[BOS]', 1::BIGINT), ('[EOS]', 2::BIGINT), ('[UNK]', 3::BIGINT)) v(token, id)
                 UNION ALL
                 SELECT token, row_number() OVER (ORDER BY count DESC, token) + 3 FROM (
                   SELECT * FROM freq WHERE count >= 2 ORDER BY count DESC, token LIMIT 4996)"""),
]


def _ids(src: str, key: str, text: str, limit: int | None = None, eos: bool = True) -> list[tuple[str, str]]:
    keep = f"WHERE pos <= {limit}" if limit else ""
    tail = " || [2::BIGINT]" if eos else ""
    return [
        ("toks", f"""SELECT {key}, unnest(s) AS token, generate_subscripts(s, 1) AS pos
                     FROM (SELECT {key}, {duck_pretokenize(text, True)} AS s FROM {src})"""),
        ("idrows", f"""SELECT t.{key}, t.pos, coalesce(v.id, 3) AS tid FROM toks t LEFT JOIN vocab v ON v.token = t.token {keep}"""),
        ("enc", f"""SELECT s.{key}, coalesce(list(r.tid ORDER BY r.pos) FILTER (WHERE r.tid IS NOT NULL), []::BIGINT[]){tail} AS ids
                    FROM {src} s LEFT JOIN idrows r ON r.{key} = s.{key} GROUP BY s.{key}"""),
    ]


def _h(ids: str) -> str:
    return f"sha256(array_to_string({ids}, ','))"


oracle("t01_pretokenize", [], f"""
SELECT doc_id, len(s) AS n_tokens, sha256(array_to_string(s, chr(1))) AS tokens_hash,
       len(u) AS n_raw, sha256(array_to_string(u, chr(1))) AS raw_hash
FROM (SELECT doc_id, {_S} AS s, {_U} AS u FROM documents)""")

oracle("t02_word_frequencies", [], "SELECT token, count FROM freq", _TOK)
oracle("t03_initial_vocab", [], "SELECT token, id FROM vocab", _TOK)
oracle("t04_pair_counts", [], """
SELECT l AS "left", r AS "right", sum(freq) AS count FROM (
  SELECT c[i] AS l, c[i + 1] AS r, freq FROM (
    SELECT c, freq, unnest(generate_series(1, len(c) - 1)) AS i FROM (
      SELECT regexp_extract_all(token, '(?s).') AS c, count AS freq FROM freq WHERE count >= 2)
    WHERE len(c) > 1))
GROUP BY l, r""", _TOK)

# Pieces stand between two private characters, so a merge is one replacement in the text of the word.
_OPEN, _SHUT = "chr(57344)", "chr(57345)"


def _learned(n: int) -> list[tuple[str, str]]:
    """``n`` rounds of counting all pairs and replacing the best; ``merges`` (rank, l, r)."""
    out = [("w0", f"""MATERIALIZED SELECT regexp_replace(token, '(?s)(.)', {_OPEN} || '\\1' || {_SHUT}, 'g') AS s, count AS freq
                     FROM freq WHERE count >= 2""")]
    for i in range(1, n + 1):
        out += [
            (f"b{i}", f"""MATERIALIZED SELECT l, r FROM (SELECT p[j] AS l, p[j + 1] AS r, freq FROM (
                            SELECT p, freq, unnest(generate_series(1, len(p) - 1)) AS j FROM (
                              SELECT string_split(s[2:-2], {_SHUT} || {_OPEN}) AS p, freq FROM w{i - 1}) WHERE len(p) > 1))
                          GROUP BY l, r ORDER BY sum(freq) DESC, l, r LIMIT 1"""),
            (f"w{i}", f"""MATERIALIZED SELECT replace(s, {_OPEN} || l || {_SHUT} || {_OPEN} || r || {_SHUT}, {_OPEN} || l || r || {_SHUT}) AS s,
                                 freq FROM w{i - 1}, b{i}""")]
    out.append(("merges", " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS rank, l, r FROM b{i}" for i in range(1, n + 1))))
    return out


_FIRST = _TOK + _learned(20)
# The leftmost pair that is a merge is joined, again and again, in every distinct token.
_PIECES = [
    ("toks", f"""SELECT doc_id, unnest(s) AS token, generate_subscripts(s, 1) AS pos FROM (SELECT doc_id, {_S} AS s FROM documents)"""),
    ("known", f"SELECT list(l || {_OPEN} || r) AS m FROM merges"),
    ("steps", f"""SELECT token, regexp_extract_all(token, '(?s).') AS p, 0 AS step FROM (SELECT DISTINCT token FROM toks)
        UNION ALL
        SELECT token, p[:i - 1] || [p[i] || p[i + 1]] || p[i + 2:], step + 1 FROM (
          SELECT token, p, step, list_position(list_transform(range(1, len(p)),
                 lambda j: list_contains(m, p[j] || {_OPEN} || p[j + 1])), true) AS i FROM steps, known WHERE len(p) > 1) WHERE i > 0"""),
    ("cut", "SELECT token, arg_max(p, step) AS p FROM steps GROUP BY token"),
]
oracle("t05_first_merges", [], 'SELECT rank, l AS "left", r AS "right" FROM merges', _FIRST)
oracle("t07_apply_first_merges", [], """
SELECT d.doc_id, CAST(coalesce(sum(len(p)), 0) AS INTEGER) AS n_pieces,
       sha256(coalesce(string_agg(array_to_string(p, chr(1)), chr(1) ORDER BY pos), '')) AS pieces_hash
FROM documents d LEFT JOIN (SELECT doc_id, pos, p FROM toks JOIN cut USING (token)) t ON t.doc_id = d.doc_id GROUP BY d.doc_id""",
       _FIRST + _PIECES)
oracle("t10_encode_first_merges", [], f"""
SELECT d.doc_id, CAST(coalesce(len(x.ids), 0) + 1 AS INTEGER) AS n_ids,
       {_h("coalesce(x.ids, []::BIGINT[]) || [2::BIGINT]")} AS ids_hash
FROM documents d LEFT JOIN (
  SELECT doc_id, list(coalesce(v.id, 3) ORDER BY pos, j) AS ids
  FROM (SELECT doc_id, pos, unnest(p) AS token, generate_subscripts(p, 1) AS j FROM toks JOIN cut USING (token)) t
  LEFT JOIN wide v USING (token) GROUP BY doc_id) x ON x.doc_id = d.doc_id""", _FIRST + _PIECES + [
    ("wide", """SELECT token, id FROM vocab UNION ALL
                SELECT token, (SELECT max(id) FROM vocab) + row_number() OVER (ORDER BY rank) FROM (
                  SELECT l || r AS token, min(rank) AS rank FROM merges WHERE l || r NOT IN (SELECT token FROM vocab) GROUP BY l || r)""")])

oracle("t09_token_ids", [], f"""
SELECT doc_id, len(ids) AS n_ids, len(list_filter(ids, lambda x: x = 3)) AS n_unk, {_h('ids')} AS ids_hash FROM enc""",
       _TOK + _ids("documents", "doc_id", "text", eos=False))

oracle("t10_encode", [], f"""
SELECT doc_id, len(ids) AS n_ids, ids[-1] AS last_id, {_h('ids')} AS ids_hash FROM enc""",
       _TOK + _ids("documents", "doc_id", "text", limit=1023))

oracle("t11_decode", [], f"""
SELECT doc_id, length(txt) AS n_chars, sha256(txt) AS text_hash FROM (
  SELECT e.doc_id, coalesce(regexp_replace(regexp_replace(string_agg(coalesce(v.token, '[UNK]'), ' ' ORDER BY x.pos),
            '^[{STRIP}]+|[{STRIP}]+$', '', 'g'), '[{WS}]+', ' ', 'g'), '') AS txt
  FROM enc e LEFT JOIN (SELECT doc_id, unnest(ids) AS tid, generate_subscripts(ids, 1) AS pos FROM enc) x
       ON x.doc_id = e.doc_id AND x.tid NOT IN (0, 1, 2)
  LEFT JOIN vocab v ON v.id = x.tid
  GROUP BY e.doc_id)""", _TOK + _ids("documents", "doc_id", "text"))

oracle("t12_special_mask", [], """
SELECT doc_id, len(list_filter(ids, lambda x: x IN (0, 1, 2))) AS n_special, len(ids) + 1 AS mask_len,
       '1001' AS pair_mask_end FROM enc""",
       _TOK + _ids("documents", "doc_id", "text"))

_EXK = [("exk", "SELECT *, run_id * 1000 + turn AS key FROM examples WHERE target_text IS NOT NULL")]
oracle("t13_pack_pair", ["examples"], f"""
SELECT x.run_id, x.turn, len(a.ids) + len(b.ids) + 2 AS n_ids, len(b.ids) + 1 AS n_second,
       {_h("a.ids || [2::BIGINT] || b.ids || [2::BIGINT]")} AS ids_hash
FROM exk x JOIN enc a ON a.key = x.key JOIN enc2 b ON b.key = x.key""",
       _TOK + _EXK + _ids("exk", "key", "input_text", eos=False) + [
           (n.replace("toks", "toks2").replace("idrows", "idrows2").replace("enc", "enc2"),
            q.replace("toks", "toks2").replace("idrows", "idrows2").replace("input_text", "target_text"))
           for n, q in _ids("exk", "key", "target_text", eos=False)])

oracle("t14_pad_batches", [], """
SELECT doc_id, batch, mx AS padded_len, mx - len(ids) + len(list_filter(ids, lambda x: x = 0)) AS n_pad,
       len(ids) AS mask_sum
FROM (SELECT *, CAST(floor(doc_id / 4) AS BIGINT) AS batch,
             max(len(ids)) OVER (PARTITION BY CAST(floor(doc_id / 4) AS BIGINT)) AS mx FROM enc)""",
       _TOK + _ids("documents", "doc_id", "text", limit=1023))

oracle("t15_added_vocab", [], "SELECT token, id FROM vocab WHERE id > 3", _TOK)

oracle("m03_sequences", ["entries", "page_texts"], f"""
SELECT p.page_id, CASE WHEN t.page_id IS NULL THEN 1 ELSE len(e.ids) END AS n_ids,
       CASE WHEN t.page_id IS NULL THEN {_h('[0::BIGINT]')} ELSE {_h('e.ids')} END AS ids_hash
FROM (SELECT page_id FROM entries WHERE NOT is_revision) p
LEFT JOIN txt t ON t.page_id = p.page_id LEFT JOIN enc e ON e.page_id = p.page_id""",
       _TOK + [("txt", "SELECT page_id, text FROM page_texts"),
               ("pg", """SELECT p.page_id, t.text FROM (SELECT page_id FROM entries WHERE NOT is_revision) p
                         JOIN txt t ON t.page_id = p.page_id""")]
       + _ids("pg", "page_id", "text", limit=1024, eos=False))

oracle("m04_training_batches", ["entries", "meta", "page_texts"], f"""
SELECT page_id, split_rank, batch, CAST(mx AS INTEGER) AS padded_len, CAST(len(ids) AS INTEGER) AS n_ids,
       {_h("ids || list_transform(range(mx - len(ids)), lambda x: 0::BIGINT)")} AS ids_hash
FROM (SELECT b.*, e.ids, max(len(e.ids)) OVER (PARTITION BY batch) AS mx FROM (
  SELECT page_id, split_rank, CAST(floor((split_rank - 1) / 4) AS BIGINT) AS batch FROM split2 WHERE split = 'train') b
  JOIN enc e USING (page_id))""",
       _ELIG + _TOK + [("pg", "SELECT page_id, text FROM page_texts")] + _ids("pg", "page_id", "text", limit=1024, eos=False))
oracle("m10_threshold_rows", [], """
SELECT page_id, CAST(len(a) AS BIGINT) AS n, round(a[CAST(floor(len(a) * 0.95::DOUBLE) AS BIGINT) + 1], 6) AS threshold
FROM (SELECT l_returnflag AS page_id, list_sort(list(abs(CAST(l_extendedprice - 30000 AS DOUBLE)))) AS a FROM lineitem GROUP BY l_returnflag)""")

oracle("m17_remove_tokens", ["top_tokens"], f"""
SELECT doc_id, len(r) AS n_ids, {_h('r')} AS ids_hash FROM (
  SELECT doc_id, list_filter(ids, lambda x: NOT list_contains(b.banned, x)) AS r
  FROM enc, (SELECT list(token_id) AS banned FROM top10) b)""",
       _TOK + _ids("documents", "doc_id", "text", eos=False) + [
           ("top10", """SELECT token_id FROM top_tokens GROUP BY token_id
                        ORDER BY sum(abs(impact)) DESC, token_id LIMIT 10""")])


# --------------------------------------------------------------------------- S
oracle("s01_load_ledger", ["entries"], "SELECT * FROM entries")
oracle("s02_import_entries", ["entries"], "SELECT * FROM entries")
oracle("s02_import_document", ["entries"], "SELECT * FROM entries")
oracle("s02_import_metadata", ["entries", "meta"], """
SELECT e.id, e.id AS entry_id, coalesce(m.used_in_training AND length(m.model_checkpoint) > 0, false) AS used_in_training,
       CASE WHEN m.used_in_training THEN m.training_timestamp END AS training_timestamp,
       CASE WHEN m.used_in_training THEN m.model_checkpoint END AS model_checkpoint,
       round(CASE WHEN m.used_in_training THEN coalesce(m.average_loss, 0.0) END, 6) AS average_loss,
       round(CASE WHEN m.used_in_training THEN coalesce(m.relative_loss, 0.0) END, 6) AS relative_loss
FROM entries e LEFT JOIN meta m ON m.entry_id = e.id""")
oracle("s02_import_headers", ["entries", "meta", "token_impacts", "top_tokens"], """
SELECT m.id AS metadata_id, h.total_tokens, (SELECT count(*) FROM top_tokens t WHERE t.token_impact_id = h.id) AS n_tokens
FROM meta m JOIN token_impacts h ON h.metadata_id = m.id WHERE m.used_in_training""")
oracle("s03_export_nested", ["entries", "meta", "token_impacts", "top_tokens"], """
SELECT e.id, e.page_id, m.used_in_training, h.total_tokens,
       CASE WHEN h.id IS NULL THEN NULL ELSE (SELECT count(*) FROM top_tokens t WHERE t.token_impact_id = h.id) END AS n_top_tokens,
       CASE WHEN h.id IS NULL THEN NULL ELSE (SELECT min(position) FROM top_tokens t WHERE t.token_impact_id = h.id) END AS first_position
FROM entries e LEFT JOIN meta m ON m.entry_id = e.id LEFT JOIN token_impacts h ON h.metadata_id = m.id""")
oracle("s04_impact_pages", ["entries", "meta", "token_impacts", "top_tokens"], """
SELECT e.id AS entry_id, e.page_id, h.id AS token_impact_id, h.total_tokens,
       count(t.token_impact_id) AS n_top_tokens, round(coalesce(sum(t.impact), 0.0), 6) AS impact_sum
FROM entries e JOIN meta m ON m.entry_id = e.id JOIN token_impacts h ON h.metadata_id = m.id
LEFT JOIN top_tokens t ON t.token_impact_id = h.id GROUP BY ALL""")
oracle("s05_read_texts", [], """
SELECT CAST(page_id AS VARCHAR) AS page_key, length(html) AS n_chars, sha256(html) AS text_hash FROM pages""")
oracle("s06_write_revision_texts", ["feed"], """
SELECT page_id || '_' || revision_id AS page_key, sha256(content) AS text_hash FROM feed""")
oracle("s07_title_arrays", ["entries"], "SELECT title FROM entries WHERE NOT is_revision AND title IS NOT NULL")
oracle("s08_category_members", [], """
SELECT CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS INTEGER) AS pos,
       CAST(p_partkey AS BIGINT) AS pageid, p_name AS title FROM part""")
oracle("s07_write_titles", ["entries"], "SELECT page_id, title FROM entries WHERE NOT is_revision")
oracle("s08_flatten_api", ["feed"], """
SELECT page_id, title, revision_id, CAST(rn AS INTEGER) AS revision_number, content FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ts DESC, event_id DESC) AS rn FROM feed)
WHERE rn <= 5 AND page_id IN (SELECT page_id FROM feed WHERE action = 'added')""")
oracle("s11_migrate_legacy", ["legacy_impact"], """
SELECT metadata_id AS id, metadata_id, CAST(impact AS BIGINT) AS total_tokens FROM legacy_impact
WHERE token = 'total_tokens'""")


# --------------------------------------------------------------------------- ST1 (equals batch L1 on the whole feed)
oracle("st01_stream_ledger", ["feed"], "SELECT * FROM s1", [("fo", "SELECT *, sha256(content) AS content_hash FROM feed")] + _S1)

oracle("l13_reset_no_recreate", ["meta"], "SELECT count(*) AS deleted_rows, CAST(0 AS BIGINT) AS remaining_rows FROM meta")
oracle("s09_repair_utf8", [], "SELECT page_id, length(html) + 1 AS n_chars, true AS repaired FROM pages")
oracle("s10_tokenizer_files", [], """
SELECT 'vocab' AS part, id AS n, token AS "left", CAST(NULL AS VARCHAR) AS "right" FROM vocab
UNION ALL SELECT 'merges', CAST(rank AS BIGINT), l, r FROM merges""", _FIRST)
oracle("s10_merges_text", [], """
SELECT CAST(row_number() OVER (ORDER BY rank) AS INTEGER) AS rank, p[1] AS "left", p[2] AS "right"
FROM (SELECT rank, regexp_extract_all(l || ' ' || r, '\\S+') AS p FROM merges) WHERE len(p) = 2""", _FIRST)


# --------------------------------------------------------------------------- result types
# DuckDB widens counts to HUGEINT and sizes to BIGINT; pin each oracle column to the Spark type.
_I, _B = "INTEGER", "BIGINT"
CASTS: dict[str, dict[str, str]] = {
    "q08_usage_statistics": {"used_entries": _B, "unused_entries": _B},
    "q09_training_status": {"main_pages": _B, "used_main_pages": _B, "unused_main_pages": _B, "unused_revisions": _B},
    "q14_crawl_list": {"rank": _I},
    "q16_table_profile": {"value": _B},
    "i04_token_validity": {"n_invalid": _B},
    "i06_size_statistics": {"entries_with_training": _B},
    "m11_critical_tokens": {"total_tokens": _I, "context_end": _I},
    "m12_top_impacts": {"rank": _I},
    "m13_last_epoch": {"total_tokens": _I},
    "m14_nan_audit": {"token_loss_nan": _B, "logits_rows_with_nan": _B},
    "m15_top_k": {"rank": _I},
    "t01_pretokenize": {"n_raw": _I, "n_tokens": _I},
    "t04_pair_counts": {"count": _B},
    "t09_token_ids": {"n_unk": _I, "n_ids": _I},
    "t10_encode": {"n_ids": _I},
    "t11_decode": {"n_chars": _I},
    "t12_special_mask": {"mask_len": _I, "n_special": _I},
    "t13_pack_pair": {"n_ids": _I, "n_second": _I},
    "t14_pad_batches": {"mask_sum": _I, "n_pad": _I, "padded_len": _I},
    "m03_sequences": {"n_ids": _I},
    "m17_remove_tokens": {"n_ids": _I},
    "s03_export_nested": {"n_top_tokens": _I},
    "s04_impact_pages": {"n_top_tokens": _I},
    "s05_read_texts": {"n_chars": _I},
    "s09_repair_utf8": {"n_chars": _I},
}
for _name, _cols in CASTS.items():
    _repl = ", ".join(f'CAST("{c}" AS {t}) AS "{c}"' for c, t in _cols.items())
    ORACLES[_name] = f"SELECT * REPLACE ({_repl}) FROM (\n{ORACLES[_name]}\n)"


# L8 end to end: l08's entries, then revision entries of every updated page (ids after them).
oracle("l08_ingest_with_revisions", ["feed_old", "feed_new"], """
SELECT * FROM v2
UNION ALL
SELECT (SELECT max(id) FROM v2) + row_number() OVER (ORDER BY ts, page_id), title, page_id, revision_id, ts,
       content_hash, 'added', true, parent_id, revision_number
FROM (SELECT f.page_id || '_' || f.revision_id AS page_id, f.title, f.revision_id, f.ts, sha256(f.content) AS content_hash,
             f.page_id AS parent_id,
             CAST(row_number() OVER (PARTITION BY f.page_id ORDER BY f.ts DESC, f.revision_id DESC) AS INTEGER) AS revision_number
      FROM feed_new f
      WHERE f.page_id IN (SELECT s.page_id FROM snap s LEFT JOIN s1 e ON e.page_id = s.page_id
                          WHERE e.page_id IS NULL OR e.revision_id <> s.revision_id))
WHERE revision_number <= 5""", _S1_CTES + _SNAP + [("v2", _L08_BODY)])
