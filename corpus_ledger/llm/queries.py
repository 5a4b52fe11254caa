"""Registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from corpus_ledger.llm.conversation_repair import op11_conversation_repair
from corpus_ledger.llm.decontamination import op8_decontamination
from corpus_ledger.llm.embedding_dedup import op13_embedding_dedup
from corpus_ledger.llm.entropy_mixing import op3_entropy_mixing
from corpus_ledger.llm.hilbert_sharding import op1_hilbert_sharding
from corpus_ledger.llm.line_dedup import op7_line_dedup
from corpus_ledger.llm.minmax_dedup import op6_minmax_dedup
from corpus_ledger.llm.quality import op2_rff_quality
from corpus_ledger.llm.token_counts import op10_token_counts
from corpus_ledger.llm.toxicity import op4_levenshtein_toxicity
from corpus_ledger.llm.vector_clusters import op12_vector_clusters
from corpus_ledger.llm.warc_derivatives import op5_warc_derivatives
from corpus_ledger.llm.weighted_sampling import op9_weighted_sampling

QUERIES = {f.__name__: f for f in (
    op1_hilbert_sharding, op2_rff_quality, op3_entropy_mixing, op4_levenshtein_toxicity, op5_warc_derivatives,
    op6_minmax_dedup, op7_line_dedup, op8_decontamination, op9_weighted_sampling, op10_token_counts,
    op11_conversation_repair, op12_vector_clusters, op13_embedding_dedup)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_duplicate_sql(table: str, shingle_words: int, percent: int) -> str:
    """All pairs that share a shingle, their exact similarity, and the smallest reachable id."""
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM {table}
), shingles AS (
  SELECT DISTINCT doc_id, w[i:i + least({shingle_words}, len(w)) - 1] AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least({shingle_words}, len(w)) + 2)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (
  SELECT a, b FROM shared s JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * s.n >= {percent} * (p.n + q.n - s.n)
), steps AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM {table} UNION SELECT r.node, s.b FROM reach r JOIN steps s ON s.a = r.seen
), least_id AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM {table} d JOIN least_id l ON l.node = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id"""


def contamination_sql(table: str, window: int) -> str:
    words = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH items AS (SELECT item_id, {words} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, w[i:i + least({window}, len(w)) - 1] AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least({window}, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), docs AS (SELECT doc_id, {words} AS w FROM {table}
), lengths AS (SELECT DISTINCT len(s) AS k FROM windows
), places AS (
  SELECT doc_id, i, k, w[i:i + k - 1] AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, lengths WHERE len(w) >= k)
), hits AS (SELECT doc_id, i, k, item_id FROM places JOIN windows USING (s)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)"""


_USABLE = """SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def clusters_sql(dim: int, clusters: int, rounds: int, seed: int, scale: int) -> str:
    """Lloyd's rounds over integers in long form, one step of the WITH clause each."""
    steps = [f"""
WITH usable AS ({_USABLE}
), kept AS (SELECT vec_id, v FROM usable WHERE len(v) = {dim}
), vectors AS MATERIALIZED (
  SELECT vec_id, d, CAST(floor({scale} * v[d]) AS BIGINT) AS x FROM (SELECT vec_id, v, unnest(range(1, {dim} + 1)) AS d FROM kept)
), firsts AS (
  SELECT vec_id, row_number() OVER (ORDER BY h, v) - 1 AS c
  FROM (SELECT vec_id, v, sha256('{seed}:' || vec_id) AS h FROM kept ORDER BY h, v LIMIT {clusters})
), centers_0 AS MATERIALIZED (SELECT c, d, x FROM firsts JOIN vectors USING (vec_id))"""]
    for r in range(rounds + 1):
        steps.append(f"""
, assigned_{r} AS MATERIALIZED (
  SELECT vec_id, arg_min(c, (distance, c)) AS c, min(distance) AS distance FROM (
    SELECT vec_id, c, sum((p.x - q.x) * (p.x - q.x)) AS distance
    FROM vectors p JOIN centers_{r} q USING (d) GROUP BY vec_id, c) GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""
, means_{r} AS (
  SELECT c, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM vectors JOIN assigned_{r} USING (vec_id) GROUP BY c, d
), centers_{r + 1} AS MATERIALIZED (
  SELECT c, d, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x
  FROM centers_{r} LEFT JOIN means_{r} USING (c, d))""")
    return "".join(steps) + f"""
, named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM centers_{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM assigned_{rounds} JOIN named USING (c)"""


def near_vectors_sql(least: float) -> str:
    """Every pair of vectors compared."""
    return f"""
WITH RECURSIVE whole AS ({_USABLE}
), usable AS (SELECT vec_id, v FROM whole WHERE len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE CASE WHEN len(x.v) = len(y.v) THEN list_cosine_similarity(x.v, y.v) END >= {least}
), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
), least_id AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN least_id l ON l.node = vec_id LEFT JOIN counts ON a = vec_id"""


_CRC32 = """xor(list_reduce(list_transform(string_split(k, ''), lambda x: CAST(ord(x) AS BIGINT)),
                  lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"""


def repair_sql() -> str:
    """One row of every conversation per step: the cheapest way, of equals the ASCII-least, to each state ('' is the
    start, then the initial of the last role)."""
    following = "CASE WHEN {0} = 'u' THEN 'a' ELSE 'u' END"
    name = "CASE WHEN {0} = 'u' THEN 'user' ELSE 'assistant' END"
    blank = "[^\\x20\\x09-\\x0D]"
    one, two = following.format("st"), following.format(f"({following.format('st')})")
    return f"""
WITH RECURSIVE tab AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, k:
    CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM range(256) r(i))
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC32} % 20 AS fate
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations), tab
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM keyed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), seen AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS r, NOT regexp_matches(text, '{blank}') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         regexp_extract(text, '({blank})[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') AS open_end FROM placed
), marked AS MATERIALIZED (
  SELECT conv_id, turn, role, text, i, r, blank, NOT blank AND again AS duplicate, NOT blank AND NOT again AND open_end AS cut,
         lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM seen
), ways AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '' AS st, CAST(0 AS BIGINT) AS cost, '' AS audit, []::VARCHAR[] AS said FROM marked
  UNION ALL
  SELECT conv_id, i, st, best.cost, best.audit, best.said FROM (
    SELECT conv_id, i, st, arg_min({{'cost': cost, 'audit': audit, 'said': said}}, {{'cost': cost, 'audit': audit}}) AS best FROM (
      SELECT conv_id, i, CASE e WHEN 'D' THEN st WHEN 'K' THEN r ELSE {following.format("st")} END AS st,
             cost + CASE e WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN cut AND e <> 'D' THEN 5 ELSE 0 END AS cost,
             audit || e AS audit,
             CASE e WHEN 'D' THEN said WHEN 'K' THEN said || [role || ':' || text]
                    ELSE said || [{name.format(f"({following.format('st')})")} || ':' || text] END AS said
      FROM (
        SELECT m.conv_id, m.i, m.r, m.role, m.text, m.cut, m.blank OR m.duplicate AS gone, p.st, p.cost, p.audit, p.said, unnest(['D', 'K', 'R']) AS e
        FROM (
          SELECT conv_id, i, cost + 5 * n AS cost, audit || repeat('I', n) AS audit, CASE n WHEN 0 THEN st WHEN 1 THEN {one} ELSE {two} END AS st,
                 CASE n WHEN 0 THEN said WHEN 1 THEN said || [{name.format(f"({one})")} || ':']
                        ELSE said || [{name.format(f"({one})")} || ':', {name.format(f"({two})")} || ':'] END AS said
          FROM (SELECT *, unnest([0, 1, 2]) AS n FROM ways)) p
        JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i + 1)
      WHERE e = 'D' OR (NOT gone AND (e = 'R' OR r = {following.format("st")} OR (r = 's' AND st = ''))))
    GROUP BY conv_id, i, st)
), ends AS (
  SELECT conv_id, arg_min({{'cost': cost, 'audit': audit, 'said': said}}, {{'cost': cost, 'audit': audit}}) AS best FROM (
    SELECT conv_id, cost + CASE st WHEN 'u' THEN 5 WHEN 's' THEN 10 ELSE 0 END AS cost,
           audit || CASE st WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END AS audit,
           CASE st WHEN 'u' THEN said || ['assistant:'] WHEN 's' THEN said || ['user:', 'assistant:'] ELSE said END AS said
    FROM ways JOIN (SELECT conv_id AS c, max(i) AS n FROM marked GROUP BY conv_id) ON c IS NOT DISTINCT FROM conv_id AND n = i)
  GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
         count_if(duplicate) AS duplicate, count_if(cut) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id)
SELECT a.conv_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))},
       CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit,
       sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM a.conv_id"""


ORACLES = {
    "op6_minmax_dedup": near_duplicate_sql("documents", 2, 80),
    "op8_decontamination": contamination_sql("documents", 10),
    "op11_conversation_repair": repair_sql(),
    "op12_vector_clusters": clusters_sql(64, 8, 10, 3, 1024),
    "op13_embedding_dedup": near_vectors_sql(0.9),
}
