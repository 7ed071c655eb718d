"""DuckDB SQL building blocks for the twins of the queries."""

from __future__ import annotations

from quarry.config import STOPWORDS

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)

#: Chunks of documents: chunks(doc_id, idx, text).
CHUNKS = """src AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM documents),
 walk(doc_id, s, k, start, win) AS (
  SELECT doc_id, s, 0, 0, substr(s, 1, 800) FROM src WHERE length(s) > 0
  UNION ALL
  SELECT doc_id, s, k + 1, nxt, substr(s, nxt + 1, 800) FROM (
   SELECT doc_id, s, k, start, stop, greatest(stop - 120, start + 1) AS nxt FROM (
    SELECT *, start + CASE WHEN cut > 400 THEN cut + 1 ELSE length(win) END AS stop FROM (
     SELECT *, CASE WHEN contains(win, chr(10) || chr(10)) THEN length(win) - length(list_last(string_split(win, chr(10) || chr(10)))) - 2
                    WHEN contains(win, '. ') THEN length(win) - length(list_last(string_split(win, '. '))) - 2 ELSE -1 END AS cut FROM walk))
   ) WHERE stop < length(s)),
 cuts AS (SELECT doc_id, k, trim(substr(win, 1, CASE WHEN cut > 400 THEN cut + 1 ELSE length(win) END), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM (
   SELECT *, CASE WHEN contains(win, chr(10) || chr(10)) THEN length(win) - length(list_last(string_split(win, chr(10) || chr(10)))) - 2
                  WHEN contains(win, '. ') THEN length(win) - length(list_last(string_split(win, '. '))) - 2 ELSE -1 END AS cut FROM walk)),
 hashed AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS idx, text FROM cuts WHERE text <> ''),
 named AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id || ':' || idx)) AS h FROM hashed),
 chunks AS (SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id, doc_id, idx, text FROM named)"""

#: Entity mentions and edge evidence of the record graph.
GRAPH = """places AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
 o AS (SELECT 'o' || o_orderkey AS chunk_id, 'c' || c_custkey AS doc_id, o_orderkey * 1000 AS base, c_name, n_name, r_name, CAST(year(o_orderdate) AS VARCHAR) AS y
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey),
 l AS (SELECT 'l' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS chunk_id, 's' || s_suppkey AS doc_id, 100000000000000 + l_orderkey * 1000 + l_linenumber * 10 AS base, s_name, p_name, n_name, CAST(year(l_shipdate) AS VARCHAR) AS y
       FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY ALL) JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN places ON s_nationkey = n_nationkey),
 named AS (SELECT chunk_id, doc_id, base + 0 AS ord, c_name AS name, 'PERSON' AS type FROM o UNION ALL SELECT chunk_id, doc_id, base + 1, n_name, 'LOCATION' FROM o
   UNION ALL SELECT chunk_id, doc_id, base + 2, r_name, 'LOCATION' FROM o UNION ALL SELECT chunk_id, doc_id, base + 3, y, 'DATE' FROM o
   UNION ALL SELECT chunk_id, doc_id, base + 0, s_name, 'ORGANIZATION' FROM l UNION ALL SELECT chunk_id, doc_id, base + 1, p_name, 'PRODUCT' FROM l
   UNION ALL SELECT chunk_id, doc_id, base + 2, n_name, 'LOCATION' FROM l UNION ALL SELECT chunk_id, doc_id, base + 3, y, 'DATE' FROM l),
 mentions AS (SELECT lower(name) AS entity_key, * FROM named),
 related AS (SELECT chunk_id, base + 1 AS ord, c_name AS source, 'HAS_COUNTRY' AS relation, n_name AS target FROM o UNION ALL SELECT chunk_id, base + 2, c_name, 'HAS_REGION', r_name FROM o
   UNION ALL SELECT chunk_id, base + 3, c_name, 'HAS_ORDER_DATE', y FROM o UNION ALL SELECT chunk_id, base + 1, s_name, 'HAS_PRODUCT', p_name FROM l
   UNION ALL SELECT chunk_id, base + 2, s_name, 'HAS_COUNTRY', n_name FROM l UNION ALL SELECT chunk_id, base + 3, s_name, 'HAS_SHIP_DATE', y FROM l),
 evidence AS (SELECT lower(source) AS src_key, relation, lower(target) AS dst_key, chunk_id, ord FROM related WHERE lower(source) <> lower(target))"""

EDGES = """edges AS (SELECT CASE WHEN turned THEN hi ELSE lo END AS src_key, CASE WHEN turned THEN lo ELSE hi END AS dst_key, relation, weight, n_chunks FROM (
   SELECT least(src_key, dst_key) AS lo, greatest(src_key, dst_key) AS hi, relation, count(*) AS weight, count(DISTINCT chunk_id) AS n_chunks, arg_min(src_key > dst_key, ord) AS turned FROM evidence GROUP BY 1, 2, 3)),
 both_ways AS (SELECT src_key AS seed, dst_key AS other, weight FROM edges UNION ALL SELECT dst_key, src_key, weight FROM edges)"""

ENTITIES = """entities AS (SELECT entity_key, arg_min(name, ord) AS name, arg_min(type, ord) AS type, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT doc_id) AS n_docs FROM mentions GROUP BY 1)"""

#: One hop from the entities of seeds(qid, chunk_id).
EXPAND = """seed_entities AS (SELECT DISTINCT qid, entity_key AS seed FROM seeds JOIN mentions USING (chunk_id)),
 reached AS (SELECT qid, other, sum(weight) AS weight FROM seed_entities JOIN both_ways USING (seed) JOIN entities e ON e.entity_key = other AND e.type <> 'DATE'
   WHERE NOT EXISTS (SELECT 1 FROM seed_entities s WHERE s.qid = seed_entities.qid AND s.seed = other) GROUP BY 1, 2),
 links AS (SELECT DISTINCT entity_key, chunk_id FROM mentions),
 hop AS (SELECT qid, l.chunk_id, CAST(sum(weight) AS BIGINT) AS score FROM reached JOIN links l ON l.entity_key = other
   WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.qid = reached.qid AND s.chunk_id = l.chunk_id) GROUP BY 1, 2)"""

KEYWORDS = f"""asked_words AS (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[A-Za-z0-9_]+'), 1) AS i FROM benchmark),
 first_words AS (SELECT qid, w, min(i) AS i FROM asked_words WHERE length(w) >= 3 AND w NOT IN ({STOP}) GROUP BY 1, 2),
 kws AS (SELECT qid, w, i FROM first_words QUALIFY row_number() OVER (PARTITION BY qid ORDER BY i) <= 8)"""

KEYWORD_HITS = """toks AS (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM chunks),
 cand AS (SELECT DISTINCT qid, chunk_id FROM kws JOIN toks USING (w) WHERE length(w) BETWEEN 2 AND 20),
 pool AS (SELECT qid, chunk_id FROM cand QUALIFY row_number() OVER (PARTITION BY qid ORDER BY chunk_id) <= 500),
 kscored AS (SELECT qid, chunk_id, count(*) FILTER (WHERE contains(lower(c.text), kws.w)) AS score FROM pool JOIN chunks c USING (chunk_id) JOIN kws USING (qid) GROUP BY 1, 2),
 keyword AS (SELECT qid, chunk_id, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM kscored WHERE score > 0 QUALIFY rank <= 15)"""

COSINE = """scored AS (SELECT q.vec_id AS qid, e.vec_id AS chunk_id, e.label AS doc_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)"""
VECTOR = COSINE + """, vector AS (SELECT qid, chunk_id, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 15)"""


def with_(*parts: str, select: str, recursive: bool = False) -> str:
    """One statement from building blocks."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n ".join(parts) + "\n" + select
