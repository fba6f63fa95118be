"""DuckDB SQL of the registered retrieval queries."""

from __future__ import annotations

WS = r"[\s\x1c-\x1f\x85\p{Z}]+"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"


def tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[ \t\n\r\f]+'), lambda t: t <> '')"


def count_tokens(x: str) -> str:
    return f"len({tokens(x)})"


def listed(x: str, sep: str = ";") -> str:
    return f"array_to_string({x}, '{sep}')"


DENSE = "SELECT l_orderkey, p_brand AS e, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey"
SPARSE = "SELECT l_orderkey, 'p' || l_partkey AS e, l_quantity FROM lineitem"


def edges(lines: str = DENSE, name: str = "edges") -> str:
    """CTEs ending in ``name``: merged hyperedges."""
    return f"""
{name}_rec AS (SELECT l_orderkey, list_sort(list_distinct(list(e))) AS m, sum(l_quantity) AS w FROM ({lines}) GROUP BY l_orderkey),
{name} AS (
  SELECT array_to_string(m, '|#|') AS edge_key, m AS entity_set, list_sort(list_distinct(list(o_orderpriority))) AS description,
         list_sort(list_distinct(list(o_orderstatus))) AS keywords, list_sort(list('order-' || l_orderkey)) AS source_id,
         sum(w) AS weight, len(m) AS arity
  FROM {name}_rec JOIN orders ON o_orderkey = l_orderkey GROUP BY m)"""


VERTICES = f"""
votes AS (SELECT p_brand AS n, p_type AS t, count(*) AS c, min(p_partkey) AS f FROM part GROUP BY 1, 2),
kinds AS (SELECT n, t FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY c DESC, f) AS r FROM votes) WHERE r = 1),
brands AS (SELECT p_brand AS n, list_sort(list_distinct(list(p_name))) AS d, list_sort(list_distinct(list('size ' || p_size))) AS props, count(DISTINCT p_partkey) AS parts FROM part GROUP BY 1),
srcs AS (SELECT e AS n, list_sort(list_distinct(list('order-' || l_orderkey))) AS source_id FROM ({DENSE}) GROUP BY 1),
vertices AS (SELECT n AS entity_name, t AS entity_type, d AS description, props, source_id FROM kinds JOIN brands USING (n) JOIN srcs USING (n))"""
CHUNKS = "chunks AS (SELECT 'order-' || o_orderkey AS chunk_id, 'order-' || o_orderkey || ' ' || o_orderstatus || ' ' || o_orderpriority AS content FROM orders)"
INC = "inc AS (SELECT edge_key, unnest(entity_set) AS entity_name FROM edges)"
SIM = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


def entity_hits(k: int = 6) -> str:
    return f"""
names AS (SELECT DISTINCT p_brand AS entity_name, substr(p_brand, 7)::INT AS vec_id FROM part),
hits AS (SELECT entity_name, sim, (row_number() OVER (ORDER BY sim DESC, entity_name) - 1)::INT AS rank FROM (
  SELECT entity_name, {SIM} AS sim FROM names JOIN embeddings a USING (vec_id), (SELECT embedding FROM embeddings WHERE vec_id = 0) b)
  WHERE sim >= 0 ORDER BY rank LIMIT {k})"""


def edge_hits(k: int = 40, where: str = "true") -> str:
    return f"""
ekeys AS (SELECT edge_key, ('0x' || substr(md5(edge_key), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id FROM edges WHERE {where}),
ehits AS (SELECT edge_key, (row_number() OVER (ORDER BY sim DESC, edge_key) - 1)::INT AS rank FROM (
  SELECT edge_key, {SIM} AS sim FROM ekeys JOIN embeddings a USING (vec_id), (SELECT embedding FROM embeddings WHERE vec_id = 0) b)
  WHERE sim >= 0 ORDER BY rank LIMIT {k})"""


def budget(rows: str, text: str, most: int, order: str) -> str:
    return f"SELECT * FROM (SELECT *, sum({count_tokens(text)}) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS run FROM ({rows})) WHERE run <= {most}"


GRAPH = f"WITH {edges()}, {VERTICES}, {CHUNKS}, {INC}"
SAID = "array_to_string(description, '<SEP>')"
EDGE_ORDER = "arity DESC, weight DESC, edge_key"
ENT_EDGES = budget(f"SELECT *, {SAID} AS said FROM edges WHERE edge_key IN (SELECT edge_key FROM inc JOIN hits USING (entity_name))", "said", 200, EDGE_ORDER)
ENT_CHUNKS_CTE = """
cited AS (SELECT rank, entity_name, unnest(source_id) AS chunk_id FROM vertices JOIN hits USING (entity_name)),
firsts AS (SELECT chunk_id, min(rank) AS rank, arg_min(entity_name, rank) AS entity_name FROM cited GROUP BY 1),
times AS (SELECT i.entity_name, j.entity_name AS member, count(*) AS n FROM inc i JOIN hits USING (entity_name) JOIN inc j ON i.edge_key = j.edge_key GROUP BY 1, 2),
rel AS (SELECT entity_name, chunk_id, sum(n)::BIGINT AS relation_counts FROM (SELECT t.entity_name, n, unnest(v.source_id) AS chunk_id FROM times t JOIN vertices v ON v.entity_name = member) GROUP BY 1, 2),
crows AS (SELECT chunk_id, rank, coalesce(relation_counts, 0) AS relation_counts, content FROM firsts LEFT JOIN rel USING (entity_name, chunk_id) JOIN chunks USING (chunk_id))"""
ENT_CHUNKS = budget("SELECT * FROM crows", "content", 400, "rank, relation_counts DESC, chunk_id")
REL_CTE = f"""
redges AS (SELECT *, (row_number() OVER (ORDER BY arity DESC, weight DESC, rank) - 1)::INT AS pos FROM ({budget(f"SELECT *, {SAID} AS said FROM edges JOIN ehits USING (edge_key)", "said", 60, "arity DESC, weight DESC, rank")})),
rmem AS (SELECT entity_name, min(pos) AS pos FROM (SELECT pos, unnest(entity_set) AS entity_name FROM redges) GROUP BY 1),
rents AS ({budget(f"SELECT entity_name, pos, {SAID} AS said FROM rmem JOIN vertices USING (entity_name)", "said", 300, "pos, entity_name")}),
rsrc AS (SELECT chunk_id, min(pos) AS pos FROM (SELECT pos, unnest(source_id) AS chunk_id FROM redges) GROUP BY 1),
rchunks AS ({budget("SELECT chunk_id, pos, content FROM rsrc JOIN chunks USING (chunk_id)", "content", 100, "pos, chunk_id")})"""


def combined(first: str, second: str, key: str) -> str:
    return f"""SELECT (row_number() OVER (ORDER BY line, pos))::INT AS id, {key} FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY line, pos) AS r FROM (
    SELECT {key}, pos, 0 AS line FROM ({first}) UNION ALL SELECT {key}, pos, 1 FROM ({second}))) WHERE r = 1"""


BOTH = f"{GRAPH}, {entity_hits()}, {edge_hits()}, {ENT_CHUNKS_CTE}, {REL_CTE}"
STATUS_SEP = "edge_key, arity::INT AS arity, weight, array_to_string(description, ';') AS description, array_to_string(keywords, ';') AS keywords, len(source_id)::INT AS n_sources"
WINDOWS = f"""
toks AS (SELECT 'd' || doc_id AS full_doc_id, {tokens("text")} AS t FROM documents WHERE text IS NOT NULL),
starts AS (SELECT full_doc_id, t, unnest(range(0, len(t), 48)) AS s FROM toks),
wins AS (SELECT 'chunk-' || md5({strip("array_to_string(t[s + 1 : s + 64], ' ')")}) AS chunk_id, full_doc_id, (s / 48)::INT AS chunk_order_index, least(64, len(t) - s)::INT AS tokens FROM starts)"""
DOC_KEY = f"'doc-' || md5({strip('text')})"
EDGE_TEXT = """
ords AS (SELECT l_orderkey, list_sort(list_distinct(list(p_brand))) AS m, sum(l_quantity)::INT AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""
TYPED = f"""{GRAPH},
v AS (SELECT entity_name, CASE WHEN entity_type = 'ECONOMY' THEN 'OTHER' ELSE entity_type END AS t FROM vertices),
typed AS (SELECT edge_key, x.t AS type_a, y.t AS type_b FROM edges JOIN v x ON x.entity_name = entity_set[1] JOIN v y ON y.entity_name = entity_set[2] WHERE arity = 2)"""


def hops(seeds: str) -> str:
    return f"""WITH {edges(SPARSE)}, {INC}, seeds AS (SELECT unnest({seeds}) AS v),
nb AS (SELECT DISTINCT i.entity_name AS v, j.entity_name AS u FROM inc i JOIN inc j ON i.edge_key = j.edge_key WHERE i.entity_name <> j.entity_name),
h AS (SELECT v, 0 AS hop FROM seeds UNION ALL SELECT u, 1 FROM nb JOIN seeds USING (v) UNION ALL SELECT b.u, 2 FROM nb a JOIN seeds USING (v) JOIN nb b ON b.v = a.u),
near AS (SELECT v AS entity_name, min(hop)::INT AS hop FROM h GROUP BY 1)"""


LINE = """CASE WHEN event_id % 10 = 0 THEN 'bad_json' WHEN event_id % 10 = 1 THEN 'not_object' WHEN event_id % 10 = 2 THEN 'empty_context' WHEN event_id % 10 = 3 THEN 'blank' ELSE 'ok' END"""

ORACLES = {
    "doc_dedup": f"SELECT {DOC_KEY} AS doc_key, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1",
    "new_docs": f"SELECT DISTINCT {DOC_KEY} AS doc_id FROM documents WHERE doc_id % 2 = 1 AND text IS NOT NULL AND {DOC_KEY} NOT IN (SELECT {DOC_KEY} FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)",
    "kv_insert_if_absent": "WITH kv AS (SELECT 'k' || (doc_id // 3) AS k, doc_id % 2 AS odd, min(doc_id) AS v FROM documents GROUP BY 1, 2) SELECT k, v FROM kv WHERE odd = 0 UNION ALL SELECT k, v FROM kv WHERE odd = 1 AND k NOT IN (SELECT k FROM kv WHERE odd = 0)",
    "chunk_windows": f"WITH {WINDOWS} SELECT w.* FROM wins w",
    "chunk_dedup_last_wins": f"WITH {WINDOWS} SELECT chunk_id, full_doc_id, chunk_order_index FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY full_doc_id DESC, chunk_order_index DESC) AS r FROM wins) WHERE r = 1",
    "token_budget": f"SELECT lang, doc_id FROM (SELECT lang, doc_id, sum({count_tokens('text')}) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM documents) WHERE run <= 5000",
    "entity_record_parse": "SELECT upper(p_name) AS entity_name, upper(p_type) AS entity_type, 'made by ' || p_brand AS description, 'size ' || p_size AS additional_properties, 'part-' || p_partkey AS source_id FROM part",
    "edge_record_parse_low": f"WITH {EDGE_TEXT} SELECT upper(array_to_string(m, ';')) AS members, 'bought together' AS description, '' AS generalization, 'order' AS keywords, w::DOUBLE AS weight, 'order-' || l_orderkey AS source_id FROM ords WHERE len(m) >= 2",
    "edge_record_parse_high": f"WITH {EDGE_TEXT} SELECT upper(array_to_string(m, ';')) AS members, 'bought together' AS description, 'a basket' AS generalization, 'order' AS keywords, 0.75::DOUBLE AS weight, 'order-' || l_orderkey AS source_id FROM ords WHERE len(m) >= 2",
    "extraction_progress": f"WITH {EDGE_TEXT}, n AS (SELECT count(*) AS c FROM ords WHERE len(m) >= 2) SELECT (SELECT count(*) FROM part) AS n_entities, c AS n_low, c AS n_high, 2 * c AS n_relations FROM n",
    "entity_type_vote": "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)) WHERE r = 1",
    "entity_merge": f"WITH {VERTICES} SELECT n AS entity_name, t AS entity_type, {listed('d')} AS description, {listed('props')} AS additional_properties, parts::INT AS n_sources FROM kinds JOIN brands USING (n)",
    "edge_merge": f"WITH {edges()} SELECT {STATUS_SEP} FROM edges",
    "edge_merge_incremental": f"WITH {edges()} SELECT {STATUS_SEP} FROM edges",
    "unknown_backfill": f"{GRAPH}, miss AS (SELECT entity_name, unnest(source_id) AS s FROM inc JOIN edges USING (edge_key) WHERE NOT entity_name > 'Brand#2') SELECT entity_name, entity_type, len(source_id)::INT AS n_sources FROM vertices WHERE entity_name > 'Brand#2' UNION ALL SELECT entity_name, 'UNKNOWN', count(DISTINCT s)::INT FROM miss GROUP BY 1",
    "vector_texts": f"{GRAPH} SELECT 'ent-' || md5(entity_name) AS id, entity_name AS name, md5(entity_name || {SAID}) AS text_md5 FROM vertices UNION ALL SELECT 'rel-' || md5(edge_key), edge_key, md5(array_to_string(keywords, '<SEP>') || array_to_string(entity_set, ', ') || {SAID}) FROM edges",
    "vertex_degree": f"WITH {edges()}, {INC} SELECT entity_name, count(*) AS degree FROM inc GROUP BY 1",
    "edge_arity": f"WITH {edges(SPARSE)} SELECT arity::INT AS arity, count(*) AS n_edges FROM edges GROUP BY 1",
    "graph_counts": f"WITH {edges()} SELECT (SELECT count(DISTINCT p_brand) FROM part) AS n_vertices, count(*) AS n_edges FROM edges",
    "vertex_neighbors": f"WITH {edges()}, {INC} SELECT DISTINCT i.entity_name, j.entity_name AS neighbor FROM inc i JOIN inc j ON i.edge_key = j.edge_key AND i.entity_name <> j.entity_name",
    "vertex_neighbors_sparse": f"WITH {edges(SPARSE)}, {INC} SELECT DISTINCT i.entity_name, j.entity_name AS neighbor FROM inc i JOIN inc j ON i.edge_key = j.edge_key AND i.entity_name <> j.entity_name",
    "incident_edges": f"WITH {edges(SPARSE)} SELECT edge_key, arity::INT AS arity, weight FROM edges WHERE list_contains(entity_set, 'p7')",
    "edge_neighborhood": f"WITH {edges(SPARSE)}, {INC}, me AS (SELECT unnest(entity_set) AS v FROM edges WHERE edge_key = (SELECT min(edge_key) FROM edges)), near AS (SELECT DISTINCT edge_key FROM inc JOIN me ON v = entity_name) SELECT 'edge' AS kind, edge_key AS id FROM near UNION ALL SELECT DISTINCT 'vertex', entity_name FROM inc JOIN near USING (edge_key)",
    "two_hop": f"{hops(repr(['p7']))} SELECT * FROM near",
    "frequent_vertices": f"WITH {edges(SPARSE)}, {INC} SELECT entity_name, count(*) AS degree FROM inc GROUP BY 1 HAVING count(*) >= 30",
    "vertex_page": f"WITH {VERTICES} SELECT entity_name, entity_type FROM vertices ORDER BY entity_name LIMIT 10 OFFSET 10",
    "edge_page": f"WITH {edges()} SELECT array_to_string(entity_set, '|*|') AS id, array_to_string(keywords, ',') AS keywords, {SAID} AS summary, array_to_string(keywords, ',') AS description FROM edges ORDER BY 1 LIMIT 20 OFFSET 40",
    "page_info": f"WITH {edges()} SELECT count(*) AS total, ceil(count(*) / 20)::BIGINT AS total_pages FROM edges",
    "remove_vertex": f"WITH {edges()}, cut AS (SELECT list_filter(entity_set, lambda x: x <> 'Brand#7') AS m, weight, source_id, list_contains(entity_set, 'Brand#7') AS hit FROM edges) SELECT array_to_string(m, '|#|') AS edge_key, sum(weight) AS weight, len(m)::INT AS arity, len(list_distinct(flatten(list(source_id))))::INT AS n_sources FROM cut WHERE NOT hit OR len(m) >= 2 GROUP BY m",
    "remove_edge": f"WITH {edges()} SELECT edge_key, weight FROM edges WHERE arity > 1",
    "upsert_vertex": f"WITH {VERTICES} SELECT entity_name, CASE entity_name WHEN 'Brand#1' THEN 'RENAMED' ELSE entity_type END AS entity_type FROM vertices UNION ALL SELECT 'Brand#NEW', 'FRESH'",
    "vertex_exists": "SELECT 'Brand#' || s_suppkey AS entity_name FROM supplier WHERE 'Brand#' || s_suppkey IN (SELECT p_brand FROM part)",
    "edge_exists": f"WITH {edges()}, asked AS (SELECT unnest([['Brand#1','Brand#2'],['Brand#2','Brand#1','Brand#3'],['Brand#1','x']]) AS m) SELECT array_to_string(m, ';') AS members FROM asked WHERE list_sort(m) IN (SELECT entity_set FROM edges)",
    "clique_expansion": f"WITH {edges()}, {INC} SELECT i.edge_key, i.entity_name AS a, j.entity_name AS b FROM inc i JOIN inc j ON i.edge_key = j.edge_key AND i.entity_name < j.entity_name",
    "pair_weights": f"WITH {edges()}, {INC} SELECT i.entity_name AS a, j.entity_name AS b, sum(weight) AS weight, count(*) AS n_edges FROM inc i JOIN inc j ON i.edge_key = j.edge_key AND i.entity_name < j.entity_name JOIN edges e ON e.edge_key = i.edge_key GROUP BY 1, 2",
    "cosine_topk": f"SELECT * FROM (SELECT a.vec_id, {SIM} AS sim FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b) WHERE sim >= 0.2 ORDER BY sim DESC, vec_id LIMIT 60",
    "cosine_topk_batch": f"SELECT query_id, vec_id, sim, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM (SELECT b.vec_id AS query_id, a.vec_id, {SIM} AS sim FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0) WHERE sim >= 0.2) WHERE rank <= 10",
    "naive_context": f"WITH top AS (SELECT vec_id, row_number() OVER (ORDER BY sim DESC, vec_id) AS rank FROM (SELECT a.vec_id, {SIM} AS sim FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b) WHERE sim >= 0.2 ORDER BY rank LIMIT 60), kept AS ({budget('SELECT text, rank FROM top JOIN documents ON doc_id = vec_id', 'text', 1600, 'rank')}) SELECT string_agg(text, '--New Chunk--' || chr(10) ORDER BY rank) AS context, count(*) AS n_chunks FROM kept",
    "entity_line_entities": f"{GRAPH}, {entity_hits()}, deg AS (SELECT entity_name, count(*) AS degree FROM inc GROUP BY 1) SELECT rank, entity_name, entity_type, degree, {listed('description')} AS description FROM vertices JOIN hits USING (entity_name) JOIN deg USING (entity_name)",
    "entity_line_edges": f"{GRAPH}, {entity_hits()} SELECT (row_number() OVER (ORDER BY {EDGE_ORDER}) - 1)::INT AS pos, edge_key, arity::INT AS arity, weight FROM ({ENT_EDGES})",
    "entity_line_chunks": f"{GRAPH}, {entity_hits()}, {ENT_CHUNKS_CTE} SELECT chunk_id, rank, relation_counts FROM ({ENT_CHUNKS})",
    "relation_line_edges": f"{GRAPH}, {edge_hits()}, {REL_CTE} SELECT pos, edge_key, arity::INT AS arity, weight FROM redges",
    "relation_line_entities": f"{GRAPH}, {edge_hits()}, {REL_CTE} SELECT pos, entity_name FROM rents",
    "relation_line_chunks": f"{GRAPH}, {edge_hits()}, {REL_CTE} SELECT pos, chunk_id FROM rchunks",
    "pairwise_edges": f"{GRAPH}, {edge_hits(200, 'arity <= 3')} SELECT rank, edge_key, weight FROM edges JOIN ehits USING (edge_key) WHERE arity = 2",
    "hyper_entities": f"{BOTH} {combined('SELECT entity_name, rank AS pos FROM hits JOIN vertices USING (entity_name)', 'SELECT entity_name, row_number() OVER (ORDER BY pos, entity_name) - 1 AS pos FROM rents', 'entity_name')}",
    "hyper_edges": f"{BOTH} {combined(f'SELECT edge_key, row_number() OVER (ORDER BY {EDGE_ORDER}) - 1 AS pos FROM ({ENT_EDGES})', 'SELECT edge_key, pos FROM redges', 'edge_key')}",
    "hyper_sources": f"{BOTH} {combined(f'SELECT chunk_id, row_number() OVER (ORDER BY rank, relation_counts DESC, chunk_id) - 1 AS pos FROM ({ENT_CHUNKS})', 'SELECT chunk_id, row_number() OVER (ORDER BY pos, chunk_id) - 1 AS pos FROM rchunks', 'chunk_id')}",
    "csv_section": f"""WITH {VERTICES} SELECT 'id,entity,said~' || string_agg((n - 1)::VARCHAR || ',' || entity_name || ',"says ""' || entity_type || '"", twice"', '~' ORDER BY n) AS csv FROM (SELECT *, row_number() OVER (ORDER BY entity_name) AS n FROM vertices)""",
    "distinct_contexts": "SELECT md5(text) AS context, min(doc_id) AS pos FROM documents GROUP BY 1",
    "sliding_reference": "SELECT item_id, md5(a || b || c) AS reference FROM (SELECT item_id, text AS a, lead(text, 1) OVER (ORDER BY item_id) AS b, lead(text, 2) OVER (ORDER BY item_id) AS c FROM benchmark) WHERE c IS NOT NULL",
    "jsonl_validation": f"SELECT count(*) FILTER (k <> 'blank') AS n_rows, count(*) FILTER (k = 'bad_json') AS n_bad_json, count(*) FILTER (k = 'not_object') AS n_not_object, count(*) FILTER (k = 'empty_context') AS n_empty_context FROM (SELECT {LINE} AS k FROM events)",
    "keyword_parse": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ', Z' WHEN 1 THEN c_name END AS high, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN '' END AS low FROM customer",
    "score_mean": "SELECT *, (comprehensiveness + diversity + empowerment + logical + readability) / 5 AS mean FROM (SELECT avg(doc_id * 3 % 10) AS comprehensiveness, avg(doc_id * 4 % 10) AS diversity, avg(doc_id * 5 % 10) AS empowerment, avg(doc_id * 6 % 10) AS logical, avg(doc_id * 7 % 10) AS readability FROM labels)",
    "win_rate": "WITH w AS (SELECT n AS criterion, avg(CASE WHEN (doc_id + doc_id // (n + 2)) % 2 = 0 THEN 1 ELSE 0 END) AS rate FROM labels, (SELECT unnest(range(8))::INT AS n) GROUP BY n) SELECT * FROM w UNION ALL SELECT -1, avg(rate) FROM w",
    "outcome_counts": "SELECT count(*) FILTER (event_type <> 'error') AS n_ok, count(*) FILTER (event_type = 'error') AS n_failed, count(*) AS n_total FROM events",
    "message_pack": "SELECT conv_id, pos::INT AS pos, CASE WHEN pos % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, md5(text) AS content FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS pos FROM conversations)",
    "cache_lookup": "WITH c AS (SELECT conv_id, turn, md5(role || '/' || text) AS h FROM conversations), k AS (SELECT DISTINCT h FROM c WHERE conv_id % 2 = 0) SELECT conv_id, turn, upper(k.h) AS cached FROM c LEFT JOIN k ON c.h = k.h",
    "db_name": r"SELECT page_id, coalesce(nullif(substr(regexp_replace(regexp_replace(split_part(url, '/', -1), '(.)\.[^./]*$', '\1'), '[^\pL\pM\p{Nd}\p{Pc}一-鿿]', '', 'g'), 1, 5), ''), 'default') AS db FROM pages",
    "rate_limit": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, n, t AS o, 1 AS c, 0::BIGINT AS no FROM e WHERE n = 1
UNION ALL SELECT f.user_id, e.n, CASE WHEN e.t - o >= 86400000000 THEN e.t ELSE o END, CASE WHEN e.t - o >= 86400000000 THEN 1 WHEN c >= 3 THEN c ELSE c + 1 END, no + CASE WHEN e.t - o < 86400000000 AND c >= 3 THEN 1 ELSE 0 END
FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, max(n) AS n_events, max(no) AS n_rejected FROM f GROUP BY 1""",
    "typed_validity": f"{TYPED} SELECT edge_key, type_a, type_b, CASE WHEN type_a = type_b AND type_a IN (SELECT p_type FROM part) THEN 'valid' WHEN type_a = 'OTHER' OR type_b = 'OTHER' THEN 'weak_valid' ELSE 'invalid' END AS schema_validity FROM typed",
    "router": r"""WITH q AS (SELECT conv_id, turn, lower(text) AS q FROM conversations WHERE role = 'user'),
m AS (SELECT conv_id, turn, regexp_matches(q, '\bthe\b')::INT AS a, regexp_matches(q, '\bof\b')::INT AS b, regexp_matches(q, '\band\b')::INT AS c, len(list_filter(regexp_split_to_array(q, '\s+'), lambda t: t <> '')) AS n FROM q),
r AS (SELECT conv_id, turn, CASE WHEN a = 1 THEN 'definition' WHEN b = 1 THEN 'relation' WHEN c = 1 THEN 'comparison' ELSE 'general' END AS query_type, CASE WHEN a + b + c >= 2 OR n > 12 THEN 'complex' WHEN a + b + c = 1 THEN 'medium' ELSE 'simple' END AS complexity FROM m)
SELECT *, (CASE complexity WHEN 'complex' THEN 60 WHEN 'medium' THEN 40 ELSE 20 END)::INT AS k FROM r""",
    "soft_weight_topk": f"WITH {VERTICES}, {entity_hits(12)} SELECT entity_name, sim, round(sim * CASE WHEN entity_type IN ('PROMO', 'STANDARD') THEN 1.0 ELSE 0.7 END::DOUBLE, 6) AS soft_sim FROM hits JOIN vertices USING (entity_name)",
    "diffusion_weight": f"{hops(repr(['p7', 'p11']))} SELECT entity_name, hop, pow(0.5, hop) AS diffusion FROM near",
    "edge_quality": f"""{GRAPH}, part_ AS (SELECT edge_key, sum(CASE WHEN entity_name IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 1 ELSE 0 END)::BIGINT AS hit, avg(CASE WHEN entity_type = 'PROMO' THEN 1.0 ELSE 0.0 END::DOUBLE) AS typed FROM inc JOIN vertices USING (entity_name) GROUP BY 1)
SELECT edge_key, round(0.4::DOUBLE * (hit / 3) + 0.2::DOUBLE * typed + 0.2::DOUBLE * (1 - 1 / (1 + len(source_id)::DOUBLE)) + 0.2::DOUBLE * (least(arity, 8) / 8), 6) AS quality, hit, CASE WHEN hit >= 3 THEN 'direct' WHEN arity > 2 THEN 'high_order' ELSE 'supporting' END AS role FROM edges JOIN part_ USING (edge_key)""",
    "edge_quality_full": f"""{GRAPH}, deg AS (SELECT entity_name, count(*) AS degree FROM inc GROUP BY 1), {entity_hits(12)}, hop AS (SELECT entity_name, 0 AS hop FROM hits),
part_ AS (SELECT edge_key, sum(CASE WHEN entity_name IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 1 ELSE 0 END)::BIGINT AS hit, avg(CASE WHEN entity_type = 'PROMO' THEN 1.0 ELSE 0.0 END::DOUBLE) AS typed,
  avg(CASE WHEN degree > 1500 THEN 1.0 ELSE 0.0 END::DOUBLE) AS high, min(hop) AS hop FROM inc JOIN vertices USING (entity_name) JOIN deg USING (entity_name) LEFT JOIN hop USING (entity_name) GROUP BY 1)
SELECT edge_key, round(0.3::DOUBLE * (hit / 3) + 0.2::DOUBLE * typed + 0.1::DOUBLE * (1 - 1 / (1 + len(source_id)::DOUBLE)) + 0.1::DOUBLE * (least(arity, 8) / 8)
  + 0.1::DOUBLE * (len(list_intersect(keywords, ['F', 'P'])) / 2) - 0.1::DOUBLE * high + 0.1::DOUBLE * coalesce(1 / (1 + hop), 0), 6) AS quality, hit,
  CASE WHEN hit >= 3 THEN 'direct' WHEN arity > 2 THEN 'high_order' ELSE 'supporting' END AS role FROM edges JOIN part_ USING (edge_key)""",
    "typed_vector_text": f"""{GRAPH}, said AS (SELECT edge_key, string_agg(entity_name || ' [' || entity_type || ']', ', ' ORDER BY entity_name || ' [' || entity_type || ']') AS m FROM inc JOIN vertices USING (entity_name) GROUP BY 1)
SELECT 'ent-' || md5(entity_name) AS id, md5('Type: ' || entity_type || '; Name: ' || entity_name || '; Description: ' || array_to_string(description, '<SEP>')) AS text FROM vertices
UNION ALL SELECT 'rel-' || md5(edge_key), md5('Members: ' || m || '; Keywords: ' || array_to_string(keywords, ', ') || '; Description: ' || array_to_string(description, '<SEP>')) FROM edges JOIN said USING (edge_key)""",
    "ablation_modes": f"""{GRAPH}, {entity_hits(12)}, h AS (SELECT entity_name, sim, entity_type, round(sim * CASE WHEN entity_type IN ('PROMO', 'STANDARD') THEN 1.0 ELSE 0.7 END::DOUBLE, 6) AS soft FROM hits JOIN vertices USING (entity_name)),
o AS (SELECT edge_key, max(sim) AS s, max(soft) AS t FROM inc JOIN h USING (entity_name) GROUP BY 1),
part_ AS (SELECT edge_key, sum(CASE WHEN entity_name IN (SELECT entity_name FROM h) THEN 1 ELSE 0 END)::BIGINT AS hit, avg(CASE WHEN entity_type IN ('PROMO', 'STANDARD') THEN 1.0 ELSE 0.0 END::DOUBLE) AS typed FROM inc JOIN vertices USING (entity_name) GROUP BY 1),
q AS (SELECT edge_key, round(0.4::DOUBLE * (hit / (SELECT count(*) FROM h)) + 0.2::DOUBLE * typed + 0.2::DOUBLE * (1 - 1 / (1 + len(source_id)::DOUBLE)) + 0.2::DOUBLE * (least(arity, 8) / 8) + 0.3::DOUBLE * t, 6) AS score,
  CASE WHEN hit >= (SELECT count(*) FROM h) THEN 'direct' WHEN arity > 2 THEN 'high_order' ELSE 'supporting' END AS role FROM edges JOIN part_ USING (edge_key) JOIN o USING (edge_key))
SELECT * FROM (SELECT 'original' AS config, edge_key, s AS score, NULL::VARCHAR AS role FROM o ORDER BY s DESC, edge_key LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'typed', edge_key, t, NULL FROM o ORDER BY t DESC, edge_key LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'full', edge_key, score, role FROM q ORDER BY score DESC, edge_key LIMIT 20)""",
    "validity_ratios": "SELECT avg(CASE WHEN p_type = 'ECONOMY' THEN 1.0 ELSE 0.0 END::DOUBLE) AS other_ratio, avg(CASE WHEN p_size > 45 THEN 1.0 ELSE 0.0 END::DOUBLE) AS invalid_ratio, avg(CASE WHEN p_type = 'ECONOMY' THEN 1.0 ELSE 0.0 END::DOUBLE) <= 0.2 AND avg(CASE WHEN p_size > 45 THEN 1.0 ELSE 0.0 END::DOUBLE) <= 0.1 AS accepted FROM part",
    "zip_by_position": "SELECT coalesce(a.pos, b.pos) AS pos, a.q, b.r FROM (SELECT doc_id AS pos, md5(text) AS q FROM documents WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id AS pos, quality AS r FROM labels) b USING (pos)",
    "cached_pieces": "SELECT conv_id, turn, i AS pos, md5(substr(text, i * 32 + 1, 32)) AS piece FROM (SELECT *, unnest(range(0, ((length(text) + 31) // 32)::BIGINT)) AS i FROM conversations)",
    "round_robin": "SELECT event_id, ((event_id + 1) % 3)::BIGINT AS model FROM events",
    "answer_clean": "SELECT conv_id, turn, md5(CASE WHEN length('user ask me ' || text || '<x>') > length('ask me') THEN " + strip("replace(replace(replace('user ask me ' || text || '<x>', 'ask me', ''), 'user', ''), '<x>', '')") + " ELSE text END) AS answer FROM conversations",
    "question_parse": "SELECT doc_id, 'what is ' || doc_id || '?' AS question FROM documents",
    "csv_parse": "SELECT p_partkey, p_name AS name, 'say \"' || p_type || '\", twice' AS said FROM part",
    "edge_id_split": f"WITH {edges()} SELECT edge_key, len(entity_set)::INT AS n, entity_set[1] AS first FROM edges",
    "url_names": "SELECT page_id, replace(replace(url, '/', '%20'), '%20', ' ') AS name FROM pages",
    "embed_cut": "SELECT doc_id, md5(substr(text, 1, 512)) AS cut FROM documents",
    "progress_percent": "SELECT event_type, round(count(*) * 100.0 / (SELECT count(*) FROM events), 2)::DOUBLE AS percent FROM events GROUP BY 1",
    "vertex_payload": f"{GRAPH} SELECT entity_name, entity_type, md5({SAID}) AS description, len(source_id)::INT AS n_sources FROM vertices WHERE entity_name IN (SELECT entity_name FROM inc WHERE edge_key IN (SELECT edge_key FROM inc WHERE entity_name = 'Brand#7'))",
    "summarise_long": f"WITH {VERTICES} SELECT entity_name, md5(CASE WHEN {count_tokens(SAID)} >= 150 THEN 'about ' || length({SAID}) ELSE {SAID} END) AS description FROM vertices",
}
