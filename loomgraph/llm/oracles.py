"""DuckDB SQL of the queries that SQL can express.

op3, op7 and op8 learn models and op5 runs a BPE vocabulary: these are tested against
brute force.  op10's SQL is exact, without MinHash: on tables where no candidate pair at the
threshold is missed (see the recall of its bands) both agree.
"""

from __future__ import annotations

from .quality_rules import BINS
from .url_filters import RULES, UPPER

WS = r"[\x20\x09-\x0D]"
LOW = f"translate(text, '{UPPER}', '{UPPER.lower()}')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda v: v <> '')"


def count(x: str, drop: str) -> str:
    return f"length(regexp_replace({x}, '{drop}', '', 'g'))"


def js(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists."""
    m = f"(({p}[i] + {q}[i]) / 2)"
    half = lambda x: f"CASE WHEN {x}[i] > 0 THEN {x}[i] * log2({x}[i] / {m}) ELSE 0 END"
    return f"sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {half(p)} + {half(q)})) / 2, 0))"


def share(x: str) -> str:
    return f"list_transform({x}, lambda v: v / list_sum({x}))"


OP1 = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, {words("x")} AS ws, list_filter(string_split(x, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g), (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY rid),
b AS (
  SELECT rid, doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, {count("x", "[^#*$%&|<>]+")} AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, length(x) AS chars,
         {count("x", "[^A-Z]+")} AS up, {count("x", "[^0-9]+")} AS num, {count("x", "[^!-`{-~]+")} AS seen, strlen(x) - length(x) AS wide,
         [{", ".join(f"len(list_filter(ws, lambda v: v = '{x}'))" for x in BINS)}] AS h
  FROM w LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             [chars - seen - (chars - word_chars), up, num, seen - up - num, chars - word_chars, wide] AS cls,
             list_append(h, n_words - list_sum(h)) AS bins FROM b),
good AS (SELECT * FROM f WHERE NOT base_failed AND n_words >= 100 AND chars >= 200),
sums AS (
  SELECT lang, docs, (SELECT list(s ORDER BY i) FROM (SELECT i, sum(cls[i]) AS s FROM good, (SELECT unnest(range(1, 7)) AS i) WHERE good.lang IS NOT DISTINCT FROM l.lang GROUP BY i)) AS c,
         (SELECT list(s ORDER BY i) FROM (SELECT i, sum(bins[i]) AS s FROM good, (SELECT unnest(range(1, {len(BINS) + 2})) AS i) WHERE good.lang IS NOT DISTINCT FROM l.lang GROUP BY i)) AS b
  FROM (SELECT lang, count(*) AS docs FROM good GROUP BY lang) l),
refs AS (SELECT {share("c")} AS rc, {share("b")} AS rb FROM sums WHERE lang IS NOT NULL AND docs >= 20),
d AS (
  SELECT rid, min(CASE WHEN chars >= 200 THEN {js("pc", "rc")} END) AS js_class, min(CASE WHEN n_words >= 100 THEN {js("pb", "rb")} END) AS js_words
  FROM (SELECT rid, chars, n_words, {share("cls")} AS pc, {share("bins")} AS pb FROM f), refs GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(js_class <= 0.3, true) AND coalesce(js_words <= 0.275, true) AS kept
FROM f LEFT JOIN d USING (rid)"""

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(translate({x}, '{UPPER}', '{UPPER.lower()}'), '{NOT_WORD}'), lambda v: v <> '')"


OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS x, {item_words("coalesce(text, '')")} AS ws FROM documents),
i AS (SELECT item_id, ws, least(len(ws), 10) AS k FROM (SELECT item_id, {item_words("coalesce(text, '')")} AS ws FROM benchmark) WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(ws[p : p + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS p FROM i)),
dw AS (SELECT rid, k, p, array_to_string(ws[p : p + k - 1], ' ') AS g FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw))),
m AS (SELECT rid, p, dw.k, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
word AS (SELECT DISTINCT rid, p + o AS w FROM (SELECT rid, p, unnest(range(0, k)) AS o FROM m)),
hit AS (SELECT rid, count(*) AS n_hit FROM word GROUP BY rid),
run AS (SELECT rid, min(w) AS a, max(w) AS b FROM (SELECT rid, w, w - row_number() OVER (PARTITION BY rid ORDER BY w) AS r FROM word) GROUP BY rid, r),
sep AS (SELECT rid, ws, list_filter(regexp_extract_all(x, '{NOT_WORD}'), lambda v: v <> '') AS ss, regexp_matches(x, '^{NOT_WORD}')::INT AS lead FROM d WHERE rid IN (SELECT rid FROM word)),
span AS (
  SELECT rid, coalesce(list_sum(list_transform(ws[1 : a - 1], lambda v: length(v))), 0) + coalesce(list_sum(list_transform(ss[1 : a - 1 + lead], lambda v: length(v))), 0) AS s,
         list_sum(list_transform(ws[1 : b], lambda v: length(v))) + coalesce(list_sum(list_transform(ss[1 : b - 1 + lead], lambda v: length(v))), 0) AS e
  FROM run JOIN sep USING (rid)),
spans AS (SELECT rid, count(*) AS n_spans, string_agg(s::BIGINT || '-' || e::BIGINT, ',' ORDER BY s) AS said FROM span GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item_id FROM m) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_spans, 0) AS n_spans, sha256(coalesce(said, '')) AS spans_sha256
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid) LEFT JOIN spans USING (rid)"""

REST = "CASE WHEN contains({u}, '://') THEN substr({u}, instr({u}, '://') + 3) ELSE '' END"


def host(u: str) -> str:
    return f"translate(regexp_extract({REST.format(u=u)}, '^([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}')"


def path(u: str) -> str:
    return f"regexp_extract({REST.format(u=u)}, '^[^/?#]*([^?#]*)', 1)"


def node(u: str) -> str:
    return f"{host(u)} || regexp_extract({REST.format(u=u)}, '^[^/?#]*([^#]*)', 1)"


RULE_ROWS = ", ".join(f"('{v}', '{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for v, r in RULES)


def ruled(rows: str) -> str:
    """(k, host, path) rows to (k, rule, verdict) of the longest fitting rule."""
    return f"SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS rv FROM {rows} JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k"


# links to absolute, scheme-relative and root-relative addresses
OP4 = f"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES {RULE_ROWS}) v(verdict, rule, rh, rp)),
p AS (SELECT row_number() OVER () AS k, page_id, url, html, {host("coalesce(url, '')")} AS host, {path("coalesce(url, '')")} AS path, {node("coalesce(url, '')")} AS a FROM pages),
pr AS ({ruled("p")}),
tags AS (SELECT url, a, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\b[^>]*>')) AS tag FROM p WHERE host <> ''),
to_ AS (SELECT url, a, trim(CASE WHEN tag ILIKE '<link%' THEN regexp_extract(tag, '(?i)\\shref\\s*=\\s*["'']?([^"''>\\s]+)', 1) ELSE regexp_extract(tag, '(?i)url\\s*=\\s*([^"''>]+)', 1) END) AS t
  FROM tags WHERE regexp_matches(tag, '(?i)^<link\\b.*\\srel\\s*=\\s*["'']?[^"''>]*\\bcanonical\\b') OR regexp_matches(tag, '(?i)^<meta\\b.*http-equiv\\s*=\\s*["'']?\\s*refresh\\b')),
abs_ AS (SELECT a, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN split_part(url, '://', 1) || ':' || t WHEN starts_with(t, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1) || t END AS u FROM to_ WHERE t <> ''),
link AS (SELECT a, {node("u")} AS b, u FROM abs_ WHERE u IS NOT NULL),
both_ AS (SELECT a AS x, b AS y FROM link WHERE a <> b UNION SELECT b, a FROM link WHERE a <> b),
reach AS (SELECT x, x AS y FROM both_ UNION SELECT r.x, e.y FROM reach r JOIN both_ e ON e.x = r.y),
tn AS (SELECT b AS k, {host("u")} AS host, {path("u")} AS path FROM link),
bad AS (SELECT a FROM p JOIN pr USING (k) WHERE rv = 'block' UNION SELECT k FROM ({ruled("tn")}) WHERE rv = 'block'),
down AS (SELECT DISTINCT x FROM reach JOIN bad ON bad.a = reach.y)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN a IN (SELECT x FROM down) AND host <> '' THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN pr USING (k)"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words(LOW)} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p : p + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM d WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, len(ws) || ':' || array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
both_ AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x, x AS y FROM both_ UNION SELECT r.x, e.y FROM reach r JOIN both_ e ON e.x = r.y),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON x = d.doc_id"""

# byte strings as hexadecimal text: two characters a byte
OP9 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, p, md5(substr(h, 2 * p + 1, 800)) AS m FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - 399)) AS p FROM d WHERE length(h) >= 800)),
hit AS (SELECT rid, p FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
step AS (SELECT rid, p, (p > coalesce(lag(p) OVER (PARTITION BY rid ORDER BY p), -1000) + 400)::INT AS new FROM hit),
run AS (SELECT rid, min(p) AS a, max(p) + 400 AS b FROM (SELECT rid, p, sum(new) OVER (PARTITION BY rid ORDER BY p) AS g FROM step) GROUP BY rid, g),
k AS (SELECT rid, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, list_append(list(a ORDER BY a), NULL) AS e, list_prepend(0, list(b ORDER BY a)) AS s FROM run GROUP BY rid)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN s IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(s) + 1), lambda i: substr(h, 2 * s[i] + 1, 2 * (coalesce(e[i], length(h) // 2) - s[i]))), '') END)) AS kept_sha256
FROM d LEFT JOIN k USING (rid)"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, i, ls[i] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
t AS (SELECT rid, doc_id, i, hex(encode(translate(regexp_replace(line, '^{WS}+|{WS}+$', '', 'g'), '{UPPER}', '{UPPER.lower()}'))) AS k FROM l),
c AS (SELECT k, row_number() OVER (ORDER BY k) AS c FROM (SELECT DISTINCT k FROM t WHERE k <> '')),
g AS (SELECT DISTINCT c, substr(k, 2 * p + 1, 10) AS g FROM (SELECT c, k, unnest(range(0, length(k) // 2 - 4)) AS p FROM c WHERE length(k) >= 10)),
n AS (SELECT c, count(*) AS n FROM g GROUP BY c),
f AS (SELECT g, count(*) AS f FROM g GROUP BY g HAVING count(*) > 1),
r AS (SELECT c, g, n, (n - ceil(n * 0.8)::BIGINT + 1) - (n - count(*) OVER (PARTITION BY c)) AS take, row_number() OVER (PARTITION BY c ORDER BY f, g) AS r FROM g JOIN f USING (g) JOIN n USING (c)),
x AS (SELECT c, g, n FROM r WHERE r <= take),
cand AS (SELECT DISTINCT a.c AS a, b.c AS b, a.n AS na, b.n AS nb FROM x a JOIN x b ON a.g = b.g AND a.c < b.c AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
both_n AS (SELECT a, b, na, nb, count(*) AS m FROM cand JOIN g p ON p.c = a JOIN g q ON q.c = b AND q.g = p.g GROUP BY a, b, na, nb),
link AS (SELECT a, b FROM both_n WHERE m * 100 >= (na + nb - m) * 80),
e AS (SELECT a AS x, b AS y FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT x, x AS y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
comp AS (SELECT x AS c, min(y) AS comp FROM reach GROUP BY x),
pos AS (SELECT rid, i, row_number() OVER (PARTITION BY coalesce(comp, c) ORDER BY doc_id NULLS LAST, rid, i) AS r FROM t JOIN c USING (k) LEFT JOIN comp USING (c)),
kept AS (SELECT l.rid, string_agg(line, chr(10) ORDER BY l.i) AS text, count(*) AS n FROM l LEFT JOIN pos ON pos.rid = l.rid AND pos.i = l.i WHERE coalesce(r, 1) = 1 GROUP BY l.rid)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, coalesce(len(ls), 0) AS n_lines, coalesce(len(ls), 0) - coalesce(n, 0) AS n_removed
FROM d LEFT JOIN kept USING (rid)"""

ORACLES = {"op1_quality_rules": OP1, "op2_decontaminate": OP2, "op4_url_filters": OP4, "op6_ngram_join": OP6, "op9_repeats": OP9, "op10_line_dedup": OP10}
