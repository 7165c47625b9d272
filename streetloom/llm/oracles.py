"""DuckDB SQL with the results of the queries that SQL can express."""

from __future__ import annotations

URL_FILTER = r"""
WITH seen AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched,
    coalesce(regexp_replace(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)', 1), '\.+$', ''), '') AS host,
    coalesce(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
hosts AS (SELECT host AS pattern, min(page_id) AS k FROM seen WHERE host <> '' GROUP BY 1),
urls AS (SELECT lower(host || path) AS pattern, min(page_id) AS k FROM seen WHERE host <> '' GROUP BY 1),
entries AS (
  SELECT 'blocked' AS list, 'domain' AS kind, pattern, k FROM hosts WHERE k % 3 = 0
  UNION ALL SELECT 'allowed', 'domain', pattern, k FROM hosts WHERE k % 7 = 0
  UNION ALL SELECT 'pages', 'url', pattern, k FROM urls WHERE k % 5 = 0),
spans AS (
  SELECT list, kind, pattern, DATE '2024-01-01' + CAST(k * 7 % 300 AS INTEGER) AS a, DATE '2024-01-01' + CAST(k * 7 % 300 + k % 60 + 10 AS INTEGER) AS b FROM entries
  UNION ALL SELECT list, kind, pattern, DATE '2024-01-01' + CAST(k * 7 % 300 + k % 60 + 40 AS INTEGER), DATE '9999-12-31' FROM entries
  UNION ALL SELECT 'parents', 'domain', 'example.org', DATE '2024-05-01', DATE '2024-06-01'),
visits AS (SELECT DISTINCT host, path, fetched FROM seen WHERE host <> ''),
met AS (
  SELECT v.*, s.list FROM visits v JOIN spans s ON v.host = s.pattern AND s.kind = 'domain' AND v.fetched >= s.a AND v.fetched < s.b
  UNION ALL SELECT v.*, s.list FROM visits v JOIN spans s ON ends_with(v.host, '.' || s.pattern) AND s.kind = 'domain' AND v.fetched >= s.a AND v.fetched < s.b
  UNION ALL SELECT v.*, s.list FROM visits v JOIN spans s ON lower(v.host || v.path) = s.pattern AND s.kind = 'url' AND v.fetched >= s.a AND v.fetched < s.b),
hits AS (
  SELECT host, path, fetched, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
    bool_or(list <> 'allowed') AS block, bool_or(list = 'allowed') AS allow
  FROM met GROUP BY 1, 2, 3)
SELECT page_id, url, seen.fetched, seen.host, CAST(coalesce(n, 0) AS BIGINT) AS n_entries, coalesce(lists, '') AS lists,
  coalesce(block, false) AND NOT coalesce(allow, false) AS blocked
FROM seen LEFT JOIN hits ON hits.host = seen.host AND hits.path = seen.path AND hits.fetched = seen.fetched
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, w, least(13, len(w)) AS size FROM (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM items)),
places AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS t FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
found AS (SELECT p.doc_id, p.i, p.size, v.item_id FROM places p JOIN windows v ON p.size = v.size AND p.t = v.t),
hit AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY 1)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit ON hit.doc_id = docs.doc_id LEFT JOIN named ON named.doc_id = docs.doc_id
"""

NEARDUP = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared.n >= 85 * (p.n + q.n - shared.n)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, root) AS (SELECT a, a FROM edges UNION SELECT edges.b, reach.root FROM reach JOIN edges ON edges.a = reach.node WHERE reach.root < edges.b),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY 1)
SELECT docs.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, coalesce(root, docs.doc_id) AS component_id, coalesce(root, docs.doc_id) = docs.doc_id AS kept
FROM docs LEFT JOIN sizes ON sizes.doc_id = docs.doc_id LEFT JOIN roots ON roots.node = docs.doc_id
"""

def _crc32(text: str) -> str:
    """Unsigned crc32 of a text of ASCII characters."""
    return f"""(SELECT xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)),
      lambda h, b: list_reduce(list_prepend(xor(h, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295))"""


def _field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen(CAST({name} AS VARCHAR)) || ':' || {name} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Both kinds of tree in one recursion each: trees of documents by lang, then the tree of their roots.
MERKLE = f"""
WITH RECURSIVE cells AS (
  SELECT doc_id, coalesce('+' || lang, '') AS tree, {_leaf("text")} AS leaf,
    CASE WHEN {_crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM cells),
nodes AS (
  SELECT tree, 0 AS level, n, pos, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, level + 1, CAST(ceil(n / 8) AS BIGINT), pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, n, pos // 8),
kept AS MATERIALIZED (SELECT * FROM nodes),
subroots AS MATERIALIZED (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM kept WHERE n = 1),
above AS (
  SELECT 0 AS level, n, pos, h FROM subroots
  UNION ALL
  SELECT level + 1, CAST(ceil(n / 8) AS BIGINT), pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM above WHERE n > 1 GROUP BY level, n, pos // 8),
high AS MATERIALIZED (SELECT * FROM above),
steps AS (
  SELECT k.tree, k.level, k.pos, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < k.pos), '') AS before, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > k.pos), '') AS after
  FROM kept k JOIN kept s ON s.tree = k.tree AND s.level = k.level AND s.pos // 8 = k.pos // 8 WHERE k.n > 1 GROUP BY 1, 2, 3),
tops AS (
  SELECT k.level, k.pos, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < k.pos), '') AS before, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > k.pos), '') AS after
  FROM high k JOIN high s ON s.level = k.level AND s.pos // 8 = k.pos // 8 WHERE k.n > 1 GROUP BY 1, 2),
heights AS (SELECT tree, max(level) AS height FROM kept GROUP BY 1),
ways AS MATERIALIZED (
  SELECT l.tree, l.pos, s.level, s.before, s.after FROM leaves l JOIN steps s ON s.tree = l.tree AND s.pos = l.pos // CAST(pow(8, s.level) AS BIGINT)
  UNION ALL
  SELECT l.tree, l.pos, height + t.level, t.before, t.after FROM leaves l JOIN heights ON heights.tree = l.tree JOIN subroots r ON r.tree = l.tree
    JOIN tops t ON t.pos = r.pos // CAST(pow(8, t.level) AS BIGINT)),
folds AS (
  SELECT tree, pos, 0 AS level, coalesce(changed, leaf) AS h FROM leaves
  UNION ALL
  SELECT f.tree, f.pos, f.level + 1, sha256(w.before || f.h || w.after) FROM folds f JOIN ways w ON w.tree = f.tree AND w.pos = f.pos AND w.level = f.level),
ends AS (SELECT tree, pos, arg_max(h, level) AS h FROM folds GROUP BY 1, 2),
proofs AS (SELECT tree, pos, sha256(string_agg(before || after, '' ORDER BY level)) AS h FROM ways GROUP BY 1, 2)
SELECT doc_id, leaf, r.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root, coalesce(p.h, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = (SELECT h FROM high WHERE n = 1) AS verified
FROM leaves l JOIN subroots r ON r.tree = l.tree JOIN ends e ON e.tree = l.tree AND e.pos = l.pos LEFT JOIN proofs p ON p.tree = l.tree AND p.pos = l.pos
"""


def _clusters(k: int = 8, rounds: int = 10, width: int = 64) -> str:
    """One part for each round: distances, assignments, centroids."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS r, vec_id, q FROM (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(greatest(-134217728, least(134217728, CAST(x AS DOUBLE) * 1024))) AS BIGINT)) AS q FROM embeddings
    WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width}))""",
        f"cells AS MATERIALIZED (SELECT r, unnest(range(1, {width + 1})) AS d, unnest(q) AS x FROM kept)",
        f"c0 AS MATERIALIZED (SELECT r AS c, d, x FROM cells WHERE r < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS (SELECT r, c, sum((cells.x - m.x) * (cells.x - m.x)) AS s FROM cells JOIN c{i} m ON m.d = cells.d GROUP BY 1, 2)")
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, arg_min(c, (s, c)) AS c, min(s) AS s FROM d{i} GROUP BY 1)")
        if i < rounds:
            parts.append(f"m{i} AS (SELECT c, d, sum(x) AS t, count(*) AS n FROM a{i} JOIN cells ON cells.r = a{i}.r GROUP BY 1, 2)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, o.d, CAST(CASE WHEN n IS NULL THEN o.x ELSE (t - ((t % n) + n) % n) // n END AS BIGINT) AS x FROM c{i} o LEFT JOIN m{i} ON m{i}.c = o.c AND m{i}.d = o.d)")
    last = f"a{rounds}"
    return f"""WITH {", ".join(parts)},
names AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY 1)
SELECT vec_id, CAST({last}.c AS INTEGER) AS cluster, CAST(s AS BIGINT) AS distance, CAST(sum(s) OVER (PARTITION BY {last}.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(s) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM {last} JOIN kept ON kept.r = {last}.r JOIN names ON names.c = {last}.c"""


ORACLES: dict[str, str] = {"op1_decontaminate": DECONTAMINATE, "op5_url_filter": URL_FILTER, "op6_neardup": NEARDUP, "op12_merkle_manifest": MERKLE, "op13_centroid_clustering": _clusters()}
