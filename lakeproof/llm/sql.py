"""DuckDB statements that give the same rows as the queries; only those that SQL can express on whole tables.

The others learn, propagate or search: tests hold them against brute-force versions instead."""

SPACED = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"list_filter(regexp_split_to_array({0}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')".format(LOWER.format("coalesce(text, '')"))
_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_FIELDS = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
#: CRC-32 of a value's text, bit by bit.
_CRC = "xor(list_reduce(list_transform(string_split({0}::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1))), 4294967295), 4294967295)"

ORACLE: dict[str, str] = {
    "op8_near_duplicates": f"""WITH RECURSIVE w AS (SELECT doc_id, {SPACED.format(LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept FROM (SELECT id AS doc_id, min(other) AS c FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)""",
    "op9_decontamination": f"""WITH d AS (SELECT doc_id, {ALNUM} AS ws FROM documents), b AS (SELECT item_id, {ALNUM} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
p AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
h AS (SELECT doc_id, item_id, i, p.n FROM p JOIN win ON p.k = win.k AND p.n = win.n),
c AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op10_substring_dedup": f"""WITH d AS (SELECT doc_id, {SPACED.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
rep AS (SELECT k FROM win GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS spot FROM win WHERE k IN (SELECT k FROM rep)),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS spot, unnest(ws) AS word FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY spot) AS kept FROM words WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = words.doc_id AND gone.spot = words.spot) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    # Levels bottom up for every source, then over the sources; each leaf's steps, joined for the proof and folded for the root.
    "op13_merkle_manifest": rf"""WITH RECURSIVE x AS (SELECT *, CASE WHEN {_CRC.format("doc_id")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS held_text FROM documents),
h AS (SELECT doc_id, source, sha256({_FIELDS} || {_FIELD.format("text")}) AS leaf, sha256({_FIELDS} || {_FIELD.format("held_text")}) AS held FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM h),
t AS (SELECT s, 0::BIGINT AS l, i, n, leaf AS d FROM k UNION ALL SELECT s, l + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY s, l, i // 3, n),
sub AS (SELECT s, l AS depth, d AS subroot, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT -1::BIGINT AS s, 0::BIGINT AS l, s AS i, n, subroot AS d FROM sub UNION ALL SELECT s, l + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY s, l, i // 3, n),
root AS (SELECT l AS height, d AS root FROM u WHERE n = 1),
nodes AS (SELECT s, l, i, d FROM t WHERE n > 1 UNION ALL SELECT s, l, i, d FROM u WHERE n > 1),
c AS (SELECT s, i, s AS tree, i AS spot, unnest(range(depth)) AS l, 0 AS above FROM k JOIN sub USING (s) UNION ALL SELECT s, i, -1, s, unnest(range(height)), depth FROM k JOIN sub USING (s), root),
p AS (SELECT c.s, c.i, c.l + above AS place, coalesce(string_agg(d, '' ORDER BY nodes.i) FILTER (nodes.i < spot // pow(3, c.l)::BIGINT), '') AS a, coalesce(string_agg(d, '' ORDER BY nodes.i) FILTER (nodes.i > spot // pow(3, c.l)::BIGINT), '') AS b
FROM c JOIN nodes ON nodes.s = tree AND nodes.l = c.l AND nodes.i // 3 = spot // pow(3, c.l + 1)::BIGINT GROUP BY c.s, c.i, c.l, above),
g AS (SELECT s, i, 0::BIGINT AS place, held AS h FROM k UNION ALL SELECT g.s, g.i, g.place + 1, sha256(a || h || b) FROM g JOIN p ON p.s = g.s AND p.i = g.i AND p.place = g.place),
q AS (SELECT s, i, string_agg(a || b, '' ORDER BY place) AS proof FROM p GROUP BY 1, 2)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, h AS folded_root, h = root AS verified FROM k JOIN sub USING (s) JOIN g ON g.s = k.s AND g.i = k.i AND g.place = depth + (SELECT height FROM root) LEFT JOIN q ON q.s = k.s AND q.i = k.i, root""",
}
