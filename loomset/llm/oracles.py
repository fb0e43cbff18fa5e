"""SQL that gives the rows of the training-data queries, where SQL can say it."""

from __future__ import annotations


def _last(name: str, key: str, at: str) -> str:
    return f"(SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {at} DESC) AS _n FROM {name}) WHERE _n = 1)"


def _words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"


_TEXTS = f"""(SELECT 'news' AS kind, id AS key, text FROM {_last('news_row', 'id', 'fetched_at')} UNION ALL SELECT 'set', original_id, array_to_string(list_filter(texts, lambda t: t IS NOT NULL), chr(10)) FROM {_last('semantic_set_view', 'original_id', 'built_at')})"""
_SETS = f"(SELECT kind, key, list_sort(list_distinct({_words('text')})) AS w FROM {_TEXTS} WHERE key IS NOT NULL AND text IS NOT NULL AND length({_words('text')}) > 0)"
_SIMILAR = """SELECT a.kind, a.key AS key_a, b.key AS key_b, a.w = b.w AS same FROM (
  SELECT x.kind, x.key AS ka, y.key AS kb, count(*) AS both FROM u x JOIN u y ON x.kind = y.kind AND x.word = y.word AND x.key < y.key GROUP BY 1, 2, 3) c
  JOIN s a ON a.kind = c.kind AND a.key = c.ka JOIN s b ON b.kind = c.kind AND b.key = c.kb WHERE c.both >= {t} * (length(a.w) + length(b.w) - c.both)"""

P1_FOUND = f"WITH s AS {_SETS}, u AS (SELECT kind, key, unnest(w) AS word FROM s) SELECT kind, key_a, key_b FROM ({_SIMILAR.format(t='0.7')})"

P1_GROUPS = f"""WITH s AS {_SETS}, u AS (SELECT kind, key, unnest(w) AS word FROM s), p AS ({_SIMILAR.format(t='0.8')}),
g AS (SELECT kind, w, min(key) AS class_id, count(*) AS n_copies FROM s GROUP BY 1, 2), m AS (SELECT s.kind, s.key, g.class_id, g.n_copies FROM s JOIN g ON s.kind = g.kind AND s.w = g.w),
l AS (SELECT DISTINCT p.kind, a.class_id AS one, b.class_id AS other FROM p JOIN m a ON a.kind = p.kind AND a.key = p.key_a JOIN m b ON b.kind = p.kind AND b.key = p.key_b WHERE NOT same),
e AS (SELECT kind, one AS c, other AS d FROM l UNION SELECT kind, other, one FROM l), n AS (SELECT kind, c, count(*) AS n FROM e GROUP BY 1, 2)
SELECT m.kind, m.key, m.class_id, m.n_copies, coalesce(n.n, 0) AS n_links FROM m LEFT JOIN n ON n.kind = m.kind AND n.c = m.class_id"""

_NAME = "lower(regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))"
P3_FOUND = f"""WITH RECURSIVE r AS (SELECT 'l' || set_id AS v, set_id AS k, source_ids AS xs FROM {_last('latent_set', 'set_id', 'built_at')} WHERE set_id IS NOT NULL UNION ALL SELECT DISTINCT 's' || original_id, original_id, [original_id] FROM semantic_set_view WHERE original_id IS NOT NULL),
n AS (SELECT DISTINCT v, CASE WHEN regexp_full_match(s, 'wiki:.*:[^:]*') THEN regexp_replace(s, ':[^:]*$', '') ELSE s END AS name FROM (SELECT v, {_NAME} AS s FROM (SELECT v, unnest(xs) AS x FROM r)) WHERE s <> '' AND s <> 'unknown'),
e AS (SELECT DISTINCT a.v AS a, b.v AS b FROM n a JOIN n b ON a.name = b.name), c(v, w) AS (SELECT v, v FROM r UNION SELECT c.v, e.b FROM c JOIN e ON c.w = e.a),
g AS (SELECT c.v, min(r.k) AS group_key, count(*) AS n FROM c JOIN r ON c.w = r.v GROUP BY 1)
SELECT r.k AS rec_key, g.group_key FROM g JOIN r ON r.v = g.v WHERE g.n > 1"""


def _plain(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


_WRITTEN = f"(SELECT 'news' AS kind, id AS key, 0 AS num, text FROM {_last('news_row', 'id', 'fetched_at')} UNION ALL SELECT 'rejected', CAST(source_index AS VARCHAR), source_index, claim FROM {_last('rejected', 'source_index', 'logged_at')})"
_FORMED = f"""(SELECT kind, key, num, CASE WHEN j IS NOT NULL THEN array_to_string(list_sort(list_transform(json_keys(j), lambda k: {_plain('k')} || {_plain("coalesce(json_extract_string(j, '$.' || chr(34) || k || chr(34)), '')")})), '')
  WHEN contains(text, '|') AND length(list_filter(string_split(text, '|'), lambda p: NOT regexp_matches(p, '^\\s*[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}_ .\\-]{{0,60}}:'))) = 0 THEN array_to_string(list_sort(list_transform(string_split(text, '|'), lambda p: {_plain('p')})), '') ELSE {_plain('text')} END AS c
  FROM (SELECT *, CASE WHEN regexp_matches(text, '^\\s*\\{{') THEN TRY_CAST(text AS JSON) END AS j FROM {_WRITTEN} WHERE text IS NOT NULL AND key IS NOT NULL))"""
_FIRST = f"(SELECT kind, key, first_value(key) OVER (PARTITION BY kind, c ORDER BY num, key) AS first, count(*) OVER (PARTITION BY kind, c) AS n FROM {_FORMED} WHERE c <> '')"
P5_FOUND = f"SELECT kind, first AS first_key, key AS copy_key FROM {_FIRST} WHERE key <> first"
P5_COLLAPSED = f"SELECT kind, key, n AS n_records FROM {_FIRST} WHERE key = first"

_SIDE = "CASE WHEN {s} IN ('', 'train') THEN 't' WHEN {s} IN ('validation', 'dev', 'labelled_dev', 'test') THEN 'e' END"


def _split(x: str) -> str:
    return f"lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'))"


_SPLIT_TEXTS = f"""(SELECT set_id AS key, {_SIDE.format(s=_split("coalesce(usage, '')"))} AS side, coalesce(source_dataset, '') AS source, {_split('usage')} AS split, v.text AS text FROM (SELECT set_id, usage, source_dataset, unnest(texts) AS v FROM {_last('latent_set', 'set_id', 'built_at')}) WHERE coalesce(v.view_type, '') <> 'evidence_reference'
  UNION ALL SELECT 'rejected:' || source_index, {_SIDE.format(s=_split("coalesce(split, '')"))}, 'rejected', {_split('split')}, claim FROM {_last('rejected', 'source_index', 'logged_at')})"""
_CROSS = f"""s AS (SELECT key, side, row_number() OVER () AS n, list_distinct({_words('text')}) AS w FROM {_SPLIT_TEXTS} WHERE side IS NOT NULL AND text IS NOT NULL AND key IS NOT NULL), u AS (SELECT n, side, unnest(w) AS word FROM s),
x AS (SELECT DISTINCT a.key AS train_key, b.key AS eval_key FROM (SELECT t.n AS tn, e.n AS en, count(*) AS both FROM u t JOIN u e ON t.word = e.word AND t.side = 't' AND e.side = 'e' GROUP BY 1, 2) c JOIN s a ON a.n = c.tn JOIN s b ON b.n = c.en WHERE c.both >= 0.7 * (length(a.w) + length(b.w) - c.both))"""
P6_FOUND = f"WITH {_CROSS} SELECT DISTINCT least(train_key, eval_key) AS key_a, greatest(train_key, eval_key) AS key_b FROM x"
P6_REPORT = f"WITH {_CROSS}, r AS (SELECT DISTINCT key, split, source FROM {_SPLIT_TEXTS} WHERE side = 'e') SELECT split, source, count(*) AS n_records, count(h.eval_key) AS n_overlapping FROM r LEFT JOIN (SELECT DISTINCT eval_key FROM x) h ON h.eval_key = r.key GROUP BY 1, 2"


def _grams(key: str, table: str) -> str:
    return f"(SELECT {key}, i, array_to_string(list_slice(w, i, i + 11), ' ') AS g FROM (SELECT {key}, w, unnest(range(1, length(w) - 10)) AS i FROM (SELECT {key}, {_words('text')} AS w FROM {table} WHERE text IS NOT NULL AND {key} IS NOT NULL)))"


_D, _I = _grams("doc_id", "documents"), _grams("item_id", "heldout_items")
P9_FOUND = f"SELECT DISTINCT doc_id, item_id FROM {_D} d JOIN {_I} h ON d.g = h.g"
P9_SPANS = f"""WITH m AS (SELECT DISTINCT doc_id, item_id, d.i - 1 AS pos FROM {_D} d JOIN {_I} h ON d.g = h.g), n AS (SELECT *, CASE WHEN pos <= lag(pos) OVER w + 12 THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY doc_id, item_id ORDER BY pos)),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS run FROM n) SELECT doc_id, item_id, min(pos) AS first_word, max(pos) + 12 - min(pos) AS n_words FROM k GROUP BY doc_id, item_id, run"""

_WINDOWS = "w AS (SELECT doc_id, i, md5(substring(text, i, 320)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 318)) AS i FROM documents WHERE length(text) >= 320))"
P10_FOUND = f"WITH {_WINDOWS}, k AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)), s AS (SELECT DISTINCT doc_id, h FROM w SEMI JOIN k ON w.h = k.h) SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id"
P10_COVERAGE = f"""WITH {_WINDOWS}, k AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)), s AS (SELECT DISTINCT doc_id, i FROM w SEMI JOIN k ON w.h = k.h),
c AS (SELECT doc_id, sum(least(320, coalesce(nx - i, 320))) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM s) GROUP BY 1)
SELECT d.doc_id, coalesce(length(text), 0) AS n_chars, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shared, CASE WHEN length(text) > 0 THEN round(coalesce(c.n, 0) / length(text), 6) ELSE 0.0 END AS share FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id"""

_VECTORS = "(SELECT bank_id AS bank, vec_id AS id, list_transform(hidden[1:48], lambda x: x::DOUBLE) AS h FROM activation_bank WHERE hidden IS NOT NULL AND length(hidden) >= 48 AND bank_id IS NOT NULL AND length(list_filter(hidden[1:48], lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND length(list_filter(hidden[1:48], lambda x: x <> 0)) > 0)"
_NEAR = f"""(SELECT a.bank, a.id, row_number() OVER (PARTITION BY a.bank, a.id ORDER BY round(list_dot_product(a.u, b.u), 9) DESC, b.id) - 1 AS rank, b.id AS neighbour, round(list_dot_product(a.u, b.u), 9) AS sim FROM v a JOIN v b ON a.bank = b.bank AND a.id <> b.id)"""
_UNITS = f"v AS (SELECT bank, id, list_transform(h, lambda x: x / sqrt(list_dot_product(h, h))) AS u FROM {_VECTORS})"
P7_LISTS = f"WITH {_UNITS} SELECT bank, id, rank, neighbour, sim FROM {_NEAR} WHERE rank < 10"
P7_FOUND = f"WITH {_UNITS} SELECT DISTINCT least(id, neighbour) AS vec_a, greatest(id, neighbour) AS vec_b FROM {_NEAR} WHERE rank < 10"

#: The total of the test split is that of the groups whose sizes come closest to a tenth of all records.
P3_TOTALS = f"""WITH RECURSIVE f AS ({P3_FOUND}), n AS (SELECT (SELECT count(*) FROM (SELECT set_id FROM latent_set WHERE set_id IS NOT NULL GROUP BY 1)) + (SELECT count(*) FROM (SELECT original_id FROM semantic_set_view WHERE original_id IS NOT NULL GROUP BY 1)) AS total),
s AS (SELECT row_number() OVER (ORDER BY n) AS i, n FROM (SELECT count(*) AS n FROM f GROUP BY group_key)), one AS (SELECT (SELECT total FROM n) - (SELECT count(*) FROM f) AS singles), goal AS (SELECT CAST(round_even(total * 0.1, 0) AS BIGINT) AS t FROM n),
reach(i, total) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT s.i, r.total + k.take * s.n FROM reach r JOIN s ON s.i = r.i + 1, (VALUES (0), (1)) AS k(take) WHERE r.total + k.take * s.n <= (SELECT 2 * t FROM goal)),
best AS (SELECT min(abs(total + least(singles, greatest(t - total, 0)) - t)) AS off FROM reach, one, goal WHERE i = (SELECT coalesce(max(i), 0) FROM s))
SELECT total AS n_records, t AS goal, off FROM n, goal, best"""

SQL = {"p1_found": P1_FOUND, "p1_groups": P1_GROUPS, "p3_found": P3_FOUND, "p3_totals": P3_TOTALS, "p7_found": P7_FOUND, "p7_lists": P7_LISTS, "p5_found": P5_FOUND, "p5_collapsed": P5_COLLAPSED, "p6_found": P6_FOUND, "p6_report": P6_REPORT, "p9_found": P9_FOUND, "p9_spans": P9_SPANS, "p10_found": P10_FOUND, "p10_coverage": P10_COVERAGE}
