"""DuckDB SQL with the same rows as the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(t=_LOWER)} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
 r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
 m AS (SELECT node, min(seen) AS c FROM r GROUP BY 1)
 SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept FROM documents d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

_MARK = r"</?s>|\[/?INST\]|<</?SYS>>|<\|role(:[^|]*)?\|>|<\|end\|>"

CHAT = rf"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
 e AS (SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '(<)(/?s>|</?SYS>>|\|)', '\1\\\2', 'g'), '(\[)(/?INST\])', '\1\\\2', 'g') AS safe,
  CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 7 ELSE 8 + coalesce(1 + length(replace(replace(role, '%', '%25'), '|', '%7C')), 0) + 7 END AS frame FROM t),
 c AS (SELECT conv_id, count(*) AS n_turns, string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  bool_or(regexp_matches(text, '{_MARK}')) AS hard, sum(frame + length(text)) AS plain, sum(frame + length(safe)) AS safe FROM e GROUP BY 1)
 SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, (3 + CASE WHEN hard THEN safe ELSE plain END)::BIGINT AS formatted_chars FROM c"""

QUALITY = rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format(t="coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
 k AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM w), g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM k),
 d AS (SELECT doc_id, g FROM g GROUP BY 1, 2 HAVING count(*) > 1), r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM g SEMI JOIN d USING (doc_id, g)) GROUP BY 1),
 m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(l) AS n_lines, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_stutters, len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x))) AS n_shouted FROM w LEFT JOIN r USING (doc_id)),
 b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 40 * n_lines OR word_chars < 2.5 * n_words OR word_chars > 12 * n_words OR 5 * n_stutters > n_words OR 2 * n_shouted > n_words) AS kept FROM b"""

NEAR_VECTORS = """WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= 0.9),
 r AS (SELECT vec_id AS node, vec_id AS seen FROM e UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a), m AS (SELECT node, min(seen) AS c FROM r GROUP BY 1)
 SELECT node AS vec_id, (SELECT count(*) FROM l WHERE l.a = node) AS n_links, c AS component_id, c = node AS kept FROM m"""

SUBSTRING = f"""WITH w AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
 k AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w), g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM k), f AS (SELECT g, min(doc_id) AS m FROM g GROUP BY 1),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (g) WHERE m < doc_id), pos AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
 kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY 1), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
 SELECT doc_id, len(w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

WARC = """WITH h AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS h FROM pages), top AS (SELECT h, max(page_id) AS top FROM h GROUP BY 1),
 q AS (SELECT page_id, octet_length(encode(b)) AS n, top, array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * i + 1, 5))::INT >> s) & 31) + 1, 1)), '')), '') AS d FROM h JOIN top USING (h))
 SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM q"""
