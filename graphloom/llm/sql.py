"""DuckDB SQL of those contract queries that SQL can express."""

OP2 = """
WITH rules(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS k FROM pages),
m AS (SELECT p.k, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
      FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY p.k)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.rv, 'allow') AS verdict FROM p LEFT JOIN m USING (k)
"""

OP4 = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS idx FROM t),
g AS (SELECT conv_id, count(*) AS n, list(struct_pack(r := role, t := text) ORDER BY idx) AS turns FROM i GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, count(*) AS copies, n, turns FROM g GROUP BY n, turns),
p AS (SELECT DISTINCT turns[1:k] AS pre FROM (SELECT turns, unnest(range(1, n)) AS k FROM u)),
kept AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pre = u.turns))
SELECT k.conv_id, k.n AS n_turns, k.copies, string_agg('<|im_start|>' || replace(i.role, '<|im_', '<| im_') || chr(10) || replace(replace(i.text, '<|im_', '<| im_'), chr(13) || chr(10), chr(10)) || '<|im_end|>', chr(10) ORDER BY i.idx) AS rendered
FROM kept k JOIN i ON i.conv_id = k.conv_id GROUP BY k.conv_id, k.n, k.copies
"""

OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 48), lambda k: struct_pack(k := k, h := md5(array_to_string(w[k:k + 49], ' '))))) AS x FROM d WHERE len(w) >= 50),
lo AS (SELECT x.h AS h, min(doc_id) AS lo FROM h GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(x.k, x.k + 50)) AS p FROM h JOIN lo ON x.h = lo.h WHERE lo < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) FILTER (g.p IS NULL) AS t, count(g.p) AS gone FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP8 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
h AS (SELECT doc_id, unnest(list_transform(range(0, length(x) // 2 - 399), lambda k: struct_pack(k := k, h := md5(substring(x, 2 * k + 1, 800))))) AS w FROM d WHERE length(x) >= 800),
again AS (SELECT w.h AS h FROM h GROUP BY 1 HAVING count(*) > 1),
hit AS (SELECT doc_id, w.k AS k FROM h WHERE w.h IN (SELECT h FROM again)),
mark AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 400 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS r FROM mark),
span AS (SELECT doc_id, min(k) AS a, max(k) + 400 AS b FROM run GROUP BY doc_id, r),
gap AS (SELECT s.doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS before FROM span s),
cut AS (SELECT g.doc_id, string_agg(substring(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substring(any_value(x), 2 * max(b) + 1) AS k, sum(b - a) AS gone, count(*) AS n FROM gap g JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)
"""

OP11 = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) AS t(m) WHERE len(w) >= m),
f AS (SELECT lang, phrase, any_value(m) AS m, count(*) AS a FROM g GROUP BY lang, phrase),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 10),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:m], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT cut.lang, cut.phrase, cut.a, k, fx.a AS l, fy.a AS r, (1000000::HUGEINT * cut.a * cut.a // (fx.a::HUGEINT * fy.a))::BIGINT AS score FROM cut JOIN f fx ON fx.lang = cut.lang AND fx.phrase = x JOIN f fy ON fy.lang = cut.lang AND fy.phrase = y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE m = 3) GROUP BY 1, 2),
kept AS (SELECT b.* FROM b LEFT JOIN inside ON inside.lang = b.lang AND inside.phrase = b.phrase WHERE position(' ' IN substr(b.phrase, position(' ' IN b.phrase) + 1)) > 0 OR longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

SQL = {"op11_collocations": OP11, "op1_substring_dedup": OP1, "op8_suffix_dedup": OP8, "op2_url_filter": OP2, "op4_chat_format": OP4}
