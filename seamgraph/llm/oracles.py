"""The same results as SQL, where SQL can say them."""

#: Runs of three or more lines with a word that an earlier place holds, and of one or two that hold 50 words or more.
OP6 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
u AS (SELECT *, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3, lead(i, 1) OVER w AS i2, lead(i, 2) OVER w AS i3, lead(n, 1) OVER w AS n2
      FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l) WHERE n > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, i3 AS j, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, i) AS k FROM u WHERE i3 IS NOT NULL
      UNION ALL SELECT doc_id, i, i2, row_number() OVER (PARTITION BY line, l2 ORDER BY doc_id, i) FROM u WHERE n + n2 >= 50
      UNION ALL SELECT doc_id, i, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) FROM u WHERE n >= 50),
g AS (SELECT DISTINCT u.doc_id, u.i FROM u JOIN r ON u.doc_id = r.doc_id AND u.i BETWEEN r.i AND r.j AND r.k > 1),
k AS (SELECT l.doc_id, count(g.i) AS n_removed,
             coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS kept
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, len(d.lines)::BIGINT AS n_lines, k.n_removed::BIGINT AS n_removed, sha256(k.kept) AS kept_sha256
FROM d JOIN k ON d.doc_id = k.doc_id
"""

#: Base counts, then fences from merged histograms per language and source.
OP2 = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
a AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM g) WHERE n > 1),
q AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM r, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY doc_id),
s AS (SELECT a.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
      coalesce(q.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
      len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_capitals, len(regexp_extract_all(t, '[!?]'))::BIGINT AS n_exclaims
      FROM a LEFT JOIN q ON a.doc_id = q.doc_id),
m AS (SELECT *, unnest([
        {'k': 'symbols', 'v': CASE WHEN word_chars = 0 THEN 0 ELSE n_symbols * 1000 // word_chars END, 'slack': 20},
        {'k': 'capitals', 'v': CASE WHEN word_chars = 0 THEN 0 ELSE n_capitals * 1000 // word_chars END, 'slack': 60},
        {'k': 'exclaims', 'v': CASE WHEN word_chars = 0 THEN 0 ELSE n_exclaims * 1000 // word_chars END, 'slack': 10},
        {'k': 'dup_lines', 'v': CASE WHEN n_lines = 0 THEN 0 ELSE n_dup_lines * 1000 // n_lines END, 'slack': 350},
        {'k': 'repeats', 'v': CASE WHEN n_words = 0 THEN 0 ELSE n_repeat_words * 1000 // n_words END, 'slack': 350},
        {'k': 'word_length', 'v': CASE WHEN n_words = 0 THEN 0 ELSE word_chars * 100 // n_words END, 'slack': 100}]) AS x FROM s),
v AS (SELECT doc_id, lang, source, n_words, x.k AS k, x.v AS v, x.slack AS slack, greatest(0, length(bin(x.v)) - 5) AS low FROM m),
b AS (SELECT lang, source, k, CASE WHEN v < 16 THEN v ELSE (v >> low) << low END AS b, count(*) AS n FROM v WHERE n_words > 0 GROUP BY ALL),
lv AS (SELECT 1 AS lv, lang, source, k, b, n FROM b UNION ALL SELECT 2, lang, NULL, k, b, sum(n) FROM b GROUP BY lang, k, b
       UNION ALL SELECT 3, NULL, NULL, k, b, sum(n) FROM b GROUP BY k, b),
c AS (SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, k ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lv, lang, source, k) AS total FROM lv),
z AS (SELECT lv, lang, source, k, any_value(total) AS total, min(b) FILTER (upto * 100 >= total * 10) AS q10,
      min(b) FILTER (upto * 100 >= total * 50) AS q50 FROM c GROUP BY lv, lang, source, k),
x AS (SELECT l.lang, l.k, (l.total * l.q10 + 200 * t.q10) // (l.total + 200) AS q10, (l.total * l.q50 + 200 * t.q50) // (l.total + 200) AS q50
      FROM z l JOIN z t ON l.lv = 2 AND t.lv = 3 AND t.k = l.k),
y AS (SELECT o.lang, o.source, o.k, (o.total * o.q10 + 200 * x.q10) // (o.total + 200) AS q10, (o.total * o.q50 + 200 * x.q50) // (o.total + 200) AS q50
      FROM z o JOIN x ON o.lv = 1 AND o.k = x.k AND o.lang IS NOT DISTINCT FROM x.lang),
f AS (SELECT lang, source, k, q50 + 4 * (q50 - q10) AS f FROM y),
j AS (SELECT v.doc_id, bool_and(v.v <= f.f + v.slack) AS within FROM v JOIN f ON v.k = f.k AND v.lang IS NOT DISTINCT FROM f.lang
      AND v.source IS NOT DISTINCT FROM f.source GROUP BY v.doc_id)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(within, false) AS kept
FROM s LEFT JOIN j ON s.doc_id = j.doc_id
"""

#: Base patterns by split and match lengths; entropy from the character counts of every window.
OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
pats AS (SELECT * FROM (VALUES
  (0, 'assign', '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'access', 'AKIA[A-Z0-9]{14,}'), (2, 'hex', '[0-9a-f]{16,}'), (3, 'candidate', '[A-Za-z0-9+/_=-]{20,}')) v(rank, kind, pat)),
hits AS (SELECT doc_id, rank, kind, regexp_extract_all(t, pat) AS m, string_split_regex(t, pat) AS g,
           CASE WHEN rank = 0 THEN regexp_extract_all(t, pat, 1) ELSE regexp_extract_all(t, pat) END AS part
         FROM d, pats WHERE regexp_matches(t, pat)),
one AS (SELECT doc_id, rank, kind, unnest(range(1, len(m) + 1)) AS i, m, g, part FROM hits),
pos AS (SELECT doc_id, rank, kind, i, m[i] AS found, part[i] AS part,
          sum(length(g[i]) + length(m[i])) OVER (PARTITION BY doc_id, rank ORDER BY i)::BIGINT AS e FROM one),
sp AS (SELECT doc_id, rank, kind, found, part, e - length(found) AS s, e FROM pos),
base AS (SELECT doc_id, rank, kind, s, e FROM sp WHERE rank < 3 AND (rank > 0 OR length(part) >= 12)),
cand AS (SELECT doc_id, found AS c, s, regexp_matches(found, '^([0-9a-f]+|[0-9A-F]+)$') AS is_hex FROM sp WHERE rank = 3
         AND NOT regexp_matches(found, '^[A-Za-z_=-]+$') AND NOT regexp_matches(found, '^[0-9_=+-]+$')
         AND NOT regexp_matches(found, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')
         AND NOT regexp_matches(found, '^/?([A-Za-z_-]{2,}[0-9]{0,4}/)+[A-Za-z_-]*[0-9]{0,4}$')
         AND NOT regexp_matches(found, '(?i)example|sample|placeholder|changeme|xxxx|1234567890|abcdefgh')),
win AS (SELECT doc_id, s, is_hex, k, unnest(string_split(substring(c, k, 20), '')) AS ch
        FROM (SELECT *, unnest(range(1, length(c) - 18)) AS k FROM cand)),
cnt AS (SELECT doc_id, s, is_hex, k, ch, count(*) AS n FROM win GROUP BY ALL),
ent AS (SELECT doc_id, s, is_hex, k, sum(round(n * log2(n) * 1048576)) AS parts FROM cnt GROUP BY ALL),
mark AS (SELECT doc_id, 3 AS rank, CASE WHEN is_hex THEN 'entropy_hex' ELSE 'entropy_base64' END AS kind, s + min(k) - 1 AS s, s + max(k) - 1 + 20 AS e
         FROM ent WHERE parts <= floor(20 * (log2(20) - CASE WHEN is_hex THEN 3.1 ELSE 3.75 END) * 1048576) GROUP BY doc_id, ent.s, is_hex),
fresh AS (SELECT * FROM mark m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = m.doc_id AND b.s <= m.s AND m.e <= b.e)),
a AS (SELECT doc_id, rank, s, e, kind || ':' || s || ':' || e AS x FROM base UNION ALL SELECT doc_id, rank, s, e, kind || ':' || s || ':' || e FROM fresh),
l AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
        coalesce(string_agg(x, ',' ORDER BY s, rank) FILTER (rank < 3), '') AS b, string_agg(x, ',' ORDER BY s, rank) AS spans FROM a GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN l ON d.doc_id = l.doc_id
"""

#: Every window of 35 words by its text.
OP3 = r"""
WITH a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM a WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY t) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
k AS (SELECT x.doc_id, count(c.i) AS gone, coalesce(string_agg(x.w[x.i], ' ' ORDER BY x.i) FILTER (c.i IS NULL), '') AS kept
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM a) x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
SELECT a.doc_id, len(a.w)::BIGINT AS n_words, coalesce(k.gone, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM a LEFT JOIN k ON a.doc_id = k.doc_id
"""

#: All pairs of vectors, then everything that their links reach.
OP4 = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.m AS component_id, vec_id = c.m AS kept
FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""

SQL: dict[str, str] = {
    "op1_secret_scan": OP1,
    "op2_quality_rules": OP2,
    "op3_substring_dedup": OP3,
    "op4_embedding_near_dedup": OP4,
    "op6_line_dedup": OP6,
}
