"""DuckDB SQL of the queries that SQL can express on whole tables."""

SQL: dict[str, str] = {}

SQL["op1_chat_format"] = """
WITH t AS (
  SELECT conv_id, turn, role, text,
         coalesce(length(role)::VARCHAR || ':' || role, '-')
         || coalesce(length(text)::VARCHAR || ':' || text, '-') || ';' AS part
  FROM conversations
), p AS (
  SELECT conv_id, row_number() OVER w AS k, string_agg(part, '') OVER w AS prefix
  FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST
               ROWS UNBOUNDED PRECEDING)
), n AS (SELECT conv_id, max(k) AS n_turns FROM p GROUP BY conv_id),
whole AS (
  SELECT p.prefix, min(p.conv_id) AS conv_id, count(*) AS n_copies, any_value(n.n_turns) AS n_turns
  FROM p JOIN n ON n.conv_id = p.conv_id AND n.n_turns = p.k GROUP BY p.prefix
), shorter AS (
  SELECT p.conv_id, p.prefix FROM p JOIN n ON n.conv_id = p.conv_id AND p.k < n.n_turns
), kept AS (
  SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM shorter s WHERE s.prefix = w.prefix)
), snaps AS (
  SELECT k.conv_id, count(*) AS n
  FROM kept k JOIN shorter s ON s.conv_id = k.conv_id JOIN whole w ON w.prefix = s.prefix
  GROUP BY k.conv_id
)
SELECT k.conv_id, k.n_turns, k.n_copies, coalesce(s.n, 0) AS n_snapshots,
       (SELECT string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '')
                          || '<|im_end|>' || chr(10), ''
                          ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
        FROM t WHERE t.conv_id = k.conv_id) AS chat
FROM kept k LEFT JOIN snaps s ON s.conv_id = k.conv_id
"""
SQL["op2_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT item_id, least(10, len(w)) AS n, w[i + 1 : i + least(10, len(w))] AS g
  FROM (SELECT *, unnest(range(len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, i, n, w[i + 1 : i + n] AS g
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)
), h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.g = dw.g),
hw AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id
), hi AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM h GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(hw.n_hit, 0) AS n_hit,
       coalesce(hi.n_items, 0) AS n_items, sha256(coalesce(hi.items, '')) AS items_sha256,
       coalesce(hw.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
SQL["op3_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, i AS line_no, line, list_filter(
           regexp_split_to_array(line, '[ \t\x0B\f\r]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
), k AS (SELECT * FROM l WHERE len(w) >= 5),
u AS (SELECT w, min((doc_id, line_no)) AS first FROM k GROUP BY w),
v AS (SELECT w, first, len(w) AS n, unnest(range(len(w))) AS i FROM u),
e AS (SELECT w, first, n, i, w[1 : i] || w[i + 2 :] AS rest FROM v),
sub AS (SELECT n, i, rest, min(first) AS first FROM e GROUP BY n, i, rest),
del AS (SELECT rest, min(first) AS first FROM e GROUP BY rest),
near AS (
  SELECT e.w FROM e JOIN sub s ON s.n = e.n AND s.i = e.i AND s.rest = e.rest
  WHERE s.first < e.first
  UNION SELECT e.w FROM e JOIN u ON u.w = e.rest WHERE u.first < e.first
  UNION SELECT u.w FROM u JOIN del ON del.rest = u.w WHERE del.first < u.first
), f AS (
  SELECT l.doc_id, l.line_no, l.line,
         u.w IS NOT NULL AND u.first <> (l.doc_id, l.line_no) AS exact,
         u.w IS NOT NULL AND u.first = (l.doc_id, l.line_no)
           AND EXISTS (SELECT 1 FROM near WHERE near.w = l.w) AS near
  FROM l LEFT JOIN u ON u.w = l.w
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE exact) AS n_exact,
       count(*) FILTER (WHERE near) AS n_near,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no)
                       FILTER (WHERE NOT exact AND NOT near), '')) AS text_sha256
FROM f GROUP BY doc_id
"""
SQL["op12_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t
  FROM documents
), c AS (
  SELECT doc_id, text, t, len(t) AS n, ('0x' || h[1:8])::BIGINT % (len(t) + 1) AS x,
         ('0x' || h[9:16])::BIGINT % (len(t) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
                OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT doc_id, text, n, form, array_to_string(t[1 : least(x, y)], '') AS a,
         array_to_string(t[least(x, y) + 1 : greatest(x, y)], '') AS m,
         array_to_string(t[greatest(x, y) + 1 :], '') AS z
  FROM c
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m
                        ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
SQL["op13_reversed_search"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents
), b AS (
  SELECT item_id, row_number() OVER () AS i, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark
), totals AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
bt AS (SELECT i, any_value(item_id) AS item_id, term, count(*) AS times FROM b GROUP BY i, term),
tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM bt) GROUP BY r, doc_id, n, term
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, totals GROUP BY term, n_docs
), s AS (
  SELECT i, any_value(bt.item_id) AS item_id, r, any_value(doc_id) AS doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT
           AS score
  FROM tf JOIN bt USING (term) JOIN w USING (term), totals GROUP BY i, r
), k AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS rank
  FROM s WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
"""
