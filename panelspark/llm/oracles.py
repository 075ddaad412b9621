"""DuckDB SQL for the queries that SQL can express."""

# Words are runs outside these six characters; documents' words in SQL.
_SPACES = r"[\x20\x09-\x0D]+"

OP9 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, CASE WHEN role = 'user' THEN contains(text, ' [/INST]') WHEN role = 'assistant' THEN contains(text, '</s>')
                 ELSE contains(text, '<</ROLE>>') OR contains(role || '>', '>>') END
            OR regexp_matches(text || role, '\x1a[0-4]') AS conflict,
    len(text) + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 5 ELSE 18 + len(role) END AS plain_chars,
    len(regexp_replace(text, '[^\x1a\[<:>]', '', 'g'))
      + CASE WHEN role IN ('user', 'assistant') THEN 0 ELSE len(regexp_replace(role, '[^\x1a\[<:>]', '', 'g')) END AS marks
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(plain_chars + CASE WHEN conflict THEN marks ELSE 0 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_WORDS = r"""
w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {table}
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
)"""

OP10 = (
    "WITH RECURSIVE"
    + _WORDS.format(table="documents")
    + """, n AS (SELECT doc_id, count(s)::BIGINT AS n_shingles FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id)
, edges AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id
    GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * k >= 75 * (p.n_shingles + q.n_shingles - k)
), reach(doc_id, node) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.node
)
SELECT n.doc_id, n.n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
)


OP2 = (
    "WITH"
    + _WORDS.format(table="documents")
    + ", "
    + _WORDS.format(table="(SELECT item_id AS doc_id, text FROM benchmark)").replace("w AS (", "iw AS (", 1).replace("s AS (", "items AS (", 1).replace("FROM w", "FROM iw")
    + """, n AS (SELECT doc_id AS item_id, count(*) AS n_item_shingles FROM items GROUP BY ALL)
SELECT s.doc_id, n.item_id, n.n_item_shingles, count(*) AS n_shared
FROM items i JOIN n ON n.item_id = i.doc_id JOIN s ON s.s = i.s GROUP BY ALL HAVING count(*) >= 0.75 * n.n_item_shingles
"""
)

OP7 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
), w AS (
  SELECT doc_id, pos, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l
), c AS (
  SELECT w, min({'doc': doc_id, 'pos': pos}) AS first FROM w WHERE len(w) >= 1 GROUP BY w
), v AS (
  SELECT first, len(w) AS n, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS rest
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM c WHERE len(w) >= 4)
), whole AS (SELECT first, len(w) AS n, array_to_string(w, ' ') AS rest FROM c WHERE len(w) >= 4),
near AS (
  SELECT y.first FROM v x JOIN v y ON x.rest = y.rest AND x.i = y.i AND x.n = y.n AND x.first < y.first
  UNION SELECT y.first FROM v x JOIN whole y ON x.rest = y.rest AND x.n = y.n + 1 AND x.first < y.first
  UNION SELECT x.first FROM v x JOIN whole y ON x.rest = y.rest AND x.n = y.n + 1 AND y.first < x.first
), marked AS (
  SELECT w.doc_id, w.pos, w.line,
    coalesce(c.first <> {'doc': w.doc_id, 'pos': w.pos} OR c.first IN (SELECT first FROM near), false) AS gone
  FROM w LEFT JOIN c ON c.w = w.w
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
  count(*) AS n_lines, count(*) FILTER (WHERE NOT gone) AS n_kept
FROM marked GROUP BY doc_id
"""

OP11 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), m AS (
  SELECT *, strlen(body)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY body) AS least FROM p
), r AS (SELECT *, payload_bytes >= 100 AND least IS NOT NULL AND page_id IS DISTINCT FROM least AS again FROM m)
SELECT page_id, payload_bytes, sha256(body) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN least END AS refers_to
FROM r
"""

# The hash is made from bytes (two digits each), with the table of the reflected polynomial; strings stand by code points.
OP12 = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
  ) GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(range(0, len(d) // 2), lambda c, i: xor(c >> 8, t[1 + xor(c & 255, ('0x' || d[2 * i + 1:2 * i + 2])::BIGINT)]), 4294967295)) AS h
  FROM (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS d FROM runs), crc
), v AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN run[:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, n FROM hashed
  ) WHERE len(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS (
  SELECT word, len(word) AS size, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, len(word) + 1)) AS i FROM v)
), near AS (
  SELECT x.word, y.word AS near FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.size = y.size AND x.word <> y.word
  UNION SELECT x.word, y.word FROM cut x JOIN v y ON x.rest = y.word
  UNION SELECT y.word, x.word FROM cut x JOIN v y ON x.rest = y.word
), best AS (
  SELECT near.word, count(*) AS n_near, min({'m': -v.n, 'w': near}) AS b FROM near JOIN v ON v.word = near.near GROUP BY ALL
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.m >= 5 * v.n THEN b.w END AS form, CASE WHEN -b.m >= 5 * v.n THEN -b.m END AS form_n
  FROM v LEFT JOIN best USING (word)
), walk(word, reached) AS (
  SELECT word, word FROM f UNION ALL SELECT w.word, f.form FROM walk w JOIN f ON f.word = w.reached WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, w.reached AS root, f.n, f.n_near, f.form_n
FROM f JOIN walk w USING (word) JOIN f e ON e.word = w.reached AND e.form IS NULL
"""

ORACLES: dict[str, str] = {
    "op2_decontaminate": OP2,
    "op7_line_dedup": OP7,
    "op9_chat_format": OP9,
    "op10_near_dedup": OP10,
    "op11_warc": OP11,
    "op12_spelling": OP12,
}
