"""DuckDB SQL for the queries that SQL can express."""

from tracelake.llm.licenses import BARRIER, THRESHOLD, templates

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AND row_number() OVER (PARTITION BY coalesce(text, ''), doc_id) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

MIXING = """
WITH docs AS (
  SELECT doc_id, source, row_number() OVER () AS i, md5(coalesce(text, '')) AS tie, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_rows FROM docs GROUP BY source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size::DOUBLE * 3 AS cap FROM sums),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
aimed AS (SELECT *, least(cap, coalesce((max(level) FILTER (WHERE level * weight <= cap) OVER ()) * weight, cap)) AS target FROM levels),
classes AS (SELECT source AS c, length(bin(size)) AS b, sum(size)::BIGINT AS words, any_value(source_size) AS source_size, any_value(target) AS target FROM docs JOIN aimed USING (source) GROUP BY ALL
            UNION ALL SELECT d.source, length(bin(size)), sum(size)::BIGINT, any_value(source_size), any_value(target) FROM docs d JOIN aimed a ON d.source IS NULL AND a.source IS NULL GROUP BY ALL),
heights AS (
  SELECT *, sum((8 + b) * words) OVER w AS rest, (target - coalesce(sum(words) OVER (PARTITION BY c ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 3::DOUBLE) AS open
  FROM classes WINDOW w AS (PARTITION BY c ORDER BY b DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
grown AS (SELECT *, CASE WHEN rest > 0 THEN open / rest::BIGINT END AS height FROM heights),
expected AS (SELECT *, CASE WHEN source_size > 0 THEN least(3::DOUBLE, coalesce((max(height) FILTER (WHERE height * (8 + b) <= 3) OVER (PARTITION BY c)) * (8 + b), 3::DOUBLE)) ELSE 0::DOUBLE END AS e FROM grown),
plan AS (
  SELECT c AS s, b, source_size, target, floor(e)::BIGINT AS certain, (e - floor(e)) / (1::DOUBLE - (e - floor(e))) AS odds, target - sum(floor(e)::BIGINT * words) OVER (PARTITION BY c)::BIGINT AS room FROM expected),
ranked AS (SELECT *, CASE WHEN odds > 0 THEN u / (1::DOUBLE - u) / odds ELSE u END AS rank FROM docs JOIN plan ON source IS NOT DISTINCT FROM s AND length(bin(size)) = b),
-- in the order of ranks whatever fits, then the smallest of the rest if it lands nearer to the mark
filled AS (
  SELECT source AS f, list_reduce(list({'i': i, 'size': size} ORDER BY rank, tie, i), lambda a, x: CASE WHEN x.size <= a.room THEN {'room': a.room - x.size, 'took': list_append(a.took, x.i)} ELSE a END, {'room': max(room), 'took': []::BIGINT[]}) AS done
  FROM ranked WHERE odds > 0 AND size > 0 GROUP BY source),
chosen AS (
  SELECT unnest(done.took) AS c FROM filled
  UNION ALL
  SELECT arg_min(i, (size, rank, tie, i)) FROM ranked JOIN filled ON source IS NOT DISTINCT FROM f WHERE size > done.room AND size < 2 * done.room AND NOT list_contains(done.took, i) GROUP BY source)
SELECT doc_id, size, source_size, target, ((certain + (i IN (SELECT c FROM chosen))::INT) * size)::BIGINT AS taken FROM ranked
"""

CHAT_FORMAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (SELECT *, regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') AS safe_role, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS safe_text FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(23 + length(safe_role) + length(safe_text))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS bytes FROM pages),
f AS (SELECT *, CASE WHEN bytes >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first,
             row_number() OVER (PARTITION BY html, page_id) AS nth FROM p)
SELECT page_id, bytes AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first OR (bytes >= 100 AND nth > 1) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first OR (bytes >= 100 AND nth > 1) THEN first END AS refers_to
FROM f
"""

NGRAM_JOIN = """
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM split),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
flat AS (SELECT doc_id, unnest(s) AS g FROM sets),
both_have AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM both_have JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, n::BIGINT AS n_shingles, component_id FROM sizes JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = doc_id
"""

_TEMPLATES = ", ".join("({}, '{}', '{}')".format(k, *(x.replace("'", "''") for x in row)) for k, row in enumerate(templates()))
_GRAMS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
_PAIRS = "unnest(list_transform(range(1, len({0})), lambda i: {{'i': i - 1, 'b': {0}[i] || ' ' || {0}[i + 1]}}))"
_CLEAN = "regexp_replace(lower(text), '[^\\p{L}\\p{N}\\n]+', ' ', 'g')"
_BEST = "arg_min(license, (-d, license)) AS license, max(d) AS d"
# more bigrams than any template can match
_MOST = 2 * max(len(text.split()) for _, text in templates())
_LOW = THRESHOLD / (2 - THRESHOLD)
LICENSES = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_CLEAN} AS t FROM documents WHERE text IS NOT NULL),
given AS (SELECT template, license, string_split(trim(regexp_replace({_CLEAN}, '\\s+', ' ', 'g')), ' ') AS w FROM (VALUES {_TEMPLATES}) AS v(template, license, text)),
wanted AS (SELECT template, license, len(w) AS k, {_GRAMS.format("w")} AS g FROM given),
-- lines, and the whole text as one more
units AS (
  SELECT r, doc_id, u.k AS k, string_split(trim(regexp_replace(u.x, ' +', ' ', 'g')), ' ') AS w
  FROM (SELECT r, doc_id, unnest(list_transform(list_concat(string_split(t, chr(10)), CASE WHEN contains(t, chr(10)) THEN [replace(t, chr(10), ' ')] ELSE [] END), lambda x, i: {{'k': i, 'x': x}})) AS u FROM docs)),
grams AS (SELECT r, doc_id, k, {_GRAMS.format("w")} AS g FROM units WHERE len(w) >= 2),
dice AS (
  SELECT r, doc_id, x.k, license, template, count(*) * 2::DOUBLE / (max(n) + max(size)) AS d
  FROM (SELECT r, doc_id, k, len(g) AS n, unnest(g) AS b FROM grams WHERE len(g) <= {_MOST}) x JOIN (SELECT template, license, len(g) AS size, unnest(g) AS b FROM wanted) USING (b) GROUP BY ALL),
best AS (SELECT r, doc_id, k, {_BEST} FROM dice WHERE d >= {THRESHOLD}::DOUBLE GROUP BY r, doc_id, k),
-- windows in what no matching line covers
taken AS (SELECT r, list(k) AS ks FROM best GROUP BY r),
open_docs AS (
  SELECT r, doc_id, string_split(trim(regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x, i: CASE WHEN list_contains(coalesce(ks, []), i) THEN '{BARRIER}' ELSE x END), ' '), ' +', ' ', 'g')), ' ') AS w
  FROM docs LEFT JOIN taken USING (r) WHERE NOT list_contains(coalesce(ks, []), len(string_split(t, chr(10))) + 1)),
-- windows that begin with a bigram of the template, of all lengths; those without enough of its bigrams within the longest are left out
asked AS (SELECT template, license, g AS own, len(g) AS size, ceil(len(g) * {_LOW}::DOUBLE - 1e-9)::BIGINT AS need, floor((k - 1) / {_LOW}::DOUBLE + 1e-9)::BIGINT AS span FROM wanted),
begun AS (
  SELECT r, doc_id, template, p.i AS a, count(*) OVER (PARTITION BY r, template ORDER BY p.i RANGE BETWEEN CURRENT ROW AND span - 1 FOLLOWING) AS many, need, span
  FROM (SELECT r, doc_id, {_PAIRS.format("w")} AS p FROM open_docs) JOIN (SELECT template, need, span, unnest(own) AS b FROM asked) ON p.b = b),
grown AS (
  SELECT r, doc_id, template, license, a, n, len(list_intersect(list_distinct(win), own)) * 2::DOUBLE / (len(list_distinct(win)) + size) AS d
  FROM (SELECT r, begun.doc_id, begun.template, license, own, size, a, n, list_transform(range(a + 1, a + n + 1), lambda i: w[i] || ' ' || w[i + 1]) AS win
        FROM (SELECT *, unnest(range(need, span + 1)) AS n FROM begun WHERE many >= need) begun JOIN asked USING (template) JOIN open_docs USING (r) WHERE a + n < len(w))),
good AS (SELECT r, doc_id, template, license, a, a + 1 + arg_max(n, (d, -n)) AS z, max(d) AS d FROM grown GROUP BY r, doc_id, template, license, a),
marked AS (SELECT *, CASE WHEN a < max(z) OVER (PARTITION BY r ORDER BY a, z, template ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM good WHERE d >= {THRESHOLD}::DOUBLE),
islands AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY a, z, template) AS island FROM marked),
everything AS (SELECT doc_id, license, d FROM best UNION ALL SELECT doc_id, license, d FROM (SELECT r, doc_id, island, {_BEST} FROM islands GROUP BY r, doc_id, island))
SELECT doc_id, license, max(d) AS score, count(*) AS units FROM everything GROUP BY ALL
"""

_STEP = "{{'c': ({0}).c + {1}, 'a': ({0}).a || '{2}', 'r': ({0}).r || {3}}}"
_DELETED = [_STEP.format(f"s{k}", "2", "D", "''") for k in range(4)]
_HELD = {k + c: f"CASE WHEN fault IN ('', 'truncated') AND role LIKE '{c}%' THEN {_STEP.format('s' + k, 'more', 'K', 'line')} ELSE none END" for k in "0123" for c in "sua"}
_TURNED = ["CASE WHEN fault IN ('', 'truncated') THEN " + _STEP.format(f"s{k}", "more + 1", "R", f"chr(10) || '{'assistant' if k == 2 else 'user'}:' || text") + " ELSE none END" for k in range(4)]
_ADDED = [_STEP.format(x, "5", "I", f"chr(10) || '{'assistant' if x == 'm2' else 'user'}:'") for x in ("m0", "m1", "m2", "m3")]
# the best (cost, audit, text) of every state of the roles (none, s, u, a), carried from row to row; rows are inserted behind each
CONVERSATION_REPAIR = f"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
dealt AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS f FROM given, tab),
broken AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE f WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM dealt WHERE f <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS solid FROM broken),
judged AS (
  SELECT conv_id, turn, role, text, k, n, chr(10) || role || ':' || text AS line,
         CASE WHEN solid = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN NOT regexp_matches(solid, '[.!?]$') THEN 'truncated' ELSE '' END AS fault,
         left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS pair FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
dp AS (
  SELECT conv_id, 0::BIGINT AS k, n, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS s0, {{'c': 1000000000::BIGINT, 'a': '', 'r': ''}} AS s1, {{'c': 5::BIGINT, 'a': 'I', 'r': chr(10) || 'user:'}} AS s2,
         {{'c': 10::BIGINT, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3 FROM judged WHERE k = 1
  UNION ALL
  SELECT conv_id, k, n, m0, m1, u, least(m3, {_STEP.format("u", "5", "I", "chr(10) || 'assistant:'")}) FROM (
    SELECT conv_id, k, n, m0, m1, m3, least(m2, {_ADDED[0]}, {_ADDED[1]}, {_ADDED[3]}) AS u FROM (
      SELECT conv_id, k, n, {_DELETED[0]} AS m0, least({_DELETED[1]}, {_HELD["0s"]}) AS m1,
             least({_DELETED[2]}, {", ".join(_HELD[j] for j in ("0u", "1u", "3u"))}, {", ".join(_TURNED[j] for j in (0, 1, 3))}) AS m2, least({_DELETED[3]}, {_HELD["2a"]}, {_TURNED[2]}) AS m3
      FROM (SELECT dp.conv_id, j.k, j.n, s0, s1, s2, s3, role, text, line, fault, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS more, {{'c': 1000000000::BIGINT, 'a': '', 'r': ''}} AS none
            FROM dp JOIN judged j ON j.conv_id IS NOT DISTINCT FROM dp.conv_id AND j.k = dp.k + 1)))),
solved AS (SELECT conv_id, least(s0, s3) AS best FROM dp WHERE k = n)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts ON i.conv_id IS NOT DISTINCT FROM counts.conv_id LEFT JOIN solved ON i.conv_id IS NOT DISTINCT FROM solved.conv_id
"""

RANKED_SEARCH = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
asked AS (
  SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
entries AS (SELECT q, item_id, term, count(*) AS repeats FROM asked GROUP BY ALL),
sums AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM docs),
held AS (SELECT r, doc_id, size, term, count(*) AS tf FROM (SELECT r, doc_id, len(w)::BIGINT AS size, unnest(w) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, sums WHERE term IN (SELECT term FROM entries) GROUP BY term, n),
scores AS (
  SELECT q, item_id, r, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * size * n) // l))))::BIGINT AS score
  FROM held JOIN weights USING (term) JOIN entries USING (term), sums GROUP BY q, item_id, r, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10
"""
