"""DuckDB statements that give the rows of the queries SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all({LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, w[i:least(i + 9, len(w))] AS win
  FROM item_words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
doc_words AS (
  SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
lengths AS (SELECT DISTINCT len(win) AS n FROM windows),
places AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS win FROM doc_words, lengths, unnest(range(1, len(w) - n + 2)) AS u(i)),
hits AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (win)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP2 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, w[i:i + 2] AS s FROM words, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS node, b AS other FROM both_ways
  UNION SELECT node, both_ways.b FROM reach JOIN both_ways ON other = both_ways.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(other) AS m FROM reach GROUP BY node) USING (doc_id)"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT doc_id, i, w[i:i + 7] AS win FROM words, unnest(range(1, len(w) - 6)) AS u(i)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
steps AS (SELECT doc_id, least(8, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 8)) AS more FROM twice),
repeated AS (SELECT doc_id, sum(more) AS n FROM steps GROUP BY doc_id),
measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    length(array_to_string(lines, '')) AS line_chars,
    CAST(length(array_to_string(list_filter(lines, lambda x:
      right(regexp_replace(x, '[\x20\x09-\x0D]+$', ''), 1) IN ('.', '!', '?', '…', '"', '”', '»', ':', ')')
      AND NOT regexp_matches(x, '(?i)(^|[^\p{L}\p{N}_])lorem ipsum([^\p{L}\p{N}_]|$)')
      AND NOT (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) <= 15 AND regexp_matches(x, '(?i)(^|[^\p{L}\p{N}_])(javascript|cookie policy|cookie settings|terms of use|terms of service|privacy policy|all rights reserved|skip to content|sign in|log in|subscribe to our|share this|read more|click here|back to top)([^\p{L}\p{N}_]|$)'))
      AND len(regexp_extract_all(x, '[#*$%&|<>]')) * 10 <= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
      AND len(regexp_extract_all(x, '!!')) * 3 <= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))), '')) AS BIGINT) AS kept_chars
  FROM words LEFT JOIN repeated USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, kept_chars,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND kept_chars >= 0.5 * line_chars AS kept
FROM measured"""

OP8 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
written AS (
  SELECT *, length('<|im_start|>') + length(r) + 1 + length(t) + length('<|im_end|>') + 1 AS chars FROM (
    SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS t,
      regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS r FROM rows))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id"""

_KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]+-----END [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
    ("login", r"://[^\s:/@]{1,100}:[^\s/@]{1,100}@", 0, 1),
]

# A match starts after what came before it: the gaps are what splitting at the pattern leaves.
OP10 = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), " + ", ".join(f"""
  hits_{kind} AS (
    SELECT doc_id, k, hit, length(gap) AS gap FROM (
      SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}')) AS hit, unnest(string_split_regex(t, '{pattern}')[:-2]) AS gap,
        generate_subscripts(regexp_extract_all(t, '{pattern}'), 1) AS k
      FROM d WHERE regexp_matches(t, '{pattern}'))),
  spans_{kind} AS (
    SELECT doc_id, '{kind}' AS kind, {i} AS rank, hit,
      sum(gap + length(hit)) OVER (PARTITION BY doc_id ORDER BY k) AS e,
      length({f"regexp_extract(hit, '{pattern}', {group})" if group else "hit"}) >= {least} AS counts
    FROM hits_{kind})""" for i, (kind, pattern, group, least) in enumerate(_KINDS)) + """,
found AS (""" + " UNION ALL ".join(f"SELECT * FROM spans_{kind} WHERE counts" for kind, *_ in _KINDS) + """),
placed AS (SELECT doc_id, kind, rank, CAST(e - length(hit) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM found),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM placed GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)"""

# CRC-32 of a string, bit by bit, lowest bit of each byte first; the strings are decimal numbers or one-byte letters and two-byte ones.
CRC32 = """list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(range(1, octet_length(encode({0})) + 1),
    lambda i: list_transform(range(0, 8), lambda b: (('0x' || hex(encode({0})[i:i]))::UBIGINT >> b) & 1::UBIGINT)))),
    lambda x, bit: xor(x >> 1, 3988292384::UBIGINT * (xor(x, bit) & 1)))"""

OP13 = rf"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, CAST(xor({CRC32.format("CAST(c AS VARCHAR)")}, 4294967295::UBIGINT) % 6 AS BIGINT) AS h FROM (SELECT DISTINCT c FROM own)),
rebuilt AS (
  SELECT convs.c, own.pos, role, text FROM convs JOIN own ON own.c = convs.c - convs.c % 100 WHERE own.pos <= h
  UNION ALL SELECT c, pos, role, text FROM convs JOIN own USING (c) WHERE pos > h),
turns AS (SELECT c, list(md5(role || chr(10) || text) ORDER BY pos) AS seq, list(length(text) ORDER BY pos) AS chars FROM rebuilt GROUP BY c),
whole AS (SELECT c, coalesce(seq, []) AS seq, coalesce(chars, []) AS chars FROM convs LEFT JOIN turns USING (c)),
members AS (SELECT c, CAST(d AS BIGINT) AS d, seq[1:d] AS key, seq[1:d - 1] AS up, CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS last, len(seq) = d AS over FROM whole, unnest(range(0, len(seq) + 1)) AS u(d)),
nodes AS (
  SELECT d, key, any_value(up) AS up, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(last) AS saved,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (over), '')) AS ends FROM members GROUP BY d, key),
kids AS (SELECT up AS key, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
known AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids USING (d, key)),
below AS (
  SELECT key[1:e] AS key, CAST(e AS BIGINT) AS d, sum(saved) AS saved, count(*) FILTER (k = 0) AS leaves
  FROM known, unnest(range(0, d + 1)) AS u(e) GROUP BY ALL)
SELECT known.c AS conv_id, known.d AS depth, p.c AS parent_conv_id, known.n AS n_convs, known.k AS n_children,
  below.leaves AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, known.ends AS ends_sha256
FROM known JOIN below USING (d, key) LEFT JOIN nodes p ON known.d > 0 AND p.d = known.d - 1 AND p.key = known.up"""

OP12 = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER.format('text')}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (
  SELECT run, k, coalesce(CAST(xor({CRC32.format("(CAST(doc_id AS VARCHAR) || ':' || run)")}, 4294967295::UBIGINT) AS BIGINT), 1) AS h FROM runs),
planted AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM planted WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
places AS (SELECT word, n, i FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
masked AS (SELECT word, n, left(word, i - 1) || '_' || substr(word, i + 1) AS mask FROM places),
shorter AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS rest FROM places),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM masked a JOIN masked b USING (mask) WHERE a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, n, count(*) AS n_near, arg_min(struct_pack(other, m), struct_pack(minus := -m, other := encode(other))) AS top FROM near GROUP BY word, n),
formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN top.m >= 2 * words.n THEN top.other END AS form,
    CASE WHEN top.m >= 2 * words.n THEN top.m END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS at, form AS next FROM formed
  UNION ALL SELECT chain.word, formed.word, formed.form FROM chain JOIN formed ON chain.next = formed.word)
SELECT formed.word, form, chain.at AS root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM formed JOIN chain ON chain.word = formed.word AND chain.next IS NULL"""

ORACLE = {"op1_decontaminate": OP1, "op2_jaccard_join": OP2, "op5_line_rules": OP5, "op8_chat_format": OP8, "op10_secret_scan": OP10, "op12_spelling_variants": OP12, "op13_prefix_trie": OP13}
