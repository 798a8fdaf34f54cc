"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
LOW = f"translate(coalesce(text, ''), {UPPER}, {LOWER})"

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM w)),
n AS (SELECT d.doc_id, count(s.s) AS n FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
link AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 85 * ((SELECT n FROM n WHERE doc_id = a.doc_id) + (SELECT n FROM n WHERE doc_id = b.doc_id) - count(*))),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents
  UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) c ON c.u = n.doc_id"""

CHAT = """
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
shown AS (
  SELECT *, replace(replace(replace(text, '\\', '\\b'), '###', '\\h'), '</turn>', '\\t') AS coded FROM given),
chats AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         CAST(sum(4 + length(role) + 2 + length(coded) + 8) AS BIGINT) AS formatted_chars,
         string_agg(role || ',', '' ORDER BY turn, role, text) AS roles
  FROM shown GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
       CASE WHEN regexp_full_match(roles, '(system,)?(user,assistant,)+') THEN 'ok'
            WHEN regexp_full_match(roles, '(system,)?(user,assistant,)*(user,)?') THEN 'unfinished' ELSE 'refused' END AS status
FROM chats"""

MIXING = """
WITH named AS (
  SELECT doc_id, CASE WHEN regexp_full_match(source, 'src[0-9]') THEN 'web' ELSE 'curated' END AS domain,
         coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
leaves AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, 4 * CAST(sum(n_tokens) AS BIGINT) AS lim FROM named GROUP BY ALL),
d1 AS (
  SELECT domain, CAST(sum(lim) AS BIGINT) AS lim, CASE domain WHEN 'web' THEN 60 WHEN 'curated' THEN 40 ELSE 1 END AS weight,
         CAST((SELECT floor(sum(tokens) * 0.8e0) FROM leaves) AS BIGINT) AS budget FROM leaves GROUP BY domain),
d2 AS (
  SELECT *, (budget - coalesce(sum(lim) OVER (ORDER BY lim / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY lim / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM d1),
d3 AS (SELECT *, max(CASE WHEN lim / weight > level THEN level END) OVER () AS top FROM d2),
d AS (SELECT domain, CAST(CASE WHEN top IS NULL THEN lim ELSE greatest(0, least(lim, floor(top * weight))) END AS BIGINT) AS budget FROM d3),
l1 AS (
  SELECT domain, lang, CAST(sum(lim) AS BIGINT) AS lim,
         CASE lang WHEN 'en' THEN 50 WHEN 'de' THEN 20 WHEN 'fr' THEN 20 WHEN 'es' THEN 10 ELSE 1 END AS weight, any_value(budget) AS budget
  FROM leaves JOIN d USING (domain) GROUP BY domain, lang),
l2 AS (
  SELECT *, (budget - coalesce(sum(lim) OVER (PARTITION BY domain ORDER BY lim / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (PARTITION BY domain ORDER BY lim / weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM l1),
l3 AS (SELECT *, max(CASE WHEN lim / weight > level THEN level END) OVER (PARTITION BY domain) AS top FROM l2),
l AS (SELECT domain, lang, CAST(CASE WHEN top IS NULL THEN lim ELSE greatest(0, least(lim, floor(top * weight))) END AS BIGINT) AS budget FROM l3),
s1 AS (SELECT domain, lang, source, tokens, lim, 1 AS weight, budget FROM leaves JOIN l USING (domain, lang)),
s2 AS (
  SELECT *, (budget - coalesce(sum(lim) OVER (PARTITION BY domain, lang ORDER BY lim / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (PARTITION BY domain, lang ORDER BY lim / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM s1),
s3 AS (SELECT *, max(CASE WHEN lim / weight > level THEN level END) OVER (PARTITION BY domain, lang) AS top FROM s2),
s4 AS (SELECT domain, lang, source, tokens, CAST(CASE WHEN top IS NULL THEN lim ELSE greatest(0, least(lim, floor(top * weight))) END AS BIGINT) AS budget FROM s3),
s AS (SELECT *, CASE WHEN tokens > 0 THEN CAST(floor(budget / tokens) AS INTEGER) ELSE 0 END AS whole FROM s4),
r AS (
  SELECT n.*, s.whole, s.budget - s.whole * s.tokens AS rest, md5('17:' || s.whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM named n JOIN s USING (domain, lang, source)),
p AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM r),
e AS (SELECT *, unnest(range(0, CASE WHEN rest > 0 AND upto <= rest THEN whole + 1 ELSE whole END)) AS epoch FROM p)
SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, domain, lang, source, n_tokens FROM e"""

LINES = """
WITH lines AS (
  SELECT doc_id, source, i, line, regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS bare
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
common AS (SELECT bare FROM lines WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT coalesce(source, '\\0')) >= 10),
marked AS (SELECT l.*, c.bare IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.bare = c.bare),
cleaned AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text FROM marked GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM cleaned"""

DECONTAMINATION = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
runs AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
found AS (SELECT doc_id, i, runs.n, item_id FROM runs JOIN win ON runs.k = win.k AND runs.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
who AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN who USING (doc_id)"""


#: crc32 of a run of letters behind an id, from the table of the 256 single bytes; letters beyond ASCII are two bytes.
VARIANTS = f"""
WITH RECURSIVE ct AS (
  SELECT list(v ORDER BY i) AS ct FROM (
    SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                          lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))),
runs AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all({LOW}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
h AS (
  SELECT run, k, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
           string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
           lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195::BIGINT, CAST(unicode(c) - 64 AS BIGINT)] END))),
           lambda c, b: xor(c >> 8, ct[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295::BIGINT) AS h
  FROM runs, ct),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT k, CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, rest FROM cut JOIN (SELECT word AS rest FROM words) USING (rest)
  UNION SELECT rest, word FROM cut JOIN (SELECT word AS rest FROM words) USING (rest)),
ranked AS (
  SELECT p.word, p.near, w.n AS near_n, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS r,
         count(*) OVER (PARTITION BY p.word) AS n_near
  FROM pairs p JOIN words w ON w.word = p.near),
named AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 10 * w.n THEN r.near END AS form,
         CASE WHEN r.near_n >= 10 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1),
path AS (
  SELECT word, word AS at FROM named
  UNION ALL SELECT p.word, n.form FROM path p JOIN named n ON n.word = p.at WHERE n.form IS NOT NULL)
SELECT n.word, n.form, p.at AS root, n.n, n.n_near, n.form_n
FROM named n JOIN path p ON p.word = n.word JOIN named e ON e.word = p.at AND e.form IS NULL"""

PHRASES = f"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(part, '[^\\x20\\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOW}, '[.,;:!?\\x0A-\\x0D]')) AS part FROM documents)),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
f AS (
  SELECT lang, p, CAST(count(*) AS BIGINT) AS f
  FROM (SELECT lang, list_slice(w, i, i + k - 1) AS p
        FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k))
  GROUP BY lang, p HAVING count(*) >= 30),
cuts AS (
  SELECT f.lang, f.p, f.f AS a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * f.f) // (l.f::HUGEINT + r.f) AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM f) f
  JOIN f l ON l.lang = f.lang AND l.p = list_slice(f.p, 1, k) JOIN f r ON r.lang = f.lang AND r.p = list_slice(f.p, k + 1, len(f.p))),
candidates AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
gone AS (
  SELECT DISTINCT s.lang, s.p
  FROM (SELECT lang, a, list_slice(p, i, i + m - 1) AS p
        FROM (SELECT lang, p, a, m, unnest(range(1, len(p) - m + 2)) AS i FROM candidates, (SELECT unnest([2, 3]) AS m) WHERE len(p) > m)) s
  JOIN candidates c ON c.lang = s.lang AND c.p = s.p WHERE 100::HUGEINT * s.a >= 80::HUGEINT * c.a),
kept AS (SELECT c.*, array_to_string(c.p, ' ') AS phrase FROM candidates c ANTI JOIN gone g ON g.lang = c.lang AND g.p = c.p)
SELECT k.lang, CAST(row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, t.n,
       CAST(score AS BIGINT) AS score
FROM kept k JOIN total t ON t.lang = k.lang QUALIFY rank <= 2000"""


def licenses_sql() -> str:
    """Every rule behind its keywords, from the same list of rules; overlaps resolved by comparing matches of one text."""
    from .licenses import RULES, spaced
    rules = ",\n  ".join(f"({i}, '{spaced(r.pattern)}', '{r.label}', {r.priority}, {r.confidence!r}::DOUBLE, {r.base}, {list(r.keywords)!r})"
                         for i, r in enumerate(RULES))
    return f"""
WITH rules(rule, pattern, label, priority, confidence, base, keywords) AS (VALUES
  {rules}),
texts AS (
  SELECT row_number() OVER () AS row, doc_id,
         ' ' || trim(regexp_replace({LOW}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', '  ', 'g'), ' ') || ' ' AS w FROM documents),
marked AS (
  SELECT row, r.*, regexp_replace(w, pattern, ' ' || chr(1) || '\\1' || chr(2) || ' ', 'g') AS m
  FROM texts JOIN rules r ON len(list_filter(keywords, lambda k: contains(w, ' ' || k || ' '))) > 0),
placed AS (
  SELECT row, rule, label, priority, confidence, base,
         unnest(list_filter(range(len(m)), lambda i: starts_with(m[i + 1], chr(1)))) AS first,
         unnest(list_filter(range(len(m)), lambda i: ends_with(m[i + 1], chr(2)))) AS last
  FROM (SELECT * REPLACE (string_split(trim(m, ' '), '  ') AS m) FROM marked WHERE contains(m, chr(1)))),
told AS (
  SELECT p.*, NOT EXISTS (
    SELECT 1 FROM placed q WHERE q.row = p.row AND q.rule <> p.rule AND q.first <= p.first AND q.last >= p.last AND
      (q.priority > p.priority OR q.priority = p.priority AND (q.last - q.first > p.last - p.first OR q.rule < p.rule))) AS kept
  FROM placed p),
found AS (
  SELECT row, count(*) FILTER (WHERE base) AS n_base, CAST(min(first) FILTER (WHERE base) AS BIGINT) AS first_word,
         CAST(max(first) FILTER (WHERE base) AS BIGINT) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base OR kept) AS labels,
         max(confidence) FILTER (WHERE base OR kept) AS score
  FROM told GROUP BY row)
SELECT doc_id, CASE WHEN w = '  ' THEN 0 ELSE CAST((length(w) - length(replace(w, '  ', ' '))) + 1 AS BIGINT) END AS n_words,
       coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0e0) AS score
FROM texts LEFT JOIN found USING (row)"""
