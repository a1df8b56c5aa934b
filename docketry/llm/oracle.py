"""The same results in SQL, for the queries that SQL can express."""

from __future__ import annotations

CONTROLS = r"([<\[])(\\*)(\|turn\|>|\|text\|>|\|end\|>|s>|/s>|INST\]|/INST\])"

ORACLES: dict[str, str] = {}

ORACLES["op1_chat_formatting"] = rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(23
    + length(regexp_replace(role, '{CONTROLS}', '\1\2\\\3', 'g'))
    + length(regexp_replace(text, '{CONTROLS}', '\1\2\\\3', 'g'))) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""

ORACLES["op6_url_filters"] = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
q AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND split_part(x, '=', 1) NOT IN
        ('ref', 'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content'))) AS params
  FROM p),
c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical
  FROM q),
listed AS (
  SELECT DISTINCT canonical FROM c
  WHERE regexp_matches(host, '(^|[.-])(spam|pills|casino|warez|porn)([.-]|$)') AND canonical IS NOT NULL),
rules(verdict, h, pre) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
  SELECT page_id, arg_max(h || pre, length(h || pre)) AS rule, arg_max(verdict, length(h || pre)) AS verdict
  FROM c, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(best.verdict,
  CASE WHEN c.canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN best USING (page_id)
"""

ORACLES["op3_quality_rules"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
grams AS (
  SELECT doc_id, i, words[i:i + 7] AS gram
  FROM w, LATERAL (SELECT unnest(generate_series(1, len(words) - 7)) AS i) WHERE len(words) > 8),
again AS (
  SELECT doc_id, i FROM grams
  QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, range(8) AS r(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, nth, line, trim(regexp_replace(
    translate(lower(line), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
          unnest(range(len(string_split(text, chr(10))))) AS nth FROM d)),
dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE norm <> '' GROUP BY doc_id),
frequent AS (
  SELECT source, norm, min(doc_id) AS spared FROM lines WHERE norm <> '' GROUP BY source, norm
  HAVING count(DISTINCT doc_id) > CASE WHEN len(string_split(norm, ' ')) > 50 THEN 3 ELSE 20 END),
removed AS (
  SELECT l.doc_id, sum(len(string_split(l.norm, ' '))) AS removed_words FROM lines l
  JOIN frequent f ON l.norm = f.norm AND l.source IS NOT DISTINCT FROM f.source
  WHERE l.doc_id <> f.spared GROUP BY l.doc_id),
c AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND 100 * (n_words - removed_words) >= 30 * n_words AS kept FROM f
"""

ORACLES["op8_benchmark_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(13, len(w)) AS size FROM b WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, w[i:i + least(13, len(w)) - 1] AS gram
  FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i) WHERE len(w) > 0),
grams AS (
  SELECT doc_id, size, i, w[i:i + size - 1] AS gram
  FROM d, sizes, LATERAL (SELECT unnest(generate_series(1, len(w) - size + 1)) AS i) WHERE len(w) >= size),
found AS (SELECT doc_id, i, size, item_id FROM grams JOIN windows USING (size, gram)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM found, LATERAL (SELECT unnest(generate_series(i, i + size - 1)) AS p) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id),
item_terms AS (SELECT item_id, unnest(w) AS term, unnest(range(len(w))) AS pos, len(w) AS n FROM b),
doc_terms AS (
  SELECT doc_id, term, pos FROM (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d)
  WHERE term IN (SELECT term FROM item_terms)),
postings AS (SELECT term, count(*) AS postings FROM doc_terms GROUP BY term),
inside AS (
  SELECT item_id, start, t.term, pos, postings
  FROM item_terms t JOIN postings USING (term),
    LATERAL (SELECT unnest(generate_series(greatest(pos - 12, 0), least(pos, greatest(n - 13, 0)))) AS start)),
ranked AS (
  SELECT item_id, start, term, row_number() OVER (PARTITION BY item_id, start ORDER BY postings, term) AS rank
  FROM (SELECT DISTINCT item_id, start, term, postings FROM inside)),
rare AS (
  SELECT x.item_id, x.start, x.term AS a, y.term AS b FROM ranked x JOIN ranked y USING (item_id, start)
  WHERE x.rank = 1 AND y.rank = 2),
pairs AS (
  SELECT item_id, a, b, max(apart) AS apart FROM (
    SELECT r.item_id, r.start, a, b, min(abs(x.pos - y.pos)) AS apart FROM rare r
    JOIN inside x ON x.item_id = r.item_id AND x.start = r.start AND x.term = a
    JOIN inside y ON y.item_id = r.item_id AND y.start = r.start AND y.term = b GROUP BY ALL)
  GROUP BY item_id, a, b),
wanted AS (SELECT a, b, max(apart) + 5 AS reach FROM pairs GROUP BY a, b),
distances AS (
  SELECT x.doc_id, a, b, min(abs(x.pos - y.pos)) AS distance
  FROM wanted JOIN doc_terms x ON x.term = a JOIN doc_terms y ON y.term = b AND y.doc_id = x.doc_id
  WHERE abs(x.pos - y.pos) <= reach GROUP BY x.doc_id, a, b),
close_to AS (
  SELECT doc_id, count(*) AS n_near, string_agg(id, ',' ORDER BY id) AS near_ids FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id
    FROM distances JOIN pairs USING (a, b) WHERE distance <= apart + 5) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(near_ids, '')) AS near_sha256
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN close_to USING (doc_id)
"""

ORACLES["op13_merkle_manifest"] = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, text, 'h' AS tag,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
    || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
    || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head
  FROM documents),
crc_table AS (
  SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
  FROM range(256) AS r(n)),
crcs AS (
  SELECT doc_id, 0 AS pos, CAST(doc_id AS VARCHAR) AS id, 4294967295::BIGINT AS c
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, pos + 1, id, xor(crcs.c // 256, t.c)
  FROM crcs JOIN crc_table t ON t.n = xor(crcs.c % 256, ascii(id[pos + 1])) WHERE pos < length(id)),
touched AS (SELECT doc_id FROM crcs WHERE pos = length(id) AND xor(c, 4294967295) % 2 = 0),
l AS (
  SELECT doc_id, source,
    sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    sha256(head || CASE WHEN text IS NULL THEN '-' WHEN t.doc_id IS NULL THEN strlen(text) || ':' || text
      ELSE strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') END) AS shown
  FROM f LEFT JOIN touched t USING (doc_id)),
p AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY source) AS n FROM l),
tree AS (
  SELECT source, 0 AS level, place, leaf AS h, n FROM p
  UNION ALL
  SELECT source, level + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (any_value(n) + 2) // 3
  FROM tree WHERE n > 1 GROUP BY source, level, place // 3),
subroots AS (
  SELECT source, level AS depth, h AS subroot,
    row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place, count(*) OVER () AS n
  FROM tree WHERE n = 1),
crown AS (
  SELECT 0 AS level, place, subroot AS h, n FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (any_value(n) + 2) // 3
  FROM crown WHERE n > 1 GROUP BY level, place // 3),
nodes AS (
  SELECT s.place AS tree, level, t.place, h, t.n > 1 AS below FROM tree t JOIN subroots s ON s.source IS NOT DISTINCT FROM t.source
  UNION ALL SELECT -1, level, place, h, n > 1 FROM crown),
runs AS (
  SELECT tree, level, place // 3 AS run, list(h ORDER BY place) AS hs FROM nodes WHERE below
  GROUP BY tree, level, place // 3),
walk AS (
  SELECT p.doc_id, leaf, subroot, s.place AS home, s.place AS tree, 0 AS level, s.depth AS depth,
    p.place AS place, shown AS h, '' AS proof
  FROM p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source
  UNION ALL
  SELECT doc_id, leaf, subroot, home,
    CASE WHEN climbs THEN w.tree ELSE -1 END, CASE WHEN climbs THEN w.level + 1 ELSE 0 END, depth,
    CASE WHEN climbs THEN w.place // 3 ELSE home END,
    CASE WHEN climbs THEN sha256(array_to_string(
      list_concat(hs[:w.place % 3], [h], hs[w.place % 3 + 2:]), '')) ELSE h END,
    CASE WHEN climbs THEN proof || array_to_string(list_concat(hs[:w.place % 3], hs[w.place % 3 + 2:]), '')
      ELSE proof END
  FROM (SELECT *, tree = -1 OR level < depth AS climbs FROM walk) w
  LEFT JOIN runs r ON w.tree = r.tree AND w.level = r.level AND w.place // 3 = r.run
  WHERE NOT climbs OR hs IS NOT NULL)
SELECT doc_id, leaf, subroot, c.h AS root, sha256(proof) AS proof_sha256, w.h AS folded_root, w.h = c.h AS verified
FROM walk w JOIN (SELECT level, h FROM crown WHERE n = 1) c ON w.tree = -1 AND w.level = c.level
"""

ORACLES["op11_hard_negatives"] = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 10
"""
