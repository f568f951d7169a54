"""SQL of the queries that it can express, written from the contracts."""

from __future__ import annotations

ORACLE = {
    "op4_fm_index_substrings": r"""WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
placed AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM split),
ahead AS (
  SELECT doc_id, place, list(word) OVER (
    PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS next FROM placed),
windows AS (SELECT doc_id, place, array_to_string(next, ' ') AS text FROM ahead WHERE len(next) = 13),
firsts AS (SELECT text, min(doc_id) AS first_doc FROM windows GROUP BY text),
gone AS (
  SELECT DISTINCT doc_id, place + unnest(range(0, 13)) AS place
  FROM windows JOIN firsts USING (text) WHERE first_doc < doc_id),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text
  FROM placed ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)""",
    "op12_shared_sum_search": r"""WITH split AS (
  SELECT doc_id, row_number() OVER () AS place, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
corpus AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(terms)) AS BIGINT) AS terms FROM split WHERE len(terms) > 0),
lengths AS (
  SELECT place, 10 + (90 * CAST(len(split.terms) AS BIGINT) * docs) // corpus.terms AS m FROM split, corpus),
spread AS (SELECT doc_id, place, unnest(terms) AS term FROM split),
counted AS (
  SELECT doc_id, place, term, count(*) AS tf FROM spread
  WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, place, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM counted, corpus GROUP BY term),
summands AS (
  SELECT doc_id, place, term, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS part
  FROM counted JOIN weights USING (term) JOIN lengths USING (place)),
scored AS (
  SELECT item_id, doc_id, place, CAST(sum(part) AS BIGINT) AS score
  FROM wanted JOIN summands USING (term) GROUP BY item_id, doc_id, place HAVING sum(part) > 0),
ranked AS (
  SELECT item_id, doc_id, score,
    CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank FROM scored)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op11_screened_prefix_trie": r"""WITH crc_table AS (
  SELECT list(value ORDER BY byte) AS crcs FROM (
    SELECT byte, list_reduce([byte, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda crc, round: CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END) AS value
    FROM (SELECT CAST(range AS BIGINT) AS byte FROM range(256)))),
heads AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda crc, byte: xor(crc >> 8, crcs[(xor(crc, byte) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc_table),
said AS (
  SELECT conv_id, turn, strlen(coalesce(text, '')) AS size,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, size, digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place
  FROM said),
sizes AS (SELECT conv_id, max(place) AS turns FROM own GROUP BY conv_id),
rebuilt AS (
  SELECT heads.conv_id, place AS depth, size, digest FROM heads JOIN own ON own.conv_id = base AND place <= h
  UNION ALL
  SELECT own.conv_id, least(h, coalesce(turns, 0)) + place - h, size, digest
  FROM heads JOIN own ON own.conv_id = heads.conv_id AND place > h LEFT JOIN sizes ON sizes.conv_id = base),
listed AS (
  SELECT conv_id, depth, size, list(digest) OVER (PARTITION BY conv_id ORDER BY depth) AS digests FROM rebuilt),
paths AS (
  SELECT conv_id, depth, size, array_to_string(digests, ',') AS node, array_to_string(digests[:-2], ',') AS parent
  FROM listed
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM heads),
lasts AS (SELECT conv_id, max(depth) AS last FROM paths GROUP BY conv_id),
nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * any_value(size) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = last), '')) AS ends_sha256
  FROM paths JOIN lasts USING (conv_id) GROUP BY node),
families AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT DISTINCT tops.node, lower.node AS other
  FROM paths AS tops JOIN paths AS lower ON lower.conv_id = tops.conv_id AND lower.depth >= tops.depth),
subtrees AS (
  SELECT below.node, count(*) FILTER (families.node IS NULL) AS n_leaves, sum(saved) AS saved_tokens
  FROM below JOIN nodes ON nodes.node = other LEFT JOIN families ON families.node = other GROUP BY below.node)
SELECT nodes.conv_id, CAST(nodes.depth AS BIGINT) AS depth, above.conv_id AS parent_conv_id, nodes.n_convs,
  coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, nodes.ends_sha256
FROM nodes JOIN subtrees USING (node) LEFT JOIN families USING (node) LEFT JOIN nodes AS above ON above.node = nodes.parent""",
}
