"""SQL (DuckDB) that states the results of this subpackage's queries independently."""

from rillway.llm.contamination import AGREE_PERCENT, MASKS, STRETCH
from rillway.llm.near_duplicates import PERCENT, SHINGLE
from rillway.llm.repeated_bytes import LENGTH
from rillway.llm.repeated_passages import WINDOW

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

REPEATED_BYTES = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, len(h) // 2 AS n_bytes FROM d),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, {2 * LENGTH}) AS x FROM (SELECT doc_id, h, unnest(range(n_bytes - {LENGTH - 1})) AS s FROM n)),
f AS (SELECT x, min({{'d': doc_id, 's': s}}) AS first FROM w GROUP BY x HAVING count(*) > 1),
hit AS (SELECT doc_id, s FROM w JOIN f USING (x) WHERE doc_id <> first.d OR s <> first.s),
g AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM (
  SELECT doc_id, s, (coalesce(s - lag(s) OVER (PARTITION BY doc_id ORDER BY s), {LENGTH + 1}) > {LENGTH})::INT AS fresh FROM hit)),
gone AS (SELECT doc_id, min(s) AS low, max(s) + {LENGTH} AS high FROM g GROUP BY doc_id, span),
edge AS (SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS since FROM gone),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (low - since)), '' ORDER BY low) AS front, max(high) AS last, sum(high - low) AS n_removed, count(*) AS n_spans
  FROM edge JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN kept USING (doc_id)
"""

REPEATED_PASSAGES = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
s AS (SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + {WINDOW}], ' ') AS x FROM (SELECT doc_id, w, unnest(range(len(w) - {WINDOW - 1})) AS pos FROM d)),
f AS (SELECT x, min(doc_id) AS low FROM s GROUP BY x),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {WINDOW})) AS place FROM s JOIN f USING (x) WHERE low < doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS left_over
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM d) ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(f"translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(len(w) - {SHINGLE - 1}), lambda i: array_to_string(w[i + 1 : i + {SHINGLE}], ' '))) END AS g FROM d),
r AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, reach.root FROM reach JOIN e ON reach.node = e.a),
c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(g)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM s LEFT JOIN c ON node = doc_id
"""

_PLAIN = r"list_filter(string_split(trim(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> '')"


def _seed_sql(rows: str, key: str) -> str:
    masks = " UNION ALL ".join(
        f"SELECT {key}, w, p, {n} AS mask, array_to_string([{', '.join(f'w[p + {i + 1}]' for i, bit in enumerate(mask) if bit == '1')}], ' ') AS seed FROM {rows}_at"
        for n, mask in enumerate(MASKS)
    )
    return f"{rows}_at AS (SELECT {key}, w, unnest(range(len(w) - {len(MASKS[0]) - 1})) AS p FROM {rows}), {rows}_seed AS ({masks})"


# For items of as many words as a mask has, or more; the tables have no shorter ones.
CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_PLAIN.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_PLAIN.format("text")} AS w FROM benchmark),
{_seed_sql("d", "doc_id")}, {_seed_sql("b", "item_id")},
hit AS (SELECT DISTINCT d_seed.doc_id, b_seed.item_id, d_seed.p - b_seed.p AS begins FROM d_seed JOIN b_seed USING (mask, seed)),
o AS (SELECT doc_id, item_id, begins, len(b.w) AS item_words, list_transform(range(greatest(begins, 0), least(begins + len(b.w), len(d.w))),
    lambda p: (d.w[p + 1] = b.w[p - begins + 1])::INT) AS same
  FROM hit JOIN d USING (doc_id) JOIN b USING (item_id)),
good AS (SELECT *, list_sum(same) AS n_matched FROM o WHERE len(list_filter(range(len(same) - least(item_words, {STRETCH}) + 1),
    lambda i: 100 * list_sum(same[i + 1 : i + least(item_words, {STRETCH})]) >= {AGREE_PERCENT} * least(item_words, {STRETCH}))) > 0)
SELECT doc_id, item_id, arg_max(begins, {{'m': n_matched, 'b': -begins}})::INTEGER AS place, max(n_matched)::INTEGER AS n_matched, any_value(item_words)::INTEGER AS item_words
FROM good GROUP BY doc_id, item_id
"""

# Base 32 of a SHA-1: 8 groups of 5 hexadecimal digits, each 4 letters.
_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31), 1)), '')"""

ARCHIVES = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS newest FROM p)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> newest THEN newest END AS refers_to, true AS intact
FROM r
"""
