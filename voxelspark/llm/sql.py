"""SQL that gives the rows of the queries that SQL can express."""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS digest FROM p),
g AS (SELECT digest, max(page_id) AS first FROM d WHERE n >= 1000 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN g USING (digest)
"""

LINE_FREQUENCY = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
hit AS (SELECT doc_id, i + k AS pos FROM win JOIN twice USING (doc_id, g), range(0, 5) r(k)),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM hit GROUP BY doc_id),
lines AS (
  SELECT DISTINCT host, t, l FROM (
    SELECT host, t, trim(unnest(string_split(regexp_replace(lower(t), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)))) AS l FROM d)
  WHERE l <> ''),
total AS (SELECT host, count(DISTINCT t) AS n_all FROM lines GROUP BY host),
freq AS (
  SELECT host, l FROM (SELECT host, l, count(*) AS c FROM lines GROUP BY host, l) JOIN total USING (host)
  WHERE c > least(10, greatest(3, n_all * 0.1))),
lost AS (
  SELECT host, t, sum(len(string_split(lines.l, ' '))) AS line_words,
    sum(CASE WHEN freq.l IS NULL THEN 0 ELSE len(string_split(lines.l, ' ')) END) AS gone
  FROM lines LEFT JOIN freq USING (host, l) GROUP BY host, t),
base AS (
  SELECT doc_id, host, t, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
judged AS (
  SELECT base.*, coalesce(gone, 0) AS gone, line_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS failed
  FROM base LEFT JOIN lost USING (host, t))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failed AS base_failed,
  NOT failed AND NOT (gone > 0 AND (line_words - gone < 10 OR line_words - gone < 0.3 * line_words)) AS kept,
  CAST(gone AS BIGINT) AS n_frequent_words
FROM judged
"""

DECONTAMINATION = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM low),
lowb AS (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
b AS (SELECT item_id, regexp_extract_all(t, '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM lowb),
item AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
gram AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM item)),
size AS (SELECT DISTINCT k FROM gram),
win AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, size WHERE len(w) >= k)),
hit AS (SELECT doc_id, k, i, item_id FROM win JOIN gram USING (g, k)),
span AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, range(0, 10) r(j) WHERE j < k GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN span USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

FILTER_AUDIT = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
first AS (SELECT t, min(doc_id) AS f FROM d GROUP BY t),
label AS (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY doc_id),
m AS (
  SELECT part,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > f THEN 'E' ELSE '' END AS fails,
    CASE WHEN q = 1 THEN 1 ELSE 0 END AS good, CASE WHEN x = 1 THEN 1 ELSE 0 END AS toxic
  FROM d JOIN first USING (t) LEFT JOIN label ON label.doc_id = d.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS n_good, sum(toxic) AS n_toxic FROM m GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, left(filter_order, step - 1) AS earlier FROM o, range(1, 6) r(step)),
z AS (
  SELECT part, n, n_good, n_toxic, filter_order, step, f, contains(fails, f) AS failing, fails = f AS alone,
    earlier <> '' AND translate(fails, earlier, '') <> fails AS before
  FROM c, s),
g AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, any_value(f) AS f,
    sum(CASE WHEN NOT failing AND NOT before THEN n ELSE 0 END) AS kept, sum(CASE WHEN failing AND NOT before THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failing AND before THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failing AND NOT before THEN n_good ELSE 0 END) AS good_lost, sum(CASE WHEN failing AND NOT before THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM z GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM g
"""

_ASSIGN = """
d{n} AS (
  SELECT vec_id, part, min({{'d': list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))), 'e': e}}) AS best
  FROM parts JOIN book{n} USING (part) GROUP BY vec_id, part)"""
_MOVE = """
m{n} AS (
  SELECT part, best.e AS e, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS v
  FROM d{n} JOIN parts USING (vec_id, part), range(1, len(x) + 1) r(i) GROUP BY ALL),
l{n} AS (SELECT part, e, list(v ORDER BY i) AS c FROM m{n} GROUP BY ALL),
book{next} AS (SELECT part, e, coalesce(l{n}.c, book{n}.c) AS c FROM book{n} LEFT JOIN l{n} USING (part, e))"""
PRODUCT_CODES = (
    """
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, part, q[part * len(q) // 16 + 1:(part + 1) * len(q) // 16] AS x FROM v, range(0, 16) r(part)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT 64),
book0 AS (SELECT part, e, x AS c FROM first JOIN parts USING (vec_id)),"""
    + ",".join(_ASSIGN.format(n=n) + "," + _MOVE.format(n=n, next=n + 1) for n in (0, 1))
    + ","
    + _ASSIGN.format(n=2)
    + """,
coded AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM d2 GROUP BY vec_id),
flat AS (SELECT part, e, i, c[i] AS v FROM book2, range(1, len(c) + 1) r(i)),
sha AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, e, i)) AS s FROM flat)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256
FROM coded JOIN v USING (vec_id), sha
"""
)
