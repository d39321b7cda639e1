"""SQL that must give the same rows as the registered queries, where SQL can express them."""

from __future__ import annotations

from larder.llm.decontaminate import UNITS

_UNITS = ", ".join(f"'{u}'" for u in sorted(UNITS))

#: Runs whose slots contradict each other are left out here; the operator cuts them, which matters for texts that mix versions. ``names``
#: is 0 (capitalised words are words), 1 (names inside a sentence) or 2 (names everywhere). A window that says too little counts if
#: equal windows, place by place, lead from it to one that does not.
LEAKS = rf"""
WITH source AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents WHERE text IS NOT NULL
  UNION SELECT 'i', item_id, text FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
),
tokens AS (SELECT kind, id, regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*|\pL+|[.!?:\n]') AS t FROM source),
kinds AS (
  SELECT *, list_transform(t, lambda x: CASE WHEN x[1] BETWEEN '0' AND '9' THEN 'n' WHEN x IN ('.', '!', '?', ':', chr(10)) THEN 'm'
    WHEN lower(x) IN ({_UNITS}) THEN 'u' WHEN upper(x[1]) = x[1] AND lower(x[1]) <> x[1] AND x <> upper(x) THEN 'c' ELSE 'l' END) AS k
  FROM tokens
),
spelled AS (SELECT k.*, names FROM kinds k, (VALUES (0), (1), (2)) v(names) WHERE kind = 'i' OR names > 0),
slots AS (
  SELECT kind, id, names, list_filter(list_transform(range(1, len(t) + 1), lambda i: {{'w': lower(t[i]), 's': CASE WHEN k[i] = 'n' THEN 'n'
    WHEN k[i] = 'm' THEN 'm' WHEN k[i] = 'u' AND i > 1 AND k[i - 1] = 'n' THEN 'u' WHEN names = 2 AND k[i] = 'c' OR names = 1 AND k[i] = 'c' AND i > 1 AND k[i - 1] <> 'm' THEN 'c'
    ELSE 'l' END}}), lambda x: x.s <> 'm') AS w FROM spelled
),
sizes AS (SELECT DISTINCT least(8, len(w)) AS size FROM slots WHERE kind = 'i' AND len(w) > 0),
windows AS (
  SELECT kind, id, names, len(w) AS n, size, p - 1 AS place, w[p:p + size - 1] AS part FROM (
    SELECT kind, id, names, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM slots, sizes
    WHERE len(w) >= size AND (kind = 'd' OR size = least(8, len(w)))
  )
),
told AS (
  SELECT *, len(list_filter(part, lambda x: x.s = 'l')) >= least(4, size) AS telling,
    list_transform(part, lambda x: CASE WHEN x.s = 'l' THEN x.w ELSE '<' || x.s || '>' END) AS template FROM windows
),
item_windows AS (
  SELECT id AS item_id, names, n AS item_words, size, place AS item_at, part AS item_part, template,
    telling OR NOT bool_or(telling) OVER (PARTITION BY id, names) AS kept FROM told t WHERE kind = 'i'
),
touched AS (
  SELECT DISTINCT d.id AS doc_id, d.names AS doc_names, i.item_id, i.names, d.place - i.item_at AS shift
  FROM told d JOIN item_windows i ON d.template = i.template AND d.size = i.size WHERE d.kind = 'd' AND i.kept
),
equal AS (
  SELECT t.*, i.item_words, i.size, i.item_at, i.item_part, d.part, i.kept,
    i.item_at - row_number() OVER (PARTITION BY t.doc_id, t.doc_names, t.item_id, t.names, t.shift ORDER BY i.item_at) AS stretch
  FROM touched t JOIN item_windows i ON i.item_id = t.item_id AND i.names = t.names
  JOIN told d ON d.kind = 'd' AND d.id = t.doc_id AND d.names = t.doc_names AND d.size = i.size AND d.place = i.item_at + t.shift AND d.template = i.template
),
met AS (
  SELECT doc_id, item_id, item_words, size, item_at, shift, item_part, part FROM (
    SELECT *, bool_or(kept) OVER (PARTITION BY doc_id, doc_names, item_id, names, shift, stretch) AS held FROM equal)
  WHERE held QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, shift, item_at
    ORDER BY kept DESC, len(list_filter(item_part, lambda x: x.s <> 'l')), len(array_to_string(list_transform(item_part, lambda x: x.w), ' '))) = 1
),
breaks AS (
  SELECT *, CASE WHEN item_at <= (lag(item_at) OVER w) + size THEN 0 ELSE 1 END AS b FROM met
  WINDOW w AS (PARTITION BY doc_id, item_id, shift ORDER BY item_at)
),
islands AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, item_id, shift ORDER BY item_at) AS island FROM breaks),
pairs AS (
  SELECT DISTINCT doc_id, item_id, shift, island, x.s AS s, x.w AS original, y.w AS found FROM (
    SELECT doc_id, item_id, shift, island, unnest(item_part) AS x, unnest(part) AS y FROM islands
  ) WHERE x.s <> 'l'
),
judged AS (
  SELECT doc_id, item_id, shift, island, count(*) = count(DISTINCT s || original) AND count(*) = count(DISTINCT s || found) AS consistent,
    count(*) FILTER (WHERE original <> found) AS changed FROM pairs GROUP BY doc_id, item_id, shift, island
),
found_runs AS (
  SELECT i.doc_id, i.item_id, any_value(item_words) AS item_words, max(i.item_at) + any_value(size) - min(i.item_at) AS matched_words,
    min(i.item_at) AS first_at, i.shift, coalesce(any_value(changed), 0) AS changed_slots
  FROM islands i LEFT JOIN judged j ON i.doc_id = j.doc_id AND i.item_id = j.item_id AND i.shift = j.shift AND i.island = j.island
  WHERE coalesce(consistent, true) GROUP BY i.doc_id, i.item_id, i.shift, i.island
)
SELECT doc_id, item_id, CAST(item_words AS INTEGER) AS item_words, CAST(matched_words AS INTEGER) AS matched_words,
  CAST(first_at AS INTEGER) AS item_at, CAST(first_at + shift AS INTEGER) AS doc_at, CAST(changed_slots AS INTEGER) AS changed_slots
FROM found_runs WHERE matched_words >= least(13, item_words)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched_words DESC, first_at, shift) = 1
"""

_BLOCK_TAGS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|"
    "main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul"
)


def _unescape(x: str) -> str:
    """The entities of the test pages; the operator decodes all that HTML knows."""
    for name, char in (("quot;?", '"'), ("copy;?", "©"), ("middot;?", "·"), ("amp;?", "&")):
        x = f"regexp_replace({x}, '&{name}', '{char}', 'g')"
    return x


def _sql_id(*parts: str) -> str:
    h = f"md5({' || chr(0) || '.join(parts)})"
    cuts = " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || {cuts} || '>'"


_NL = "chr(13) || chr(10)"
WARC = rf"""
WITH pages_in AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
cleaned AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?(?:-->|$)', '', 'g'),
    '(?si)<script\b[^>]*>.*?(?:</script\s*>|$)', '', 'g'), '(?si)<style\b[^>]*>.*?(?:</style\s*>|$)', '', 'g'),
    '(?si)<noscript\b[^>]*>.*?(?:</noscript\s*>|$)', '', 'g'), '(?si)<template\b[^>]*>.*?(?:</template\s*>|$)', '', 'g') AS shown,
    'sha256:' || sha256(html) AS payload_digest, CAST(octet_length(encode(html)) AS VARCHAR) AS size FROM pages_in
),
ids AS (
  SELECT *, {_sql_id("'response'", "coalesce(url, '')", "'1970-01-01T00:00:00Z'", "html")} AS response_id,
    'sha256:' || sha256('HTTP/1.1 200 OK' || {_NL} || 'Content-Type: text/html; charset=utf-8' || {_NL}
      || 'Content-Length: ' || size || {_NL} || {_NL} || html) AS response_digest FROM cleaned
),
parts AS (
  SELECT *, {_sql_id("'conversion'", "response_id")} AS conversion_id, {_sql_id("'metadata'", "response_id")} AS metadata_id,
    regexp_replace(regexp_replace(shown, '(?i)</?(?:{_BLOCK_TAGS})\b[^>]*(?:>|$)', chr(10), 'g'), '</?[a-zA-Z!?][^>]*(?:>|$)', '', 'g') AS flat,
    regexp_extract(shown, '(?si)<title\b[^>]*>(.*?)(?:</title\s*>|$)', 1) AS title,
    lower(regexp_extract(shown, '(?i)<html\b[^>]*?\blang\s*=\s*["'']?([A-Za-z0-9-]+)', 1)) AS lang,
    regexp_extract_all(shown, '(?i)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1) AS links FROM ids
),
texts AS (
  SELECT *, trim(regexp_replace(regexp_replace({_unescape("flat")}, '[ \t\r\f\x0b\x{{a0}}]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS text,
    concat('source-content-type: text/html; charset=utf-8', {_NL}, 'source-content-length: ', size, {_NL},
      'source-payload-digest: ', payload_digest, {_NL}, 'source-block-digest: ', response_digest, {_NL}, 'conversion: ', conversion_id, {_NL},
      CASE WHEN regexp_matches(shown, '(?i)<title\b[^>]*>') THEN 'title: ' || trim(regexp_replace({_unescape("title")}, '\s+', ' ', 'g')) || {_NL} ELSE '' END,
      CASE WHEN lang <> '' THEN 'language: ' || lang || {_NL} ELSE '' END,
      coalesce(array_to_string(list_transform(links, lambda x: 'outlink: ' || {_unescape("x")} || {_NL}), ''), '')) AS fields
  FROM parts
),
records AS (
  SELECT page_id, 'metadata' AS record_type, metadata_id AS record_id, response_id AS refers_to, conversion_id AS concurrent_to,
    url AS target_uri, 'application/warc-fields' AS content_type, payload_digest, fields AS block FROM texts
  UNION ALL
  SELECT page_id, 'conversion', conversion_id, response_id, metadata_id, url, 'text/plain; charset=utf-8', payload_digest, text FROM texts
)
SELECT page_id, record_type, record_id, refers_to, concurrent_to, target_uri, '1970-01-01T00:00:00Z' AS date, content_type,
  octet_length(encode(block)) AS content_length, 'sha256:' || sha256(block) AS block_digest, payload_digest AS source_payload_digest, block
FROM records
"""

_SETS = r"""
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words
)"""

COMPONENTS = f"""
WITH RECURSIVE {_SETS},
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM sets s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.s)
"""

FINGERPRINTS = r"""
WITH placed AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC) - 1 AS n FROM documents),
paired AS (
  SELECT a.doc_id, a.n, b.n AS next_n, a.text, length(a.text) AS n_chars,
    left(a.text, CAST(length(a.text) - length(a.text) // 2 AS BIGINT)) || left(b.text, CAST(length(a.text) // 2 AS BIGINT)) AS edited
  FROM placed a JOIN placed b ON b.n = (a.n + 1) % (SELECT count(*) FROM placed)
),
texts AS (SELECT n, 0 AS edit, text FROM paired UNION ALL SELECT n, 1, edited FROM paired),
words AS (SELECT n, edit, unnest(string_split_regex(lower(text), '[ \t\n\v\f\r]+')) AS term FROM texts),
weights AS (
  SELECT n, edit, term, ln(CAST(count(*) AS DOUBLE)) AS l, md5(term) AS d FROM words WHERE term <> '' GROUP BY n, edit, term
),
halves AS (
  SELECT n, edit, l, CAST('0x' || substr(d, 1, 15) AS BIGINT) AS h0, CAST('0x' || substr(d, 17, 15) AS BIGINT) AS h1 FROM weights
),
seeds AS (SELECT n, edit, l, [h0 & 1073741823, h0 >> 30, h1 & 1073741823, h1 >> 30] AS p FROM halves),
raw AS (
  SELECT n, edit, l, p[1] AS p0, k, [(p[1] + (5 * k + 1) * p[2]) & 4294967295, (p[2] + (5 * k + 2) * p[3]) & 4294967295,
    (p[3] + (5 * k + 3) * p[4]) & 4294967295, (p[4] + (5 * k + 4) * p[1]) & 4294967295, (p[1] + (5 * k + 5) * p[3]) & 4294967295] AS x
  FROM seeds, range(24) AS s(k)
),
once AS (SELECT * REPLACE (list_transform(x, lambda v: (xor(v, v >> 16) * 99338859) & 4294967295) AS x) FROM raw),
twice AS (SELECT * REPLACE (list_transform(x, lambda v: (xor(v, v >> 13) * 1119006261) & 4294967295) AS x) FROM once),
uniform AS (SELECT n, edit, l, p0, k, list_transform(x, lambda v: (xor(v, v >> 16) + 0.5::DOUBLE) / 4294967296) AS u FROM twice),
drawn AS (
  SELECT n, edit, l, p0, k, -ln(u[1] * u[2]) AS r, ln(-ln(u[3] * u[4])) AS c, u[5] AS b FROM uniform
),
stepped AS (SELECT *, CAST(floor(l / r + b) AS BIGINT) AS t FROM drawn),
least_a AS (
  SELECT n, edit, k, min(CAST(floor((c - r * (t - b) - r + 96) * 8388608) AS BIGINT) * 4294967296
    + ((p0 + (t & 1048575) * 506952113) & 4294967295)) & 4294967295 AS sample
  FROM stepped GROUP BY n, edit, k
),
marks AS (SELECT n, edit, string_agg(printf('%08x', sample), '' ORDER BY k) AS f, list(sample ORDER BY k) AS s FROM least_a GROUP BY n, edit),
near AS (
  SELECT p.doc_id, p.n_chars, p.edited, a.f AS f0, e.f AS f1, a.s AS s0, e.s AS s1, b.s AS s2
  FROM paired p LEFT JOIN marks a ON a.n = p.n AND a.edit = 0 LEFT JOIN marks e ON e.n = p.n AND e.edit = 1
  LEFT JOIN marks b ON b.n = p.next_n AND b.edit = 0
)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, coalesce(f0, '-') AS fingerprint, coalesce(f1, '-') AS edited_fingerprint,
  CASE WHEN s0 IS NULL AND s1 IS NULL THEN 1.0 WHEN s0 IS NULL OR s1 IS NULL THEN 0.0
    ELSE len(list_filter(list_zip(s0, s1), lambda z: z[1] = z[2])) / 24.0 END::DOUBLE AS near_edited,
  CASE WHEN s0 IS NULL AND s2 IS NULL THEN 1.0 WHEN s0 IS NULL OR s2 IS NULL THEN 0.0
    ELSE len(list_filter(list_zip(s0, s2), lambda z: z[1] = z[2])) / 24.0 END::DOUBLE AS near_next
FROM near
"""

NEGATIVES = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
    other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 3
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN counted USING (vec_id)
"""
