"""The same results as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from stratafold.llm.licenses import PHRASES, TEMPLATES

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
), r AS (
  SELECT html, max(page_id) AS response_id FROM p WHERE n >= 1000 GROUP BY html
)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN r.response_id IS NULL OR r.response_id IS NOT DISTINCT FROM p.page_id
    THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN r.response_id IS NOT NULL AND r.response_id IS DISTINCT FROM p.page_id
    THEN r.response_id END AS refers_to
FROM p LEFT JOIN r ON p.html = r.html
"""


QUALITY = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT r, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 9)
), again AS (
  SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), covered AS (
  SELECT r, sum(least(8, coalesce(lead_i - i, 8))) AS n FROM (
    SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS lead_i FROM again) GROUP BY r
), dup AS (
  SELECT r, sum(n - 1) AS n FROM (
    SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r
), base AS (
  SELECT d.r, doc_id, source, t, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dup ON d.r = dup.r LEFT JOIN covered ON d.r = covered.r
), norm AS (
  SELECT r, source, list_filter(list_transform(string_split(regexp_replace(regexp_replace(lower(t), '[0-9]+', '0', 'g'),
    '[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls FROM base
), kinds AS (
  SELECT row_number() OVER () AS k, source, own FROM (
    SELECT DISTINCT source, list_sort(list_distinct(ls)) AS own FROM norm WHERE len(ls) > 0)
), line AS (
  SELECT k, source, n_lines, h, length(h) - length(replace(h, ' ', '')) + 1 AS w
  FROM (SELECT k, source, len(own) AS n_lines, unnest(own) AS h FROM kinds)
), host AS (
  SELECT source, least(0.02 * count(*), 500) AS least_n FROM kinds GROUP BY source
), common AS (
  SELECT c.source, c.h, host.least_n FROM (SELECT source, h, count(*) AS n FROM line GROUP BY source, h) c
  JOIN host ON c.source IS NOT DISTINCT FROM host.source WHERE c.n >= 10 AND c.n >= host.least_n
), held AS (
  SELECT line.k, line.source, line.h, line.w, line.n_lines, common.least_n,
    sum(line.w) OVER (PARTITION BY line.k) AS words, count(*) OVER (PARTITION BY line.k) AS lines
  FROM line JOIN common ON line.source IS NOT DISTINCT FROM common.source AND line.h = common.h
), whole AS (
  SELECT k, sum(w) AS n FROM line GROUP BY k
), tmpl AS (
  SELECT source, h FROM held JOIN whole ON held.k = whole.k WHERE lines <= 0.5 * n_lines OR words <= 0.5 * whole.n
  GROUP BY source, h, least_n HAVING count(*) >= 10 AND count(*) >= least_n
), gone AS (
  SELECT r, sum(length(l.h) - length(replace(l.h, ' ', '')) + 1)::BIGINT AS n_template_words
  FROM (SELECT r, source, unnest(ls) AS h FROM norm) l JOIN tmpl ON l.source IS NOT DISTINCT FROM tmpl.source AND l.h = tmpl.h GROUP BY r
), judged AS (
  SELECT base.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    coalesce(n_template_words, 0)::BIGINT AS n_template_words FROM base LEFT JOIN gone ON base.r = gone.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - n_template_words >= 0.3 * n_words AS kept, n_template_words FROM judged
"""


CONTAMINATION = r"""
WITH up AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), item AS (
  SELECT item_id, ws, least(len(ws), 13) AS k FROM (SELECT item_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark) WHERE len(ws) > 0
), gram AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g
  FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM item)
), win AS (
  SELECT r, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g
  FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM up, (SELECT DISTINCT k FROM gram) WHERE len(ws) >= k)
), met AS (
  SELECT r, win.k, i, item_id FROM win JOIN gram ON win.g = gram.g AND win.k = gram.k
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM met) GROUP BY r
), named AS (
  SELECT r, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM met GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM up LEFT JOIN hit ON up.r = hit.r LEFT JOIN named ON up.r = named.r
"""


LICENSES = r"""
WITH t AS (SELECT row_number() OVER () AS n, * FROM (VALUES {templates}) v(label, own)),
tpl AS (
  SELECT n, label, list_distinct(string_split(own, ' ')) AS own, ceil(len(string_split(own, ' ')) / 0.8) AS run FROM t
),
phrase AS (SELECT * FROM (VALUES {phrases}) v(label, g)),
d AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM d
), base AS (
  SELECT r, label, i FROM (
    SELECT r, ws, label, g, len(string_split(g, ' ')) AS k, unnest(range(1, len(ws) - len(string_split(g, ' ')) + 2)) AS i
    FROM w, phrase WHERE contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || g || ' '))
  WHERE array_to_string(list_slice(ws, i, i + k - 1), ' ') = g
), b AS (
  SELECT r, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM base GROUP BY r
), block AS (
  SELECT r, list_distinct(list_filter(string_split_regex(line, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS held
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
), hit AS (
  SELECT r, n, label, len(own) AS size, run, i, x FROM (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w)
  JOIN (SELECT *, unnest(own) AS x FROM tpl) USING (x)
), enough AS (
  SELECT r, n FROM hit GROUP BY r, n, size HAVING count(DISTINCT x) >= 0.8 * size
), met AS (
  SELECT hit.* FROM hit JOIN enough USING (r, n)
), near AS (
  SELECT r, label, len(list_intersect(own, held)) / len(own) AS c FROM block, tpl
  WHERE len(list_intersect(own, held)) >= 0.8 * len(own)
  UNION ALL
  SELECT a.r, a.label, count(DISTINCT b.x) / a.size FROM met a JOIN met b ON a.r = b.r AND a.n = b.n AND b.i >= a.i AND b.i < a.i + a.run
  GROUP BY a.r, a.n, a.label, a.size, a.i HAVING count(DISTINCT b.x) >= 0.8 * a.size
), m AS (
  SELECT r, max(c) AS c FROM near GROUP BY r
), every AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM (
    SELECT r, label FROM near UNION ALL SELECT r, label FROM base) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.a::BIGINT AS first_word,
  b.z::BIGINT AS last_word, coalesce(b.ls, '') AS base_labels, coalesce(every.ls, '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(m.c, 0)::DOUBLE END AS score
FROM w LEFT JOIN b ON w.r = b.r LEFT JOIN m ON w.r = m.r LEFT JOIN every ON w.r = every.r
"""


def _licenses() -> str:
    listed = lambda pairs: ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    phrases = listed((label, phrase) for phrase, label in PHRASES)
    return LICENSES.replace("{templates}", listed(TEMPLATES)).replace("{phrases}", phrases)


def oracle() -> dict[str, str]:
    return {"op4_line_quality": QUALITY, "op5_warc": WARC, "op6_decontaminate": CONTAMINATION, "op9_licenses": _licenses()}
