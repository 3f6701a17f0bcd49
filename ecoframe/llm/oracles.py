"""DuckDB SQL for the queries of this subpackage that SQL can express, written from their contracts."""

from __future__ import annotations

_WORDS = r"[w for w in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if w <> '']"
_DOCS = f"d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents)"
_WORD_ROWS = "pos AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d)"

OP3 = rf"""
WITH {_DOCS},
s AS (
  SELECT doc_id, source, len(w) AS size,
    greatest(length(regexp_replace(text, '[^A-Za-zÀ-ɏ]', '', 'g'))::DOUBLE / greatest(length(text), 1), 0.1::DOUBLE) AS quality,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM d),
totals AS (
  SELECT source, sum(size)::DOUBLE AS total,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::DOUBLE AS weight
  FROM s GROUP BY source),
levels AS (
  SELECT *, (sum(total) OVER () * 1.5::DOUBLE - 2 * coalesce(sum(total) OVER before, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM totals WINDOW before AS (ORDER BY total / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
common AS (SELECT min_by(level, total / weight) AS level FROM levels WHERE 2 * total > weight * level),
plan AS (
  SELECT source, total, CASE WHEN 2 * total <= weight * levels.level THEN 2 * total ELSE weight * common.level END AS target
  FROM levels LEFT JOIN common ON true),
summed AS (
  SELECT s.*, total, target, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY s.source ORDER BY -ln(u) / quality, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM s JOIN plan ON s.source IS NOT DISTINCT FROM plan.source),
cut AS (SELECT *, target - epochs * total AS rest FROM summed)
SELECT doc_id, size, total::BIGINT AS source_size, target,
  (size * (epochs + CASE WHEN upto <= rest OR (upto - size < rest AND abs(upto - rest) <= abs(upto - size - rest)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM cut"""


def _tree(levels: int = 7) -> str:
    """One level of the tree after the other, from counted forms to templates."""
    out = ["t0 AS (SELECT *, '' AS node FROM counted)"]
    for k in range(levels):
        out.append(f"""
s{k} AS (
  SELECT *, form[{k + 1}] AS part, sum(n) OVER (PARTITION BY host, node, form[{k + 1}]) AS pages,
    sum(CASE WHEN form[{k + 1}] IS NOT NULL THEN n END) OVER (PARTITION BY host, node) AS total,
    count(DISTINCT form[{k + 1}]) OVER (PARTITION BY host, node) AS children
  FROM t{k}),
t{k + 1} AS (
  SELECT host, form, n, labelled, bad,
    CASE WHEN part IS NULL THEN node ELSE node || '/' || CASE WHEN children > 32 AND pages < total * 0.02::DOUBLE THEN '*' ELSE part END END AS node
  FROM s{k})""")
    return ",".join(out)


def _down(levels: int = 8) -> str:
    """Rates from the host down: each labelled node's, smoothed towards the one above."""
    return ",".join(f"""
p{k + 1} AS (
  SELECT p{k}.* EXCLUDE (p), CASE WHEN a.l IS NULL THEN p ELSE (a.b + p * 8) / (a.l + 8) END AS p
  FROM p{k} LEFT JOIN above a ON p{k}.host = a.host AND p{k}.template = a.template AND a.level = {k})""" for k in range(levels))


def _fits(domain: str, path: str) -> str:
    return f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{path}')"


OP4 = rf"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM h),
ruled AS (
  SELECT *, CASE WHEN {_fits('www.example.com', '/en/')} THEN 'www.example.com/en/' WHEN {_fits('example.com', '/en/')} THEN 'example.com/en/'
      WHEN {_fits('net', '/es/')} THEN 'net/es/' WHEN {_fits('net', '/fr/')} THEN 'net/fr/' WHEN {_fits('com', '/')} THEN 'com/' END AS rule,
    [CASE WHEN regexp_full_match(s, '[0-9]+') THEN '<n>'
       WHEN regexp_full_match(s, '[0-9]+\.[A-Za-z]+') THEN '<n>.' || regexp_extract(s, '[^.]*$')
       WHEN regexp_full_match(s, '[0-9a-fA-F-]{{8,}}') AND regexp_matches(s, '[0-9]') THEN '<id>'
       WHEN regexp_matches(s, '[0-9]') THEN '<v>' ELSE s END for s in string_split(path, '/') if s <> ''] AS shaped
  FROM p),
seen AS (
  SELECT page_id, host, path, rule, shaped AS form,
    CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS told
  FROM ruled),
counted AS (
  SELECT host, form, count(*) AS n, count(told) AS labelled, count(*) FILTER (told = 'block') AS bad FROM seen GROUP BY host, form),
{_tree()},
whole AS (SELECT host, form, labelled, bad, node || list_aggregate(list_transform(form[8:], lambda s: '/' || s), 'string_agg', '') AS longer, node FROM t7),
named AS (SELECT host, form, labelled, bad, coalesce(longer, node) AS template FROM whole),
leaves AS (
  SELECT host, template, sum(labelled)::DOUBLE AS labelled, sum(bad)::DOUBLE AS bad, string_split(template, '/') AS seg,
    regexp_replace(template, '^((?:/(?:<[^/]*|\*))*)/[^/<*][^/]*', '\1/+') AS branch, regexp_extract(host, '[^.]*\.?[^.]*$') AS domain
  FROM named GROUP BY host, template),
prior AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(bad) / sum(labelled) ELSE 0 END AS prior FROM leaves),
pools AS (SELECT host, branch, sum(bad) AS pool_bad, sum(labelled) AS pool_labelled FROM leaves WHERE labelled >= 20 GROUP BY ALL),
steps AS (SELECT *, unnest(range(least(7, len(seg) - 1) + 1)) AS level FROM leaves),
nodes AS (
  SELECT host, level, array_to_string(seg[1:level + 1], '/') AS prefix, sum(bad) AS b, sum(labelled) AS l
  FROM steps WHERE labelled > 0 GROUP BY ALL),
domains AS (
  SELECT regexp_extract(host, '[^.]*\.?[^.]*$') AS domain, (sum(b) / count(*) + any_value(prior) * 8) / (sum(l) / count(*) + 8) AS base
  FROM nodes, prior WHERE level = 0 GROUP BY ALL),
above AS (
  SELECT s.host, s.template, s.level, n.b, n.l FROM steps s
  JOIN nodes n ON s.host = n.host AND s.level = n.level AND array_to_string(s.seg[1:s.level + 1], '/') = n.prefix
  WHERE s.level <= greatest(len(s.seg) - 2, 0)),
p0 AS (SELECT leaves.*, coalesce(base, prior) AS p FROM leaves CROSS JOIN prior LEFT JOIN domains ON leaves.domain = domains.domain),
{_down()},
tested AS (
  SELECT p8.*, pool_bad, pool_labelled, labelled >= 20 AND abs(bad / greatest(labelled, 1) - pool_bad / pool_labelled)
    <= 2 * sqrt(pool_bad / pool_labelled * (1 - pool_bad / pool_labelled) / greatest(labelled, 1)) + 1e-9 AS alike
  FROM p8 LEFT JOIN pools ON p8.host = pools.host AND p8.branch = pools.branch),
pure AS (
  SELECT host, template, (CASE WHEN alike THEN pool_bad ELSE bad END + p * 8) / (CASE WHEN alike THEN pool_labelled ELSE labelled END + 8) AS purity
  FROM tested),
worse AS (SELECT host FROM leaves WHERE host <> '' GROUP BY host HAVING sum(bad) > 0)
SELECT page_id, seen.host, path, rule,
  coalesce(told, CASE WHEN purity >= 0.9 AND seen.host IN (SELECT host FROM worse) THEN 'block' ELSE 'allow' END) AS verdict
FROM seen LEFT JOIN named ON seen.host = named.host AND seen.form = named.form
LEFT JOIN pure ON named.host = pure.host AND named.template = pure.template"""

OP5 = rf"""
WITH {_DOCS}, {_WORD_ROWS},
windows AS (
  SELECT *, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) AS h FROM pos),
later AS (SELECT *, i <= n - 19 AND row_number() OVER (PARTITION BY i <= n - 19, h ORDER BY doc_id, i) > 1 AS again FROM windows),
gone AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM later),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""

OP6 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1, 1)
    for k in range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""

OP7 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
chunks AS (SELECT doc_id, c, substr(h, 2 * c + 1, 2198) AS p FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 99, 0), 1000)) AS c FROM d)),
windows AS (
  SELECT doc_id, c + j AS i, md5(substr(p, 2 * j + 1, 200)) AS k
  FROM (SELECT doc_id, c, p, unnest(range(0, least(1000, length(p) // 2 - 99))) AS j FROM chunks)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
edges AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS edge FROM later),
runs AS (SELECT *, sum(edge) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM edges),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

#: kind, pattern, group that has a least length, that length. Runs of one class are searched at their least length.
_SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("forge_token", r"(?:ghp_|gho_|ghs_|glpat-)[A-Za-z0-9_-]+", 0, 24),
    ("chat_token", r"(?:xoxb-|xoxp-|xoxa-)[A-Za-z0-9-]+", 0, 20),
    ("payment_key", r"(?:sk_live_|rk_live_)[A-Za-z0-9]+", 0, 24),
    ("signed_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ("bearer", r"(?i:bearer)\x20+[A-Za-z0-9+/_.=-]+", 0, 27),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    ("url_login", r"[A-Za-z]+://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@", 0, 9),
)


def _hits(rank: int) -> str:
    kind, pattern, group, least = _SECRETS[rank]
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, {least} AS least, [length(x) for x in string_split_regex(text, {quoted})] AS gap,
  [length(x) for x in regexp_extract_all(text, {quoted})] AS whole, [length(x) for x in regexp_extract_all(text, {quoted}, {group})] AS part FROM d"""


OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({" UNION ALL ".join(map(_hits, range(len(_SECRETS))))}),
flat AS (SELECT doc_id, rank, kind, least, generate_subscripts(gap, 1) AS i, unnest(gap) AS g, unnest(whole) AS w, unnest(part) AS p FROM hits),
ends AS (SELECT *, sum(g + coalesce(w, 0)) OVER (PARTITION BY doc_id, rank ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM flat),
spans AS (SELECT doc_id, rank, stop - w AS start, kind || ':' || (stop - w) || ':' || stop AS span FROM ends WHERE p >= least),
found AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (doc_id)"""

OP10 = rf"""
WITH {_DOCS}, {_WORD_ROWS},
windows AS (
  SELECT doc_id, i, n, [word, lead(word, 1) OVER (PARTITION BY doc_id ORDER BY i), lead(word, 2) OVER (PARTITION BY doc_id ORDER BY i)] AS g
  FROM pos),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows WHERE i <= n - 2) WHERE c > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
lines AS (SELECT *, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS x FROM d),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(x) AS n_lines, len(x) - len(list_distinct(x)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
    len([v for v in w if length(v) >= 2 and regexp_matches(v, '\p{{Lu}}') and not regexp_matches(v, '\p{{Ll}}')]) AS n_shouted,
    length(regexp_replace(text, '\P{{L}}', '', 'g')) AS n_letters
  FROM lines LEFT JOIN repeats USING (doc_id)),
f AS (
  SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
    + 8 * (n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines)::INT + 16 * (10 * n_shouted > 5 * n_words)::INT
    + 32 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT + 64 * (10 * n_letters < 6 * word_chars)::INT)::BIGINT AS failures
  FROM m)
SELECT *, failures & 3 <> 0 AS base_failed, failures = 0 AS kept FROM f"""

_CRC_BIT = "CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
OP11 = rf"""
WITH t AS (
  SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
    len([w for w in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if w <> '']) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) AS i FROM t),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
    [4294967295::BIGINT] || list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda k: ascii(substr(conv_id::VARCHAR, k, 1))::BIGINT),
    lambda crc, byte: list_reduce([xor(crc, byte)] || range(8), lambda a, b: {_CRC_BIT}))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, i, m, words FROM c JOIN ranked ON ranked.conv_id = base AND i <= h
  UNION ALL SELECT conv_id, 1, i, m, words FROM ranked JOIN c USING (conv_id) WHERE i > h),
paths AS (
  SELECT conv_id, row_number() OVER o AS depth, words, string_agg(m, '') OVER o AS path
  FROM rebuilt WINDOW o AS (PARTITION BY conv_id ORDER BY part, i ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
lengths AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
nodes AS (
  SELECT path, p.depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
    sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (l.depth = p.depth), '')) AS ends_sha256
  FROM paths p JOIN lengths l ON l.conv_id = p.conv_id GROUP BY path, p.depth),
children AS (SELECT left(path, 32 * (depth - 1)::BIGINT) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
sums AS (
  SELECT left(path, 32 * above) AS path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT n.path, saved, (n_children IS NULL)::INT AS leaf, unnest(range(n.depth + 1)) AS above
    FROM nodes n LEFT JOIN children USING (path)) GROUP BY 1)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
  coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (path) LEFT JOIN children USING (path)
  LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, 32 * (n.depth - 1)::BIGINT)"""

OP12 = rf"""
WITH {_DOCS},
masks AS (
  SELECT doc_id, coalesce(source, '') AS part,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(coalesce(doc_id, 9223372036854775807) > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM d),
says AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
rows AS (SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM masks LEFT JOIN says USING (doc_id)),
five AS (SELECT unnest([1, 2, 4, 8, 16]) AS bit, unnest(['A', 'B', 'C', 'D', 'E']) AS name),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order
  FROM five a, five b, five c, five d, five e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (
  SELECT filter_order, step, bit,
    list_sum([0] || list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65)))::BIGINT AS before
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders) JOIN five ON name = substr(filter_order, step, 1)),
counted AS (
  SELECT part, filter_order, step, bit,
    count(*) FILTER (mask & (before | bit) = 0) AS kept,
    count(*) FILTER (mask & before = 0 AND mask & bit > 0) AS removed,
    count(*) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant,
    count(*) FILTER (mask = bit) AS unique_fails,
    count(*) FILTER (mask & before = 0 AND mask & bit > 0 AND good) AS good_lost,
    count(*) FILTER (mask & before = 0 AND mask & bit > 0 AND toxic) AS toxic_lost
  FROM rows, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted"""

ORACLE = {"op3_mix_sources": OP3, "op4_url_templates": OP4, "op5_phrase_automata": OP5, "op6_salvage_warc": OP6,
          "op7_suffix_sort": OP7, "op9_trigram_secrets": OP9, "op10_rule_ledger": OP10,
          "op11_prefix_trie": OP11, "op12_filter_audit": OP12}
