"""DuckDB SQL for the queries that SQL can express. The others are tested against brute force in tests/llm."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_ESCAPED = "length(replace({0}, '\\', '\\\\'))" + "".join(f" + (length({{0}}) - length(replace({{0}}, '{m}', ''))) // {len(m)}" for m in _MARKS)

OP1 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE role WHEN 'user' THEN 20 WHEN 'assistant' THEN 7 ELSE 20 + {_ESCAPED.format("role")} END + {_ESCAPED.format("text")})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_SUFFIXES = "('co.uk', 'org.uk', 'ac.uk', 'com.au', 'net.au', 'co.jp', 'co.nz', 'com.br', 'co.in', 'co.za')"


def _strength(level: str) -> str:
    return f"""
  SELECT round(coalesce(CASE WHEN slope > 0 THEN 1 / least(greatest((seen - base) / slope, 1.0 / 1001), 1.0 / 3) - 1 END, 1000.0), 6) AS k
  FROM (SELECT sum(n * pow(bad / n - mean, 2)) AS seen, sum(mean * (1 - mean)) AS base, sum(mean * (1 - mean) * (n - 1)) AS slope FROM {level})"""


def _posterior(level: str, key: str) -> str:
    return f"SELECT {key}, (bad + mean * k) / (n + k) AS mean, n + k AS weight FROM {level}, {level}_k"


OP2 = f"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
named AS (
  SELECT host, CASE WHEN two IN {_SUFFIXES} AND two <> host THEN two ELSE parts[-1] END AS suffix,
    CASE WHEN two IN {_SUFFIXES} THEN array_to_string(parts[-3:], '.') ELSE two END AS domain
  FROM (SELECT host, string_split(host, '.') AS parts, array_to_string(string_split(host, '.')[-2:], '.') AS two FROM (SELECT DISTINCT host FROM p))),
outcomes AS (
  SELECT host, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END AS bad
  FROM p JOIN labels ON labels.doc_id = p.page_id),
h AS (SELECT host, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM outcomes WHERE bad IS NOT NULL GROUP BY host),
hd AS (SELECT h.*, domain, suffix FROM h JOIN named USING (host)),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hd GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
top AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS mean FROM s),
sm AS (SELECT s.*, mean FROM s, top), sm_k AS ({_strength("sm")}), sp AS ({_posterior("sm", "suffix")}),
dm AS (SELECT d.*, mean FROM d JOIN sp USING (suffix)), dm_k AS ({_strength("dm")}), dp AS ({_posterior("dm", "domain")}),
hm AS (SELECT hd.*, mean FROM hd JOIN dp USING (domain)), hm_k AS ({_strength("hm")}), hp AS ({_posterior("hm", "host")}),
known AS (
  SELECT host, coalesce(hp.mean, dp.mean, sp.mean, top.mean) AS mean, coalesce(hp.weight, dp.weight, sp.weight, 1000.0) AS weight
  FROM named LEFT JOIN hp USING (host) LEFT JOIN dp USING (domain) LEFT JOIN sp USING (suffix), top),
ruled AS (
  SELECT p.*, round(mean, 9) AS bad_rate, round(mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)), 9) AS bad_bound,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p JOIN known USING (host))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bad_bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
  bad_rate, bad_bound
FROM ruled
"""


def _alnum(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


OP4 = f"""
WITH iw AS (SELECT item_id, {_alnum("text")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[s:s + 9], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM iw WHERE len(w) > 0)),
dw AS (SELECT row_number() OVER () AS r, doc_id, {_alnum("text")} AS w FROM documents),
spot AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM dw, (SELECT DISTINCT m FROM win)),
hit AS (SELECT r, s, m, item_id FROM (SELECT r, s, m, array_to_string(w[s:s + m - 1], ' ') AS k FROM spot) JOIN win USING (m, k)),
pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + m)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN ids USING (r)
"""

_DRAW = "(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || s), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"
OP6 = f"""
WITH tab AS (
  SELECT list(v ORDER BY n) AS tab FROM (
    SELECT n, list_reduce([n]::BIGINT[] || range(8)::BIGINT[], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END) AS v FROM range(256) x(n))),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h,
    list_transform(range(9), lambda s: 1.0 / -ln({_DRAW})) AS scores FROM documents),
c AS (
  SELECT doc_id, size::BIGINT AS size, scores,
    xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, length(h)::BIGINT, 2), lambda i: ('0x' || h[i + 1:i + 2])::BIGINT),
      lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)::BIGINT AS text_crc32 FROM d, tab),
s AS (SELECT *, (list_position(scores[1:8], list_max(scores[1:8])) - 1)::INTEGER AS shard FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot,
  CASE WHEN scores[9] > list_max(scores[1:8]) THEN 8 ELSE shard END::INTEGER AS grown_shard
FROM s
"""

OP7 = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
later AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM later) GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, string_agg(word, ' ' ORDER BY i) AS text
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) d
  ANTI JOIN (SELECT doc_id, unnest(g) AS i FROM gone) g ON g.doc_id = d.doc_id AND g.i = d.i GROUP BY d.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP10 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

ORACLES = {"op1_chat_format": OP1, "op2_url_filter": OP2, "op4_decontaminate": OP4, "op6_shard": OP6, "op7_substring_dedup": OP7, "op10_warc": OP10}
