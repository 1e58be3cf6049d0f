"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

CONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, list_slice(w, s + 1, s + least(13, len(w))) AS ws
        FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS s FROM i WHERE len(w) > 0)),
p AS (SELECT rid, unnest(w) AS tok, generate_subscripts(w, 1) AS pos FROM d),
o AS (SELECT p.rid, p.pos, win.item, len(win.ws) AS n
      FROM p JOIN win ON p.tok = win.ws[1] JOIN d ON d.rid = p.rid
      WHERE list_slice(d.w, p.pos, p.pos + len(win.ws) - 1) = win.ws),
h AS (SELECT rid, count(DISTINCT q) AS n_hit
      FROM (SELECT rid, unnest(range(pos, pos + n)) AS q FROM o) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT rid, item FROM o) GROUP BY rid)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h ON h.rid = d.rid LEFT JOIN it ON it.rid = d.rid
"""

#: formatted length: marks, escaped roles and escaped texts; a block for each run of equal roles.
CHAT = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
s AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')) AS text_n,
             length(replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), chr(10), 'xx')) AS role_n
      FROM s)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(text_n + CASE WHEN before = role THEN length('<|im_next|>')
                              ELSE length('<|im_start|>') + role_n + 1 + length('<|im_end|>') + 1 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


SPLIT = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

REPEATS = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {SPLIT} AS w FROM documents),
win AS (SELECT rid, s, md5(array_to_string(list_slice(w, s, s + 34), ' ')) AS k
        FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
cut AS (SELECT DISTINCT rid, unnest(range(s, s + 35)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
kept AS (SELECT t.rid, string_agg(t.x, ' ' ORDER BY t.p) AS said, count(*) AS n
         FROM (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) t ANTI JOIN cut ON cut.rid = t.rid AND cut.p = t.p GROUP BY t.rid)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.said, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.rid = d.rid
"""

#: SHA-1 in base32: eight groups of twenty bits, four characters each.
_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST((CAST('0x' || substr(sha1(coalesce(html, '')), CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) // [32768, 1024, 32, 1][i % 4 + 1]) % 32 + 1 AS BIGINT), 1)), '')"""
WARC = f"""
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, {_BASE32} AS payload_digest,
 CASE WHEN page_id < stored THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < stored THEN stored END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS stored FROM pages)
"""

#: Levels of the six rules, exact binomial tails per stratum, rule and cutoff, and the verdict.
_RATIOS = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
           "capitals": ("n_capitals", "word_chars"), "bangs": ("n_bangs", "n_words"), "echoes": ("n_echoes", "n_words")}
_LEVELS = ", ".join(f"struct_pack(rule := '{r}', level := CASE WHEN {b} > 0 THEN least(40, CAST(floor(40 * {t} / {b}) AS BIGINT)) ELSE 0 END)"
                    for r, (t, b) in _RATIOS.items())
QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, {SPLIT} AS w FROM documents),
ln AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
       FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
fw AS (SELECT rid, s, array_to_string(list_slice(w, s, s + 4), ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS s FROM d WHERE len(w) >= 5)),
rw AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(s, s + 5)) AS p
       FROM (SELECT *, count(*) OVER (PARTITION BY rid, k) AS c FROM fw) WHERE c > 1) GROUP BY rid),
m AS (SELECT d.rid, d.doc_id, d.lang, len(w) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(ln.n_lines, 0) AS n_lines,
       coalesce(ln.n_dup_lines, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words,
       length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs,
       len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_echoes
      FROM d LEFT JOIN ln USING (rid) LEFT JOIN rw USING (rid)),
lv AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, [{_LEVELS}] AS levels FROM m),
lab AS (SELECT lv.lang, CAST(q.quality = 1 AS INT) AS good, lv.levels
        FROM lv JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) q ON lv.doc_id = q.doc_id
        WHERE q.quality = 1 OR NOT lv.base_failed),
n AS (SELECT lang, sum(good) AS n, sum(1 - good) AS bad_n FROM lab GROUP BY lang),
hist AS (SELECT lang, x.rule AS rule, x.level AS level, sum(good) AS good, sum(1 - good) AS bad
         FROM (SELECT lang, good, unnest(levels) AS x FROM lab) GROUP BY ALL),
masks AS (SELECT lang, list(struct_pack(m := m, c := c)) AS rest
          FROM (SELECT lang, list_transform(levels, lambda x: x.level > 0) AS m, count(*) AS c FROM lab WHERE good = 0 GROUP BY ALL) GROUP BY lang),
pick AS (SELECT lang, arg_max(rules, len(rules)) AS rules FROM (
  WITH RECURSIVE r AS (
   SELECT lang, rest, CAST([] AS BIGINT[]) AS rules FROM masks
   UNION ALL SELECT lang, list_filter(rest, lambda x: NOT x.m[best]), list_append(rules, CAST(best AS BIGINT)) FROM (
    SELECT *, list_position(reach, list_max(reach)) AS best, list_max(reach) AS most FROM (
     SELECT *, list_transform(range(1, {len(_RATIOS) + 1}), lambda i: coalesce(list_sum(list_transform(rest, lambda x: CASE WHEN x.m[i] THEN x.c ELSE 0 END)), 0)) AS reach
     FROM r)) WHERE most > 0)
  SELECT * FROM r) GROUP BY lang),
d2 AS (SELECT 0.05 / greatest(1, count(*) FILTER (n > 0)) AS delta FROM n),
use AS (SELECT pick.lang, n.n, n.bad_n, pick.rules, delta,
         list_max(list_filter(range(1, len(rules) + 1), lambda m: pow(1 - 0.05 / m, n.n) <= delta / m)) AS m
        FROM pick JOIN n ON n.lang IS NOT DISTINCT FROM pick.lang, d2),
cnt AS (SELECT u.lang, u.n, u.bad_n, u.m, u.delta, {list(_RATIOS)}[u.i] AS rule, c.cutoff,
         coalesce(sum(h.good) FILTER (h.level >= c.cutoff), 0) AS k, coalesce(sum(h.bad) FILTER (h.level >= c.cutoff), 0) AS bad_k
        FROM (SELECT *, unnest(rules[1:m]) AS i FROM use WHERE m IS NOT NULL) u, (SELECT unnest(range(1, 41)) AS cutoff) c
        JOIN hist h ON h.lang IS NOT DISTINCT FROM u.lang AND h.rule = {list(_RATIOS)}[u.i] GROUP BY ALL),
tail AS (SELECT *, CASE WHEN k >= n * (0.05 / m) THEN 1.0 ELSE list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda i:
          exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05 / m) + (n - i) * ln(1 - 0.05 / m)))) END AS p FROM cnt),
best AS (SELECT lang, rule, arg_max(cutoff, struct_pack(g := bad_k / greatest(bad_n, 1) - k / greatest(n, 1), c := cutoff)) AS cutoff
         FROM tail WHERE p <= delta / m AND bad_k / greatest(bad_n, 1) - k / greatest(n, 1) > 0 GROUP BY lang, rule),
bad AS (SELECT DISTINCT y.rid FROM (SELECT rid, lang, unnest(levels) AS x FROM lv) y
        JOIN best b ON b.lang IS NOT DISTINCT FROM y.lang AND b.rule = y.x.rule AND y.x.level >= b.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept FROM lv
"""

#: Token counts need the tokenizers; phrases and their scores are SQL.
PHRASES = r"""
WITH p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
           FROM (SELECT coalesce(lang, 'und') AS lang,
                 unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
                 FROM documents)),
g AS (SELECT lang, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws, k, unnest(range(1, k)) AS cut FROM f WHERE k >= 2),
s AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n.n, cut,
             CAST((CAST(1000 AS HUGEINT) * c.a * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(ws, 1, cut), ' ')
      JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(ws, cut + 1, c.k), ' ') JOIN n ON n.lang = c.lang),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT DISTINCT f.lang, f.phrase FROM f JOIN f b ON b.lang = f.lang AND b.k > f.k AND b.f >= f.f
      WHERE contains(' ' || b.phrase || ' ', ' ' || f.phrase || ' '))
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM m ANTI JOIN o USING (lang, phrase)
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) QUALIFY rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op1_benchmark_decontamination": CONTAMINATION,
    "op3_quality_rules": QUALITY,
    "op5_substring_dedup": REPEATS,
    "op6_warc_normaliser": WARC,
    "op9_chat_formatting": CHAT,
    "op13_phrase_collocations": PHRASES,
}
