"""DuckDB SQL for the queries of this subpackage that SQL can express, written from the queries' contracts.

Models (op2, op7), the secret scan's randomness tests (op3) and encoding (op6) have no SQL; they are tested against
plain Python, exact round trips or held-out rows.
"""
from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = """
WITH t AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
    FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)),
whole AS (
    SELECT conv_id, count(*) AS n_turns, list([role, text] ORDER BY k) AS turns,
           string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY k) AS text
    FROM t GROUP BY conv_id),
firsts AS (SELECT min(conv_id) AS conv_id, count(*) AS n_logged, n_turns, turns, any_value(text) AS text FROM whole GROUP BY n_turns, turns)
SELECT conv_id, CAST(0 AS BIGINT) AS part, CAST(n_turns AS BIGINT) AS n_turns, CAST(n_logged AS BIGINT) AS n_logged, text
FROM firsts AS a
WHERE NOT EXISTS (SELECT 1 FROM whole AS b WHERE b.n_turns > a.n_turns AND b.turns[1] = a.turns[1] AND b.turns[:a.n_turns] = a.turns)
"""

OP4 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
items AS (
    SELECT DISTINCT item, least(10, len(w)) AS size, w[i:i + least(10, len(w)) - 1] AS win
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hits AS (
    SELECT p.doc_id, p.i, t.size, t.item FROM places AS p
    JOIN (SELECT DISTINCT size FROM items) AS s ON p.i + s.size - 1 <= len(p.w)
    JOIN items AS t ON t.size = s.size AND t.win = p.w[p.i:p.i + s.size - 1]),
covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(f.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered AS c USING (doc_id) LEFT JOIN found AS f USING (doc_id)
"""

OP5 = f"""
WITH lines AS (
    SELECT doc_id, i, l[i] AS line, {_LOWER.format(f"trim(l[i], {_BLANKS})")} AS key
    FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
often AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT doc_id, i, line, o.key IS NOT NULL AND doc_id <> keeper AS gone FROM lines LEFT JOIN often AS o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP8 = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw, coalesce(rest, '') AS rest FROM u),
p AS (SELECT page_id, {_LOWER.format("raw")} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
sites AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS s(site, start, verdict)),
best AS (
    SELECT page_id, max_by(site || start, length(site || start)) AS rule, max_by(verdict, length(site || start)) AS verdict
    FROM p JOIN sites ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start) GROUP BY page_id),
w AS (SELECT * FROM (VALUES ('ad-server'), ('ads-track'), ('adult'), ('adult-x'), ('betting'), ('casino'), ('casino-win'), ('cheap-loans'), ('cheap-pills'),
      ('free-bets'), ('free-money'), ('link-farm'), ('pharmacy-online'), ('poker'), ('porn'), ('replica-watches'), ('spam-farm'), ('sportsbook'), ('xxx')) AS v(word)),
words AS (SELECT page_id, min_by(word, (-length(word), word)) AS word FROM p, w WHERE list_contains(regexp_split_to_array(lower(host || path), '[./]'), word) GROUP BY page_id)
SELECT page_id, host, path, best.rule, coalesce(best.verdict, CASE WHEN word IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN best.rule IS NULL THEN word END AS pattern_rule
FROM p LEFT JOIN best USING (page_id) LEFT JOIN words USING (page_id)
"""

OP9 = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
    SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) AS c
    JOIN n AS m ON m.doc_id = a JOIN n AS o ON o.doc_id = b WHERE 100 * k >= 75 * (m.n + o.n - k)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT doc_id, b FROM reach JOIN links ON a = r)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id, min(r) = doc_id AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

OP10 = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
again AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM twice) GROUP BY doc_id),
l AS (
    SELECT doc_id, line, w, len(w) AS n, len(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols, length(array_to_string(w, '')) AS chars,
        len(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^[\\x20\\x09]*(#{1,6}|[*>])[\\x20\\x09]+', ''),
            '\\*\\*\\*([^\\x20\\x09*]|[^\\x20\\x09*][^*]*[^\\x20\\x09*])\\*\\*\\*', '\\1', 'g'), '\\*\\*([^\\x20\\x09*]|[^\\x20\\x09*][^*]*[^\\x20\\x09*])\\*\\*', '\\1', 'g'),
            '\\*([^\\x20\\x09*]|[^\\x20\\x09*][^*]*[^\\x20\\x09*])\\*', '\\1', 'g'), '[^#*$%&|<>]', '', 'g')) AS own
    FROM (SELECT doc_id, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS w FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d))),
j AS (
    SELECT *, n > 0 AND ((n >= 2 AND symbols >= 3 AND symbols * 4 >= n AND own >= 3 AND own * 4 >= n)
        OR (n >= 150 AND NOT regexp_matches(line, '[.,;:!?…。、，！？；：،؛؟।]')) OR regexp_matches(line, '[.,;:!?](\\x20?[.,;:!?]){9}') OR (n >= 6 AND (length(line) - length(replace(line, '|', ''))) * 3 >= n)
        OR (n >= 4 AND (length(line) - length(replace(line, '!', ''))) * 2 >= n) OR (n >= 12 AND len(list_distinct(w)) * 3 <= n)
        OR (n <= 20 AND regexp_matches(lower(line), 'accept all cookies|all rights reserved|click here to|cookie policy|enable javascript|privacy policy|sign up for our newsletter|skip to content|subscribe to our|terms of service'))) AS bad
    FROM l),
s AS (
    SELECT doc_id, sum(chars) AS chars, sum(symbols) AS symbols, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup,
           coalesce(sum(chars) FILTER (bad), 0) AS lost
    FROM j GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(chars AS BIGINT) AS word_chars, CAST(symbols AS BIGINT) AS n_symbols,
       CAST(dup AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words,
       len(w) < 50 OR 100 * coalesce(again.n, 0) > 50 * len(w) AS base_failed,
       NOT (len(w) < 50 OR 100 * coalesce(again.n, 0) > 50 * len(w)) AND (chars = 0 OR 100.0 * lost / chars <= 50) AS kept
FROM d JOIN s USING (doc_id) LEFT JOIN again USING (doc_id)
"""

OP11 = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c.b, e.vec_id)) AS component_id,
       e.vec_id <= coalesce(c.b, e.vec_id) AS kept
FROM embeddings AS e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least AS c ON c.a = e.vec_id
"""

_TERMS = '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+'

OP12 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERMS}') AS w FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERMS}')) AS term FROM benchmark),
whole AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, term, size, count(*) AS tf FROM (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, whole),
part AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * size * n_docs) // n_terms))) AS part
         FROM tf JOIN weight USING (term), whole),
scored AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM b JOIN part USING (term) GROUP BY ALL HAVING sum(part) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10
"""

OP13 = f"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?' || chr(10) || chr(11) || chr(12) || chr(13) || ']')) AS piece
    FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ ' || chr(9) || ']+') AS w FROM p),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
f AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k))
    GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, a FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, j, array_to_string(w[:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail
         FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
scored AS (
    SELECT cuts.lang, cuts.phrase, cuts.a, j, x.a AS l, y.a AS r, n.n, (1000::HUGEINT * cuts.a * n.n) // (x.a::HUGEINT * y.a) AS score
    FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = head JOIN f AS y ON y.lang = cuts.lang AND y.phrase = tail
    JOIN n ON n.lang = cuts.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_of AS (
    SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most
    FROM (SELECT lang, w, a, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL),
kept AS (SELECT weakest.* FROM weakest LEFT JOIN inner_of AS i USING (lang, phrase) WHERE i.most IS NULL OR 100 * i.most < 100 * a)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) WHERE rank <= 2000
"""
