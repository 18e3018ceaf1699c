"""SQL twins, for an engine with recursive queries and list functions."""

from edgeloom.llm.license_scan import NOTICES, SPELLINGS

SUPERMINHASH = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
    SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS sh
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
sized AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
    FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
    SELECT a, b FROM pairs JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b
    WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM sized UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
       coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sized USING (doc_id) LEFT JOIN least USING (doc_id)
"""

INT8_TILES = r"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(vec_id, other) AS (
    SELECT vec_id, vec_id FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT d.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, d.vec_id) AS component_id,
       coalesce(component_id, d.vec_id) = d.vec_id AS kept
FROM embeddings d LEFT JOIN counts USING (vec_id) LEFT JOIN least USING (vec_id)
"""

QUOTATION_LINKS = r"""
WITH RECURSIVE lines AS (
    SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
levels AS (
    SELECT *, list_transform(lines, lambda l: length(regexp_replace(regexp_extract(l, '^(?:[\x20\t]*>)+'), '[^>]', '', 'g'))) AS levels FROM lines),
blocks AS (
    SELECT conv_id, turn, level, array_to_string(list_transform(list_zip(lines, levels), lambda z:
        CASE WHEN z[2] = level THEN regexp_replace(z[1], '^(?:[\x20\t]*>)+', '') ELSE '' END), chr(10)) AS block
    FROM (SELECT *, unnest(list_distinct(list_append(levels, 0))) AS level FROM levels)),
parts AS (SELECT conv_id, turn, level, unnest(regexp_split_to_array(block, '\n(?:[\x20\t\r]*\n)+')) AS part FROM blocks),
pieces AS (
    SELECT conv_id, turn, level, unnest([replace(part, chr(10), ' ')] || regexp_split_to_array(replace(part, chr(10), ' '), '[.!?。！？]+(?:[\x20\t\r]+|$)')
           || string_split(part, chr(10))) AS piece FROM parts),
units AS (
    SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(lower(piece), '[^\p{L}\p{N}]+', ' ', 'g')) AS unit FROM pieces),
q AS (SELECT * FROM units WHERE level > 0 AND unit <> ''),
o AS (SELECT * FROM units WHERE level = 0 AND unit <> ''),
found AS (
    SELECT q.conv_id, q.turn, q.level, q.unit, len(string_split(q.unit, ' ')) AS n, max(o.turn) AS origin
    FROM q JOIN o ON o.conv_id = q.conv_id AND o.unit = q.unit AND o.turn < q.turn GROUP BY ALL),
nq AS (
    SELECT conv_id, turn, sum(len(list_filter(levels, lambda x: x > 0))) AS n, min(list_min(list_filter(levels, lambda x: x > 0))) AS level
    FROM levels GROUP BY ALL),
votes AS (SELECT conv_id, turn, origin, sum(found.n) AS words FROM found JOIN nq USING (conv_id, turn, level) GROUP BY ALL),
parents AS (SELECT conv_id, turn, (arg_max(origin, words * 1000000000 + origin)) AS reply_to FROM votes GROUP BY ALL),
chain(conv_id, turn, thread) AS (
    SELECT conv_id, turn, reply_to FROM parents
    UNION SELECT c.conv_id, c.turn, p.reply_to FROM chain c JOIN parents p ON p.conv_id = c.conv_id AND p.turn = c.thread),
threads AS (SELECT conv_id, turn, min(thread) AS thread FROM chain GROUP BY ALL),
nl AS (SELECT conv_id, turn, count(*) AS n FROM found GROUP BY ALL)
SELECT c.conv_id, c.turn, c.role, coalesce(threads.thread, c.turn) AS thread, reply_to,
       coalesce(nq.n, 0)::BIGINT AS n_quoted, coalesce(nl.n, 0)::BIGINT AS n_linked,
       '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || trim(CASE WHEN coalesce(nq.n, 0) > 0 THEN array_to_string(
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda line: NOT regexp_matches(line, '^[\x20\t]*>')
             AND NOT regexp_matches(line, '^(On .+ wrote:|Am .+ schrieb.*:|Le .+ a écrit ?:|El .+ escribió:)[\x20\t]*$')), chr(10))
           ELSE coalesce(text, '') END) || chr(10) || '<|end|>' AS message
FROM conversations c LEFT JOIN parents USING (conv_id, turn) LEFT JOIN threads USING (conv_id, turn)
LEFT JOIN nq USING (conv_id, turn) LEFT JOIN nl USING (conv_id, turn)
"""


def license_digests() -> str:
    form = r"regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\n]+', ' ', 'g')"
    for spelling, one in SPELLINGS:
        form = rf"regexp_replace({form}, '\b{spelling}\b', '{one}', 'g')"
    form = rf"regexp_replace({form}, '(?m)^\x20?(copyright|c [0-9]{{4}}|all rights reserved)( .*)?$', '', 'g')"
    units = f"list_filter(list_transform(string_split({form}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    notices = ", ".join(f"('{name}', '{text}')" for name, text in NOTICES)
    return f"""
WITH known AS (SELECT DISTINCT license_id, array_to_string({units}, ' ') AS words FROM (VALUES {notices}) t(license_id, text)),
d AS (SELECT row_number() OVER () AS r, doc_id, {units} AS lines FROM documents),
l AS (SELECT r, unnest(lines) AS words FROM d),
per AS (SELECT r, count(*) AS n FROM l WHERE words IN (SELECT words FROM known) GROUP BY r),
names AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS licenses FROM l JOIN known USING (words) GROUP BY r),
whole AS (SELECT r, min(license_id) AS whole_license FROM d JOIN known ON array_to_string(lines, ' ') = words GROUP BY r)
SELECT doc_id, len(lines)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_license_lines, coalesce(licenses, '') AS licenses, whole_license
FROM d LEFT JOIN per USING (r) LEFT JOIN names USING (r) LEFT JOIN whole USING (r)
"""


FILTER_AUDIT = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             min(doc_id) OVER (PARTITION BY text) AS least FROM t),
f AS (SELECT part, doc_id, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
             100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
             coalesce(doc_id > least, FALSE) AS e FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
      FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT x1.k || x2.k || x3.k || x4.k || x5.k AS filter_order, [x1.bit, x2.bit, x3.bit, x4.bit, x5.bit] AS bits
      FROM x x1 JOIN x x2 ON x2.k <> x1.k JOIN x x3 ON x3.k NOT IN (x1.k, x2.k) JOIN x x4 ON x4.k NOT IN (x1.k, x2.k, x3.k)
      JOIN x x5 ON x5.k NOT IN (x1.k, x2.k, x3.k, x4.k)),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) r(step)),
c AS (
    SELECT part, filter_order, step, bit,
           sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
           sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
           sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 AND good = 1 THEN n ELSE 0 END)::BIGINT AS good_lost,
           sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 AND toxic = 1 THEN n ELSE 0 END)::BIGINT AS toxic_lost
    FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM c
"""
