"""DuckDB SQL for the queries that SQL can express; written for small tables."""

from __future__ import annotations

from furrow.llm import quality_rules as Q
from furrow.llm import secrets as S

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP9 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM n WINDOW same AS (PARTITION BY t)
"""


def op7() -> str:
    tests = []
    for name, over, op, limit, least in Q.RULES:
        value = name if over is None else f"{name} / nullif({over}, 0)"
        tests.append(f"(n_words >= {least} AND coalesce({value} {op} {limit}, false))")
    stop = ", ".join(f"'{w}'" for w in Q.STOP_WORDS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(5) r(k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop
  FROM d LEFT JOIN covered USING (doc_id)),
r AS (SELECT * EXCLUDE (lines), len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT ({" OR ".join(tests)}) AS kept, n_lines, n_stop
FROM r
"""


def op2(scope: int = 200) -> str:
    patterns = {"assign": S.ASSIGN, "access": S.ACCESS, "hex": S.HEX, "weak_id": S.WEAK_ID, "weak_secret": S.WEAK_SECRET.partition(")")[2], "endpoint": S.ENDPOINT}
    good = {
        "assign": "length(regexp_extract_all(t, p, 2)[i]) >= 6",
        "weak_secret": "regexp_matches(m[i], '[0-9]') AND regexp_matches(m[i], '[A-Za-z]') AND (NOT regexp_matches(m[i], '[/_-]') OR (regexp_matches(m[i], '[A-Z]') AND regexp_matches(m[i], '[a-z]')))",
    }
    found = " UNION ALL ".join(
        f"""SELECT doc_id, '{kind}' AS kind, {no} AS no, '{part}' AS part, b, b + length(m[i]) AS e FROM (
        SELECT doc_id, t, p, m, i, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS b
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, t, p, regexp_extract_all(t, p) AS m, regexp_split_to_array(t, p) AS g
        FROM (SELECT doc_id, coalesce(text, '') AS t, '{patterns[kind].replace("'", "''")}' AS p FROM documents))))
        WHERE {good.get(kind, "true")}"""
        for kind, no, part in S.KINDS
    )
    over = lambda surer: f"EXISTS (SELECT 1 FROM {surer} y WHERE y.doc_id = x.doc_id AND y.b < x.e AND x.b < y.e)"
    near = lambda part: f"EXISTS (SELECT 1 FROM live y WHERE y.doc_id = x.doc_id AND y.part = '{part}' AND y.b - x.e <= {scope} AND x.b - y.e <= {scope})"
    return f"""
WITH found AS MATERIALIZED ({found}),
sure AS MATERIALIZED (SELECT * FROM found WHERE no < 3),
far AS MATERIALIZED (SELECT * FROM sure UNION ALL SELECT * FROM found x WHERE no = 5 AND NOT {over("sure")}),
ids AS MATERIALIZED (SELECT * FROM far UNION ALL SELECT * FROM found x WHERE no = 3 AND NOT {over("far")}),
live AS MATERIALIZED (SELECT * FROM ids UNION ALL SELECT * FROM found x WHERE no = 4 AND NOT {over("ids")}),
spans AS (SELECT * FROM sure UNION ALL SELECT * FROM live x WHERE no = 3 AND {near("secret")} UNION ALL SELECT * FROM live x WHERE no = 4 AND ({near("id")} OR {near("endpoint")})
  UNION ALL SELECT * FROM live x WHERE no = 5 AND {near("id")} AND {near("secret")})
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, no) FILTER (no < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, no), '') AS spans, count(*) FILTER (no >= 3) AS n_linked
FROM documents d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""


OP1 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, s + k AS i FROM later, range(20) r(k)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


OP4 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) m USING (doc_id)
"""


OP5 = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS x FROM conversations),
l AS (SELECT conv_id, turn, i, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
    lower(trim(regexp_replace(regexp_replace(line, '^(?:[ \t]*>)+', ''), '[\x20\x09-\x0D]+', ' ', 'g'))) AS h
  FROM (SELECT conv_id, turn, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS i FROM c)),
p AS (SELECT *, CASE WHEN level = 0 THEN 0 ELSE sum(new) OVER (PARTITION BY conv_id, turn ORDER BY i) END AS p
  FROM (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY conv_id, turn ORDER BY i) THEN 0 ELSE 1 END AS new FROM l)),
f AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, p, level ORDER BY i) AS para FROM p WHERE h <> ''),
paras AS (SELECT conv_id, turn, p, level, min(i) AS i, string_agg(h, ' ' ORDER BY i) AS h FROM f GROUP BY conv_id, turn, p, level, para),
units AS (SELECT conv_id, turn, p, level, h FROM f UNION SELECT conv_id, turn, p, level, h FROM paras
  UNION SELECT conv_id, turn, p, level, string_agg(h, ' ' ORDER BY i) FROM paras GROUP BY ALL
  UNION SELECT conv_id, turn, p, level, unnest(string_split(regexp_replace(h, '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) FROM paras),
met AS (SELECT q.conv_id, q.turn, q.p, q.level, q.h, max(s.turn) AS origin FROM units q JOIN units s ON s.conv_id = q.conv_id AND s.h = q.h AND s.turn < q.turn AND s.level = 0 WHERE q.level > 0 GROUP BY ALL),
got AS (SELECT conv_id, turn, p, level, origin, sum(len(string_split(h, ' '))) AS words FROM met GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, p ORDER BY words DESC, origin DESC) AS n FROM got) WHERE n = 1),
link AS (SELECT conv_id, turn, origin AS reply_to FROM (SELECT conv_id, turn, origin, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, sum(words) DESC, origin DESC) AS n FROM best GROUP BY conv_id, turn, level, origin) WHERE n = 1),
up AS (SELECT conv_id, turn, [turn] AS path FROM (SELECT DISTINCT conv_id, turn FROM conversations) ANTI JOIN link USING (conv_id, turn)
  UNION ALL SELECT k.conv_id, k.turn, list_append(u.path, k.turn) FROM up u JOIN link k ON k.conv_id = u.conv_id AND k.reply_to = u.turn),
top AS (SELECT conv_id, turn, path[1] AS thread, len(path) - 1 AS depth, row_number() OVER (PARTITION BY conv_id, path[1] ORDER BY path) - 1 AS place FROM up),
listed AS (SELECT conv_id, turn, count(*) AS n_linked, string_agg(level || ':' || origin, ',' ORDER BY p) AS sources FROM best GROUP BY ALL),
many AS (SELECT conv_id, turn, count(DISTINCT p) AS n_passages FROM f WHERE level > 0 GROUP BY ALL)
SELECT c.conv_id, c.turn, c.role, k.reply_to, coalesce(top.thread, c.turn) AS thread, coalesce(top.place, 0) AS place, coalesce(top.depth, 0) AS depth,
  len(list_filter(x, lambda y: regexp_matches(y, '^(?:[ \t]*>)+')))::BIGINT AS n_quoted, coalesce(n_passages, 0) AS n_passages, coalesce(n_linked, 0) AS n_linked, coalesce(sources, '') AS sources,
  array_to_string(list_filter(x, lambda y: NOT regexp_matches(y, '^(?:[ \t]*>)+')), chr(10)) AS own_text
FROM c LEFT JOIN link k USING (conv_id, turn) LEFT JOIN top USING (conv_id, turn) LEFT JOIN listed USING (conv_id, turn) LEFT JOIN many USING (conv_id, turn)
"""


OP12 = r"""
WITH RECURSIVE t AS (SELECT d.doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents d),
f AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), min(doc_id) OVER (PARTITION BY t) IS NOT NULL)] AS fails FROM t),
marked AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f
  LEFT JOIN (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id) USING (doc_id)),
orders AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
steps AS (SELECT filter_order, step, [instr('ABCDE', x) FOR x IN string_split(filter_order[1:step - 1], '') IF x <> ''] AS earlier, instr('ABCDE', filter_order[step]) AS no
  FROM orders, range(1, 6) r(step) WHERE length(filter_order) = 5),
one AS (SELECT part, filter_order, step, no, fails[no] AS fail, len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS n, good, toxic FROM marked, steps),
counted AS (SELECT part, filter_order, step, no, count(*) FILTER (NOT gone AND NOT fail) AS kept, count(*) FILTER (NOT gone AND fail) AS removed, count(*) FILTER (gone AND fail) AS redundant,
  count(*) FILTER (fail AND n = 1) AS unique_fails, count(*) FILTER (NOT gone AND fail AND good) AS good_lost, count(*) FILTER (NOT gone AND fail AND toxic) AS toxic_lost FROM one GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, no)::BIGINT AS shapley FROM counted
"""


OP13 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 5) r(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS x FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, u.f AS l, v.f AS r, j, ((2000000::HUGEINT * c.a) // (u.f + v.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f u ON u.lang = c.lang AND u.phrase = array_to_string(x[1:j], ' ') JOIN f v ON v.lang = c.lang AND v.phrase = array_to_string(x[j + 1:], ' ')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM cuts) WHERE o = 1),
inside AS (SELECT lang, array_to_string(x[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, a, x, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 4) s(m) WHERE m < k) GROUP BY ALL),
left_over AS (SELECT b.* FROM best b LEFT JOIN inside i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < 80 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over) JOIN total USING (lang) WHERE rank <= 2000
"""
