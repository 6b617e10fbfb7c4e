"""DuckDB SQL for the queries that SQL can express, written without the operators' methods."""

from __future__ import annotations

from wareloom.llm import license_scan, mixing, quality_rules, secret_scan, url_rules


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def plain_pattern(pattern: str) -> str:
    return quoted(pattern.replace("\\x20", " "))


def secret_spans() -> str:
    """All matches by position, then candidates linked by comparing them with every part of their scope."""
    kinds = [*secret_scan.BASE, *secret_scan.WEAK, ("break", secret_scan.SCOPE_END, "true")]
    conditions = {k: c.replace("m rlike ", "regexp_matches(m, ").replace("]'", "]')").replace("+$'", "+$')") for k, _, c in kinds}
    hits = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS kind, unnest(string_split_regex(text, {plain_pattern(p)})) AS gap, unnest(list_append(regexp_extract_all(text, {plain_pattern(p)}), NULL)) AS m, "
        f"unnest(list_append(regexp_extract_all(text, {plain_pattern(p)}, {2 if k in ('assign', 'account') else 0}), NULL)) AS v, "
        f"generate_subscripts(string_split_regex(text, {plain_pattern(p)}), 1) AS i FROM t"
        for i, (k, p, _) in enumerate(kinds))
    good = " ".join(f"WHEN {i} THEN {conditions[k]}" for i, (k, _, _) in enumerate(kinds))
    names = "[" + ", ".join(quoted(k) for k in secret_scan.KINDS) + "]"
    near = lambda kinds_: f"EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.scope = s.scope AND o.kind IN ({kinds_}) AND (o.start, o.kind) <> (s.start, s.kind))"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), h AS ({hits}),
p AS (SELECT doc_id, kind, m, v, CAST(sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM h),
g AS (SELECT doc_id, kind, stop - length(m) AS start, stop FROM p WHERE m IS NOT NULL AND CASE kind {good} END),
s AS (SELECT *, sum(CASE WHEN kind = {secret_scan.BREAK} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, kind ROWS UNBOUNDED PRECEDING) AS scope FROM g),
r AS (SELECT * FROM s WHERE kind < 3 OR (kind < {secret_scan.BREAK} AND NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.kind < 3 AND o.start < s.stop AND s.start < o.stop)
   AND CASE kind WHEN 3 THEN {near('0, 2, 4')} WHEN 4 THEN {near('1, 3')} ELSE {near('1, 3')} AND {near('0, 2')} END)),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
   string_agg(CASE WHEN kind < 3 THEN concat({names}[kind + 1], ':', start, ':', stop) END, ',' ORDER BY start, kind) AS base,
   string_agg(concat({names}[kind + 1], ':', start, ':', stop), ',' ORDER BY start, kind) AS spans FROM r GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a ON a.doc_id = t.doc_id"""


TOP_PRODUCTS = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.c, d.c) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INT) AS rank, vec_id, score FROM r WHERE n <= 5"""


def quality_rules_sql() -> str:
    stop = ", ".join(quoted(w) for w in sorted(set(quality_rules.STOP_WORDS)))

    def broken(rule):
        bounds = [f"{rule.top} / {rule.bottom} < {rule.least}"] * (rule.least is not None) + [f"{rule.top} / {rule.bottom} > {rule.most}"] * (rule.most is not None)
        return f"CASE WHEN n_words >= {rule.words} AND {rule.bottom} > 0 AND ({' OR '.join(bounds)}) THEN '{rule.name}' END"

    rules = ", ".join(broken(r) for r in quality_rules.RULES)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \\x09-\\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS lines FROM t),
e AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
k AS (SELECT doc_id, i, word, lag(word) OVER d AS before, array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), ' ') AS eight, count(*) OVER (PARTITION BY doc_id) AS n
  FROM e WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, eight) AS times FROM k WHERE i + 7 <= n),
c AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS added FROM f WHERE times > 1),
repeated AS (SELECT doc_id, CAST(sum(added) AS BIGINT) AS n FROM c GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) FILTER (lower(word) IN ({stop})) AS n_stop_words, count(*) FILTER (word LIKE '%!!') AS n_marked_words, count(*) FILTER (word = before) AS n_echo_words FROM k GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, len(lines) AS n_lines,
  coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_marked_words, 0) AS n_marked_words, coalesce(n_echo_words, 0) AS n_echo_words,
  len(list_filter(lines, lambda x: substr(ltrim(x, ' '), 1, 1) IN ('-', '*', '•', '·'))) AS n_bullet_lines
  FROM w LEFT JOIN repeated USING (doc_id) LEFT JOIN counted USING (doc_id)),
j AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEATED} * n_words AS base_failed, concat_ws(',', {rules}) AS broken_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken_rules = '' AS kept, broken_rules FROM j"""


def mixture() -> str:
    weights = mixing.WEIGHTS
    total = sum(weights.values())
    turns = ", ".join(f"('{name}', {k}, {slot}, {weights[name]})" for name, k, slot in mixing.period(weights))
    named = ", ".join(f"'{w}'" for w in weights if w != mixing.OTHER)
    return f"""
WITH turns(class, turn, slot0, weight) AS (VALUES {turns}),
numbered AS (
  SELECT doc_id, source, CASE WHEN source IN ({named}) THEN source ELSE '{mixing.OTHER}' END AS class,
         row_number() OVER (PARTITION BY CASE WHEN source IN ({named}) THEN source ELSE '{mixing.OTHER}' END
                            ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')))) - 1 AS ordinal
  FROM documents),
blocks AS (SELECT *, ordinal // {mixing.BLOCK} AS block, ordinal % {mixing.BLOCK} AS place FROM numbered)
SELECT doc_id, source, b.class AS class, CAST(block AS BIGINT) AS block, CAST(place AS BIGINT) AS place,
       CAST(block * {total} // weight AS BIGINT) AS release, CAST(((block + 1) * {total} + weight - 1) // weight AS BIGINT) AS deadline,
       CAST((block // weight) * {total} + slot0 AS BIGINT) AS slot
FROM blocks b JOIN turns t ON b.class = t.class AND b.block % t.weight = t.turn"""


def licenses() -> str:
    """Every window of every template's shape, without hashing."""
    rows, shapes = [], set()
    for name, (text,) in license_scan.TEMPLATES.items():
        words = [w for w in license_scan.plain_words(text) if w]
        shingles = list(dict.fromkeys(" ".join(words[i : i + 5]) for i in range(len(words) - 4)))
        shapes.add((len(shingles), -(-len(shingles) // 4)))
        rows += [f"({quoted(name)}, {len(shingles)}, {-(-len(shingles) // 4)}, {quoted(s)})" for s in shingles]
    blanks = "' '"
    cleaned = f"translate(lower(coalesce(text, '')), concat({quoted(''.join(c for c in license_scan.PUNCTUATION if c >= ' '))}, chr(9), chr(10), chr(11), chr(12), chr(13)), repeat({blanks}, {len(license_scan.PUNCTUATION)}))"
    return f"""
WITH n(license, s, stride, shingle) AS (VALUES {', '.join(rows)}),
w AS (SELECT doc_id, list_filter(string_split({cleaned}, ' '), lambda x: x <> '') AS words FROM documents),
e AS (SELECT doc_id, len(words) AS total, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM w),
h AS (SELECT doc_id, total, i, array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), ' ') AS shingle FROM e),
hit AS (SELECT doc_id, total, i, license, s, stride, shingle FROM h JOIN n USING (shingle) WHERE i + 5 <= total),
held AS (SELECT doc_id, total, license, s, stride, shingle, unnest(range(greatest(0, (i - s) // stride), i // stride + 1)) * stride AS first_word, i FROM hit),
share AS (SELECT doc_id, total, license, s, stride, first_word, count(DISTINCT shingle) AS shared FROM held WHERE i >= first_word AND i < first_word + s + stride GROUP BY ALL),
good AS (SELECT *, shared / s AS containment, count(*) OVER d AS n_windows, row_number() OVER (PARTITION BY doc_id, license ORDER BY shared DESC, first_word) AS k FROM share WHERE shared >= {license_scan.LEAST} * s WINDOW d AS (PARTITION BY doc_id, license))
SELECT doc_id, license, containment, CAST(first_word AS INT) AS first_word, CAST(least(s + stride + 4, total - first_word) AS INT) AS n_words, n_windows FROM good WHERE k = 1"""


def shards(number: int = 8) -> str:
    """CRC-32 from its polynomial, byte by byte; the smallest capacity by a recursive binary search over all groups."""
    fill = lambda at: f"list_max(list_filter(p, lambda x: x <= {at} + mid))"
    steps = "SELECT *, (lo + hi) // 2 AS mid, 0 AS e0 FROM b WHERE lo < hi"
    for k in range(number):
        steps = f"SELECT *, {fill(f'e{k}')} AS e{k + 1} FROM ({steps})"
    cuts = "SELECT p, lo AS mid, 0 AS e0 FROM b WHERE lo = hi"
    for k in range(number - 1):
        cuts = f"SELECT *, {fill(f'e{k}')} AS e{k + 1} FROM ({cuts})"
    return f"""
WITH RECURSIVE bit AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(3988292384, x >> 1) ELSE x >> 1 END) AS v FROM range(256) r(i)),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bit),
t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size, sha256(text) AS grp, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(text)) AS key,
  list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(text), '..'), lambda x: CAST('0x' || x AS BIGINT))) AS bytes FROM t),
g AS (SELECT grp, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY 1), s AS (SELECT grp, CAST(sum(size) OVER (ORDER BY grp) AS BIGINT) AS stop, size FROM g),
b AS (SELECT (max(stop) + {number - 1}) // {number} AS lo, max(stop) AS hi, list_prepend(0, list(stop ORDER BY stop)) AS p, max(stop) AS total FROM s
  UNION ALL SELECT CASE WHEN e{number} >= total THEN lo ELSE mid + 1 END, CASE WHEN e{number} >= total THEN mid ELSE hi END, p, total FROM ({steps})),
c AS (SELECT [{', '.join(f'e{k}' for k in range(1, number))}] AS cuts FROM ({cuts})),
o AS (SELECT grp, CAST(len(list_filter(cuts, lambda x: x <= stop - size)) AS INT) AS shard FROM s, c)
SELECT doc_id, size, xor(list_reduce(bytes, lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM d JOIN o USING (grp) CROSS JOIN crc"""


CRC_TABLE = """bit AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(3988292384, x >> 1) ELSE x >> 1 END) AS v FROM range(256) r(i)),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bit)"""


def crc32(text: str) -> str:
    """CRC-32 of a text, with the table ``crc`` in the FROM clause."""
    numbers = f"list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex({text}), '..'), lambda x: CAST('0x' || x AS BIGINT)))"
    return f"xor(list_reduce({numbers}, lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295)"


def repairs() -> str:
    """A forward programme over all rows: the best of each state is its cost, audit and repaired text in one string, and the least string wins."""
    grown = lambda s, cost, letter, line: (
        f"lpad(CAST(CAST(substr({s}, 1, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({s}, 10, strpos({s}, chr(1)) - 10) || '{letter}' || substr({s}, strpos({s}, chr(1))) || {line}")
    user, assistant = "'user:' || chr(10)", "'assistant:' || chr(10)"
    to_user = lambda s: f"least(s2, {grown('s0', 2, 'I', user)}, {grown('s1', 2, 'I', user)}, {grown(s, 2, 'I', user)})"
    inserts = f"SELECT * REPLACE ({to_user('s3')} AS s2) FROM (SELECT * REPLACE (least(s3, {grown('s2', 2, 'I', assistant)}) AS s3) FROM (SELECT * REPLACE ({to_user('s3')} AS s2) FROM %s))"
    own, cut = "role || ':' || text || chr(10)", "extra"
    delete = lambda s: grown(s, 3, "D", "''")
    on = lambda condition, s: f"CASE WHEN {condition} THEN {s} END"
    fine = "fault NOT IN ('blank', 'duplicate')"
    rerole = lambda name, s: on(fine, grown(s, f"2 + {cut}", "R", f"'{name}:' || text || chr(10)"))
    keep = lambda initial, s: on(f"{fine} AND initial = '{initial}'", grown(s, cut, "K", own))
    blank = "'[^ \\x09-\\x0D]'"
    return f"""
WITH RECURSIVE {CRC_TABLE},
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS hit FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE hit <> 0),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, left(role, 1) AS initial FROM
  (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d)),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, {blank}) THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ \x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
  coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM o),
r AS (SELECT *, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS extra, count(*) OVER (PARTITION BY conv_id) AS rows FROM f),
best AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST(lpad('0', 9, '0') || chr(1) AS VARCHAR) AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL
  SELECT conv_id, i, {delete('s0')}, least({delete('s1')}, {keep('s', 's0')}),
    least({delete('s2')}, {', '.join(keep('u', s) + ', ' + rerole('user', s) for s in ('s0', 's1', 's3'))}), least({delete('s3')}, {keep('a', 's2')}, {rerole('assistant', 's2')})
  FROM (SELECT b.conv_id, r.i, s0, s1, s2, s3, role, text, fault, extra, initial FROM ({inserts % 'best'}) b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1)),
e AS (SELECT b.conv_id, least(s0, s3) AS s FROM ({inserts % 'best'}) b JOIN (SELECT conv_id, max(i) AS i FROM r GROUP BY 1) m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM r GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(CAST(substr(s, 1, 9) AS INT), 0) AS BIGINT) AS cost, coalesce(substr(s, 10, strpos(s, chr(1)) - 10), '') AS audit,
  sha256(coalesce(left(substr(s, strpos(s, chr(1)) + 1), -1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id"""


def url_verdicts() -> str:
    """All combinations of up to three tokens of every labelled url, counted one by one."""
    listed = "NULL"
    for verdict, rule in sorted(url_rules.LISTED, key=lambda r: len(r[1])):
        domain, _, path = rule.partition("/")
        listed = f"CASE WHEN (host = '{domain}' OR host LIKE '%.{domain}') AND starts_with(path, '/{path}') THEN {{'rule': '{rule}', 'verdict': '{verdict}'}} ELSE {listed} END"
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    lower = f"translate(%s, '{url_rules.UPPER}', '{url_rules.LOWER}')"
    labels = "list_filter(string_split(host, '.'), lambda x: x <> '')"
    domains = f"list_transform(range(1, len({labels}) + 1), lambda i: 'host:' || array_to_string({labels}[i:], '.'))"
    words = f"flatten(list_transform(list_filter({labels}, lambda x: contains(x, '-')), lambda x: list_transform(string_split(x, '-'), lambda w: 'word:' || w)))"
    segments = "list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'segment:' || regexp_replace(x, '[0-9]+', '#', 'g'))"
    extension = "regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)".replace("\\\\", "\\")
    extensions = f"CASE WHEN {extension} <> '' THEN ['extension:' || {lower % extension}] ELSE [] END"
    keys = "list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: 'key:' || regexp_extract(x, '^([^=]*)', 1))"
    tokens = f"list_sort(list_distinct(list_concat({domains}, {words}, {segments}, {extensions}, {keys})))"
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
u AS (SELECT url, {lower % f"regexp_extract({rest}, '^([^/?#]*)', 1)"} AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract({rest}, '^[^?#]*\\?([^#]*)', 1) AS query FROM (SELECT DISTINCT url FROM p)),
t AS (SELECT *, {listed} AS listed, {tokens} AS tokens FROM u),
one AS (SELECT url, listed.verdict AS verdict, unnest(tokens) AS token FROM t),
sets AS (SELECT url, verdict, token AS a, '' AS b, '' AS c, 1 AS size FROM one
  UNION ALL SELECT x.url, x.verdict, x.token, y.token, '', 2 FROM one x JOIN one y ON x.url = y.url AND x.token < y.token
  UNION ALL SELECT x.url, x.verdict, x.token, y.token, z.token, 3 FROM one x JOIN one y ON x.url = y.url AND x.token < y.token JOIN one z ON y.url = z.url AND y.token < z.token),
least AS (SELECT greatest({url_rules.LEAST_URLS}, (count(*) + {url_rules.ONE_IN - 1}) // {url_rules.ONE_IN}) AS n FROM t WHERE listed IS NOT NULL),
counted AS (SELECT a, b, c, size, sum(count(*)) OVER (PARTITION BY a, b, c) AS n_urls, verdict, count(*) AS n_labelled FROM sets WHERE verdict IS NOT NULL GROUP BY a, b, c, size, verdict),
rules AS (SELECT *, rtrim(concat_ws(' ', a, b, c)) AS rule, n_labelled / n_urls AS confidence FROM counted, least WHERE n_labelled >= n AND n_labelled / n_urls >= {url_rules.LEAST_CONFIDENCE}),
kept AS (SELECT * FROM rules r WHERE NOT EXISTS (SELECT 1 FROM rules s WHERE s.size < r.size AND s.verdict = r.verdict AND s.confidence >= r.confidence
  AND s.a IN (r.a, r.b, r.c) AND (s.b = '' OR s.b IN (r.a, r.b, r.c)))),
met AS (SELECT s.url, k.rule, k.verdict, row_number() OVER (PARTITION BY s.url ORDER BY k.confidence DESC, k.n_labelled DESC, k.size, k.rule, k.verdict) AS nth FROM sets s JOIN kept k ON k.a = s.a AND k.b = s.b AND k.c = s.c WHERE s.verdict IS NULL)
SELECT page_id, host, path, listed.rule AS rule, coalesce(listed.verdict, met.verdict, 'allow') AS verdict, met.rule AS mined_rule
FROM p JOIN t USING (url) LEFT JOIN met ON met.url = p.url AND met.nth = 1"""


SPELLING = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{url_rules.UPPER}', '{url_rules.LOWER}') AS run FROM documents),
distinct_runs AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY 1, 2),
hit AS (SELECT run, n, {crc32("id || ':' || run")} AS h FROM distinct_runs, crc),
words AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM hit GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
cut AS (SELECT DISTINCT word, n, left(word, i) || substr(word, i + 2) AS rest, i FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT DISTINCT x.word, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT c.word, words.word, words.n FROM cut c JOIN words ON words.word = c.rest
  UNION SELECT words.word, c.word, c.n FROM cut c JOIN words ON words.word = c.rest),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS near_n FROM pairs GROUP BY 1),
named AS (SELECT b.word, n_near, b.near_n, min(p.near) AS near FROM best b JOIN pairs p ON p.word = b.word AND p.near_n = b.near_n GROUP BY 1, 2, 3),
judged AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN named ON named.word = w.word),
chain AS (SELECT word, word AS at FROM judged UNION ALL SELECT c.word, j.form FROM chain c JOIN judged j ON j.word = c.at WHERE j.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN judged j ON j.word = c.at WHERE j.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN ends USING (word)"""
