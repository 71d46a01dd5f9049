"""DuckDB SQL for the registered corpus queries that SQL can express."""

from gridcast.llm import secrets

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP5 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid,
        regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
        regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(ws), 10) AS n, list_slice(ws, i, i + least(len(ws), 10) - 1) AS w
    FROM (SELECT *, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM b WHERE len(ws) > 0)),
places AS (SELECT rid, n, i, list_slice(ws, i, i + n - 1) AS w
    FROM (SELECT d.*, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows))),
found AS (SELECT rid, i, places.n AS n, item FROM places JOIN windows ON places.n = windows.n AND places.w = windows.w),
hits AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM found) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM found GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)"""

OP9 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, rid, i, ls[i] AS line,
        {LOWER.format("trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k
    FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
keys AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 AND doc_id IS NOT NULL
    GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines,
    count(*) FILTER (keeper IS NOT NULL AND doc_id <> keeper) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR doc_id = keeper OR doc_id IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN keys USING (k) GROUP BY rid"""

OP2 = rf"""
WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {LOWER.format("regexp_extract(rest, '^[^/?#]*', 0)")} AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
ruled AS (SELECT *, CASE
        WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p),
marks AS (SELECT doc_id, max(coalesce(quality = 0 OR toxic = 1, false)) AS bad FROM labels GROUP BY doc_id),
hosts AS (SELECT host, split_part(host, '.', -1) AS suffix,
        array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, count(*) AS n, sum(bad::INT) AS k
    FROM p JOIN marks ON try_cast(nullif(regexp_extract(path, '/([0-9]+)(?:[.]html|/)?$', 1), '') AS BIGINT) = marks.doc_id GROUP BY host),
all_ AS (SELECT coalesce(sum(k) / sum(n), 0.0) AS m FROM hosts),
s1 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM hosts, all_ GROUP BY suffix),
w1 AS (SELECT {"{w}"} AS w FROM s1),
s AS (SELECT suffix, k + m * w AS a, n - k + (1 - m) * w AS b FROM s1, w1),
d1 AS (SELECT domain, sum(n) AS n, sum(k) AS k, any_value(a / (a + b)) AS m FROM hosts JOIN s USING (suffix) GROUP BY domain),
w2 AS (SELECT {"{w}"} AS w FROM d1),
d AS (SELECT domain, k + m * w AS a, n - k + (1 - m) * w AS b FROM d1, w2),
h1 AS (SELECT host, n, k, a / (a + b) AS m FROM hosts JOIN d USING (domain)),
w3 AS (SELECT {"{w}"} AS w FROM h1),
h AS (SELECT host, k + m * w AS a, n - k + (1 - m) * w AS b FROM h1, w3)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN coalesce({"{h}"}, {"{d}"}, {"{s}"}, 0) > 1.5 * (SELECT m FROM all_) THEN 'block' ELSE 'allow' END AS verdict,
    round(coalesce({"{h}"}, {"{d}"}, {"{s}"}, 0), 6) AS bad_share
FROM ruled LEFT JOIN h USING (host)
    LEFT JOIN d ON d.domain = array_to_string(list_slice(string_split(host, '.'), -2, -1), '.')
    LEFT JOIN s ON s.suffix = split_part(host, '.', -1)"""
_SPREAD = "(sum(n * (k / n - m) * (k / n - m)) - sum(m * (1 - m))) / (sum(n) - count(*))"
_WEIGHT = f"""coalesce(least(greatest(CASE WHEN {_SPREAD} > 0
    THEN sum(n * m * (1 - m)) / sum(n) / ({_SPREAD}) - 1 ELSE 10000.0 END, 1.0), 10000.0), 10000.0)"""
_BOUND = "{0}.a / ({0}.a + {0}.b) - sqrt({0}.a * {0}.b / (({0}.a + {0}.b) * ({0}.a + {0}.b) * ({0}.a + {0}.b + 1)))"
OP2 = OP2.replace("{w}", _WEIGHT)
for _level in "hds":
    OP2 = OP2.replace("{" + _level + "}", _BOUND.format(_level))

OP6 = rf"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS spot, row_number() OVER () AS rid,
        CAST(len({WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
s AS (SELECT *, 2 * source_size AS most, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w
    FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
r AS (SELECT *, row_number() OVER (ORDER BY most / w, source NULLS LAST) AS k FROM s),
lv AS (SELECT k, most / w AS ratio, (1.5::DOUBLE * sum(source_size) OVER () - (sum(most) OVER (ORDER BY k) - most)::DOUBLE)
        / (sum(w) OVER () - (sum(w) OVER (ORDER BY k) - w)) AS level FROM r),
level AS (SELECT level, k FROM lv WHERE level < ratio OR k = (SELECT max(k) FROM lv) ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN most <= level * w THEN most::DOUBLE ELSE level * w END AS target FROM s, level),
f AS (SELECT d.*, source_size, target,
        CAST(sum(size) OVER (PARTITION BY d.source ORDER BY spot, size, rid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN target > 0 THEN (copy * source_size + upto) / target ELSE 0 END AS vt
    FROM f, (SELECT unnest([0, 1]) AS copy)),
e AS (SELECT *, sum(size) OVER (ORDER BY vt, spot, coalesce(source, ''), size, copy, rid ROWS UNBOUNDED PRECEDING) AS so_far FROM c)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
    CAST(sum(CASE WHEN so_far <= (SELECT sum(target) FROM t) THEN size ELSE 0 END) AS BIGINT) AS taken
FROM e GROUP BY rid"""

_ESCAPED = r"""regexp_replace(regexp_replace(regexp_replace(replace({}, '\', '\0'), '<(\||s>|/s>)', '\\1\1', 'g'),
    '\[INST\]', '\\2INST]', 'g'), '\[/INST\]', '\\2/INST]', 'g')"""
OP7 = rf"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, replace({_ESCAPED.format("role")}, chr(10), '\3') AS r, {_ESCAPED.format("text")} AS c FROM m)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r, c)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r, c) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length('<|turn|>') + length(r) + 1 + length(c) + length('<|end|>') + 1) + length('<|begin|>') AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

OP10 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
windows AS (SELECT rid, i, sha256(array_to_string(list_slice(ws, i, i + 34), ' ')) AS w
    FROM (SELECT *, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
often AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS k FROM windows SEMI JOIN often USING (w)),
words AS (SELECT doc_id, rid, k, ws[k] AS word FROM (SELECT *, unnest(range(1, greatest(len(ws), 1) + 1)) AS k FROM d))
SELECT any_value(doc_id) AS doc_id, count(word) AS n_words, count(gone.k) AS n_removed,
    sha256(coalesce(string_agg(word, ' ' ORDER BY words.k) FILTER (gone.k IS NULL), '')) AS kept_sha256
FROM words LEFT JOIN gone ON words.rid = gone.rid AND words.k = gone.k GROUP BY words.rid"""

def _any_case(pattern: str) -> str:
    """Letters outside of classes and escapes in either case."""
    out, depth, escaped = [], 0, False
    for i, c in enumerate(pattern):
        hexed = pattern[max(i - 2, 0):i] == r"\x" or pattern[max(i - 3, 0):i - 1] == r"\x"
        depth += (c == "[") - (c == "]")
        out.append(f"[{c.upper()}{c.lower()}]" if c.isalpha() and not (depth or escaped or hexed) else c)
        escaped = c == "\\" and not escaped
    return "".join(out)


def _matches(kind: str, pattern: str, keep: str = "true") -> str:
    """Every match, with its place: the running length of matches and the gaps between them."""
    p = pattern.replace("'", "''")
    return f"""SELECT rid, kind, e - length(m) AS s, e FROM (SELECT rid, '{kind}' AS kind, m,
        sum(length(gap) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS e FROM (SELECT rid, unnest(range(1, len(ms) + 1)) AS i,
            unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap FROM (SELECT rid, regexp_extract_all(text, '{p}') AS ms,
            regexp_split_to_array(text, '{p}') AS gaps FROM d))) WHERE {keep}"""


_ASSIGN = _any_case(secrets.ASSIGN)
_BASE = [_matches("assign", _ASSIGN, "length(regexp_extract(m, '{}', 2)) >= 6".format(_ASSIGN.replace("'", "''"))),
         _matches("access", secrets.ACCESS, "length(m) >= 20"), _matches("hex", secrets.HEX, "length(m) >= 24")]
_WEAK = [_matches("id", _any_case(secrets.ID)), _matches("key", _any_case(secrets.KEY)),
         _matches("key", secrets.MIXED, "length(m) >= 20 AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')"),
         _matches("endpoint", _any_case(secrets.ENDPOINT)), _matches("endpoint", _any_case(secrets.HOST))]
_RANK = "list_position(['assign', 'access', 'hex', 'id', 'key', 'endpoint'], kind)"
_NEAR = """EXISTS (SELECT 1 FROM parts p WHERE p.rid = w.rid AND p.kind IN ({}) AND (
        (p.s >= w.e AND p.s - w.e <= 200 AND NOT regexp_matches(substr(w.text, CAST(w.e + 1 AS BIGINT), CAST(p.s - w.e AS BIGINT)), '\\n[\\x20\\t\\r]*\\n'))
        OR (p.e <= w.s AND w.s - p.e <= 200 AND NOT regexp_matches(substr(w.text, CAST(p.e + 1 AS BIGINT), CAST(w.s - p.e AS BIGINT)), '\\n[\\x20\\t\\r]*\\n'))))"""
_SECRET, _IDENTIFIER = _NEAR.format("'assign', 'hex', 'key'"), _NEAR.format("'access', 'id'")
OP11 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
base AS ({" UNION ALL ".join(_BASE)}),
weak AS (SELECT u.*, text FROM ({" UNION ALL ".join(_WEAK)}) u JOIN d USING (rid)
    WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = u.rid AND b.s < u.e AND b.e > u.s)),
parts AS (SELECT rid, kind, s, e FROM base UNION ALL SELECT rid, kind, s, e FROM weak),
spans AS (SELECT *, true AS is_base FROM base UNION ALL SELECT rid, kind, s, e, false FROM weak w WHERE
    CASE kind WHEN 'id' THEN {_SECRET} WHEN 'key' THEN {_IDENTIFIER} ELSE {_SECRET} AND {_IDENTIFIER} END)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    sha256(coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, {_RANK}, e) FILTER (is_base), '')) AS base_sha256,
    coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, {_RANK}, e) FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN spans USING (rid) GROUP BY rid"""

# CRC-32 by its table of 256 remainders, which SQL makes from the polynomial.
_TABLE = """(SELECT list(c ORDER BY x) AS t FROM (SELECT x, list_reduce(list_prepend(x, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS x)))"""
OP12 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS rid,
        regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[a-z\x{{00C0}}-\x{{00FF}}]+') AS rs FROM documents),
r AS (SELECT rid, coalesce(CAST(any_value(doc_id) AS VARCHAR), '') || ':' || run AS named, run, count(*) AS n
    FROM (SELECT rid, doc_id, unnest(rs) AS run FROM d) WHERE length(run) >= 5 GROUP BY rid, run),
b AS (SELECT run, n, hex(encode(named)) AS x FROM r),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2),
        lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) AS h FROM b, {_TABLE}),
w AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS form_n, first(other ORDER BY other_n DESC, other) AS form FROM near GROUP BY word),
known AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form,
    CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS spot FROM known UNION ALL SELECT chain.word, form FROM chain JOIN known ON chain.spot = known.word WHERE form IS NOT NULL)
SELECT known.word, form, spot AS root, n, n_near, form_n
FROM known JOIN chain ON known.word = chain.word WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.word = spot AND k.form IS NOT NULL)"""

SQL = {"op2_url_filter": OP2, "op5_benchmark_decontamination": OP5, "op6_source_mix": OP6,
       "op7_chat_format": OP7, "op9_line_dedup": OP9, "op10_substring_dedup": OP10,
       "op11_secret_scan": OP11, "op12_spelling_variants": OP12}
