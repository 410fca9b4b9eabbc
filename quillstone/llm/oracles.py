"""DuckDB SQL for the queries that SQL can express.

Absent: op3 (patience diff), op7 and op8 (tokenizers) and the pipeline; tests hold these against brute force. Tests
also run the SQL over planted tables, with secrets, aliases and licences that the given tables lack.
"""

from __future__ import annotations

from quillstone.llm.licenses import RULES, SENTENCES

SPACES = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """
WITH o AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)),
w AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS l, count(*) AS n FROM o GROUP BY conv_id
  UNION ALL SELECT NULL, [{'r': role, 't': text}], 1 FROM conversations WHERE conv_id IS NULL),
pre AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, n)) AS k FROM w)),
m AS (SELECT l, n, min(conv_id) AS conv_id FROM w GROUP BY l, n),
r AS (SELECT conv_id, n, list_aggregate(list_transform(l, lambda x: '<|' || coalesce(x.r, '') || '|>' || chr(10) || coalesce(x.t, '') || '<|end|>' || chr(10)), 'string_agg', '') AS t
  FROM m ANTI JOIN pre USING (l))
SELECT conv_id, n AS n_turns, length(t) AS n_chars, sha256(t) AS rendered_sha256 FROM r
"""

OP2 = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, regexp_extract_all(coalesce(text, ''), '{SPACES}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{SPACES}')) AS l,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[A-Z]', '', 'g')) AS n_upper
  FROM documents),
t AS (SELECT doc_id, i, w[i:i + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM t) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, stratum, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, n_upper
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id),
s AS (
  SELECT *, greatest(coalesce(1000 * n_symbols // nullif(n_words, 0), 0), coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0),
    coalesce(1000 * n_upper // nullif(word_chars, 0), 0), coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0))::BIGINT AS score FROM f),
known AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
p AS (
  SELECT stratum, least(ceil(score / 25.0), 41)::BIGINT AS place, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad
  FROM s JOIN known USING (doc_id) GROUP BY ALL),
g AS (SELECT stratum, unnest(range(0, 41)) AS place FROM (SELECT DISTINCT stratum FROM p)),
c AS (
  SELECT g.stratum, g.place, coalesce(sum(good) FILTER (p.place > g.place), 0)::BIGINT AS k, coalesce(sum(bad) FILTER (p.place > g.place), 0)::BIGINT AS bad_out, sum(good)::BIGINT AS n
  FROM g JOIN p ON g.stratum = p.stratum GROUP BY ALL),
tried AS (
  SELECT c.*, CASE WHEN k > n * 0.01 THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))) END AS chance FROM c),
sure AS (
  SELECT *, bool_and(chance <= 0.05 / (SELECT count(DISTINCT stratum) FROM p)) OVER (PARTITION BY stratum ORDER BY place DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS passed FROM tried),
ok AS (
  SELECT *, max(bad_out) OVER (PARTITION BY stratum) AS best
  FROM sure WHERE passed),
cut AS (SELECT stratum, max(place) * 25 AS cutoff FROM ok WHERE bad_out > 0 AND bad_out >= 0.99 * best GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(score > cutoff, false) AS kept, score, cutoff::BIGINT AS cutoff
FROM s LEFT JOIN cut USING (stratum)
"""


def _found(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
{kind}_m AS (SELECT n, t, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v FROM d WHERE regexp_matches(t, '{p}')),
{kind}_s AS (
  SELECT n, {rank} AS rank, '{kind}' AS kind, s AS a, s + length(m[i]) AS b, m[i] AS value FROM (
    SELECT n, m, v, i, length(array_to_string(g[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS s FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {kind}_m))
  WHERE length(v[i]) >= {least})"""


OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
{_found("assign", 0, r'''((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''', 2, 6)},
{_found("access", 1, "AKIA[A-Z0-9]+", 0, 20)},
{_found("hex", 2, "[0-9a-f]+", 0, 24)},
{_found("entropy", 3, "[A-Za-z0-9+/_=-]{20,}", 0, 20)},
base AS (SELECT * FROM assign_s UNION ALL SELECT * FROM access_s UNION ALL SELECT * FROM hex_s),
cand AS (
  SELECT *, CASE WHEN NOT regexp_matches(value, '[0-9]') THEN 4.1 WHEN regexp_matches(value, '^([0-9a-f]*[a-f][0-9a-f]*|[0-9A-F]*[A-F][0-9A-F]*)$') THEN 3.0
    WHEN regexp_matches(value, '^[A-Z2-7]*[A-Z][A-Z2-7]*=*$') THEN 3.5 WHEN regexp_matches(value, '^([a-z0-9]+|[A-Z0-9]+)$') THEN 3.6
    WHEN regexp_matches(value, '[A-Z][^A-Z]*[a-z]|[a-z][^a-z]*[A-Z]') THEN 3.8 ELSE 4.1 END AS least
  FROM entropy_s
  WHERE NOT regexp_matches(value, '(?i)example|placeholder|dummy|changeme|redacted|x{{6}}')
    AND NOT regexp_matches(value, '(?i)0123456789|123456789|abcdefghijkl|qwertyuiop')
    AND NOT regexp_matches(value, '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$')),
win AS (SELECT *, list_aggregate(string_split(substring(value, i, 20), ''), 'entropy') AS bits FROM (SELECT *, unnest(range(1, length(value) - 18)) AS i FROM cand)),
added AS (
  SELECT n, rank, kind, a + min(i) - 1 AS a, a + max(i) + 19 AS b FROM win WHERE bits >= least - 1e-9 GROUP BY n, rank, kind, a
  HAVING NOT EXISTS (SELECT 1 FROM base x WHERE x.n = win.n AND x.a <= win.a + min(win.i) - 1 AND x.b >= win.a + max(win.i) + 19)),
every AS (SELECT n, rank, kind, a, b FROM base UNION ALL SELECT * FROM added),
j AS (
  SELECT n, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans
  FROM every GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (n)
"""
OP4 = OP4.replace("SELECT * FROM assign_s", "SELECT n, rank, kind, a, b FROM assign_s").replace("SELECT * FROM access_s", "SELECT n, rank, kind, a, b FROM access_s").replace("SELECT * FROM hex_s", "SELECT n, rank, kind, a, b FROM hex_s")

OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{SPACES}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i:i + 3] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)
  UNION ALL SELECT doc_id, w FROM d WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(low.b, d.doc_id) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN low ON d.doc_id = low.a
"""

OP6 = r"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
l AS (
  SELECT url AS a, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS root, regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)', 1) AS folder, regexp_replace(unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda x: regexp_extract(x, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda x: regexp_extract(x, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))), '(?i)&(amp|#38|#x26);', '&', 'g') AS t
  FROM u WHERE contains(url, '://')),
e AS (
  SELECT a, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(root, '^(.*?:)//', 1) || t WHEN starts_with(t, '/') THEN root || t
    WHEN starts_with(t, '?') THEN regexp_extract(a, '(?s)^[^?#]*') || t WHEN starts_with(t, '#') THEN regexp_extract(a, '(?s)^[^#]*') || t WHEN folder = root THEN root || '/' || t ELSE folder || t END AS b
  FROM l WHERE t <> ''),
x AS (
  SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
    array_to_string(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_\w+|gclid|dclid|fbclid|msclkid|mc_cid|mc_eid)(=|$)')), '&') AS q
  FROM (SELECT url FROM u UNION SELECT a FROM e UNION SELECT b FROM e)),
r(action, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f AS (SELECT url, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action FROM x JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY url),
k AS (
  SELECT x.url, host, path, rule, action, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '/+$', '') || CASE WHEN q = '' THEN '' ELSE '?' || q END AS key
  FROM x LEFT JOIN f ON x.url = f.url),
g AS (SELECT DISTINCT y.key AS a, z.key AS b FROM e JOIN k y ON e.a = y.url JOIN k z ON e.b = z.url WHERE contains(e.b, '://')),
reach AS (SELECT a, b FROM g UNION SELECT b, a FROM g UNION SELECT reach.a, s.b FROM reach JOIN (SELECT a, b FROM g UNION SELECT b, a FROM g) s ON reach.b = s.a),
passed AS (SELECT reach.a AS key, CASE WHEN bool_or(k.action = 'allow') THEN 'allow' ELSE 'block' END AS action FROM reach JOIN k ON reach.b = k.key WHERE k.action IS NOT NULL GROUP BY reach.a)
SELECT page_id, host, path, rule, coalesce(k.action, passed.action, 'allow') AS verdict FROM u JOIN k ON u.url = k.url LEFT JOIN passed ON k.key = passed.key
"""

OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[i:i + 9] AS x, 10 AS n FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM b WHERE len(w) >= 10)
  UNION SELECT item_id, w, len(w) FROM b WHERE len(w) BETWEEN 1 AND 9),
places AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
m AS (SELECT doc_id, i, places.n, item_id FROM places JOIN win ON places.n = win.n AND places.x = win.x),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""



def _op10() -> str:
    """Sentences by splitting and normalising, then one step for each rule in order."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    space, marks = r"[ \t\n\x0B\f\r]", r"[ \t\n\x0B\f\r#*/;-]"
    norm = lambda x: f"""regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '["''`‘’“”]', '', 'g'), '^{marks}+|{space}*\\n{marks}*', ' ', 'g'), '{space}+', ' ', 'g')), '[ \\t\\n\\x0B\\f\\r.;:,!]+$', '')"""
    known = ", ".join(f"({q(k)}, {q(v)})" for k, v in SENTENCES.items())
    steps = ""
    for i, (sequence, name) in enumerate(RULES):
        seek = q("".join(f"|{x}|" for x in sequence))
        steps += f",\nr{i + 1} AS MATERIALIZED (SELECT n, ids, replace(l, {seek}, '||') AS l, CASE WHEN contains(l, {seek}) AND NOT list_contains(names, {q(name)}) THEN list_append(names, {q(name)}) ELSE names END AS names FROM r{i})"
    return f"""
WITH known(k, v) AS (VALUES {known}),
d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, text FROM documents),
p AS (SELECT n, string_split(regexp_replace(regexp_replace(text, '\\n{marks}*\\n', chr(1), 'g'), '([.!?;]){space}+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM d),
s AS MATERIALIZED (SELECT n, i, p[i] AS s FROM (SELECT n, p, unnest(range(1, len(p) + 1)) AS i FROM p)),
w AS MATERIALIZED (SELECT n, i, v FROM (SELECT n, i, {norm("s")} AS k FROM s) JOIN known USING (k)),
ln AS (SELECT n, i, j, x[j] AS s FROM (SELECT n, i, x, unnest(range(1, len(x) + 1)) AS j FROM (SELECT n, i, string_split(s, chr(10)) AS x FROM s ANTI JOIN w USING (n, i) WHERE contains(s, chr(10))))),
v AS (SELECT n, i, 0 AS j, v FROM w UNION ALL SELECT n, i, j, v FROM (SELECT n, i, j, {norm("s")} AS k FROM ln) JOIN known USING (k)),
r0 AS MATERIALIZED (SELECT n, string_agg(v, '|' ORDER BY i, j) AS ids, '|' || string_agg(v, '||' ORDER BY i, j) || '|' AS l, []::VARCHAR[] AS names FROM v GROUP BY n){steps}
SELECT doc_id, coalesce(ids, '') AS identifiers, coalesce(array_to_string(names, ','), '') AS licenses, coalesce(len(list_filter(string_split(l, '|'), lambda x: x <> '')), 0)::BIGINT AS unmatched
FROM d LEFT JOIN r{len(RULES)} USING (n)
"""


def _op11(rounds: int = 2) -> str:
    d = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - e[i]) * (v[i] - e[i])))"
    near = lambda i: f"a{i} AS MATERIALIZED (SELECT ref, part, any_value(v) AS v, min([d, entry]) AS m FROM (SELECT ref, part, v, entry, {d}::BIGINT AS d FROM p JOIN b{i} USING (part)) GROUP BY ref, part)"
    mean = lambda i: f"""u{i} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY j) AS e FROM (
    SELECT part, m[2] AS entry, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM (SELECT part, m, v, unnest(range(1, len(v) + 1)) AS j FROM a{i}) GROUP BY ALL) GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(u{i}.e, b{i}.e) AS e FROM b{i} LEFT JOIN u{i} USING (part, entry))"""  # noqa: E731
    steps = ",\n".join(x for i in range(rounds) for x in (near(i), mean(i)))
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS ref, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT ref, part, q[part * (len(q) // 16) + 1:(part + 1) * (len(q) // 16)] AS v FROM k, (SELECT unnest(range(16)) AS part)),
s AS (SELECT ref, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS entry FROM k ORDER BY entry LIMIT 64),
b0 AS MATERIALIZED (SELECT part, entry, v AS e FROM p JOIN s USING (ref)),
{steps},
{near(rounds)},
c AS (SELECT ref, string_agg(lpad(lower(to_hex(m[2])), 2, '0'), '' ORDER BY part) AS code, sum(m[1])::BIGINT AS error FROM a{rounds} GROUP BY ref)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM k JOIN c USING (ref)
"""


def _op12() -> str:
    field = lambda c: f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: {bits}), 4294967295)"
    up = lambda t: f"SELECT g, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM {t} WHERE n > 1 GROUP BY g, lvl, pos // 16, n"
    walk = lambda t, kids: f"SELECT id, {t}.g, {t}.lvl + 1, pos // 16, (n + 15) // 16, proof || array_to_string(l[1:pos % 16] || l[pos % 16 + 2:], ''), sha256(array_to_string(l[1:pos % 16] || [fold] || l[pos % 16 + 2:], '')) FROM {t} JOIN {kids} ON {kids}.g = {t}.g AND {kids}.lvl = {t}.lvl AND p = pos // 16 WHERE n > 1"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '') AS g, {leaf("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(lower)} END AS claimed FROM documents),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
low(g, lvl, pos, n, h) AS (SELECT g, 0, pos, n, leaf FROM o UNION ALL {up("low")}),
low_kids AS MATERIALIZED (SELECT g, lvl, pos // 16 AS p, list(h ORDER BY pos) AS l FROM low GROUP BY ALL),
top AS MATERIALIZED (SELECT g AS id, '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, h FROM low WHERE n = 1),
high(g, lvl, pos, n, h) AS (SELECT g, 0, pos, n, h FROM top UNION ALL {up("high")}),
high_kids AS MATERIALIZED (SELECT g, lvl, pos // 16 AS p, list(h ORDER BY pos) AS l FROM high GROUP BY ALL),
a(id, g, lvl, pos, n, proof, fold) AS (SELECT id, g, 0, pos, n, '', coalesce(claimed, leaf) FROM o UNION ALL {walk("a", "low_kids")}),
b(id, g, lvl, pos, n, proof, fold) AS (
  SELECT a.id, '', 0, top.pos, top.n, proof, fold FROM a JOIN top ON a.g = top.id WHERE a.n = 1 UNION ALL {walk("b", "high_kids")})
SELECT doc_id, leaf, top.h AS subroot, high.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = high.h AS verified
FROM o JOIN (SELECT id, proof, fold FROM b WHERE n = 1) USING (id) JOIN top ON o.g = top.id JOIN high ON high.n = 1
"""


ORACLES: dict[str, str] = {
    "op1_chat_snapshots": OP1,
    "op2_quality_rules": OP2,
    "op4_secret_scan": OP4,
    "op5_minhash_near_dedup": OP5,
    "op6_url_filter": OP6,
    "op9_decontamination": OP9,
    "op10_license_scan": _op10(),
    "op11_vector_codes": _op11(),
    "op12_merkle_manifest": _op12(),
}
