"""DuckDB SQL for queries(), over views named as the tables.

Absent are the data-dependent loop of pagerank_converged, the walks of cycle_paths, the whole roadmap and the rules of
detected_entry_points; tests hold those against brute force or small expected results.
"""

from __future__ import annotations

from quillstone.functions import constants as C
from quillstone.functions.paths import glob_regex, ignore_regex, workspace_regex
from quillstone.operators.search import term_weights
from quillstone.plans.base import CODE, EDGES, FILES, LAYERED, URL_PATHS, duck

CODE, EDGES, FILES, LAYERED, URL_PATHS = (f"({duck(x)})" for x in (CODE, EDGES, FILES, LAYERED, URL_PATHS))
LF = "chr(10)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def n_lines(t: str) -> str:
    return f"(length({t}) - length(replace({t}, {LF}, '')) + CASE WHEN {t} = '' OR ends_with({t}, {LF}) THEN 0 ELSE 1 END)"


def words(t: str) -> str:
    spaced = f"regexp_replace(regexp_replace(regexp_replace({t}, '[_-]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_transform([list_filter(string_split({spaced}, ' '), lambda x: x <> '')], lambda w: CASE WHEN len(w) > 1 THEN list_append(w, {t}) ELSE w END)[1]"


def tokens(t: str) -> str:
    raw = f"list_filter(string_split_regex({t}, '[^A-Za-z0-9_]+'), lambda x: x <> '')"
    return f"list_filter(list_transform(flatten(list_transform({raw}, lambda r: {words('r')})), lambda x: lower(x)), lambda x: length(x) >= 3)"


BASENAME = "regexp_extract(path, '([^/]*)$', 1)"
DIRNAME = "regexp_extract(path, '^(.*)/[^/]*$', 1)"
EXT = f"lower(regexp_extract({BASENAME}, '^.+\\.([^.]*)$', 1))"
STEM = f"regexp_replace({BASENAME}, '^(.+)\\.[^.]*$', '\\1')"
DIRS = f"list_transform(list_filter(string_split({DIRNAME}, '/'), lambda x: x <> ''), lambda x: lower(x))"
SLUG = f"regexp_replace(regexp_replace(lower({DIRNAME}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
LANGUAGE = f"CASE {EXT} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.LANGUAGE_BY_EXTENSION.items()) + " ELSE 'other' END"


def _class(header: str) -> str:
    within = lambda n: f"list_has_any({DIRS}, {names(n)})"
    rx = lambda of, p: f"regexp_matches({of}, {q(p)})"
    marks = f"array_to_string(string_split({header}, {LF})[1:3], {LF})"
    test = " OR ".join([f"len(list_filter({DIRS}, lambda d: {rx('d', C.TEST_SEGMENT)})) > 0", *(rx(BASENAME, p) for p in C.TEST_BASENAMES)])
    generated = " OR ".join([f"contains({marks}, {q(m)})" for m in C.GENERATED_MARKERS] + [f"contains(lower({BASENAME}), {q(m)})" for m in C.GENERATED_INFIXES])
    extra = {"component": f" OR {rx(BASENAME, C.COMPONENT_BASENAME)}", "hook": f" OR {rx(BASENAME, C.HOOK_BASENAME)}"}
    rules = [(f"{STEM} = 'main'", "entrypoint"), (test, "test"), (within(C.FIXTURE_SEGMENTS), "fixture"), (f"list_contains({names(C.STYLE_EXTENSIONS)}, {EXT})", "style")]
    rules += [(f"list_contains({names(C.DOCS_EXTENSIONS)}, {EXT}) OR {within(['docs'])}", "docs")]
    rules += [(f"list_contains({names(C.CONFIG_FILENAMES)}, lower({BASENAME})) OR list_contains({names(C.CONFIG_EXTENSIONS)}, {EXT}) OR {within(['config'])}", "config"), (generated, "generated")]
    rules += [(within(n) + extra.get(k, ""), k) for k, n in C.SEGMENT_CLASSES] + [(f"list_contains({names(C.ASSET_EXTENSIONS)}, {EXT})", "asset")]
    return "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for c, k in rules) + " ELSE 'unknown' END"


FILES_PLUS = f"(SELECT *, {LANGUAGE} AS language, {_class(chr(39) * 2)} AS classification FROM {FILES})"


def _degrees(edges: str) -> str:
    return f"""(SELECT f.id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM {FILES} f
  LEFT JOIN (SELECT dst, count(*) AS n FROM {edges} GROUP BY dst) i ON i.dst = f.id LEFT JOIN (SELECT src, count(*) AS n FROM {edges} GROUP BY src) o ON o.src = f.id)"""


def _pagerank(edges: str, rounds: int = C.PAGERANK_ITERATIONS, epsilon: float = C.PAGERANK_EPSILON) -> str:
    """The rounds themselves; a row of a vertex to itself, without a share, carries it along."""
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {edges}), o AS MATERIALIZED (SELECT src, count(*) AS n FROM e GROUP BY src), v AS MATERIALIZED (SELECT id, count(*) OVER () AS n FROM {FILES}),
s AS MATERIALIZED (SELECT e.src, e.dst, o.n::DOUBLE AS n_out FROM e JOIN o USING (src) UNION ALL SELECT id, id, NULL FROM v),
r(t, id, n, r, ends, moved) AS (
  SELECT 0, id, v.n, 1::DOUBLE / v.n, o.src IS NULL, 1e9::DOUBLE FROM v LEFT JOIN o ON o.src = v.id
  UNION ALL
  SELECT t + 1, id, n, r, ends, sum(abs(r - old)) OVER () FROM (
    SELECT any_value(t) AS t, s.dst AS id, any_value(n) AS n, 0.15::DOUBLE / any_value(n) + 0.85::DOUBLE * any_value(d) / any_value(n) + coalesce(sum(r / n_out), 0) AS r, bool_or(ends AND n_out IS NULL) AS ends, max(CASE WHEN n_out IS NULL THEN r END) AS old
    FROM (SELECT *, coalesce(sum(CASE WHEN ends THEN r END) OVER (), 0) AS d FROM r WHERE t < {rounds} AND moved >= {epsilon}) x JOIN s ON s.src = x.id GROUP BY s.dst))
SELECT id, round(r, 6) AS page_rank FROM r WHERE t = (SELECT max(t) FROM r)"""


_boost = "CASE classification " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in C.ROLE_BOOST.items()) + " ELSE 0::DOUBLE END"


def _ranked(edges: str) -> str:
    return f"""(SELECT *, CASE WHEN is_parsed THEN greatest(0::DOUBLE, least(1::DOUBLE, round(0.55::DOUBLE * coalesce((page_rank - lp) / nullif(hp - lp, 0), 0) + 0.3::DOUBLE * coalesce((in_degree - li) / nullif(hi - li, 0), 0) + 0.15::DOUBLE * {_boost}, 6))) ELSE 0::DOUBLE END AS importance
  FROM (SELECT f.*, d.in_degree, d.out_degree, p.page_rank, min(p.page_rank) FILTER (is_parsed) OVER () AS lp, max(p.page_rank) FILTER (is_parsed) OVER () AS hp,
    min(d.in_degree) FILTER (is_parsed) OVER () AS li, max(d.in_degree) FILTER (is_parsed) OVER () AS hi FROM {FILES_PLUS} f JOIN {_degrees(edges)} d USING (id) JOIN ({_pagerank(edges)}) p USING (id)))"""


DEG, RANKED = _degrees(EDGES), _ranked(EDGES)


def _scc(edges: str) -> str:
    reach = f"e AS MATERIALIZED (SELECT src, dst FROM {edges}), reach AS (SELECT src AS a, dst AS b FROM e UNION SELECT reach.a, e.dst FROM reach JOIN e ON reach.b = e.src)"
    return f"{reach}, scc AS (SELECT f.id, least(f.id, coalesce(min(x.b), f.id)) AS component FROM {FILES} f LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a) x ON x.a = f.id GROUP BY f.id)"


ANCESTORS = f"list_transform(range(0, len(string_split({DIRNAME}, '/')) + 1), lambda i: array_to_string(string_split({DIRNAME}, '/')[1:i], '/'))"
ANCESTORS = f"CASE WHEN {DIRNAME} = '' THEN [''] ELSE {ANCESTORS} END"


def _modules(roots: list[str], most: int) -> str:
    parts = []
    for r in roots:
        inner = DIRNAME if not r else f"CASE WHEN starts_with(path, {q(r + '/')}) THEN substring({DIRNAME}, {len(r) + 2}) END"
        seg = f"list_filter(string_split({inner}, '/'), lambda x: x <> '')"
        parts += [f"CASE WHEN len({seg}) >= {d} THEN {q(r + '/') if r else q('')} || array_to_string(({seg})[1:{d}], '/') END" for d in (1, 2)]
    return f"""
f AS (SELECT id, path, is_parsed, {DIRNAME} AS d FROM {FILES}),
cand AS (SELECT DISTINCT path, dir FROM (SELECT path, unnest([{', '.join(parts)}]) AS dir FROM {FILES}) WHERE dir IS NOT NULL),
direct AS (SELECT d FROM f WHERE is_parsed GROUP BY d HAVING count(*) >= {C.MODULE_MIN_FILES}),
own AS (SELECT path, arg_max(dir, length(dir)) AS dir FROM cand WHERE dir IN (SELECT d FROM direct) GROUP BY path),
top AS (SELECT dir FROM own GROUP BY dir ORDER BY count(*) DESC, dir LIMIT {most}),
assigned AS (SELECT f.path, CASE WHEN own.dir IS NULL THEN NULL WHEN top.dir IS NULL THEN 'other' ELSE top.dir END AS module FROM f LEFT JOIN own USING (path) LEFT JOIN top ON top.dir = own.dir)"""


def _redact(t: str) -> str:
    """The rules that are plain replacements, without the two that test a match."""
    for _, pattern, replacement in C.REDACTION_RULES:
        if pattern:
            t = f"regexp_replace({t}, {q(pattern)}, {q(replacement.replace('$', chr(92)))}, 'g')"
    return t


REDACTED = f"array_to_string(list_transform(string_split(text, {LF}), lambda l: {_redact('l')}), {LF})"


def _where(line: str, pattern: str, test: str, replacement: str) -> str:
    """Replaces the matches m of a line that pass a test."""
    put = f"list_transform([regexp_extract_all(x, {q(pattern)})[i]], lambda m: CASE WHEN {test} THEN {q(replacement)} ELSE m END)[1]"
    pieces = f"list_transform(string_split_regex(x, {q(pattern)}), lambda gap, i: gap || coalesce({put}, ''))"
    return f"list_transform([{line}], lambda x: CASE WHEN regexp_matches(x, {q(pattern)}) THEN array_to_string({pieces}, '') ELSE x END)[1]"


def _redact_line(line: str) -> str:
    """All line rules in order, with the two that test a match."""
    has = lambda p, x: f"regexp_matches({x}, {q(p)})"
    for name, pattern, replacement in C.REDACTION_RULES:
        if name == "entropy":
            inner = "m[2:-2]"
            classes = " + ".join(f"{has(p, inner)}::INT" for p in ("[a-z]", "[A-Z]", "[0-9]", "(?s)[^A-Za-z0-9]"))
            test = f"{classes} >= {C.ENTROPY_CLASSES} AND list_aggregate(regexp_extract_all({inner}, '(?s).'), 'entropy') >= {C.ENTROPY_BITS}"
            for mark in ('"', "'", "`"):
                line = _where(line, f"{mark}[^{mark}\\\\]{{{C.ENTROPY_LENGTH},}}{mark}", test, f"{mark}{C.REDACTED}{mark}")
        elif name == "base64-blob":
            line = _where(line, f"[A-Za-z0-9+/]{{{C.BASE64_LENGTH},}}={{0,2}}", " AND ".join(has(p, "m") for p in ("[a-z]", "[A-Z]", "[0-9]")), C.REDACTED)
        else:
            line = f"regexp_replace({line}, {q(pattern)}, {q(replacement.replace('$', chr(92)))}, 'g')"
    return line


#: Lines of private-key blocks go first: b opens a block, e ends one, and a line is within if the last mark before it is b.
PEM_MARKS = f"array_to_string(list_transform(string_split(text, {LF}), lambda l: CASE WHEN regexp_matches(l, {q(C.PEM_END)}) THEN 'e' WHEN regexp_matches(l, {q(C.PEM_BEGIN)}) THEN 'b' ELSE '.' END), '')"
UNBLOCKED = f"CASE WHEN contains(text, 'PRIVATE KEY') THEN list_transform(string_split(text, {LF}), lambda l, i: CASE WHEN regexp_matches(l, {q(C.PEM_BEGIN)}) OR regexp_matches(({PEM_MARKS})[1:i - 1], 'b[.]*$') THEN {q(C.REDACTED)} ELSE l END) ELSE string_split(text, {LF}) END"
REDACTED_WHOLE = f"array_to_string(list_transform({UNBLOCKED}, lambda l: {_redact_line('l')}), {LF})"
SIZES = f"list_transform(string_split(text, {LF}), lambda l: length(l))"


def _postings(skipped: str = "") -> str:
    return f"""(SELECT token, path, count(*) AS count, list_sort(list_distinct(list(line)))[1:{C.LINES_PER_TOKEN}] AS lines
  FROM (SELECT path, line, unnest({tokens('l')}) AS token FROM (SELECT path, unnest(string_split(text, {LF})) AS l, generate_subscripts(string_split(text, {LF}), 1) AS line FROM {CODE}{skipped})) GROUP BY token, path)"""


#: Of all texts, and of those that the skip rules leave.
POSTINGS = _postings()
INDEXABLE_POSTINGS = _postings(f"""
  WHERE NOT (strlen(text) > {C.MAX_PARSE_BYTES} OR contains(text[1:{C.BINARY_CHECK_BYTES}], chr(0)) OR list_max({SIZES}) > {C.MINIFIED_MAX_LINE} OR (text <> '' AND list_sum({SIZES}) / len({SIZES})::DOUBLE > {C.MINIFIED_MEAN_LINE}))""")


def _preview(line: str, terms: list[str]) -> str:
    t = f"trim({line})"
    at = "coalesce(" + ", ".join(f"nullif(strpos(lower({t}), {q(x)}), 0) - 1" for x in terms) + ", 0)"
    return f"CASE WHEN length({t}) <= {C.PREVIEW_CHARS} THEN {t} ELSE substring({t}, greatest(0, least({at} - {C.PREVIEW_CHARS // 2}, length({t}) - {C.PREVIEW_CHARS})) + 1, {C.PREVIEW_CHARS}) END"


def _search(query: str, limit: int, postings: str = POSTINGS) -> str:
    terms = ", ".join(f"({q(t)}, {w}::DOUBLE)" for t, w in term_weights(query)[0].items())
    order = names(["symbol-exact", "symbol-prefix", "symbol-substring", "filename-exact", "filename-substring", "path-segment", "content"])
    return f"""WITH terms(term, weight) AS (VALUES {terms}),
f AS (SELECT doc_id, path, CASE WHEN doc_id % 9 = 0 THEN 'test' WHEN doc_id % 13 = 0 THEN 'fixture' ELSE 'docs' END AS classification, doc_id % 100 / 100::DOUBLE AS importance, text, lower({STEM}) AS stem, list_transform(string_split(path, '/'), lambda x: lower(x)) AS parts FROM {CODE}),
s AS (SELECT f.path, regexp_replace(p_name, ' ', '_', 'g') AS name, p_size % 2 = 0 AS ex FROM part JOIN f ON f.doc_id = p_partkey),
h AS (SELECT path, term, weight, name, ex, CASE WHEN lower(name) = term THEN 100 WHEN starts_with(lower(name), term) THEN 60 ELSE 30 END::DOUBLE AS tier FROM s JOIN terms ON contains(lower(name), term)),
h1 AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY path, term ORDER BY tier DESC, ex DESC, name) = 1),
p AS (
  SELECT path, term, weight, tier + CASE WHEN ex THEN 8 ELSE 0 END AS points, CASE tier WHEN 100 THEN 'symbol-exact' WHEN 60 THEN 'symbol-prefix' ELSE 'symbol-substring' END AS kind, name, NULL::BIGINT[] AS lines FROM h1
  UNION ALL SELECT path, term, weight, CASE WHEN stem = term THEN 45 ELSE 20 END, CASE WHEN stem = term THEN 'filename-exact' ELSE 'filename-substring' END, NULL, NULL FROM f JOIN terms ON contains(stem, term)
  UNION ALL SELECT path, term, weight, 15, 'path-segment', NULL, NULL FROM f JOIN terms ON list_contains(parts, term)
  UNION ALL SELECT path, term, weight, least(4 * log2(1::DOUBLE + count), 24), 'content', NULL, lines FROM {postings} JOIN terms ON token = term),
g AS (SELECT path, sum(points * weight) AS total, list_filter({order}, lambda k: list_contains(list(kind), k)) AS kinds, arg_max(name, term) FILTER (name IS NOT NULL) AS best_symbol, list_sort(list_distinct(flatten(list(lines) FILTER (lines IS NOT NULL))))[1:5] AS lines FROM p GROUP BY path)
SELECT g.path, round(greatest(total + 25 * importance + CASE classification WHEN 'test' THEN -20 WHEN 'fixture' THEN -15 ELSE 0 END, 0), 3) AS score, kinds, best_symbol, g.lines, f.text
FROM g JOIN f ON g.path = f.path ORDER BY score DESC, importance DESC, g.path LIMIT {limit}"""


EXCLUDED = " OR ".join([f"list_contains({names(C.EXCLUDED_EXTENSIONS)}, {EXT})", *(f"regexp_matches({BASENAME}, {q(p)})" for p in C.EXCLUDED_BASENAMES), f"regexp_matches(path, {q(glob_regex('app/**'))})"])
IGNORED = f"list_has_any(string_split(path, '/'), {names(C.IGNORED_DIRS)}) OR " + " OR ".join(f"regexp_matches(path, {q(ignore_regex(g))})" for g in C.IGNORED_GLOBS)
BUDGET = f"""SELECT source, doc_id, size, place, bytes_so_far::BIGINT AS bytes_so_far FROM (
  SELECT *, count(*) OVER w AS place, sum(size) OVER w AS bytes_so_far FROM (SELECT DISTINCT d.source, d.doc_id, l.quality, least(strlen(coalesce(d.text, '')), {C.SNIPPET_BYTES})::BIGINT AS size FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) l ON l.doc_id = d.doc_id)
  WINDOW w AS (PARTITION BY source ORDER BY quality DESC, doc_id ROWS UNBOUNDED PRECEDING)) WHERE place <= {C.BUDGET_FILES} AND bytes_so_far <= {C.BUDGET_BYTES}"""
NPM = list(C.DEPENDENCY_ROLES)[:25]
_role = "CASE name " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in C.DEPENDENCY_ROLES.items()) + " END"
_probes = names([*C.PROBE_SUFFIXES, *C.INDEX_SUFFIXES])
_order = "is_parsed DESC, importance DESC, in_degree DESC, line_count DESC, path, id"
_mixed = "['./', '/', '././', '../'][page_id % 4 + 1] || CASE WHEN page_id % 3 = 0 THEN replace(path, '/', chr(92)) ELSE path END"
_globs = ["src/*.ts", "**/*.md", "app/p?ges/**", "*useThing*"]
_spaces = ["packages/*", "packages/**", "src/*/*"]

ORACLES: dict[str, str] = {
    "language_stats": f"SELECT language, file_count, line_count, round(100.0::DOUBLE * file_count / sum(file_count) OVER (), 1) AS share_percent FROM (SELECT coalesce(lang, 'other') AS language, count(*) AS file_count, sum({n_lines('text')})::BIGINT AS line_count FROM {CODE} GROUP BY 1)",
    "content_hash": f"SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS n_copies FROM {CODE} GROUP BY 1",
    "line_stats": f"SELECT doc_id, {n_lines('text')} AS line_count, list_max({SIZES}) AS longest, CASE WHEN text = '' THEN 0 ELSE round(list_sum({SIZES}) / len({SIZES})::DOUBLE, 6) END AS mean FROM {CODE}",
    "skip_reason": f"""SELECT skip_reason, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, CASE WHEN strlen(text) > {C.MAX_PARSE_BYTES} THEN 'too-large' WHEN list_max({SIZES}) > {C.MINIFIED_MAX_LINE} OR (text <> '' AND list_sum({SIZES}) / len({SIZES})::DOUBLE > {C.MINIFIED_MEAN_LINE}) THEN 'minified'
  WHEN NOT lang <> 'fr' THEN 'unsupported-language' END AS skip_reason FROM {CODE}) GROUP BY 1""",
    "path_parts": f"SELECT id, path, {BASENAME} AS basename, {DIRNAME} AS dirname, {EXT} AS ext, {STEM} AS stem, len(string_split(path, '/'))::BIGINT AS n_segments, CASE WHEN {SLUG} = '' THEN 'root' ELSE {SLUG} END AS slug FROM {FILES}",
    "ignore_rules": f"SELECT id, path FROM {FILES} WHERE NOT ({IGNORED})",
    "normalize_path": f"SELECT page_id, regexp_replace(regexp_replace(replace(raw, chr(92), '/'), '^(\\./)+', ''), '^/+', '') AS normal, NOT regexp_matches(raw, '(^|/)\\.\\.(/|$)') AND NOT starts_with(raw, '/') AS is_guarded FROM (SELECT page_id, {_mixed} AS raw FROM {URL_PATHS})",
    "glob_match": "SELECT id, " + ", ".join([f"regexp_matches(path, {q(glob_regex(g))}) AS glob_{i}" for i, g in enumerate(_globs)] + [f"regexp_matches({DIRNAME}, {q(workspace_regex(g))}) AS workspace_{i}" for i, g in enumerate(_spaces)]) + f" FROM {FILES}",
    "classify_files": f"SELECT id, {LANGUAGE} AS language, {_class('header')} AS classification FROM (SELECT *, CASE WHEN id % 29 = 0 THEN '// x' || {LF} || '// DO NOT EDIT' ELSE '//' || {LF} || '//' || {LF} || '//' || {LF} || 'DO NOT EDIT' END AS header FROM {FILES})",
    "identifier_split": f"SELECT p_partkey, array_to_string({words('name')}, ' ') AS words, array_to_string({tokens('name')}, ' ') AS tokens FROM (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') || 'HTTPGet_' || p_size AS name FROM part)",
    "symbol_id": f"SELECT id, substring(sha1(path || '#' || name || '#' || line_count), 1, 16) AS symbol_id FROM {FILES}",
    "extract_query_terms": "SELECT conv_id, turn, array_to_string(list_filter(w, lambda x: length(x) >= 3), ' ') AS terms, array_to_string(list_filter(w, lambda x: length(x) < 3), ' ') AS dropped FROM (SELECT conv_id, turn, list_sort(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda x: x <> ''))) AS w FROM conversations WHERE role = 'user')",
    "trim_preview": f"SELECT doc_id, line, {_preview('t', ['token', 'heit', 'tion'])} AS preview FROM (SELECT doc_id, unnest(string_split(text, {LF})) AS t, generate_subscripts(string_split(text, {LF}), 1) - 1 AS line FROM {CODE})",
    "entropy_items": "SELECT item_id, round(coalesce(list_aggregate(list_filter(string_split(coalesce(text, ''), ''), lambda c: c <> ''), 'entropy'), 0), 6) AS bits, (regexp_matches(coalesce(text, ''), '[a-z]')::BIGINT + regexp_matches(coalesce(text, ''), '[A-Z]')::BIGINT + regexp_matches(coalesce(text, ''), '[0-9]')::BIGINT + regexp_matches(coalesce(text, ''), '[^A-Za-z0-9]')::BIGINT) AS n_classes FROM benchmark",
    "redact_documents": f"SELECT doc_id, sha256(r) AS redacted_sha256, r <> text AS is_changed FROM (SELECT doc_id, text, {REDACTED_WHOLE} AS r FROM {CODE})",
    "redaction_stats": " UNION ALL ".join(f"SELECT {q(n)} AS rule, sum(len(regexp_extract_all(text, {q(p)})))::BIGINT AS n_matches, count(*) FILTER (regexp_matches(text, {q(p)})) AS n_documents FROM {CODE}" for n, p, _ in C.REDACTION_RULES if p),
    "redact_idempotent": f"SELECT count(*) FILTER (r <> array_to_string(list_transform(string_split(r, {LF}), lambda l: {_redact('l')}), {LF})) AS n_unstable FROM (SELECT {REDACTED} AS r FROM {CODE})",
    "redact_file_excluded": f"SELECT id, {EXCLUDED} AS is_excluded FROM (SELECT id, path || ['', '.pem', '/.env.local', '/id_rsa.pub', '/secrets.yaml'][id % 5 + 1] AS path FROM {FILES})",
    "citation_verify": f"""WITH a AS (SELECT conv_id * 1000 + turn AS answer_id, coalesce(text, '') || ' `./doc' || conv_id || '.md:' || (turn * 3 + 1) || '`' || CASE WHEN conv_id % 7 = 0 THEN ' `nowhere/x.md`' ELSE '' END || CASE WHEN conv_id % 11 = 0 THEN ' [[x]]' ELSE '' END || CASE WHEN conv_id % 3 = 0 THEN ' [x](doc1.md:1)' ELSE '' END AS text FROM conversations WHERE role = 'assistant'),
i AS (SELECT 'doc' || doc_id || '.md' AS path, {n_lines('text')} AS n FROM {CODE}),
c AS (SELECT answer_id, regexp_replace(regexp_replace(regexp_extract(c, '([A-Za-z0-9_@./-]+\\.[A-Za-z0-9]+)(?::([0-9]+))?', 1), '^(\\./)+', ''), '^/+', '') AS path, try_cast(regexp_extract(c, '([A-Za-z0-9_@./-]+\\.[A-Za-z0-9]+)(?::([0-9]+))?', 2) AS INT) AS line
  FROM (SELECT answer_id, unnest(list_concat(regexp_extract_all(text, '`([A-Za-z0-9_@./-]+\\.[A-Za-z0-9]+)(?::([0-9]+))?`'), regexp_extract_all(text, '\\]\\(([A-Za-z0-9_@./-]+\\.[A-Za-z0-9]+)(?::([0-9]+))?\\)'))) AS c FROM a)),
v AS (SELECT answer_id, count(*) AS n_cited, bool_and(n IS NOT NULL AND (line IS NULL OR line BETWEEN 1 AND n)) AS ok FROM c LEFT JOIN i USING (path) GROUP BY answer_id)
SELECT answer_id, coalesce(n_cited, 0) AS n_cited, coalesce(ok, false) AND NOT contains(text, '[[') AS is_valid FROM a LEFT JOIN v USING (answer_id)""",
    "snippet_budget": BUDGET,
    "agg_sent_bytes": f"SELECT source, count(*) AS n_sent, sum(size)::BIGINT AS n_bytes FROM ({BUDGET}) GROUP BY source",
    "token_index": f"SELECT token, path, count, array_to_string(lines, ',') AS lines FROM {POSTINGS}",
    "token_top": f"SELECT token, sum(count)::BIGINT AS n, count(*) AS n_files FROM {POSTINGS} GROUP BY token ORDER BY n DESC, token LIMIT 50",
    "keyword_search": f"SELECT path, score, array_to_string(kinds, ',') AS match_kinds, best_symbol, coalesce(array_to_string(lines, ','), '') AS lines FROM ({_search('token config widget x1 the', 50)})",
    "search_previews": f"SELECT path, line, {_preview('l', ['the', 'token'])} AS preview FROM (SELECT path, line, string_split(text, {LF})[line] AS l FROM (SELECT path, text, unnest(lines) AS line FROM ({_search('token the', 20)}) WHERE lines IS NOT NULL))",
    "dir_rollup": f"SELECT dir AS path, count(*) FILTER (d = dir) AS file_count, count(*) AS descendant_file_count FROM (SELECT {DIRNAME} AS d, unnest({ANCESTORS}) AS dir FROM {URL_PATHS}) GROUP BY dir",
    "dir_dominant": f"SELECT dir, classification AS dominant, n FROM (SELECT {DIRNAME} AS dir, classification, count(*) AS n FROM {FILES_PLUS} GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, classification) = 1",
    "nearest_ancestor": f"WITH u AS (SELECT DISTINCT path FROM {URL_PATHS}), x AS (SELECT path, unnest({ANCESTORS}) AS dir FROM u) SELECT path, arg_max(dir, length(dir)) || '/conf.json' AS config FROM x WHERE dir <> '' AND length(dir) % 2 = 0 GROUP BY path",
    "module_assign": f"WITH {_modules(['', 'packages'], C.MAX_MODULES)} SELECT path, module FROM assigned",
    "module_counts": f"WITH {_modules([''], 10)} SELECT module, count(*) AS file_count FROM assigned WHERE module IS NOT NULL GROUP BY module",
    "module_edges": f"WITH {_modules([''], C.MAX_MODULES)} SELECT DISTINCT x.module AS from_module, y.module AS to_module FROM {EDGES} e JOIN f a ON a.id = e.src JOIN f b ON b.id = e.dst JOIN assigned x ON x.path = a.path JOIN assigned y ON y.path = b.path WHERE x.module <> y.module",
    "workspace_shares": f"SELECT dir, n FROM (SELECT *, sum(n) OVER () AS kept, count(*) OVER () AS k FROM (SELECT *, max(n) OVER () AS m, sum(n) OVER () AS t FROM (SELECT split_part(path, '/', 1) AS dir, count(*) AS n FROM {FILES} GROUP BY 1)) WHERE n * 5 >= m) WHERE k >= 2 AND kept * 2 >= t",
    "entry_points": f"SELECT path, priority, row_number() OVER (ORDER BY priority, path) AS rank FROM (SELECT DISTINCT path, CASE lower({STEM}) WHEN 'main' THEN 1 WHEN 'index' THEN 2 WHEN 'app' THEN 3 WHEN 'server' THEN 3 WHEN 'cli' THEN 4 END::BIGINT AS priority FROM {FILES}) WHERE priority IS NOT NULL",
    "degree": f"SELECT id, in_degree, out_degree FROM {DEG}",
    "adjacency": f"SELECT id, coalesce(o, '') AS out_links, coalesce(i, '') AS in_links FROM (SELECT src AS id, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS o FROM {EDGES} GROUP BY src) FULL JOIN (SELECT dst AS id, string_agg(src::VARCHAR, ',' ORDER BY src) AS i FROM {EDGES} GROUP BY dst) USING (id)",
    "orphans": f"SELECT id FROM {DEG} WHERE in_degree = 0 AND out_degree = 0",
    "distinct_edges": "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) = 1",
    "pagerank_fixed": _pagerank(EDGES, 10, 0),
    "pagerank_converged": _pagerank(f"(SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM {EDGES})"),
    "scc": f"WITH RECURSIVE {_scc(EDGES)} SELECT id, component FROM scc",
    "component_count": f"WITH RECURSIVE {_scc(LAYERED)} SELECT count(DISTINCT component) AS n_components FROM scc",
    "cycles_summary": f"WITH RECURSIVE {_scc(LAYERED)} SELECT row_number() OVER (ORDER BY edge_count DESC, component) AS cycle_rank, component, size, edge_count FROM (SELECT component, count(*) AS size FROM scc GROUP BY component HAVING count(*) > 1) JOIN (SELECT x.component, count(*) AS edge_count FROM e JOIN scc x ON x.id = e.src JOIN scc y ON y.id = e.dst WHERE x.component = y.component GROUP BY x.component) USING (component)",
    "condense_dag": f"WITH RECURSIVE {_scc(LAYERED)}, rep AS (SELECT component, id AS rep FROM scc JOIN {_ranked(LAYERED)} USING (id) QUALIFY row_number() OVER (PARTITION BY component ORDER BY importance DESC, id) = 1), o AS (SELECT id, rep FROM scc JOIN rep USING (component)) SELECT DISTINCT x.rep AS src, y.rep AS dst FROM e JOIN o x ON x.id = e.src JOIN o y ON y.id = e.dst WHERE x.rep <> y.rep",
    "bfs_layers": f"WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM {LAYERED}), b AS (SELECT id, 0 AS d FROM {FILES} WHERE id % 500 = 10 UNION SELECT e.dst, b.d + 1 FROM b JOIN e ON e.src = b.id WHERE b.d < 60) SELECT id, least(min(d), 4)::BIGINT AS layer FROM b GROUP BY id",
    "importance_rank": f"SELECT id, importance, row_number() OVER (ORDER BY {_order}) AS importance_rank FROM {RANKED}",
    "top_important_files": f"SELECT id, path, importance FROM {RANKED} ORDER BY {_order} LIMIT {C.TOP_FILES}",
    "top_key_files": f"WITH {_modules(['', 'packages'], C.MAX_MODULES)} SELECT module, rank, path FROM (SELECT module, r.path, row_number() OVER (PARTITION BY module ORDER BY importance DESC, r.path, id) AS rank FROM {RANKED} r JOIN (SELECT DISTINCT path, module FROM assigned WHERE module IS NOT NULL) a ON a.path = r.path) WHERE rank <= 5",
    "join_file_metrics": f"SELECT id, path, language, classification, in_degree, out_degree, importance, coalesce(n, 0) AS symbol_count FROM {RANKED} LEFT JOIN (SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1) USING (id)",
    "external_importers": "SELECT l_returnflag AS ecosystem, l_suppkey::VARCHAR AS package, count(DISTINCT l_partkey) AS n_importers, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS importers FROM (SELECT DISTINCT l_returnflag, l_suppkey, l_partkey FROM lineitem) GROUP BY 1, 2",
    "dependency_usage": f"WITH d AS (SELECT DISTINCT 'npm' AS ecosystem, {names(NPM)}[s_suppkey * 3 % 25 + 1] AS name FROM supplier), u AS (SELECT {names(NPM)}[l_suppkey % 25 + 1] AS name, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) SELECT ecosystem, name, coalesce(n, 0) AS imported_by_count, {_role} AS role FROM d LEFT JOIN u USING (name)",
    "probe_suffixes": f"WITH f AS (SELECT id, path, regexp_replace(path, '\\.[a-z]+$', '') AS base FROM {FILES}), c AS (SELECT id, base || unnest({_probes}) AS p, generate_subscripts({_probes}, 1) AS pos FROM f) SELECT f.id AS import_id, f.base, t.to_path FROM f LEFT JOIN (SELECT c.id, arg_min(c.p, c.pos) AS to_path FROM c WHERE c.p IN (SELECT path FROM f) GROUP BY c.id) t ON t.id = f.id",
    "semi_changed": "SELECT doc_id AS path, sha256(coalesce(text, '')) AS content_hash FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0",
    "anti_orphaned": "SELECT doc_id AS path, source FROM documents WHERE doc_id % 4 = 1",
    "upsert_cache": "SELECT doc_id AS path, lang, CASE WHEN doc_id % 6 = 2 THEN 2 ELSE 1 END::BIGINT AS version FROM documents",
    "replaced_rows": "SELECT doc_id AS path, lang, CASE WHEN doc_id % 50 = 7 THEN 2 ELSE 1 END::BIGINT AS version FROM documents WHERE doc_id % 50 <> 11",
    "stored_cache_hits": "SELECT doc_id AS path, sha256(coalesce(text, '')) AS content_hash, CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 0 THEN 'hit' ELSE 'miss' END AS state FROM documents UNION ALL SELECT -1 - doc_id, sha256(coalesce(text, '')), 'gone' FROM documents",
    "delete_cascade": "SELECT conv_id, turn, role FROM conversations WHERE conv_id % 5 <> 0",
    "reconcile_diff": "SELECT coalesce(l.id, t.id) AS id, CASE WHEN l.id IS NULL THEN 'add' ELSE 'remove' END AS change FROM (SELECT DISTINCT o_custkey AS id FROM orders) l FULL JOIN (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 5000) t ON l.id = t.id WHERE l.id IS NULL OR t.id IS NULL",
    "consecutive_pairs": "SELECT * FROM (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, lead(l_partkey) OVER w AS next_part, lag(l_partkey) OVER w AS previous_part FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)) WHERE next_part IS NOT NULL",
    "minmax_normalise": "SELECT p_partkey, round(coalesce((p_retailprice - min(p_retailprice) OVER ()) / nullif(max(p_retailprice) OVER () - min(p_retailprice) OVER (), 0), 0), 6) AS scaled FROM part",
    "bench_percentiles": "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS largest FROM events GROUP BY event_type",
    "rate_limit_offered": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n_offered FROM events",
    "debounce_latest": "SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events) WHERE after IS NULL OR after - ts >= INTERVAL 1800 SECONDS",
    "windowed_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "session_counts": "SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS g FROM events)) GROUP BY 1, 2) GROUP BY user_id",
    "incremental_index": f"SELECT token, path, count, array_to_string(lines, ',') AS lines FROM {INDEXABLE_POSTINGS}",
    "stored_search": f"SELECT path, score, array_to_string(kinds, ',') AS match_kinds, best_symbol, coalesce(array_to_string(lines, ','), '') AS lines, 'x1' AS dropped_terms FROM ({_search('token config widget x1 the', 50, INDEXABLE_POSTINGS)})",
    "names_by_part": "SELECT part, name, of FROM (SELECT p_name AS name, 'part ' || p_partkey AS of FROM part UNION ALL SELECT s_name, 'supplier ' || s_suppkey FROM supplier) JOIN (VALUES ('dget'), ('%'), ('ier#00000'), ('0'), ('lu'), ('no such part'), ('Supplier#000000001')) v(part) ON contains(name, part)",
    "lookup_contains": "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'dget') OR contains(p_name, '%')",
}

_near = "regexp_replace(regexp_extract(o.path, '([^/]*)$', 1), '\\.[a-z]+$', '')"
_far = "regexp_replace(o.path, '\\.[a-z]+$', '')"
_tried = " UNION ALL ".join(f"SELECT import_id, tier * 100 + {i} AS pos, base || {q(x)} AS p FROM b2" for i, x in enumerate([*C.PROBE_SUFFIXES, *C.INDEX_SUFFIXES]))
_other_modules = f"{_modules(['', 'packages'], C.MAX_MODULES)}, am AS (SELECT DISTINCT path, module FROM assigned WHERE module IS NOT NULL)"
_purposes = "CASE lower(regexp_extract(module, '([^/]*)$', 1)) " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in C.MODULE_PURPOSES.items()) + " ELSE n || ' files; no directory convention matched.' END"
_slug = lambda x: f"CASE WHEN regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') = '' THEN 'root' ELSE regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END"
SCRIPT_PATH = "replace(path, '.', '_') || '.ts'"
_supplier = "(SELECT s_suppkey AS k, 'repo' || s_nationkey AS repo, 'repo' || s_nationkey || '/pkg' || s_suppkey || '/' AS dir FROM supplier)"
DECLARED = f"""(SELECT repo, dir || 'package.json' AS path, 'npm' AS ecosystem, {names(NPM)}[k % 25 + 1] AS name, '^' || k AS version_spec, 'runtime' AS scope FROM {_supplier} WHERE k % 4 = 0 AND k % 28 <> 0
  UNION ALL SELECT repo, dir || 'package.json', 'npm', 'jest', '*', 'dev' FROM {_supplier} WHERE k % 4 = 0 AND k % 28 <> 0
  UNION ALL SELECT repo, dir || 'requirements.txt', 'pypi', 'flask', '==2.' || k, 'runtime' FROM {_supplier} WHERE k % 4 = 1 UNION ALL SELECT repo, dir || 'requirements.txt', 'pypi', 'lib' || k, '', 'runtime' FROM {_supplier} WHERE k % 4 = 1
  UNION ALL SELECT repo, dir || 'go.mod', 'go', 'github.com/a/b' || k, 'v1.2.3', 'runtime' FROM {_supplier} WHERE k % 4 = 2 UNION ALL SELECT repo, dir || 'go.mod', 'go', 'golang.org/x/y', 'v0.1.0', 'indirect' FROM {_supplier} WHERE k % 4 = 2
  UNION ALL SELECT repo, dir || 'Cargo.toml', 'cargo', n, CASE n WHEN 'serde' THEN '1.' || k WHEN 'rand' THEN '0.8' ELSE '0.5' END, CASE n WHEN 'criterion' THEN 'dev' ELSE 'runtime' END FROM {_supplier}, (SELECT unnest(['serde', 'rand', 'criterion']) AS n) WHERE k % 4 = 3)"""
_has = lambda *x: f"coalesce(bool_or(name IN ({', '.join(map(q, x))})), false)"
ORACLES |= {
    "resolve_imports": f"""WITH f AS MATERIALIZED (SELECT id, path, {DIRNAME} AS d FROM {FILES}),
i AS (SELECT f.id AS import_id, f.d, f.path, starts_with(f.path, 'packages/api/') AS api, starts_with(f.path, 'packages/web/') AS web, (f.id // 24) % 10 AS form, {_near} AS near, {_far} AS far FROM f JOIN f o ON f.id = o.id + 24),
b AS (SELECT *, CASE form WHEN 0 THEN [d || '/' || near] WHEN 1 THEN [CASE WHEN contains(d, '/') THEN regexp_extract(d, '^(.*)/', 1) || '/' ELSE '' END || near]
  WHEN 2 THEN CASE WHEN api THEN ['packages/api/src/routes/' || substring(far, 5), 'packages/api/src/' || substring(far, 5)] ELSE ['src/' || substring(far, 5)] END WHEN 3 THEN CASE WHEN api THEN [] ELSE [far] END
  WHEN 6 THEN ['packages/web/src/' || near] WHEN 7 THEN [d || '/' || near || '/gone'] WHEN 8 THEN CASE WHEN web THEN ['packages/web/src/' || near] ELSE [] END WHEN 9 THEN CASE WHEN api THEN [] ELSE ['nowhere/' || near, 'src/utils/' || near] END ELSE [] END AS bases FROM i),
b2 AS (SELECT import_id, unnest(bases) AS base, generate_subscripts(bases, 1) AS tier FROM b),
c AS ({_tried}),
t AS (SELECT import_id, arg_min(p, pos) AS to_path FROM c WHERE p IN (SELECT path FROM f) GROUP BY import_id),
o AS (SELECT b.*, to_path, CASE WHEN to_path IS NOT NULL THEN 'edge' WHEN form IN (4, 5) OR (form IN (3, 9) AND api) THEN 'external' ELSE 'unresolved' END AS outcome FROM b LEFT JOIN t USING (import_id))
SELECT import_id, outcome, to_path, CASE WHEN outcome = 'external' THEN CASE form WHEN 4 THEN 'react' WHEN 5 THEN '@scope/pkg' WHEN 3 THEN '~' || split_part(far, '/', 1) WHEN 9 THEN 'pre-' || near || '-post' END END AS package,
  CASE WHEN outcome = 'unresolved' THEN CASE WHEN form IN (2, 3, 9) OR (form = 8 AND web) THEN 'alias-unmapped' ELSE 'no-match-on-disk' END END AS reason FROM o""",
    "resolve_python": f"""WITH f AS (SELECT id FROM {FILES}), i AS (SELECT id, 'os.path' AS specifier FROM f UNION ALL SELECT id, '..p' || id % 6 || '.' || x FROM f, (SELECT unnest(['x', 'y']) AS x) UNION ALL SELECT id, 'src.mod' || (id + 7) FROM f)
SELECT 'src/mod' || id || '.py' AS path, specifier, CASE WHEN specifier = 'os.path' THEN 'stdlib' WHEN starts_with(specifier, '.') THEN 'unresolved' WHEN id + 7 IN (SELECT id FROM f) THEN 'edge' ELSE 'external' END AS outcome,
  CASE WHEN starts_with(specifier, 'src') AND id + 7 IN (SELECT id FROM f) THEN 'src/mod' || (id + 7) || '.py' END AS to_path, CASE WHEN specifier = 'os.path' THEN 'os' WHEN starts_with(specifier, 'src') AND id + 7 NOT IN (SELECT id FROM f) THEN 'src' END AS package FROM i""",
    "neighborhood": f"SELECT src AS id, 'out' AS direction, dst AS neighbour FROM {EDGES} UNION ALL SELECT dst, 'in', src FROM {EDGES}",
    "collapse_edges": f"WITH s AS (SELECT id, CASE WHEN starts_with(path, 'src/') THEN 'src' WHEN starts_with(path, 'packages/api/') THEN 'packages/api' WHEN starts_with(path, 'docs/') THEN 'docs' ELSE path END AS shown FROM {FILES}) SELECT a.shown AS from_shown, b.shown AS to_shown, count(*) AS n_edges FROM {EDGES} e JOIN s a ON a.id = e.src JOIN s b ON b.id = e.dst WHERE a.shown <> b.shown GROUP BY 1, 2",
    "rank_steps": f"""WITH r AS MATERIALIZED (SELECT id, path, row_number() OVER (ORDER BY {_order}) AS importance_rank FROM {RANKED}),
d AS (SELECT src AS id, (min({{'p': path, 'i': r.id}})).i AS x FROM {EDGES} e JOIN r ON r.id = e.dst GROUP BY src), u AS (SELECT dst AS id, (min({{'p': path, 'i': r.id}})).i AS x FROM {EDGES} e JOIN r ON r.id = e.src GROUP BY dst)
SELECT r.id, importance_rank, lead(r.id) OVER (ORDER BY importance_rank) AS next_id, lag(r.id) OVER (ORDER BY importance_rank) AS previous_id, d.x AS first_dependency, u.x AS first_dependent FROM r LEFT JOIN d ON d.id = r.id LEFT JOIN u ON u.id = r.id""",
    "depth_budget": f"SELECT greatest(coalesce(max(depth) FILTER (shown <= 60), 1), 1)::BIGINT AS depth FROM (SELECT depth, sum(n) OVER (ORDER BY depth) AS shown FROM (SELECT len(string_split(dir, '/')) AS depth, count(DISTINCT dir) AS n FROM (SELECT unnest({ANCESTORS}) AS dir FROM {URL_PATHS}) WHERE dir <> '' GROUP BY 1))",
    "stored_index": f"SELECT token, path, count, array_to_string(lines, ',') AS lines FROM {POSTINGS} WHERE token IN ('token', 'config', 'the', 'x1y')",
    "ask_fallback": f"SELECT path, place FROM (SELECT path, row_number() OVER (ORDER BY {_order}) AS place FROM {RANKED}) WHERE place <= {C.TOP_FILES}",
    "dominant_module": f"WITH {_other_modules}, x AS (SELECT dir, module, count(*) AS n FROM (SELECT unnest({ANCESTORS}) AS dir, {_slug('module')} AS module FROM assigned WHERE module IS NOT NULL) GROUP BY 1, 2) SELECT dir, module FROM x QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, module) = 1",
    "largest_candidate": f"WITH {_other_modules} SELECT d AS dir, count(*) AS n FROM f WHERE is_parsed AND d IN (SELECT dir FROM cand) GROUP BY d ORDER BY n DESC, d LIMIT 1",
    "module_cards": f"""WITH {_other_modules}, r AS MATERIALIZED (SELECT id, path, row_number() OVER (ORDER BY {_order}) AS importance_rank FROM {RANKED}),
u AS (SELECT path, min(importance_rank) AS importance_rank FROM r GROUP BY path), k AS (SELECT module, string_agg(path, ',' ORDER BY n) AS key_files FROM (SELECT module, path, row_number() OVER (PARTITION BY module ORDER BY importance_rank, path) AS n FROM u JOIN am USING (path)) WHERE n <= 5 GROUP BY module),
c AS (SELECT module, count(*) AS n FROM am GROUP BY module), p AS (SELECT DISTINCT x.module AS a, y.module AS b FROM {EDGES} e JOIN r s ON s.id = e.src JOIN r t ON t.id = e.dst JOIN am x ON x.path = s.path JOIN am y ON y.path = t.path WHERE x.module <> y.module),
o AS (SELECT a AS module, string_agg({_slug('b')}, ',' ORDER BY b) AS x FROM p GROUP BY a), i AS (SELECT b AS module, string_agg({_slug('a')}, ',' ORDER BY a) AS x FROM p GROUP BY b)
SELECT module AS dir, {_slug('module')} AS id, CASE module WHEN 'other' THEN 'Other' ELSE regexp_extract(module, '([^/]*)$', 1) END AS name, CASE module WHEN 'other' THEN 'Small modules grouped together.' ELSE {_purposes} END AS purpose, n AS file_count, coalesce(key_files, '') AS key_files, coalesce(o.x, '') AS depends_on, coalesce(i.x, '') AS depended_on_by
FROM c LEFT JOIN k USING (module) LEFT JOIN o USING (module) LEFT JOIN i USING (module)""",
    "stats_counters": f"""WITH RECURSIVE {_scc(LAYERED)} SELECT * FROM (SELECT count(*) AS n_files, count(*) FILTER (is_parsed) AS n_parsed, count(*) FILTER (NOT is_parsed) AS n_skipped, sum(line_count)::BIGINT AS n_lines, sum(size_bytes)::BIGINT AS n_bytes, count(DISTINCT language) AS n_languages, count(*) FILTER (classification = 'entrypoint') AS n_entry_points FROM {FILES_PLUS}),
(SELECT count(*) AS n_symbols, count(*) FILTER (l_returnflag = 'N') AS n_unresolved FROM lineitem), (SELECT count(*) AS n_edges FROM e), (SELECT count(*) FILTER (contains(text, chr(65533))) + count(*) FILTER (list_max({SIZES}) > {C.MINIFIED_MAX_LINE}) AS n_diagnostics FROM {CODE}), (SELECT count(DISTINCT component) AS n_components FROM scc)""",
    "union_diagnostics": f"""WITH d AS (SELECT source || '/doc' || doc_id || '.md' AS path, text FROM documents) SELECT 'error' AS severity, 'FILE_UNREADABLE' AS code, path FROM d WHERE text IS NULL UNION ALL SELECT 'warning', 'ENCODING_LOSSY', path FROM d WHERE contains(text, chr(65533)) UNION ALL SELECT 'info', 'MINIFIED', path FROM d WHERE list_max({SIZES}) > {C.MINIFIED_MAX_LINE}
UNION ALL SELECT 'warning', 'MANIFEST_INVALID', dir || 'package.json' FROM {_supplier} WHERE k % 28 = 0 UNION ALL SELECT 'warning', 'PARSE_FAILED', 'src/mod' || id || '.py' FROM {FILES} WHERE id % 13 = 0""",
    "read_manifests": f"""SELECT dir || ['package.json', 'requirements.txt', 'go.mod', 'Cargo.toml'][k % 4 + 1] AS path, ['npm', 'pypi', 'go', 'cargo'][k % 4 + 1] AS ecosystem, CASE k % 4 WHEN 0 THEN CASE WHEN k % 28 <> 0 THEN 'p' || k END WHEN 2 THEN 'example.com/m' || k WHEN 3 THEN 'c' || k END AS project_name,
  CASE k % 4 WHEN 0 THEN CASE WHEN k % 28 <> 0 THEN '1.' || k END WHEN 3 THEN '0.' || k END AS version FROM {_supplier}""",
    "manifest_dependencies": f"SELECT path, ecosystem, name, version_spec, scope FROM {DECLARED}",
    "distinct_deps": f"SELECT ecosystem, name, scope, version_spec, path FROM {DECLARED} QUALIFY row_number() OVER (PARTITION BY ecosystem, name, scope ORDER BY length({DIRNAME}), path, version_spec) = 1",
    "detected_type": f"""WITH m AS (SELECT repo, bool_or(k % 4 = 0) AS npm, bool_or(k % 4 = 1) AS py FROM {_supplier} GROUP BY repo), d AS (SELECT repo, {_has('next')} AS nx, {_has('react', 'react-dom')} AS re, {_has('vue')} AS vu, {_has('flask', 'django', 'fastapi')} AS web FROM {DECLARED} GROUP BY repo),
s AS (SELECT 'repo' || n_nationkey AS repo, n_nationkey % 2 + 1 AS n FROM nation WHERE n_nationkey % 3 = 0), a AS (SELECT repo FROM m UNION SELECT repo FROM s)
SELECT a.repo, CASE WHEN s.n > 1 THEN 'Monorepo (' || s.n || ' workspaces)' WHEN npm THEN CASE WHEN nx THEN 'Next.js application' WHEN re THEN 'React application' WHEN vu THEN 'Vue application' ELSE 'Node.js service' END WHEN py THEN CASE WHEN web THEN 'Python web application' ELSE 'Python package' END ELSE 'Unknown project type' END AS label
FROM a LEFT JOIN m USING (repo) LEFT JOIN d USING (repo) LEFT JOIN s USING (repo)""",
    "script_imports": f"""SELECT {SCRIPT_PATH} AS path, CASE n WHEN 1 THEN './m' || size_bytes WHEN 2 THEN '../t' || id % 7 WHEN 3 THEN 'pkg-' || id % 5 || '/sub' WHEN 4 THEN 'lib' || id % 3 ELSE './lazy' || id % 4 END AS specifier, [2, 6, 8, 9, 12][n]::BIGINT AS line, ['static', 'type', 'reexport', 'require', 'dynamic'][n] AS kind, n = 2 AS is_type_only FROM {FILES}, (SELECT unnest(range(1, 6)) AS n)""",
    "script_symbols": f"""SELECT {SCRIPT_PATH} AS path, CASE n WHEN 1 THEN 'q' WHEN 2 THEN 'K' || id WHEN 3 THEN 'run' ELSE 'use' || replace(brand, '#', '') END AS name, ['const', 'class', 'method', 'hook'][n] AS kind, [9, 10, 11, 15][n]::BIGINT AS start_line, [9, 14, 13, 17][n]::BIGINT AS end_line, n IN (2, 4) AS is_exported, CASE WHEN n = 3 THEN 'K' || id END AS container_name FROM {FILES}, (SELECT unnest(range(1, 5)) AS n)""",
    "python_imports": f"SELECT 'src/mod' || id || '.py' AS path, CASE n WHEN 1 THEN 'os.path' WHEN 2 THEN '..p' || id % 6 || '.x' ELSE '..p' || id % 6 || '.y' END AS specifier, [1, 2, 2][n]::BIGINT AS line, 'static' AS kind FROM {FILES}, (SELECT unnest(range(1, 4)) AS n)",
    "python_symbols": f"""SELECT 'src/mod' || id || '.py' AS path, CASE n WHEN 1 THEN 'LIMIT' WHEN 2 THEN '/items/' || id % 9 WHEN 3 THEN 'handle_' || id WHEN 4 THEN 'Thing' || id % 11 ELSE '_run' END AS name, ['const', 'route', 'function', 'class', 'method'][n] AS kind, [6, 8, 8, 13, 14][n]::BIGINT AS start_line, [6, 8, 11, 15, 15][n]::BIGINT AS end_line, n IN (1, 3, 4) AS is_exported, CASE WHEN n = 5 THEN 'Thing' || id % 11 END AS container_name FROM {FILES}, (SELECT unnest(range(1, 6)) AS n)""",
    "module_guards": f"SELECT 'src/mod' || id || '.py' AS path FROM {FILES} WHERE id % 8 = 0",
    "throttle_progress": """WITH RECURSIVE e AS MATERIALIZED (SELECT event_type, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT event_type, event_id, n, us AS passed, true AS admitted FROM e WHERE n = 1 UNION ALL SELECT e.event_type, e.event_id, e.n, CASE WHEN e.us - passed >= 900000000 THEN e.us ELSE passed END, e.us - passed >= 900000000 FROM r JOIN e ON e.event_type = r.event_type AND e.n = r.n + 1)
SELECT event_type, event_id, admitted FROM r""",
    "rate_limit_admitted": """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, us, [us] AS taken, true AS admitted, NULL::BIGINT AS retry FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_id, n, us, CASE WHEN len(t) < 2 THEN list_append(t, us) ELSE t END, len(t) < 2, CASE WHEN len(t) >= 2 THEN (t[1] + 21600000000 - us) // 1000000 + 1 END
  FROM (SELECT e.*, list_filter(r.taken, lambda x: x > e.us - 21600000000) AS t FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id, event_id, admitted, retry AS retry_after_s FROM r""",
    "fingerprint": "SELECT n AS n_rows, sha256(n || ':' || s) AS fingerprint FROM (SELECT count(*) AS n, sum(('0x' || substr(sha256(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey})::VARCHAR), 1, 15))::BIGINT)::HUGEINT AS s FROM customer)",
    "truncate_content": f"WITH h AS (SELECT doc_id, array_to_string(string_split(text, {LF})[1:5], {LF}) AS h FROM {CODE}), c AS (SELECT doc_id, CASE WHEN strlen(h) <= 1000 THEN h ELSE left(h, list_max(list_filter(range(0, 1001), lambda k: strlen(left(h, k)) <= 1000))) END AS c FROM h) SELECT doc_id, strlen(c) AS n_bytes, sha256(c) AS cut_sha256 FROM c",
}

_synonyms = ", ".join(f"({q(k)}, {q(x)})" for k, v in C.KEYWORDS.items() for x in v)
ORACLES |= {
    "keyword_expand": f"""WITH w AS (SELECT event_type AS query FROM events UNION SELECT p_name || ' config' FROM part),
t AS (SELECT DISTINCT query, unnest(string_split_regex(lower(query), '[^a-z0-9_]+')) AS term FROM w), k(term, synonym) AS (VALUES {_synonyms})
SELECT query, term, max(weight) AS weight FROM (SELECT query, term, 1::DOUBLE AS weight FROM t WHERE length(term) >= 3 UNION ALL SELECT query, synonym, 0.6::DOUBLE FROM t JOIN k USING (term) WHERE length(t.term) >= 3) GROUP BY query, term""",
    "cache_hits": "SELECT doc_id AS path, sha256(coalesce(text, '')) AS content_hash FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0",
    "document_fingerprint": "SELECT c_custkey, sha256(to_json({'c_custkey': c_custkey, 'c_mktsegment': c_mktsegment, 'c_name': c_name, 'fingerprint': ''})::VARCHAR) AS fingerprint FROM customer",
    "canonical_json": "SELECT c_custkey, to_json({'c_at': {'c_calls': [c_mktsegment, NULL], 'c_nationkey': c_nationkey}, 'c_custkey': c_custkey, 'c_mktsegment': CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END, 'c_name': c_name})::VARCHAR AS json FROM customer",
    "internal_edges": f"WITH f AS (SELECT id, {DIRNAME} AS d FROM {FILES}) SELECT a.d AS component, count(*) AS edge_count FROM {EDGES} e JOIN f a ON a.id = e.src JOIN f b ON b.id = e.dst WHERE a.d = b.d GROUP BY a.d",
}
