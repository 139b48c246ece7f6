"""DuckDB SQL for the same results as ``assayer.plans.queries``."""

from __future__ import annotations

import keyword

from assayer.plans.queries import CAP, DICE, MAXIMUM, ORIGINALS, SEED, STATUS_OF, WINDOW


def part(x: str) -> str:
    return f"unhex(lpad(hex(octet_length(encode({x}))), 16, '0')) || encode({x})"


def stable_id(rule: str, path: str, symbol: str, evidence: str) -> str:
    return "sha256(" + " || ".join(part(x) for x in (rule, path, symbol, evidence)) + ")"


def choose(index: str, values: tuple[str, ...]) -> str:
    return f"(CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END)"


EVENT_LINES = "lines AS (SELECT CAST(user_id AS VARCHAR) AS file, day(ts) * 24 + hour(ts) AS line, SUM(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS hits FROM events GROUP BY 1, 2)"


def day_functions(width: int) -> str:
    return f"f AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS file, day(ts) AS d, CAST(user_id AS VARCHAR) || '#' || day(ts) AS function_id, day(ts) * 24 AS s, day(ts) * 24 + {width - 1} AS e, day(ts) % 7 + 1 AS c FROM events)"


OWNED = "owned AS (SELECT f.function_id, f.file, l.line, l.hits FROM f JOIN lines l ON l.file = f.file AND l.line BETWEEN f.s AND f.e WHERE NOT (l.line > f.s + 5 AND l.line < f.s + 8))"
SHARED = "shared AS (SELECT DISTINCT o.function_id FROM owned o JOIN (SELECT file, line FROM owned GROUP BY 1, 2 HAVING COUNT(*) > 1) x USING (file, line))"
APPLIED = f"""WITH {EVENT_LINES}, {day_functions(24)}, {OWNED}, {SHARED},
edge AS (SELECT DISTINCT f.function_id FROM f JOIN lines l ON l.file = f.file AND (l.line = f.s + 5 OR l.line = f.s + 8) WHERE l.line BETWEEN f.s AND f.e),
n AS (SELECT function_id, SUM(CASE WHEN hits > 0 THEN 1 ELSE 0 END) AS covered, COUNT(*) AS executable FROM owned GROUP BY 1),
a AS (SELECT f.function_id, f.c, COALESCE(n.covered, 0) AS covered, COALESCE(n.executable, 0) AS executable,
  CASE WHEN f.file NOT IN (SELECT file FROM lines) THEN 'unmatched-file' WHEN f.function_id IN (SELECT function_id FROM edge) OR f.function_id IN (SELECT function_id FROM shared) THEN 'ambiguous'
  WHEN n.executable IS NULL THEN 'empty-range' ELSE 'matched' END AS reason FROM f LEFT JOIN n USING (function_id)),
p AS (SELECT *, CASE WHEN reason = 'matched' THEN 100.0::DOUBLE * covered / executable END AS cov FROM a)"""

GRAPH = """g0 AS (SELECT s.s_nationkey AS a, c.c_nationkey AS b, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey GROUP BY 1, 2),
dep AS (SELECT x.n_name AS package, y.n_name AS dependency, CASE WHEN n > 1.3 * (SELECT AVG(n) FROM g0) THEN 'production' ELSE 'development' END AS scope, x.n_regionkey = y.n_regionkey AS gated, x.n_regionkey AS ra, y.n_regionkey AS rb FROM g0 JOIN nation x ON a = x.n_nationkey JOIN nation y ON b = y.n_nationkey),
prod AS (SELECT DISTINCT package, dependency, ra, rb FROM dep WHERE scope = 'production' AND NOT gated)"""
COUPLED = f"""{GRAPH}, ca AS (SELECT dependency AS name, COUNT(DISTINCT package) AS n FROM prod GROUP BY 1), ce AS (SELECT package AS name, COUNT(DISTINCT dependency) AS n FROM prod GROUP BY 1),
cp AS (SELECT n_name AS name, COALESCE(ca.n, 0) AS afferent, COALESCE(ce.n, 0) AS efferent FROM nation LEFT JOIN ca ON ca.name = n_name LEFT JOIN ce ON ce.name = n_name),
ci AS (SELECT *, CASE WHEN afferent + efferent = 0 THEN 0.0::DOUBLE ELSE efferent::DOUBLE / (afferent + efferent) END AS instability FROM cp)"""

STATUS = "CASE l_returnflag || l_linestatus " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_OF.items()) + " ELSE 'ignored' END"
ORIGINAL = choose(f"l_linenumber % {len(ORIGINALS)}", ORIGINALS)
MUTANTS = f"m AS (SELECT l_orderkey, l_linenumber, l_suppkey, {STATUS} AS status, {ORIGINAL} AS original FROM lineitem)"
COUNTS = ", ".join(f"SUM(CASE WHEN status = '{s}' THEN 1 ELSE 0 END)::BIGINT AS {s.replace('-', '_')}" for s in ("killed", "survived", "no-coverage", "compile-error", "runtime-error", "timeout", "ignored", "invalid", "pending"))
FAMILY = "CASE WHEN original IN ('true') THEN 'boolean-literal' WHEN original IN ('==', '<') THEN 'comparison' WHEN original IN ('&&', 'or') THEN 'logical' ELSE 'arithmetic' END"

WORDS = r"w AS (SELECT CAST(doc_id AS VARCHAR) AS file, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS t FROM documents)"
ENCODE = "array_to_string(list_transform({0}, lambda v: octet_length(encode(v)) || ':' || v), '')"
WINDOWS = f"""{WORDS}, s0 AS (SELECT file, t, unnest(range(0, len(t) - {WINDOW} + 1)) AS start FROM w WHERE len(t) >= {WINDOW}),
win AS MATERIALIZED (SELECT file, start, sha256({ENCODE.format(f"t[start + 1 : start + {WINDOW}]")}) AS key FROM s0)"""
REGIONS = f"""{WINDOWS}, cap AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY file, start) AS place FROM win) WHERE place <= {CAP}),
seed AS (SELECT a.file AS file_l, a.start AS start_l, b.file AS file_r, b.start - a.start AS shift FROM cap a JOIN cap b ON a.key = b.key AND a.place < b.place),
lane AS (SELECT DISTINCT file_l, file_r, shift FROM seed),
met AS (SELECT file_l, file_r, shift, x.start AS start_l FROM lane JOIN win x ON x.file = file_l JOIN win y ON y.file = file_r AND y.start = x.start + shift AND y.key = x.key),
isl AS (SELECT *, start_l - ROW_NUMBER() OVER (PARTITION BY file_l, file_r, shift ORDER BY start_l) AS island FROM met),
reg AS (SELECT file_l, file_r, shift, MIN(start_l) AS start_l, CAST(COUNT(*) + {WINDOW - 1} AS INTEGER) AS token_count FROM isl GROUP BY file_l, file_r, shift, island)"""
CLASSES = "cl AS (SELECT file, t, MIN(file) OVER (PARTITION BY t) AS representative FROM w)"
SHINGLES = f"""{WORDS}, {CLASSES}, h0 AS (SELECT file, len(t) - 3 AS total, t, unnest(range(0, len(t) - 3)) AS s FROM cl WHERE len(t) >= 4 AND file = representative),
h AS MATERIALIZED (SELECT file, total, sha256({ENCODE.format("t[s + 1 : s + 4]")}) AS shingle, COUNT(*) AS c FROM h0 GROUP BY 1, 2, 3),
pairs AS (SELECT a.file AS l, b.file AS r, 2.0::DOUBLE * SUM(LEAST(a.c, b.c)) / (a.total + b.total) AS similarity FROM h a JOIN h b ON a.shingle = b.shingle AND a.file < b.file GROUP BY a.file, b.file, a.total, b.total),
near AS (SELECT * FROM pairs WHERE similarity >= {DICE})"""

TURNS = "c AS (SELECT 'conv/' || conv_id AS file, 'c' || conv_id AS owner, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS refs FROM conversations)"
COHESION = f"""{TURNS}, sz AS (SELECT file, owner, COUNT(*) AS functions FROM c GROUP BY 1, 2),
rf AS (SELECT file, turn, unnest(refs) AS ref FROM c), ok AS (SELECT * FROM rf WHERE ref NOT IN ('self', 'default', 'none', 'some', 'option', 'result') OR ref IN ('none', 'some', 'option', 'result')),
pr AS (SELECT DISTINCT a.file, a.turn AS l, b.turn AS r FROM ok a JOIN ok b ON a.file = b.file AND a.ref = b.ref AND a.turn < b.turn),
rl AS (SELECT file, COUNT(*) AS related FROM pr GROUP BY 1),
co AS (SELECT sz.file, owner, functions, COALESCE(related, 0) AS related, CASE WHEN functions < 2 THEN 1.0::DOUBLE ELSE COALESCE(related, 0) / (functions * (functions - 1) / 2.0::DOUBLE) END AS cohesion FROM sz LEFT JOIN rl USING (file))"""

ORDER_F = "fo AS (SELECT 'o/' || l_orderkey AS file, COUNT(*)::DOUBLE AS complexity, MAX(l_linenumber)::DOUBLE AS nesting, CAST(SUM(l_quantity) AS BIGINT)::DOUBLE AS statements, COUNT(DISTINCT l_returnflag || l_linestatus)::DOUBLE AS parameters FROM lineitem GROUP BY l_orderkey)"
KISS = f"""{ORDER_F}, k AS (
SELECT 'kiss.cyclomatic-complexity' AS rule_id, file, complexity AS measured, 5.0::DOUBLE AS allowed, 'cyclomatic-complexity-v1' AS ev FROM fo UNION ALL
SELECT 'kiss.nesting-depth', file, nesting, 5.0, 'nesting-depth-v1' FROM fo UNION ALL SELECT 'kiss.function-statements', file, statements, 60.0, 'recursive-statements-v1' FROM fo UNION ALL
SELECT 'kiss.parameter-count', file, parameters, 2.0, 'parameter-count-v1' FROM fo),
kr AS (SELECT rule_id, {stable_id("rule_id", "file", "'f'", "ev")} AS violation_id, file, 'f' AS stable_symbol, measured, allowed, CASE WHEN measured > allowed THEN 'fail' ELSE 'pass' END AS result, GREATEST(measured - allowed, 0.0) AS excess FROM k)"""


def yearly(year: int) -> str:
    return f"""(SELECT {stable_id("'load.orders'", "'c/' || o_custkey", "CAST(o_custkey AS VARCHAR)", "'orders-v1'")} AS violation_id, CAST(o_custkey AS VARCHAR) AS stable_symbol, n::DOUBLE AS measured,
    CASE WHEN n > 1 THEN 'fail' ELSE 'pass' END AS result, GREATEST(n - 1, 0)::DOUBLE AS excess FROM (SELECT o_custkey, COUNT(*) AS n FROM orders WHERE year(o_orderdate) = {year} GROUP BY 1))"""


URL = "regexp_extract(url, '//(.*)$', 1)"
URI = "replace(replace(url_encode({0}), '%2F', '/'), '%3A', ':')"
SYMBOL = "'crate::m' || s_nationkey || '::Type.' || replace(s_name, '#', '_')"

ORACLE_SQL: dict[str, str] = {
    "crap_score": "SELECT l_orderkey, l_linenumber, ROUND(l_linenumber::DOUBLE * l_linenumber * ((1 - l_discount * 1000 / 100) * (1 - l_discount * 1000 / 100) * (1 - l_discount * 1000 / 100)) + l_linenumber, 6) AS crap FROM lineitem",
    "risk_summary": "WITH s AS (SELECT ROUND(l_linenumber::DOUBLE * l_linenumber * ((1 - l_discount * 1000 / 100) * (1 - l_discount * 1000 / 100) * (1 - l_discount * 1000 / 100)) + l_linenumber, 6) AS crap FROM lineitem) SELECT SUM(CASE WHEN crap > 6.0 THEN 1 ELSE 0 END)::BIGINT AS over_threshold, SUM(CASE WHEN crap IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing_coverage, MAX(crap) AS max_score FROM s",
    "line_coverage": APPLIED + " SELECT function_id, covered::BIGINT AS covered, executable, reason, ROUND(cov, 6) AS coverage, ROUND(c::DOUBLE * c * ((1 - cov / 100) * (1 - cov / 100) * (1 - cov / 100)) + c, 6) AS crap FROM p",
    "coverage_counters": APPLIED + " SELECT SUM((reason = 'matched')::INT)::BIGINT AS matched_functions, SUM((reason = 'unmatched-file')::INT)::BIGINT AS unmatched_functions, SUM((reason = 'empty-range')::INT)::BIGINT AS empty_ranges, SUM((reason = 'ambiguous')::INT)::BIGINT AS ambiguous_functions FROM p",
    "ambiguous_lines": f"WITH {EVENT_LINES}, {day_functions(30)}, {OWNED}, {SHARED} SELECT function_id FROM shared",
    "enclosing_function": """WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS file, day(ts) * 24 + hour(ts) AS hr FROM events), z AS (SELECT unnest([6, 24, 96]) AS size),
b AS (SELECT DISTINCT file, size, hr // size AS n FROM e, z), f AS (SELECT file, n * size AS s, n * size + size - 1 AS e, size || ':' || n AS name FROM b)
SELECT event_id, name AS symbol FROM (SELECT event_id, name, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY f.e - f.s, name) AS k FROM e LEFT JOIN f ON f.file = e.file AND hr BETWEEN f.s AND f.e) WHERE k = 1""",
    "file_resolution": """WITH p AS (SELECT regexp_extract(url, '//([^/]+)', 1) AS host, regexp_extract(url, '//[^/]+/([^?#]*)', 1) AS path FROM pages),
norm AS (SELECT DISTINCT path AS file, CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '.' ELSE regexp_replace(path, '/+$', '') END AS rel FROM p),
rep AS (SELECT DISTINCT host || '/' || path AS reported FROM p),
met AS (SELECT file, reported, CASE WHEN rel = reported THEN 1 WHEN reported = '/' || rel THEN 2 WHEN ends_with(reported, '/' || rel) OR ends_with(rel, '/' || reported) THEN 3 ELSE 4 END AS way
  FROM norm JOIN rep ON regexp_extract(rel, '[^/]*$') = regexp_extract(reported, '[^/]*$')),
k AS (SELECT *, COUNT(CASE WHEN way <= 3 THEN 1 END) OVER (PARTITION BY file) AS ns, COUNT(*) OVER (PARTITION BY file) AS nb, MIN(way) OVER (PARTITION BY file) AS best FROM met)
SELECT file, reported FROM k WHERE way = best AND (way <= 2 OR (way = 3 AND ns = 1) OR nb = 1)""",
    "lcov_round_trip": f"WITH {EVENT_LINES} SELECT 'src/' || file || '.c' AS file, line::INT AS line, hits::BIGINT AS hits FROM lines",
    "coverage_json_round_trip": f"WITH {EVENT_LINES} SELECT 'src/' || file AS file, line::INT AS line, (hits > 0)::BIGINT AS hits FROM lines",
    "coupling": f"WITH {COUPLED} SELECT name, afferent, efferent, ROUND(instability, 9) AS instability FROM ci",
    "package_cycles": f"""WITH RECURSIVE {GRAPH}, r AS (SELECT package AS a, dependency AS b FROM prod UNION SELECT r.a, p.dependency FROM r JOIN prod p ON r.b = p.package)
SELECT DISTINCT members, n FROM (SELECT x.a, string_agg(x.b, '|' ORDER BY x.b) AS members, COUNT(*)::INT AS n FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)""",
    "layer_directions": f"WITH {GRAPH} SELECT package, dependency, ra AS source_layer, rb AS target_layer, ra >= rb AS passed FROM prod",
    "forbidden_edges": f"WITH {GRAPH} SELECT package, dependency, NOT ((starts_with(package, 'NATION_1') AND ends_with(dependency, '2')) OR ends_with(package, '3')) AS passed FROM prod",
    "coupling_rules": f"""WITH {COUPLED}, r AS (SELECT 'solid.maximum-module-fan-out' AS rule_id, name, efferent::DOUBLE AS m, 12.0::DOUBLE AS a, 'package-production-fan-out-v1' AS ev FROM ci UNION ALL
SELECT 'kiss.module-dependency-count', name, efferent, 16.0, 'production-dependency-count-v1' FROM ci UNION ALL SELECT 'coupling.afferent', name, afferent, NULL, 'coupling.afferent' FROM ci UNION ALL
SELECT 'coupling.efferent', name, efferent, NULL, 'coupling.efferent' FROM ci UNION ALL SELECT 'coupling.instability', name, instability, NULL, 'coupling.instability' FROM ci)
SELECT rule_id, {stable_id("rule_id", "'crates/' || name || '/Cargo.toml'", "name", "ev")} AS violation_id, 'crates/' || name || '/Cargo.toml' AS file, name AS stable_symbol, ROUND(m, 9) AS measured, a AS allowed,
CASE WHEN m > a THEN 'fail' ELSE 'pass' END AS result, ROUND(CASE WHEN m > a THEN m - a ELSE 0 END, 9) AS excess FROM r""",
    "mutation_summary": f"WITH {MUTANTS} SELECT original, {COUNTS}, COUNT(*) AS total FROM m GROUP BY 1",
    "mutation_score": f"WITH {MUTANTS} SELECT l_suppkey, SUM((status = 'killed')::INT)::BIGINT AS killed, SUM((status IN ('killed', 'survived'))::INT)::BIGINT AS scoreable, ROUND(SUM((status = 'killed')::INT)::DOUBLE / NULLIF(SUM((status IN ('killed', 'survived'))::INT), 0), 9) AS score FROM m GROUP BY 1",
    "mutation_operators": f"""WITH {MUTANTS}, r AS (SELECT original, CASE original WHEN '==' THEN '!=' WHEN '<' THEN '>=' WHEN '&&' THEN '||' WHEN '+' THEN '-' WHEN 'true' THEN 'false' WHEN 'or' THEN CASE WHEN l_suppkey % 2 = 0 THEN 'and' END END AS replacement FROM m)
SELECT original, replacement, {FAMILY} AS operator, CASE WHEN original = '==' THEN 'EqualityOperator' WHEN original = '<' THEN 'RelationalOperator' WHEN original = '&&' OR (original = 'or' AND replacement IS NOT NULL) THEN 'LogicalOperator' WHEN original = '+' THEN 'ArithmeticOperator' WHEN original = 'true' THEN 'BooleanLiteral' ELSE 'GenericMutation' END AS mutator, COUNT(*) AS n FROM r GROUP BY 1, 2, 3, 4""",
    "mutant_fingerprints": f"""WITH {MUTANTS}, o AS (SELECT *, {FAMILY} AS operator, ROW_NUMBER() OVER (PARTITION BY l_suppkey, l_linenumber, original ORDER BY l_orderkey) - 1 AS k FROM m)
SELECT l_orderkey, l_linenumber, {stable_id("'mutation.fingerprint'", "'src/' || l_suppkey || '.rs'", "'f' || l_linenumber", "'[' || chr(34) || operator || chr(34) || ',' || chr(34) || original || chr(34) || ',' || chr(34) || '!=' || chr(34) || ',' || k || ']'")} AS fingerprint FROM o""",
    "seeded_selection": f"""WITH o AS (SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS fp FROM orders), k AS (SELECT o_orderkey, fp, sha256(unhex('{SEED:016X}') || {part("fp")}) AS seeded_key FROM o)
SELECT o_orderkey, seeded_key, CASE WHEN ROW_NUMBER() OVER (ORDER BY seeded_key, fp) <= {MAXIMUM} THEN 'pending' ELSE 'ignored' END AS status FROM k""",
    "exact_windows": f"WITH {WINDOWS} SELECT p.file AS file, p.start::INT AS start, occurrences, files FROM (SELECT MIN(struct_pack(file := file, start := start)) AS p, COUNT(*) AS occurrences, COUNT(DISTINCT file) AS files FROM win GROUP BY key HAVING COUNT(*) > 1)",
    "maximal_regions": f"""WITH {REGIONS} SELECT DISTINCT g.file_l, g.start_l::INT AS start_l, g.file_r, (g.start_l + g.shift)::INT AS start_r, g.token_count FROM reg g JOIN seed s ON s.file_l = g.file_l AND s.file_r = g.file_r AND s.shift = g.shift AND s.start_l BETWEEN g.start_l AND g.start_l + g.token_count - {WINDOW}
WHERE g.file_l <> g.file_r OR g.shift >= g.token_count""",
    "near_clones": f"WITH {SHINGLES} SELECT l, r, ROUND(similarity, 9) AS similarity FROM near",
    "clone_classes": f"WITH {WORDS}, {CLASSES} SELECT file, representative FROM cl",
    "clone_groups": f"""WITH RECURSIVE {SHINGLES}, lk AS (SELECT l AS a, r AS b, similarity FROM near UNION ALL SELECT representative, file, 1.0 FROM cl WHERE file <> representative AND len(t) >= 4),
e AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
lab AS (SELECT a AS node, MIN(LEAST(a, b)) AS label FROM c GROUP BY 1), m AS (SELECT label, COUNT(*)::INT AS members FROM lab GROUP BY 1), s AS (SELECT label, MIN(similarity) AS similarity FROM lk JOIN lab ON a = node GROUP BY 1)
SELECT label, members, ROUND(similarity, 9) AS similarity FROM m JOIN s USING (label)""",
    "module_cohesion": f"WITH {COHESION} SELECT file, owner, functions, related, ROUND(cohesion, 9) AS cohesion FROM co",
    "cohesion_rules": f"WITH {COHESION} SELECT 'cohesion.module' AS rule_id, {stable_id(chr(39) + 'cohesion.module' + chr(39), 'file', 'owner', chr(39) + 'qualified-owner-function-reference-graph-v1' + chr(39))} AS violation_id, file, ROUND(cohesion, 9) AS measured, CASE WHEN cohesion < 0.1 THEN 'fail' ELSE 'pass' END AS result FROM co",
    "identifier_counts": f"SELECT 'all' AS package, w AS identifier, SUM((role = 'assistant')::INT)::BIGINT AS production_references, SUM((role <> 'assistant')::INT)::BIGINT AS test_references FROM (SELECT role, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations) WHERE w NOT IN ({', '.join(repr(w) for w in keyword.kwlist)}) GROUP BY 2",
    "unused_items": f"""WITH u AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate > (SELECT CAST(MAX(l_shipdate) AS DATE) - 90 FROM lineitem)),
x AS (SELECT p_partkey FROM part WHERE p_size <= 45 AND p_partkey NOT IN (SELECT l_partkey FROM u))
SELECT 'yagni.unused-module' AS rule_id, {stable_id("'yagni.unused-module'", "'parts/' || p_partkey", "'part::' || p_partkey", "'unreferenced-production-module-v1'")} AS violation_id, 'parts/' || p_partkey AS file, 'part::' || p_partkey AS stable_symbol, (SELECT COUNT(*) FROM x) AS measured, 'fail' AS result FROM x""",
    "contract_tests": f"""WITH t AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), i AS (SELECT 'd/' || doc_id AS file, lang, CAST(doc_id AS VARCHAR) AS s, doc_id IN (SELECT doc_id FROM t) AS ok FROM documents WHERE lang IN ('en', 'de'))
SELECT {stable_id("'solid.subtype-contract-test'", "file", "s || ' for ' || lang", "lang || '|' || s || '|contract'")} AS violation_id, file, s || ' for ' || lang AS stable_symbol, ok AS measured_flag, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS result FROM i""",
    "kiss_rules": f"WITH {KISS} SELECT * FROM kr",
    "rule_summary": f"WITH {KISS} SELECT COUNT(*) AS evaluated, SUM((result = 'pass')::INT)::BIGINT AS passed, SUM((result = 'fail')::INT)::BIGINT AS failed FROM kr",
    "baseline_diff": f"""SELECT c.violation_id, c.stable_symbol, c.measured, c.result, c.excess, CASE WHEN c.result = 'pass' THEN CASE WHEN p.result = 'fail' THEN 'improved' ELSE 'not-applicable' END
WHEN p.result IS NULL THEN 'new' WHEN p.result = 'pass' OR c.excess > p.excess THEN 'worsened' WHEN c.excess < p.excess THEN 'improved' ELSE 'existing' END AS baseline FROM {yearly(1997)} c LEFT JOIN {yearly(1996)} p USING (violation_id)""",
    "baseline_resolved": f"SELECT p.violation_id, p.stable_symbol FROM {yearly(1996)} p WHERE p.result = 'fail' AND p.violation_id NOT IN (SELECT violation_id FROM {yearly(1997)} c)",
    "path_functions": f"""WITH x AS (SELECT page_id, {URL} AS u FROM pages), y AS (SELECT *, regexp_replace(regexp_replace(u, '/+', '/', 'g'), '/+$', '') AS v FROM x)
SELECT page_id, 'a/' || v AS repository, '/' || v AS report, {URI.format("u")} AS uri, {stable_id("'r'", "v", "'é'", "u")} AS id FROM y""",
    "symbol_functions": f"SELECT s_suppkey, {SYMBOL} AS bare, replace(s_name, '#', '_') AS name, 'crate::m' || s_nationkey || '::Type' AS owner, 'm' || s_nationkey || '|Type|' || replace(s_name, '#', '_') AS segments, length('m' || s_nationkey) || ':m' || s_nationkey || '4:Type' || length(s_name) || ':' || replace(s_name, '#', '_') AS encoded FROM supplier",
    "text_positions": "WITH x AS (SELECT conv_id, turn, substr(text, 1, length(text) // 2) AS b FROM conversations) SELECT conv_id, turn, (length(b) - length(replace(b, chr(10), '')) + 1)::INT AS line, (length(string_split(b, chr(10))[-1]) + 1)::INT AS \"column\" FROM x",
    "sarif_results": f"WITH {KISS} SELECT rule_id, 'warning' AS level, {URI.format('file')} AS uri, violation_id AS fingerprint FROM kr WHERE result = 'fail'",
}
