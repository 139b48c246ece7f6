"""DuckDB SQL for the same results as ``assayer.plans.rule_queries``."""

from __future__ import annotations

from assayer.plans.sql import EVENT_LINES, GRAPH, MUTANTS, ORACLE_SQL, REGIONS, WORDS, stable_id

CRAP = "ROUND(l_linenumber::DOUBLE * l_linenumber * ((1 - l_discount * 1000 / 100) * (1 - l_discount * 1000 / 100) * (1 - l_discount * 1000 / 100)) + l_linenumber, 6)"
CRAP_RULES = f"cr AS (SELECT 'crap.maximum' AS rule_id, {stable_id(chr(39) + 'crap.maximum' + chr(39), 'file', 'stable_symbol', chr(39) + 'crap-formula-v1' + chr(39))} AS violation_id, file, stable_symbol, CASE WHEN crap > 6 THEN 'fail' ELSE 'pass' END AS result, crap AS measured, ROUND(GREATEST(crap - 6, 0), 6) AS excess FROM (SELECT 'o/' || l_orderkey AS file, 'l' || l_linenumber AS stable_symbol, {CRAP} AS crap FROM lineitem))"
FEATURES = """nat AS (SELECT n_nationkey, n_name FROM nation), ordered AS (SELECT o_custkey, COUNT(*) AS n FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1),
ft AS (SELECT n_name AS package, c_custkey AS k, COALESCE(n, 0) AS n FROM customer JOIN nat ON c_nationkey = n_nationkey LEFT JOIN ordered ON o_custkey = c_custkey),
free AS (SELECT 'crates/' || package || '/Cargo.toml' AS file, package || '::feature::x' || k AS symbol, 'unused-feature:x' || k AS evidence FROM ft f
  WHERE n = 0 AND k % 11 <> 0 AND k % 9 <> 0 AND NOT EXISTS (SELECT 1 FROM ft g WHERE g.package = f.package AND g.k = f.k - 1 AND g.k % 9 = 0))"""
UNREACHABLE = "un AS (SELECT DISTINCT 'u/' || user_id AS file, event_type AS symbol, 'd' || day(ts) AS evidence FROM events WHERE event_type <> 'error')"
REGION_ROWS = ORACLE_SQL["maximal_regions"].removeprefix("WITH " + REGIONS)
RUNS = """runs AS (SELECT o_custkey % 50 AS c, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 13 <> 0 END AS v, o_orderkey % 11 = 0 AS t, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 3 END AS x FROM orders),
st AS (SELECT c, CASE WHEN v = FALSE THEN 'compile' WHEN t THEN 'timeout' WHEN x IS NULL THEN 'runtime' WHEN x = 0 THEN 'survived' ELSE 'killed' END AS s FROM runs)"""


def n(status: str, name: str) -> str:
    return f"SUM((s = '{status}')::INT)::BIGINT AS {name}"


def edge_rule(rule: str, passed: str) -> str:
    return f"SELECT '{rule}' AS rule_id, 'crates/' || package || '/Cargo.toml' AS file, package || ' -> ' || dependency AS stable_symbol, package || '->' || dependency AS structural_evidence, {passed} AS measured_flag, TRUE AS allowed FROM prod"


def round_trip(rows: str, *more: str) -> str:
    return f"WITH {EVENT_LINES}{''.join(', ' + m for m in more)} {rows}"


ORACLE_SQL = {
    "crap_rules": f"WITH {CRAP_RULES} SELECT * FROM cr",
    "mutation_rules": f"""WITH {MUTANTS.replace("l_suppkey,", "l_suppkey, l_orderkey || '-' || l_linenumber AS fp,", 1)},
sc AS (SELECT SUM((status = 'killed')::INT)::DOUBLE / SUM((status IN ('killed', 'survived'))::INT) AS m FROM m)
SELECT 'mutation.score' AS rule_id, {stable_id("'mutation.score'", "'Cargo.toml'", "'repository mutation set'", "'run-v1'")} AS violation_id, 'Cargo.toml' AS file, 'repository mutation set' AS stable_symbol, CASE WHEN m < 0.8 THEN 'fail' ELSE 'pass' END AS result, ROUND(m, 9) AS measured, NULL::BOOLEAN AS measured_flag FROM sc
UNION ALL SELECT 'mutation.surviving-mutant', {stable_id("'mutation.surviving-mutant'", "'src/' || l_suppkey || '.rs'", "'f' || l_linenumber", "fp")}, 'src/' || l_suppkey || '.rs', 'f' || l_linenumber, 'fail', NULL, TRUE FROM m WHERE status = 'survived'""",
    "dry_rules": f"""WITH g AS (SELECT 'c/' || o_custkey AS file, 'g' || o_orderkey AS s, CASE WHEN o_orderkey % 3 <> 0 THEN 'c' || o_orderkey ELSE 'g' || o_orderkey END AS ev, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 100) / 100.0::DOUBLE ELSE 1.0::DOUBLE END AS m FROM orders WHERE o_orderkey % 9 >= 5)
SELECT 'dry.clone' AS rule_id, {stable_id("'dry.clone'", "file", "s", "ev")} AS violation_id, file, s AS stable_symbol, CASE WHEN m < 0.92 THEN 'pass' ELSE 'fail' END AS result, m AS measured, CASE WHEN m < 0.92 THEN 0.0::DOUBLE ELSE ROUND(m - 0.92::DOUBLE, 9) END AS excess FROM g""",
    "empty_inventories": f"""SELECT 'dry.clone' AS rule_id, {stable_id("'dry.clone'", "'Cargo.toml'", "'repository clone inventory'", "'empty-clone-inventory-v1'")} AS violation_id, 'Cargo.toml' AS file, 'repository clone inventory' AS stable_symbol, 'pass' AS result, 'empty-clone-inventory-v1' AS structural_evidence, 0.0::DOUBLE AS measured
UNION ALL SELECT 'yagni.unused-module', {stable_id("'yagni.unused-module'", "'Cargo.toml'", "'repository inventory::yagni.unused-module'", "'empty-reliable-inventory-v1'")}, 'Cargo.toml', 'repository inventory::yagni.unused-module', 'pass', 'empty-reliable-inventory-v1', 0.0""",
    "unused_functions": """WITH f AS (SELECT p_partkey AS k, 'm' || p_partkey % 25 AS package, p_size, p_size % 7 <> 0 AS live FROM part)
SELECT 'src/' || package || '.rs' AS file, package || '::f' || k AS symbol, 'unreferenced-function:f' || k AS evidence, CASE WHEN p_size > 25 THEN 'public' ELSE 'private' END AS visibility FROM f
WHERE live AND p_size <> 50 AND k <> 3 AND NOT ends_with(package, 'm7') AND p_size % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM f g WHERE g.live AND g.p_size % 2 = 0 AND g.k = f.k - 25)""",
    "unused_dependencies": f"""WITH {GRAPH}, nx AS (SELECT a.n_name AS package, b.n_name AS dependency FROM nation a JOIN nation b ON (b.n_nationkey = a.n_nationkey + 1 AND a.n_regionkey > 0) OR b.n_nationkey = a.n_nationkey + 2)
SELECT 'crates/' || package || '/Cargo.toml' AS file, package || '::dependency::' || dependency AS symbol, package || '->' || dependency AS evidence FROM prod ANTI JOIN nx USING (package, dependency)""",
    "unused_features": f"WITH {FEATURES} SELECT * FROM free",
    "unreachable_items": f"WITH {UNREACHABLE} SELECT * FROM un",
    "module_references": """WITH u AS (SELECT l_partkey, COUNT(*) AS n FROM lineitem GROUP BY 1)
SELECT 'root::p' || p_partkey AS stable_symbol, GREATEST(COALESCE(n, 0) - CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END, 0)::BIGINT AS references FROM part LEFT JOIN u ON l_partkey = p_partkey""",
    "yagni_rules": f"""WITH {UNREACHABLE}, {FEATURES}, fs AS (SELECT 'yagni.unreachable-code' AS rule_id, *, (SELECT COUNT(*) FROM un) AS measured, 10000000 AS allowed FROM un
UNION ALL SELECT 'yagni.unused-feature-flag', *, (SELECT COUNT(*) FROM free), 0 FROM free
UNION ALL SELECT 'yagni.unused-feature-flag', 'Cargo.toml', 'repository inventory::yagni.unused-feature-flag', 'empty-reliable-inventory-v1', 0, 0 WHERE NOT EXISTS (SELECT 1 FROM free))
SELECT rule_id, {stable_id("rule_id", "file", "symbol", "evidence")} AS violation_id, file, symbol AS stable_symbol, CASE WHEN measured > allowed THEN 'fail' ELSE 'pass' END AS result, measured, allowed FROM fs""",
    "architecture_rules": f"""WITH RECURSIVE {GRAPH}, rc AS (SELECT package AS a, dependency AS b FROM prod UNION SELECT rc.a, p.dependency FROM rc JOIN prod p ON rc.b = p.package),
ring AS (SELECT DISTINCT cycle FROM (SELECT x.a, list(x.b ORDER BY x.b) AS cycle FROM rc x JOIN rc y ON x.a = y.b AND x.b = y.a GROUP BY x.a)),
rw AS ({edge_rule("solid.forbidden-module-edge", "NOT (starts_with(package, 'NATION_1') AND ends_with(dependency, '2'))")} UNION ALL {edge_rule("solid.domain-to-infrastructure", "NOT (starts_with(package, 'NATION_2') AND ends_with(dependency, '3'))")}
UNION ALL {edge_rule("solid.interface-to-implementation", "NOT starts_with(package, 'NATION_9')")} UNION ALL {edge_rule("solid.dependency-direction", "ra >= rb")}
UNION ALL SELECT 'solid.package-cycle', 'Cargo.toml', array_to_string(cycle, ' -> '), array_to_string(cycle, '|'), TRUE, FALSE FROM ring
UNION ALL SELECT 'solid.package-cycle', 'Cargo.toml', 'repository package dependency graph', 'acyclic-package-graph-v1', FALSE, FALSE WHERE NOT EXISTS (SELECT 1 FROM ring))
SELECT rule_id, {stable_id("rule_id", "file", "stable_symbol", "structural_evidence")} AS violation_id, file, stable_symbol, CASE WHEN measured_flag = allowed THEN 'pass' ELSE 'fail' END AS result, structural_evidence, measured_flag FROM rw""",
    "resolved_targets": """WITH r AS (SELECT l_orderkey AS o, l_linenumber AS k, unnest([l_partkey % 10, l_linenumber]) AS leaf, unnest([0, 1]) AS form FROM lineitem),
t AS (SELECT r.o, r.k, MIN(s.l_linenumber) AS target FROM r JOIN lineitem s ON s.l_orderkey = r.o AND s.l_suppkey % 10 = r.leaf GROUP BY r.o, r.k, r.form, r.leaf HAVING COUNT(DISTINCT s.l_linenumber) = 1)
SELECT DISTINCT 'o/' || o AS file, o || ':' || k AS function_id, o || ':' || target AS target FROM t""",
    "structural_claims": """WITH f AS (SELECT l_orderkey AS o, l_linenumber AS k, l_suppkey % 3 AS leaf, l_suppkey % 2 AS form FROM lineitem),
met AS (SELECT s.o, s.k AS s, m.k AS n, (s.form = m.form)::INT AS exact FROM f s JOIN f m ON s.o = m.o AND s.leaf = m.leaf AND ABS(s.k - m.k) <= 1 WHERE s.k % 2 = 0 AND m.k % 2 = 1),
kept AS (SELECT * FROM (SELECT *, MAX(exact) OVER (PARTITION BY o, s) AS best FROM met) WHERE exact = best),
one AS (SELECT o, s, MIN(n) AS n FROM kept GROUP BY 1, 2 HAVING COUNT(*) = 1)
SELECT o || ':' || s AS structural_id, o || ':' || n AS native_id FROM (SELECT *, COUNT(*) OVER (PARTITION BY o, n) AS claims FROM one) WHERE claims = 1""",
    "merged_lines": "SELECT file, line, MAX(hits) AS hits FROM (SELECT CAST(user_id AS VARCHAR) AS file, day(ts) * 24 + hour(ts) AS line, COUNT(*) AS hits FROM events GROUP BY 1, 2, event_type = 'click') GROUP BY 1, 2",
    "merged_functions": "SELECT 'p/' || l_partkey AS file, 's' || l_suppkey % 3 AS stable_symbol, MAX(l_linenumber) AS complexity, 'n' || MIN(l_linenumber) AS name FROM lineitem GROUP BY 1, 2",
    "merged_records": """SELECT id, MIN(version) AS version, BOOL_OR(native) AS native, string_agg(DISTINCT c, '|' ORDER BY c) AS capabilities
FROM (SELECT s_nationkey AS id, '1.2' AS version, FALSE AS native, 's' || s_suppkey % 4 AS c FROM supplier UNION ALL SELECT c_nationkey, '1.1', c_mktsegment = 'BUILDING', c_mktsegment FROM customer) GROUP BY 1""",
    "merged_identifiers": "SELECT l_suppkey % 7 AS package, l_partkey AS identifier, SUM((l_returnflag = 'N')::INT)::BIGINT AS production_references, SUM((l_returnflag <> 'N')::INT)::BIGINT AS test_references FROM lineitem GROUP BY 1, 2",
    "merged_features": "SELECT o_custkey % 5 AS package, o_custkey % 40 AS name, COUNT(*) AS references, string_agg(DISTINCT 'e' || o_orderkey % 6, '|' ORDER BY 'e' || o_orderkey % 6) AS enables, BOOL_AND(o_orderkey % 2 = 0) AS target_gated FROM orders GROUP BY 1, 2",
    "non_redundant_regions": f"""WITH {REGIONS}, mr AS ({REGION_ROWS}) SELECT * FROM mr i WHERE NOT EXISTS (SELECT 1 FROM mr o WHERE o.file_l = i.file_l AND o.file_r = i.file_r AND o.token_count > i.token_count
AND o.start_l <= i.start_l AND i.start_l + i.token_count <= o.start_l + o.token_count AND o.start_r <= i.start_r AND i.start_r + i.token_count <= o.start_r + o.token_count)""",
    "fallback_groups": f"""WITH {REGIONS}, mr AS ({REGION_ROWS}), sd AS (SELECT token_count, file_l AS file, start_l AS start FROM mr UNION SELECT token_count, file_r, start_r FROM mr),
tx AS (SELECT token_count, file, start, t[start + 1 : start + token_count] AS x FROM sd JOIN w USING (file))
SELECT token_count, p.file AS file, p.start AS start, places FROM (SELECT token_count, MIN(struct_pack(file := file, start := start)) AS p, COUNT(*)::INT AS places FROM tx GROUP BY token_count, x HAVING COUNT(*) > 1)""",
    "maximal_groups": """WITH g AS (SELECT l_orderkey AS group_id, COUNT(*)::INT AS token_count, list_sort(list(DISTINCT l_partkey)) AS files FROM lineitem GROUP BY 1), o AS (SELECT token_count, files, unnest(files) AS f FROM g)
SELECT group_id, token_count FROM g WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.f = g.files[1] AND o.token_count > g.token_count AND list_has_all(o.files, g.files))""",
    "eligible_functions": """WITH c AS (SELECT 'conv/' || conv_id % 5 AS path, CASE WHEN turn % 2 = 0 THEN 'c' || conv_id ELSE 't' || turn END AS symbol, turn % 4 AS start_line, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM conversations WHERE role <> 'system')
SELECT path, symbol, start_line, len(w)::INT AS tokens FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY path, start_line, w ORDER BY symbol) AS k FROM c WHERE len(w) >= 12 AND start_line > 0) WHERE k = 1""",
    "invalid_rows": """WITH r AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN '../up' ELSE 'src/a.rs' END AS file, o_orderkey // 2 AS s, (o_orderkey % 8)::DOUBLE AS measured FROM orders),
k AS (SELECT *, CASE WHEN measured IN (6) THEN 'fail' ELSE 'pass' END AS result, COUNT(*) OVER (PARTITION BY file, s) AS same FROM r)
SELECT file, measured, result, COUNT(*) AS n FROM k WHERE file = '../up' OR same > 1 OR measured = 7 GROUP BY 1, 2, 3""",
    "outcomes": f"""WITH {RUNS}, ct AS (SELECT c, {n("killed", "killed")}, {n("survived", "survived")}, {n("timeout", "timeout")}, {n("compile", "compile_error")}, {n("runtime", "runtime_error")} FROM st GROUP BY 1)
SELECT *, CASE WHEN timeout + runtime_error > 0 THEN 1 WHEN survived > 0 THEN 2 ELSE 0 END AS exit_code FROM ct""",
    "ranked_risk": f"WITH r AS (SELECT 'o/' || l_orderkey AS file, l_linenumber AS start_line, CASE WHEN l_orderkey % 4 <> 0 THEN {CRAP} END AS crap FROM lineitem) SELECT *, ROW_NUMBER() OVER (ORDER BY crap DESC NULLS LAST, file, start_line) AS place FROM r",
    "report_counts": f"WITH {CRAP_RULES} SELECT COUNT(*) AS rule_results, SUM((result = 'fail')::INT)::BIGINT AS rule_failures, 18::BIGINT AS findings, 2::BIGINT AS omitted_checks FROM cr",
    "sarif_sections": f"""WITH {MUTANTS}, sc AS (SELECT SUM((status = 'killed')::INT)::DOUBLE / SUM((status IN ('killed', 'survived'))::INT) AS m FROM m),
r AS (SELECT 'crap-threshold' AS rule_id, GREATEST(l_linenumber - 2, 1)::INT AS start_line, GREATEST(3, l_linenumber - 2)::INT AS end_line, 1 AS places, 0 AS fp FROM lineitem WHERE {CRAP} > 6
UNION ALL SELECT 'duplicate-code', (o_orderkey % 9)::INT, GREATEST(7, o_orderkey % 9)::INT, 2, 0 FROM orders WHERE o_orderkey % 5 <> 0 AND (o_orderkey % 100) / 100.0::DOUBLE >= 0.92 AND o_orderkey % 9 >= 5
UNION ALL SELECT 'mutation.score', NULL, NULL, 1, 1 FROM sc WHERE m < 0.8 UNION ALL SELECT 'mutation.surviving-mutant', NULL, NULL, 1, 1 FROM m WHERE status = 'survived')
SELECT rule_id, start_line, end_line, places, COUNT(*) AS n, SUM(fp)::BIGINT AS fingerprints FROM r GROUP BY 1, 2, 3, 4""",
    "cobertura_round_trip": round_trip("SELECT unnest([file || '.py', '/base/' || file || '.py']) AS file, line::INT AS line, hits::BIGINT AS hits FROM lines"),
    "istanbul_round_trip": round_trip("SELECT '/src/' || file || '.ts' AS file, line::INT AS line, hits::BIGINT AS hits FROM lines"),
    "llvm_round_trip": round_trip(
        "SELECT '/s/' || file || '.c' AS file, line::INT AS line, MAX(hits)::BIGINT AS hits FROM x GROUP BY 1, 2",
        "x AS (SELECT file, line, hits FROM lines WHERE line % 2 = 0 UNION ALL SELECT file, unnest(range(line, line + 3)), hits FROM lines WHERE line % 3 = 0)",
    ),
    "llvm_stretches": round_trip(
        "SELECT '/s/' || file || '.c' AS file, s AS start_line, e AS end_line, MAX(hits)::BIGINT AS hits FROM st JOIN rg USING (file) WHERE e IS NOT NULL AND s BETWEEN line AND line + 2 GROUP BY 1, 2, 3",
        "rg AS (SELECT file, line::BIGINT AS line, hits FROM lines WHERE line % 3 = 0)",
        "st AS (SELECT file, s, LEAD(s) OVER (PARTITION BY file ORDER BY s) - 1 AS e FROM (SELECT file, line AS s FROM rg UNION SELECT file, line + 3 FROM rg))",
    ),
    "regional_coverage": """WITH l AS (SELECT user_id || '#' || day(ts) AS function_id, unnest(range(hour(ts), hour(ts) + minute(ts) % 7 + 1)) AS line, (event_type <> 'error')::INT AS hit FROM events),
m AS (SELECT function_id, line, MAX(hit) AS hit FROM l GROUP BY 1, 2) SELECT function_id, ROUND(100.0::DOUBLE * SUM(hit) / COUNT(*), 9) AS coverage FROM m GROUP BY 1""",
}
