"""DuckDB SQL for the same results as ``assayer.plans.report_queries``."""

from __future__ import annotations

from assayer.plans.report_queries import REPORT_GROUPS
from assayer.plans.rule_sql import ORACLE_SQL as RULE_SQL
from assayer.plans.sql import APPLIED, EVENT_LINES, FAMILY, KISS, MUTANTS, ORACLE_SQL as BASE_SQL, day_functions, stable_id

POLICY = APPLIED.replace(EVENT_LINES, "lines AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS file, day(ts) * 24 + hour(ts) AS line, 1 AS hits FROM events WHERE event_type = 'purchase')")
assert POLICY != APPLIED and day_functions(24) in POLICY
STATES = "SUM((s = 'timeout')::INT)"

ORACLE_SQL = {
    "mutant_symbols": """WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS file, day(ts) * 24 + hour(ts) AS line FROM events), b AS (SELECT DISTINCT file, unnest([line // 12, line // 6]) AS n FROM e),
f AS (SELECT file, 'b' || n AS name, n * 6 AS s, n * 6 + 11 - n % 3 AS e FROM b), m AS (SELECT event_id, name, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY f.e - s, name) AS k FROM e JOIN f ON f.file = e.file AND line BETWEEN s AND f.e)
SELECT e.event_id, COALESCE(name, file || '::<module>') AS stable_symbol, 'comparison' AS operator FROM e LEFT JOIN m ON m.event_id = e.event_id AND k = 1""",
    "mutant_numbers": f"WITH {MUTANTS} SELECT ROW_NUMBER() OVER (ORDER BY 'src/' || l_suppkey, 'f' || l_linenumber, l_orderkey || '-' || l_linenumber) AS id, l_orderkey || '-' || l_linenumber AS fingerprint FROM m",
    "numbered_rules": f"WITH {KISS} SELECT violation_id, ROW_NUMBER() OVER (ORDER BY rule_id, file, stable_symbol, violation_id) AS place FROM kr",
    "numbered_diagnostics": """WITH e AS (SELECT event_id, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS s, event_type <> 'view' AS a, user_id, ts, event_type FROM events)
SELECT event_id, ROW_NUMBER() OVER (ORDER BY s, CASE WHEN a THEN 'u' || user_id END NULLS FIRST, CASE WHEN a THEN hour(ts) END NULLS FIRST, CASE WHEN a THEN minute(ts) END NULLS FIRST, CASE WHEN a THEN second(ts) END NULLS FIRST, event_type, CAST(event_id AS VARCHAR)) AS place FROM e""",
    "numbered_mutants": f"""WITH {MUTANTS}, r AS (SELECT 'src/' || l_suppkey % 9 AS file, 'f' || l_linenumber AS symbol, {FAMILY} AS operator, l_linenumber, l_orderkey % 100 AS id, original, status, list_position(['killed', 'survived', 'no-coverage', 'compile-error', 'runtime-error', 'timeout', 'ignored', 'invalid', 'pending'], status) AS k, CASE WHEN l_orderkey % 3 <> 0 THEN l_orderkey % 4 END AS exit_code FROM m)
SELECT ROW_NUMBER() OVER (ORDER BY file, symbol, operator, l_linenumber, id, original, k, exit_code NULLS FIRST) AS place, file, operator, id, status, exit_code FROM r""",
    "reported_groups": f"""WITH g AS (SELECT l_orderkey AS group_id, COUNT(*) AS token_count, list_sort(list(DISTINCT struct_pack(file := l_partkey, start_line := l_linenumber))) AS p FROM lineitem GROUP BY 1)
SELECT group_id, token_count, len(p)::INT AS places FROM g ORDER BY token_count DESC, p, len(p), group_id LIMIT {REPORT_GROUPS}""",
    "unresolved_mutants": f"WITH {MUTANTS} SELECT l_suppkey, status IN ('timeout', 'pending') AS unresolved, COUNT(*) AS n FROM m GROUP BY 1, 2",
    "policy_coverage": POLICY + """ , z AS (SELECT function_id, CASE WHEN reason = 'unmatched-file' THEN 'matched' ELSE reason END AS reason, CASE WHEN reason = 'unmatched-file' THEN 0.0::DOUBLE ELSE cov END AS cov, c FROM p)
SELECT function_id, reason, ROUND(cov, 6) AS coverage, ROUND(c::DOUBLE * c * ((1 - cov / 100) * (1 - cov / 100) * (1 - cov / 100)) + c, 6) AS crap FROM z""",
    "span_relations": """WITH s AS (SELECT l_orderkey, l_linenumber AS k, l_linenumber * 100 + l_partkey % 10 AS b, (l_linenumber + l_quantity::INT % 3) * 100 + l_suppkey % 10 + 10 AS e FROM lineitem)
SELECT x.l_orderkey, x.k AS a_line, y.k AS b_line, y.b <= x.b AND x.e <= y.e AS within FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND x.k <> y.k AND x.b < y.e AND y.b < x.e""",
    "united_records": "SELECT s_nationkey AS nation, 'supplier' AS kind, NULL AS segment FROM supplier UNION SELECT c_nationkey, 'customer', c_mktsegment FROM customer",
    "native_report": """WITH j AS (SELECT 'o' AS part, '{"k":' || o_orderkey || ',"s":"' || o_orderstatus || '"}' AS j FROM orders UNION ALL SELECT 'n', '{"name":"' || n_name || '"}' FROM nation UNION ALL SELECT 'd', '{"about":"' || n_name || '"}' FROM nation)
SELECT CASE WHEN ROW_NUMBER() OVER (PARTITION BY part ORDER BY j) = 1 THEN '' ELSE ', ' END || j AS line FROM j
UNION ALL SELECT unnest(['{"request": {}, "schema_version": 1, "tool": {"name": "assayer"}, "results": {', '"nations": [', ']', ', "none": [', ']', ', "orders": [', ']', '}, "diagnostics": [', ']}'])""",
    "test_symbols": """WITH s AS (SELECT 'm' || p_partkey % 25 AS package, p_partkey AS k, p_partkey % 7 AS o, 'm' || p_partkey % 25 || '::t' || p_partkey % 7 || '::f' || p_partkey AS symbol FROM part),
r AS (SELECT DISTINCT 'm' || c_custkey % 25 AS package, c_nationkey % 7 AS o, c_custkey AS k, 'm' || c_custkey % 25 || '::t' || c_nationkey % 7 || '::check' AS test, CASE c_custkey % 3 WHEN 0 THEN 't' || c_custkey % 7 || '::f' || c_custkey WHEN 1 THEN 'crate::f' || c_custkey ELSE 'none' || c_custkey END AS reference FROM customer),
m AS (SELECT r.package, test, reference, symbol, CASE WHEN r.k = s.k AND r.k % 3 = 0 THEN 3 WHEN r.k = s.k AND r.k % 3 = 1 THEN 1 ELSE 0 END + CASE WHEN r.o = s.o THEN 2 ELSE 0 END AS score FROM r JOIN s USING (package)),
b AS (SELECT *, MAX(score) OVER (PARTITION BY package, test, reference) AS top FROM m WHERE score > 0)
SELECT package, test, reference, MIN(symbol) AS symbol FROM b WHERE score = top GROUP BY 1, 2, 3 HAVING COUNT(*) = 1""",
    "imported_mutants": """SELECT 'src/' || l_suppkey || '.rs' AS file, 'replace == with != in ' || l_orderkey || '-' || l_linenumber AS external_id, l_linenumber::INT AS line, (l_orderkey % 80 + 1)::INT AS "column", '==' AS original, '!=' AS replacement, ROUND(0.5 + l_tax::DOUBLE, 6) AS duration,
CASE l_linenumber % 5 WHEN 0 THEN 'killed' WHEN 1 THEN 'survived' WHEN 2 THEN 'compile-error' WHEN 3 THEN 'timeout' ELSE 'runtime-error' END AS status, 'comparison' AS operator FROM (SELECT l_suppkey, l_orderkey, l_linenumber, MAX(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2, 3)""",
    "yagni_inventories": f"""WITH uf AS ({RULE_SQL["unused_functions"]}), ud AS ({RULE_SQL["unused_dependencies"]}),
x AS (SELECT CASE WHEN visibility = 'private' THEN 'yagni.unused-private-function' ELSE 'yagni.unreferenced-crate-export' END AS rule_id, file, symbol, evidence FROM uf UNION ALL SELECT 'yagni.unused-production-dependency', file, symbol, evidence FROM ud),
n AS (SELECT rule_id, COUNT(*) AS measured FROM x GROUP BY 1), w AS (SELECT unnest(['yagni.unused-private-function', 'yagni.unreferenced-crate-export', 'yagni.unused-production-dependency']) AS rule_id),
a AS (SELECT x.*, measured FROM x JOIN n USING (rule_id) UNION ALL SELECT rule_id, 'Cargo.toml', 'repository inventory::' || rule_id, 'empty-reliable-inventory-v1', 0 FROM w WHERE rule_id NOT IN (SELECT rule_id FROM n))
SELECT rule_id, {stable_id("rule_id", "file", "symbol", "evidence")} AS violation_id, file, symbol AS stable_symbol, CASE WHEN measured > CASE WHEN rule_id = 'yagni.unused-private-function' THEN 7 ELSE 0 END THEN 'fail' ELSE 'pass' END AS result, measured FROM a""",
    "supplier_cycles": """WITH RECURSIVE e AS (SELECT 's' || s_suppkey AS a, 's' || ((s_suppkey * (s_nationkey + 1) + s_nationkey) % (SELECT COUNT(*) FROM supplier) + 1) AS b FROM supplier),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT DISTINCT members, n FROM (SELECT x.a, string_agg(x.b, '|' ORDER BY x.b) AS members, COUNT(*)::INT AS n FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)""",
    "offset_positions": """WITH x AS (SELECT DISTINCT conv_id || ':' || turn AS file, text, unnest([0, length(text) // 3, length(text) // 2, length(text)]) AS o FROM conversations), y AS (SELECT file, o, substr(text, 1, o) AS b FROM x)
SELECT file, o::BIGINT AS "offset", (length(b) - length(replace(b, chr(10), '')) + 1)::INT AS line, (length(string_split(b, chr(10))[-1]) + 1)::INT AS "column" FROM y""",
    "kept_baseline": BASE_SQL["baseline_diff"],
    "exit_codes": f"""WITH r AS (SELECT o_custkey AS c, o_orderkey % 5 = 0 AS bad, CASE WHEN o_orderkey % 31 = 0 THEN 'timeout' WHEN o_orderkey % 3 = 0 THEN 'survived' ELSE 'killed' END AS s FROM orders),
g AS (SELECT c, {STATES} AS missing, COUNT(*) AS n, SUM(bad::INT) = 0 AS gate, CASE WHEN {STATES} > 0 THEN 1 WHEN SUM((s = 'survived')::INT) > 0 THEN 2 ELSE 0 END AS m FROM r GROUP BY 1)
SELECT c AS o_custkey, m AS mutation_exit, CASE WHEN m = 1 THEN 1 WHEN gate THEN 0 ELSE 2 END AS check_exit, CASE WHEN (n = 1 AND c % 2 <> 0) OR missing > 0 THEN 1 WHEN NOT gate THEN 2 ELSE 0 END AS risk_exit FROM g""",
    "clone_group_sizes": BASE_SQL["clone_groups"][: BASE_SQL["clone_groups"].index(", m AS (SELECT label")] + """, ln AS (SELECT CAST(doc_id AS VARCHAR) AS file, len(string_split(text, chr(10)))::INT AS statement_count FROM documents)
SELECT label, MIN(len(t))::INT AS token_count, MIN(statement_count) AS statement_count FROM lab JOIN w ON w.file = node JOIN ln ON ln.file = node GROUP BY 1""",
    "regional_files": f"""WITH {EVENT_LINES}, b AS (SELECT DISTINCT file, line // 48 AS n FROM lines)
SELECT b.file, n, COUNT(*) AS lines, SUM(hits)::BIGINT AS hits FROM b JOIN lines l ON l.file = b.file AND line BETWEEN n * 48 AND n * 48 + 60 GROUP BY 1, 2""",
}
