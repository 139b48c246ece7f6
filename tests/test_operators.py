"""Operators on literal facts."""

import hashlib
import json
import re
import time

import pytest
from pyspark.sql import functions as F

from assayer.functions import columns as fn
from assayer.operators import clones, cohesion, coverage, mutation, packages, unused
from assayer.rules import catalog, engine
from assayer.sinks import reports
from assayer.sources import coverage_reports, mutation_reports, python_facts, repository

FUN = "function_id string, file string, name string, stable_symbol string, start_line int, end_line int, complexity int, excluded array<struct<s:int,e:int>>"


def one(spark, expression, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0)).select(expression.alias("x")).first().x


def stable(*parts):
    h = hashlib.sha256()
    for p in parts:
        h.update(len(p.encode()).to_bytes(8, "big") + p.encode())
    return h.hexdigest()


def test_stable_id_does_not_depend_on_separators(spark):
    want = stable("r", "src/é.rs", "s", "e")
    for path in ("src/é.rs", "src\\é.rs", "./src//é.rs"):
        assert one(spark, fn.stable_id(F.lit("r"), F.lit(path), F.lit("s"), F.lit("e"))) == want
    assert one(spark, fn.repository_path(F.lit("a/../b"))) is None and one(spark, fn.repository_path(F.lit("/a"))) is None


@pytest.mark.parametrize("path,want", [("a/./b/../c", "a/c"), ("../a", "../a"), ("file:///x/../y", "/y"), ("C:\\A\\b", "c:/a/b"), ("//Srv/S", "//srv/s"), ("./", "."), ("/../a", "/a")])
def test_coverage_path(spark, path, want):
    assert one(spark, fn.coverage_path(F.lit(path))) == want


@pytest.mark.parametrize("symbol,bare,name,owner", [
    ("m::T.f(a: (u8))#0123456789ab:2", "m::T.f", "f", "m::T"), ("f", "f", "f", "file"), ("a::r#b(x)", "a::r#b", "b", "a"), ("x)#zz", "x)#zz", "x)#zz", "file"), ("a.b::c", "a.b::c", "c", "a.b"),
])
def test_symbols(spark, symbol, bare, name, owner):
    assert one(spark, fn.bare_symbol(F.lit(symbol))) == bare
    assert one(spark, fn.simple_name(F.lit(symbol))) == name
    assert one(spark, fn.cohesion_owner(F.lit(symbol), F.lit("file"))) == owner


@pytest.mark.parametrize("pattern,value,want", [("a*b", "ab", True), ("a*b", "a", False), ("*", "", True), ("a%", "ab", False), ("a*b*", "axbx", False), ("a_", "ab", False)])
def test_patterns(spark, pattern, value, want):
    assert one(spark, fn.matches_pattern(F.lit(pattern), F.lit(value))) is want


def test_terminal_text_and_uris(spark):
    assert one(spark, fn.escape_terminal(F.lit("a\x1b[b\u202ec"))) == "a\\u{1b}[b\\u{202e}c"
    assert one(spark, fn.path_uri(F.lit("a b\\é:~*"))) == "a%20b/%C3%A9:~%2A"


def test_unknown_import_status_is_an_error(spark):
    assert one(spark, fn.imported_status(F.lit("muter"), F.lit("runtimeError"))) == "killed"
    with pytest.raises(Exception, match="unsupported status"):
        one(spark, fn.imported_status(F.lit("muter"), F.lit("odd")))


def functions(spark, *rows):
    return spark.createDataFrame([(r[0], r[1], r[0], r[0], r[2], r[3], r[4], r[5] if len(r) > 5 else []) for r in rows], FUN)


def test_coverage_slice(spark):
    f = functions(spark, ("a", "x.c", 1, 4, 3), ("b", "x.c", 5, 9, 2), ("c", "x.c", 9, 12, 1), ("d", "y.c", 1, 9, 2, [(3, 6)]), ("e", "z.c", 1, 2, 1), ("g", "y.c", 20, 30, 1), ("h", "y.c", 40, 60, 4, [(44, 50)]))
    lines = spark.createDataFrame([("x.c", 1, 2), ("x.c", 2, 0), ("x.c", 9, 1), ("y.c", 3, 1), ("y.c", 4, 1), ("y.c", 45, 0), ("y.c", 51, 7)], "file string, line int, hits long")
    got = {r.function_id: (r.reason, r.coverage) for r in coverage.apply_coverage(f, lines).collect()}
    assert got == {"a": ("matched", 50.0), "b": ("ambiguous", None), "c": ("ambiguous", None), "d": ("ambiguous", None), "e": ("unmatched-file", None), "g": ("empty-range", None), "h": ("matched", 100.0)}
    zero = {r.function_id: r.coverage for r in coverage.apply_coverage(f, lines, True, True).collect()}
    assert zero["e"] == 0.0 and zero["g"] is None
    assert one(spark, fn.crap_score(F.lit(4), F.lit(50.0))) == 6.0


def test_coverage_does_not_depend_on_order(spark):
    f = functions(spark, *((f"f{i}", "x.c", i * 10, i * 10 + 12, 2) for i in range(20)))
    lines = spark.createDataFrame([("x.c", i * 3, i % 2) for i in range(70)], "file string, line int, hits long")
    a, b = coverage.apply_coverage(f, lines), coverage.apply_coverage(f.orderBy(F.rand(1)).repartition(5), lines.orderBy(F.rand(2)))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_files_with_one_basename_stay_unresolved(spark):
    files = spark.createDataFrame([("src/a.c",), ("b.c",), ("q/c.c",)], "file string")
    rep = spark.createDataFrame([("/r/src/a.c",), ("x/b.c",), ("y/b.c",), ("z/c.c",)], "file string")
    got = {r.file: r.reported for r in coverage.resolve_files(files, rep).collect()}
    assert got == {"src/a.c": "/r/src/a.c", "q/c.c": "z/c.c"}


def graph(spark):
    p = spark.createDataFrame([("a", "crates/a"), ("b", "b/"), ("c", "."), ("d", "d")], "name string, root string")
    rows = [("a", "b", True), ("b", "a", True), ("b", "serde", False), ("c", "c", True), ("d", "a", True), ("a", "b", True)]
    d = spark.createDataFrame([(x, y, "production", i, False, "") for x, y, i in rows] + [("d", "c", "development", True, False, ""), ("d", "b", "production", True, True, "")], "package string, dependency string, scope string, internal boolean, target_gated boolean, source_identifier string")
    return p, d


def test_coupling_and_cycles(spark):
    p, d = graph(spark)
    got = {r.name: (r.afferent, r.efferent, r.instability) for r in packages.coupling(p, d).collect()}
    assert got == {"a": (2, 1, 1 / 3), "b": (1, 2, 2 / 3), "c": (1, 1, 0.5), "d": (0, 1, 1.0)}
    rows = catalog.architecture(p, d, spark.createDataFrame([("a", 1), ("b", 2), ("d", 3)], "pattern string, layer int"), ["d->*"])
    got = {(r.rule_id, r.stable_symbol): r.result for r in rows.collect()}
    assert got["solid.package-cycle", "a -> b"] == "fail" and got["solid.package-cycle", "c"] == "fail"
    assert got["solid.dependency-direction", "a -> b"] == "fail" and got["solid.dependency-direction", "b -> a"] == "pass"
    assert got["solid.forbidden-module-edge", "d -> a"] == "fail" and got["solid.forbidden-module-edge", "b -> a"] == "pass"
    with pytest.raises(Exception, match="several layer patterns"):
        packages.layer_of(p, spark.createDataFrame([("a", 1), ("*", 2)], "pattern string, layer int")).collect()


MUT = "id long, file string, stable_symbol string, operator string, fingerprint string, line int, column int, original string, replacement string, start_byte long, end_byte long, status string"


def test_mutants(spark):
    f = functions(spark, ("outer", "a.rs", 1, 20, 1), ("inner", "a.rs", 5, 8, 1))
    rows = [(i, "./a.rs", "", "", "", line, col, "==", "!=", 0, 0, s) for i, (line, col, s) in enumerate([(6, 1, "killed"), (6, 9, "survived"), (15, 1, "timeout"), (50, 1, "killed")])]
    m = mutation.number(mutation.fingerprints(mutation.fill_symbols(spark.createDataFrame(rows, MUT), f))).collect()
    assert sorted(r.stable_symbol for r in m) == ["a.rs::<module>", "inner", "inner", "outer"] and sorted(r.id for r in m) == [1, 2, 3, 4]
    assert stable("mutation.fingerprint", "a.rs", "inner", '["comparison","==","!=",1]') in {r.fingerprint for r in m}
    assert len({r.fingerprint for r in m}) == 4
    score = mutation.mutation_score(spark.createDataFrame(rows, MUT)).first()
    assert (score.killed, score.scoreable) == (2, 3)
    chosen = mutation.select_candidates(spark.createDataFrame([("comparison", "f", "s", c) for c in "abc"], "operator string, file string, stable_symbol string, fingerprint string"), ["comparison"], 7)
    want = sorted("abc", key=lambda c: hashlib.sha256((7).to_bytes(8, "big") + (1).to_bytes(8, "big") + c.encode()).digest())
    assert [r.fingerprint for r in chosen.collect()] == want
    assert sorted(r.status for r in mutation.limit_execution(chosen, 1).collect()) == ["ignored", "ignored", "pending"]
    runs = spark.createDataFrame([(True, False, 0), (True, False, 3), (True, True, None), (True, False, None), (False, False, None)], "validated boolean, timed_out boolean, exit_code int")
    assert [r.status for r in mutation.classify_outcome(runs).collect()] == ["survived", "killed", "timeout", "runtime-error", "compile-error"]


def test_exact_regions(spark):
    base = [f"t{i}" for i in range(40)]
    arrays = spark.createDataFrame([("a", ["x", *base, "y"]), ("b", [*base[:30], "z", *base]), ("c", base[:12] * 2)], "file string, tokens array<string>")
    wins = clones.windows(arrays, 10)
    got = {(r.file_l, r.start_l, r.file_r, r.start_r, r.token_count) for r in clones.maximal_regions(wins, 10, 100).collect()}
    assert ("a", 1, "b", 31, 40) in got and ("a", 1, "b", 0, 30) in got and ("c", 0, "c", 12, 12) in got
    kept = {(r.file_l, r.start_l, r.file_r, r.start_r) for r in clones.non_redundant(clones.maximal_regions(wins, 10, 100)).collect()}
    assert ("a", 1, "b", 31) in kept
    assert not any(f == g and abs(s - t) < n for f, s, g, t, n in got)


def test_dice_at_the_threshold(spark):
    left, right = [f"a{i}" for i in range(8)], [*(f"a{i}" for i in range(6)), "p", "q"]
    arrays = spark.createDataFrame([("l", left), ("r", right), ("o", ["z"] * 9)], "file string, tokens array<string>")
    counts = clones.shingle_sets(arrays, 1)
    assert [(r.l, r.r, r.similarity) for r in clones.near_pairs(counts, 0.75).collect()] == [("l", "r", 0.75)]
    assert clones.near_pairs(counts, 0.7501).count() == 0
    g = clones.near_groups(clones.near_pairs(counts, 0.5), clones.clone_classes(arrays)).collect()
    assert [(x.members, x.similarity) for x in g] == [(["l", "r"], 0.75)]


def test_independent_groups(spark):
    place = lambda f, s, e: {"file": f, "start_line": s, "end_line": e}
    rows = [("g1", 50, [place("a", 1, 9), place("b", 1, 9)]), ("g2", 40, [place("a", 5, 20), place("c", 1, 9)]), ("g3", 30, [place("d", 1, 3), place("c", 1, 9)])]
    df = spark.createDataFrame(rows, "group_id string, token_count int, places array<struct<file:string,start_line:int,end_line:int>>")
    assert sorted(r.group_id for r in clones.independent_groups(df).collect()) == ["g1", "g3"]
    m = spark.createDataFrame([("x", 9, ["a", "b"]), ("y", 5, ["a", "b"]), ("z", 5, ["a", "c"])], "group_id string, token_count int, files array<string>")
    assert sorted(r.group_id for r in clones.maximal_groups(m).collect()) == ["x", "z"]


def test_independent_groups_equal_one_greedy_pass(spark):
    import random

    rng = random.Random(5)
    rows = []
    for i in range(120):
        n = rng.randrange(2, 5)
        size = rng.randrange(3, 12)
        places = sorted({(f"f{rng.randrange(8)}", rng.randrange(60)) for _ in range(n)})
        rows.append((f"g{i:03}", rng.randrange(20, 40), [{"file": f, "start_line": s, "end_line": s + size} for f, s in places]))
    covered, want = {}, []
    for g, _, places in sorted(rows, key=lambda r: (-r[1], [(p["file"], p["start_line"], p["end_line"]) for p in r[2]], len(r[2]), r[0])):
        if sum(all(p["end_line"] < s or e < p["start_line"] for s, e in covered.get(p["file"], ())) for p in places) >= 2:
            want.append(g)
            for p in places:
                covered.setdefault(p["file"], []).append((p["start_line"], p["end_line"]))
    df = spark.createDataFrame(rows, "group_id string, token_count int, places array<struct<file:string,start_line:int,end_line:int>>")
    assert sorted(r.group_id for r in clones.independent_groups(df).collect()) == sorted(want)


def greedy_groups(rows):
    covered, want = {}, []
    for g, _, places in sorted(rows, key=lambda r: (-r[1], [(p["file"], p["start_line"], p["end_line"]) for p in r[2]], len(r[2]), r[0])):
        if sum(all(max(p["start_line"], s) > min(p["end_line"], e) for s, e in covered.get(p["file"], ())) for p in places) >= 2:
            want.append(g)
            for p in places:
                covered.setdefault(p["file"], []).append((p["start_line"], p["end_line"]))
    return sorted(want)


@pytest.mark.parametrize("seed,bits,together", [(1, 3, 20), (2, 4, 1), (3, 10, 200_000)])
def test_independent_groups_over_long_files(spark, monkeypatch, seed, bits, together):
    """Stretches are short, long and uneven, places long, short and without lines; the rounds meet few rows a place."""
    import random

    monkeypatch.setattr(clones, "_STRETCH_BITS", bits)
    monkeypatch.setattr(clones, "_PLACES_TOGETHER", together)
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        start = [(rng.choice("abcd"), rng.randrange(900)) for _ in range(rng.randrange(2, 6))]
        places = [{"file": f, "start_line": s, "end_line": s + rng.choice((-1, 0, 3, 12, 40, 40, 300))} for f, s in sorted(set(start))]
        rows.append((f"g{i:03}", rng.randrange(20, 40), places))
    df = spark.createDataFrame(rows, "group_id string, token_count int, places array<struct<file:string,start_line:int,end_line:int>>")
    got = clones.independent_groups(df)
    assert got.columns == df.columns and sorted(r.group_id for r in got.collect()) == greedy_groups(rows)
    many = spark.range(1000).selectExpr("id AS rank", "0 AS place", "0L AS at", "10 AS bits", "id * 100 AS low", "id * 100 + 200 AS high")
    met = clones._stretches(many)
    assert met.count() <= 3 * 1000 and dict(met.dtypes)["at"] == "bigint" and "string" not in dict(met.dtypes).values()


def test_cycles_equal_mutual_reach(spark):
    import random

    rng = random.Random(3)
    edges = sorted({(f"n{rng.randrange(24):02}", f"n{rng.randrange(24):02}") for _ in range(34)})
    reach = {x: {b for a, b in edges if a == x} for x, _ in edges}
    while any(len(s | set().union(*(reach.get(y, set()) for y in s))) > len(s) for s in reach.values() if s):
        reach = {x: s | set().union(*(reach.get(y, set()) for y in s)) for x, s in reach.items()}
    want = {tuple(sorted(y for y in s if x in reach.get(y, ()))) for x, s in reach.items() if x in s}
    got = [tuple(r.cycle) for r in packages.cycles(spark.createDataFrame(edges, "a string, b string")).collect()]
    assert len(want) > 1 and sorted(got) == sorted(want)


def test_frequent_windows_extend_the_seeds(spark):
    """With one place a key allowed less than it has, regions are those of seeded diagonals in full."""
    rows = [(f"f{i}", ["p"] * 0 + [f"x{i}"] + [f"c{j}" for j in range(14)] + [f"y{i}"]) for i in range(6)]
    arrays = spark.createDataFrame(rows, "file string, tokens array<string>")
    got = {(r.file_l, r.start_l, r.file_r, r.start_r, r.token_count) for r in clones.maximal_regions(clones.windows(arrays, 5), 5, 3).collect()}
    assert got == {(f"f{a}", 1, f"f{b}", 1, 14) for a in range(3) for b in range(a + 1, 3)}


def plain_regions(files, size, most):
    """Matching stretches of every diagonal that hold two of the first ``most`` places of a window."""
    places = {}
    for f, t in sorted(files.items()):
        for i in range(len(t) - size + 1):
            places.setdefault(tuple(t[i : i + size]), []).append((f, i))
    pairs = {(a, b): max(i, j) < most for p in places.values() for i, a in enumerate(p) for j, b in enumerate(p) if a < b}
    out = set()
    for (f, i), (g, j) in pairs:
        if ((f, i - 1), (g, j - 1)) not in pairs:
            n = next(k for k in range(10**6) if ((f, i + k), (g, j + k)) not in pairs)
            if any(pairs[(f, i + k), (g, j + k)] for k in range(n)) and (f != g or j - i >= n + size - 1):
                out.add((f, i, g, j, n + size - 1))
    return out


@pytest.mark.parametrize("size,most,seed", [(5, 3, 1), (4, 2, 2), (7, 4, 3), (6, 100, 4)])
def test_regions_equal_a_plain_pass(spark, size, most, seed):
    import random

    rng = random.Random(seed)
    parts = [[f"p{k}.{i if k % 2 else i % 3}" for i in range(rng.randrange(3, 4 * size))] for k in range(6)]
    files = {f"f{i:02}": [w for _ in range(rng.randrange(1, 5)) for w in (rng.choice(parts) if rng.random() < 0.8 else [f"u{rng.randrange(50)}"])] for i in range(14)}
    files |= {f"g{i:02}": files[f"f{i:02}"] for i in range(0, 14, 3)} | {"lol": ["lol"] * 40, "few": ["x"], "none": []}
    arrays = spark.createDataFrame(list(files.items()), "file string, tokens array<string>")
    want = plain_regions(files, size, most)
    for wins in (clones.windows(arrays, size), clones.candidate_windows(arrays, size)):
        got = [(r.file_l, r.start_l, r.file_r, r.start_r, r.token_count) for r in clones.maximal_regions(wins, size, most).collect()]
        assert len(want) > 5 and sorted(got) == sorted(want)


def test_regions_are_made_from_their_ends(spark):
    """Copies make rows for the two ends of a stretch, not for each window in it; windows that occur once are left out."""
    words = [f"w{i}" for i in range(3000)]
    arrays = spark.createDataFrame([("a", words), ("b", words), ("c", [f"x{i}" for i in range(3000)])], "file string, tokens array<string>")
    wins = clones.candidate_windows(arrays, 30)
    assert wins.count() == 2 * 2971 and "c" not in {r.file for r in wins.select("file").distinct().collect()}
    assert {tuple(r) for r in clones.window_buckets(wins).groupBy("file", "occurrences", "files").count().collect()} == {("a", 2, 2, 2971)}
    from assayer.operators.graph import settle

    linked = clones._linked(settle(wins), clones._frequent(wins, 100), 100)
    assert [(r.low, r.high) for r in clones._islands(linked).collect()] == [(0, 2970)]


@pytest.mark.parametrize("size,most,seed", [(5, 3, 1), (4, 2, 2), (7, 4, 3), (6, 100, 4), (2, 100, 5), (9, 5, 6)])
def test_regions_need_no_windows_inside_of_copies(spark, size, most, seed):
    import random

    rng = random.Random(seed)
    parts = [[f"p{k}.{i if k % 2 else i % 3}" for i in range(rng.randrange(3, 4 * size))] for k in range(6)]
    files = {f"f{i:02}": [w for _ in range(rng.randrange(1, 5)) for w in (rng.choice(parts) if rng.random() < 0.8 else [f"u{rng.randrange(50)}"])] for i in range(14)}
    files |= {f"g{i:02}": files[f"f{i:02}"] for i in range(0, 14, 3)} | {"lol": ["lol"] * 40, "few": ["x"], "none": []}
    long = [f"l{i}" for i in range(200)]
    files |= {"l1": ["a", *long, "b"], "l2": long, "l3": [*long[:120], "other", *long[120:]]}
    arrays = spark.createDataFrame(list(files.items()), "file string, tokens array<string>")
    wins = clones.candidate_windows(arrays, size, most)
    got = [(r.file_l, r.start_l, r.file_r, r.start_r, r.token_count) for r in clones.maximal_regions(wins, size, most).collect()]
    assert sorted(got) == sorted(plain_regions(files, size, most))
    if most > 3 or size > 5:
        assert wins.where("file = 'l2'").count() < 100 < clones.candidate_windows(arrays, size).where("file = 'l2'").count()


@pytest.mark.parametrize("size,crowd,seed", [(5, 3, 1), (3, 1, 2), (2, 4, 3)])
def test_places_of_crowds_equal_all_pairs(spark, size, crowd, seed):
    """Where windows have more places than pairs are made of, all places of all regions are found still."""
    import random

    rng = random.Random(seed)
    parts = [[f"p{k}.{i if k % 2 else i % 3}" for i in range(rng.randrange(3, 4 * size))] for k in range(5)]
    files = {f"f{i:02}": [w for _ in range(rng.randrange(1, 6)) for w in (rng.choice(parts) if rng.random() < 0.8 else [f"u{rng.randrange(9)}"])] for i in range(14)}
    files |= {f"g{i:02}": files[f"f{i:02}"] for i in range(0, 14, 2)} | {"lol": ["lol"] * 30, "lola": ["a", *["lol"] * 25, "b"], "few": ["x"], "none": []}
    long = [f"l{i}" for i in range(60)]
    files |= {f"n{i}": [*long[: 5 * i], f"e{i % 3}", *long[5 * i + 1 :]] for i in range(11)}  # copies that differ in a word
    arrays = spark.createDataFrame(list(files.items()), "file string, tokens array<string>")
    want = {p for f, i, g, j, n in plain_regions(files, size, 10**9) for p in ((f, i, n), (g, j, n))}
    assert want > {p for f, i, g, j, n in plain_regions(files, size, crowd) for p in ((f, i, n), (g, j, n))}
    got = [tuple(r) for r in clones.repeated_places(clones.candidate_windows(arrays, size, crowd), size, crowd).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_regions_are_exchanged_once_to_tell_contained_ones(spark, seed):
    import random

    rng = random.Random(seed)
    rows = sorted({(rng.choice("ab"), rng.randrange(30), rng.choice("cd"), rng.randrange(30), rng.randrange(1, 30)) for _ in range(150)} | {("x", 1, "y", 2, 9)})
    inside = lambda i, o: (i[0], i[2]) == (o[0], o[2]) and o[4] > i[4] and all(o[k] <= i[k] and i[k] + i[4] <= o[k] + o[4] for k in (1, 3))
    want = [i for i in rows if not any(inside(i, o) for o in rows)]
    df = spark.createDataFrame(rows, "file_l string, start_l int, file_r string, start_r int, token_count int")
    out = clones.non_redundant(df)
    assert 20 < len(want) < len(rows) and sorted(map(tuple, out.collect())) == want
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange") == 1


@pytest.mark.parametrize("step", ["regions", "places", "groups", "independent"])
def test_tables_of_places_are_not_broadcast(spark, monkeypatch, step):
    """However small tables are on disk: the driver would hold them unpacked."""
    plans, settle = [], clones.settle

    def told(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df)

    monkeypatch.setattr(clones, "settle", told)
    part = [f"c{j}" for j in range(14)]
    arrays = spark.createDataFrame([(f"f{i}", [f"x{i}", *part, f"y{i}", *part]) for i in range(6)], "file string, tokens array<string>")
    wins = clones.candidate_windows(arrays, 5, 3)
    if step == "regions":
        out = clones.maximal_regions(wins, 5, 3)
    elif step == "places":
        out = clones.repeated_places(wins, 5, 3)
    elif step == "groups":
        out = clones.place_groups(spark.createDataFrame([("f1", 1, 14), ("f2", 1, 14)], "file string, start int, token_count int"), arrays)
    else:
        rows = [("a", 3, [("f", 1, 3), ("g", 1, 3)]), ("b", 2, [("f", 2, 3), ("h", 1, 2)]), ("c", 2, [("h", 8, 9), ("h", 4, 5)])]
        out = clones.independent_groups(spark.createDataFrame(rows, "group_id string, token_count int, places array<struct<file: string, start_line: int, end_line: int>>"))
        assert sorted(r.group_id for r in out.collect()) == ["a", "c"]
        assert not any("rangepartitioning(token_count" in p and ", places" in p.split("rangepartitioning(")[1].split(")")[0] for p in plans)
    rows = out.collect()
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert rows and not any("BroadcastExchange" in p for p in plans)


def test_groups_exchange_tokens_as_one_string(spark):
    """Odd tokens come through as they are, and no array of them is exchanged for the places of a file."""
    odd = ['"', "\\", "\n", "\u2028", "é", "{}", ",", "[", "\x00", "null"]
    arrays = spark.createDataFrame([("a", ["x", *odd]), ("b", [*odd, "y"]), ("c", ["z"])], "file string, tokens array<string>")
    regions = spark.createDataFrame([("a", 1, "b", 0, 10)], "file_l string, start_l int, file_r string, start_r int, token_count int")
    groups = clones.fallback_groups(regions, arrays)
    assert [(r.token_count, [tuple(x) for x in r.locations]) for r in groups.collect()] == [(10, [("a", 1), ("b", 0)])]
    assert "AS packed#" in groups._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("marks", [64, 1 << 22])
def test_near_pairs_store_no_sets_but_those_compared(spark, monkeypatch, marks):
    """Sets of files without a candidate are not kept, whatever the marks of names leave in before the exchange."""
    kept, settle = [], clones.settle

    def told(df):
        out = settle(df)
        if "elements" in df.columns:
            kept.extend(r.file for r in out.select("file").collect())
        return out

    monkeypatch.setattr(clones, "settle", told)
    monkeypatch.setattr(clones, "MARKS", marks, raising=False)
    base = [f"w{i}" for i in range(100)]
    files = [(f"u{i:03}", [f"v{i}.{j}" for j in range(40)]) for i in range(150)] + [("a", base), ("b", [*base[:99], "x"]), ("c", ["y", *base[1:]])]
    arrays = spark.createDataFrame(files, "file string, tokens array<string>")
    pairs = clones.near_pairs(clones.shingle_sets(arrays, 4), 0.9)
    assert sorted((r.l, r.r, round(r.similarity, 6)) for r in pairs.collect()) == [("a", "b", round(96 / 97, 6)), ("a", "c", round(96 / 97, 6)), ("b", "c", round(95 / 97, 6))]
    assert sorted(kept) == ["a", "b", "c"]
    none = clones.near_pairs(clones.shingle_sets(arrays.where("file LIKE 'u%'"), 4), 0.9)
    assert none.count() == 0


def test_near_pairs_equal_brute_force(spark):
    import random
    from collections import Counter

    rng = random.Random(9)
    texts = {}
    for i in range(40):
        base = [f"w{rng.randrange(12)}" for _ in range(rng.randrange(20, 60))]
        texts[f"d{i:02}"] = base
        near = list(base)
        for _ in range(rng.randrange(0, 4)):
            near[rng.randrange(len(near))] = f"z{rng.randrange(5)}"
        texts[f"e{i:02}"] = near
    bag = {k: Counter(tuple(v[i : i + 3]) for i in range(len(v) - 2)) for k, v in texts.items()}
    want = set()
    for a in bag:
        for b in bag:
            n = 2 * sum((bag[a] & bag[b]).values()) / (sum(bag[a].values()) + sum(bag[b].values()))
            if a < b and n >= 0.8:
                want.add((a, b, round(n, 9)))
    arrays = spark.createDataFrame(list(texts.items()), "file string, tokens array<string>")
    got = {(r.l, r.r, round(r.similarity, 9)) for r in clones.near_pairs(clones.shingle_sets(arrays, 3), 0.8).collect()}
    assert len(want) > 10 and got == want


def test_near_pairs_exchange_prefixes(spark, monkeypatch):
    """Each set posts the front part in which a partner must meet it, not all its elements; frequent ones come last."""
    monkeypatch.setattr(clones, "ASKED", 1)
    rows = [(f"f{i}", ["of", "the", "and", "in", *(f"w{i}.{j}" for j in range(96))]) for i in range(40)]
    sets = clones.shingle_sets(spark.createDataFrame([*rows, ("twin", [*rows[0][1], "end"])], "file string, tokens array<string>"), 1)
    lists = {r.file: r.prefix for r in clones._prefixes(sets, 0.92).collect()}
    assert {len(v) for v in lists.values()} == {15} and not set(lists["f1"]) & set(lists["f2"]) and set(lists["f0"]) & set(lists["twin"])
    assert [(r.l, r.r) for r in clones.near_pairs(sets, 0.92).collect()] == [("f0", "twin")]
    assert clones.near_pairs(sets, 0.92, sets.where("file <> 'twin'")).count() == 0


def test_cohesion(spark):
    rows = [("f", "1", "T::a", ["T::b", "new"]), ("f", "2", "T::b", ["field::x"]), ("f", "3", "T::c", ["field::x", "new"]), ("f", "4", "T::d", []), ("f", "5", "U::only", [])]
    df = spark.createDataFrame([(a, b, "", c, d, True) for a, b, c, d in rows], "file string, function_id string, name string, stable_symbol string, references array<string>, structural_metrics_reliable boolean")
    got = {r.owner: (r.related, r.cohesion) for r in cohesion.module_cohesion(df).collect()}
    assert got == {"T": (2, 2 / 6), "U": (0, 1.0)}


def test_unused(spark):
    p, d = graph(spark)
    idents = spark.createDataFrame([("a", "b", 3), ("b", "a", 0), ("a", "lone", 1), ("a", "used", 2)], "package string, identifier string, production_references int")
    feats = spark.createDataFrame([("b", "x", ["dep:serde"], 0, False), ("b", "y", [], 0, False), ("b", "default", [], 0, False), ("c", "z", [], 0, False), ("c", "w", ["z"], 0, False)], "package string, name string, enables array<string>, references int, target_gated boolean")
    assert {r.evidence for r in unused.unused_dependencies(p, d, idents, feats).collect()} == {"b->a", "c->c", "d->a"}
    assert {r.symbol for r in unused.unused_features(p, feats).collect()} == {"b::feature::y"}
    f = spark.createDataFrame([("a", "m::lone", "private", []), ("a", "m::used", "private", []), ("a", "m::main", "public", ["used"])], "package string, stable_symbol string, visibility string, references array<string>")
    f = f.withColumns({"file": F.lit("a.rs"), "name": F.col("stable_symbol"), "structural_metrics_reliable": F.lit(True), "production": F.lit(True), "entry_point": F.lit(False)})
    assert [r.symbol for r in unused.unused_functions(f, idents, "private").collect()] == ["m::lone"]
    assert unused.unused_functions(f, idents, "private", ["m::lone"]).count() == 0


def test_inventory_rows_measure_the_total(spark):
    found = spark.createDataFrame([("a", "x", "e1"), ("b", "y", "e2")], "file string, symbol string, evidence string")
    rows = engine.bounded_inventory(found, "yagni.unused-module", 2).collect()
    assert [(r.measured, r.result) for r in rows] == [(2.0, "pass")] * 2
    assert {r.result for r in engine.bounded_inventory(found, "yagni.unused-module", 1).collect()} == {"fail"}
    none = engine.bounded_inventory(found.limit(0), "yagni.unused-module", 0).collect()
    assert [(r.measured, r.file, r.result) for r in none] == [(0.0, "Cargo.toml", "pass")]


def test_comparisons_at_equality(spark):
    rows = lambda c, m, a: engine.rule_rows(spark.range(1), "r", "f", "s", c, "e", m, a).first()
    assert rows("maximum", 2, 2).result == "pass" and rows("minimum", 2, 2).result == "pass"
    x = rows("maximum-exclusive", 0.92, 0.92)
    assert x.result == "fail" and x.excess == engine.EPSILON
    assert rows("informational", 9, None).result == "pass"
    b = engine.rule_rows(spark.range(1), "r", "f", "s", "boolean", "e", measured_flag=True, allowed_flag=False).first()
    assert b.result == "fail" and b.excess == 1.0 and b.violation_id == stable("r", "f", "s", "e")
    assert engine.invalid_rows(engine.rule_rows(spark.range(1), "r", "/f", "s", "maximum", "e", 1, 2)).count() == 1


def test_baseline_truth_table(spark):
    row = lambda s, m: engine.rule_rows(spark.range(1), "r", "f", s, "maximum", "e", m, 1.0)
    before = engine.union(row("same", 3), row("worse", 2), row("better", 5), row("passed", 1), row("fixed", 2), row("gone", 9))
    now = engine.union(row("same", 3), row("worse", 3), row("better", 4), row("passed", 1.0000001), row("fixed", 1), row("new", 2), row("ok", 0))
    out = engine.with_baseline(now, before)
    assert {r.stable_symbol: r.baseline for r in out.collect()} == {"same": "existing", "worse": "worsened", "better": "improved", "passed": "worsened", "fixed": "improved", "new": "new", "ok": "not-applicable"}
    none = engine.omissions(spark, [("other", "x")])
    assert [r.stable_symbol for r in engine.resolved(now, before, none).collect()] == ["gone"]
    assert engine.resolved(now, before, engine.omissions(spark, [("r", "incomplete")])).count() == 0
    assert not engine.gate(out, none.limit(0)).first().gate_passed
    calm = engine.with_baseline(row("same", 3), before)
    assert engine.gate(calm, none.limit(0)).first().gate_passed and not engine.gate(calm, none).first().gate_passed


LCOV = "TN:\nSF:./src//a.c\nDA:1,2\nDA:2,0\nDA:1,5,abc\nend_of_record\nSF:b.c\nDA:7,1\nend_of_record\n"
COBERTURA = '<coverage><sources><source>/r</source></sources><packages><package><classes><class filename="a.py"><lines><line number="3" hits="1"/><line number="4" hits="0"/></lines></class></classes></package></packages></coverage>'
PYJSON = json.dumps({"files": {"a.py": {"executed_lines": [1, 2], "missing_lines": [3]}}})
ISTANBUL = json.dumps({"k": {"path": "/r/a.ts", "statementMap": {"0": {"start": {"line": 4}}, "1": {"start": {"line": 4}}}, "s": {"0": 0, "1": 6}}})
LLVM = json.dumps({"data": [{"functions": [{"filenames": ["a.c"], "regions": [[2, 1, 3, 4, 5, 0, 0, 0]]}], "files": [{"filename": "a.c", "segments": [[2, 1, 9, True], [8, 1, 0, False]]}]}]})


@pytest.mark.parametrize("name,text,fmt,want", [
    ("x.info", LCOV, "lcov", {("src/a.c", 1, 5), ("src/a.c", 2, 0), ("b.c", 7, 1)}),
    ("x.xml", COBERTURA, "cobertura", {("a.py", 3, 1), ("a.py", 4, 0), ("/r/a.py", 3, 1), ("/r/a.py", 4, 0)}),
    ("x.json", PYJSON, "coverage-py", {("a.py", 1, 1), ("a.py", 2, 1), ("a.py", 3, 0)}),
    ("x.json", ISTANBUL, "istanbul", {("/r/a.ts", 4, 6)}),
    ("x.json", LLVM, "llvm", {("a.c", 2, 9), ("a.c", 3, 5)}),
])
def test_coverage_formats(spark, tmp_path, name, text, fmt, want):
    shape = spark.createDataFrame([(text,)], "text string").select(coverage_reports.json_shape()).first()[0]
    assert coverage_reports.detect_format(name, text, shape) == fmt
    (tmp_path / name).write_text(text)
    assert {tuple(r) for r in coverage_reports.read(spark, str(tmp_path / name)).select("file", "line", "hits").collect()} == want


def test_mutation_imports(spark):
    text = lambda x: spark.createDataFrame([(json.dumps(x),)], "text string")
    mte = {"schemaVersion": "2", "files": {"a.ts": {"language": "ts", "source": "x\nif (a == b) {}\n", "mutants": [{"id": "1", "mutatorName": "m", "replacement": "!=", "status": "Killed", "location": {"start": {"line": 2, "column": 7}, "end": {"line": 2, "column": 9}}}]}}}
    r = mutation_reports.mutation_elements(text(mte)).first()
    assert (r.file, r.line, r.original, r.status, r.operator) == ("a.ts", 2, "==", "killed", "comparison")
    cm = {"outcomes": [{"scenario": "Baseline", "summary": "Success"}, {"scenario": {"Mutant": {"name": "replace == with != in f", "file": "a.rs", "replacement": "!=", "span": {"start": {"line": 3, "column": 4}}}}, "summary": "MissedMutant", "phase_results": [{"duration": 1.5}, {"duration": 1.0}]}]}
    r = mutation_reports.cargo_mutants(text(cm)).collect()
    assert [(x.file, x.status, x.duration) for x in r] == [("a.rs", "survived", 2.5)]
    mu = {"fileReports": [{"appliedOperators": [{"testSuiteOutcome": "passed", "mutationPoint": {"mutationOperatorId": "Op", "filePath": "a.swift", "position": {"line": 1, "column": 2}}, "mutationSnapshot": {"before": "&&", "after": "||"}}]}]}
    assert mutation_reports.muter(text(mu)).first().status == "survived"
    assert len(set(mutation_reports.reserve_numbers([("p", "f", "1"), ("p", "f", "1")]))) == 2


SOURCE = '''
class A:
    def _f(self, xs):
        total = 0
        for x in xs:
            if x > 0 and x != 3:
                total += self.k * g(x)
        return total
        print("never")

def h(a, b=True):
    def inner(c):
        return c
    return inner(a) if b else None
'''


def test_python_facts(spark):
    files = spark.createDataFrame([("a.py", SOURCE, False), ("bad.py", "def (", False)], "relative string, text string, test boolean")
    got = {r.name: r for r in python_facts.python_functions(files).collect()}
    f = got["_f"]
    assert (f.complexity, f.nesting_depth, f.parameter_count, f.visibility, f.stable_symbol) == (4, 2, 2, "private", "A._f(2)")
    assert set(f.references) == {"field::k", "g", "print"} and "LOCAL" in f.normalized_tokens and "total" not in f.normalized_tokens
    assert set(got) == {"_f", "h"} and got["h"].excluded[0].s == 12
    assert [r.file for r in python_facts.parse_issues(files).collect()] == ["bad.py"]
    m = python_facts.python_mutants(files).orderBy("start_byte").collect()
    assert [(r.original, r.replacement) for r in m] == [(">", "<="), ("and", "or"), ("!=", "=="), ("*", "/"), ("True", "False")]
    assert [r.line for r in python_facts.unreachable_statements(files).collect()] == [9]
    assert python_facts.lexer_facts(files).count() > 20


def test_repository_sources(spark, tmp_path):
    for name, text in {"src/a.py": "x=1", "src/test_a.py": "x", "node_modules/b.ts": "y", "gen/c.rs": "z", "run": "#!/bin/bash\n", "skip/d.py": "q", "README": "n", ".gitignore": "skip/\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.relative: (r.language, r.generated) for r in repository.source_files(spark, str(tmp_path)).collect()}
    assert got == {"src/a.py": ("python", False), "gen/c.rs": ("rust", True), "run": ("bash", False)}
    assert repository.load_config("[kiss]\nmaximum_parameters = 3\n")["kiss"]["maximum_parameters"] == 3
    with pytest.raises(ValueError):
        repository.load_config("[odd]\n")
    assert repository.project_kinds(str(tmp_path)) == {"generic"}
    (tmp_path / "setup.py").write_text("")
    assert repository.project_kinds(str(tmp_path)) == {"python"} and {t["id"]: t["applicable"] for t in repository.mutation_tools(str(tmp_path))}["mutmut"]
    a = repository.scope_fingerprint({"filters": ["b", "a", "a"]}, {"kiss": {}, "baseline": {"x": 1}}, {})
    assert a == repository.scope_fingerprint({"filters": ["a", "b"]}, {"kiss": {}, "baseline": {}}, {}) and len(a) == 64
    meta = {"workspace_root": "/r", "workspace_members": ["a"], "packages": [{"id": "a", "name": "a", "manifest_path": "/r/crates/a/Cargo.toml", "dependencies": [{"name": "serde", "kind": None, "optional": False}, {"name": "a", "kind": "dev"}], "features": {"default": ["x"], "x": []}}]}
    p, d, f = repository.cargo_metadata(spark.createDataFrame([(json.dumps(meta),)], "text string"))
    assert [tuple(r) for r in p.collect()] == [("a", "crates/a")] and {(r.dependency, r.scope, r.internal) for r in d.collect()} == {("serde", "production", False), ("a", "development", True)} and f.count() == 2


AST = {"kind": "TranslationUnitDecl", "inner": [{"kind": "NamespaceDecl", "name": "n", "inner": [{"kind": "FunctionDecl", "name": "f", "type": {"qualType": "int  (int)"}, "range": {"begin": {"line": 2}, "end": {"line": 9}}, "inner": [
    {"kind": "ParmVarDecl"}, {"kind": "CompoundStmt", "inner": [{"kind": "IfStmt", "inner": [{"kind": "BinaryOperator", "opcode": "&&"}, {"kind": "ForStmt"}]}, {"kind": "LambdaExpr", "inner": [{"kind": "IfStmt"}]}]}]}]}, {"kind": "FunctionDecl", "name": "decl"}]}


def test_syntax_trees(spark):
    from assayer.sources import clang_ast

    one, two = json.dumps(AST), json.dumps(AST).replace("ForStmt", "NullStmt")
    rows = clang_ast.functions(spark.createDataFrame([("a.c", one), ("a.c", two)], "file string, ast string"))
    assert [(r.name, r.stable_symbol, r.start_line, r.end_line, r.complexity) for r in clang_ast.merged(rows).collect()] == [("n::f", "n::f[type:int (int)]", 2, 9, 4)]


def test_reports(spark):
    rules = engine.union(engine.rule_rows(spark.range(1), "r.a", "a b.rs", "s", "maximum", "e", 3, 1), engine.rule_rows(spark.range(1), "r.b", "c.rs", "s", "maximum", "e", 0, 1))
    doc = json.loads("".join(r.line for r in reports.sarif_document(rules).collect()))
    assert doc["version"] == "2.1.0" and [r["ruleId"] for r in doc["runs"][0]["results"]] == ["r.a"]
    assert doc["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "a%20b.rs"
    res = spark.createDataFrame([("a", 1, "==", "!=", 6, 8, "killed", 0.5)], "file string, id long, original string, replacement string, start int, end int, status string, duration double")
    src = spark.createDataFrame([("a", "c", "ab\ncd == e")], "file string, language string, source string")
    x = json.loads(reports.mutation_elements(res, src).first().json)
    assert x["mutants"][0]["location"] == {"start": {"line": 2, "column": 4}, "end": {"line": 2, "column": 6}} and x["mutants"][0]["mutatorName"] == "EqualityOperator"
    assert [r.line.split()[:2] for r in reports.human_lines(rules).collect()] == [["rules:", "2"], ["r.a", "a"]] and "r.a" in reports.native_rows(rules).first().json


def test_best_symbols_with_many_symbols_of_one_owner(spark):
    """Tests and symbols of one owner do not meet in pairs; the verdicts are those of all pairs."""
    from assayer.operators import facts

    symbols = [("p", f"p::t::f{i}") for i in range(3)] + [("p", "p::u::only"), ("p", "p::f1"), ("p", "x::t::f2"), ("q", "q::f9"), ("q", "q::g::f9"), ("p", "p::v::new"), ("p", "p::w::new")]
    refs = [("p", t, x) for t in ("p::t::check", "p::u::check", "p::other", "check", "p::u::deep::check") for x in ("t::f1", "crate::f1", "f1", "none", "crate", "x::t::f2", "a::t::f2::b", "only::f0", "new", "u::only")] + [("q", "q::g::check", "f9"), ("q", "q::h::check", "f9")]
    parts = lambda x: [y for y in re.split(r"\W", x) if y]
    cut = lambda x, p: x[len(p) :] if x[: len(p)] == p else x
    want = []
    for package, test, reference in sorted(set(refs)):
        ref, context, told = [x for x in parts(reference) if x not in ("crate", "self", "super")], cut(parts(test), [package]), {}
        for _, symbol in (s for s in symbols if s[0] == package and ref):
            path = cut(parts(symbol), [package])
            base = 3 if any(ref[i : i + len(path)] == path for i in range(len(ref))) else int(path[-1] in ref)
            told[symbol] = base + (2 if path[:-1] and context[: len(path) - 1] == path[:-1] else 0)
        best = [s for s, n in told.items() if n and n == max(told.values())]
        want += [(package, test, reference, best[0])] if len(best) == 1 else []
    out = facts.best_symbols(spark.createDataFrame(refs + refs[:3], "package string, test string, reference string"), spark.createDataFrame(symbols, "package string, symbol string"))
    assert sorted(tuple(r) for r in out.select("package", "test", "reference", "symbol").collect()) == want
    many = spark.range(3000).select(F.lit("p").alias("package"), F.concat(F.lit("p::t::f"), "id").alias("symbol"))
    asked = spark.range(3000).select(F.lit("p").alias("package"), F.lit("p::t::check").alias("test"), F.concat(F.lit("none"), "id").alias("reference"))
    met = facts.best_symbols(asked, many)
    assert met.count() == 0
    before = time.monotonic()
    met.count()
    assert time.monotonic() - before < 10  # 9,000,000 pairs by owner


def test_architecture_rules_without_production_edges_equal_the_sql(spark, tmp_path):
    """Every pair of nations has as many lines: no edge is above the mean."""
    import duckdb

    from assayer.plans import rule_queries, rule_sql

    con = duckdb.connect()
    tables = {
        "nation": "SELECT i::INT AS n_nationkey, 'NATION_' || i AS n_name, (i % 2)::INT AS n_regionkey FROM range(4) t(i)", "supplier": "SELECT i AS s_suppkey, (i % 4)::INT AS s_nationkey FROM range(4) t(i)", "customer": "SELECT i AS c_custkey, (i % 4)::INT AS c_nationkey FROM range(4) t(i)",
        "orders": "SELECT i AS o_orderkey, i AS o_custkey FROM range(4) t(i)", "lineitem": "SELECT o AS l_orderkey, s AS l_suppkey FROM range(4) a(o), range(4) b(s)",
    }
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = con.execute(rule_sql.ORACLE_SQL["architecture_rules"])
    columns = [d[0] for d in want.description]
    got = rule_queries.architecture_rules(spark, str(tmp_path)).select(*columns)
    assert [tuple(r) for r in got.collect()] == want.fetchall()


def test_cycles_behind_a_long_way_take_few_rounds(spark, monkeypatch):
    """One edge out of each node: a way of 300 nodes into a cycle of 5, a cycle of 64, and a way that ends."""
    edges = [(f"w{i:03}", f"w{i + 1:03}") for i in range(300)] + [("w300", "c1"), ("c1", "c2"), ("c2", "c3"), ("c3", "c4"), ("c4", "c5"), ("c5", "c1"), ("self", "self")]
    edges += [(f"r{i:02}", f"r{(i + 1) % 64:02}") for i in range(64)] + [("e1", "e2"), ("e2", "e3"), ("x", "r05")]
    rounds, settle = [], packages.settle
    monkeypatch.setattr(packages, "settle", lambda df: rounds.append(1) or settle(df))
    got = sorted(r.cycle for r in packages.cycles(spark.createDataFrame(edges, "a string, b string")).collect())
    assert got == [["c1", "c2", "c3", "c4", "c5"], [f"r{i:02}" for i in range(64)], ["self"]]
    assert len(rounds) < 16


def test_imported_mutants_are_parsed_once_and_ids_alone_are_exchanged(spark):
    rows = spark.createDataFrame([("a.rs", "m1", 1, 1), ("a.rs", "m2", 1, 1), ("b.rs", "m1", 1, 1)], "file string, external_id string, line int, column int")
    told = mutation_reports.checked(rows)
    assert sorted((r.file, r.external_id) for r in told.collect()) == [("a.rs", "m1"), ("a.rs", "m2"), ("b.rs", "m1")]
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    with pytest.raises(Exception, match="told twice: a.rs m2"):
        mutation_reports.checked(rows.unionByName(rows.where("external_id = 'm2'"))).collect()


def test_resolved_targets_are_summed_before_the_exchange(spark):
    f = spark.createDataFrame([("f", "T", "a", "T::x", ["x", "T::x", "y"]), ("f", "T", "b", "T::y", ["z"]), ("f", "T", "c", "T::y", ["x"])], "file string, owner string, function_id string, symbol string, references array<string>")
    told = cohesion.resolved_targets(f)
    assert sorted((r.function_id, r.target) for r in told.collect()) == [("a", "a"), ("c", "a")]
    assert "distinct" not in told._jdf.queryExecution().optimizedPlan().toString().lower()
