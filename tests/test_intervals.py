"""Interval joins, containment and independent groups against brute force, and what they may shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import clones, coverage, intervals, mutation


def spans(rng, n, files=3, top=500):
    out = []
    for i in range(n):
        s = rng.randrange(top)
        out.append((f"f{rng.randrange(files)}", i, s, s + rng.choice([0, 0, 1, 3, 17, 64, 200, -1])))
    return out


def test_cells_cover_each_number_of_a_span_once(spark):
    cases = [(0, 0), (5, 5), (0, 63), (1, 62), (7, 1000), (4095, 4096), (9, 8), (2**31 - 5, 2**31 + 5), (-7, 9)]
    rows = spark.createDataFrame(cases, "s long, e long").select("s", "e", intervals.span_cells(F.col("s"), F.col("e")).alias("c")).collect()
    for r in rows:
        covered = [x for c in r.c for x in range(c.cell << c.level, (c.cell + 1) << c.level)]
        assert sorted(covered) == list(range(r.s, r.e + 1))
        assert len(r.c) <= max(1, 2 * (r.e - r.s + 2).bit_length())


def test_stab_equals_all_pairs(spark):
    rng = random.Random(1)
    some, points = spans(rng, 120), [(f"f{rng.randrange(3)}", i, rng.randrange(520)) for i in range(200)] + [("f0", 900, None)]
    s = spark.createDataFrame(some, "file string, span int, s int, e int")
    p = spark.createDataFrame(points, "file string, point int, at int")
    got = sorted((r.point, r.span) for r in intervals.stab(p, "at", s, "s", "e", ["file"]).collect())
    assert got == sorted((j, i) for f, j, x in points for g, i, a, b in some if f == g and x is not None and a <= x <= b)
    none = s.where("s < 0")
    assert intervals.stab(p, "at", none, "s", "e", ["file"]).count() == 0


def test_intersections_equal_all_pairs(spark):
    rng = random.Random(2)
    a, b = spans(rng, 80), spans(rng, 90)
    x = spark.createDataFrame(a, "file string, i int, s1 int, e1 int")
    y = spark.createDataFrame(b, "file string, j int, s2 int, e2 int")
    got = sorted((r.i, r.j) for r in intervals.intersecting(x, y, ("s1", "s2"), ("e1", "e2"), ["file"]).collect())
    assert got == sorted((i, j) for f, i, s, e in a for g, j, t, u in b if f == g and s <= e and t <= u and s <= u and t <= e)


def test_a_hot_file_makes_cells_and_no_product(spark):
    """One file, 20,000 lines and 2,000 functions of 10 lines: 40 million pairs would be looked at by a
    join on the file alone."""
    f = spark.range(2000).select(F.concat(F.lit("f"), "id").alias("function_id"), F.lit("hot.c").alias("file"), (F.col("id") * 10).cast("int").alias("start_line"), (F.col("id") * 10 + 9).cast("int").alias("end_line"), F.array().cast("array<struct<s:int,e:int>>").alias("excluded"))
    lines = spark.range(20_000).select(F.lit("hot.c").alias("file"), F.col("id").cast("int").alias("line"), (F.col("id") % 3).alias("hits"))
    assert intervals.with_span_cells(f, "start_line", "end_line").count() <= 2000 * 2 * 4
    assert intervals.with_point_cells(lines, "line", f, "start_line", "end_line").count() == 20_000 * 4
    owned = coverage.owned_lines(f, lines)
    plan = owned._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan and "level" in plan
    assert owned.count() == 20_000


def test_owned_lines_leave_excluded_ranges_out(spark):
    rng = random.Random(4)
    fs, lines = [], [(f"f{rng.randrange(2)}", x, rng.randrange(3)) for x in range(300)]
    for g, i, s, e in spans(rng, 60, 2, 250):
        fs.append((f"n{i}", g, s, e, None if i % 7 == 0 else [(s + 2, s + 9), (s + 20, s + 21), (e - 3, e)][: i % 4]))
    f = spark.createDataFrame(fs, "function_id string, file string, start_line int, end_line int, excluded array<struct<s:int,e:int>>")
    got = sorted((r.function_id, r.line, r.hits) for r in coverage.owned_lines(f, spark.createDataFrame(lines, "file string, line int, hits int")).collect())
    want = sorted((n, x, h) for n, g, s, e, ex in fs for lf, x, h in lines if lf == g and s <= x <= e and not any(a < x < b for a, b in ex or []))
    assert got == want


def test_mutants_take_the_smallest_function_around_them(spark):
    rng = random.Random(6)
    fs = [(f"n{i}", g, f"n{i}", "" if i % 3 else f"s{i}", s, e) for g, i, s, e in spans(rng, 70, 2, 200)]
    ms = [(i, f"f{rng.randrange(3)}", "", "", "==", rng.randrange(260)) for i in range(150)]
    f = spark.createDataFrame(fs, "function_id string, file string, name string, stable_symbol string, start_line int, end_line int")
    m = spark.createDataFrame(ms, "id int, file string, stable_symbol string, operator string, original string, line int")
    got = {r.id: r.stable_symbol for r in mutation.fill_symbols(m, f).collect()}
    for i, g, _, _, _, x in ms:
        around = [(e - s, sym or n) for n, h, _, sym, s, e in fs if h == g and s <= x <= e]
        assert got[i] == (min(around)[1] if around else f"{g}::<module>")


def test_regional_coverage_counts_lines_by_stretches(spark):
    rng = random.Random(7)
    regions = [(f"n{rng.randrange(5)}", s, e, rng.randrange(3)) for _, _, s, e in spans(rng, 60, 1, 120)]
    regions.append(("far", 1, 1_000_000_000, 1))
    hits = {}
    for n, s, e, h in regions[:-1]:
        for x in range(s, e + 1):
            hits.setdefault(n, {})[x] = max(h, hits.get(n, {}).get(x, 0))
    df = spark.createDataFrame(regions, "function_id string, start_line int, end_line int, hits long")
    got = {r.function_id: r.coverage for r in coverage.regional_percent(df).collect()}
    want = {n: 100.0 * sum(h > 0 for h in x.values()) / len(x) for n, x in hits.items()}
    assert got.pop("far") == 100.0 and got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in want)
    stretches = intervals.greatest_stretches(df.withColumnRenamed("function_id", "file"), ["file"])
    assert stretches.count() <= 2 * len(regions)
    plain = {(n, x): h for n, some in hits.items() for x, h in some.items()}
    made = {(r.file, x): r.hits for r in stretches.where("file <> 'far'").collect() for x in range(r.start_line, r.end_line + 1)}
    assert made == plain


def test_spans_that_meet_within_one_table(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), i, (s := rng.randrange(40)), s + rng.choice([-1, 0, 1, 5, 30])) for i in range(80)] + [("a", 80, 3, 9), ("a", 81, 3, 9)]
    got = intervals.intersecting_itself(spark.createDataFrame(rows, "file string, i int, s int, e int"), "s", "e", ["file"])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    want = sorted((x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and max(x[2], y[2]) <= min(x[3], y[3]))
    assert sorted((r.a.i, r.b.i) for r in got.collect()) == want


def inside(i, o):
    return i[0] == o[0] and i[2] == o[2] and o[4] > i[4] and o[1] <= i[1] and i[1] + i[4] <= o[1] + o[4] and o[3] <= i[3] and i[3] + i[4] <= o[3] + o[4]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_containment_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = set()
    for _ in range(250):
        s = rng.randrange(60)
        rows.add((rng.choice("ab"), s, "c", max(0, s + rng.choice([0, 0, 1, -1, 5, 20, -20])), rng.randrange(1, 40)))
    rows = [*rows, ("a", 3, "c", 3, 7), ("lone", 0, "c", 0, 3), ("lone", 0, "c", 0, 3)]
    df = spark.createDataFrame(rows, "file_l string, start_l int, file_r string, start_r int, token_count int")
    got = clones.non_redundant(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Python" not in plan
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if not any(inside(r, o) for o in rows))
    assert clones.non_redundant(df.limit(0)).count() == 0


GROUPS = "group_id string, token_count int, places array<struct<file:string,start_line:int,end_line:int>>"


def greedy(rows):
    covered, kept = {}, []
    for g, _, places in sorted(rows, key=lambda r: (-r[1], [tuple(p) for p in r[2]], len(r[2]), r[0])):
        if sum(all(e < s or t < b for s, t in covered.get(f, ())) for f, b, e in places) >= 2:
            kept.append(g)
            for f, b, e in places:
                covered.setdefault(f, []).append((b, e))
    return sorted(kept)


@pytest.mark.parametrize("files,size", [(2, 12), (30, 6), (6, 30)])
def test_groups_in_rounds_equal_one_greedy_pass(spark, files, size):
    rng = random.Random(files)
    rows = []
    for i in range(150):
        places = sorted({(f"f{rng.randrange(files)}", rng.randrange(80)) for _ in range(rng.randrange(2, 6))})
        n = rng.randrange(1, size)
        rows.append((f"g{i:03}", rng.randrange(20, 30), [(f, s, s + n) for f, s in places]))
    out = clones.independent_groups(spark.createDataFrame(rows, GROUPS))
    assert sorted(r.group_id for r in out.collect()) == greedy(rows)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "Pandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_groups_in_a_long_chain_and_of_one_file(spark):
    chain = [(f"g{i:03}", 9, [("a", 3 * i, 3 * i + 4), ("b", 3 * i, 3 * i + 4)]) for i in range(12)]
    same = [(f"s{i}", 5, [("z", 1, 9), ("z", 20 + i, 30 + i), ("z", 50, 60)]) for i in range(20)]
    rows = chain + same + [("lone", 50, [("q", 1, 2)]), ("none", 50, [])]
    assert sorted(r.group_id for r in clones.independent_groups(spark.createDataFrame(rows, GROUPS)).collect()) == greedy(rows)
    assert clones.independent_groups(spark.createDataFrame([], GROUPS)).count() == 0
