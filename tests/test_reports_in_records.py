"""Record readers over split files, positions by a sweep, documents written by executors."""

import json
import random

import pytest
from pyspark.sql import functions as F

from assayer.sinks import reports
from assayer.sources import coverage_reports


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_lcov_is_read_in_many_tasks(spark, tmp_path, small_splits, end):
    rng = random.Random(1)
    want, rows = {}, []
    for i in range(600):
        rows += ["TN:", f"SF:./src/f{i % 500}.c", "FN:1,f", "DA:9"[:0] + "FNDA:3,f"]
        for _ in range(rng.randrange(0, 9)):
            line, hits = rng.randrange(1, 30), rng.randrange(4)
            rows.append(f"DA:{line},{hits}" + (",sum" if line % 5 == 0 else ""))
            key = (f"src/f{i % 500}.c", line)
            want[key] = max(hits, want.get(key, 0))
        rows.append("end_of_record")
    path = tmp_path / "all.info"
    path.write_bytes((end.join(rows) + end).encode())
    got = coverage_reports.lcov(spark, str(path))
    assert {(r.file, r.line): r.hits for r in got.collect()} == want
    assert coverage_reports.read_records(spark, "\nend_of_record", str(path)).rdd.getNumPartitions() > 4
    assert "Window" not in plan(got) and "Python" not in plan(got)


def test_lcov_without_record_ends_or_files(spark, tmp_path):
    path = tmp_path / "odd.info"
    path.write_text("DA:1,1\nSF:a.c\nDA:1,2\nSF:b.c\nDA:3,0\nSF:\nDA:4,1\n")
    assert {tuple(r) for r in coverage_reports.lcov(spark, str(path)).collect()} == {("a.c", 1, 2), ("b.c", 3, 0)}
    path.write_text("")
    assert coverage_reports.lcov(spark, str(path)).count() == 0


def test_cobertura_is_read_in_many_tasks(spark, tmp_path, small_splits):
    packages, want = [], set()
    for p in range(20):
        classes = ['<class name="none" filename="none.py"/>']
        for c in range(25):
            name = f"p{p}/c&amp;{c}.py"
            classes.append(f'<class line-rate="0.5"\n name="c{c}" filename="{name}"><methods><method name="m"><lines><line number="90" hits="{c}"/></lines></method></methods>\n<lines><line number="{c}" hits="{p}"/></lines></class>')
            for root in ("", "/a b/", "/r&/"):
                want |= {(f"{root}p{p}/c&{c}.py", 90, c), (f"{root}p{p}/c&{c}.py", c, p)}
        packages.append(f"<package><classes>{''.join(classes)}</classes></package>")
    path = tmp_path / "c.xml"
    path.write_text(f'<?xml version="1.0"?>\n<coverage><sources><source>/a b/</source><source> /r&amp; </source><source/></sources><packages>{"".join(packages)}</packages></coverage>')
    (tmp_path / "d.xml").write_text('<coverage><packages><package><classes><class filename="/abs.py"><lines><line number="1" hits="1"/></lines></class><class filename="e.py"><lines/></class><class filename=""><lines><line number="2" hits="1"/></lines></class></classes></package></packages></coverage>')
    got = coverage_reports.cobertura(spark, str(path), str(tmp_path / "d.xml"))
    assert {tuple(r) for r in got.collect()} == want | {("/abs.py", 1, 1)}
    assert coverage_reports.read_records(spark, "</class>", str(path)).rdd.getNumPartitions() > 4
    assert "Python" not in plan(got) and "Window" not in plan(got)
    (tmp_path / "e.xml").write_text('<coverage><class filename="a"><lines></class></coverage>')
    with pytest.raises(Exception, match="(?i)malformed"):
        coverage_reports.cobertura(spark, str(tmp_path / "e.xml")).collect()


def test_llvm_regions_stay_regions(spark):
    regions = [[1, 1, 1_000_000, 2, 3, 0, 0, 0], [10, 1, 20, 2, 0, 0, 0, 0], [15, 1, 40, 2, 9, 0, 0, 0], [5, 1, 6, 1, 4, 0, 0, 2]]
    text = json.dumps({"data": [{"files": [], "functions": [{"filenames": ["a.c"], "regions": regions}]}]})
    out = coverage_reports.llvm_stretches(spark.createDataFrame([(text,)], "text string"))
    assert sorted((r.start_line, r.end_line, r.hits) for r in out.collect()) == [(1, 9, 3), (10, 14, 3), (15, 20, 9), (21, 40, 9), (41, 1_000_000, 3)]


def test_positions_equal_counting(spark):
    rng = random.Random(8)
    sources = {f"f{i}": "".join(rng.choices("ab\né🙂", k=rng.randrange(0, 80))) for i in range(12)} | {"none": "", "breaks": "\n\n\n"}
    offsets = [(f, rng.randrange(0, len(t) + 1)) for f, t in sources.items() for _ in range(15)]
    src = spark.createDataFrame(list(sources.items()), "file string, source string")
    out = reports.positions(spark.createDataFrame([*offsets, ("unknown", 3)], "file string, offset int"), src)
    want = {(f, o, sources[f][:o].count("\n") + 1, o - (sources[f][:o].rfind("\n") + 1) + 1) for f, o in offsets}
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert "substring" not in plan(out)


def test_documents_are_written_by_tasks_in_order(spark, tmp_path, monkeypatch):
    rows = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("n"), F.lit("x").alias("name")).repartition(7)
    twice = spark.createDataFrame([("same",)] * 5, "name string")
    monkeypatch.setattr("pyspark.sql.DataFrame.toLocalIterator", None)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    lines = reports.envelope(spark, {"name": "t"}, {}, {"a": rows, "b": rows.limit(0), "c": twice}, twice.select(F.col("name").alias("d")))
    reports.write_document(lines, str(tmp_path / "out"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    doc = json.loads("".join(p.read_text() for p in parts))
    assert len(parts) > 1 and doc["results"]["b"] == [] and len(doc["results"]["c"]) == 5 and len(doc["diagnostics"]) == 5
    assert [r["n"] for r in doc["results"]["a"]] == sorted(range(3000), key=lambda n: json.dumps({"n": n, "name": "x"}, separators=(",", ":")))
    none = reports.document_lines(spark, ["{", "}"])
    assert [r.line for r in none.collect()] == ["{", "}"]


def test_text_report_has_its_sections_in_order(spark):
    f = spark.createDataFrame([("a.c", 3, "f", 2, 50.0, 6.5), ("b\x1b.c", 1, "g", 9, None, None), ("a.c", 1, "h", 1, 100.0, 9.0)], "file string, start_line int, name string, complexity int, coverage double, crap double")
    g = spark.createDataFrame([(2, 30, [("x", 1, 2), ("y", 3, 4)]), (1, 40, [("x", 5, 6), ("z", 7, 8)])], "number int, token_count int, locations array<struct<file:string,start_line:int,end_line:int>>")
    m = spark.createDataFrame([("a.c", 2, 1, 2, "==", "!=", "killed"), ("a.c", 1, 5, 1, "+", "-", "survived")], "file string, line int, column int, id int, original string, replacement string, status string")
    got = [r.line for r in reports.human_lines(None, f, g, m).collect()]
    assert got == [
        "risk: 3 functions, 2 over 6.00, 1 without coverage", "  a.c:1 h  complexity 1, coverage 100.00%, risk 9.00", "  a.c:3 f  complexity 2, coverage 50.00%, risk 6.50", "  b\\u{1b}.c:1 g  complexity 9, coverage unknown, risk unknown",
        "clones: 2 groups", "  1: 40 tokens in x:5-6, z:7-8", "  2: 30 tokens in x:1-2, y:3-4",
        "mutants: 2, 1 killed, 1 survived", "  a.c:1:5 #1 + -> - survived", "  a.c:2:1 #2 == -> != killed",
    ]
