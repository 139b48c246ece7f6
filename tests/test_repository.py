"""Source discovery, compilation databases and report documents."""

import json

import pytest
from pyspark.sql import functions as F

from assayer.sinks import reports
from assayer.sources import mutation_reports, repository


CASES = [
    ({".gitignore": "*.log\n!keep.log\n"}, "a/b.log", True), ({".gitignore": "*.log\n!keep.log\n"}, "a/keep.log", False),
    ({".gitignore": "/only\n"}, "only", True), ({".gitignore": "/only\n"}, "a/only", False), ({".gitignore": "out/\n"}, "a/out/x.c", True), ({".gitignore": "out/\n"}, "a/out", False),
    ({".gitignore": "a/*.c\n"}, "a/b/x.c", False), ({".gitignore": "a/**/x.c\n"}, "a/b/c/x.c", True), ({".gitignore": "a/**/x.c\n"}, "a/x.c", True), ({".gitignore": "**/t\n"}, "q/t/u.c", True), ({".gitignore": "d/**\n"}, "d/e/f", True),
    ({".gitignore": "d/\n!d/e.c\n"}, "d/e.c", True), ({".gitignore": "[ab]?.c\n"}, "x/bz.c", True), ({".gitignore": "[!ab].c\n"}, "a.c", False), ({".gitignore": "\\!x.c\n\\#y\n"}, "!x.c", True),
    ({".gitignore": "*.c\n", "sub/.gitignore": "!*.c\n"}, "sub/x.c", False), ({".gitignore": "!x.c\n", ".ignore": "x.c\n"}, "x.c", True), ({"sub/.gitignore": "x.c\n"}, "subx/x.c", False), ({".gitignore": "# c\n\nx.c  \n"}, "x.c", True),
]


def test_ignore_files(spark):
    """Every case in a folder of its own; a file is left out by itself or with a folder above it."""
    files = spark.createDataFrame([(f"case{i}/{name}", text) for i, (texts, _, _) in enumerate(CASES) for name, text in texts.items()], "relative string, text string")
    paths = {f"case{i}/{'/'.join(path.split('/')[:n])}": n < path.count("/") + 1 for i, (_, path, _) in enumerate(CASES) for n in range(1, path.count("/") + 2)}
    entries = spark.createDataFrame([(p, f) for p, f in paths.items()], "relative string, folder boolean")
    out = {r.relative for r in repository.ignored(entries, repository.ignore_rules(files)).collect()}
    for i, (_, path, want) in enumerate(CASES):
        parts = path.split("/")
        assert any(f"case{i}/{'/'.join(parts[:n])}" in out for n in range(1, len(parts) + 1)) is want, CASES[i]


def test_sources_are_selected_and_none_is_cut(spark, tmp_path):
    files = {"src/a.c": "int x;", "src/gen.c": "int g;", "src/b.rs": "fn b() {}", "notes.txt": "x", "run": "#!/bin/bash\n", "plain": "no shell", "pkg/__init__.py": "x = 1", "pkg/_a.py": "y", ".hidden/h.py": "z", ".gitignore": "gen.*\n/out/\n", "out/o.py": "o", "deep/a/b/c/d.py": "d", "deep/.ignore": "c/\n!c/\n", "deep/a/.gitignore": "e.py\n", "deep/a/e.py": "e", "node_modules/n.ts": "n"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "out" / "o.py").chmod(0)
    (tmp_path / "link.py").symlink_to(tmp_path / "src" / "a.c")
    got = {r.relative: (r.language, r.text) for r in repository.source_files(spark, f"file://{tmp_path}").collect()}
    want = {"src/a.c": "c", "src/b.rs": "rust", "run": "bash", "pkg/__init__.py": "python", "pkg/_a.py": "python", ".hidden/h.py": "python", "deep/a/b/c/d.py": "python"}
    assert got == {p: (lang, files[p]) for p, lang in want.items()}
    listed = {r.relative: r.length for r in repository.listing(spark, str(tmp_path)).collect()}
    assert not {p for p in listed if p.startswith(("out/", "node_modules/"))} and listed["src/b.rs"] == 9
    with pytest.raises(Exception, match="more than 6 bytes: src/b.rs"):
        repository.source_files(spark, str(tmp_path), max_bytes=6, filters=("b.rs",)).collect()


def test_only_selected_files_are_opened(spark, tmp_path):
    """A file of another extension, an ignored and an excluded one may be unreadable."""
    for name in ("a.py", "b.bin", "skip/c.py", "target/d.rs", "x_test.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / ".gitignore").write_text("skip\n")
    files = repository.listing(spark, str(tmp_path))
    assert {r.relative for r in files.collect()} == {"a.py", "b.bin", "x_test.py", ".gitignore"}
    got = repository.read_files(files.where("relative = 'a.py'"), str(tmp_path)).collect()
    assert [(r.relative, r.text) for r in got] == [("a.py", "a.py")]
    assert [r.relative for r in repository.source_files(spark, str(tmp_path)).collect()] == ["a.py"]


def test_compile_commands(spark, tmp_path):
    entries = [
        {"directory": "build", "file": "../src/a.c", "command": "cc -DX='a b' -c ../src/a.c"}, {"directory": "/abs", "file": "/src/b.c", "arguments": ["cc", "b.c"], "output": "b.o"},
        {"directory": "build", "file": "../src/a.c", "arguments": ["cc", "-O2"]},
    ]
    path = tmp_path / "compile_commands.json"
    path.write_text(json.dumps(entries))
    got = [tuple(r) for r in repository.compile_commands(spark, str(path), base="/w").orderBy("index").collect()]
    assert got == [("/w/build", "/w/src/a.c", ["cc", "-DX=a b", "-c", "../src/a.c"], None, 0), ("/abs", "/src/b.c", ["cc", "b.c"], "b.o", 1), ("/w/build", "/w/src/a.c", ["cc", "-O2"], None, 2)]
    for wrong in ({"directory": "d", "file": "f"}, {"directory": "d", "file": "f", "arguments": ["x"], "command": "x"}, {"directory": "", "file": "f", "command": "x"}, {"directory": "d", "file": "f", "arguments": []}):
        path.write_text(json.dumps([wrong]))
        with pytest.raises(Exception, match="compilation database entry 0"):
            repository.compile_commands(spark, str(path)).collect()


@pytest.mark.parametrize("text", ["[nonsense]\n", "[dry]\nmin_token = 3\n", "[dry]\nsimilarity_threshold = 1.5\n", "[kiss]\nmaximum_parameters = 0\n", "crap = 3\n"])
def test_wrong_settings(text):
    with pytest.raises(ValueError):
        repository.load_config(text)


def test_settings_are_found_above(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "assayer.toml").write_text("[dry]\nmin_tokens = 9\n[yagni]\nmaximum_unused_modules = 0\n")
    path = repository.find_config(str(tmp_path / "a" / "b"))
    assert path == str(tmp_path / "assayer.toml")
    got = repository.load_config((tmp_path / "assayer.toml").read_text())
    assert got["dry"]["min_tokens"] == 9 and got["dry"]["shingle_tokens"] == 4


def test_imported_mutants_are_checked(spark):
    schema = "file string, external_id string, line int, column int"
    ok = [("./src/a.c", "1", 1, 1), ("src/a.c", "2", 1, 5)]
    assert [r.file for r in mutation_reports.checked(spark.createDataFrame(ok, schema)).orderBy("external_id").collect()] == ["src/a.c", "src/a.c"]
    for bad, why in (([("../a.c", "1", 1, 1)], "outside"), ([("a.c", "1", 0, 1)], "without a place"), ([("a.c", "1", 1, 1), ("a.c", "1", 2, 1)], "told twice")):
        with pytest.raises(Exception, match=why):
            mutation_reports.checked(spark.createDataFrame(bad, schema)).collect()
    with pytest.raises(Exception, match="beyond 1"):
        mutation_reports.checked(spark.createDataFrame(ok, schema), 1).collect()


def test_envelope_and_sarif_sections(spark):
    rules = spark.createDataFrame([("crap.maximum", "v1", "a b.c", "f", 9.0, "fail"), ("kiss.x", "v2", "b.c", "g", 2.0, "fail"), ("kiss.x", "v3", "b.c", "h", 1.0, "pass"), ("kiss.y", "v4", "", "h", 2.0, "fail")], "rule_id string, violation_id string, file string, stable_symbol string, measured double, result string")
    rules = rules.withColumns({"allowed": F.lit(1.0), "measured_flag": F.lit(None).cast("boolean"), "allowed_flag": F.lit(None).cast("boolean")})
    functions = spark.createDataFrame([("f", "a b.c", 0, 4, 9.0), ("g", "b.c", 5, 4, 1.0)], "name string, file string, start_line int, end_line int, crap double")
    doc = json.loads("".join(r.line for r in reports.sarif_document(rules, functions=functions).collect()))["runs"][0]
    assert [r["id"] for r in doc["tool"]["driver"]["rules"]] == ["crap-threshold", "kiss.x"]
    assert {(r["ruleId"], r["level"]) for r in doc["results"]} == {("crap-threshold", "warning"), ("kiss.x", "warning")}
    (risk,) = [r for r in doc["results"] if r["ruleId"] == "crap-threshold"]
    assert risk["locations"] == [{"physicalLocation": {"artifactLocation": {"uri": "a%20b.c"}, "region": {"startLine": 1, "endLine": 4}}}] and "partialFingerprints" not in risk
    lines = reports.envelope(spark, {"name": "assayer", "version": "1"}, {"filters": []}, {"rules": rules, "functions": functions.limit(0)})
    report = json.loads("".join(r.line for r in lines.collect()))
    assert report["schema_version"] == 1 and len(report["results"]["rules"]) == 4 and report["results"]["functions"] == [] and report["diagnostics"] == []
