"""Facts of sources in languages with braces, from small sources written for these tests."""

import pytest

from assayer.sources import brace_facts as bf

# (language, text, [(symbol, first line, last line, complexity, nesting, statements, parameters, visibility)])
SOURCES = {
    "c": ("""#define TWICE(x) { (x) * 2
static int pick(int n, const char *name) {
  int best = 0; /* { */
  for (int i = 0; i < n; i++) {
    if (name[i] == '{' || best > i) best = i;
  }
  while (n > 0) { n--; }
  return best ? best : n;
}
void none(void) { }
""", [("pick(2)", 2, 9, 6, 1, 7, 2, "private"), ("none(0)", 10, 10, 1, 0, 0, 0, "public")]),
    "cpp": ("""namespace shop {
class Till : public Box {
  int sum_;
public:
  Till(int a) : Box(a), sum_(0) { add(a); }
  int add(int a) { auto f = [&](int x) { return x > 0 && x < 9; }; return f(a) ? a : 0; }
private:
  bool open() const noexcept { return sum_ >= 1; }
};
}
int shop::Till::count(std::vector<int> xs, std::map<int, int> ys) { switch (xs.size()) { case 0: return 1; case 1: return 2; default: return 3; } }
""", [("shop::Till::Till(1)", 5, 5, 1, 0, 1, 1, "public"), ("shop::Till::add(1)", 6, 6, 2, 0, 2, 1, "public"), ("shop::Till::open(0)", 8, 8, 1, 0, 1, 0, "private"), ("shop::Till::count(2)", 11, 11, 3, 1, 4, 2, "public")]),
    "objective-c": ("""#import <Foo.h>
@implementation Cart
+ (int)sum:(int)a with:(int)b {
  if (a > b && self.ready) { [self note:@"x"]; }
  return a + b;
}
- (void)clear { total = 0; }
@end
""", [("Cart.sum:with:(2)", 3, 6, 3, 1, 3, 2, "public"), ("Cart.clear(0)", 7, 7, 1, 0, 1, 0, "public")]),
    "typescript": ("""export class Cart<T> extends Base {
  private total = 0;
  add(item: T, n = 1): void { if (n > 0 && item) { this.total += n } }
}
export const twice = (x: number) => {
  return x * 2;
};
function outer(a?: string) {
  function inner() { return a === "x" || a === "y"; }
  try { inner() } catch (e) { return `${e}`; }
  return a ? 1 : 2;
}
""", [("Cart.add(2)", 3, 3, 3, 1, 2, 2, "public"), ("twice(1)", 5, 7, 1, 0, 1, 1, "public"), ("outer(1)", 8, 12, 3, 1, 5, 1, "private")]),
    "swift": ("""public struct Cart {
  public init(items: [Int]) { self.items = items }
  func total(of kind: String, by n: Int) -> Int? {
    guard n > 0 else { return nil }
    for i in items where i > n { print(i) }
    return n
  }
}
extension Cart { private func reset() { items = [] } }
""", [("Cart.init(1)", 2, 2, 1, 0, 1, 1, "public"), ("Cart.total(2)", 3, 7, 3, 1, 5, 2, "internal"), ("Cart.reset(0)", 9, 9, 1, 0, 1, 0, "private")]),
    "rust": ("""impl<'a> Cart<'a> {
    pub fn pick(&self, n: u8) -> Option<u8> {
        let best = match n { 0 => 1, 1 | 2 => 2, _ => 3 };
        let c = '{'; // }
        if best > 2 && n != 1 { return None; }
        Some(self.find(best)?)
    }
}
fn plain() { loop { break; } }
""", [("Cart::pick(2)", 2, 7, 6, 1, 5, 2, "public"), ("plain(0)", 9, 9, 1, 1, 2, 0, "private")]),
    "bash": ("""#!/bin/bash
greet() {
  local name="$1"
  if [ "$name" == "x" ] || [ -z "$name" ]; then
    echo "no {"
  fi
  case "$name" in
    a) echo 1 ;;
    b) echo 2 ;;
  esac
}
function run { for f in a b; do greet "$f"; done; }
""", [("greet(0)", 2, 11, 5, 1, None, 0, "public"), ("run(0)", 12, 12, 2, 1, None, 0, "public")]),
}


@pytest.mark.parametrize("language", SOURCES)
def test_functions(language):
    text, want = SOURCES[language]
    rows = bf.functions_of("f", text, language, False)
    # file, name, symbol, first and last line, complexity, nesting, statements, parameters, tokens, references, excluded, visibility, reliable
    got = [(*r[2:7], r[7] if language != "bash" else None, r[8], r[12]) for r in rows]
    assert got == want and all(r[13] for r in rows)


def test_inner_functions_are_left_to_themselves():
    rows = {r[1]: r for r in bf.functions_of("f", SOURCES["typescript"][0], "typescript", False)}
    assert rows["outer"][11] == [{"s": 9, "e": 9}] and "inner" in rows["outer"][10]


def test_tokens_and_references_are_normalized():
    (row,) = bf.functions_of("f", 'int f(int a) { int b = a + 7; log(b, "x"); return s.size(b) + a; }', "c", False)
    assert row[9] == "int f ( int LOCAL ) { int LOCAL = LOCAL + LITERAL ; log ( LOCAL , LITERAL ) ; return s . size ( LOCAL ) + LOCAL ; }".split()
    assert row[10] == ["log", "method::size", "s"]
    s = bf.Source("rust", "fn f<'a>(x: &'a str) -> char { 'a' }")
    assert [v for v, _ in bf._normal(s, list(range(len(s.tokens))), set())].count("LIFETIME") == 2


@pytest.mark.parametrize(("language", "text", "line"), [
    ("c", "int f() {\n  if (x {\n}\n", 2), ("rust", "fn f() {\n if a > {\n }\n}", 2), ("typescript", "function f() {\n return 'x;\n}", 2), ("cpp", "int f() { return 1; }\n}\n", 2), ("swift", "func f() { /* open\n }", 1), ("bash", "f() {\n echo 1\n", 1),
])
def test_issues_make_functions_unreliable(language, text, line):
    problem = bf.Source(language, text).problem
    assert problem and problem[0] == line
    assert not any(r[13] for r in bf.functions_of("f", text, language, False))


def test_mutants_need_two_operands():
    got = bf.mutants_of("f", "int f(int *p, std::vector<int> v) {\n  return -1 + *p == 2 && p != é;\n}", "cpp")
    assert [(m[1], m[5]) for m in got] == [(2, "+"), (2, "=="), (2, "&&"), (2, "!=")]
    assert all("int f(int *p, std::vector<int> v) {\n  return -1 + *p == 2 && p != é;\n}".encode()[m[3] : m[4]].decode() == m[5] for m in got)
    assert [m[5] for m in bf.mutants_of("f", 'if [[ "$a" -gt 1 && $b == x ]]; then :; fi', "bash")] == ["-gt", "&&", "=="]
    assert [m[5] for m in bf.mutants_of("f", "let x = true || a < b;", "rust")] == ["true", "||", "<"]
    assert bf.mutants_of("f", "- (BOOL)go {\n  return YES;\n}", "objective-c")[0][5] == "YES"


def test_frames(spark):
    rows = [(f"src/a.{k}", text, k, False) for k, (text, _) in SOURCES.items()] + [("x", None, "c", False), ("y", "", "rust", True), ("z", "text", "cobol", False), ("bad.c", "int f( {", "c", False)]
    files = spark.createDataFrame(rows, "relative string, text string, language string, test boolean")
    f = bf.brace_functions(files).collect()
    assert len(f) == sum(len(w) for _, w in SOURCES.values()) and len({r.function_id for r in f}) == len(f)
    assert {r.file for r in bf.brace_issues(files).collect()} == {"bad.c"}
    m = bf.brace_mutants(files).collect()
    assert {r.file for r in m} >= {"src/a.c", "src/a.rust", "src/a.bash"} and all(r.operator and r.replacement for r in m)
    assert bf.brace_tokens(files).where("value = 'LOCAL'").count() > 20
    assert bf.brace_functions(files.limit(0)).count() == 0
