"""Facts of sources in the C family, TypeScript, Swift, Rust and Bash: functions, tokens, mutants, issues.

No parser of these languages is at hand, so facts come from tokens and matched brackets: a function is a
head that its language has, parameters in parentheses and a body in braces. Brackets that do not match,
and literals or comments that do not end, make the file's functions unreliable and give an issue, so that
rules report omissions for them instead of numbers. As with Python sources, this one step runs for each
file in ``mapInPandas`` and yields the fact tables.

Defined results: null and empty texts give no rows; a function in a function is a boundary of its own
(its decisions are not its owner's) and is no row; equal symbols of a file are told apart by their tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.columns import C_FAMILY, mutation_operator, mutation_replacement
from assayer.sources.python_facts import FUNCTIONS, disambiguate

LANGUAGES = (*C_FAMILY, "typescript", "swift", "rust", "bash")
_CONTROL = {"if", "for", "while", "switch", "catch", "return", "sizeof", "do", "else", "match", "guard", "until", "foreach", "synchronized", "case", "throw", "new", "delete", "alignof", "decltype", "typeof", "await", "in"}
_DECISIONS = {
    **dict.fromkeys(C_FAMILY, {"if", "for", "while", "case", "catch"}),
    "typescript": {"if", "for", "while", "case", "catch"}, "swift": {"if", "for", "while", "case", "catch", "guard"}, "rust": {"if", "for", "while"}, "bash": {"if", "elif", "for", "while", "until"},
}
_NESTING = {"if", "for", "while", "do", "switch", "try", "match", "loop", "repeat", "guard", "until", "foreach", "case", "unsafe"}
_KEYWORDS = _CONTROL | set(
    "break continue default goto const static struct class enum union void int char long short float double bool unsigned signed auto inline extern public private protected virtual override template typename namespace using this self super "
    "function let var export import from async yield of instanceof interface type implements extends readonly func init deinit mutating inout is as try throws rethrows fn pub mut impl trait mod use crate where loop move ref dyn unsafe "
    "then fi done esac elif local echo nil null undefined true false True False YES NO typedef volatile register explicit friend operator noexcept final constexpr open internal fileprivate extension protocol id".split()
)
_LITERAL_WORDS = {"true", "false", "nil", "null", "undefined", "YES", "NO", "nullptr", "NULL"}
_BOOLEANS = {"true", "false", "YES", "NO"}
_COMPARED = {"==", "!=", "<", ">", "<=", ">=", "&&", "||"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_STRING = r'"(?:\\.|[^"\\])*+"'
_PLAIN = r"(?P<skip>\s+)|(?P<note>//[^\n]*|/\*(?:.*?\*/))|(?P<str>{strings})|(?P<num>(?<![\w.])\d[\w.]*)|(?P<name>{names})|(?P<op>{ops}|[^\w\s])"
_OPS = r"===|!==|<<=|>>=|\.\.\.|\.\.<|\.\.=|==|!=|<=|>=|&&|\|\||->|=>|::|\+\+|--|\+=|-=|\*=|/=|\?\?|\?\."
_FORMS = {
    **dict.fromkeys(C_FAMILY, (r'(?:@|L|u8?|U|R)?' + _STRING + r"|'(?:\\.|[^'\\\n])+'", r"[^\W\d]\w*")),
    "typescript": (_STRING + r"|'(?:\\.|[^'\\])*+'|`(?:\\.|[^`\\])*+`", r"(?:[^\W\d]|\$)[\w$]*"),
    "swift": (r'""".*?"""|' + _STRING, r"`?[^\W\d]\w*`?"),
    "rust": (r'b?r(?P<hash>#*)".*?"(?P=hash)|b?' + _STRING + r"|b?'(?:\\[^']+|[^'\\\n])'", r"(?:r#|')?[^\W\d]\w*"),
}
_BASH = re.compile(
    r"(?P<skip>[ \t\r]+|\\\n)|(?P<line>\n)|(?P<note>(?<![^\s;(])\#[^\n]*)|(?P<here><<-?\s*(['\"]?)(?P<word>\w+)\5[^\n]*\n.*?\n\s*(?P=word)(?=\n|\Z))|(?P<str>\"(?:\\.|[^\"\\])*+\"|\$?'[^']*'|\$\{[^}]*\}|\$[\w@#?*!$-])"
    r"|(?P<num>\b\d+\b)|(?P<op>-(?:eq|ne|gt|ge|lt|le)\b|==|!=|<=|>=|&&|\|\||;;|\[\[|\]\]|\(\(|\)\)|\$\(\(|\$\()|(?P<name>[A-Za-z_][\w-]*)|(?P<sign>[^\w\s])",
    re.S,
)


def _lexemes(language: str) -> re.Pattern:
    if language == "bash":
        return _BASH
    strings, names = _FORMS[language]
    return re.compile(_PLAIN.format(strings=strings, names=names, ops=_OPS), re.S)


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    line: int
    mate: int = -1


@dataclass
class Source:
    """A file's tokens without layout and comments, brackets matched."""

    language: str
    text: str
    tokens: list[Token] = field(default_factory=list)
    problem: tuple[int, str] | None = None

    def __post_init__(self) -> None:
        text, line, open_ = self.text, 1, []
        if self.language in C_FAMILY:  # directives take their lines
            text = re.sub(r"(?m)^[ \t]*#(?!import\b.*;)(?:[^\n\\]|\\.|\\\n)*", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
        for m in _lexemes(self.language).finditer(text):
            kind = m.lastgroup if m.lastgroup != "hash" else "str"
            kind = {"sign": "op", "here": "str", "word": "str"}.get(kind, kind)
            if kind == "op" and m[0] == "'" and self.language in (*C_FAMILY, "typescript") or kind == "op" and m[0] in '"`':
                self.problem = self.problem or (line, "a literal does not end")
            if kind == "op" and text.startswith("/*", m.start()):
                self.problem = self.problem or (line, "a comment does not end")
                break
            if kind not in ("skip", "note") and (kind != "line" or self.tokens and self.tokens[-1].kind != "line"):
                self.tokens.append(Token(kind, m[0], m.start(), m.end(), line))
            line += m[0].count("\n")
        for i, t in enumerate(self.tokens):
            if t.kind != "op" or self.language == "bash" and t.text not in ("{", "}"):
                continue
            if t.text in _OPEN:
                open_.append(i)
            elif t.text in _CLOSE:
                if open_ and _OPEN[self.tokens[open_[-1]].text] == t.text:
                    t.mate = open_.pop()
                    self.tokens[t.mate].mate = i
                else:
                    self.problem = self.problem or (t.line, f"{t.text} closes nothing")
        for a, t, b in zip(self.tokens, self.tokens[1:], self.tokens[2:]):
            if self.language != "bash" and t.kind == "op" and t.text in _COMPARED and a.end < t.start and b.text in (")", "]", "{", "}", ";"):
                self.problem = self.problem or (t.line, f"{t.text} lacks an operand")
        if open_:
            self.problem = self.problem or (self.tokens[open_[-1]].line, f"{self.tokens[open_[-1]].text} is not closed")

    def at(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""


@dataclass
class Function:
    name: str
    owner: list[str]
    head: int  # first token of the declaration
    params: tuple[int, int]  # tokens within the parentheses
    body: tuple[int, int]  # braces


def _named_block(s: Source, i: int) -> str | None:
    """The name that an opening brace gives to what it holds: of a class, an extension, a module."""
    j, words = i - 1, []
    while j >= 0 and i - j < 60 and s.at(j) not in ("{", "}", ";"):
        words.append(s.at(j))
        j -= 1
    words.reverse()
    for k, w in enumerate(words):
        if w in ("class", "struct", "enum", "extension", "protocol", "interface", "namespace", "trait", "mod", "module", "union") and k + 1 < len(words):
            name = next((x for x in words[k + 1 :] if re.fullmatch(r"[A-Za-z_$][\w$]*", x)), None)
            return None if "(" in words[k:] and s.language in C_FAMILY and w != "class" else name
        if w == "impl":
            rest = words[words.index("for") + 1 :] if "for" in words[k:] else re.sub(r"^<.*?>", "", " ".join(words[k + 1 :])).split()
            return next((x for x in rest if re.fullmatch(r"[A-Za-z_]\w*", x)), None)
    return None


def _back_to_statement(s: Source, i: int) -> int:
    while i > 0 and s.at(i - 1) not in ("{", "}", ";") and s.tokens[i - 1].kind != "line":
        if s.language in ("cpp", "c", "objective-c") and s.at(i - 1) == ":" and s.at(i - 2) in ("public", "private", "protected"):
            break
        if s.language in ("typescript", "swift") and s.tokens[i - 1].line < s.tokens[i].line and s.at(i - 1) not in (",", "(", "="):
            break
        i -= 1
    return i


def _head(s: Source, brace: int) -> Function | None:
    """The function whose body an opening brace begins, if it begins one."""
    lang, j = s.language, brace - 1
    if lang == "bash":
        while j >= 0 and s.tokens[j].kind == "line":
            j -= 1
        if s.at(j) == ")" and s.at(j - 1) == "(" and s.tokens[j - 2].kind == "name":
            return Function(s.at(j - 2), [], j - 3 if s.at(j - 3) == "function" else j - 2, (j, j), (brace, s.tokens[brace].mate))
        if s.tokens[j].kind == "name" and s.at(j - 1) == "function":
            return Function(s.at(j), [], j - 1, (j, j), (brace, s.tokens[brace].mate))
        return None
    end = (brace, s.tokens[brace].mate)
    if lang in ("rust", "swift"):
        k = j
        while k >= 0 and s.at(k) not in ("{", "}", ";"):
            if s.at(k) in ("fn", "func", "init", "deinit", "subscript") and (s.at(k) != "init" or s.at(k - 1) != "."):
                p = k + 1
                while p < brace and s.at(p) != "(":
                    p += 1
                if p >= brace or s.tokens[p].mate > brace:
                    return None
                return Function(s.at(k + 1) if s.at(k) in ("fn", "func") else s.at(k), [], _back_to_statement(s, k), (p + 1, s.tokens[p].mate), end)
            k -= 1
        return None
    if lang == "objective-c":
        for k in range(_back_to_statement(s, brace), brace):
            if s.at(k) in ("-", "+") and s.at(k + 1) == "(":
                p = s.tokens[k + 1].mate + 1
                parts = [s.at(x) + ":" for x in range(p, brace) if s.at(x + 1) == ":"] or [s.at(p)]
                return Function("".join(parts), [], k, (p, brace), end)
    if lang == "typescript" and s.at(j) == "=>":
        p = j - 1
        if s.at(p) != ")":
            while p > 0 and s.at(p) not in (")", "=", ";", "{", "}"):
                p -= 1
        if s.at(p) != ")":
            return None
        o = s.tokens[p].mate
        n = o - 1
        while n > 0 and s.at(n) in ("async", "="):
            n -= 1
        while n > 0 and s.at(n) not in ("const", "let", "var", ";", "{", "}", "(", ","):
            n -= 1
        named = s.at(n) in ("const", "let", "var")
        return Function(s.at(n + 1) if named else "", [], _back_to_statement(s, n), (o + 1, p), end)
    # name ( parameters ) and what may stand before the body
    k = j
    while k >= 0 and s.at(k) != ")":
        if s.at(k) in ("{", "}", ";", "=", "else", "do", "try", "return") or s.tokens[k].kind in ("str", "num"):
            return None
        k -= 1
    if k < 0 or s.tokens[k].mate < 0:
        return None
    o = s.tokens[k].mate
    if lang == "cpp" and s.at(o - 2) in (",", ":") and s.tokens[o - 1].kind == "name":  # initializers of a constructor
        x = o - 2
        while x > 0 and s.at(x) not in (";", "{", "}"):
            if s.at(x) == ":" and s.at(x - 1) == ")":
                k, o = x - 1, s.tokens[x - 1].mate
                break
            x -= 1
    n = o - 1
    if s.at(n) == ">" and lang == "typescript":
        while n > 0 and s.at(n) != "<":
            n -= 1
        n -= 1
    if lang == "cpp" and s.at(n) == "]":
        return Function("", [], n, (o + 1, k), end)  # a lambda
    if n < 0 or s.tokens[n].kind != "name" or s.at(n) in _CONTROL:
        return Function("", [], n, (o + 1, k), end) if s.at(n) == "function" else None
    if lang == "typescript" and s.at(n - 1) in (".", "new"):
        return None
    name = s.at(n)
    owner = []
    while lang == "cpp" and s.at(n - 1) == "::":
        owner.insert(0, s.at(n - 2))
        n -= 2
    return Function(name, owner, _back_to_statement(s, n), (o + 1, k), end)


def functions_in(s: Source) -> tuple[list[Function], list[Function]]:
    """(functions that are rows, all functions): named ones that lie in no other function."""
    rows: list[Function] = []
    every: list[Function] = []
    owners: list[tuple[int, str]] = []
    inside = -1
    implementation = ""
    for i, t in enumerate(s.tokens):
        while owners and owners[-1][0] < i:
            owners.pop()
        if s.language == "objective-c" and t.text in ("implementation", "interface") and s.at(i - 1) == "@":
            implementation = s.at(i + 1)
        if t.text == "end" and s.at(i - 1) == "@":
            implementation = ""
        if t.text != "{" or t.kind != "op" or t.mate < 0:
            continue
        found = _head(s, i)
        if found:
            every.append(found)
            if i > inside and found.name:
                found.owner = [*(n for _, n in owners), *([implementation] if implementation and s.at(found.head) in "+-" else []), *found.owner]
                rows.append(found)
            inside = max(inside, t.mate)
        elif i > inside:
            name = _named_block(s, i)
            if name:
                owners.append((t.mate, name))
    return rows, every


def _own(s: Source, f: Function, every: list[Function]) -> list[int]:
    """Tokens of a body without those of functions in it."""
    gaps = [(g.body[0], g.body[1]) for g in every if f.body[0] < g.body[0] and g.body[1] < f.body[1]]
    out, skip = [], -1
    ends = dict(gaps)
    for i in range(f.body[0] + 1, f.body[1]):
        if i <= skip:
            continue
        if i in ends:
            skip = ends[i]
            continue
        out.append(i)
    return out


def _parameters(s: Source, f: Function) -> list[list[int]]:
    low, high = f.params
    if s.language == "objective-c" and s.at(f.head) in ("-", "+"):
        return [[x] for x in range(low + 1, high) if s.tokens[x].kind == "name" and s.at(x - 1) == ")"]
    parts, i, depth = [[]], low, 0
    while i < high:
        t = s.at(i)
        if t in _OPEN and s.tokens[i].mate > 0:
            parts[-1] += range(i, s.tokens[i].mate + 1)
            i = s.tokens[i].mate
        else:
            depth += {"<": 1, ">": -1}.get(t, 0)
            if t == "," and depth <= 0:
                parts.append([])
            else:
                parts[-1].append(i)
        i += 1
    parts = [p for p in parts if p]
    return [] if s.language in C_FAMILY and len(parts) == 1 and [s.at(x) for x in parts[0]] == ["void"] else parts


def _local_names(s: Source, f: Function, own: list[int]) -> set[str]:
    lang, out = s.language, set()
    word = lambda i: s.tokens[i].kind == "name" and s.at(i) not in _KEYWORDS if 0 <= i < len(s.tokens) else False
    for part in _parameters(s, f):
        if lang in C_FAMILY:
            names = [x for x in part if word(x)]
            out |= {s.at(names[-1])} if names else set()
        else:
            stop = next((k for k, x in enumerate(part) if s.at(x) in (":", "=", "?")), len(part))
            out |= {s.at(x) for x in part[:stop] if word(x)}
    for i in own:
        before, after = s.at(i - 1), s.at(i + 1)
        if not word(i):
            continue
        if lang == "bash":
            if after == "=" and s.tokens[i].end == s.tokens[i + 1].start or before in ("local", "for", "read", "declare"):
                out.add(s.at(i))
        elif lang in C_FAMILY:
            typed = s.tokens[i - 1].kind == "name" and before not in _CONTROL or before in ("*", "&") and s.tokens[i - 2].kind == "name" and s.at(i - 2) not in _CONTROL and s.at(i - 3) in ("{", "}", ";", "(", "const")
            if typed and after in ("=", ";", ",", "[", ":", ")"):
                out.add(s.at(i))
        elif before in ("let", "var", "const", "for", "mut", "ref") or before == "(" and s.at(i - 2) in ("let", "catch"):
            out.add(s.at(i))
    return out


def _normal(s: Source, order: list[int], local: set[str]) -> list[tuple[str, int]]:
    out = []
    for i in order:
        t = s.tokens[i]
        if t.kind in ("str", "num") and not (s.language == "bash" and t.text.startswith("$")) or t.text in _LITERAL_WORDS:
            out.append(("LITERAL", t.line))
        elif t.kind == "str":
            out.append(("LOCAL" if t.text.strip("${}") in local or t.text[1:].isdigit() else t.text, t.line))
        elif t.kind != "line":
            lifetime = s.language == "rust" and t.text.startswith("'")
            out.append(("LIFETIME" if lifetime else "LOCAL" if t.kind == "name" and t.text in local else t.text, t.line))
    return out


def _decisions(s: Source, own: list[int]) -> int:
    n, words = 0, _DECISIONS[s.language]
    for i in own:
        t = s.tokens[i]
        if t.kind == "name":
            n += t.text in words and s.at(i - 1) not in (".", "#") and not (s.language == "swift" and t.text == "case" and s.at(i - 1) in ("if", "guard", "for", "while"))
            if t.text == "match" and s.language == "rust":
                j = i + 1
                while j < len(s.tokens) and s.at(j) != "{":
                    j = s.tokens[j].mate + 1 if s.tokens[j].mate > j else j + 1
                arms, k = 0, j + 1
                while 0 < j and k < s.tokens[j].mate:
                    arms += s.at(k) == "=>"
                    k = s.tokens[k].mate + 1 if s.tokens[k].mate > k else k + 1
                n += max(arms - 1, 0)
        elif t.kind == "op":
            n += t.text in ("&&", "||")
            if t.text == "?":
                optional = s.language == "swift" and s.tokens[i - 1].end == t.start or s.language == "typescript" and s.at(i + 1) in (":", ")", ",", ";")
                n += not optional
            n += t.text == ";;" and s.language == "bash"
    return n


def _depth(s: Source, f: Function, own: list[int]) -> int:
    if s.language == "bash":
        depth = best = 0
        for i in own:
            word = s.at(i)
            if s.tokens[i].kind == "name" and s.at(i - 1) not in ("echo",):
                depth += (word in ("if", "for", "while", "until", "case")) - (word in ("fi", "done", "esac"))
                best = max(best, depth)
        return best
    best, open_ = 0, []
    within = set(own)
    for i in own:
        while open_ and open_[-1] < i:
            open_.pop()
        if s.at(i) == "{" and s.tokens[i].mate > 0:
            j, control = i - 1, False
            while j > f.body[0] and s.at(j) not in ("{", "}", ";"):
                if s.tokens[j].kind == "name" and s.at(j) in _NESTING and j in within:
                    control = True
                j = s.tokens[j].mate - 1 if s.at(j) in _CLOSE and 0 <= s.tokens[j].mate < j and s.at(j) != "}" else j - 1
            control = control or s.at(i - 1) in ("else", "do", "try")
            if control:
                open_.append(s.tokens[i].mate)
                best = max(best, len(open_))
    return best


def _statements(s: Source, own: list[int]) -> int:
    """Starts of statements: after a brace, a semicolon, a label, the condition of a control statement
    or, where lines end statements, a line."""
    lines_end = s.language in ("swift", "typescript")
    n, fresh, paren, last, label = 0, True, -1, 0, False
    arms = set()  # braces of a match hold arms
    for i in own:
        if s.at(i) == "match" and s.language == "rust":
            j = next((k for k in range(i, len(s.tokens)) if s.at(k) == "{"), i)
            arms.add(j)
    for i in own:
        t = s.tokens[i]
        if t.kind == "line":
            fresh = True
            continue
        if i <= paren:
            continue
        if lines_end and last and t.line > last and t.kind in ("name", "num") and s.at(i - 1) not in (",", "=", "+", "-", "&&", "||", "(", ".", "?", ":"):
            fresh = True
        last = t.line
        if t.text in ("{", "}", ";", ";;"):
            fresh, label = i not in arms, False
            continue
        if fresh:
            label = t.text in ("case", "default")
            n += not label and t.text not in ("else", "catch", "finally", "then", "fi", "done", "esac", "do", ")", "elif") and s.at(i - 1) != "else"
            fresh = t.text in ("else", "then", "do") and s.language == "bash" or t.text == "else" and s.at(i + 1) not in ("if", "{")
        elif t.text == ":" and label:
            fresh, label = True, False
        if t.text in ("(", "[") and t.mate > i:
            paren = t.mate
            fresh = fresh or s.at(i - 1) in ("if", "for", "while") and s.at(t.mate + 1) not in ("{", ";")
    return n


def _visibility(s: Source, f: Function) -> str:
    head = {s.at(x) for x in range(f.head, f.params[0])}
    if s.language == "rust":
        return "public" if "pub" in head else "private"
    if s.language == "swift":
        return "public" if head & {"public", "open"} else "private" if head & {"private", "fileprivate"} else "internal"
    if s.language == "typescript":
        return "private" if "private" in head or f.name.startswith("#") else "public" if "export" in head or f.owner else "private"
    if s.language == "c":
        return "private" if "static" in head else "public"
    if s.language == "cpp" and f.owner:
        i, depth = f.head, 0
        while i > 0:
            i -= 1
            if s.at(i) == "}" and s.tokens[i].mate >= 0:
                i = s.tokens[i].mate
            elif s.at(i) == "{":
                return "private" if "class" in {s.at(x) for x in range(max(0, i - 8), i)} else "public"
            elif s.at(i) in ("public", "private", "protected") and s.at(i + 1) == ":":
                return s.at(i) if s.at(i) != "protected" else "private"
    return "public"


def functions_of(file: str, text: str, language: str, test: bool) -> list[tuple]:
    s = Source(language, text)
    rows, every = functions_in(s)
    out = []
    for f in rows:
        own = _own(s, f, every)
        local = _local_names(s, f, own)
        params = _parameters(s, f)
        tokens = [v for v, _ in _normal(s, list(range(f.head, f.body[1] + 1)), local)]
        refs = set()
        for i in own:
            t = s.tokens[i]
            if t.kind != "name" or t.text in _KEYWORDS:
                continue
            if s.at(i - 1) in (".", "->", "?."):
                if s.at(i + 1) == "(":
                    refs.add("method::" + t.text)
                elif s.at(i - 2) in ("self", "this"):
                    refs.add("field::" + t.text)
            elif t.text not in local:
                refs.add(t.text)
        inner = [g for g in every if f.body[0] < g.body[0] and g.body[1] < f.body[1]]
        mark = "::" if language in ("rust", "cpp") else "."
        out.append((
            file, f.name, mark.join([*f.owner, f.name]) + f"({len(params)})", s.tokens[f.head].line, s.tokens[f.body[1]].line, 1 + _decisions(s, own), _depth(s, f, own), _statements(s, own), len(params),
            tokens, sorted(refs), [{"s": s.tokens[g.head].line, "e": s.tokens[g.body[1]].line} for g in inner], _visibility(s, f), s.problem is None, not test, f.name == "main",
        ))
    return out


_BINARY = {"==", "!=", "<", ">", "<=", ">=", "&&", "||", "+", "-", "*", "/", "-eq", "-ne", "-gt", "-ge", "-lt", "-le"}


def mutants_of(file: str, text: str, language: str) -> list[tuple]:
    """Operators between two operands, and boolean literals: file, line, column, start and end byte, original."""
    s, out = Source(language, text), []
    breaks = [-1, *(m.start() for m in re.finditer("\n", text))]
    for i, t in enumerate(s.tokens):
        if t.kind == "name" and t.text in _BOOLEANS and s.at(i - 1) != ".":
            ok = language != "bash"
        elif t.kind == "op" and t.text in _BINARY and 0 < i < len(s.tokens) - 1:
            a, b = s.tokens[i - 1], s.tokens[i + 1]
            left = a.kind in ("num", "str") or a.kind == "name" and (a.text not in _KEYWORDS or a.text in ("self", "this", *_LITERAL_WORDS)) or a.text in (")", "]", "))", "]]")
            right = b.kind in ("num", "str") or b.kind == "name" and b.text not in _CONTROL or b.text in ("(", "!", "-", "$((", "$(", "[[", "[", "@", "&", "*")
            if language == "objective-c" and a.line < t.line and b.text == "(":
                continue  # the sign of a method
            spaced = (a.end < t.start) == (t.end < b.start)
            wide = a.end < t.start and t.end < b.start
            ok = left and right and spaced and (wide or t.text not in ("<", ">", "*"))
            if language == "bash" and t.text in ("<", ">", "+", "-", "*", "/"):
                ok = ok and any(x.text in ("((", "$((") for x in s.tokens[max(0, i - 12) : i])
        else:
            continue
        if ok:
            at, end = len(text[: t.start].encode()), len(text[: t.end].encode())
            out.append((file, t.line, t.start - breaks[t.line - 1], at, end, t.text))
    return out


def _frames(rows_of, schema: str, names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, text, language, test in zip(b.relative, b.text, b.language, b.test, strict=True):
                if text and language in LANGUAGES:
                    rows += rows_of(file, text, language, bool(test))
            yield pd.DataFrame(rows, columns=names)

    return lambda files: files.select("relative", "text", "language", "test").mapInPandas(run, schema)


def brace_functions(files: DataFrame) -> DataFrame:
    """``files``: relative, text, language, test."""
    names = [c.split()[0] for c in re.split(r", (?![es]:)", FUNCTIONS)]
    rows = lambda f, t, g, test: [(r[0], f"{r[0]}::{r[2]}", *r[1:]) for r in disambiguate(functions_of(f, t, g, test))]
    return _frames(rows, FUNCTIONS, names)(files)


def brace_tokens(files: DataFrame) -> DataFrame:
    """(file, index, line, value) of whole files."""

    def rows(file: str, text: str, language: str, _: bool) -> list[tuple]:
        s = Source(language, text)
        _rows, every = functions_in(s)
        local = set().union(*(_local_names(s, f, _own(s, f, every)) for f in every))
        return [(file, i, ln, v) for i, (v, ln) in enumerate(_normal(s, list(range(len(s.tokens))), local))]

    return _frames(rows, "file string, index long, line int, value string", ["file", "index", "line", "value"])(files)


def brace_issues(files: DataFrame) -> DataFrame:
    def rows(file: str, text: str, language: str, _: bool) -> list[tuple]:
        problem = Source(language, text).problem
        return [(file, *problem)] if problem else []

    return _frames(rows, "file string, line int, message string", ["file", "line", "message"])(files)


def brace_mutants(files: DataFrame) -> DataFrame:
    """Candidates: file, line, column, start_byte, end_byte, original, replacement, operator; empty symbol and fingerprint."""
    found = _frames(lambda f, t, g, _: [(*r, g) for r in mutants_of(f, t, g)], "file string, line int, column int, start_byte long, end_byte long, original string, language string", ["file", "line", "column", "start_byte", "end_byte", "original", "language"])(files)
    out = found.withColumn("replacement", mutation_replacement("language", "original")).where("replacement IS NOT NULL")
    return out.withColumns({"operator": mutation_operator("original"), "stable_symbol": F.lit(""), "fingerprint": F.lit("")}).drop("language")
