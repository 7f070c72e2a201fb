"""Symbols and import specifiers of source files, in Arrow batches.

Python files go through the standard library's parser. The other languages are read as code with
strings and comments blanked out, which tolerates broken text; nothing is installed for them.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

PARSED = "struct<symbols:array<struct<name:string,kind:string,line:int,signature:string>>,specs:array<string>>"
_STRINGS = {
    "script": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`",
    "go": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`",
    "rust": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\.)'",
    "java": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'",
}
_NAME = r"[A-Za-z_$][\w$]*"
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "function", "return", "with", "else", "do", "new", "await", "typeof", "super"}


class Source:
    """A text, its code with strings and comments blanked, and its string literals by position."""

    def __init__(self, text: str, kind: str):
        self.text, self.literals = text, {}

        def blank(m):
            if m[0][0] in "\"'`":
                self.literals[m.start()] = m[0][1:-1]
                return m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1]
            return re.sub(r"[^\n]", " ", m[0])

        self.code = re.sub(_STRINGS[kind], blank, text, flags=re.S)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.lines = text.split("\n")

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def closing(self, at: int, pair: str = "()") -> int:
        """Place behind the bracket that closes the one at ``at``; the end of the text if none does."""
        depth = 0
        for m in re.compile(f"[{re.escape(pair)}]").finditer(self.code, at):
            depth += 1 if m[0] == pair[0] else -1
            if not depth:
                return m.end()
        return len(self.code)


def _script(s: Source, typed: bool) -> Iterator[tuple[int, int, str, str]]:
    """(place of the name, place of the declaration, name, kind)."""
    simple = [(rf"\b(?:async\s+)?function\s+({_NAME})\s*[<(]", "function"), (rf"(?<![.\w$])(?<!abstract )class\s+(?!extends\b)({_NAME})", "class")]
    if typed:
        simple += [(rf"(?<![.\w$])interface\s+({_NAME})", "interface"), (rf"(?<![.\w$])type\s+({_NAME})\s*(?:<[^=]*>)?\s*=", "type"), (rf"(?<![.\w$])(?:const\s+)?enum\s+({_NAME})", "enum")]
    for pattern, kind in simple:
        for m in re.finditer(pattern, s.code):
            if kind != "class" or not re.search(r"[=(,:]\s*\Z", s.code[max(0, m.start() - 40) : m.start()]):
                yield m.start(1), m.start(), m[1], kind
    for m in re.finditer(rf"\b(?:const|let)\s+({_NAME})\b(?:\s*:[^=;]*(?:=>[^=;]*)?)?\s*=\s*(?:async\b\s*)?(function\b|<[^>()]*>\s*\(|\(|{_NAME}\s*=>)", s.code):
        if m[2] == "function" or m[2].endswith("=>") or re.match(r"\s*(?::[^;{}]*?)?=>", s.code[s.closing(m.end() - 1) :]):
            yield m.start(1), m.start(), m[1], "function"
    head = r"^[ \t]*(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+|[*#]\s*)*"
    for m in re.finditer(rf"{head}({_NAME})\s*(?:<[^<>()]*>)?\s*\(", s.code, re.M):
        if m[1] not in _NOT_METHODS and re.match(r"\s*(?::[^;={}]*(?:\{[^{}]*\}[^;={}]*)?)?\{", s.code[s.closing(m.end() - 1) :]):
            yield m.start(1), m.start() + len(m[0]) - len(m[0].lstrip()), m[1], "method"


def _script_specs(s: Source) -> Iterator[str]:
    for at, literal in s.literals.items():
        before = s.code[:at].rstrip()
        statement = re.split(r"[;\n](?=\s*(?:import|export)\b)", s.code[max(0, at - 2000) : at])[-1].lstrip()
        if re.search(r"\brequire\s*\(\Z", before) or (re.match(r"(?:import|export)\b", statement) and re.search(r"(?:\bfrom|\bimport)\Z", before)):
            yield literal


def _go(s: Source) -> Iterator[tuple[int, int, str, str]]:
    for m in re.finditer(r"^func\s*(\([^)]*\)\s*)?(\w+)", s.code, re.M):
        yield m.start(2), m.start(), m[2], "method" if m[1] else "function"
    for m in re.finditer(r"^[ \t]*type\s+(\(|\w+)", s.code, re.M):
        group = m[1] == "("
        start = m.end() if group else m.start(1)
        end = s.closing(m.start(1)) if group else len(s.code)
        first = None
        for t in re.finditer(r"^[ \t]*(\w+)(?:\[[^\]]*\])?\s+(=|struct\b|interface\b|\S)" if group else r"(\w+)(?:\[[^\]]*\])?\s*(=|struct\b|interface\b|\S)", s.code[start:end], re.M):
            first = first or {"struct": "struct", "interface": "interface"}.get(t[2], "type")
            yield start + t.start(1), m.start() + len(m[0]) - len(m[0].lstrip()), t[1], first
            if not group:
                break


def _go_specs(s: Source) -> Iterator[str]:
    for m in re.finditer(r"^import\s+(\(|[\w.]*\s*[\"`])", s.code, re.M):
        end = s.closing(m.start(1)) if m[1] == "(" else s.code.find("\n", m.end()) % (len(s.code) + 1)
        yield from (x for at, x in s.literals.items() if m.start() < at < end and s.code[at] == '"')


def _rust(s: Source) -> Iterator[tuple[int, int, str, str]]:
    lead = r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|default|extern(?:\s+\"[^\"]*\")?)\s+)*"
    for word, kind in (("fn", "function"), ("struct", "struct"), ("enum", "enum"), ("trait", "trait"), ("type", "type")):
        for m in re.finditer(rf"(?<![\w.]){lead}\b{word}\s+(\w+)", s.code):
            body = re.match(r"\s*(?:<[^{}]*?>)?\s*\([^{};]*\)[^{};]*;", s.code[m.end() :]) if word == "fn" else None
            if not body:  # a signature without a body is another kind of item
                yield m.start(1), m.start(), m[1], kind
    for m in re.finditer(r"^[ \t]*(?:unsafe\s+)?impl\b\s*(?:<[^{}]*?>\s*)?(?:[^{};]*?\bfor\s+)?(\w+)\s*(?:\{|where\b)", s.code, re.M):
        yield m.start(1), m.start() + len(m[0]) - len(m[0].lstrip()), m[1], "impl"


def _java(s: Source) -> Iterator[tuple[int, int, str, str]]:
    lead = r"(?:@(?!interface\b)\w+(?:\([^)]*\))?\s+|(?:public|private|protected|static|final|abstract|sealed|strictfp|synchronized|native|default|transient)\s+)*"
    for word, kind in (("class", "class"), ("@interface", "annotation"), (r"(?<!@)interface", "interface"), ("enum", "enum")):
        for m in re.finditer(rf"(?<![\w.@]){lead}{word}\s+(\w+)", s.code):
            yield m.start(1), m.start(), m[1], kind
    for m in re.finditer(rf"(?<=[;{{}}])\s*({lead})(?:<[^>]*>\s*)?(?:([\w.]+(?:<[^;{{}}()]*>)?(?:\[\])*)\s+)?(\w+)\s*\(", s.code):
        if m[3] in _NOT_METHODS or (m[2] or "") in ("new", "return", "throw", "else"):
            continue
        tail = s.code[s.closing(m.end() - 1) :]
        if re.match(r"\s*(?:throws\s+[\w.,\s]+)?\{", tail) or (m[2] and re.match(r"\s*(?:throws\s+[\w.,\s]+)?;", tail) and not re.match(r"\s*=", tail)):
            yield m.start(3), m.start() + len(m[0]) - len(m[0].lstrip()), m[3], "method" if m[2] else "constructor"


def _python(text: str) -> tuple[list[tuple], list[str]] | None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines, found, specs = text.split("\n"), [], []

    def visit(node, in_class):
        for child in ast.iter_child_nodes(node):
            inner = in_class
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                line = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                is_class = isinstance(child, ast.ClassDef)
                found.append((child.name, "class" if is_class else "method" if in_class else "function", line, lines[line - 1].strip()[:120]))
                inner = in_class or is_class
            elif isinstance(child, ast.ImportFrom):
                specs.append("." * child.level + (child.module or ""))
            elif isinstance(child, ast.Import):
                specs.extend(a.name for a in child.names if not a.asname)
            visit(child, inner)

    visit(tree, False)
    return found, specs


def _python_by_line(text: str) -> tuple[list[tuple], list[str]]:
    """For text that does not parse: declarations by indentation."""
    found, classes, decorated = [], [], None
    for i, line in enumerate(text.split("\n"), 1):
        m = re.match(r"([ \t]*)(?:(@)|(?:async\s+)?(def|class)\s+(\w+))", line)
        if m and m[2]:
            decorated = decorated or (i, line)
        elif m:
            depth = len(m[1].expandtabs())
            classes = [c for c in classes if c < depth]
            at, shown = decorated or (i, line)
            found.append((m[4], "class" if m[3] == "class" else "method" if classes else "function", at, shown.strip()[:120]))
            classes += [depth] if m[3] == "class" else []
            decorated = None
        elif line.strip():
            decorated = None
    specs = [m[1] or m[2] for m in re.finditer(r"^[ \t]*(?:from\s+([.\w]+)\s+import\b|import\s+([\w.]+)\s*$)", text, re.M)]
    return found, specs


def parse(grammar: str | None, text: str | None, line_offset: int = 0) -> dict:
    """Symbols in order of their places and distinct specifiers, for a grammar name; unknown grammars give none."""
    if not text or not grammar:
        return {"symbols": [], "specs": []}
    if grammar == "python":
        symbols, specs = _python(text) or _python_by_line(text)
    else:
        kind = {"go": "go", "rust": "rust", "java": "java"}.get(grammar, "script")
        s = Source(text, kind)
        marks = _script(s, grammar in ("typescript", "tsx")) if kind == "script" else {"go": _go, "rust": _rust, "java": _java}[kind](s)
        seen: dict[int, tuple] = {}
        for name_at, at, name, what in sorted(marks, key=lambda x: x[:2]):
            seen.setdefault(name_at, (name, what, s.line(at) + 1 + line_offset, s.lines[s.line(at)].strip()[:120]))
        symbols = [seen[k] for k in sorted(seen, key=lambda k: (seen[k][2], k))]
        if kind == "script":
            specs = list(_script_specs(s))
        elif kind == "go":
            specs = list(_go_specs(s))
        else:
            specs = [re.sub(r"\s+", " ", m[1]).strip() for m in re.finditer(r"(?<![\w.])(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);" if kind == "rust" else r"\bimport\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", s.code)]
    clean = dict.fromkeys(x for x in (re.sub("^[\"'`]|[\"'`]$", "", x).strip() for x in specs) if x)
    return {"symbols": [dict(zip(("name", "kind", "line", "signature"), x, strict=True)) for x in symbols], "specs": list(clean)}


def parse_files(files: DataFrame) -> DataFrame:
    """``files`` (path, content, ...) plus ``parsed``. Components with a script block are parsed by its language, lines counted from the file's top."""
    from loomdex.functions import text as T
    from loomdex.sources.files import vue_script

    @F.udf(PARSED, useArrow=True)
    def run(grammar, text, offset):
        return parse(grammar, text, offset or 0)

    vue = T.extension(F.col("path")) == ".vue"
    block = F.when(vue, vue_script(F.col("content")))
    d = files.withColumn("__block", block)
    grammar = F.when(vue, F.col("__block.language")).otherwise(T.grammar_of(F.col("path")))
    text = F.when(vue, F.col("__block.script")).otherwise(F.col("content"))
    return d.withColumn("parsed", run(grammar, text, F.col("__block.line_offset"))).drop("__block")
