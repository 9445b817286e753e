"""Code units of source files: modules, classes, functions and methods with their lines, calls and imports."""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.common import spread
from corvine.model import unit_id
from corvine.sources.files import language_of

SCHEMA = "file_path string, namespace string, language string, name string, type string, line_start int, line_end int, signature string, docstring string, parameters array<string>, return_type string, decorators array<string>, parent string, calls array<string>, imports array<string>, complexity int"
_BRANCH = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.BoolOp, ast.IfExp, ast.comprehension)


def _dotted(n: ast.AST) -> str:
    """Name, attribute chain, base of a subscript or text of a constant; empty for anything else."""
    if isinstance(n, ast.Name):
        return n.id
    if isinstance(n, ast.Attribute):
        base = _dotted(n.value)
        return f"{base}.{n.attr}" if base else n.attr
    if isinstance(n, ast.Subscript):
        return _dotted(n.value)
    return str(n.value) if isinstance(n, ast.Constant) else ""


def python_units(code: str, stem: str) -> list[dict]:
    """P1 to P7, by the syntax tree: nothing for a file that doesn't parse. Async functions count like others."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return []
    imports = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            imports += [a.name for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            imports += [f"{n.module or ''}.{a.name}".lstrip(".") for a in n.names]
    out = [{"name": stem, "type": "Module", "line_start": 1, "line_end": code.count("\n") + 1, "docstring": ast.get_docstring(tree), "imports": imports}]

    def visit(node: ast.AST, parent: str | None, in_class: bool) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.ClassDef):
                out.append({"name": n.name, "type": "Class", "line_start": n.lineno, "line_end": n.end_lineno, "docstring": ast.get_docstring(n), "imports": [_dotted(b) for b in n.bases], "decorators": [_dotted(d) for d in n.decorator_list], "parent": parent, "signature": f"class {n.name}"})
                visit(n, n.name, True)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                params = [a.arg for a in (*n.args.posonlyargs, *n.args.args)]
                calls = sorted({c for x in ast.walk(n) if isinstance(x, ast.Call) and (c := _dotted(x.func))})
                returns = ast.unparse(n.returns) if n.returns else None
                out.append({"name": n.name, "type": "Method" if in_class else "Function", "line_start": n.lineno, "line_end": n.end_lineno, "docstring": ast.get_docstring(n), "parameters": params, "return_type": returns, "decorators": [_dotted(d.func if isinstance(d, ast.Call) else d) for d in n.decorator_list], "calls": calls, "parent": parent if in_class else None, "signature": f"def {n.name}({', '.join(params)})" + (f" -> {returns}" if returns else ""), "complexity": 1 + sum(isinstance(x, _BRANCH) for x in ast.walk(n))})
                visit(n, n.name, False)
            else:
                visit(n, parent, in_class)

    visit(tree, None, False)
    return out


_HIDE = re.compile(r"""/\*[\s\S]*?\*/|//[^\n]*|\"\"\"[\s\S]*?\"\"\"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`""")
_WORDS = frozenset("if for while switch catch return new function class super do else throw typeof await func go defer synchronized try case".split())
_DECLARES = {
    "javascript": [("Class", r"\bclass\s+(?P<name>[\w$]+)"), ("Function", r"\bfunction\s*\*?\s*(?P<name>[\w$]+)\s*\((?P<params>[^()]*)\)"), ("Function", r"\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*=\s*(?:async\s*)?(?:function\b[^(]*)?\((?P<params>[^()]*)\)[^={;]*(?:=>)?\s*(?=\{)"), ("Method", r"(?m)^[ \t]+(?:(?:static|async|get|set|public|private|protected|readonly)\s+)*(?P<name>[\w$]+)\s*\((?P<params>[^()]*)\)[^;={}()]*(?=\{)")],
    "go": [("Class", r"\btype\s+(?P<name>\w+)\s+(?:struct|interface)\b"), ("Method", r"(?m)^func\s*\(\w*\s*\*?(?P<parent>\w+)[^)]*\)\s*(?P<name>\w+)\s*\((?P<params>[^()]*)\)"), ("Function", r"(?m)^func\s+(?P<name>\w+)\s*\((?P<params>[^()]*)\)")],
    "java": [("Class", r"\b(?:class|interface|enum|record)\s+(?P<name>\w+)"), ("Method", r"(?m)^[ \t]+(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)*(?:<[^>]+>\s+)?(?:[\w.\[\]]+(?:<[^;{}()]*>)?(?:\[\])*\s+)?(?P<name>\w+)\s*\((?P<params>[^()]*)\)[^;={}()]*(?=\{)")],
}
_DECLARES["typescript"] = _DECLARES["javascript"]
_IMPORTS = {"javascript": r"""\bfrom\s+['"]([^'"]+)['"]|\brequire\(\s*['"]([^'"]+)['"]""", "go": r"""(?m)^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"$""", "java": r"\bimport\s+(?:static\s+)?([\w.*]+)\s*;"}
_IMPORTS["typescript"] = _IMPORTS["javascript"]


def brace_units(code: str, stem: str, language: str) -> list[dict]:
    """P8 to P12, by declarations: texts and comments are blanked, a unit ends where its braces close, and a method belongs
    to the innermost class around it (in Go to its receiver). A file whose braces don't close gives what is declared."""
    blank = lambda m: re.sub(r"[^\n]", " ", m.group())
    bare = _HIDE.sub(blank, code)
    ends = [m.start() for m in re.finditer("\n", bare)]
    line = lambda i: bisect_left(ends, i) + 1
    closes, stack = {}, []
    for m in re.finditer(r"[{}]", bare):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            closes[stack.pop()] = m.start()
    opens = sorted([*closes, *stack])
    found = [g for m in re.finditer(_IMPORTS[language], code) for g in m.groups() if g]
    out = [{"name": stem, "type": "Module", "line_start": 1, "line_end": code.count("\n") + 1, "imports": found}]
    spans, taken = [], set()
    for kind, pattern in _DECLARES[language]:
        for m in re.finditer(pattern, bare):
            if m.group("name") in _WORDS or m.start("name") in taken:
                continue
            taken.add(m.start("name"))
            k = bisect_left(opens, m.end() - (1 if bare[m.end() - 1 : m.end()] == "{" else 0))
            open_at = opens[k] if k < len(opens) else -1
            end = closes.get(open_at, len(bare)) if open_at >= 0 else m.end()
            g = m.groupdict()
            params = [re.split(r"[\s:=]+", p.strip())[0 if language != "java" else -1] for p in (g.get("params") or "").split(",") if p.strip()]
            calls = sorted({c for c in re.findall(r"([A-Za-z_$][\w$.]*)\s*\(", bare[open_at:end]) if c.split(".")[0] not in _WORDS}) if kind != "Class" and open_at >= 0 else []
            spans.append((m.start("name"), end, {"name": m.group("name"), "type": kind, "line_start": line(m.start("name")), "line_end": line(end), "signature": " ".join(code[m.start() : m.end()].split()), "parameters": params, "calls": calls, "parent": g.get("parent"), "complexity": None if kind == "Class" else 1 + len(re.findall(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?![.?:])", bare[open_at:end]))}))
    around: list = []  # classes that are open, the innermost last
    for a, b, unit in sorted(spans, key=lambda s: s[0]):
        while around and around[-1][0] < b:
            around.pop()
        if unit["type"] == "Method" and not unit["parent"] and around:
            unit["parent"] = around[-1][1]
        if unit["type"] == "Class":
            around.append((b, unit["name"]))
        out.append(unit)
    return out


def units(files: DataFrame) -> DataFrame:
    """Code units of (file_path, namespace, code): one row per unit, with ``id`` by the rule of corvine.model.

    The extension decides the language; files of other languages, null and empty codes give nothing, and a file that one
    parser can't read gives no rows instead of failing its task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            rows = []
            for path, ns, lang, code in zip(b["file_path"], b["namespace"], b["language"], b["code"], strict=True):
                stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                for u in python_units(code, stem) if lang == "python" else brace_units(code, stem, lang):
                    rows.append({"file_path": path, "namespace": ns, "language": lang, "parameters": [], "decorators": [], "calls": [], "imports": [], **u})
            out = pd.DataFrame(rows, columns=names).astype(object)
            yield out.where(out.notna(), None)

    lang = language_of(F.col("file_path"))
    rows = files.select("file_path", "namespace", lang.alias("language"), "code").where(F.col("language").isin("python", *_DECLARES) & (F.length("code") > 0))
    return spread(rows).mapInPandas(run, SCHEMA).withColumn("id", unit_id(F.col("file_path"), F.col("line_start"), F.col("name")))
