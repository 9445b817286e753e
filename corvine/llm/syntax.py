"""Source files that do not parse in the language of their extension."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.common import spread
from corvine.llm import lexers
from corvine.llm.gll import MEMO_LIMIT, Groups
from corvine.llm.grammars import grammars

#: Extension -> language of the supported source files.
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "java": "java"}
#: Frames of the parser's own recursion, a few for each level of brackets (they take no stack but the interpreter's own).
DEEPEST = 1_000_000
_GROUPS = Groups()
_LEX = {"java": lexers.java, "go": lexers.go}
_HEADS = {"if": ("HIf", "IF"), "elif": ("HElif", "ELIF"), "else": ("HElse", "ELSE"), "while": ("HWhile", "WHILE"), "for": ("HFor", "FOR"), "try": ("HTry", "TRY"), "except": ("HExcept", "EXCEPT"), "finally": ("HFinally", "FINALLY"), "with": ("HWith", "WITH"), "def": ("HDef", "DEF"), "class": ("HClass", "CLASS")}
_LINES: dict = {}


def extension(path: str | Column = "file_path") -> Column:
    """The lower-cased extension of a path column: what stands behind the last dot of the last segment, else empty."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def _line_kind(toks: tuple, g) -> str | None:
    """What a logical line is: a simple line, the head of a block, or a head with its body behind it (…I)."""
    if toks in _LINES:
        return _LINES[toks]
    first = toks[1] if toks[0] == "async" and len(toks) > 1 else toks[0]
    kind = None
    if first in _HEADS:
        rule, name = _HEADS[first]
        if toks[-1] == ":" and g.derives(rule, toks, _GROUPS):
            kind = name
        elif g.derives("ILine", toks, _GROUPS):
            kind = name + "I"
    elif first == "@":
        kind = "DECO" if g.derives("Deco", toks, _GROUPS) else None
    elif first == "match" and toks[-1] == ":" and g.derives("HMatch", toks, _GROUPS):
        kind = "MATCH"
    elif first == "case" and toks[-1] == ":" and g.derives("HCase", toks, _GROUPS):
        kind = "CASE"
    elif g.derives("Line", toks, _GROUPS):
        kind = "SIMPLE"
    elif first == "case" and g.derives("ICase", toks, _GROUPS):
        kind = "CASEI"
    _LINES[toks] = kind
    return kind


def _python(code: str) -> bool:
    g = grammars("py")[0]
    lines = lexers.python(code, _GROUPS, g)
    if lines is None:
        return False
    levels, outs = [0], [[]]
    opened = True  # whether a deeper line may follow
    for n, (indent, toks) in enumerate(lines):
        kind = _line_kind(toks, g)
        if not kind:
            return False
        if indent > levels[-1]:
            if not opened or n == 0:
                return False
            levels.append(indent)
            outs.append([])
        else:
            while indent < levels[-1]:
                levels.pop()
                inner = outs.pop()
                outs[-1].append(_GROUPS.intern("{", tuple(inner)))
            if indent != levels[-1]:
                return False
        out = outs[-1]
        if kind != "SIMPLE" or not out or out[-1] != "SIMPLE":
            out.append(kind)
        opened = toks[-1] == ":" and kind[-1:] != "I"
    while len(outs) > 1:
        inner = outs.pop()
        outs[-1].append(_GROUPS.intern("{", tuple(inner)))
    return g.derives("File", tuple(outs[0]), _GROUPS)


def _brackets(ext: str, code: str, g) -> bool:
    toks = lexers.js(code, _GROUPS, g) if ext in ("js", "ts") else _LEX[ext](code, _GROUPS)
    if toks is not None and g.derives("File", toks, _GROUPS):
        return True
    if ext in ("js", "ts") and ("/" in code or "`" in code):
        toks = lexers.js(code, _GROUPS, g, exact=True)
        return toks is not None and g.derives("File", toks, _GROUPS)
    return False


def parses(ext: str, code: str | None) -> bool:
    """Whether any dialect grammar of the extension accepts the text. Null and empty texts and other extensions do."""
    if not code or ext not in LANGUAGES:
        return True
    if len(_GROUPS.of) > MEMO_LIMIT:
        _GROUPS.ids.clear()
        _GROUPS.of.clear()
        _LINES.clear()
        for e in LANGUAGES:
            for g in grammars(e):
                g.memo.clear()
    if sys.getrecursionlimit() < DEEPEST:
        sys.setrecursionlimit(DEEPEST)
    return _python(code) if ext == "py" else any(_brackets(ext, code, g) for g in grammars(ext))


def syntax_errors(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(key) of the files no dialect grammar accepts; null paths and codes, other extensions and empty files are none.

    Every file is one row and is judged alone where it is read: no shuffle. ``files`` needs key, file_path and code;
    further columns don't matter.
    """
    kind = files.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bad = [not parses(e, c) for e, c in zip(b["ext"], b["code"], strict=True)]
            yield b.loc[bad, [key]]

    rows = files.select(F.col(key), extension().alias("ext"), "code").where(F.col("ext").isin(*LANGUAGES) & (F.length("code") > 0))
    return spread(rows).mapInPandas(judge, f"`{key}` {kind}")


def repository(namespace: str = "namespace") -> Column:
    """The part of the namespace before the colon, the whole without one; null stays null."""
    return F.substring_index(namespace, ":", 1)


def syntax_error_rates(files: DataFrame) -> DataFrame:
    """(repository, language, files, invalid_files, invalid_rate) of the source files. A null namespace is a group of its own.

    The verdicts are taken with the file in one pass and summed up before the shuffle.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"repository": b["repository"], "ext": b["ext"], "bad": [not parses(e, c) for e, c in zip(b["ext"], b["code"], strict=True)]})

    rows = files.select(repository().alias("repository"), extension().alias("ext"), "code").where(F.col("ext").isin(*LANGUAGES))
    judged = spread(rows).mapInPandas(judge, "repository string, ext string, bad boolean")
    language = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.col("ext")]
    return judged.groupBy("repository", language.alias("language")).agg(
        F.count("*").alias("files"), F.count_if("bad").alias("invalid_files"), F.round(F.count_if("bad") / F.count("*"), 6).alias("invalid_rate")
    )
